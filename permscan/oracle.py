"""The registered queries as SQL for another engine, over the same tables."""

import math

from .functions.scalars import ERF_SMALL, ERFC_LARGE, ERFC_MIDDLE
from .queries import SQL_GROUPING, SQL_JOIN, SQL_SETS, SQL_WHERE, SQL_WINDOW
from .tables import MISSING_BRAND, PERMUTATIONS, RUNS

NUMBER = "'^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$'"

PERM = f"""permutations as (
  select 'perm_'||lpad(cast(perm as string),4,'0') as source_file, cast(perm as int) as perm_id,
    cast(p_partkey as int) as variant_id, p_name,
    cast((p_partkey*37)%1000+1 as double)/1001 as af,
    cast((p_partkey*7907+perm*104723)%99989+1 as double)/99991 as filter_pvalue,
    case when (p_partkey+perm)%101=0 then null
         else cast((p_partkey*7919+perm*104729+p_partkey*perm*31)%99991+1 as double)/99991 end as lrt_pvalue,
    cast((p_partkey*17+perm*13)%2001-1000 as double)/1000 as beta,
    cast((p_partkey*11+perm*7)%500 as double)/1000 as beta_std_err,
    cast((p_partkey*3+perm)%50 as double)/1000 as variant_h2,
    case when (p_partkey+perm)%20=0 then 'bad-chisq,high-bse'
         when (p_partkey+perm)%33=0 then 'af-filter' else '' end as notes
  from part cross join range(1,{RUNS + 1}) as t(perm))"""

VAR = f"""variants as (select cast(p_partkey as int) as variant_id, p_name||'#'||cast(p_partkey as string) as variant
  from part where p_brand<>'{MISSING_BRAND}')"""

RES = "results as (select p.*, v.variant from permutations p join variants v on p.variant_id=v.variant_id)"

PHENO = "pheno as (select cast(c_custkey as string) as sample, c_acctbal as phenotype from customer)"

SHUFFLED = f"""pr as (select perm from range(1,{PERMUTATIONS + 1}) as t(perm)),
ord as (select sample, phenotype, row_number() over (order by sample) as i from pheno),
sh as (select perm, sample, row_number() over (partition by perm
        order by md5('84:'||cast(perm as string)||':'||sample), sample) as i from ord cross join pr),
permuted as (select cast(sh.perm as int) as perm_id, tgt.sample, src.phenotype
  from sh join ord src on src.sample=sh.sample join ord tgt on tgt.i=sh.i)"""

PRES = """pres as (select distinct cast(o_custkey as string) as sample, o_orderpriority||'_'||o_orderstatus as variant
  from orders join pheno on pheno.sample=cast(o_custkey as string))"""

MOMENTS = "st as (select count(*) as n, avg(phenotype) as my, var_pop(phenotype)*count(*) as syy from pheno)"

FIT = """k as (select variant, count(*) as k from pres group by variant),
s as (select t.*, st.n, cast(k.k as double)/st.n as af, st.syy,
   k.k-cast(k.k as double)*k.k/st.n as sxx, t.t-k.k*st.my as sxy from t join k on k.variant=t.variant cross join st)"""

STATS = """round(af,9) as af, round(sxy/sxx,6) as beta, round(sqrt((syy-sxy*sxy/sxx)/((n-2)*sxx)),6) as beta_std_err,
  round(-n*ln(1-sxy*sxy/(sxx*syy)),6) as lrt_stat"""

RAW = """raw as (select cast(c_custkey as string) as id,
  case when c_custkey%7=0 then 'NA' when c_custkey%11=0 then '' when c_custkey%13=0 then 'abc'
       else cast(c_custkey*2 as string) end as t1,
  case when c_custkey%5=0 then '1d' when c_custkey%3=0 then ' 2.5 ' else 'NaN' end as t2 from customer)"""

EVENTS = """ev as (select user_id as job, event_id as perm_id, value as elapsed,
  case when event_type='error' then 1 else 0 end as failed from events)"""

LISTS = "fv as (select 'f'||cast(l_linenumber as string) as f, cast(l_partkey as string) as variant from lineitem)"

SETS = """u as (select f, count(distinct variant) as d from fv group by f),
sh as (select a.f, count(*) as shared from (select distinct f, variant from fv) a
  join (select distinct variant from fv where f=(select min(f) from fv)) b on a.variant=b.variant group by a.f),
base as (select d from u where f=(select min(f) from fv))"""


def _printed(column: str) -> str:
    """A value as result files carry it: three digits, 32 bits."""
    return f"cast(cast(cast(printf('%.2E',{column}) as double) as float) as double)"


def _with(*parts: str) -> str:
    return "with " + ",\n".join(parts) + "\n"


def _polynomial(coefficients: list[float], x: str) -> str:
    value = f"{coefficients[0]!r}::double"
    for coefficient in coefficients[1:]:
        value = f"({value}*{x}+{coefficient!r}::double)"
    return value


def _chi2_tail(statistic: str) -> str:
    """Upper tail of the chi-square distribution with one degree of freedom, as erfc(sqrt(x/2))."""
    q = f"(greatest({statistic},0)/2)"
    y, inverse = f"sqrt{q}", f"(1/{q})"

    def ratio(pair, x):
        return f"({_polynomial(pair[0], x)}/{_polynomial(pair[1], x)})"

    return f"""case when {y}<=0.46875 then 1-{y}*{ratio(ERF_SMALL, q)}
 when {y}<=4 then exp(-{q})*{ratio(ERFC_MIDDLE, y)}
 else exp(-{q})*({1 / math.sqrt(math.pi)!r}::double-{inverse}*{ratio(ERFC_LARGE, inverse)})/{y} end"""


# The observed trait and the permutations, their sums over carriers, and the statistics.
SCANNED = [
    PHENO,
    SHUFFLED,
    PRES,
    MOMENTS,
    "every as (select 0 as perm_id, sample, phenotype from pheno union all select * from permuted)",
    """t as (select p.perm_id, g.variant, sum(p.phenotype) as t from pres g join every p on p.sample=g.sample
  group by p.perm_id, g.variant)""",
    FIT,
    """f as (select 'perm_'||lpad(cast(perm_id as string),4,'0') as source_file, perm_id, variant, af, sxy/sxx as beta,
   sqrt((syy-sxy*sxy/sxx)/((n-2)*sxx)) as beta_std_err, sxy*sxy/(sxx*syy) as variant_h2,
   -n*ln(1-sxy*sxy/(sxx*syy)) as lrt_stat
  from s where af between 0.05 and 0.95 and sxx>0)""",
]
RUN_ROWS = _with(*SCANNED) + f"""select source_file, perm_id, variant, {_printed("af")} as af, {_printed("beta")} as beta,
  {_printed("beta_std_err")} as beta_std_err, '' as notes from f"""


FILES = f"""files as (
  select source_file, cast(dense_rank() over (order by variant_id)-1 as int) as variant_id,
    p_name||'#'||cast(variant_id as string) as variant, {_printed("af")} as af,
    {_printed("filter_pvalue")} as filter_pvalue, {_printed("lrt_pvalue")} as lrt_pvalue,
    {_printed("beta")} as beta, {_printed("beta_std_err")} as beta_std_err,
    {_printed("variant_h2")} as variant_h2, notes
  from permutations)"""


def _trait(column: str) -> str:
    return f"select id as sample, try_cast(trim({column}) as double) as phenotype from raw where regexp_matches(trim({column}),{NUMBER})"


def _verdict(lines: str) -> str:
    """The layout that files (source_file, row_idx, variant) call for, judged from their rows."""
    return f"""select n_union, sum_unique, all_same_set, all_identical, case when all_identical then 'normalized'
  when all_same_set then 'set_normalized' when n_union<sum_unique*0.8 then 'set_normalized_overlap' else 'inline' end as verdict
from (select (select count(distinct variant) from {lines}) as n_union,
  (select cast(sum(d) as bigint) from (select count(distinct variant) as d from {lines} group by source_file) x) as sum_unique,
  (select count(*)=0 from (select source_file, list_sort(list(distinct variant)) as held from {lines} group by source_file) x
   where held<>(select list_sort(list(distinct variant)) from {lines}
                where source_file=(select min(source_file) from {lines}))) as all_same_set,
  (select count(*)=0 from (select source_file, list(variant order by row_idx) as held from {lines} group by source_file) x
   where held<>(select list(variant order by row_idx) from {lines}
                where source_file=(select min(source_file) from {lines}))) as all_identical) y"""


def _case(name: str, *files: str) -> str:
    rows = " union all ".join(files)
    return f"select '{name}' as \"case\", v.* from ({_with(f'l as ({rows})')}{_verdict('l')}) v"


PARTS = "select p_partkey as k, p_name||'#'||cast(p_partkey as string) as variant from part"
LAYOUT_CASES = "\nunion all\n".join(
    _case(name, *[f"select '{f}' as source_file, {at} as row_idx, variant from ({PARTS}) p where {held}" for f, at, held in files])
    for name, files in {
        "identical": [("a", "k", "true"), ("b", "k", "true")],
        "same set": [("a", "k", "true"), ("b", "-k", "true")],
        "overlap": [("a", "k", "k%10<7"), ("b", "k", "k%10>2")],
        "disjoint": [("a", "k", "k%10<5"), ("b", "k", "k%10>=5")],
    }.items()
)


def _layout_check(column: str) -> str:
    lines = f"""select source_file, variant_id as row_idx, {column} as variant from files
  where source_file in (select distinct source_file from files order by source_file limit 3)"""
    counts = "(select count(distinct source_file) from l) as n_files, (select count(*) from l) as n_rows"
    return f"select '{column}' as \"of\", v.* from ({_with(PERM, FILES, f'l as ({lines})')}select {counts}, w.* from ({_verdict('l')}) w) v"


ORACLE = {
    "pooled_null": _with(PERM)
    + """select count(*) as n, count(lrt_pvalue) as n_non_null, min(lrt_pvalue) as min,
  quantile_cont(lrt_pvalue,0.01) as p01, quantile_cont(lrt_pvalue,0.5) as median,
  quantile_cont(lrt_pvalue,0.99) as p99, max(lrt_pvalue) as max, avg(lrt_pvalue) as mean,
  stddev(lrt_pvalue) as stddev from permutations""",
    "per_run_summary": _with(PERM)
    + """select source_file, count(*) as n, min(lrt_pvalue) as min, avg(lrt_pvalue) as mean, max(lrt_pvalue) as max
from permutations group by source_file order by source_file""",
    "minp_threshold": _with(PERM)
    + """select quantile_cont(mn,0.05) as threshold
from (select source_file, min(lrt_pvalue) as mn from permutations group by source_file) x""",
    "column_quantiles": _with(PERM)
    + """select quantile_cont(beta,0.1) as q10, quantile_cont(beta,0.5) as q50, quantile_cont(beta,0.9) as q90
from permutations""",
    "results_view": _with(PERM, VAR, RES) + "select source_file, variant_id, variant, lrt_pvalue, notes from results",
    "orphan_rows": _with(PERM, VAR)
    + """select source_file, variant_id from permutations p
where not exists (select 1 from variants v where v.variant_id=p.variant_id)""",
    "top_hits": _with(PERM, VAR, RES)
    + """select source_file, variant_id, variant, lrt_pvalue from results
order by lrt_pvalue asc nulls last, source_file, variant_id limit 20""",
    "top_hits_descending": _with(PERM, VAR, RES)
    + """select source_file, variant_id, variant, filter_pvalue from results
order by filter_pvalue desc nulls last, source_file, variant_id limit 50""",
    "effect_z_rank": _with(PERM)
    + """select source_file, variant_id, case when beta_std_err=0 then null else beta/beta_std_err end as z
from permutations order by abs(case when beta_std_err=0 then null else beta/beta_std_err end) desc nulls last,
  source_file, variant_id limit 20""",
    "effect_z_all": _with(PERM)
    + """select source_file, variant_id, case when beta_std_err=0 then null else beta/beta_std_err end as z
from permutations""",
    "h2_rank": _with(PERM)
    + """select source_file, variant_id, variant_h2 from permutations
order by variant_h2 desc nulls last, source_file, variant_id limit 20""",
    "qc_rows": _with(PERM)
    + "select source_file, variant_id, notes from permutations where notes<>'' and af between 0.05 and 0.95",
    "qc_flag_counts": _with(PERM)
    + """select source_file, flag, count(*) as n
from (select source_file, unnest(string_split(notes,',')) as flag from permutations where notes<>'') x
group by source_file, flag""",
    "qc_flag_totals": _with(PERM)
    + """select flag, count(*) as n
from (select unnest(string_split(notes,',')) as flag from permutations where notes<>'') x group by flag""",
    "empirical_p_variant": _with(
        PERM, "o as (select variant_id, lrt_pvalue as obs from permutations where perm_id=1 and lrt_pvalue is not null)"
    )
    + """select o.variant_id, count(*) as n_null,
  avg(case when d.lrt_pvalue<=o.obs then cast(1 as double) else cast(0 as double) end) as empirical_p
from o join permutations d on o.variant_id=d.variant_id
where d.perm_id<>1 and d.lrt_pvalue is not null group by o.variant_id""",
    "empirical_p_pooled": _with(
        PERM,
        """h as (select lrt_pvalue as v, sum(case when perm_id<>1 then 1 else 0 end) as c
  from permutations where lrt_pvalue is not null group by lrt_pvalue)""",
        "cum as (select v, cast(sum(c) over (order by v) as double)/sum(c) over () as ep from h)",
    )
    + "select d.variant_id, cum.ep as empirical_p from permutations d join cum on d.lrt_pvalue=cum.v where d.perm_id=1",
    "bh_qvalues": _with(
        PERM,
        """r as (select source_file, variant_id, lrt_pvalue as p,
  count(*) over (partition by source_file order by lrt_pvalue) as rk,
  count(*) over (partition by source_file) as m from permutations where lrt_pvalue is not null)""",
    )
    + """select source_file, variant_id,
  least(cast(1 as double), min(p*m/rk) over (partition by source_file order by p desc)) as q_value from r""",
    "trait_extract": _with(RAW) + _trait("t1"),
    "trait_valid_counts": _with(RAW, f"a as ({_trait('t1')})", f"b as ({_trait('t2')})")
    + """select 't1' as trait, count(*) as n_valid from a union all select 't2' as trait, count(*) as n_valid from b""",
    "master_file_traits": _with(RAW, f"a as ({_trait('t1')})", f"b as ({_trait('t2')})")
    + "select 't1' as trait, * from a union all select 't2' as trait, * from b",
    "phenotype_file": _with(PHENO) + "select sample, phenotype from pheno",
    "keyed_permutation": _with(PHENO, SHUFFLED) + "select perm_id, sample, phenotype from permuted",
    "numpy_permutation_moments": _with(PHENO)
    + f"""select cast(perm as int) as perm_id, count(*) as n, count(distinct sample) as n_samples,
  min(phenotype) as min, max(phenotype) as max, round(avg(phenotype),4) as mean
from pheno cross join range(1,{PERMUTATIONS + 1}) as t(perm) group by perm""",
    "permuted_files": _with(PHENO, SHUFFLED)
    + "select 'perm_'||lpad(cast(perm_id as string),4,'0') as source_file, sample, phenotype from permuted",
    "assoc_scan": _with(
        PHENO,
        SHUFFLED,
        PRES,
        MOMENTS,
        """t as (select p.perm_id, g.variant, sum(p.phenotype) as t from pres g join permuted p on p.sample=g.sample
  group by p.perm_id, g.variant)""",
        FIT,
    )
    + f"select perm_id, variant, {STATS} from s where af between 0.05 and 0.95 and sxx>0",
    "assoc_observed": _with(
        PHENO,
        PRES,
        MOMENTS,
        "t as (select g.variant, sum(p.phenotype) as t from pres g join pheno p on p.sample=g.sample group by g.variant)",
        FIT,
    )
    + f"select variant, {STATS} from s where af between 0.05 and 0.95 and sxx>0",
    "redundancy_verdict": _with(
        LISTS,
        SETS,
        """agg as (select (select count(distinct variant) from fv) as n_union, cast(sum(u.d) as bigint) as sum_unique,
  min(case when u.d=sh.shared and u.d=(select d from base) then 1 else 0 end)=1 as all_same_set
  from u join sh on u.f=sh.f)""",
    )
    + """select n_union, sum_unique, all_same_set,
  case when all_same_set then 'set_normalized' when n_union<sum_unique*0.8 then 'set_normalized_overlap'
       else 'inline' end as verdict from agg""",
    "redundancy_sets": _with(LISTS, SETS)
    + """select u.f as source_file, u.d as n_unique, sh.shared as n_shared,
  (u.d=sh.shared and u.d=(select d from base)) as same_set from u join sh on u.f=sh.f""",
    "set_normalize": """with src as (select l_returnflag||l_linestatus||cast(cast(l_quantity as int) as string) as variant from lineitem),
dict as (select variant, cast(row_number() over (order by variant)-1 as int) as variant_id from (select distinct variant from src) x)
select d.variant_id, count(*) as n from src s join dict d on s.variant=d.variant group by d.variant_id""",
    "variant_dictionary": """select cast(row_number() over (order by variant)-1 as int) as variant_id, variant
from (select distinct p_brand||' '||p_type||' '||p_name as variant from part) x""",
    "convert_normalized": _with(PERM, FILES)
    + "select source_file, variant_id, variant, lrt_pvalue, beta, notes from files",
    "convert_inline": _with(PERM, FILES) + "select source_file, variant, af, filter_pvalue, variant_h2 from files",
    "convert_set_normalized": _with(PERM, FILES)
    + """select source_file, cast(dense_rank() over (order by variant)-1 as int) as variant_id, variant, beta_std_err
from files""",
    "convert_events": _with(PERM)
    + """select distinct source_file as name, 'converted' as status, true as timed, 'source_file='||source_file as txt_path,
  'inline' as parquet_path, cast(null as string) as error from permutations""",
    "convert_growing": _with(
        PERM,
        """first as (select p_name||'#'||cast(variant_id as string) as variant, count(*) as n from permutations
  where perm_id<=2 and variant_id%3=0 group by 1)""",
        """later as (select p_name||'#'||cast(variant_id as string) as variant, count(*) as n from permutations
  where perm_id between 3 and 4 group by 1)""",
        "names as (select variant, 1 as version from first union all select variant, 2 from later where variant not in (select variant from first))",
    )
    + """select cast(row_number() over (order by version, variant)-1 as int) as variant_id, variant, version,
  coalesce((select n from first f where f.variant=names.variant),0)
    +coalesce((select n from later l where l.variant=names.variant),0) as n_rows from names""",
    "stream_set_normalized": _with(PERM)
    + f"""select source_file, p_name||'#'||cast(variant_id as string) as variant, {_printed("lrt_pvalue")} as lrt_pvalue
from permutations where perm_id<=4 and variant_id%5>=perm_id-1""",
    "deletion_ledger": _with(PERM)
    + "select distinct source_file as name, 'deleted' as outcome, 'absent' as second from permutations where perm_id<=3",
    "event_progress": _with(PERM)
    + f"""select count(distinct source_file) as n_converted, 0::bigint as n_failed, {RUNS + 5}-count(distinct source_file) as n_left
from permutations""",
    "event_states": _with(
        EVENTS,
        "placed as (select *, row_number() over (partition by job order by perm_id desc) as nth, count(*) over (partition by job) as n from ev)",
        """r as (select job, cast(sum(1-failed) as bigint) as c, cast(sum(failed) as bigint) as f, max(n) as n,
  avg(elapsed) filter (where nth<=10) as m from placed group by job)""",
    )
    + """select cast(job as string) as job, c as n_converted, f as n_failed, round(m,6) as mean_elapsed,
  round(m*greatest(60-n,0),6) as eta_seconds, case when n<60 then 'running' when f>0 then 'error' else 'done' end as state from r""",
    "order_differences": f"""with p as ({PARTS}), n as (select max(k)+1 as n from p),
lists as (select 'f2' as source_file, k as row_idx, case when k%1000=7 then variant||'?' else variant end as variant from p
  union all select 'f3', n-1-k, variant from p cross join n
  union all select 'f4', k, variant from p cross join n where k<n-10
  union all select 'f5', k, variant from p
  union all select 'f5', n, 'extra' from n),
names as (select distinct source_file from lists),
ref as (select source_file, k as row_idx, variant from p cross join names),
met as (select coalesce(l.source_file,r.source_file) as source_file, coalesce(l.row_idx,r.row_idx) as row_idx,
  r.variant as expected, l.variant as found from lists l full join ref r on l.source_file=r.source_file and l.row_idx=r.row_idx)
select source_file, row_idx, expected, found from met where expected is distinct from found
qualify row_number() over (partition by source_file order by row_idx)=1""",
    "layout_cases": LAYOUT_CASES,
    "layout_check": _layout_check("variant") + "\nunion all\n" + _layout_check("notes"),
    "run_names": """select p_partkey, 'perm_'||cast(p_partkey as string)||case when p_partkey%2=0 then '.v1' else '' end as source_file
from part""",
    "preview_rows": _with(PERM, "r as (select source_file, variant_id, notes from permutations where variant_id<=20)")
    + """select source_file, variant_id, notes, (select count(*) from r) as total from r
order by variant_id, source_file limit 200""",
    "stream_inline": _with(PERM, FILES) + "select source_file, variant, lrt_pvalue from files",
    "read_column": _with(PERM, FILES) + "select filter_pvalue from files",
    "file_listing": _with(PERM) + "select distinct source_file from permutations",
    "raw_file": _with(PERM)
    + """select p_name||'#'||cast(variant_id as string) as variant,
  cast(printf('%.2E',beta_std_err) as double) as beta_std_err, source_file from permutations""",
    "file_row_counts": _with(PERM) + "select source_file, count(*) as n from permutations group by source_file",
    "redundancy_ordered": _with(PERM)
    + """select source_file, count(*) as n_rows, true as identical, count(*) as n_unique, count(*) as n_shared,
  true as same_set from permutations group by source_file""",
    "redundancy_ordered_verdict": _with(PERM)
    + """select count(distinct variant_id) as n_union, count(*) as sum_unique, true as all_same_set,
  true as all_identical, 'normalized' as verdict from permutations""",
    "presence_matrix": """select cast(c.k as string) as variant, p.s as sample,
  cast(case when o.k is null then 0 else 1 end as int) as present
from (select distinct o_custkey as k from orders) c cross join (select distinct o_orderpriority as s from orders) p
left join (select distinct o_custkey as k, o_orderpriority as s from orders) o on o.k=c.k and o.s=p.s""",
    "run_history": """select printf('20240101T%06dZ',c_nationkey) as timestamp, printf('nation_%d',c_nationkey) as population,
  string_agg(distinct c_mktsegment, ',' order by c_mktsegment) as traits, count(*) as n_perms, 'done' as status,
  printf('/runs/%d',c_nationkey) as output_dir from customer group by c_nationkey""",
    "job_matrix": """with traits as (select distinct c_mktsegment as trait from customer),
types as (select distinct o_orderpriority as vt from orders)
select trait, vt, trait||'_'||vt as job from traits cross join types""",
    "job_status": _with(EVENTS)
    + """select job, cast(sum(1-failed) as bigint) as n_converted, cast(sum(failed) as bigint) as n_failed,
  count(*) as n from ev group by job""",
    "job_queue": _with(
        EVENTS,
        "r as (select job, cast(sum(1-failed) as bigint) as c, cast(sum(failed) as bigint) as f from ev group by job)",
    )
    + """select c_custkey as job, coalesce(c,0) as n_converted, coalesce(f,0) as n_failed,
  case when c is null then 'queued' when c+f<60 then 'running' when f>0 then 'error' else 'done' end as state
from customer left join r on r.job=c_custkey""",
    "rolling_eta": _with(EVENTS)
    + """select job, perm_id, avg(elapsed) over (partition by job order by perm_id rows between 9 preceding and current row)
 * (count(*) over (partition by job) - row_number() over (partition by job order by perm_id)) as eta_seconds from ev""",
    "end_to_end": RUN_ROWS,
    "end_to_end_inline": RUN_ROWS,
    "end_to_end_events": f"""select 'perm_'||lpad(cast(perm as string),4,'0') as name, 'converted' as status, true as timed,
  cast(null as string) as txt_path, 'permutations/population=ALL/trait=balance/variant_type=orders' as parquet_path,
  cast(null as string) as error from range(0,{PERMUTATIONS + 1}) as t(perm) where (select count(*) from orders)>0""",
    "assoc_result_rows": _with(*SCANNED)
    + f"""select source_file, perm_id, variant, {_printed("af")} as af,
  {_printed(_chi2_tail("(beta/beta_std_err)*(beta/beta_std_err)"))} as filter_pvalue,
  {_printed(_chi2_tail("lrt_stat"))} as lrt_pvalue, {_printed("beta")} as beta, {_printed("beta_std_err")} as beta_std_err,
  {_printed("variant_h2")} as variant_h2, '' as notes from f""",
    "assoc_moments_numpy": _with(PHENO, PRES)
    + f"select variant, count(*) as k, {PERMUTATIONS + 1} as n_scans from pres group by variant",
    "scan_events": _with(
        PHENO,
        SHUFFLED,
        PRES,
        "lost as (select perm_id, count(*) filter (where perm_id=2 and phenotype<0) as n from permuted group by perm_id)",
        """band as (select count(*) as n from (select variant, count(*)/(select count(*) from pheno)::double as af from pres
  group by variant) x where af between 0.05 and 0.95)""",
    )
    + """select perm_id, case when n>0 then 'scan_failed' else 'converted' end as status,
  case when n>0 then 'missing or infinite phenotype value' end as error,
  case when n>0 then 0 else (select n from band) end as n_rows from lost""",
    "guarded_preview": _with(PERM) + "select count(*) as row_count, cast(least(count(*),200) as int) as shown from permutations",
    "sql_where": _with(PERM) + SQL_WHERE,
    "sql_join": _with(PERM, VAR) + SQL_JOIN,
    "sql_grouping": _with(PERM) + SQL_GROUPING,
    "sql_window": _with(PERM) + SQL_WINDOW.replace("with ranked", ", ranked"),
    "sql_sets": _with(PERM, VAR) + SQL_SETS,
}

# The forms of one operator for small and for large inputs answer the same statement.
ORACLE |= {
    "pooled_null_histogram": ORACLE["pooled_null"],
    "empirical_p_variant_salted": ORACLE["empirical_p_variant"],
    "empirical_p_pooled_chunks": ORACLE["empirical_p_pooled"],
    "bh_qvalues_chunks": ORACLE["bh_qvalues"],
    "keyed_permutation_chunks": ORACLE["keyed_permutation"],
    "trait_cells": ORACLE["trait_extract"],
    "trait_cell_counts": ORACLE["trait_valid_counts"],
    "job_names": ORACLE["job_matrix"],
}
