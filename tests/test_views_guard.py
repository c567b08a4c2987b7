import json

import pytest
from conftest import rows

from permscan.operators import normalize, ranking, summaries
from permscan.plans import guard, jobs, pipeline, views
from permscan.sources import phenotypes


@pytest.fixture(scope="module")
def dataset(spark):
    session = views.query_session(spark)
    facts = session.createDataFrame(
        [(f"perm_{p:04d}", p, v, 0.1 * v if v else None, "bad-chisq" if v == 2 else "") for p in range(1, 101) for v in range(4)],
        "source_file string, perm_id int, variant_id int, lrt_pvalue double, notes string",
    )
    variants = session.createDataFrame([(0, "A"), (1, "C"), (2, "G")], "variant_id int, variant string")
    return views.register(facts, variants)


@pytest.mark.parametrize(
    "sql, n",
    [
        ("select * from permutations", 400),
        ("  SELECT variant from results", 300),
        ("with a as (select 1 as x) select * from a", 1),
        ("select 1 as a;", 1),
        ("select ';' as a", 1),
        ("-- first\n/* then */ select 1 as a", 1),
        ("(select 1 as a)", 1),
        ("select 1 as a -- last", 1),
        ("select variant_id from variants union select variant_id from permutations", 4),
        ("select variant, count(*) as n from results group by all having n > 1", 3),
        ("select count(*) as reflected from permutations", 1),
        ("select notes from permutations where notes like '%reflect%'", 0),
        ("select notes from permutations where notes like '%reflect(%' or notes = \"identifier('x')\"", 0),
        ("select 1 as a /* reflect('x') /* nested */ reflect(2) */ -- reflect(3)", 1),
        ("with variants as (select 7 as x) select * from variants", 1),
    ],
)
def test_accepted(dataset, sql, n):
    assert guard.read_only(dataset.session, sql).count() == n


@pytest.mark.parametrize(
    "sql",
    [
        "",
        "drop view permutations",
        "insert into variants values (9, 'T')",
        "with a as (select 1 as x) insert into variants select x, 'T' from a",
        "from variants insert into variants select *",
        "select 1 as a; select 2 as b",
        "select 1) as q; drop view permutations; --",
        "set spark.sql.ansi.enabled=false",
        "show tables",
        "select * from parquet.`/root/testdata/sf0.001/part.parquet`",
        "select reflect('java.lang.System', 'getenv', 'PATH') as x",
        "select `reflect`/* /* x */ */ ('java.lang.System', 'getenv', 'PATH') as x",
        "select try_reflect -- x\r('java.lang.System', 'getenv', 'PATH') as x",
        "select identifier('ref' || 'lect')('java.lang.System', 'getenv', 'PATH') as x",
        "select reflect /* /* a */ b */ ('java.lang.System', 'getenv', 'PATH') as x",
        "select r'\\', reflect('java.lang.System', 'getenv', 'PATH') as x, '",
        "select r'\\' as y, reflect('java.lang.System', 'getenv', 'PATH') as x",
        "select /*+ f(') */ 1 as a, ') */ reflect('java.lang.System', 'getenv', 'PATH') as x",
        "select * from permutations asof join variants on true",
        "select nothing from permutations",
        "create table t as select 1",
    ],
)
def test_refused(dataset, sql):
    with pytest.raises(guard.RefusedQuery):
        guard.read_only(dataset.session, sql)
    assert dataset.session.sql("select count(*) from permutations").first()[0] == 400


def test_tables_of_a_shared_catalog_are_refused(spark, dataset, tmp_path):
    spark.sql(f"create table shared_numbers using parquet location '{tmp_path}/t' as select 1 as x")
    try:
        for sql in (
            "select * from shared_numbers",
            "select count(*) as n from permutations where variant_id in (select x from default.shared_numbers)",
            "with a as (select * from spark_catalog.default.shared_numbers) select * from a",
        ):
            with pytest.raises(guard.RefusedQuery, match="shared_numbers"):
                guard.read_only(dataset.session, sql)
    finally:
        spark.sql("drop table shared_numbers")


def test_views_do_not_leak(spark, dataset):
    assert not spark.catalog.tableExists("permutations")


def test_preview_and_tool(dataset):
    answer = json.loads(guard.run_tool(dataset, "query_results", {"sql": "select variant_id, lrt_pvalue from permutations"}))
    assert answer["row_count"] == 400 and len(answer["rows"]) == 200
    assert answer["note"] == "truncated to first 200 of 400 rows"
    assert {"variant_id": 0, "lrt_pvalue": None} in answer["rows"]
    short = json.loads(guard.run_tool(dataset, "query_results", {"sql": "select timestamp '2024-01-01' as t"}))
    assert short["row_count"] == 1 and "note" not in short and short["rows"][0]["t"].startswith("2024-01-01")
    assert "SELECT or WITH" in json.loads(guard.run_tool(dataset, "query_results", {"sql": "drop table x"}))["error"]
    assert json.loads(guard.run_tool(dataset, "other", {})) == {"error": "unknown tool 'other'"}


def test_orphans_are_not_results(dataset):
    assert dataset.results.where("variant_id = 3").count() == 0
    assert normalize.orphans(dataset.permutations, dataset.variants).count() == 100


def test_top_hits(dataset):
    best = ranking.top_hits(dataset.permutations, dataset.variants, limit=2)
    assert [(r.source_file, r.variant) for r in best.collect()] == [("perm_0001", "C"), ("perm_0002", "C")]
    worst = ranking.top_hits(dataset.permutations, dataset.variants, limit=101, ascending=False).collect()
    assert [r.variant for r in worst] == ["G"] * 100 + ["C"]
    every = ranking.top_hits(dataset.permutations, dataset.variants, limit=400).collect()
    assert [r.lrt_pvalue for r in every[-100:]] == [None] * 100 and len(every) == 300
    complete = ranking.top_hits(dataset.results.drop("variant"), dataset.variants, limit=2, reference_complete=True)
    assert rows(complete, "variant") == [("C",), ("C",)]
    with pytest.raises(ValueError, match="No column"):
        ranking.top_hits(dataset.permutations, column="lrt_pvalue; drop")


def plan(df, capsys):
    df.explain()
    return capsys.readouterr().out


def test_plans(dataset, capsys):
    top = plan(ranking.top_hits(dataset.permutations, limit=5), capsys)
    assert "TakeOrderedAndProject" in top
    assert "Join" not in plan(summaries.per_run_summary(dataset.permutations), capsys)


def test_facts_scan_pushes_down(spark, tmp_path, capsys):
    spark.range(10).selectExpr("'perm_0001' source_file", "1 perm_id", "cast(id as int) variant_id", "rand() beta", "0.1D af").write.parquet(str(tmp_path / "f"))
    data = views.open_dataset(spark, str(tmp_path / "f"))
    text = plan(guard.read_only(data.session, "select beta from permutations where variant_id = 3 and af > 0.05"), capsys)
    assert "EqualTo(variant_id,3)" in text and "GreaterThan(af,0.05)" in text
    assert "ReadSchema: struct<variant_id:int,beta:double,af:double" in text


def test_job_matrix(spark):
    traits = spark.createDataFrame([("LD50",), ("MIC",), ("MIC",)], "trait string")
    types = spark.createDataFrame([("unitigs",), ("snps",)], "vt string")
    assert rows(jobs.job_matrix(traits, types), "job") == [("LD50_snps",), ("LD50_unitigs",), ("MIC_snps",), ("MIC_unitigs",)]


def test_end_to_end(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("ID\tT\tU\n" + "".join(f"s{i}\t{i * i % 7}\t{i}\n" for i in range(12)) + "s99\tNA\t\n")
    (tmp_path / "p.Rtab").write_text(
        "Gene\t" + "\t".join(f"s{i}" for i in range(12)) + "\n"
        + "".join(f"g{k}\t" + "\t".join(str(int((i + k) % 3 == 0)) for i in range(12)) + "\n" for k in range(4))
    )
    config = pipeline.RunConfig(str(tmp_path / "base"), "ALL", ["T", "U"], n_perms=3, timestamp="20240101T000000Z")
    master = phenotypes.read_master(spark, str(tmp_path / "m.tsv"))
    presence = phenotypes.read_presence(spark, str(tmp_path / "p.Rtab"))
    pipeline.run(config, master, {"genes": presence})
    data = pipeline.open_run(spark, config, "U", "genes")
    assert data.results.count() == 4 * 4
    assert rows(data.results.select("source_file").distinct()) == [(f"perm_000{i}",) for i in range(4)]
    everything = spark.read.parquet(str(tmp_path / "base" / "permutations"))
    assert rows(everything.select("population", "trait", "variant_type").distinct()) == [("ALL", "T", "genes"), ("ALL", "U", "genes")]
    events = spark.read.parquet(config.path("run_events", "T", "genes"))
    assert rows(events, "name", "status", "error") == [(f"perm_000{i}", "converted", None) for i in range(4)]
    past = phenotypes.read_history(spark, str(tmp_path / "base")).collect()
    assert [(r.timestamp, r.traits, r.variant_types, r.n_perms, r.status) for r in past] == [
        ("20240101T000000Z", ["T", "U"], ["genes"], 3, "done")
    ]


def test_a_failing_job_does_not_stop_the_others(spark, tmp_path):
    master = spark.createDataFrame([(f"s{i}", str(i * i % 7)) for i in range(12)], "ID string, T string")
    presence = spark.createDataFrame([(f"s{i}", f"g{i % 3}") for i in range(12)], "sample string, variant string")
    config = pipeline.RunConfig(str(tmp_path / "b"), "ALL", ["missing", "T"], n_perms=2, layout=pipeline.INLINE)
    past = spark.read.json(pipeline.run(config, master, {"genes": presence})).first()
    assert past.status == "error"
    lost = spark.read.parquet(config.path("run_events", "missing", "genes"))
    assert lost.count() == 3 and lost.where("status = 'scan_failed' and error like '%missing%'").count() == 3
    assert pipeline.open_run(spark, config, "T", "genes").results.groupBy("variant").count().collect()
    with pytest.raises(ValueError, match="layout"):
        pipeline.RunConfig("b", "ALL", [], layout="other")
