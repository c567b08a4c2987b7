"""The domain's tables, derived by Spark from the benchmark's star schema.

Parts play the variants, customers the samples, orders the carriers, and every part has one result row per
permutation. Values are arithmetic on the keys, so that other engines can state the same tables.
"""

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUNS = 20
PERMUTATIONS = 3
MISSING_BRAND = "Brand#7"
# Parts whose result rows of one run share a task and a text file.
PARTS_PER_FILE = 262_144


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spread(df: DataFrame) -> DataFrame:
    """Deal rows out evenly before the fan-out that follows."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def permutations(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    """One result row per part and run."""
    perm = F.explode(F.sequence(F.lit(1).cast("long"), F.lit(RUNS).cast("long"))).alias("perm")
    rows = _spread(load(spark, sf_dir, "part").select("p_partkey", *extra)).select("p_partkey", *extra, perm)
    return _statistics(rows, *extra)


def _statistics(rows: DataFrame, *extra: str) -> DataFrame:
    """Result columns of (p_partkey, perm)."""
    columns = {
        "source_file": "format_string('perm_%04d', perm)",
        "perm_id": "cast(perm as int)",
        "variant_id": "cast(p_partkey as int)",
        "af": "((p_partkey * 37) % 1000 + 1) / 1001D",
        "filter_pvalue": "((p_partkey * 7907 + perm * 104723) % 99989 + 1) / 99991D",
        "lrt_pvalue": (
            "if((p_partkey + perm) % 101 = 0, null, "
            "((p_partkey * 7919 + perm * 104729 + p_partkey * perm * 31) % 99991 + 1) / 99991D)"
        ),
        "beta": "((p_partkey * 17 + perm * 13) % 2001 - 1000) / 1000D",
        "beta_std_err": "((p_partkey * 11 + perm * 7) % 500) / 1000D",
        "variant_h2": "((p_partkey * 3 + perm) % 50) / 1000D",
        "notes": (
            "case when (p_partkey + perm) % 20 = 0 then 'bad-chisq,high-bse' "
            "when (p_partkey + perm) % 33 = 0 then 'af-filter' else '' end"
        ),
    }
    return rows.select(*[F.expr(e).alias(c) for c, e in columns.items()], *extra)


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference table that lacks one brand's variants."""
    return (
        load(spark, sf_dir, "part")
        .where(F.col("p_brand") != MISSING_BRAND)
        .select(F.col("p_partkey").cast("int").alias("variant_id"), _variant().alias("variant"))
    )


def _variant():
    return F.concat("p_name", F.lit("#"), F.col("p_partkey").cast("string"))


def result_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result rows that carry their variant string, as result files do."""
    return _named(permutations(spark, sf_dir, "p_name"))


def _named(rows: DataFrame) -> DataFrame:
    return rows.withColumn("variant", F.concat("p_name", F.lit("#"), F.col("variant_id").cast("string"))).drop("p_name")


def placed_result_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of :func:`result_rows`, placed as result text is written: run after run, ranges of variant ids in order.

    The parts are ranged once, before the runs multiply them, and every run reads the same ranges.
    """
    parts = load(spark, sf_dir, "part").select("p_partkey", "p_name")
    ranged = parts.repartitionByRange(1 + parts.count() // PARTS_PER_FILE, "p_partkey")
    runs = [ranged.withColumn("perm", F.lit(run).cast("long")) for run in range(1, RUNS + 1)]
    return _named(_statistics(reduce(DataFrame.unionAll, runs), "p_name"))


def phenotype(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("sample"), F.col("c_acctbal").alias("phenotype")
    )


def presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer carries the priorities and states of its orders."""
    return load(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("sample"),
        F.concat_ws("_", "o_orderpriority", "o_orderstatus").alias("variant"),
    )


def master(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide phenotype text with missing and malformed values."""
    t1 = (
        "case when c_custkey % 7 = 0 then 'NA' when c_custkey % 11 = 0 then '' "
        "when c_custkey % 13 = 0 then 'abc' else cast(c_custkey * 2 as string) end"
    )
    t2 = "case when c_custkey % 5 = 0 then '1d' when c_custkey % 3 = 0 then ' 2.5 ' else 'NaN' end"
    return load(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("id"), F.expr(t1).alias("t1"), F.expr(t2).alias("t2")
    )


def run_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of jobs: (job, perm_id, elapsed, status)."""
    status = F.when(F.col("event_type") == "error", "convert_failed").otherwise("converted")
    return load(spark, sf_dir, "events").select(
        F.col("user_id").alias("job"),
        F.col("event_id").alias("perm_id"),
        F.col("value").alias("elapsed"),
        status.alias("status"),
    )


def variant_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variant lists of seven result files, one per line number."""
    return load(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("f"), F.col("l_linenumber").cast("string")).alias("source_file"),
        F.col("l_partkey").cast("string").alias("variant"),
    )


def ordered_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants of five files by position: the parts in order, one value changed, reversed, cut off, and one too many."""
    parts = load(spark, sf_dir, "part")
    size = parts.agg(F.max("p_partkey") + 1).scalar()
    base = _spread(parts.select("p_partkey", _variant().alias("variant"))).withColumn("n", size)
    changed = F.when(F.col("p_partkey") % 1000 == 7, F.concat("variant", F.lit("?"))).otherwise(F.col("variant"))
    place = F.col("p_partkey")

    def file(name, at, variant):
        return F.struct(F.lit(name).alias("source_file"), at.alias("row_idx"), variant.alias("variant"))

    same = F.col("variant")
    none = F.lit(None).cast("string")
    extra = place == F.col("n") - 1
    rows = F.array(
        file("f1", place, same),
        file("f2", place, changed),
        file("f3", F.col("n") - 1 - place, same),
        file("f4", F.when(place < F.col("n") - 10, place), same),
        file("f5", place, same),
        file("f5", F.when(extra, F.col("n")), F.when(extra, F.lit("extra")).otherwise(none)),
    )
    return base.select(F.explode(rows).alias("r")).select("r.*").where("row_idx is not null")


def layout_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of files (case, source_file, row_idx, variant) that call for each of the layouts."""
    parts = _spread(load(spark, sf_dir, "part").select("p_partkey", _variant().alias("variant")))
    place, key = F.col("p_partkey"), F.col("p_partkey") % 10

    def row(case, name, at, held):
        values = F.struct(F.lit(case).alias("case"), F.lit(name).alias("source_file"), at.alias("row_idx"), F.col("variant"))
        return F.when(held, values)

    every = F.lit(True)
    rows = F.array(
        row("identical", "a", place, every), row("identical", "b", place, every),
        row("same set", "a", place, every), row("same set", "b", -place, every),
        row("overlap", "a", place, key < 7), row("overlap", "b", place, key > 2),
        row("disjoint", "a", place, key < 5), row("disjoint", "b", place, key >= 5),
    )
    return parts.select(F.explode(rows).alias("r")).where("r is not null").select("r.*")
