"""Empirical p-values against the permuted statistics, and false-discovery-rate correction."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..staging import stage
from .ordering import CHUNK, chunk_offsets, running_total, with_chunks


def empirical_p_per_variant(
    observed: DataFrame,
    null: DataFrame,
    key: str = "variant_id",
    column: str = "lrt_pvalue",
    salts: int = 16,
) -> DataFrame:
    """Fraction of permuted runs whose statistic is at least as extreme as the observed one, per variant.

    The key is salted by run, so that a variant with very many permuted rows is shared by ``salts`` tasks. Both sides
    are shuffled: the optimizer does not count the rows that salting adds, so by its estimate it would send them
    all through the driver.
    """
    seen = observed.select(key, F.col(column).cast("double").alias("seen")).where("seen is not null")
    drawn = null.select(key, F.col(column).cast("double").alias("drawn"), "source_file").where("drawn is not null")
    copies = seen.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = drawn.withColumn("salt", F.pmod(F.hash("source_file"), F.lit(salts)))
    pairs = salted.join(copies.hint("merge"), [key, "salt"])
    hit = F.when(F.col("drawn") <= F.col("seen"), 1.0).otherwise(0.0)
    return pairs.groupBy(key).agg(F.count(F.lit(1)).alias("n_null"), F.avg(hit).alias("empirical_p"))


def empirical_p_pooled(
    observed: DataFrame,
    null: DataFrame,
    key: str = "variant_id",
    column: str = "lrt_pvalue",
) -> DataFrame:
    """Fraction of all permuted statistics at least as extreme as each observed one."""
    seen = observed.select(key, F.col(column).cast("double").alias("value")).where("value is not null")
    drawn = null.select(F.col(column).cast("double").alias("value")).where("value is not null")
    # Observed values enter with weight 0: each finds its own running count by an equality join.
    weighted = drawn.withColumn("w", F.lit(1)).unionByName(seen.select("value", F.lit(0).alias("w")))
    counted = weighted.groupBy("value").agg(F.sum("w").alias("cnt"))
    ranked = _ranked(counted)
    table = ranked.select("value", F.try_divide(F.col("upto").cast("double"), F.col("n")).alias("empirical_p"))
    return seen.join(table.hint("merge"), "value").select(key, "empirical_p")


def _ranked(counted: DataFrame) -> DataFrame:
    chunked = with_chunks(counted, "value")
    offsets = chunk_offsets(chunked, "cnt", totals={"n": F.col("cnt")})
    return running_total(chunked, offsets, "cnt", ("value",), "upto")


def bh_qvalues(permutations: DataFrame, column: str = "lrt_pvalue", key: str = "variant_id") -> DataFrame:
    """Benjamini–Hochberg q-value of every row within its run.

    A q-value depends only on the run, the p-value and counts, so it is worked out on the distinct p-values
    of each run and joined back. Both sides are shuffled: rows made by an explode are many more than the optimizer
    estimates, and by its estimate it would send them all through the driver.
    """
    rows = permutations.select("source_file", key, F.col(column).cast("double").alias("p")).where("p is not null")
    distinct = rows.groupBy("source_file", "p").agg(F.count(F.lit(1)).alias("cnt"))
    steps = _step_up(distinct).hint("merge")
    return rows.join(steps, ["source_file", "p"]).select("source_file", key, "q_value")


def _step_up(distinct: DataFrame) -> DataFrame:
    """(source_file, p, q_value), each run spread over chunks of p-values."""
    chunked = with_chunks(distinct, "source_file", "p")
    by = ["source_file", CHUNK]
    located = chunked.join(chunk_offsets(chunked, "cnt", ("source_file",), totals={"m": F.col("cnt")}), by)
    # Counting down from the chunk's end gives the rank in the order that the step-up minimum needs anyway.
    down = Window.partitionBy(*by).orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rank = F.col("_offset") + F.col("_sum") + F.col("cnt") - F.sum("cnt").over(down)
    raw = located.select(*by, "p", (F.col("p") * F.col("m") / rank).alias("raw"))
    steps = stage(raw.select(*by, "p", F.min("raw").over(down).alias("inside")), "steps")
    lowest = steps.groupBy(*by).agg(F.min("inside").alias("low"))
    later = Window.partitionBy("source_file").orderBy(CHUNK).rowsBetween(1, Window.unboundedFollowing)
    after = lowest.select(*by, F.min("low").over(later).alias("after"))
    return steps.join(after, by).select(
        "source_file", "p", F.least(F.lit(1.0), "inside", "after").alias("q_value")
    )
