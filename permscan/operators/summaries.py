"""Summaries of permuted statistics, quality flags and run events."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import flags, source_name
from ..schema import CONVERTED
from .order_stats import quantiles
from .ordering import CHUNK, with_chunks


POOLED_CUTS = {"p01": 0.01, "median": 0.5, "p99": 0.99}


def pooled_null_distribution(permutations: DataFrame, column: str = "lrt_pvalue") -> DataFrame:
    """One row describing ``column`` over all permutations together."""
    value = F.col(column).cast("double")
    described = permutations.agg(
        F.count(F.lit(1)).alias("n"),
        F.count(value).alias("n_non_null"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        F.avg(value).alias("mean"),
        F.stddev(value).alias("stddev"),
    )
    cuts = quantiles(permutations, column, POOLED_CUTS)
    return described.withColumn("cut", cuts.select(F.struct("*")).scalar()).select(
        "n", "n_non_null", "min", "cut.p01", "cut.median", "cut.p99", "max", "mean", "stddev"
    )


def per_run_summary(permutations: DataFrame, column: str = "lrt_pvalue") -> DataFrame:
    """Count, minimum, mean and maximum of ``column`` per run, in text order of the run names."""
    value = F.col(column).cast("double")
    return (
        permutations.groupBy("source_file")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min(value).alias("min"),
            F.avg(value).alias("mean"),
            F.max(value).alias("max"),
        )
        .orderBy("source_file")
    )


def permutation_threshold(permutations: DataFrame, alpha: float = 0.05, column: str = "lrt_pvalue") -> DataFrame:
    """Lower ``alpha`` quantile of the smallest ``column`` of each run."""
    smallest = permutations.groupBy("source_file").agg(F.min(F.col(column).cast("double")).alias("smallest"))
    return quantiles(smallest, "smallest", {"threshold": alpha})


def qc_flag_counts(permutations: DataFrame, per_run: bool = True) -> DataFrame:
    """Rows per quality flag. Equal notes are counted before they are split."""
    keys = ["source_file"] if per_run else []
    counted = permutations.where(F.col("notes") != "").groupBy(*keys, "notes").agg(F.count(F.lit(1)).alias("c"))
    split = counted.select(*keys, F.explode(flags(F.col("notes"))).alias("flag"), "c")
    return split.groupBy(*keys, "flag").agg(F.sum("c").alias("n"))


def rows_per_source(lines: DataFrame) -> DataFrame:
    """Row count of every scanned result file."""
    return (
        lines.groupBy("file_path")
        .agg(F.count(F.lit(1)).alias("c"))
        .groupBy(source_name(F.col("file_path")).alias("source_file"))
        .agg(F.sum("c").alias("n"))
    )


def job_status(events: DataFrame, total: int | None = None) -> DataFrame:
    """Converted and failed runs per job, and the job's state when the planned total is given."""
    converted = F.col("status") == CONVERTED
    rolled = events.groupBy("job").agg(
        F.count_if(converted).alias("n_converted"),
        F.count_if(~converted).alias("n_failed"),
        F.count(F.lit(1)).alias("n"),
    )
    if total is None:
        return rolled
    state = (
        F.when(F.col("n") < total, "running").when(F.col("n_failed") > 0, "error").otherwise("done")
    )
    return rolled.withColumn("state", state)


def job_queue(jobs: DataFrame, events: DataFrame, total: int) -> DataFrame:
    """State of every planned job; one without events is still queued."""
    return jobs.join(job_status(events, total), "job", "left").select(
        *jobs.columns,
        F.coalesce("n_converted", F.lit(0)).alias("n_converted"),
        F.coalesce("n_failed", F.lit(0)).alias("n_failed"),
        F.coalesce("state", F.lit("queued")).alias("state"),
    )


def rolling_eta(events: DataFrame, last: int = 10, partitions: int | None = None) -> DataFrame:
    """Expected remaining seconds after each event: mean of the last ``last`` run times × runs left.

    Events are cut into chunks by their place in the order of job and permutation, so the longest job is spread
    over many tasks however its numbers lie. Each chunk borrows the ``last - 1`` events before it and learns its
    offset from the chunk counts.
    """
    placed = with_chunks(events.select("job", "perm_id", "elapsed"), "job", "perm_id", partitions=partitions)
    cut = placed.withColumnRenamed(CHUNK, "part")
    by_part = Window.partitionBy("job", "part")
    by_job = Window.partitionBy("job")

    sizes = cut.groupBy("job", "part").agg(F.count(F.lit(1)).alias("rows"))
    offsets = sizes.select(
        "job",
        "part",
        F.coalesce(
            F.sum("rows").over(by_job.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("offset"),
        F.sum("rows").over(by_job).alias("total"),
    )
    tails = (
        cut.withColumn("from_end", F.row_number().over(by_part.orderBy(F.desc("perm_id"))))
        .where(F.col("from_end") < last)
        .drop("from_end")
    )
    previous = F.collect_list(F.struct("perm_id", "elapsed")).over(
        by_job.orderBy("perm_id").rowsBetween(-(last - 1), -1)
    )
    borrowed = (
        tails.withColumn("before", previous)
        .withColumn("earlier_part", F.lag("part").over(by_job.orderBy("perm_id")))
        .where(F.col("part") != F.col("earlier_part"))
        .select("job", "part", F.explode("before").alias("e"))
        .select("job", "e.perm_id", "e.elapsed", "part", F.lit(True).alias("borrowed"))
    )
    rows = cut.withColumn("borrowed", F.lit(False)).unionByName(borrowed)
    in_order = by_part.orderBy("perm_id")
    measured = rows.select(
        "*",
        F.avg("elapsed").over(in_order.rowsBetween(-(last - 1), 0)).alias("mean"),
        F.row_number().over(in_order).alias("at"),
    ).where(~F.col("borrowed"))
    done = F.col("offset") + F.col("at") - F.least(F.col("offset"), F.lit(last - 1))
    return measured.join(offsets, ["job", "part"]).select(
        "job", "perm_id", (F.col("mean") * (F.col("total") - done)).alias("eta_seconds")
    )
