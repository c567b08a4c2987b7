"""Which storage layout a run's files call for, judged from its first files."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordering import row_index
from ..operators.redundancy import redundancy_by_file, verdict
from ..schema import RESULT_COLUMNS
from ..sources.files import first_files
from ..staging import stage
from .convert import stage_lines


def _lines(spark: SparkSession, run_dir: str, sample: int, column: str) -> DataFrame:
    if column not in RESULT_COLUMNS:
        raise ValueError(f"Result files have no column {column!r}, only {RESULT_COLUMNS}")
    paths = first_files(spark, run_dir, sample)
    if not paths:
        raise ValueError(f"{run_dir} holds no result files")
    lines = row_index(stage_lines(spark, paths))
    return stage(lines.select("source_file", "row_idx", F.col(column).cast("string").alias("variant")), "sampled")


def check_run(spark: SparkSession, run_dir: str, sample: int = 5, column: str = "variant") -> DataFrame:
    """One row: the verdict over the first ``sample`` result files in text order, for any of their columns."""
    lines = _lines(spark, run_dir, sample, column)
    found = lines.agg(F.countDistinct("source_file").alias("n_files"), F.count(F.lit(1)).alias("n_rows"))
    counts = found.select(F.struct("n_files", "n_rows")).scalar()
    return verdict(lines).withColumn("found", counts).select("found.*", "*").drop("found")


def check_files(spark: SparkSession, run_dir: str, sample: int = 5, column: str = "variant") -> DataFrame:
    """One row per sampled file with both comparisons."""
    return redundancy_by_file(_lines(spark, run_dir, sample, column))
