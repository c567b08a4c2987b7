"""Jobs of a run: one per trait and variant type."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import job_name, variant_stem


def job_matrix(traits: DataFrame, variant_types: DataFrame) -> DataFrame:
    """(trait, vt, job) for every pair of distinct names.

    The variant types become one array value inside Spark, which is unfolded per trait.
    """
    types = variant_types.agg(F.collect_set("vt")).scalar()
    pairs = traits.select("trait").distinct().select("trait", F.explode(types).alias("vt"))
    return pairs.withColumn("job", job_name(F.col("trait"), F.col("vt")))


def variant_types(paths: DataFrame) -> DataFrame:
    """(vt,) of variant files: their names up to the first dot."""
    return paths.select(variant_stem("path").alias("vt"))
