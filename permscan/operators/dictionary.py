"""A variant dictionary that grows: ids once given stay, every version is kept."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.writers import write_variants
from ..staging import exists
from .ordering import dense_index

VERSION = "version"


def read_dictionary(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """``(variant_id, variant, version)`` as of a version, the latest one by default."""
    entries = spark.read.schema(f"variant_id int, variant string, {VERSION} int").parquet(path)
    return entries if version is None else entries.where(F.col(VERSION) <= version)


def grow(spark: SparkSession, path: str, rows: DataFrame) -> int:
    """Give ids to the variants of ``rows`` that the dictionary lacks; returns the version that holds them all.

    New variants follow the highest id in text order and are written as a version of their own, so readers of
    earlier versions see what they saw. Running it again with the same rows changes nothing. One writer at a time.
    """
    fresh = rows.select("variant").where("variant is not null").distinct()
    version, first = 0, 0
    if exists(spark, path):
        known = read_dictionary(spark, path)
        version, last = known.agg(F.max(VERSION), F.max("variant_id")).first()
        version, first = version or 0, 0 if last is None else last + 1
        fresh = fresh.join(known.select("variant"), "variant", "left_anti")
    numbered = dense_index(fresh, "variant", out="pos")
    entries = numbered.select((F.col("pos") + first).cast("int").alias("variant_id"), "variant")
    if version and entries.isEmpty():
        return version
    # A version that was cut off while it was written has no committed files and is replaced.
    write_variants(entries, f"{path}/{VERSION}={version + 1}", "overwrite")
    return version + 1
