"""The three query views over a converted dataset: permutations, variants, results."""

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..sources.results import read_facts, read_variants

VIEWS = ("permutations", "variants", "results")


@dataclass
class Dataset:
    """A dataset's views, registered in a session of their own so that no other name is in reach."""

    session: SparkSession
    permutations: DataFrame
    variants: DataFrame | None
    results: DataFrame


def results_view(permutations: DataFrame, variants: DataFrame | None) -> DataFrame:
    """Rows with their variant string; a row whose id the reference lacks is dropped.

    The join strategy is left to the optimizer, which broadcasts the reference only below its size limit.
    """
    if variants is None:
        return permutations
    return permutations.join(variants.select("variant_id", "variant"), "variant_id")


def register(permutations: DataFrame, variants: DataFrame | None = None) -> Dataset:
    """Make the views in the session the frames belong to."""
    results = results_view(permutations, variants)
    permutations.createOrReplaceTempView("permutations")
    results.createOrReplaceTempView("results")
    if variants is not None:
        variants.createOrReplaceTempView("variants")
    return Dataset(permutations.sparkSession, permutations, variants, results)


def query_session(spark: SparkSession) -> SparkSession:
    """New session on the same cluster, without temporary views and without SQL on file paths."""
    session = spark.newSession()
    for key in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        session.conf.set(key, spark.conf.get(key))
    session.conf.set("spark.sql.runSQLOnFiles", "false")
    return session


def open_dataset(spark: SparkSession, facts_path: str, reference_path: str | None = None) -> Dataset:
    """Views over Parquet results: a folder, file or glob, plus the reference of a normalised layout."""
    session = query_session(spark)
    facts = read_facts(session, facts_path)
    return register(facts, read_variants(session, reference_path) if reference_path else None)
