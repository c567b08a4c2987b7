"""Writers for result tables, phenotypes, run events and run summaries."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import perm_name, three_digits
from ..schema import NUMERIC_COLUMNS, RAW_HEADER, RUN_SUMMARY, column_name

# Permutations that share a folder.
PERMS_PER_BUCKET = 100
# Rows that a task sorts when facts are written.
ROWS_PER_TASK = 524_288


def dataset_path(base_dir: str, kind: str, population: str, trait: str, variant_type: str) -> str:
    """Folder of one job; reading ``base_dir/kind`` yields all jobs with their names as columns."""
    return f"{base_dir.rstrip('/')}/{kind}/population={population}/trait={trait}/variant_type={variant_type}"


def write_facts(facts: DataFrame, path: str, n_rows: int, mode: str = "errorifexists") -> None:
    """Result rows as zstd Parquet in buckets of permutations.

    With variant ids, rows are ranged and ordered by bucket and id, so that per-variant queries skip files and row
    groups. ``n_rows``, at least about their number, keeps each task's sort small; the last key splits an id that holds
    many rows. Rows that carry their variant string stay in the tasks that read them: no shuffle.
    """
    bucket = F.coalesce(F.floor(F.col("perm_id") / PERMS_PER_BUCKET), F.lit(-1)).cast("int")
    placed = facts.withColumn("perm_bucket", bucket)
    if "variant_id" in facts.columns:
        order = ["perm_bucket", "variant_id", "source_file"]
        placed = placed.repartitionByRange(
            1 + n_rows // ROWS_PER_TASK, *order, F.xxhash64(*facts.columns)
        ).sortWithinPartitions(*order)
    else:
        placed = placed.sortWithinPartitions("perm_bucket")
    placed.write.mode(mode).option("compression", "zstd").partitionBy("perm_bucket").parquet(path)


def write_variants(variants: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Reference table, files ordered by id."""
    (
        variants.repartitionByRange("variant_id")
        .sortWithinPartitions("variant_id")
        .write.mode(mode)
        .option("compression", "zstd")
        .parquet(path)
    )


def write_result_text(results: DataFrame, path: str, order: str = "variant_id", placed: bool = False) -> None:
    """Result rows as tab-separated text with the raw header, one ``source_file=…`` folder per run.

    Rows keep the order of ``order``; a large run spans several files whose names sort in that order. ``placed``
    rows already lie so that each run's partitions follow one another in that order: they are sorted where they are.
    """
    columns = []
    for raw in RAW_HEADER:
        name = column_name(raw)
        value = three_digits(F.col(name).cast("double")) if name in NUMERIC_COLUMNS else F.col(name)
        columns.append(value.alias(raw))
    ranged = results if placed else results.repartitionByRange("source_file", order)
    (
        ranged.sortWithinPartitions("source_file", order)
        .select("source_file", *columns)
        .write.option("sep", "\t")
        .option("header", True)
        .option("escape", '"')
        .option("emptyValue", "")
        .option("extension", "txt")
        .partitionBy("source_file")
        .csv(path)
    )


def write_phenotype(pheno: DataFrame, path: str, header: bool = False) -> None:
    """One phenotype as two-column text."""
    pheno.select("sample", "phenotype").write.option("sep", "\t").option("header", header).csv(path)


def write_permuted_phenotypes(
    permuted: DataFrame, path: str, header: bool = False, width: int = 4, prefix: str = "perm"
) -> None:
    """Permuted phenotypes as text, one ``source_file=perm_0001`` folder per permutation."""
    (
        permuted.withColumn("source_file", perm_name(F.col("perm_id"), prefix, width))
        .repartitionByRange("source_file", "sample")
        .sortWithinPartitions("source_file", "sample")
        .select("source_file", "sample", "phenotype")
        .write.option("sep", "\t")
        .option("header", header)
        .option("extension", "tsv")
        .partitionBy("source_file")
        .csv(path)
    )


def write_events(events: DataFrame, path: str, mode: str = "append") -> None:
    events.write.mode(mode).parquet(path)


def write_summary(
    spark: SparkSession,
    base_dir: str,
    timestamp: str,
    population: str,
    traits: list[str],
    variant_types: list[str],
    n_perms: int,
    status: str,
    output_dir: str,
) -> str:
    """One-row JSON summary of a run."""
    path = f"{base_dir.rstrip('/')}/run_summary_{timestamp}.json"
    row = (timestamp, population, traits, variant_types, n_perms, status, output_dir)
    spark.createDataFrame([row], RUN_SUMMARY).coalesce(1).write.json(path)
    return path
