"""Readers for phenotype tables, presence matrices and run summaries."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import trait_number
from ..schema import PHENOTYPE, RUN_SUMMARY


def read_master(spark: SparkSession, path: str) -> DataFrame:
    """Wide phenotype table: an id column and one column per trait, all as text.

    Spark's CSV reader takes at most 20,480 columns; :func:`read_master_cells` has no limit.
    """
    return spark.read.option("sep", "\t").option("header", True).option("escape", '"').csv(path)


def read_phenotype(spark: SparkSession, path: str, header: bool = False) -> DataFrame:
    """Two-column (sample, phenotype) file or folder, without or with a header line."""
    return spark.read.schema(PHENOTYPE).option("sep", "\t").option("header", header).csv(path)


def _cells(spark: SparkSession, path: str, id_column: str | None) -> DataFrame:
    """``(id, name, cell)`` of a tab-separated table with a header, one row per cell but the id's.

    Lines are read as text and paired with the header's names inside the row, so neither the number of columns nor
    the size of the plan is limited. All files repeat one header. Blank lines are skipped, missing cells are NULL,
    cells beyond the header are left out. Quotes around a field go; a tab always ends a field.
    """
    lines = spark.read.text(path).where(F.trim("value") != "")
    header = lines.first()
    if header is None:
        raise ValueError(f"No header line in {path}")
    names = [name.removeprefix('"').removesuffix('"') for name in header.value.split("\t")]
    id_column = id_column or names[0]
    if id_column not in names:
        raise ValueError(f"The header of {path} lacks the id column {id_column!r}")
    at = names.index(id_column)
    fields = F.transform(F.split("value", "\t", -1), lambda field: F.regexp_replace(field, '^"(.*)"$', "$1"))
    # The header enters the plan as one literal, split there.
    columns = F.split(F.lit("\t".join(names)), "\t", -1)
    return (
        lines.where(F.col("value") != header.value)
        .select(fields.alias("cell"))
        .select(
            F.nullif(F.get("cell", F.lit(at)), F.lit("")).alias("id"),
            F.posexplode(F.arrays_zip(columns.alias("name"), F.col("cell"))).alias("at", "c"),
        )
        .where((F.col("at") != at) & F.col("c.name").isNotNull())
        .select("id", "c.name", "c.cell")
    )


def read_master_cells(spark: SparkSession, path: str, id_column: str = "ID") -> DataFrame:
    """Wide phenotype table of any number of traits as ``(sample, trait, value)``, values as text; see :func:`_cells`."""
    cells = _cells(spark, path, id_column)
    return cells.select(F.col("id").alias("sample"), F.col("name").alias("trait"), F.col("cell").alias("value"))


def read_presence(spark: SparkSession, path: str, id_column: str | None = None) -> DataFrame:
    """Presence/absence matrix (one row per variant, one column per sample) as ``(variant, sample, present)``.

    Read as :func:`_cells` says; missing and empty cells count as absent.
    """
    present = F.when(trait_number(F.col("cell")) != 0, 1).otherwise(0)
    cells = _cells(spark, path, id_column)
    return cells.select(F.col("id").alias("variant"), F.col("name").alias("sample"), present.alias("present"))


def read_history(spark: SparkSession, base_dir: str) -> DataFrame:
    """Past runs from their summaries, newest first."""
    return (
        spark.read.schema(RUN_SUMMARY).json(f"{base_dir.rstrip('/')}/run_summary_*.json").orderBy(F.desc("timestamp"))
    )
