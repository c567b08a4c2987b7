"""Readers for association results: tab-separated text by column name, and Parquet."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import is_malformed, number, perm_id, source_name
from ..schema import NUMERIC_COLUMNS, RESULT_COLUMNS, column_name


def _text(spark: SparkSession):
    # Quotes are doubled inside quoted values; files stay splittable.
    return (
        spark.read.option("sep", "\t")
        .option("header", True)
        .option("escape", '"')
        .option("pathGlobFilter", "*.txt")
    )


def headers(spark: SparkSession, paths: list[str]) -> DataFrame:
    """First line of every file that has one: (file_path, header)."""
    lines = spark.read.option("pathGlobFilter", "*.txt").text(paths)
    return (
        lines.select(
            "value",
            F.monotonically_increasing_id().alias("seq"),
            F.col("_metadata.file_path").alias("file_path"),
            F.col("_metadata.file_block_start").alias("block_start"),
        )
        .where(F.col("block_start") == 0)
        .groupBy("file_path")
        .agg(F.min_by("value", "seq").alias("header"))
    )


def first_header(spark: SparkSession, path: str | list[str]) -> list[str]:
    """Column names of the first non-empty file below ``path``."""
    return _text(spark).csv(path).columns


def _scan(spark: SparkSession, paths, names: list[str]) -> DataFrame:
    """All-string scan of files that share one header; Spark checks each file's header against ``names``."""
    schema = ", ".join(f"`{n}` string" for n in [*names, "row_error"])
    return (
        _text(spark)
        .option("enforceSchema", False)
        .option("columnNameOfCorruptRecord", "row_error")
        .schema(schema)
        .csv(paths)
        .select(
            *[F.col(f"`{n}`").alias(column_name(n)) for n in names if column_name(n) in RESULT_COLUMNS],
            F.col("_metadata.file_path").alias("file_path"),
            F.col("_metadata.file_block_start").alias("block_start"),
            F.monotonically_increasing_id().alias("scan_seq"),
            "row_error",
        )
    )


def require_columns(found: list[str], needed: list[str]) -> None:
    missing = [c for c in needed if c not in found]
    if missing:
        raise ValueError(f"Missing columns {missing}. Columns: {list(found)}")


def _data_columns(names: list[str]) -> list[str]:
    # Folder columns such as source_file=… follow the header's own.
    return [n for n in names if n != "source_file"]


def scan_text(spark: SparkSession, path, names: list[str] | None = None) -> DataFrame:
    """Result files with one common header as untyped columns plus where each row was found.

    Columns are matched by name: extra ones are dropped, order is free, a missing one raises ValueError.
    """
    names = names or _data_columns(first_header(spark, path))
    require_columns([column_name(n) for n in names], RESULT_COLUMNS)
    return _scan(spark, path, names).select(*RESULT_COLUMNS, "file_path", "block_start", "scan_seq", "row_error")


def typed(lines: DataFrame) -> DataFrame:
    """Typed result rows; ``n_bad`` counts values of a row that are not numbers, and a wrong number of fields."""
    parsed = lines.withColumns({f"_{c}": number(F.col(c)) for c in NUMERIC_COLUMNS})
    malformed = [is_malformed(F.col(c), F.col(f"_{c}")).cast("int") for c in NUMERIC_COLUMNS]
    return parsed.select(
        source_name(F.col("file_path")).alias("source_file"),
        "variant",
        *[F.col(f"_{c}").alias(c) for c in NUMERIC_COLUMNS],
        F.coalesce("notes", F.lit("")).alias("notes"),
        sum(malformed, F.col("row_error").isNotNull().cast("int")).alias("n_bad"),
        "file_path",
        "block_start",
        "scan_seq",
    )


def read_results(spark: SparkSession, path, names: list[str] | None = None) -> DataFrame:
    """Typed rows of result files with one common header, plus run name and number."""
    rows = typed(scan_text(spark, path, names))
    return rows.select("source_file", perm_id(F.col("source_file")).alias("perm_id"), *RESULT_COLUMNS)


def read_column(spark: SparkSession, path, column: str) -> DataFrame:
    """One column of result files, under its table name."""
    if column not in RESULT_COLUMNS:
        raise ValueError(f"Result files have no column {column!r}, only {RESULT_COLUMNS}")
    return read_results(spark, path).select(column)


def read_file(spark: SparkSession, path) -> DataFrame:
    """A result file as it is: raw column names, inferred types."""
    return _text(spark).option("inferSchema", True).csv(path)


def read_facts(spark: SparkSession, path: str) -> DataFrame:
    """Parquet result rows with ``filename`` and ``source_file``.

    Takes a file, folder or glob. Files without a stored run name get it from the file's own name.
    """
    facts = spark.read.option("pathGlobFilter", "*.parquet").parquet(path)
    named = facts.select("*", F.col("_metadata.file_path").alias("filename"))
    if "source_file" not in facts.columns:
        named = named.withColumn(
            "source_file", F.regexp_extract(F.url_decode("filename"), r"([^/\\]+)\.parquet$", 1)
        )
    if "perm_id" not in facts.columns:
        named = named.withColumn("perm_id", perm_id(F.col("source_file")))
    return named


def read_variants(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def has_result_header(names: list[str]) -> bool:
    return set(RESULT_COLUMNS) <= {column_name(n) for n in names}

