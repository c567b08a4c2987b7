"""Conversion of result text files to Parquet, with one event per result file."""

import time
from dataclasses import dataclass
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import decoded, perm_id
from ..operators.dictionary import grow, read_dictionary
from ..operators.normalize import check_against_reference, encode, positional_reference
from ..operators.ordering import row_index
from ..operators.redundancy import order_marks
from ..schema import CONVERT_FAILED, CONVERTED, RESULT_COLUMNS
from ..sources.files import delete_files, result_files
from ..sources.results import first_header, has_result_header, headers, read_variants, scan_text, typed
from ..sources.writers import write_events, write_facts, write_variants
from ..staging import delete, exists, new_path, stage

NORMALIZED = "normalized"
INLINE = "inline"
SET_NORMALIZED = "set_normalized"


@dataclass
class Conversion:
    """What a conversion wrote."""

    facts_path: str
    reference_path: str | None
    events: DataFrame


def _origin(path):
    """The file of a run, or its folder where the run has one."""
    return F.when(path.rlike(r"/source_file=[^/]+/[^/]*$"), F.regexp_replace(path, r"/[^/]*$", "")).otherwise(path)


def stage_lines(spark: SparkSession, paths, folder: str | None = None, positions: bool = True) -> DataFrame:
    """Typed rows of all readable files, written once; without ``positions`` it is not kept where a row was found.

    Files normally share one header, which Spark verifies during the scan. Only if that fails are the
    first lines compared, and each group of files with the same usable header is scanned on its own.
    """
    left_out = () if positions else ("file_path", "block_start", "scan_seq")
    names = [n for n in first_header(spark, paths) if n != "source_file"]
    common_error = None
    if has_result_header(names):
        try:
            return stage(typed(scan_text(spark, paths, names)).drop(*left_out), "lines", folder)
        except (PySparkException, Py4JJavaError) as error:  # a file with another header is told apart below
            if "header" not in str(error):
                raise
            common_error = error
    found = (
        headers(spark, paths)
        .groupBy("header")
        .agg(F.collect_list(decoded(F.col("file_path"))).alias("paths"))
        .collect()
    )
    if common_error and len(found) == 1:
        raise common_error
    scans = [
        typed(scan_text(spark, row.paths, row.header.split("\t")))
        for row in found
        if has_result_header(row.header.split("\t"))
    ]
    if not scans:
        # Nothing can be read: no rows, so that every file becomes a failed event.
        scans = [typed(scan_text(spark, paths, RESULT_COLUMNS)).where("false")]
    return stage(reduce(DataFrame.unionByName, scans).drop(*left_out), "lines", folder)


def _quality(rows: DataFrame, positions: bool) -> DataFrame:
    """Per run: rows and malformed values; with known positions also the order fingerprint."""
    marks = order_marks() if positions else [F.count(F.lit(1)).alias("rows")]
    return rows.groupBy("source_file").agg(F.sum("n_bad").alias("n_bad"), *marks)


def _events(files: DataFrame, quality: DataFrame, seconds: float, facts_path: str) -> DataFrame:
    per_run = files.groupBy("source_file").agg(
        F.min(_origin(F.col("path"))).alias("txt_path"), F.sum("length").alias("length")
    )
    joined = per_run.join(quality, "source_file", "left")
    error = (
        F.when(F.col("length") == 0, "empty file")
        .when(F.col("rows").isNull(), "no rows: header only, or columns missing")
        .when(F.col("n_bad") > 0, F.format_string("%d malformed values", F.col("n_bad")))
    )
    status = F.when(error.isNull(), CONVERTED).otherwise(CONVERT_FAILED)
    runs = F.count(F.lit(1)).over(Window.partitionBy())  # one row per run
    return joined.select(
        F.col("source_file").alias("name"),
        status.alias("status"),
        (F.lit(seconds) / runs).alias("elapsed_seconds"),
        "txt_path",
        F.when(error.isNull(), F.lit(facts_path)).alias("parquet_path"),
        error.alias("error"),
    )


def convert(
    spark: SparkSession,
    source,
    facts_path: str,
    reference_path: str | None = None,
    layout: str = NORMALIZED,
    mode: str = "errorifexists",
    events_path: str | None = None,
    events_mode: str = "append",
    delete_source: bool = False,
) -> Conversion:
    """Convert the result files in a folder, or a list of file paths.

    A file that is empty, lacks columns or holds values that are not numbers becomes a failed event and
    the others go on; its rows are left out as a whole. In the normalised layout all files must repeat the
    reference's variants in order. The reference is the first good file's unless one exists already, and is
    never replaced. The set-normalised layout gives ids to variants that its dictionary lacks; ids once given stay.
    ``delete_source`` removes the text of converted runs from the executors and leaves a ledger beside the facts.
    """
    if layout not in (NORMALIZED, INLINE, SET_NORMALIZED):
        raise ValueError(f"Unknown layout {layout!r}")
    if layout != INLINE and reference_path is None:
        raise ValueError(f"The {layout} layout needs a reference path")
    started = time.monotonic()
    files = stage(result_files(spark, source), "files")
    if files.isEmpty():
        raise ValueError(f"{source} holds no result files")
    scratch = new_path(spark, "conversion")
    lines = stage_lines(spark, source, scratch, positions=layout == NORMALIZED)
    if layout == NORMALIZED:
        lines = row_index(lines, folder=scratch)
    quality = stage(_quality(lines, layout == NORMALIZED), "quality")
    good = quality.where("n_bad = 0")
    rows = lines.join(good.select("source_file"), "source_file", "left_semi")
    rows = rows.withColumn("perm_id", perm_id(F.col("source_file")))

    located = ["source_file", "perm_id"]
    stats = [c for c in RESULT_COLUMNS if c != "variant"]
    if layout == INLINE:
        facts = rows.select(*located, "variant", *stats)
    elif layout == NORMALIZED:
        if not exists(spark, reference_path):
            first = good.agg(F.min("source_file")).first()[0]
            if first is not None:
                write_variants(positional_reference(rows, first), reference_path)
        if exists(spark, reference_path):
            check_against_reference(rows, read_variants(spark, reference_path), good)
        facts = rows.select(F.col("row_idx").alias("variant_id"), *located, *stats)
    else:
        version = grow(spark, reference_path, rows)
        dictionary = read_dictionary(spark, reference_path, version).select("variant_id", "variant")
        # Hashed, so that the rows, many times the dictionary, are not sorted to be joined.
        facts = encode(rows, dictionary.hint("shuffle_hash")).select("variant_id", *located, *stats)
    write_facts(facts, facts_path, good.agg(F.sum("rows")).first()[0] or 0, mode)

    events = stage(_events(files, quality, time.monotonic() - started, facts_path), "events")
    if events_path:
        write_events(events, events_path, events_mode)
    delete(spark, scratch)
    if delete_source:
        delete_converted(spark, events, ledger_path(facts_path))
    return Conversion(facts_path, None if layout == INLINE else reference_path, events)


def ledger_path(path: str) -> str:
    """Where it is noted what was deleted for the rows or events at ``path``: beside them, in a folder that scans pass over."""
    parent, _, name = path.rstrip("/").rpartition("/")
    return f"{parent}/_deleted/{name}"


def delete_converted(spark: SparkSession, events: DataFrame, ledger: str) -> DataFrame:
    """Delete the text of converted runs in the executors; call only after the rows and events are committed.

    Returns the ledger ``(name, path, outcome)``, written to ``ledger``. Running it again deletes nothing twice: what
    is gone already is noted as ``absent``.
    """
    done = events.where(F.col("status") == CONVERTED).select("name", F.col("txt_path").alias("path"))
    delete_files(done).write.mode("overwrite").parquet(ledger)
    return spark.read.parquet(ledger)


def write_inline(spark: SparkSession, run_dir: str, out_dir: str, delete_source: bool = False) -> Conversion:
    return convert(spark, run_dir, out_dir, layout=INLINE, delete_source=delete_source)


def write_normalized(
    spark: SparkSession,
    run_dir: str,
    out_dir: str,
    reference_path: str | None = None,
    delete_source: bool = False,
) -> Conversion:
    parent = out_dir.rstrip("/").rsplit("/", 1)[0]
    reference_path = reference_path or f"{parent}/reference/variants.parquet"
    return convert(spark, run_dir, out_dir, reference_path, NORMALIZED, delete_source=delete_source)
