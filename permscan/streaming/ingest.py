"""Convert result files as they land, exactly once, with bounded extra disk."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.normalize import positional_reference
from ..operators.ordering import row_index
from ..plans.convert import INLINE, NORMALIZED, convert, delete_converted, ledger_path, stage_lines
from ..sources.files import first_files
from ..sources.writers import write_variants
from ..staging import exists

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def bootstrap_reference(spark: SparkSession, run_dir: str, reference_path: str) -> None:
    """Write the reference from the first file in text order, unless there is one.

    A stream sees files in no particular order, so it must not pick the reference itself.
    """
    if exists(spark, reference_path):
        return
    paths = first_files(spark, run_dir, sample=1)
    if not paths:
        raise ValueError(f"{run_dir} holds no result files")
    lines = stage_lines(spark, paths)
    source = lines.agg(F.min("source_file")).first()[0]
    write_variants(positional_reference(row_index(lines), source), reference_path)


def _sweep(spark: SparkSession, events_path: str, batch: int) -> None:
    committed = f"{events_path}/batch={batch}"
    if exists(spark, committed):
        delete_converted(spark, spark.read.parquet(committed), ledger_path(committed))


def start_ingest(
    spark: SparkSession,
    run_dir: str,
    facts_path: str,
    events_path: str,
    checkpoint: str,
    reference_path: str | None = None,
    max_files: int = 1000,
    delete_source: bool = True,
    available_now: bool = False,
    layout: str | None = None,
) -> StreamingQuery:
    """Stream new result files of ``run_dir`` into Parquet rows and run events.

    The stream lists files only; each batch goes through the batch conversion. Rows and events of a batch
    live in a folder named after it, which a replayed batch overwrites. The sources of a batch are deleted
    once the next one starts, when its commit is certain; :func:`ingest_available` also sweeps the last.
    Writers must move finished files into ``run_dir``. Without a ``layout`` a reference path means the normalised one;
    in the set-normalised layout every batch adds its new variants to the dictionary at that path.
    """
    layout = layout or (NORMALIZED if reference_path else INLINE)
    if layout == NORMALIZED:
        bootstrap_reference(spark, run_dir, reference_path)

    def convert_batch(files: DataFrame, batch: int) -> None:
        session = files.sparkSession
        if delete_source and batch:
            _sweep(session, events_path, batch - 1)
        paths = [r.path for r in files.select("path").collect()]  # at most max_files
        if paths:
            convert(
                session,
                paths,
                f"{facts_path}/batch={batch}",
                reference_path,
                layout,
                mode="overwrite",
                events_path=f"{events_path}/batch={batch}",
                events_mode="overwrite",
            )

    stream = (
        spark.readStream.format("binaryFile")
        .schema(FILE_SCHEMA)
        .option("pathGlobFilter", "*.txt")
        .option("maxFilesPerTrigger", max_files)
        .load(run_dir)
        .select("path")
        .writeStream.foreachBatch(convert_batch)
        .option("checkpointLocation", checkpoint)
    )
    return (stream.trigger(availableNow=True) if available_now else stream).start()


def ingest_available(spark: SparkSession, run_dir: str, facts_path: str, events_path: str, checkpoint: str, **options) -> None:
    """Convert everything that has landed, then stop."""
    query = start_ingest(spark, run_dir, facts_path, events_path, checkpoint, available_now=True, **options)
    query.awaitTermination()
    if options.get("delete_source", True) and exists(spark, events_path):
        last = spark.read.parquet(events_path).agg(F.max("batch")).first()[0]
        if last is not None:
            _sweep(spark, events_path, last)


def progress(spark: SparkSession, events_path: str, total: int) -> DataFrame:
    """One row: finished and failed runs so far out of ``total``."""
    events = spark.read.parquet(events_path)
    return events.agg(
        F.count_if(F.col("status") == "converted").alias("n_converted"),
        F.count_if(F.col("status") != "converted").alias("n_failed"),
        (F.lit(total) - F.count(F.lit(1))).alias("n_left"),
    )
