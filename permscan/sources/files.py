"""File listings, which read no data, and deletion."""

import re

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import decoded, source_name

DELETED, ABSENT = "deleted", "absent"


def result_files(spark: SparkSession, source, suffix: str = ".txt") -> DataFrame:
    """Result files (name, path, length) of a folder or list of paths. Only file metadata is read.

    Looks at files directly in a folder and in ``source_file=…`` folders as Spark itself writes them.
    A scan passes over empty files, so their names come from Spark's own file index.
    """
    listed = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(source)
    scanned = listed.select(F.col("_metadata.file_path").alias("uri"), "length")
    # The index writes file:///a where the scan writes file:/a.
    names = [(uri.replace(":///", ":/", 1),) for uri in listed.inputFiles() if uri.endswith(suffix)]
    indexed = spark.createDataFrame(names, "uri string")
    return indexed.join(scanned, "uri", "left").select(
        source_name(F.col("uri")).alias("source_file"),
        decoded(F.col("uri")).alias("path"),
        F.coalesce("length", F.lit(0)).alias("length"),
    )


def list_result_files(spark: SparkSession, run_dir: str, suffix: str = ".txt") -> DataFrame:
    """Result files of a run in text order of their names."""
    return result_files(spark, run_dir, suffix).orderBy("source_file", "path")


def first_files(spark: SparkSession, run_dir: str, sample: int = 5, suffix: str = ".txt") -> list[str]:
    """Paths that make up the first ``sample`` result files in text order."""
    listed = result_files(spark, run_dir, suffix)
    names = listed.select("source_file").distinct().orderBy("source_file").limit(sample)
    return [r.path for r in listed.join(names, "source_file", "left_semi").orderBy("path").collect()]


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    """File system and plain path of a path or URI: local, HDFS or object store."""
    if re.match(r"file:/+", path):
        return fs.LocalFileSystem(), "/" + re.sub(r"^file:/+", "", path)
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def _delete(path: str) -> str:
    """What became of one file or folder; a failure is an outcome, so that the others go on."""
    try:
        store, plain = open_store(path)
        kind = store.get_file_info(plain).type
        if kind == fs.FileType.NotFound:
            return ABSENT
        (store.delete_dir if kind == fs.FileType.Directory else store.delete_file)(plain)
        return DELETED
    except (OSError, pa.ArrowException) as error:
        return f"{type(error).__name__}: {error}"


def delete_files(manifest: DataFrame) -> DataFrame:
    """``(name, path, outcome)`` of deleting the files or folders of ``(name, path)`` in the executors.

    The outcome is ``deleted``, ``absent`` or an error's text. Deletion happens when the result is read, again at
    each reading, so write it down first.
    """

    def run(batches):
        for batch in batches:
            outcomes = [_delete(path) for path in batch.column("path").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(outcomes, pa.string())], ["name", "path", "outcome"])

    return manifest.select("name", "path").mapInArrow(run, "name string, path string, outcome string")
