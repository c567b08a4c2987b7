"""Intermediate tables that outlive executors: written once into the shared folder, then read back."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_fallback = None


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir`` as the session names it.

    Only a local-mode session without that setting gets a temporary folder of its own.
    """
    global _local_fallback
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if _local_fallback is None:
        _local_fallback = tempfile.TemporaryDirectory(prefix="permscan-", ignore_cleanup_errors=True)
    return _local_fallback.name


def _app_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/permscan/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, label: str) -> str:
    """Unused path below the shared folder."""
    return f"{_app_folder(spark)}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str, folder: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and return the table read back.

    Cuts lineage durably, and freezes values such as partition ids that a recomputation could change.
    A ``folder`` gathers tables that are to be deleted together.
    """
    spark = df.sparkSession
    path = new_path(spark, label) if folder is None else f"{folder}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete everything this application has staged; frames built on it become unusable."""
    delete(spark, _app_folder(spark))


def _hadoop(spark: SparkSession, path: str):
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()), jvm_path


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = _hadoop(spark, path)
    return fs.exists(target)


def delete(spark: SparkSession, path: str) -> bool:
    """Remove one file or folder; False when it was already gone."""
    fs, target = _hadoop(spark, path)
    return fs.delete(target, True)
