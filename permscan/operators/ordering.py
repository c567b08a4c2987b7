"""Exact positions and running sums in a total order, without one task seeing a whole group.

Rows are range-partitioned the way a distributed sort does it and the chunk number is frozen in a staged
table. Chunk totals (one row per chunk and group) then give each chunk its offset, and only rows of one
chunk meet in a window. A group holding most of the rows is therefore spread over many chunks.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import stage

CHUNK = "_chunk"


def with_chunks(df: DataFrame, *order: str, partitions: int | None = None) -> DataFrame:
    """Staged copy of ``df`` with a chunk number that increases along ``order``."""
    count = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(count, *order)
    return stage(ranged.withColumn(CHUNK, F.spark_partition_id()), "chunks")


def _before(by: tuple) -> Window:
    return Window.partitionBy(*by).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)


def _join_chunks(df: DataFrame, per_chunk: DataFrame, by: tuple) -> DataFrame:
    # Plain equality: the windows have already placed the rows by these columns, so they are not moved again.
    return df.join(per_chunk, [*by, CHUNK])


def chunk_offsets(chunked: DataFrame, value: str, by: tuple = (), totals: dict[str, Column] | None = None) -> DataFrame:
    """One row per group and chunk: the sum of ``value`` in the chunk and in the chunks before it.

    ``totals`` names sums over the whole group that every row gets as well.
    """
    totals = totals or {}
    sums = chunked.groupBy(*by, CHUNK).agg(
        F.sum(value).alias("_sum"), *[F.sum(c).alias(f"_{name}") for name, c in totals.items()]
    )
    group = Window.partitionBy(*by)
    return sums.select(
        *by,
        CHUNK,
        "_sum",
        F.coalesce(F.sum("_sum").over(_before(by)), F.lit(0)).alias("_offset"),
        *[F.sum(f"_{name}").over(group).alias(name) for name in totals],
    )


def running_total(
    chunked: DataFrame, offsets: DataFrame, value: str, order: tuple, out: str, by: tuple = ()
) -> DataFrame:
    """Inclusive running sum of ``value`` along the unique key ``order`` within ``by``, for the chunks in ``offsets``.

    ``chunked`` comes from :func:`with_chunks` over ``(*by, *order)``; the ``by`` columns are never NULL.
    """
    inside = (
        Window.partitionBy(*by, CHUNK).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = chunked.withColumn(out, F.sum(value).over(inside))
    joined = _join_chunks(local, offsets.drop("_sum"), by)
    return joined.withColumn(out, F.col(out) + F.col("_offset")).drop("_offset")


def dense_index(df: DataFrame, *order: str, out: str = "pos") -> DataFrame:
    """Position 0, 1, 2, … of every row along ``order``. Rows equal in ``order`` get arbitrary neighbours."""
    chunked = with_chunks(df, *order)
    sizes = chunked.groupBy(CHUNK).agg(F.count(F.lit(1)).alias("_rows"))
    offsets = sizes.select(CHUNK, F.coalesce(F.sum("_rows").over(_before(())), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(CHUNK).orderBy(*order)
    local = chunked.withColumn(out, F.row_number().over(inside) - 1)
    return local.join(offsets, CHUNK).withColumn(out, F.col(out) + F.col("_offset")).drop(CHUNK, "_offset")


def row_index(lines: DataFrame, out: str = "row_idx", folder: str | None = None) -> DataFrame:
    """0-based position of every row in its source, from scan positions kept by the text reader.

    Within a file split rows carry consecutive scan numbers, so a split's first number and the sizes of
    the splits before it locate each row; no window over the rows themselves. The table of splits is staged (in
    ``folder``, if given): it is computed once, and its true size is known when the rows are joined with it.
    """
    key = ["source_file", "file_path", "block_start"]
    splits = lines.groupBy(*key).agg(F.count(F.lit(1)).alias("_rows"), F.min("scan_seq").alias("_first"))
    earlier = (
        Window.partitionBy("source_file")
        .orderBy("file_path", "block_start")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = splits.select(*key, "_first", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_offset"))
    offsets = stage(offsets, "splits", folder)
    position = F.col("_offset") + F.col("scan_seq") - F.col("_first")
    return lines.join(offsets, key).withColumn(out, position.cast("int")).drop("_offset", "_first")
