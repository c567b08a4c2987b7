"""First differences of many files from a reference, found by comparing hashes of row blocks level by level.

Hashes of rows combine by exclusive-or, so one pass over the rows gives the leaves of every file's tree, and coarser
levels follow from the leaves. Only children of differing nodes are compared, and only the first differing
block of a file is read again.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import stage
from .redundancy import MARKS, order_marks

# Rows of a leaf, and children of a node.
BLOCK_ROWS, FAN = 4096, 64

FILE = "source_file"


def _node(width: int):
    return F.floor(F.col("block") / width).alias("node")


def block_marks(indexed: DataFrame, rows: int = BLOCK_ROWS) -> DataFrame:
    """``(source_file, block, rows, mark, mark2)``: the leaves of every file's tree."""
    return indexed.groupBy(FILE, F.floor(F.col("row_idx") / rows).alias("block")).agg(*order_marks())


def _merged(marks: DataFrame, *by) -> DataFrame:
    return marks.groupBy(*by).agg(
        F.sum("rows").alias("rows"), F.bit_xor("mark").alias("mark"), F.bit_xor("mark2").alias("mark2")
    )


def _first_differing(found: DataFrame, expected: DataFrame) -> DataFrame:
    """Per file the first node whose marks are not the reference's, from ``(source_file, node, *marks)`` of both."""
    signed = expected.withColumn("rows", -F.col("rows")).unionByName(found)
    left = _merged(signed, FILE, "node").where("rows <> 0 or mark <> 0 or mark2 <> 0")
    return left.groupBy(FILE).agg(F.min("node").alias("parent"))


def first_differences(
    indexed: DataFrame, reference: DataFrame, rows: int = BLOCK_ROWS, marks: DataFrame | None = None
) -> DataFrame:
    """``(source_file, row_idx, expected, found)``: where each file that differs from the reference does so first.

    ``indexed`` holds ``(source_file, row_idx, variant)``, ``reference`` ``(variant_id, variant)``. Files that equal the
    reference have no row. A side that has ended shows as NULL. ``marks`` may hold the files' leaves if they are known already.
    """
    whole = reference.select(F.lit("").alias(FILE), F.col("variant_id").alias("row_idx"), "variant")
    leaves = stage(block_marks(indexed, rows) if marks is None else marks, "leaves")
    expected = stage(block_marks(whole, rows).drop(FILE), "leaves")
    last = leaves.select("block").union(expected.select("block")).agg(F.max("block")).first()[0]
    root = _merged(expected).select(F.struct(*MARKS)).scalar()
    files = _merged(leaves, FILE).where(~F.struct(*MARKS).eqNullSafe(root))
    at = files.select(FILE, F.lit(0).cast("long").alias("parent"))

    width = 1
    while last is not None and width <= last:
        width *= FAN
    while width > 1:
        at, width = stage(at, "differing"), width // FAN
        parent = F.floor(F.col("block") / (width * FAN)).alias("parent")
        level = leaves.select("*", parent).join(at, [FILE, "parent"])
        due = expected.select("*", parent).join(at, "parent")
        at = _first_differing(
            _merged(level, FILE, _node(width)), _merged(due, FILE, _node(width))
        )
    at = stage(at.withColumnRenamed("parent", "block"), "differing")

    block = F.floor(F.col("row_idx") / rows).alias("block")
    none, one = F.lit(None).cast("string"), F.lit(1)
    row, variant = F.col("row_idx").cast("long").alias("row_idx"), F.col("variant")
    here = indexed.select(FILE, "row_idx", "variant", block).join(at, [FILE, "block"], "left_semi")
    here = here.select(FILE, row, variant.alias("found"), none.alias("expected"), one.alias("side"))
    due = whole.select("row_idx", "variant", block).join(at, "block")
    due = due.select(FILE, row, none.alias("found"), variant.alias("expected"), F.lit(2).alias("side"))
    met = here.union(due).groupBy(FILE, "row_idx").agg(
        F.max("found").alias("found"), F.max("expected").alias("expected"), F.sum("side").alias("sides")
    )
    differs = (F.col("sides") != 3) | ~F.col("found").eqNullSafe(F.col("expected"))
    first = F.min(F.when(differs, F.struct("row_idx", "expected", "found"))).alias("at")
    return met.groupBy(FILE).agg(first).where("at is not null").select(FILE, "at.*")
