"""Do result files repeat the same variants? Order and set comparison with the first file."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

IDENTICAL = "normalized"
SAME_SET = "set_normalized"
OVERLAP = "set_normalized_overlap"
DISTINCT = "inline"
OVERLAP_SHARE = 0.8


# What a fingerprint consists of.
MARKS = ["rows", "mark", "mark2"]


def order_marks():
    """Two independent 64-bit sums over (position, variant): equal for equal columns in equal order."""
    position, variant = F.col("row_idx"), F.coalesce("variant", F.lit("\0"))
    return [
        F.count(F.lit(1)).alias("rows"),
        F.bit_xor(F.xxhash64(position, variant)).alias("mark"),
        F.bit_xor(F.xxhash64(F.lit("second"), variant, position)).alias("mark2"),
    ]


def order_fingerprints(indexed: DataFrame, by: str = "source_file") -> DataFrame:
    """(source, rows, mark, mark2); partial results are combined before the shuffle."""
    return indexed.groupBy(by).agg(*order_marks())


def reference_fingerprint(variants: DataFrame) -> DataFrame:
    return variants.select(F.col("variant_id").alias("row_idx"), "variant").agg(*order_marks())


def set_comparison(lines: DataFrame) -> DataFrame:
    """Per file: distinct variants, those shared with the first file, and those no earlier file has.

    (file, variant) pairs are made distinct before the shuffle on the variant, where a variant then has at
    most one row per file.
    """
    first = lines.agg(F.min("source_file")).scalar()
    pairs = lines.select("source_file", "variant").distinct()
    of_variant = Window.partitionBy("variant")
    marked = pairs.select(
        "source_file",
        F.max((F.col("source_file") == first).cast("int")).over(of_variant).alias("shared"),
        (F.col("source_file") == F.min("source_file").over(of_variant)).cast("int").alias("new"),
    )
    per_file = marked.groupBy("source_file").agg(
        F.count(F.lit(1)).alias("n_unique"), F.sum("shared").alias("n_shared"), F.sum("new").alias("n_new")
    )
    # One row per file from here on.
    base = F.max(F.when(F.col("source_file") == first, F.col("n_unique"))).over(Window.partitionBy())
    same = (F.col("n_unique") == F.col("n_shared")) & (F.col("n_unique") == base)
    return per_file.withColumn("same_set", same)


def order_comparison(indexed: DataFrame) -> DataFrame:
    """Per file: rows, and whether its variants equal the first file's in value and order."""
    marks = order_fingerprints(indexed)
    everything = Window.partitionBy()
    first = F.min_by(F.struct(*MARKS), "source_file").over(everything)
    return marks.withColumn("first", first).select(
        "source_file", F.col("rows").alias("n_rows"), (F.struct(*MARKS) == F.col("first")).alias("identical")
    )


def redundancy_by_file(indexed: DataFrame) -> DataFrame:
    """One row per file with both comparisons."""
    return order_comparison(indexed).join(set_comparison(indexed), "source_file").drop("n_new")


def verdict(lines: DataFrame) -> DataFrame:
    """One row: the figures over all files and the storage layout they call for.

    ``lines`` holds (source_file, variant); the order is compared where it also holds ``row_idx``.
    """
    sets = set_comparison(lines).agg(
        F.sum("n_new").alias("n_union"),
        F.sum("n_unique").alias("sum_unique"),
        F.bool_and("same_set").alias("all_same_set"),
    )
    if "row_idx" in lines.columns:
        identical = order_comparison(lines).agg(F.bool_and("identical")).scalar()
    else:
        identical = F.lit(False)
    layout = (
        F.when(F.col("all_identical"), IDENTICAL)
        .when(F.col("all_same_set"), SAME_SET)
        .when(F.col("n_union") < F.col("sum_unique") * OVERLAP_SHARE, OVERLAP)
        .otherwise(DISTINCT)
    )
    return sets.withColumn("all_identical", identical).withColumn("verdict", layout)
