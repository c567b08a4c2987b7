"""Variant strings factored out into a reference table."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import stage
from .ordering import dense_index
from .hashtree import first_differences
from .redundancy import MARKS, order_fingerprints, reference_fingerprint


class ReferenceMismatch(ValueError):
    """A file's variants are not the reference's in value and order.

    ``differences`` has the first difference of every differing file.
    """

    def __init__(self, message: str, differences: DataFrame):
        super().__init__(message)
        self.differences = differences


def positional_reference(indexed: DataFrame, source: str) -> DataFrame:
    """(variant_id, variant) of one file: the id is the row's position, repeated variants are kept."""
    return indexed.where(F.col("source_file") == source).select(
        F.col("row_idx").cast("int").alias("variant_id"), "variant"
    )


def check_against_reference(
    indexed: DataFrame, variants: DataFrame, fingerprints: DataFrame | None = None
) -> None:
    """Raise ReferenceMismatch naming the first file, in text order, that departs from the reference.

    ``fingerprints`` may hold those of ``indexed`` if they are known already.
    """
    reference = reference_fingerprint(variants).select(F.struct(*MARKS)).scalar()
    found = order_fingerprints(indexed) if fingerprints is None else fingerprints
    differing = found.where(F.struct(*MARKS) != reference).select("source_file")
    if differing.isEmpty():
        return
    # Only files whose whole fingerprint differs enter the tree.
    rows = indexed.join(differing, "source_file", "left_semi")
    differences = stage(first_differences(rows, variants), "differences")
    least = F.min(F.struct("source_file", "row_idx", "expected", "found"))
    first = differences.agg(least.alias("at"), F.count(F.lit(1)).alias("n")).first()
    at = first["at"]
    raise ReferenceMismatch(
        f"{at['source_file']}: variants differ from the reference at row {at['row_idx']}: expected {at['expected']!r}, "
        f"found {at['found']!r} ({first['n']} differing files). "
        "Check the redundancy verdict and use the inline or the set-based layout.",
        differences,
    )


def variant_dictionary(rows: DataFrame) -> DataFrame:
    """(variant_id, variant) over the union of all variants, ids in text order of the variants."""
    distinct = rows.select("variant").where("variant is not null").distinct()
    return dense_index(distinct, "variant", out="variant_id").select(
        F.col("variant_id").cast("int").alias("variant_id"), "variant"
    )


def encode(rows: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Replace the variant string by its id; a missing string keeps a NULL id."""
    return rows.join(dictionary, "variant", "left").drop("variant")


def orphans(permutations: DataFrame, variants: DataFrame) -> DataFrame:
    """Rows whose ``variant_id`` the reference lacks; the ``results`` view drops them."""
    return permutations.join(variants.select("variant_id"), "variant_id", "left_anti")
