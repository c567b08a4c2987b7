"""Best rows by a statistic. Each is a per-task top-k merged on one task of at most ``limit`` rows per input."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import effect_z
from ..schema import MAX_AF, MIN_AF


def _ranked(df: DataFrame, value, limit: int, ascending: bool) -> DataFrame:
    direction = value.asc_nulls_last() if ascending else value.desc_nulls_last()
    ties = [c for c in ("source_file", "variant_id", "variant") if c in df.columns]
    return df.orderBy(direction, *ties).limit(int(limit))


def top_hits(
    permutations: DataFrame,
    variants: DataFrame | None = None,
    column: str = "lrt_pvalue",
    limit: int = 20,
    ascending: bool = True,
    reference_complete: bool = False,
) -> DataFrame:
    """First ``limit`` result rows by ``column``, NULL last, ties in order of run and variant.

    Variant strings are fetched for the chosen rows only. Rows without a reference entry do not count as
    results; ``reference_complete`` skips that check where the dataset's writer has already made it.
    """
    if column not in permutations.columns:
        raise ValueError(f"No column {column!r} to rank by; there are {permutations.columns}")
    if variants is None:
        return _ranked(permutations, F.col(column), limit, ascending)
    rows = permutations
    if not reference_complete:
        rows = rows.join(variants.select("variant_id"), "variant_id", "left_semi")
    best = _ranked(rows, F.col(column), limit, ascending)
    return _ranked(best.join(variants, "variant_id"), F.col(column), limit, ascending)


def rank_by_effect(permutations: DataFrame, limit: int = 20) -> DataFrame:
    """Rows with the largest absolute effect over its standard error."""
    scored = permutations.withColumn("z", effect_z(F.col("beta"), F.col("beta_std_err")))
    return _ranked(scored, F.abs("z"), limit, ascending=False)


def rank_by_heritability(permutations: DataFrame, limit: int = 20) -> DataFrame:
    return _ranked(permutations, F.col("variant_h2"), limit, ascending=False)


def flagged_rows(permutations: DataFrame) -> DataFrame:
    """Rows whose statistics a quality flag puts in doubt."""
    return permutations.where(F.col("notes") != "")


def in_frequency_band(df: DataFrame, low: float = MIN_AF, high: float = MAX_AF) -> DataFrame:
    return df.where(F.col("af").between(low, high))
