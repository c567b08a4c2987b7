"""Trait extraction from a wide phenotype table."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import trait_number
from ..schema import MISSING_IDS


def require(df: DataFrame, column: str, role: str) -> None:
    if column not in df.columns:
        raise ValueError(f"The table lacks the {role} column {column!r}; it has {df.columns}")


def trait_columns(master: DataFrame, id_column: str = "ID") -> list[str]:
    """Every column but the id is a trait."""
    require(master, id_column, "ID")
    return [c for c in master.columns if c != id_column]


def extract_trait(master: DataFrame, trait: str, id_column: str = "ID") -> DataFrame:
    """(sample, phenotype) for one trait, without rows that lack a sample or a numeric value."""
    require(master, id_column, "ID")
    require(master, trait, "trait")
    sample = F.col(f"`{id_column}`")
    return master.select(
        F.when(~sample.isin(MISSING_IDS), sample).alias("sample"),
        trait_number(F.col(f"`{trait}`")).alias("phenotype"),
    ).dropna(subset=["sample", "phenotype"])


def valid_counts(master: DataFrame, id_column: str = "ID") -> DataFrame:
    """Rows with a numeric value per trait.

    Every row becomes one map of its traits, so the plan has one aggregate whatever the number of columns; counts are
    combined before they move.
    """
    traits = trait_columns(master, id_column)
    cells = F.arrays_zip(
        F.array(*[F.lit(t) for t in traits]).alias("trait"), F.array(*[F.col(f"`{t}`") for t in traits]).alias("value")
    )
    return cell_counts(master.select(F.explode(cells).alias("cell")).select("cell.*"))


def cell_counts(cells: DataFrame) -> DataFrame:
    """Rows with a numeric value per trait of ``(trait, value)``."""
    return cells.groupBy("trait").agg(F.count(trait_number(F.col("value"))).alias("n_valid"))


def trait_of_cells(cells: DataFrame, trait: str) -> DataFrame:
    """``(sample, phenotype)`` of one trait from ``(sample, trait, value)``, without rows that lack either."""
    sample = F.col("sample")
    picked = cells.where(F.col("trait") == trait)
    return picked.select(
        F.when(~sample.isin(MISSING_IDS), sample).alias("sample"), trait_number(F.col("value")).alias("phenotype")
    ).dropna(subset=["sample", "phenotype"])
