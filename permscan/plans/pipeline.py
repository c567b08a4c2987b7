"""End-to-end run: trait → permutations → association scan → Parquet → views."""

from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import perm_name
from ..operators.association import OBSERVED, association_statistics, result_rows, scan_sums
from ..operators.permute import PermutationStore
from ..operators.traits import extract_trait
from ..schema import (
    CONVERTED,
    DEFAULT_PERMUTATIONS,
    DEFAULT_SEED,
    MAX_AF,
    MIN_AF,
    RESULT_COLUMNS,
    RUN_EVENT,
    SCAN_FAILED,
)
from ..sources.writers import dataset_path, write_events, write_facts, write_summary, write_variants
from ..staging import stage
from .views import Dataset, open_dataset

NORMALIZED, INLINE = "normalized", "inline"


@dataclass
class RunConfig:
    base_dir: str
    population: str
    traits: list[str]
    id_column: str = "ID"
    n_perms: int = DEFAULT_PERMUTATIONS
    seed: int = DEFAULT_SEED
    min_af: float = MIN_AF
    max_af: float = MAX_AF
    # Whether variant strings stand in a reference table or on every result row.
    layout: str = NORMALIZED
    timestamp: str = field(default_factory=lambda: datetime.now(timezone.utc).strftime("%Y%m%dT%H%M%SZ"))

    def __post_init__(self):
        if self.layout not in (NORMALIZED, INLINE):
            raise ValueError(f"layout {self.layout!r} is neither {NORMALIZED!r} nor {INLINE!r}")

    def path(self, kind: str, trait: str, variant_type: str) -> str:
        return dataset_path(self.base_dir, kind, self.population, trait, variant_type)


def _events(outcomes: DataFrame, results: str) -> DataFrame:
    """One event per permutation from ``(perm_id, elapsed_seconds, error)``."""
    scanned = F.col("error").isNull()
    values = {
        "name": perm_name(F.col("perm_id")),
        "status": F.when(scanned, CONVERTED).otherwise(SCAN_FAILED),
        "elapsed_seconds": F.col("elapsed_seconds"),
        "txt_path": F.lit(None),
        "parquet_path": F.when(scanned, results),
        "error": F.col("error"),
    }
    return outcomes.select(*[values[f.name].cast(f.dataType).alias(f.name) for f in RUN_EVENT])


def _run_job(
    config: RunConfig, store: PermutationStore, master: DataFrame, trait: str, variant_type: str, presence: DataFrame
) -> None:
    """Scan on ids; strings meet the rows only in the inline layout. Failed permutations leave an event, no rows."""
    pheno = stage(extract_trait(master, trait, config.id_column), "pheno")
    band = {"min_af": config.min_af, "max_af": config.max_af}
    scan = scan_sums(presence, pheno, config.n_perms, config.seed, store=store, **band)
    rows = result_rows(association_statistics(scan.sums, pheno, **band))
    key, results = "variant_id", config.path("permutations", trait, variant_type)
    if config.layout == INLINE:
        key, rows = "variant", rows.join(scan.variants, "variant_id")
    else:
        write_variants(scan.variants, config.path("variants", trait, variant_type))
    stats = [c for c in RESULT_COLUMNS if c != "variant"]
    write_facts(rows.select(key, "source_file", "perm_id", *stats), results, scan.sums.count())
    write_events(_events(scan.outcomes, results), config.path("run_events", trait, variant_type))


def _job_failed(spark: SparkSession, config: RunConfig, trait: str, variant_type: str, error: Exception) -> None:
    text = F.lit(f"{type(error).__name__}: {error}"[:2000])
    outcomes = spark.range(OBSERVED, config.n_perms + 1).select(
        F.col("id").alias("perm_id"), F.lit(0.0).alias("elapsed_seconds"), text.alias("error")
    )
    write_events(_events(outcomes, ""), config.path("run_events", trait, variant_type))


def run(config: RunConfig, master: DataFrame, presence_by_type: dict[str, DataFrame]) -> str:
    """Run every trait × variant type and write a run summary; returns the summary's path.

    ``perm_0000`` holds the observed trait, ``perm_0001`` … the permutations. Permutations are drawn once for all jobs
    with the same samples. A job that fails as a whole leaves a failure event for every permutation and the status
    ``error``; the other jobs run.
    """
    spark = master.sparkSession
    store = PermutationStore(config.n_perms, config.seed)
    status = "error"
    try:
        failed = 0
        for trait in config.traits:
            for variant_type, presence in presence_by_type.items():
                try:
                    _run_job(config, store, master, trait, variant_type, presence)
                except (PySparkException, ValueError) as error:
                    failed += 1
                    _job_failed(spark, config, trait, variant_type, error)
        status = "error" if failed else "done"
    finally:
        summary = write_summary(
            spark,
            config.base_dir,
            config.timestamp,
            config.population,
            config.traits,
            list(presence_by_type),
            config.n_perms,
            status,
            config.base_dir,
        )
    return summary


def open_run(spark, config: RunConfig, trait: str, variant_type: str) -> Dataset:
    """Views over one job of a run."""
    reference = config.path("variants", trait, variant_type) if config.layout == NORMALIZED else None
    return open_dataset(spark, config.path("permutations", trait, variant_type), reference)
