"""Single-variant association of a permuted trait in closed form (fixed effects, ordinary least squares).

Only t, the sum of the phenotype over a variant's carriers, depends on the permutation. The number k of
carriers belongs to the variant, and the phenotype's mean and sum of squares to the whole scan.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import chi2_tail, perm_name, three_digits
from ..schema import DEFAULT_SEED, MAX_AF, MIN_AF, NUMERIC_COLUMNS, RESULT_COLUMNS
from ..staging import stage
from . import grid
from .normalize import variant_dictionary
from .permute import KEYED, PermutationStore, sample_index

OBSERVED = 0


def carriers_of(presence: DataFrame) -> DataFrame:
    """Distinct (variant, sample) pairs that are present."""
    if "present" in presence.columns:
        presence = presence.where("present <> 0")
    return presence.select("variant", F.col("sample").cast("string").alias("sample")).distinct()


@dataclass
class Scan:
    """Sums over carriers of every permutation that could be scanned, and what became of each permutation."""

    # (perm_id, variant_id, k, t)
    sums: DataFrame
    # (variant_id, variant) of the variants in the frequency band, ids in text order
    variants: DataFrame
    # (perm_id, elapsed_seconds, error); no error for what was scanned
    outcomes: DataFrame


def scan_sums(
    presence: DataFrame,
    pheno: DataFrame,
    n_perms: int,
    seed: int = DEFAULT_SEED,
    permuted: DataFrame | None = None,
    variants: DataFrame | None = None,
    min_af: float = 0.0,
    max_af: float = 1.0,
    method: str = KEYED,
    store: PermutationStore | None = None,
    size: grid.Blocks = grid.Blocks(),
) -> Scan:
    """Scan every permutation by matrix products over a grid of blocks (:mod:`.grid`), on variant ids.

    Variants are packed and checked against the frequency band before anything is replicated. Draws come from
    ``store``, if one is given, or from the table ``permuted``, which need not hold the observed trait. A permutation
    with a missing, infinite or repeated value, or whose cell failed, has an error and no sums; the others go on.
    """
    index = sample_index(pheno)
    samples = index.count()
    packed = stage(grid.packed_carriers(carriers_of(presence), index, size), "carriers")
    held = packed.groupBy("variant").agg(F.sum(F.size("at")).alias("k"))
    if variants is not None:
        held = variants.select("variant").distinct().join(held, "variant", "left").fillna(0, ["k"])
    frequency = F.col("k") / F.lit(max(samples, 1))
    held = held.where(frequency.between(min_af, max_af))
    dictionary = variant_dictionary(held)
    counted = held.join(dictionary, "variant")
    rows = packed.join(counted, "variant").select("variant_id", "k", "block", "at")
    nobody = counted.where("k = 0").select(
        "variant_id", "k", F.lit(0).alias("block"), F.array().cast("array<int>").alias("at")
    )
    if permuted is None:
        store = store or PermutationStore(n_perms, seed, method, size.samples)
        values = grid.drawn_values(index, store.draws(index), size)
        blocks = list(range(n_perms // size.perms + 1))
    else:
        values = grid.given_values(index, permuted, size)
        places = permuted.select(F.floor(F.col("perm_id") / size.perms).cast("int").alias("p")).distinct()
        blocks = sorted(r["p"] for r in places.collect())
    cells = grid.cell_sums(rows.union(nobody), values, samples, dictionary.count(), blocks, size)
    cells = stage(cells, "cells")
    outcomes = cells.where("variant_id is null").groupBy("perm_id").agg(
        F.sum("seconds").alias("elapsed_seconds"), F.min("error").alias("error")
    )
    failed = outcomes.where("error is not null").select("perm_id")
    sums = cells.where("variant_id is not null").select("perm_id", "variant_id", "k", "t")
    return Scan(sums.join(failed, "perm_id", "left_anti"), dictionary, outcomes)


def phenotype_moments(pheno: DataFrame) -> Column:
    """Scalar struct of what no permutation changes: n, mean, centred sum of squares."""
    n = F.count("phenotype")
    return pheno.agg(
        F.struct(
            n.alias("n"), F.avg("phenotype").alias("mean"), (F.var_pop("phenotype") * n).alias("syy")
        ).alias("moments")
    ).scalar()


def association_statistics(
    sums: DataFrame, pheno: DataFrame, min_af: float = MIN_AF, max_af: float = MAX_AF
) -> DataFrame:
    """af, beta, its standard error, r² and the likelihood-ratio statistic from (perm_id, variant_id, k, t).

    Keeps variants inside the frequency band. One without variation, or one that fits the trait perfectly,
    gets NULL statistics and a note.
    """
    k, n, syy = F.col("k").cast("double"), F.col("m.n"), F.col("m.syy")
    terms = (
        sums.withColumn("m", phenotype_moments(pheno))
        .withColumns({"af": k / n, "sxx": k - k * k / n, "sxy": F.col("t") - k * F.col("m.mean")})
        .where(F.col("af").between(min_af, max_af))
    )
    sxx, sxy = F.col("sxx"), F.col("sxy")
    fitted = terms.select(
        "perm_id",
        "variant_id",
        "af",
        "sxx",
        F.try_divide(sxy, sxx).alias("slope"),
        F.try_divide(sxy * sxy, sxx * syy).alias("fit"),
        (syy - F.try_divide(sxy * sxy, sxx)).alias("rss"),
        n.alias("n"),
    )
    perfect = F.col("fit") >= 1.0 - 1e-12
    testable = F.col("fit").isNotNull() & ~perfect & (F.col("n") > 2)
    variance = F.greatest(F.col("rss"), F.lit(0.0)) / ((F.col("n") - 2) * F.col("sxx"))
    return fitted.select(
        "perm_id",
        "variant_id",
        "af",
        F.when(testable, F.col("slope")).alias("beta"),
        F.when(testable, F.sqrt(variance)).alias("beta_std_err"),
        F.when(testable, F.col("fit")).alias("variant_h2"),
        F.when(testable, -F.col("n") * F.log1p(-F.col("fit"))).alias("lrt_stat"),
        F.when(F.col("fit").isNull() | (F.col("n") <= 2), "pre-filtering-failed")
        .when(perfect, "perfectly-separable-data")
        .otherwise("")
        .alias("notes"),
    )


def association_scan(
    presence: DataFrame,
    pheno: DataFrame,
    n_perms: int,
    seed: int = DEFAULT_SEED,
    permuted: DataFrame | None = None,
    variants: DataFrame | None = None,
    min_af: float = MIN_AF,
    max_af: float = MAX_AF,
    method: str = KEYED,
) -> DataFrame:
    """Statistics of every (permutation, variant); permutation 0 is the observed trait.

    ``method`` says how permutations are drawn, unless a table of ``permuted`` phenotypes is given: ``KEYED`` in md5
    order, for any number of samples; ``NUMPY`` as numpy's generator does, for at most ``VECTOR_SAMPLES``
    samples (more are an error). Variants nobody carries take part when ``variants`` lists them. See :func:`scan_sums`.
    """
    scan = scan_sums(presence, pheno, n_perms, seed, permuted, variants, min_af, max_af, method)
    statistics = association_statistics(scan.sums, pheno, min_af, max_af)
    return statistics.join(scan.variants, "variant_id").drop("variant_id")


def result_rows(statistics: DataFrame, prefix: str = "perm") -> DataFrame:
    """Statistics as typed result rows, rounded to the three digits that result files carry.

    ``lrt_pvalue`` is the likelihood-ratio test, ``filter_pvalue`` a Wald test by normal approximation,
    and ``variant_h2`` the share of variance explained. Variants appear as the statistics have them, by name or id.
    """
    z = F.try_divide(F.col("beta"), F.col("beta_std_err"))
    full = statistics.withColumns(
        {"lrt_pvalue": chi2_tail(F.col("lrt_stat")), "filter_pvalue": chi2_tail(z * z)}
    )
    rounded = [three_digits(F.col(c)).try_cast("double").cast("float").alias(c) for c in NUMERIC_COLUMNS]
    typed = {c: r for c, r in zip(NUMERIC_COLUMNS, rounded)}
    named = "variant" if "variant" in statistics.columns else "variant_id"
    return full.select(
        perm_name(F.col("perm_id"), prefix).alias("source_file"),
        F.col("perm_id").cast("int").alias("perm_id"),
        *[typed.get(c, F.col(named if c == "variant" else c)) for c in RESULT_COLUMNS],
    )
