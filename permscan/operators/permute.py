"""Phenotype permutations, one table of (perm_id, sample, phenotype) instead of one file each."""

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import DEFAULT_SEED
from ..staging import stage
from .ordering import dense_index

# How permutations are drawn: in md5 order, for any number of samples, or as numpy does.
KEYED, NUMPY = "keyed", "numpy"

# Largest phenotype vector handed to every task: 2 million doubles, 16 MB.
VECTOR_SAMPLES = 2_000_000
# Rows of one permutation that may be ranked by one task.
RANK_ROWS = 100_000

_PERMUTED = "perm_id int, sample string, phenotype double"


class TooManySamples(ValueError):
    """The phenotype is too long to hand to every task; use the hash-keyed permutation."""


def phenotype_vector(pheno: DataFrame, order: str = "sample") -> pd.DataFrame:
    """Samples and values in ``order`` on the driver, after a check of their number."""
    rows = pheno.count()
    if rows > VECTOR_SAMPLES:
        raise TooManySamples(f"{rows} samples exceed {VECTOR_SAMPLES}; use keyed_permutations")
    return pheno.orderBy(order).select("sample", "phenotype").toPandas()


def shuffled(values: np.ndarray, seed: int, perm: int) -> np.ndarray:
    """Permutation ``perm`` of ``values``: every permutation has its own generator."""
    return np.random.default_rng(seed + perm).permutation(values)


def numpy_permutations(
    pheno: DataFrame, n_perms: int, seed: int = DEFAULT_SEED, order: str = "sample"
) -> DataFrame:
    """Permutations 1..n of the phenotype as numpy's generator with seed ``seed + i`` draws them.

    Needs the whole vector in each task, so its length is checked; permutations run in parallel.
    """
    spark = pheno.sparkSession
    vector = phenotype_vector(pheno, order)
    shared = spark.sparkContext.broadcast((vector["sample"].to_numpy(), vector["phenotype"].to_numpy()))
    slice_rows = 500_000

    def draw(batches):
        samples, values = shared.value
        for batch in batches:
            for perm in batch["id"]:
                drawn = shuffled(values, seed, int(perm))
                for at in range(0, len(drawn), slice_rows):
                    part = slice(at, at + slice_rows)
                    yield pd.DataFrame(
                        {"perm_id": np.int32(perm), "sample": samples[part], "phenotype": drawn[part]}
                    )

    return spark.range(1, n_perms + 1).mapInPandas(draw, _PERMUTED)


def keyed_sources(ordered: DataFrame, n_perms: int, seed: int = DEFAULT_SEED, rank_rows: int = RANK_ROWS) -> DataFrame:
    """(perm_id, pos, source, phenotype): the sample at ``source`` gives its value to the one at ``pos``.

    ``ordered`` is a staged table of samples with their place in text order. The i-th sample in that order
    receives the value of the i-th sample by md5(seed:perm:sample). md5 values are spread evenly, so their
    leading digits cut each permutation into groups of at most about ``rank_rows`` rows, and the group sizes give each
    group its offset.
    """
    digits = max(0, math.ceil(math.log(max(ordered.count(), 1) / rank_rows, 16)))
    perms = F.explode(F.sequence(F.lit(1), F.lit(n_perms))).alias("perm_id")
    text = F.concat_ws(":", F.lit(str(seed)), F.col("perm_id").cast("string"), F.col("sample"))
    keyed = (
        ordered.select(perms, "sample", "phenotype", "pos")
        .withColumn("key", F.md5(text))
        .withColumn("part", F.substring("key", 1, digits))
    )
    inside = Window.partitionBy("perm_id", "part").orderBy("key", "sample", "pos")
    place = (F.row_number().over(inside) - 1).alias("rank")
    ranked = keyed.select("perm_id", "part", "phenotype", F.col("pos").alias("source"), place)
    sizes = keyed.groupBy("perm_id", "part").agg(F.count(F.lit(1)).alias("rows"))
    earlier = Window.partitionBy("perm_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("perm_id", "part", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("offset"))
    return ranked.join(offsets, ["perm_id", "part"]).select(
        "perm_id", (F.col("rank") + F.col("offset")).alias("pos"), "source", "phenotype"
    )


def sample_index(pheno: DataFrame) -> DataFrame:
    """Staged ``(sample, phenotype, pos)``: every sample's place in text order."""
    return stage(dense_index(pheno.select("sample", "phenotype"), "sample", out="pos"), "samples")


def keyed_permutations(
    pheno: DataFrame, n_perms: int, seed: int = DEFAULT_SEED, rank_rows: int = RANK_ROWS
) -> DataFrame:
    """Permutations 1..n for any number of samples, drawn as :func:`keyed_sources` says."""
    if n_perms < 1:
        raise ValueError("At least one permutation is needed")
    ordered = sample_index(pheno)
    drawn = keyed_sources(ordered, n_perms, seed, rank_rows).select("perm_id", "pos", "phenotype")
    return drawn.join(ordered.select("sample", "pos"), "pos").select("perm_id", "sample", "phenotype")


class PermutationStore:
    """Draws of positions, made once for every set of samples and then shared by traits and variant types.

    A draw does not depend on the phenotype's values, only on the samples (``KEYED``) or their number (``NUMPY``).
    """

    def __init__(self, n_perms: int, seed: int = DEFAULT_SEED, method: str = KEYED, block: int = 1024):
        self.n_perms, self.seed, self.method, self.block = n_perms, seed, method, block
        self.tables: dict[tuple, DataFrame] = {}

    def draws(self, index: DataFrame) -> DataFrame:
        """Staged ``(perm_id, block, source)`` for the samples of ``index``; permutation 0 leaves them in place."""
        count = F.count(F.lit(1))
        mark = F.sum(F.xxhash64("sample", "pos").cast("decimal(38,0)"))
        seen = tuple(index.agg(count, mark).first())
        key = seen if self.method == KEYED else seen[:1]
        if key not in self.tables:
            self.tables[key] = stage(self._draw(index, seen[0]), "draws")
        return self.tables[key]

    def _draw(self, index: DataFrame, samples: int) -> DataFrame:
        spark = index.sparkSession
        if self.method == NUMPY:
            return spark.range(self.n_perms + 1).mapInArrow(
                _positions(samples, self.seed, self.block), "perm_id int, block int, source array<long>"
            )
        own = index.select(F.lit(0).alias("perm_id"), "pos", F.col("pos").alias("source"))
        if self.n_perms:
            drawn = keyed_sources(index, self.n_perms, self.seed)
            own = own.union(drawn.select("perm_id", "pos", "source"))
        blocks = own.groupBy("perm_id", F.floor(F.col("pos") / self.block).cast("int").alias("block"))
        placed = blocks.agg(F.sort_array(F.collect_list(F.struct("pos", "source"))).alias("placed"))
        return placed.select("perm_id", "block", F.col("placed.source").alias("source"))


def _positions(samples: int, seed: int, block: int):
    """Permutations of positions by numpy's generators, one at a time, cut into blocks of samples."""
    if samples > VECTOR_SAMPLES:
        raise TooManySamples(f"{samples} samples exceed {VECTOR_SAMPLES}; draw {KEYED} permutations")

    def draw(batches):
        for batch in batches:
            for perm in batch.column("id").to_pylist():
                source = np.arange(samples)
                if perm:
                    source = shuffled(source, seed, perm)
                ends = np.r_[np.arange(0, samples, block), samples].astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(ends) - 1, perm, np.int32)),
                        pa.array(np.arange(len(ends) - 1, dtype=np.int32)),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(source)),
                    ],
                    ["perm_id", "block", "source"],
                )

    return draw
