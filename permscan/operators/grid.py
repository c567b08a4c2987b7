"""Sums of permuted phenotypes over carriers as a blocked matrix product.

The product (variants × samples) · (samples × permutations) is cut into cells of a block of variants and a block of
permutations. Packed carriers go to every block of permutations and permuted values to every block of variants; both
meet in the cell, ordered by blocks of samples, and the task adds up one dense product per block of samples. No row
stands for a carrier of a permutation, and a task holds one cell's sums and one block of samples.
"""

import time
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..staging import stage


@dataclass(frozen=True)
class Blocks:
    """Sizes that bound what a task holds: a cell's sums and one dense product take 8 MB each."""

    # Samples of one packed row, variants and permutations of a cell, variants of one dense product.
    samples: int = 1024
    variants: int = 4096
    perms: int = 256
    dense: int = 1024


# Rows a task hands back at a time.
OUTPUT_ROWS = 500_000

_CELLS = "v int, p int, block int, kind int, id long, k long, at array<int>, y array<double>"
_SUMS = "perm_id int, variant_id int, k long, t double, seconds double, error string"
_OUT = pa.schema(
    [("perm_id", pa.int32()), ("variant_id", pa.int32()), ("k", pa.int64()), ("t", pa.float64()),
     ("seconds", pa.float64()), ("error", pa.string())]
)


def sample_blocks(values: DataFrame, size: Blocks) -> DataFrame:
    """``(perm_id, block, at, y)``: values of ``(perm_id, pos, phenotype)`` by blocks of samples, places within the block."""
    place = F.struct((F.col("pos") % size.samples).cast("int").alias("at"), F.col("phenotype").alias("y"))
    packed = values.groupBy("perm_id", F.floor(F.col("pos") / size.samples).cast("int").alias("block")).agg(
        F.sort_array(F.collect_list(place)).alias("places")
    )
    return packed.select("perm_id", "block", F.col("places.at").alias("at"), F.col("places.y").alias("y"))


def given_values(index: DataFrame, permuted: DataFrame, size: Blocks) -> DataFrame:
    """Blocks of a table ``(perm_id, sample, phenotype)`` of permuted phenotypes."""
    values = permuted.join(index.select("sample", "pos"), "sample").select("perm_id", "pos", "phenotype")
    return sample_blocks(values, size)


def drawn_values(index: DataFrame, draws: DataFrame, size: Blocks) -> DataFrame:
    """Blocks of the values that draws of positions ``(perm_id, block, source)`` put in the samples' places."""
    places = draws.select("perm_id", "block", F.posexplode("source").alias("at", "source"))
    values = places.join(index.select(F.col("pos").alias("source"), "phenotype"), "source")
    pos = F.col("block").cast("long") * size.samples + F.col("at")
    return sample_blocks(values.select("perm_id", pos.alias("pos"), "phenotype"), size)


def packed_carriers(carriers: DataFrame, index: DataFrame, size: Blocks) -> DataFrame:
    """``(variant, block, at)``: places of a variant's carriers, one row per block of samples."""
    placed = carriers.join(index.select("sample", "pos"), "sample")
    at = F.collect_list((F.col("pos") % size.samples).cast("int")).alias("at")
    return placed.groupBy("variant", F.floor(F.col("pos") / size.samples).cast("int").alias("block")).agg(at)


class _Lists:
    """Rows of an array column as numpy slices."""

    def __init__(self, column: pa.ListArray):
        self.offsets = column.offsets.to_numpy()
        self.values = column.values.to_numpy(zero_copy_only=False)

    def __getitem__(self, row: int) -> np.ndarray:
        return self.values[self.offsets[row] : self.offsets[row + 1]]


class _Cell:
    """Sums of one block of variants under one block of permutations."""

    def __init__(self, samples: int, size: Blocks):
        self.samples, self.size = samples, size
        self.perms: dict[int, int] = {}
        self.filled = np.zeros(0, np.int64)
        self.errors: dict[int, str] = {}
        self.broken = None
        self.block, self.y = None, None
        self.rows: dict[int, int] = {}
        self.k: list[int] = []
        self.sums = np.zeros((0, 0))
        self.seconds = 0.0

    def add_values(self, block: int, ids: np.ndarray, at: list[np.ndarray], y: list[np.ndarray]) -> None:
        """Values of one block of samples; rows for it may come in several parts."""
        for perm in ids:
            self.perms.setdefault(int(perm), len(self.perms))
        grown = len(self.perms) - len(self.filled)
        self.filled = np.r_[self.filled, np.zeros(grown, np.int64)]
        if block != self.block:
            self.block, self.y = block, np.zeros((self.size.samples, len(self.perms)))
        elif grown:
            self.y = np.column_stack([self.y, np.zeros((self.size.samples, grown))])
        for perm, places, values in zip(ids, at, y):
            column = self.perms[int(perm)]
            if not np.isfinite(values).all():
                self.errors.setdefault(int(perm), "missing or infinite phenotype value")
                values = np.zeros(len(values))
            if (np.diff(places) <= 0).any():
                self.errors.setdefault(int(perm), "more than one phenotype value for a sample")
            self.y[places, column] = values
            self.filled[column] += len(places)

    def add_carriers(self, block: int, ids: np.ndarray, k: np.ndarray, at: list[np.ndarray]) -> None:
        for start in range(0, len(ids), self.size.dense):
            part = range(start, min(start + self.size.dense, len(ids)))
            x = np.zeros((len(part), self.size.samples))
            for row, n in enumerate(part):
                x[row, at[n]] = 1.0
                if int(ids[n]) not in self.rows:
                    self.rows[int(ids[n])] = len(self.rows)
                    self.k.append(int(k[n]))
            wide, tall = len(self.perms), len(self.rows)
            if self.sums.shape != (tall, wide):
                sums = np.zeros((tall, wide))
                sums[: self.sums.shape[0], : self.sums.shape[1]] = self.sums
                self.sums = sums
            if block == self.block:
                self.sums[[self.rows[int(ids[n])] for n in part]] += x @ self.y

    def results(self):
        """Sums of the permutations without an error, and of every permutation the time and its error."""
        for perm, column in self.perms.items():
            if self.broken:
                self.errors[perm] = self.broken
            elif self.filled[column] != self.samples:
                text = f"{self.filled[column]} phenotype values for {self.samples} samples"
                self.errors.setdefault(perm, text)
        good = [perm for perm in self.perms if perm not in self.errors]
        columns = [self.perms[perm] for perm in good]
        variants, k = np.array(list(self.rows), np.int32), np.array(self.k, np.int64)
        step = max(1, OUTPUT_ROWS // max(1, len(good)))
        for start in range(0, len(variants) if good else 0, step):
            part = slice(start, start + step)
            size = len(variants[part])
            yield self._batch(
                perm_id=np.tile(np.array(good, np.int32), size),
                variant_id=np.repeat(variants[part], len(good)),
                k=np.repeat(k[part], len(good)),
                t=self.sums[part][:, columns].ravel(),
            )
        share = self.seconds / max(1, len(self.perms))
        yield self._batch(
            perm_id=np.array(list(self.perms), np.int32),
            seconds=np.full(len(self.perms), share),
            error=pa.array([self.errors.get(perm) for perm in self.perms], pa.string()),
        )

    @staticmethod
    def _batch(**columns) -> pa.RecordBatch:
        size = len(columns["perm_id"])
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type) for f in _OUT], schema=_OUT
        )


def _multiply(samples: int, size: Blocks):
    def run(batches):
        key, cell = None, None
        for batch in batches:
            heads = [batch.column(n).to_numpy() for n in ("v", "p", "block", "kind")]
            ids, k = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("id", "k"))
            at, y = _Lists(batch.column("at")), _Lists(batch.column("y"))
            fresh = np.any([h[1:] != h[:-1] for h in heads], axis=0)
            starts = [0, *(np.flatnonzero(fresh) + 1), batch.num_rows]
            for a, b in zip(starts[:-1], starts[1:]):
                v, p, block, kind = (int(h[a]) for h in heads)
                if (v, p) != key:
                    if cell:
                        yield from cell.results()
                    key, cell = (v, p), _Cell(samples, size)
                began = time.perf_counter()
                try:
                    if kind == 0:
                        cell.add_values(block, ids[a:b], [at[r] for r in range(a, b)], [y[r] for r in range(a, b)])
                    else:
                        cell.add_carriers(block, ids[a:b], k[a:b], [at[r] for r in range(a, b)])
                except (ArithmeticError, LookupError, MemoryError, TypeError, ValueError) as error:
                    # What one cell's values can cause; the other cells go on.
                    cell.broken = cell.broken or f"{type(error).__name__}: {error}"
                cell.seconds += time.perf_counter() - began
        if cell:
            yield from cell.results()

    return run


def cell_sums(
    packed: DataFrame, values: DataFrame, samples: int, variants: int, perm_blocks: list[int], size: Blocks
) -> DataFrame:
    """``(perm_id, variant_id, k, t, seconds, error)`` of all cells.

    ``packed`` has ``(variant_id, k, block, at)`` and ``values`` ``(perm_id, block, at, y)``. Rows with a variant carry a
    sum; rows without one tell, for a permutation in a cell, the time its share took and what was wrong with it. A
    permutation that has an error in a cell has no sums there.
    """

    def column(kind: str) -> Column:
        return F.lit(None).cast(kind)

    blocks = max(1, -(-variants // size.variants))
    left = packed.select(
        F.floor(F.col("variant_id") / size.variants).cast("int").alias("v"),
        F.explode(F.lit(perm_blocks).cast("array<int>")).alias("p"),
        "block", F.lit(1).alias("kind"), F.col("variant_id").cast("long").alias("id"), "k", "at",
        column("array<double>").alias("y"),
    )
    right = values.select(
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("v"),
        F.floor(F.col("perm_id") / size.perms).cast("int").alias("p"),
        "block", F.lit(0).alias("kind"), F.col("perm_id").cast("long").alias("id"), column("long").alias("k"), "at", "y",
    )
    cells = left.union(right).repartition("v", "p").sortWithinPartitions("v", "p", "block", "kind", "id")
    return cells.mapInArrow(_multiply(samples, size), _SUMS)
