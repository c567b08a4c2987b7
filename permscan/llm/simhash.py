"""SimHash near-duplicates by a Gray-order hierarchical index."""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..staging import stage
from .common import shuffle_partitions
from .components import connected_components

BITS = 64
# Upper nodes with more fingerprints than this are divided further.
NODE_SIZE = 4096
LEAF = 16
PAIRS_AT_ONCE = 1 << 18


def _fingerprint(text: bytes, shingle: int) -> int:
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    width = min(shingle, len(words))
    count = len(words) - width + 1
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[:count].tolist(), ends[width - 1 :].tolist(), strict=True)
    hashes = np.array([digest(joined[s:e], 42) for s, e in spans], "<u8")
    ones = np.zeros(BITS, np.int64)
    for at in range(0, count, 1 << 16):
        part = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > count, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fingerprint)`` for every row; the fingerprint is the unsigned value's bits as a long.

    A-Z are lower-cased, words are runs of other bytes than space and ``\\t \\n \\v \\f \\r``, and shingles of
    ``shingle`` words count as often as they occur. A bit is set if it is set in over half of the shingles'
    XXH64 (seed 42). Fewer words make one shingle; a null, empty or blank text has fingerprint 0.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text")
    )

    def run(batches):
        for batch in batches:
            values = [_fingerprint(t.as_py(), shingle) for t in batch.column(1)]
            bits = np.array(values, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits)], ["doc_id", "fingerprint"])

    return rows.mapInArrow(run, "doc_id long, fingerprint long")


def with_fingerprints(docs: DataFrame, shingle: int = 3, text_col: str = "text") -> DataFrame:
    """``docs`` with every column and row, and the fingerprint of each as a long."""
    place = docs.columns.index(text_col)
    kinds = T.StructType([*docs.schema.fields, T.StructField("fingerprint", T.LongType())])

    def run(batches):
        for batch in batches:
            texts = batch.column(place).cast(pa.binary())
            bits = np.array([_fingerprint(t.as_py() or b"", shingle) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bits)], kinds.names)

    return docs.mapInArrow(run, kinds)


def gray_rank(bits: np.ndarray) -> np.ndarray:
    """Position of each 64-bit pattern in the Gray code sequence."""
    rank = bits.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def _components(count: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Least member of each vertex's component."""
    label = np.arange(count)
    while len(u):
        low, high = np.minimum(u, v), np.maximum(u, v)
        np.minimum.at(label, high, low)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
        u, v = label[u], label[v]
        apart = u != v
        u, v = u[apart], v[apart]
    return label


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


class _Index:
    """Hierarchy over fingerprints in Gray order: each node keeps the bits its members share and their pattern."""

    def __init__(self, bits: np.ndarray):
        self.levels = []
        every, some = bits, bits
        while len(every) > LEAF:
            cuts = np.arange(0, len(every), LEAF)
            every, some = np.bitwise_and.reduceat(every, cuts), np.bitwise_or.reduceat(some, cuts)
            self.levels.append((~(every ^ some), every))

    def pairs(self, bits: np.ndarray, most: int, merged):
        """Yield ``(i, j)`` arrays of links at ``most`` differing bits or fewer; ``merged(level)`` gives, for each
        node, the one component that all its members already belong to, or -1."""
        top = len(self.levels)
        count = len(self.levels[-1][0]) if top else len(bits)
        i, j = np.triu_indices(count)
        stack = [(top, i, j)]
        while stack:
            level, i, j = stack.pop()
            # Few enough at a time that their children are as many as are held at once.
            most_pairs = PAIRS_AT_ONCE // (LEAF * LEAF if level else 1)
            if len(i) > most_pairs:
                stack.append((level, i[most_pairs:], j[most_pairs:]))
                i, j = i[:most_pairs], j[:most_pairs]
            if level == 0:
                near = (i < j) & (_distance(bits[i], bits[j]) <= most)
                yield i[near], j[near]
                continue
            mask, pattern = self.levels[level - 1]
            whole = merged(level)
            apart = np.bitwise_count((pattern[i] ^ pattern[j]) & mask[i] & mask[j])
            open_ = (apart <= most) & ((whole[i] != whole[j]) | (whole[i] < 0))
            i, j = i[open_], j[open_]
            if not len(i):
                continue
            below = len(self.levels[level - 2][0]) if level > 1 else len(bits)
            a = (i[:, None] * LEAF + np.arange(LEAF))[:, :, None]
            b = (j[:, None] * LEAF + np.arange(LEAF))[:, None, :]
            a, b = (x.ravel() for x in np.broadcast_arrays(a, b))
            fits = (a < below) & (b < below) & (a <= b)
            stack.append((level - 1, a[fits], b[fits]))


def _link(bits: np.ndarray, most: int) -> np.ndarray:
    """Component labels within one node whose distinct fingerprints come in Gray order."""
    count = len(bits)
    label = np.arange(count)
    near = _distance(bits[1:], bits[:-1]) <= most
    label = _components(count, np.flatnonzero(near), np.flatnonzero(near) + 1)
    index = _Index(bits)

    def merged(level):
        cuts = np.arange(0, count, LEAF**level)
        low = np.minimum.reduceat(label, cuts)
        return np.where(low == np.maximum.reduceat(label, cuts), low, -1)

    for i, j in index.pairs(bits, most, merged):
        i, j = label[i], label[j]
        new = i != j
        if new.any():
            label = _components(count, i[new], j[new])[label]
    return label


def _small_links(group: np.ndarray, bits: np.ndarray, most: int, widest: int) -> tuple:
    """Links inside runs of equal ``group`` no longer than ``widest``."""
    found_i, found_j = [], []
    i = np.arange(len(bits))
    for step in range(1, widest):
        i = i[i + step < len(bits)]
        i = i[group[i] == group[i + step]]
        if not len(i):
            break
        near = _distance(bits[i], bits[i + step]) <= most
        found_i.append(i[near])
        found_j.append(i[near] + step)
    empty = np.zeros(0, np.int64)
    return np.concatenate([empty, *found_i]), np.concatenate([empty, *found_j])


def _forest(group: np.ndarray, bits: np.ndarray, most: int) -> tuple:
    """Edges of a spanning forest of the links inside each run of equal ``group``."""
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    sizes = np.diff(np.append(starts, len(bits)))
    large = sizes > 4 * LEAF
    in_small = np.repeat(~large, sizes)
    label = np.arange(len(bits))
    i, j = _small_links(group[in_small], bits[in_small], most, 4 * LEAF)
    at = np.flatnonzero(in_small)
    label[at] = at[_components(len(at), i, j)]
    for start, size in zip(starts[large], sizes[large], strict=True):
        label[start : start + size] = start + _link(bits[start : start + size], most)
    child = np.flatnonzero(label != np.arange(len(bits)))
    return bits[child], bits[label[child]]


def _divide(free: list[int], parts: int) -> list[list[int]]:
    """Cut the bit positions into ``parts`` runs of nearly equal length."""
    return [list(map(int, run)) for run in np.array_split(free, parts)]


def _masks(most: int, depth: int) -> dict[tuple, int]:
    """Path → the bits on which a node's members agree. Two patterns that differ in at most ``most`` of the free
    bits agree on all of one of ``most + 1`` parts of them, at every level."""
    masks, level = {(): 0}, {(): list(range(BITS))}
    for _ in range(depth):
        below = {}
        for path, free in level.items():
            for k, part in enumerate(_divide(free, most + 1)):
                masks[(*path, k)] = masks[path] | sum(1 << b for b in part)
                below[(*path, k)] = [b for b in free if b not in part]
        level = below
    return masks


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _children(rows: DataFrame, masks: dict, parents: list[tuple], most: int) -> DataFrame:
    """One row per fingerprint and child node of its node."""
    numbers = {path: n for n, path in enumerate(masks)}
    bits = F.col("fingerprint")

    def nodes(path) -> Column:
        return F.array(
            *[
                F.struct(
                    F.lit(numbers[(*path, k)]).alias("path"),
                    bits.bitwiseAND(F.lit(_signed(masks[(*path, k)])).cast("long")).alias("pattern"),
                )
                for k in range(most + 1)
            ]
        )

    by_path = None
    for path in parents:
        here = F.col("path") == numbers[path]
        by_path = F.when(here, nodes(path)) if by_path is None else by_path.when(here, nodes(path))
    return rows.withColumn("node", F.explode(by_path)).select("fingerprint", "node.path", "node.pattern")


def forest_edges(distinct: DataFrame, most: int = 3, node_size: int = NODE_SIZE, depth: int = 3) -> DataFrame:
    """Spanning edges ``(u, v)`` between distinct fingerprints, per upper node, that connect whatever differs in
    ``most`` bits or fewer.

    Upper nodes of the index are keys of a shuffle: a masked bit pattern that all members share. A node with
    over ``node_size`` members hands them to its children, which share more bits. Each final node is searched in
    its task: members in Gray order, factored into a hierarchy of shared patterns whose pairs of groups are
    dropped once their shared bits differ too much or once both lie in one component. A task emits fewer edges
    than it has members.
    """
    spark = distinct.sparkSession
    masks = _masks(most, depth)
    paths = {d: [p for p in masks if len(p) == d] for d in range(depth + 1)}
    rows = _children(distinct.select("fingerprint", F.lit(0).alias("path")), masks, paths[0], most)
    final = []
    for level in range(1, depth):
        sizes = rows.groupBy("path", "pattern").agg(F.count(F.lit(1)).alias("members"))
        heavy = stage(sizes.where(F.col("members") > node_size).drop("members"), "heavy")
        final.append(rows.join(heavy, ["path", "pattern"], "left_anti"))
        rows = _children(rows.join(heavy, ["path", "pattern"], "left_semi"), masks, paths[level], most)
    nodes = rows
    for part in final:
        nodes = nodes.unionByName(part)

    def run(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            path = held.column("path").to_numpy()
            pattern = held.column("pattern").to_numpy()
            last = np.flatnonzero((path != path[-1]) | (pattern != pattern[-1]))
            cut = last[-1] + 1 if len(last) else 0
            if cut:
                yield search(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None and held.num_rows:
            yield search(held)

    def search(table):
        path, pattern = table.column("path").to_numpy(), table.column("pattern").to_numpy()
        new = np.concatenate([[True], (path[1:] != path[:-1]) | (pattern[1:] != pattern[:-1])])
        group = np.cumsum(new)
        bits = table.column("fingerprint").to_numpy().view(np.uint64)
        order = np.lexsort((gray_rank(bits), group))
        u, v = _forest(group[order], bits[order], most)
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

    placed = nodes.repartition(shuffle_partitions(spark), "path", "pattern").sortWithinPartitions("path", "pattern")
    return placed.mapInArrow(run, "u long, v long")


def _roots(distinct: DataFrame, most: int) -> DataFrame:
    """``distinct`` fingerprints, each with the one that names its component."""
    links = connected_components(forest_edges(distinct, most))
    return distinct.join(links.withColumnRenamed("u", "fingerprint"), "fingerprint", "left").withColumn(
        "root", F.coalesce("v", "fingerprint")
    )


def near_duplicates(
    docs: DataFrame, shingle: int = 3, most: int = 3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every row of ``docs``; other columns are not read.

    Two documents are linked if their fingerprints differ in ``most`` bits or fewer; ``component_id`` is the
    smallest doc_id reachable over links, the document's own included. Documents of equal fingerprint, blank ones
    too, are linked. Rows without a doc_id take part but name no component: it is null if no member has an id.
    Rows that repeat a doc_id come back as often. An empty table gives no rows.
    """
    rows = stage(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    distinct = stage(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id")), "distinct")
    named = _roots(distinct, most)
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = named.select("fingerprint", "root").join(least, "root").select("fingerprint", "component_id")
    return rows.join(classes, "fingerprint").select("doc_id", "fingerprint", "component_id")


def least_of_components(
    docs: DataFrame, order: list[str], shingle: int = 3, most: int = 3, text_col: str = "text"
) -> DataFrame:
    """One row of ``docs`` for each component of :func:`near_duplicates`, with all columns: the least by the columns
    ``order``, then by the others. A null in the first of them comes last, in the others first.

    The least row of every fingerprint is found before rows meet, so one that very many rows share is no hot group.
    """
    names = [*order, *[c for c in docs.columns if c not in order]]
    # Columns go by their places, so none can bear the name of one that is added.
    places = {c: f"_{n}" for n, c in enumerate(names)}
    rows = docs.select(*[F.col(f"`{c}`").alias(at) for c, at in places.items()])
    text = places[text_col]
    row = F.struct(F.col(places[names[0]]).isNull().alias("_none"), *places.values())
    marked = with_fingerprints(rows, shingle, text)
    prints = with_fingerprints(rows.select(text), shingle, text).select("fingerprint").distinct()
    named = _roots(stage(prints, "distinct"), most)
    least = marked.groupBy("fingerprint").agg(F.min(row).alias("row"))
    least = least.join(named.select("fingerprint", "root"), "fingerprint")
    least = least.groupBy("root").agg(F.min("row").alias("row"))
    return least.select(*[F.col(f"row.{places[c]}").alias(c) for c in docs.columns])


def fingerprint_hex(fingerprint: Column) -> Column:
    """16 lowercase hex digits of a fingerprint."""
    return F.lpad(F.lower(F.hex(fingerprint)), 16, "0")
