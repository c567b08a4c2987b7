"""Conversation prefix trie: per-node figures from minimal-perfect-hash node tables over shards of conversations."""

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordering import CHUNK, chunk_offsets, running_total, with_chunks
from ..staging import stage
from .common import WORD, shuffle_partitions

# Turns that one task holds as flat arrays (about 150 bytes each). Longer conversations go on in the next shard.
SHARD_ROWS = 400_000
# Ids of a node's last turn that travel as one row to the task that hashes them.
IDS_A_BLOCK = 512

KEY = ["depth", "k1", "k2"]
NODES = (
    f"{CHUNK} int, kind int, unit int, depth long, k1 long, k2 long, p1 long, p2 long, "
    "convs long, least long, words long, tail long"
)


class SlotTable:
    """Minimal perfect hash over distinct keys of several unsigned 64-bit lanes, in levels of bit arrays.

    A level keeps the keys that have a cell of it to themselves and hands the others on; a key's slot is the number of
    kept cells before its own. The keys are stored by slot, and every answer is compared with them, so a foreign key,
    or one whose hash collides, is told apart and gets -1.
    """

    SPACE = 2

    def __init__(self, *lanes: np.ndarray):
        self.levels = []
        left = np.arange(len(lanes[0]))
        first = 0
        slots = np.empty(len(left), np.int64)
        while len(left):
            size = max(64, self.SPACE * len(left))
            cell = self._cell(lanes, left, len(self.levels), size)
            alone = np.bincount(cell, minlength=size) == 1
            before = np.cumsum(alone) - alone
            kept = alone[cell]
            slots[left[kept]] = first + before[cell[kept]]
            self.levels.append((size, alone, first + before))
            first += int(kept.sum())
            left = left[~kept]
        self.keys = tuple(np.empty_like(lane) for lane in lanes)
        for stored, lane in zip(self.keys, lanes):
            stored[slots] = lane
        self.size = first

    @staticmethod
    def _cell(lanes, rows, level, size):
        with np.errstate(over="ignore"):
            mixed = np.full(len(rows), 0x9E3779B97F4A7C15 * (level + 1) & (2**64 - 1), np.uint64)
            for lane in lanes:
                mixed = (mixed ^ lane[rows]) * np.uint64(0xBF58476D1CE4E5B9)
                mixed ^= mixed >> np.uint64(29)
                mixed *= np.uint64(0x94D049BB133111EB)
                mixed ^= mixed >> np.uint64(32)
        return (mixed % np.uint64(size)).astype(np.int64)

    def find(self, *lanes: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 for keys that are not in the table."""
        out = np.full(len(lanes[0]), -1, np.int64)
        left = np.arange(len(out))
        for level, (size, alone, before) in enumerate(self.levels):
            cell = self._cell(lanes, left, level, size)
            hit = alone[cell]
            out[left[hit]] = before[cell[hit]]
            left = left[~hit]
        found = out >= 0
        same = np.ones(int(found.sum()), bool)
        for stored, lane in zip(self.keys, lanes):
            same &= stored[out[found]] == lane[found]
        out[np.flatnonzero(found)[~same]] = -1
        return out


def _distinct(*lanes: np.ndarray) -> np.ndarray:
    """Index of one row of every distinct key."""
    order = np.lexsort(lanes[::-1])
    fresh = np.ones(len(order), bool)
    if len(order):
        fresh[1:] = np.any([lane[order][1:] != lane[order][:-1] for lane in lanes], axis=0)
    return order[fresh]


def _upward(depth: np.ndarray, parent: np.ndarray, sums: list[np.ndarray], least: np.ndarray | None = None) -> None:
    """Add (or take the least of) what every slot holds into its parent's slot, deepest nodes first."""
    order = np.argsort(-depth, kind="stable")
    edges = np.flatnonzero(np.diff(depth[order])) + 1
    for level in np.split(order, edges):
        level = level[parent[level] >= 0]
        for values in sums:
            np.add.at(values, parent[level], values[level])
        if least is not None:
            np.minimum.at(least, parent[level], least[level])


def _column(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def _lane(values: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(values, np.int64).view(np.uint64)


def _table(schema: pa.Schema, size: int, **columns) -> pa.Table:
    filled = []
    for field in schema:
        value = columns.get(field.name)
        if value is None or np.isscalar(value):
            value = pa.nulls(size, field.type) if value is None else pa.array(np.full(size, value), field.type)
        elif isinstance(value, np.ndarray):
            value = pa.array(value.view(np.int64) if value.dtype == np.uint64 else value).cast(field.type)
        filled.append(value)
    return pa.Table.from_arrays(filled, schema=schema)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64()}
    return pa.schema([(name, kinds[kind]) for name, kind in (part.split() for part in ddl.split(", "))])


def _shard_nodes(table: pa.Table) -> pa.Table:
    """One shard's turns → its nodes with members, least member and parent, and a row for every conversation's end.

    Rows of a conversation that began in an earlier shard form a trie of their own (``unit`` 1), which starts from
    the digest (``s1``, ``s2``) of what came before. ``tail`` names the conversation of the shard's last turn.
    """
    conv, depth = _column(table, "conv_id"), _column(table, "depth")
    order = np.lexsort((depth, conv))
    conv, depth = conv[order], depth[order]
    own = [_lane(_column(table, name)[order]) for name in ("f1", "f2")]
    starts = np.flatnonzero(np.r_[True, conv[1:] != conv[:-1]])
    lengths = np.diff(np.r_[starts, len(conv)])
    going_on = depth[0] > 0
    unit = np.zeros(len(conv), np.uint64)
    if going_on:
        unit[: lengths[0]] = 1
    keys = []
    for lane, seed in zip(own, ("s1", "s2")):
        run = np.bitwise_xor.accumulate(lane)
        before = np.repeat(run[starts] ^ lane[starts], lengths)
        if going_on:
            before[: lengths[0]] ^= _lane(table.column(seed)[:1].to_numpy())[0]
        keys.append(run ^ before)
    lanes = (unit, depth.astype(np.uint64), *keys)
    one = _distinct(*lanes)
    slots = SlotTable(*[lane[one] for lane in lanes])
    at = slots.find(*lanes)
    up = [keys[0] ^ own[0], keys[1] ^ own[1]]

    size = slots.size
    node_depth, words, parents = np.empty(size, np.int64), np.empty(size, np.int64), np.empty(size, np.int64)
    p = [np.empty(size, np.uint64) for _ in up]
    where = at[one]
    node_depth[where], words[where] = depth[one], _column(table, "words")[order][one]
    for stored, lane in zip(p, up):
        stored[where] = lane[one]
    above = slots.find(unit[one], (depth[one] - 1).astype(np.uint64), up[0][one], up[1][one])
    parents[where] = np.where(depth[one] > 0, above, -1)

    ends = at[starts + lengths - 1]
    members, least = np.zeros(size, np.int64), np.full(size, np.iinfo(np.int64).max)
    np.add.at(members, ends, 1)
    np.minimum.at(least, ends, conv[starts])
    _upward(node_depth, parents, [members], least)

    chunk = table.column(CHUNK)[0].as_py()
    tail = pa.array(np.full(size, conv[-1]), pa.int64(), mask=np.arange(size) != at[-1])
    schema = _arrow(NODES)
    nodes = _table(
        schema, size, **{CHUNK: chunk}, kind=0, unit=slots.keys[0], depth=node_depth, k1=slots.keys[2], k2=slots.keys[3],
        p1=p[0], p2=p[1], convs=members, least=least, words=words, tail=tail,
    )
    last = np.flatnonzero(table.column("last").to_numpy(zero_copy_only=False)[order])
    closing = _table(
        schema, len(last), **{CHUNK: chunk}, kind=1, depth=depth[last], k1=keys[0][last], k2=keys[1][last], least=conv[last]
    )
    return pa.concat_tables([nodes, closing])


SUMS = "depth long, k1 long, k2 long, leaves long, saved long"


def _shard_sums(table: pa.Table) -> pa.Table:
    """One shard's nodes → what the subtree of each holds of the nodes that count here."""
    unit, depth = _column(table, "unit").astype(np.uint64), _column(table, "depth")
    keys = [_lane(_column(table, name)) for name in ("k1", "k2")]
    up = [_lane(_column(table, name)) for name in ("p1", "p2")]
    slots = SlotTable(unit, depth.astype(np.uint64), *keys)
    at = slots.find(unit, depth.astype(np.uint64), *keys)
    parents, node_depth = np.empty(slots.size, np.int64), np.empty(slots.size, np.int64)
    above = slots.find(unit, (depth - 1).astype(np.uint64), *up)
    parents[at], node_depth[at] = np.where(depth > 0, above, -1), depth
    sums = []
    for name in ("leaves", "saved"):
        values = np.zeros(slots.size, np.int64)
        values[at] = _column(table, name) + _column(table, f"later_{name}")
        sums.append(values)
    _upward(node_depth, parents, sums)
    return _table(
        _arrow(SUMS), slots.size, depth=node_depth, k1=slots.keys[2], k2=slots.keys[3], leaves=sums[0], saved=sums[1]
    )


def _numbered(conversations: DataFrame, partitions: int) -> DataFrame:
    """``(conv_id, pos, c1, c2, words)``: place of each turn in its conversation, from 1, and digests of its content."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.xxhash64(role, text).alias("c1"),
        F.xxhash64(F.lit(1), text, role).alias("c2"),
        F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).cast("long").alias("words"),
        F.lit(1).cast("long").alias("one"),
    )
    order = ("turn", "c1", "c2")
    chunked = with_chunks(turns, "conv_id", *order, partitions=partitions)
    offsets = chunk_offsets(chunked, "one", by=("conv_id",))
    placed = running_total(chunked, offsets, "one", order, "pos", by=("conv_id",))
    return stage(placed.select("conv_id", "pos", "c1", "c2", "words"), "turns")


def rebuilt(turns: DataFrame, family: int = 20, most: int = 4) -> DataFrame:
    """``(conv_id, depth, c1, c2, words, last)`` of every rebuilt conversation: a root row of depth 0, then its turns.

    Conversation c takes its first h turns, h = crc32(c) modulo ``most``, from the conversation that ``family`` puts
    at its head. Its own first h turns go.
    """
    sizes = turns.groupBy("conv_id").agg(F.max("pos").alias("n"))
    sizes = stage(sizes, "sizes")
    lenders = sizes.select(F.col("conv_id").alias("lender"), F.col("n").alias("lent"))
    heads = sizes.withColumn("h", F.crc32(F.col("conv_id").cast("string")) % most)
    heads = heads.withColumn("lender", F.col("conv_id") - F.col("conv_id") % family).join(lenders, "lender", "left")
    given = F.least("h", F.coalesce("lent", F.lit(0).cast("long")))
    heads = heads.select(
        "conv_id", "lender", "h", given.alias("given"), (given + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("total")
    )
    heads = stage(heads, "heads")

    digests = ["c1", "c2", "words"]
    depth = F.col("pos") - F.col("h") + F.col("given")
    kept = turns.join(heads.drop("lender"), "conv_id").where("pos > h")
    kept = kept.select("conv_id", depth.alias("depth"), *digests, (depth == F.col("total")).alias("last"))
    first = turns.where(F.col("pos") < most).withColumnRenamed("conv_id", "lender")
    lent = heads.join(first, "lender").where("pos <= h")
    lent = lent.select("conv_id", F.col("pos").alias("depth"), *digests, (F.col("pos") == F.col("total")).alias("last"))
    zero = F.lit(0).cast("long")
    roots = heads.select("conv_id", zero.alias("depth"), *[zero.alias(c) for c in digests], (F.col("total") == 0).alias("last"))
    return roots.union(lent).union(kept)


def _hash_blocks(batches):
    """Sorted ``(depth, k1, k2, conv_id)`` → joined ids of neighbouring rows of a node, ``IDS_A_BLOCK`` at most."""
    schema = pa.schema([("depth", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("first", pa.int64()), ("ids", pa.string())])
    for batch in batches:
        key = [batch.column(i).to_numpy() for i in range(3)]
        ids = batch.column(3)
        fresh = np.ones(len(ids), bool)
        fresh[1:] = np.any([k[1:] != k[:-1] for k in key], axis=0)
        starts = np.flatnonzero(fresh)
        cuts = np.concatenate([np.arange(a, b, IDS_A_BLOCK) for a, b in zip(starts, np.r_[starts[1:], len(ids)])] or [starts])
        lists = pa.ListArray.from_arrays(pa.array(np.r_[cuts, len(ids)], pa.int32()), ids.cast(pa.string()))
        picked = pa.array(cuts)
        columns = [batch.column(i).take(picked) for i in range(3)] + [ids.take(picked), pc.binary_join(lists, ",")]
        yield pa.RecordBatch.from_arrays(columns, schema=schema)


def _hash_nodes(batches):
    """Blocks sorted by node and first id → SHA-256 of each node's ids; only the running hash is kept."""
    schema = pa.schema([("depth", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("sha", pa.string())])
    node, running = None, None
    for batch in batches:
        done = []
        keys = zip(*[batch.column(i).to_pylist() for i in range(3)])
        for key, ids in zip(keys, batch.column("ids")):
            if key == node:
                running.update(b",")
            else:
                if node is not None:
                    done.append((*node, running.hexdigest()))
                node, running = key, hashlib.sha256()
            running.update(ids.as_buffer())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)
    if node is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((*node, running.hexdigest()), schema)], schema=schema)


def _end_hashes(ends: DataFrame, partitions: int) -> DataFrame:
    order = [*KEY, "conv_id"]
    ranged = ends.repartitionByRange(partitions, *order).sortWithinPartitions(*order)
    blocks = ranged.mapInArrow(_hash_blocks, "depth long, k1 long, k2 long, first long, ids string")
    dealt = blocks.repartition(partitions, *KEY).sortWithinPartitions(*KEY, "first")
    return dealt.mapInArrow(_hash_nodes, "depth long, k1 long, k2 long, sha string")


def _later(counted: DataFrame) -> DataFrame:
    """``(_chunk, later_leaves, later_saved)``: what conversations cut at the end of a shard hold in later shards."""
    ahead = counted.where("unit = 1").select(F.col("member").alias("conv"), CHUNK, "leaves", "saved")
    zero = F.lit(0).cast("long")
    tails = counted.where("tail is not null").select(F.col("tail").alias("conv"), CHUNK, zero, zero)
    per_shard = ahead.union(tails).groupBy("conv", CHUNK).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    after = Window.partitionBy("conv").orderBy(F.desc(CHUNK)).rowsBetween(Window.unboundedPreceding, -1)
    summed = per_shard.select(
        "conv", CHUNK, F.sum("leaves").over(after).alias("later_leaves"), F.sum("saved").over(after).alias("later_saved")
    )
    return summed.join(tails.select("conv", CHUNK), ["conv", CHUNK]).drop("conv")


def prefix_trie(conversations: DataFrame, family: int = 20, most: int = 4, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per node of the trie of rebuilt conversations, see :func:`rebuilt`.

    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``,
    ``saved_tokens`` (words that need not be read again, over the subtree), ``ends_sha256`` (of the decimal ids of the
    conversations that end here, ascending, joined by commas).

    A node is known by its depth and 128 bits, the exclusive-or of 64-bit hashes of (depth, role, text), so prefixes of
    any length are a running sum. Turns are cut into ranges of (conversation, depth) of ``shard_rows`` rows at most on average; a
    conversation longer than that goes on in the next one. Every shard numbers its distinct digests by a
    minimal perfect hash, scatters counts into flat arrays and adds them up through the array of parents' slots, deepest first.
    Sums of the shards then meet by digest, with partial sums. In a second pass every node counts in the one shard that
    holds its smallest member, so subtree sums add up too.

    Rows without a conv_id belong to no conversation and take no part. Equal turns numbers of a conversation come in
    the order of the hashes of their content; repeated rows are turns of their own. Null roles and texts are empty. Other
    columns are ignored. An empty table has no nodes, not even a root.
    """
    spark = conversations.sparkSession
    columns = conversations.select("conv_id", "turn", "role", "text")
    partitions = max(shuffle_partitions(spark), -(-columns.count() // shard_rows))
    paths = rebuilt(_numbered(columns, partitions), family, most)
    content = [F.col("depth"), F.col("c1"), F.col("c2")]
    paths = paths.select(
        "conv_id", "depth", "words", "last",
        F.when(F.col("depth") > 0, F.xxhash64(*content)).otherwise(F.lit(0)).alias("f1"),
        F.when(F.col("depth") > 0, F.xxhash64(F.lit(1), *content)).otherwise(F.lit(0)).alias("f2"),
    )
    shards = with_chunks(paths, "conv_id", "depth", partitions=partitions)

    parts = shards.groupBy("conv_id", CHUNK).agg(
        F.min("depth").alias("from"), F.bit_xor("f1").alias("x1"), F.bit_xor("f2").alias("x2")
    )
    before = Window.partitionBy("conv_id").orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    seeds = parts.select(CHUNK, "from", F.bit_xor("x1").over(before).alias("s1"), F.bit_xor("x2").over(before).alias("s2"))
    seeded = shards.join(seeds.where("from > 0").drop("from"), CHUNK, "left")
    local = stage(seeded.groupBy(CHUNK).applyInArrow(_shard_nodes, NODES), "shard-nodes")

    found = local.where("kind = 0")
    nodes = found.groupBy(*KEY).agg(
        F.sum("convs").alias("n_convs"), F.min("least").alias("conv_id"), F.max("words").alias("words"),
        F.max("p1").alias("p1"), F.max("p2").alias("p2"),
    )
    nodes = stage(nodes, "nodes")
    above = [(F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")]
    below = nodes.where("depth > 0").groupBy(*above).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(below, KEY, "left").fillna(0, ["n_children"])
    nodes = stage(nodes, "nodes")

    here = F.col("member") == F.col("conv_id")
    counted = found.select(CHUNK, "unit", *KEY, F.col("least").alias("member"), "tail")
    counted = counted.join(nodes, KEY).select(
        CHUNK, "unit", *KEY, "p1", "p2", "member", "tail",
        (here & (F.col("n_children") == 0)).cast("long").alias("leaves"),
        F.when(here, (F.col("n_convs") - 1) * F.col("words")).otherwise(F.lit(0)).alias("saved"),
    )
    counted = stage(counted, "counted")
    laters = [F.when(F.col("tail").isNotNull(), F.col(c)).alias(c) for c in ("later_leaves", "later_saved")]
    joined = counted.join(_later(counted), CHUNK, "left").select(*counted.columns, *laters)
    joined = joined.fillna(0, ["later_leaves", "later_saved"]).drop("member", "tail")
    sums = joined.groupBy(CHUNK).applyInArrow(_shard_sums, SUMS)

    hashes = _end_hashes(local.where("kind = 1").select(*KEY, F.col("least").alias("conv_id")), partitions)
    # One shuffle brings a node's figures together.
    parts = nodes.select(*KEY, "p1", "p2", "conv_id", "n_convs", "n_children").unionByName(sums, True).unionByName(hashes, True)
    whole = parts.groupBy(*KEY).agg(
        *[F.max(c).alias(c) for c in ("p1", "p2", "conv_id", "n_convs", "n_children", "sha")],
        F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"),
    )
    below = [(F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2")]
    parents = nodes.select(*below, F.col("conv_id").alias("parent_conv_id"))
    return whole.join(parents, ["depth", "p1", "p2"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("sha", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )
