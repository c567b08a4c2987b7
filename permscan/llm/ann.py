"""Approximate nearest neighbours by a hash-prefix forest."""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import stage
from .common import shuffle_partitions

TREES = 16
HASH_BITS = 64
# Vectors, on average, that share the shortest prefix to which a search ascends: so many up to twice as many.
LEAF = 4096
# A search stops ascending once so many candidates have been met, over all trees.
CANDIDATES = 65536
# Expected share of a query's neighbours that no tree may bring at the prefix where a search stops.
MISSED = 0.05
SEED = 11
BLOCK = 256
# Levels of ascent at most, and members of a bucket that one task holds.
LEVELS = 8
CHUNK = 4 * LEAF


def _planes(tree: int, size: int, seed: int) -> np.ndarray:
    return np.random.default_rng((seed, tree)).standard_normal((size, HASH_BITS))


def _hashes(vectors: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """Hash strings of 64 bits, first bit highest."""
    bits = vectors @ _planes(tree, vectors.shape[1], seed) > 0
    return np.packbits(bits, axis=1).view(">u8")[:, 0].astype(np.uint64)


def _matrix(column: pa.ChunkedArray | pa.Array, size: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), np.float64).reshape(-1, size)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``(id, vector)``, one row per id, without vectors that are null, zero or hold a null or non-finite component."""
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    zero = ~F.exists("vector", lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"))
    rows = rows.where(F.col("id").isNotNull() & F.col("vector").isNotNull()).where(~bad & ~zero)
    return rows.groupBy("id").agg(F.min("vector").alias("vector"))


def _hashed(entries: DataFrame, size: int, trees: int, bits: int, seed: int) -> DataFrame:
    """One row per entry and tree, with the hash string and its first bits, the bucket."""

    def run(batches):
        for batch in batches:
            matrix = _matrix(batch.column("vector"), size)
            matrix = matrix / np.linalg.norm(matrix, axis=1, keepdims=True)
            for tree in range(trees):
                value = _hashes(matrix, tree, seed)
                bucket = np.zeros(len(value), np.int64)
                if bits:
                    bucket = (value >> np.uint64(HASH_BITS - bits)).astype(np.int64)
                first = [pa.array(np.full(len(value), tree, np.int32)), pa.array(bucket), pa.array(value.view(np.int64))]
                yield pa.RecordBatch.from_arrays(
                    [*first, *batch.columns], ["tree", "bucket", "hash", *batch.schema.names]
                )

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in entries.schema)
    return entries.mapInArrow(run, f"tree int, bucket long, hash long, {kinds}")


def _ranges(hashes: np.ndarray, of: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Where, in the sorted array, the hashes lie that share ``level`` first bits with each of ``of``."""
    if level == 0:
        return np.zeros(len(of), np.int64), np.full(len(of), len(hashes))
    low_bits = np.uint64(HASH_BITS - level)
    low = (of >> low_bits) << low_bits
    high = low | ((np.uint64(1) << low_bits) - np.uint64(1))
    return np.searchsorted(hashes, low, "left"), np.searchsorted(hashes, high, "right")


def _descend(bits: int, deepest: int):
    """Part of a tree's bucket → for each query, how many hashes share each length of prefix from ``bits`` on."""

    def run(table: pa.Table, asked: pa.Table) -> pa.Table:
        hashes = np.sort(table.column("hash").to_numpy().view(np.uint64))
        of = asked.column("hash").to_numpy().view(np.uint64)
        spans = [_ranges(hashes, of, x) for x in range(bits, deepest + 1)]
        met = np.stack([high - low for low, high in spans], axis=1)
        number = np.repeat(asked.column("number").to_numpy(), len(spans))
        levels = np.tile(np.arange(bits, deepest + 1, dtype=np.int32), len(of))
        return pa.table({"number": number, "level": levels, "met": met.ravel().astype(np.int64)})

    return run


def _collect(size: int, k: int):
    """Part of a tree's bucket and queries with their levels → the best ``k`` of those that share the prefix."""

    def run(table: pa.Table, asked: pa.Table) -> pa.Table:
        out = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
        value = table.column("hash").to_numpy().view(np.uint64)
        order = np.argsort(value, kind="stable")
        hashes, number = value[order], table.column("number").to_numpy()[order]
        members = _matrix(table.column("vector"), size)[order]
        wanted = _matrix(asked.column("vector"), size)
        of, who = asked.column("hash").to_numpy().view(np.uint64), asked.column("number").to_numpy()
        level = asked.column("level").to_numpy()
        for x in np.unique(level):
            mine = np.flatnonzero(level == x)
            low, high = _ranges(hashes, of[mine], int(x))
            for start, end in np.unique(np.stack([low, high], axis=1), axis=0):
                same = mine[(low == start) & (high == end)] if end > start else mine[:0]
                for at in range(0, len(same), BLOCK):
                    rows = same[at : at + BLOCK]
                    _best(wanted[rows] @ members[start:end].T, who[rows], number[start:end], k, out)
        columns = [np.concatenate(c) for c in out]
        return pa.table(dict(zip(("query", "number", "score"), columns, strict=True)))

    return run


def _best(score: np.ndarray, rows: np.ndarray, members: np.ndarray, k: int, out: list) -> None:
    """All candidates that score no less than the k-th best of their query, ties included up to k by number."""
    if score.shape[1] > k:
        cut = -np.partition(-score, k - 1, axis=1)[:, k - 1 : k]
    else:
        cut = np.full((len(score), 1), -np.inf)
    row, column = np.nonzero(score >= cut)
    value, number = score[row, column], members[column]
    order = np.lexsort((number, -value, row))
    row, value, number = row[order], value[order], number[order]
    nth = np.arange(len(row)) - np.searchsorted(row, row)
    kept = nth < k
    out[0].append(rows[row[kept]])
    out[1].append(number[kept])
    out[2].append(value[kept])


def _length(vector: str) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda sum_, x: sum_ + x.cast("double") * x.cast("double")))


def _deepest(score: Column, length: Column, trees: int) -> Column:
    """Longest prefix at which a vector that scores no less than ``score`` shares it with the query in any tree with a
    probability of 1 - ``MISSED``, 0 without a score or below 0; ``length`` is that of the query times the greatest of all vectors.

    One hyperplane leaves two directions on one side with the probability 1 - angle / pi.
    """
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), score / length))
    alike = 1 - F.acos(cosine) / math.pi
    bits = F.floor(math.log(1 - MISSED ** (1 / trees)) / F.log(alike))
    # Spark's least and greatest pass over nulls; below 0 a short vector may lie at any angle.
    return F.when(score.isNull() | (score < 0), 0).when(alike >= 1, HASH_BITS - 1).otherwise(F.least(F.coalesce(bits, F.lit(0)), F.lit(HASH_BITS - 1))).cast("int")


def _nearest(found: DataFrame, entries: DataFrame, k: int) -> DataFrame:
    """``(number, best)``: for each query the ``k`` + 1 best ids, itself included, as ``(less, id)``."""
    # An entry met in several trees may differ in the last digit of its sum.
    found = found.groupBy("query", "number").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "number")
    found = found.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k + 1).drop("nth")
    ids = found.join(entries.select("number", "ids"), "number").select(
        "query", (-F.col("score")).alias("less"), F.explode("ids").alias("id")
    )
    best = ids.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("less", "id"))).alias("best"))
    return best.select(F.col("query").alias("number"), F.slice("best", 1, k + 1).alias("best"))


def search(
    vectors: DataFrame,
    queries: str,
    k: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    trees: int = TREES,
    leaf: int = LEAF,
    candidates: int = CANDIDATES,
    seed: int = SEED,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: up to ``k`` neighbours of largest inner product for each row of ``vectors``
    that satisfies the SQL condition ``queries`` on ``id``, among all others; ties go to the smaller id.

    Every tree sorts all vectors by a string of 64 bits, the sides of random hyperplanes on which a vector's
    direction lies. A search descends to the longest prefix that others share with the query in each tree, then ascends
    in all trees at once, a bit at a time, until ``candidates`` strings have been met over all trees or the prefix
    is as short as ``leaf`` to twice ``leaf`` vectors share on average. All vectors with that prefix in any tree are scored
    exactly, in double precision. The score of the last neighbour then tells how short a prefix must be for some tree
    to bring any better vector with a probability of 1 - ``MISSED``. Queries that stopped at a longer one search again
    there, or score all entries if it is shorter than a bucket's. The expected recall so does not fall as the table grows;
    on vectors without structure nearly all queries score all entries.

    Equal vectors are one entry of the index, so one that very many rows repeat makes no large bucket; only its
    ``k`` + 1 smallest ids can come into a result, and no others are kept. A bucket of more than ``CHUNK`` entries is cut
    into parts, each of which its queries visit. Vectors that are null or zero or hold a null or non-finite component, and
    rows without id, take no part. Rows that repeat an id count as one, with the least of their vectors. Vectors
    must have one length, else it is an error. Queries that meet fewer than ``k`` others score all entries, so only a table
    of fewer rows gives less; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = stage(usable(vectors, id_col, vector_col), "vectors")
    smallest = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    few = rows.withColumn("nth", smallest).where(F.col("nth") <= k + 1)
    entries = few.groupBy("vector").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    entries = stage(entries.withColumn("number", F.element_at("ids", 1)), "entries")
    asking = rows.where(F.expr(queries)).join(entries.select("vector", "number"), "vector")
    asking = stage(asking.select(F.col("id").alias("query_id"), "number"), "asking")
    count, size, greatest = entries.agg(F.count(F.lit(1)), F.max(F.size("vector")), F.max(_length("vector"))).first()
    if not count:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")

    bits = max(0, math.floor(math.log2(count / leaf)))
    members = _hashed(entries.select("number", "vector"), size, trees, bits, seed)
    askers = entries.join(asking.select("number").distinct(), "number", "left_semi")
    wanted = _hashed(askers.select("number", "vector"), size, trees, bits, seed)
    sizes = members.groupBy("tree", "bucket").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("parts"))
    sizes = stage(sizes, "buckets")
    key = ["tree", "bucket", "part"]
    groups = shuffle_partitions(spark)
    part = F.pmod(F.xxhash64("number"), F.col("parts")).cast("int")
    members = members.join(sizes, ["tree", "bucket"]).withColumn("part", part).drop("parts")
    wanted = wanted.join(sizes, ["tree", "bucket"])
    wanted = wanted.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")

    def together(left, right):
        return left.repartition(groups, *key).groupBy(*key).cogroup(right.repartition(groups, *key).groupBy(*key))

    light = [*key, "hash", "number"]
    met = together(members.select(light), wanted.select(light))
    met = met.applyInArrow(_descend(bits, min(HASH_BITS - 1, bits + LEVELS)), "number long, level int, met long")
    met = met.groupBy("number", "level").agg(F.sum("met").alias("met"))
    enough = F.max(F.when(F.col("met") >= candidates, F.col("level")))
    levels = met.groupBy("number").agg(F.coalesce(enough, F.lit(bits)).alias("level"))

    levels = stage(levels, "levels")

    collected = "query long, number long, score double"
    found = together(members, wanted.join(levels, "number"))
    found = stage(found.applyInArrow(_collect(size, k + 1), collected), "found")
    # The score of the last neighbour found bounds the angle of all that are better; where these may be missed, the
    # search goes on to the prefix that suffices, or to all entries if the buckets do not hold it.
    last = F.when(F.size("best") > k, -F.get("best", F.lit(k))["less"])
    bounds = askers.select("number", (_length("vector") * greatest).alias("length")).join(levels, "number")
    bounds = bounds.join(_nearest(found, entries, k), "number", "left")
    needed = _deepest(last, F.col("length"), trees)
    again = bounds.select("number", needed.alias("needed"), "level").where("needed < level")
    again = stage(again.select("number", F.col("needed").alias("level")), "again")
    near = together(members, wanted.join(again.where(F.col("level") >= bits), "number"))
    found = found.unionByName(near.applyInArrow(_collect(size, k + 1), collected))
    far = again.where(F.col("level") < bits).select("number")
    far_count = far.count()
    if far_count:
        # Every block of entries meets every block of queries.
        blocks, asked = math.ceil(count / CHUNK), math.ceil(far_count / CHUNK)
        same = [F.lit(0).alias("tree"), F.lit(0).cast("long").alias("hash")]

        def flat(rows):
            # Names of its own for each side, which Spark would otherwise take for one table.
            return rows.select(*same, F.col("number").alias("number"), F.col("vector").alias("vector"))

        def block(parts):
            return F.pmod(F.xxhash64("number"), F.lit(parts)).cast("int")

        def every(parts):
            return F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))

        left = flat(entries).withColumn("bucket", block(blocks)).withColumn("part", every(asked))
        right = flat(entries.join(far, "number", "left_semi")).withColumn("level", F.lit(0))
        right = right.withColumn("part", block(asked)).withColumn("bucket", every(blocks))
        found = found.unionByName(together(left, right).applyInArrow(_collect(size, k + 1), collected))
    best = _nearest(found, entries, k)
    joined = asking.join(best, "number")
    others = F.slice(F.filter("best", lambda b: b["id"] != F.col("query_id")), 1, k)
    out = joined.select("query_id", F.posexplode(others).alias("nth", "hit"))
    return out.select(
        "query_id",
        (F.col("nth") + 1).alias("rank"),
        F.col("hit.id").alias("vec_id"),
        (-F.col("hit.less")).alias("score"),
    )
