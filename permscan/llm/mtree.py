"""Exact largest inner products by best-first search in M-trees: paged metric nodes, covering radii, parent distances."""

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..staging import stage

# Distinct vectors that one tree holds, on average at most, queries that one task runs against it, and pivots.
TREE = 8192
QUERIES = 4096
PIVOTS = 1024
# Entries of an inner page are a power of two; objects of a leaf page, at most.
FAN_LEVELS = 4
LEAF = 128
# Distances are rounded; a bound holds with this share of the longest vector's length to spare.
SLACK = 1e-9
EXACT = 2.0**53
LONG = 2**63

PAGE = "shard long, page int, leaf boolean, child int, radius double, apart double, vector array<long>, ids array<long>"
FOUND = "query long, vec_id long, score long"


class _Space:
    """Integer vectors as points: a further component brings all to the same length, so near means large product.

    For a query q (further component 0) and a vector x, |q - x|² = |q|² + longest² - 2 q·x.
    """

    def __init__(self, size: int, longest: float, largest: float):
        self.size, self.square = size, longest
        # Beyond this, sums in doubles would round: products are made of Python's integers and no bound is used.
        self.exact = size * largest * largest < EXACT

    def matrix(self, column) -> np.ndarray:
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        lengths = np.diff(column.offsets.to_numpy())
        rows = np.repeat(np.arange(len(lengths)), lengths)
        places = np.arange(len(rows)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        out = np.zeros((len(lengths), max(1, self.size)), np.float64 if self.exact else object)
        out[rows, places] = column.flatten().to_numpy()
        return out

    def lift(self, matrix: np.ndarray) -> np.ndarray:
        """Points of indexed vectors."""
        matrix = matrix.astype(np.float64)
        rest = np.sqrt(np.maximum(0.0, self.square - np.einsum("ij,ij->i", matrix, matrix)))
        return np.column_stack([matrix, rest])


def _split(points: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two halves of the rows: the nearer half to one of two far points, and the rest."""
    own = points[rows]
    first = own[np.argmax(((own - own[0]) ** 2).sum(1))]
    to_first = ((own - first) ** 2).sum(1)
    second = own[np.argmax(to_first)]
    order = np.argsort(to_first - ((own - second) ** 2).sum(1), kind="stable")
    half = len(rows) // 2
    return rows[order[:half]], rows[order[half:]]


def _pages(points: np.ndarray):
    """Bulk load: ``(page, leaf, child, object, radius, distance to the page's own routing object)`` of every entry."""
    numbers = iter(range(len(points) * 2 + 1))

    def centre(rows):
        middle = points[rows].mean(0)
        return rows[np.argmin(((points[rows] - middle) ** 2).sum(1))]

    def away(rows, point):
        return np.sqrt(((points[rows] - points[point]) ** 2).sum(1))

    waiting = [(next(numbers), np.arange(len(points)), None)]
    while waiting:
        page, rows, above = waiting.pop()
        if len(rows) <= LEAF:
            apart = np.full(len(rows), np.nan) if above is None else away(rows, above)
            for row, far in zip(rows, apart):
                yield page, True, -1, row, 0.0, far
            continue
        parts = [rows]
        for _ in range(FAN_LEVELS):
            parts = [half for part in parts for half in (_split(points, part) if len(part) > LEAF else (part,))]
        for part in parts:
            child, middle = next(numbers), centre(part)
            far = np.nan if above is None else away(np.array([middle]), above)[0]
            yield page, False, child, middle, away(part, middle).max(), far
            waiting.append((child, part, middle))


def _build(space: _Space):
    def run(table: pa.Table) -> pa.Table:
        points = space.lift(space.matrix(table.column("vector")))
        page, leaf, child, row, radius, apart = zip(*_pages(points))
        row = pa.array(row, pa.int64())
        ids = table.column("ids").take(row).combine_chunks()
        ids = pa.ListArray.from_arrays(
            ids.offsets, ids.values, mask=pa.array([not x for x in leaf])
        ) if len(row) else ids
        return pa.table(
            {
                "shard": pa.array(np.full(len(row), table.column("shard")[0].as_py()), pa.int64()),
                "page": pa.array(page, pa.int32()),
                "leaf": pa.array(leaf),
                "child": pa.array(child, pa.int32()),
                "radius": pa.array(radius, pa.float64()),
                "apart": pa.array(apart, pa.float64()),
                "vector": table.column("vector").take(row).combine_chunks(),
                "ids": ids,
            }
        )

    return run


class _Tree:
    """Pages of one shard as flat arrays; page i is the rows ``first[i]`` to ``first[i + 1]``."""

    def __init__(self, table: pa.Table, space: _Space):
        table = table.take(pa.array(np.argsort(table.column("page").to_numpy(), kind="stable")))
        pages = table.column("page").to_numpy()
        self.space = space
        self.first = np.searchsorted(pages, np.arange(pages[-1] + 2))
        self.leaf = table.column("leaf").to_numpy(zero_copy_only=False)[self.first[:-1]]
        self.child = table.column("child").to_numpy()
        self.radius, self.apart = (table.column(name).to_numpy() for name in ("radius", "apart"))
        self.rows = space.matrix(table.column("vector"))
        ids = table.column("ids").combine_chunks()
        self.offsets, self.ids = ids.offsets.to_numpy(), ids.values.to_numpy()

    def search(self, query: np.ndarray, least: int | None, keep: int) -> list[tuple[int, int]]:
        """The ``keep`` largest ``(score, id)`` that reach ``least``, smaller ids first among equal scores."""
        space, best = self.space, []
        norm = float(np.dot(query, query))
        slack = SLACK * (1.0 + np.sqrt(norm) + np.sqrt(space.square))

        def distance(products):
            return np.sqrt(np.maximum(0.0, norm + space.square - 2.0 * products))

        def reach():
            if least is None or not space.exact:
                return np.inf
            return distance(float(least)) + slack

        bound = reach()
        queue = [(0.0, 0, None)]
        while queue:
            nearest, page, to_centre = heapq.heappop(queue)
            if nearest > bound:
                break
            rows = np.arange(self.first[page], self.first[page + 1])
            if to_centre is not None:
                # Triangle inequality over the stored distance to the page's centre: no product for what is too far.
                near = np.abs(to_centre - self.apart[rows]) - self.radius[rows] <= bound
                rows = rows[near]
            products = self.rows[rows] @ query
            if self.leaf[page]:
                if not space.exact:
                    products = np.array([max(-LONG, min(LONG - 1, x)) for x in products], object)
                if least is not None:
                    wanted = products >= least
                    rows, products = rows[wanted], products[wanted]
                if len(rows):
                    for row, score in zip(rows, products):
                        best += [(-int(score), int(i)) for i in self.ids[self.offsets[row] : self.offsets[row + 1]]]
                    best.sort()
                    del best[keep:]
                    if len(best) == keep and (least is None or -best[-1][0] > least):
                        least = -best[-1][0]
                        bound = reach()
                continue
            to_rows = distance(products.astype(np.float64))
            lower = np.maximum(0.0, to_rows - self.radius[rows])
            for row, low, far in zip(rows, lower, to_rows):
                if low <= bound:
                    heapq.heappush(queue, (low, int(self.child[row]), far))
        return [(-score, number) for score, number in best]


def _search(space: _Space, keep: int):
    def run(queries: pa.Table, pages: pa.Table) -> pa.Table:
        found = [], [], []
        if len(queries) and len(pages):
            tree = _Tree(pages, space)
            rows = space.matrix(queries.column("vector"))
            for key, row, least in zip(queries.column("query").to_pylist(), rows, queries.column("least").to_pylist()):
                for score, number in tree.search(row, least, keep):
                    found[0].append(key)
                    found[1].append(number)
                    found[2].append(score)
        return pa.table([pa.array(c, pa.int64()) for c in found], ["query", "vec_id", "score"])

    return run


def quantized(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64) -> DataFrame:
    """``(id, vector)`` with whole components, one row per id, without ids that are null and unusable vectors."""
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    rows = rows.where(F.col("id").isNotNull() & F.col("vector").isNotNull()).where(~bad)
    whole = F.transform("vector", lambda x: F.floor(x * scale))
    return rows.select("id", whole.alias("vector")).groupBy("id").agg(F.min("vector").alias("vector"))


def _assigned(entries: DataFrame, space: _Space, pivots: np.ndarray) -> DataFrame:
    """Adds the nearest pivot and the distance to it."""
    schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in entries.schema)}, pivot int, far double"
    shared = entries.sparkSession.sparkContext.broadcast(space.lift(pivots))

    def run(batches):
        centres = shared.value
        for batch in batches:
            points = space.lift(space.matrix(batch.column("vector")))
            products = points @ centres.T
            pivot = np.argmax(products, axis=1)
            far = np.sqrt(((points - centres[pivot]) ** 2).sum(1))
            columns = [*batch.columns, pa.array(pivot.astype(np.int32)), pa.array(far)]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "pivot", "far"])

    return entries.mapInArrow(run, schema)


def _open_pivots(queries: DataFrame, space: _Space, pivots: np.ndarray, radius: np.ndarray) -> DataFrame:
    """Every query with each pivot whose ball may hold a vector that reaches its bound."""
    schema = "query long, vector array<long>, least long, block long, home long, pivot int"
    shared = queries.sparkSession.sparkContext.broadcast((space.lift(pivots), pivots.astype(np.float64), radius))

    def run(batches):
        _, plain, radii = shared.value
        for batch in batches:
            rows = space.matrix(batch.column("vector"))
            for start in range(0, len(rows), 512):
                own = rows[start : start + 512].astype(np.float64)
                norm = np.einsum("ij,ij->i", own, own)[:, None] + space.square
                far = np.sqrt(np.maximum(0.0, norm - 2.0 * (own @ plain.T)))
                least = batch.column("least").slice(start, len(own)).to_pylist()
                least = np.array([-np.inf if x is None or not space.exact else float(x) for x in least])[:, None]
                with np.errstate(invalid="ignore"):
                    reach = np.sqrt(np.maximum(0.0, norm - 2.0 * least)) + 2 * SLACK * (1.0 + np.sqrt(norm))
                at, pivot = np.nonzero(far - radii <= reach)
                taken = batch.slice(start, len(own)).take(pa.array(at))
                yield pa.RecordBatch.from_arrays(
                    [*taken.columns, pa.array(pivot.astype(np.int32))], [*taken.schema.names, "pivot"]
                )

    return queries.mapInArrow(run, schema)


def _visit(cells: DataFrame, pages: DataFrame, space: _Space, keep: int) -> DataFrame:
    """Search each query of a cell (shard, block of queries) in the shard's tree."""
    wanted = cells.select(F.col("shard").alias("shard"), F.col("block").alias("block")).distinct()
    trees = pages.join(wanted, "shard")
    return (
        cells.groupBy("shard", "block")
        .cogroup(trees.groupBy("shard", "block"))
        .applyInArrow(_search(space, keep), FOUND)
    )


def _best(found: DataFrame, keep: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)
    hit = F.struct("rank", "vec_id", "score")
    return ranked.groupBy("query").agg(F.sort_array(F.collect_list(hit)).alias("hits"))


def search(
    vectors: DataFrame, is_query: str, k: int, id_col: str = "vec_id", vector_col: str = "embedding",
    scale: int = 64, tree_size: int = TREE, block_size: int = QUERIES,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k largest integer inner products of every query, exactly.

    Components become ``floor(scale * x)``. ``is_query`` is a condition on ``id``. Equal scores rank by smaller id; a
    query's own row is no candidate.

    Equal vectors are searched and indexed once, with their k + 1 smallest ids, which is all that can be among the
    best k of any query. Vectors go to the nearest of up to ``PIVOTS`` sampled pivots; a pivot's vectors are cut at
    random into trees of about ``tree_size``. A task bulk-loads each tree: rows are halved between two far points
    until leaves hold ``LEAF``; every entry keeps its covering radius and its distance to the page's centre. Queries
    first search a tree of their own pivot. The score reached there bounds what the others must hold: balls of
    pivots that cannot are left out, and so are pages and objects in the trees that are visited.

    Vectors that are null or hold a null or non-finite component take no part; neither do rows without an id. Of rows
    that repeat an id the least vector counts. Short vectors are filled up with zeros, so an empty one scores 0 with all.
    Components beyond a long are cut to its ends, and so are scores before they are ranked; where products would exceed 2^53 they are made of
    Python's integers and every page is visited. Other columns are ignored. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = stage(quantized(vectors, id_col, vector_col, scale), "vectors")
    keep = k + 1
    smallest = Window.partitionBy("vector").orderBy("id")
    few = rows.withColumn("_place", F.row_number().over(smallest)).where(F.col("_place") <= keep)
    entries = few.groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    entries = stage(entries, "distinct-vectors")

    doubles = F.transform("vector", lambda x: x.cast("double"))
    stats = entries.select(
        F.size("vector").alias("size"),
        F.coalesce(F.array_max(F.transform(doubles, F.abs)), F.lit(0.0)).alias("largest"),
        F.aggregate(doubles, F.lit(0.0), lambda total, x: total + x * x).alias("square"),
    )
    stats = stats.agg(F.count(F.lit(1)).alias("n"), *[F.max(c).alias(c) for c in ("size", "largest", "square")]).first()
    space = _Space(stats["size"] or 0, stats["square"] or 0.0, stats["largest"] or 0.0)
    count = max(1, min(PIVOTS, -(-stats["n"] // tree_size)))
    sampled = entries.select("vector").orderBy(F.xxhash64("vector"), "vector").limit(count).toArrow()
    pivots = space.matrix(sampled.column("vector")) if stats["n"] else np.zeros((1, max(1, space.size)))

    near = stage(_assigned(entries, space, pivots), "assigned")
    reached = near.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far")).collect()
    balls = {r["pivot"]: (r["n"], r["far"]) for r in reached}
    trees = {pivot: -(-n // tree_size) for pivot, (n, _) in balls.items()}
    radius = np.array([balls.get(i, (0, -np.inf))[1] for i in range(len(pivots))])
    wide = spark.createDataFrame([(p, n) for p, n in trees.items()], "pivot int, trees long")
    shard = (F.col("pivot").cast("long") * (1 << 40)).alias("shard")
    place = F.pmod(F.xxhash64("vector", F.lit(7)), F.col("trees"))
    placed = near.join(F.broadcast(wide), "pivot").select((shard + place).alias("shard"), "vector", "ids")
    pages = stage(placed.groupBy("shard").applyInArrow(_build(space), PAGE), "pages")

    asking = rows.where(F.expr(is_query))
    names = asking.groupBy("vector").agg(F.min("id").alias("query"))
    names = stage(_assigned(names, space, pivots), "queries")
    homes = [(r["pivot"], -(-r["count"] // block_size)) for r in names.groupBy("pivot").count().collect()]
    homes = spark.createDataFrame([(p, n, trees.get(p, 1)) for p, n in homes], "pivot int, blocks long, trees long")
    part = F.pmod(F.xxhash64("query"), F.col("blocks"))
    asked = names.join(F.broadcast(homes), "pivot").select(
        "query", "vector", F.lit(None).cast("long").alias("least"),
        (shard + part).alias("block"), (shard + F.pmod(part, F.col("trees"))).alias("home"),
    )
    at_home = stage(_visit(asked.withColumn("shard", F.col("home")), pages, space, keep), "at-home")
    known = _best(at_home, keep).where(F.size("hits") == keep)
    known = known.select("query", F.get("hits", F.lit(keep - 1))["score"].alias("least"))
    bounded = asked.drop("least").join(known, "query", "left").select("query", "vector", "least", "block", "home")
    opened = _open_pivots(bounded, space, pivots, radius).join(F.broadcast(wide), "pivot")
    cells = opened.withColumn("_tree", F.explode(F.sequence(F.lit(0).cast("long"), F.col("trees") - 1)))
    cells = cells.withColumn("shard", shard + F.col("_tree")).where("shard <> home")
    cells = stage(cells.select("query", "vector", "least", "block", "shard"), "cells")
    elsewhere = _visit(cells, pages, space, keep)

    hits = _best(at_home.union(elsewhere), keep).join(names.select("query", "vector"), "query")
    others = F.slice(F.filter("hits", lambda hit: hit["vec_id"] != F.col("id")), 1, k)
    answered = asking.join(hits, "vector").select("id", F.posexplode(others).alias("place", "hit"))
    rank = (F.col("place") + 1).alias("rank")
    return answered.select(F.col("id").alias("query_id"), rank, "hit.vec_id", "hit.score")
