import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from permscan.llm import mtree

LONG = 2**63


def cut(x):
    return max(-LONG, min(LONG - 1, x))


def brute(rows, k=20):
    vectors = {}
    for number, vector in rows:
        if number is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        whole = [cut(math.floor(64 * x)) for x in vector]
        vectors[number] = min(whole, vectors.get(number, whole))
    out = []
    for query, vector in vectors.items():
        if query % 20 == 0:
            scored = sorted((-cut(sum(a * b for a, b in zip(vector, v))), i) for i, v in vectors.items() if i != query)
            out += [(query, place + 1, i, -score) for place, (score, i) in enumerate(scored[:k])]
    return sorted(out)


def found(spark, rows, **settings):
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    table = table.select("*", F.lit(1).alias("shard"), F.lit("x").alias("query"), F.lit(2.5).alias("ids"))
    result = mtree.search(table, "id % 20 = 0", 20, **settings)
    assert [(f.name, f.dataType.simpleString()) for f in result.schema] == [
        ("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")
    ]
    return sorted(tuple(r) for r in result.collect())


def gaussian(count, size, seed=1, centres=6):
    draw = np.random.default_rng(seed)
    around = draw.standard_normal((centres, size))
    return [(i, (around[draw.integers(centres)] + 0.2 * draw.standard_normal(size)).tolist()) for i in range(count)]


@pytest.mark.parametrize("settings", [{}, {"tree_size": 40, "block_size": 6}])
def test_equals_brute_force(spark, settings):
    rows = gaussian(1200, 12)
    assert found(spark, rows, **settings) == brute(rows)


def test_many_equal_vectors_and_ties(spark):
    draw = random.Random(4)
    rows = [(i, [1.0, -0.5, 0.0]) for i in range(400)]
    rows += [(i, [draw.choice([0.0, 1.0, -0.5]) for _ in range(3)]) for i in range(400, 700)]
    assert found(spark, rows, tree_size=5) == brute(rows)


def test_odd_vectors(spark):
    draw = random.Random(2)
    rows = [(i, [draw.gauss(0, draw.choice([0.1, 3])) for _ in range(draw.choice([0, 2, 4]))]) for i in range(150)]
    rows += [(None, [1.0]), (500, None), (501, [None, 1.0]), (520, [float("nan")]), (540, [float("inf")])]
    rows += [(40, [9.0, 9.0]), (40, [9.0, 9.0]), (7, [1.0, 2.0, 3.0, 4.0]), (-20, [0.0])]
    assert found(spark, rows) == brute(rows)


def test_products_beyond_doubles(spark):
    draw = random.Random(3)
    rows = [(i, [draw.gauss(0, 1e17), draw.gauss(0, 1)]) for i in range(60)]
    rows += [(100 + i, [1e7 + i / 64, 1e8]) for i in range(30)]
    assert found(spark, rows, tree_size=16) == brute(rows)


def test_few_and_no_vectors(spark):
    assert found(spark, []) == []
    assert found(spark, [(0, [1.0])]) == []
    assert found(spark, [(0, [1.0]), (1, [2.0])]) == [(0, 1, 1, 64 * 128)]


def test_pages_keep_radii_and_bounds_spare_work():
    rows = np.floor(64 * np.array([v for _, v in gaussian(3000, 8)]))
    space = mtree._Space(8, float((rows**2).sum(1).max()), float(np.abs(rows).max()))
    points = space.lift(rows)
    entries = list(mtree._pages(points))
    below = {}
    for page, leaf, child, row, radius, apart in reversed(entries):
        below.setdefault(page, []).extend([row] if leaf else below[child])
    for page, leaf, child, row, radius, apart in entries:
        if not leaf:
            reach = np.sqrt(((points[below[child]] - points[row]) ** 2).sum(1)).max()
            assert reach <= radius + 1e-9
    assert sorted(below[0]) == list(range(3000))
