"""Connected components of a graph given as edges between longs."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import stage


def _minima(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a vertex is linked to the least vertex around it."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _minima(both).withColumn("m", F.least("m", "u"))
    joined = both.where("v > u").join(least, "u")
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every vertex and its smaller neighbours are linked to the least of these."""
    least = _minima(edges)
    joined = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return joined.union(least.select("u", F.col("m").alias("v"))).where("u <> v")


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """``(u, v)`` edges → ``(u, v)``: every vertex that is not the least of its component, with that least vertex.

    Alternates large and small stars until a round changes nothing; each round is written to the shared
    folder. Minima are aggregated before they move, so a vertex with very many edges is no hot group. Loops
    and repeated edges are allowed; no edges give no rows. Edges with a null end are ignored.
    """
    ordered = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    edges = stage(ordered.distinct(), "edges")
    before = _state(edges)
    while before[0]:
        edges = stage(_small_star(_large_star(edges).distinct()).distinct(), "edges")
        after = _state(edges)
        if after == before:
            break
        before = after
    return edges
