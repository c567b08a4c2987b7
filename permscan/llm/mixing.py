"""Mixing sources to target weights by weighted fair queueing."""

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordering import CHUNK, chunk_offsets, running_total, with_chunks
from ..staging import stage
from .common import WORD

MOST_PASSES = 3
# Documents queue in pieces of at most this share of all words, so a very long one does not hold up its source.
GRAIN = 20_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def cyclic_weights(sources: DataFrame, weights=(5.0, 2.0, 1.0)) -> DataFrame:
    """``weight`` for each row of ``sources`` (one per source): the given ones in turn, by code point, null last."""
    place = F.row_number().over(Window.partitionBy().orderBy(F.col("source").asc_nulls_last())) - 1
    values = F.array(*[F.lit(float(w)) for w in weights])
    return sources.withColumn("weight", F.element_at(values, (place % len(weights) + 1).cast("int")))


def targets(sources: DataFrame, budget: float = 1.0, passes: int = MOST_PASSES) -> DataFrame:
    """Adds ``target`` to ``(source, source_size, weight)``: ``budget`` × all sizes, shared by weight.

    A target stops at ``passes`` × the source's size and the excess is shared again until none is above. That is
    one common virtual time up to which all queues are served: sources run dry in order of size / weight, so the
    time follows from running sums in that order. One row per source is sorted in one task.
    """
    full = F.col("source_size") * passes
    order = Window.partitionBy().orderBy(full / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    ranked = sources.select(
        "*",
        (F.sum("source_size").over(every) * F.lit(float(budget))).alias("_budget"),
        F.coalesce(F.sum(full).over(before), F.lit(0)).alias("_dry_sizes"),
        (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))).alias("_open"),
        (full / F.col("weight")).alias("_dry_at"),
    )
    time = (F.col("_budget") - F.col("_dry_sizes")) / F.col("_open")
    # Sources that run dry later give earlier times than the first one that does not run dry.
    timed = ranked.withColumn("_time", F.max(F.when(time <= F.col("_dry_at"), time)).over(every))
    served = F.least(F.col("weight") * F.col("_time"), full.cast("double"))
    return timed.withColumn("target", F.coalesce(served, full.cast("double"))).select(*sources.columns, "target")


def mix(
    docs: DataFrame,
    weights=(5.0, 2.0, 1.0),
    budget: float = 1.0,
    passes: int = MOST_PASSES,
    seed: int = 42,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """``(doc_id, source, size, source_size, weight, target, taken, finish)`` for every row of ``docs``.

    Documents of a source queue in the order of a seeded hash of their id, again and again for ``passes`` passes. A
    document's virtual finish time is the words of its source up to its end, divided by the source's weight
    (``finish``, in the first pass); a document of more than a ``GRAIN``-th of all words has one for each such piece. All pieces
    of all passes are range-sorted by finish time (then by source), their words are summed up in that order, and the
    queue is cut where the sum reaches the budget. ``taken`` is a document's words before the cut in all passes, at
    most ``passes`` × ``size``; a source's are within a piece of its ``target``, up to which an ideal queue would serve it.

    ``weights`` go to the sources in turn by code point. Null texts have size 0 and take nothing; the null source is
    a source of its own, last in order; rows with equal ids queue next to each other by size. Null ids queue like one
    id. An empty table gives no rows. Running sums are taken per range of the order, so no task sees a
    whole source.
    """
    sized = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        word_count(F.col(text_col)).alias("size"),
        F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(f":{seed}"))).alias("draw"),
    )
    sized = stage(sized, "sizes")
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    shares = targets(cyclic_weights(sources, weights), budget, passes)
    # Window functions below group by a number, because a source can be null.
    numbered = shares.withColumn(
        "number", F.row_number().over(Window.partitionBy().orderBy(F.col("source").asc_nulls_last()))
    )
    numbered = stage(numbered, "shares")
    queue = sized.join(numbered, sized["source"].eqNullSafe(numbered["source"])).drop(numbered["source"])
    key = ("draw", "doc_id", "size")
    chunked = with_chunks(queue, "number", *key)
    ends = running_total(chunked, chunk_offsets(chunked, "size", ("number",)), "size", key, "end", ("number",))
    total = sized.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    cut = _cut(_pieces(ends, total, passes), math.floor(total * budget + 0.5))
    return ends.withColumn("cut", cut.select(F.struct("finish", "number", "upto", "words")).scalar()).select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "weight",
        "target",
        _before_cut(total, passes).alias("taken"),
        (F.col("end") / F.col("weight")).alias("finish"),
    )


def _piece(total: int) -> int:
    return max(1, -(-total // GRAIN))


def _finish(upto: Column) -> Column:
    return upto / F.col("weight")


def _passed(nth: Column) -> Column:
    """Words of its source that are before a document in a pass."""
    return F.col("source_size") * nth + F.col("end") - F.col("size")


def _pieces(ends: DataFrame, total: int, passes: int) -> DataFrame:
    """``(finish, number, upto, words)`` of every piece in every pass; ``upto`` is its end among its source's words."""
    piece = _piece(total)
    count = F.ceil(F.col("size") / piece)
    places = ends.where("size > 0").withColumn("nth", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))))
    places = places.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)))
    end = F.least("size", (F.col("at") + 1) * piece)
    upto = _passed(F.col("nth")) + end
    return places.select(_finish(upto).alias("finish"), "number", upto.alias("upto"), (end - F.col("at") * piece).alias("words"))


def _cut(pieces: DataFrame, budget: int) -> DataFrame:
    """The piece in which the budget ends, with the words of it that are before the cut; no row if it never does.

    Only the range that holds the cut is counted through.
    """
    order = ("finish", "number", "upto")
    chunked = with_chunks(pieces, *order)
    offsets = chunk_offsets(chunked, "words")
    holds = (F.col("_offset") < budget) & (F.col("_offset") + F.col("_sum") >= budget)
    found = offsets.where(holds)
    inside = chunked.join(found.select(CHUNK), CHUNK, "left_semi")
    served = running_total(inside, found, "words", order, "served")
    last = served.where((F.col("served") >= budget) & (F.col("served") - F.col("words") < budget))
    return last.select(*order, (budget - F.col("served") + F.col("words")).alias("words"))


def _before_cut(total: int, passes: int) -> Column:
    """Words of a document in all passes that are served before the cut; all, if there is none."""
    piece = _piece(total)

    def in_pass(taken, nth):
        start = _passed(nth)
        count = F.ceil(F.col("size") / piece)
        places = F.when(F.col("size") > 0, F.sequence(F.lit(0).cast("long"), count - 1)).otherwise(F.array().cast("array<long>"))

        def add(sum_, at):
            end = F.least("size", (at + 1) * piece)
            upto = start + end
            here = F.struct(_finish(upto).alias("finish"), F.col("number").alias("number"), upto.alias("upto"))
            cut = F.struct(F.col("cut.finish").alias("finish"), F.col("cut.number").alias("number"), F.col("cut.upto").alias("upto"))
            whole = end - at * piece
            words = F.when(F.col("cut").isNull() | (here < cut), whole).when(here == cut, F.col("cut.words")).otherwise(0)
            return sum_ + words

        return taken + F.aggregate(places, F.lit(0).cast("long"), add)

    nths = F.sequence(F.lit(0).cast("long"), F.lit(passes - 1).cast("long"))
    return F.aggregate(nths, F.lit(0).cast("long"), in_pass)


def sequence(mixed: DataFrame) -> DataFrame:
    """Whole documents of a mix in the order in which they are served, one row per copy, globally range-sorted.

    Texts are not cut: a document comes as often as ``taken / size``, rounded; the one in service at the cut thus
    comes if at least half of it is served. Adds ``copy`` (from 0) and that copy's ``virtual_finish``.
    """
    copies = F.floor(F.try_divide(F.col("taken"), F.col("size")) + 0.5).cast("int")
    rows = mixed.withColumn("copies", copies).where("copies > 0")
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    finish = F.col("finish") + F.col("copy") * F.col("source_size") / F.col("weight")
    return rows.withColumn("virtual_finish", finish).orderBy("virtual_finish", "source", "doc_id")
