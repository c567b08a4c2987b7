"""Exact values at given ranks of a column, bracketed by quantile sketches and settled by one counting pass."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Relative error of Spark's mergeable quantile sketch is one part in so many.
SKETCH = 10_000
# Brackets that hold more values than this together are narrowed by another sketch; so many meet in one task.
SETTLE = 1_000_000


@dataclass
class _Bracket:
    """Values from ``low`` to ``high`` (None: no bound), all of the column's that have rank ``below`` and up."""

    low: float | None
    high: float | None
    below: int
    held: int

    def condition(self, value: Column) -> Column:
        bounds = F.lit(True)
        if self.low is not None:
            bounds = bounds & (value >= F.lit(self.low))
        return bounds if self.high is None else bounds & (value <= F.lit(self.high))


def _sketched(values: DataFrame, around: list[tuple[_Bracket, int]]) -> list[tuple[float, float]]:
    """For each (bracket, rank) two values of the bracket between which that rank lies."""
    columns = []
    for nth, (bracket, rank) in enumerate(around):
        inside = F.when(bracket.condition(F.col("value")), F.col("value"))
        # The rank's place in the bracket, twice the sketch's error and two ranks to either side.
        spare = 2 / SKETCH + 2 / bracket.held
        at = (rank - bracket.below + 0.5) / bracket.held
        ends = [max(0.0, at - spare), min(1.0, at + spare)]
        columns.append(F.percentile_approx(inside, ends, SKETCH).alias(f"b{nth}"))
    row = values.agg(*columns).first()
    return [tuple(row[f"b{nth}"]) for nth in range(len(around))]


def _merged(ends: list[tuple[float, float]]) -> list[tuple[float, float]]:
    out: list[tuple[float, float]] = []
    for low, high in sorted(set(ends)):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    return out


def _counted(values: DataFrame, ends: list[tuple[float, float]]) -> list[_Bracket]:
    value = F.col("value")
    counts = []
    for nth, (low, high) in enumerate(ends):
        counts.append(F.count_if(value < F.lit(low)).alias(f"below{nth}"))
        counts.append(F.count_if((value >= F.lit(low)) & (value <= F.lit(high))).alias(f"held{nth}"))
    row = values.agg(*counts).first()
    return [_Bracket(low, high, row[f"below{n}"], row[f"held{n}"]) for n, (low, high) in enumerate(ends)]


def _brackets(values: DataFrame, count: int, ranks: list[int], settle: int) -> list[_Bracket]:
    """Disjoint brackets that hold all the ranks and at most ``settle`` values, unless one value alone is more."""
    found = [_Bracket(None, None, 0, count)]
    while sum(b.held for b in found) > settle:
        around = [(b, rank) for rank in ranks for b in found if b.below <= rank < b.below + b.held]
        narrowed = _counted(values, _merged(_sketched(values, around)))
        if sum(b.held for b in narrowed) >= sum(b.held for b in found):
            break  # few values, each repeated very often: they are counted, not held
        found = narrowed
    return found


def quantiles(df: DataFrame, column: str, probabilities: dict[str, float], settle: int = SETTLE) -> DataFrame:
    """Exact interpolated quantiles of a column as one row, one column per named probability; NULLs do not count.

    Rank (n - 1) × probability lies between two values, which are interpolated. Brackets around the ranks come from
    mergeable sketches, narrowed until they hold at most ``settle`` values; the driver gets one row of bounds and counts each
    time. Distinct values inside are then counted, with partial counts, and the ranks read off. Nothing is written.
    """
    values = df.select(F.col(column).cast("double").alias("value")).where("value is not null")
    count = values.count()
    places = {name: (count - 1) * q for name, q in probabilities.items()}
    ranks = sorted({int(r) for r in places.values()} | {min(count - 1, int(r) + 1) for r in places.values()}) if count else []
    brackets = _brackets(values, count, ranks, settle)

    value, region, below = F.col("value"), F.lit(None).cast("int"), F.lit(0).cast("long")
    for nth, bracket in enumerate(brackets):
        held = bracket.condition(value)
        region = F.when(held, F.lit(nth)).otherwise(region)
        below = F.when(F.col("region") == nth, F.lit(bracket.below)).otherwise(below)
    counted = values.select("value", region.alias("region")).where("region is not null")
    counted = counted.groupBy("region", "value").agg(F.count(F.lit(1)).alias("cnt"))
    order = Window.partitionBy("region").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counted.select("value", (F.sum("cnt").over(order) + below).alias("upto"))
    found = []
    for name, place in places.items():
        low = F.min(F.when(F.col("upto") > int(place), F.col("value")))
        high = F.min(F.when(F.col("upto") > min(count - 1, int(place) + 1), F.col("value")))
        part = place - int(place)
        found.append((low + (high - low) * part if part else low).alias(name))
    return ranked.agg(*found)
