"""Running state of every job from a stream of events, kept between batches instead of read again."""

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..schema import CONVERTED

LAST = 10
STATE = "n_converted long, n_failed long, perms array<long>, times array<double>"
OUTPUT = "job string, n_converted long, n_failed long, mean_elapsed double, eta_seconds double, state string"


def _advance(total: int, last: int):
    """Update of one job by a batch of its events: counts, and the times of the ``last`` highest permutations."""

    def update(key: tuple, batches, state: GroupState):
        converted, failed, perms, times = state.get if state.exists else (0, 0, [], [])
        recent = list(zip(perms, times))
        for events in batches:
            good = int((events["status"] == CONVERTED).sum())
            converted, failed = converted + good, failed + len(events) - good
            newest = events.nlargest(last, "perm_id")
            recent = sorted([*recent, *zip(newest["perm_id"].tolist(), newest["elapsed"].tolist())])[-last:]
        state.update((converted, failed, [p for p, _ in recent], [t for _, t in recent]))
        mean = sum(t for _, t in recent) / len(recent)
        left = total - converted - failed
        name = "running" if left > 0 else "error" if failed else "done"
        yield pd.DataFrame(
            {
                "job": [key[0]], "n_converted": [converted], "n_failed": [failed], "mean_elapsed": [mean],
                "eta_seconds": [mean * max(left, 0)], "state": [name],
            }
        )

    return update


def job_states(events: DataFrame, total: int, last: int = LAST) -> DataFrame:
    """Stream of ``(job, perm_id, elapsed, status)`` → the state of each job that a batch touches.

    A job's state is two counts and its last few run times, whatever the number of events; a batch's events of a job come
    in parts, so a job with most of them is never held whole. ``total`` is the planned number of runs of a job, which
    together with the mean of the last times gives the remaining seconds.
    """
    typed = events.select(
        F.col("job").cast("string").alias("job"), F.col("perm_id").cast("long").alias("perm_id"),
        F.col("elapsed").cast("double").alias("elapsed"), "status",
    )
    return typed.groupBy("job").applyInPandasWithState(
        _advance(total, last), OUTPUT, STATE, "update", GroupStateTimeout.NoTimeout
    )


def start_job_states(
    events: DataFrame, path: str, checkpoint: str, total: int, last: int = LAST, available_now: bool = False
) -> StreamingQuery:
    """Write the states that each batch changes into a folder named after it, which a replay overwrites."""

    def write(states: DataFrame, batch: int) -> None:
        states.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    stream = job_states(events, total, last).writeStream.outputMode("update").foreachBatch(write)
    stream = stream.option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if available_now else stream).start()


def latest_states(spark: SparkSession, path: str) -> DataFrame:
    """Every job's state after the last batch that touched it."""
    written = spark.read.parquet(path)
    columns = [c for c in written.columns if c != "batch"]
    newest = written.groupBy("job").agg(F.max_by(F.struct(*columns), "batch").alias("row"))
    return newest.select("row.*")
