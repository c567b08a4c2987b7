import random

import pytest
from conftest import rows

from permscan.streaming import states

SCHEMA = "job string, perm_id long, elapsed double, status string"


def land(spark, folder, nth, events):
    spark.createDataFrame(events, SCHEMA).coalesce(1).write.parquet(f"{folder}/part={nth}")


def run(spark, folder, out, checkpoint, total):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")
    states.start_job_states(stream, out, checkpoint, total, last=3, available_now=True).awaitTermination()


def expected(events, total):
    out = []
    for job in {e[0] for e in events}:
        mine = sorted(e for e in events if e[0] == job)
        good = sum(e[3] == "converted" for e in mine)
        times = [e[2] for e in sorted(mine, key=lambda e: e[1])[-3:]]
        left = total - len(mine)
        state = "running" if left > 0 else "error" if good < len(mine) else "done"
        mean = pytest.approx(sum(times) / len(times))
        out.append((job, good, len(mine) - good, mean, pytest.approx(max(left, 0) * sum(times) / len(times)), state))
    return sorted(out, key=lambda r: r[0])


def test_states_go_on_where_the_last_run_stopped(spark, tmp_path):
    draw = random.Random(1)
    folder, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    events = [(f"j{n % 3}", n, draw.random(), "converted" if n % 7 else "convert_failed") for n in range(60)]
    events += [("hot", n, draw.random(), "converted") for n in range(400)]
    draw.shuffle(events)
    land(spark, folder, 0, events[:200])
    land(spark, folder, 1, events[200:300])
    run(spark, folder, out, checkpoint, 400)
    assert sorted(map(tuple, states.latest_states(spark, out).collect())) == expected(events[:300], 400)
    land(spark, folder, 2, events[300:])
    run(spark, folder, out, checkpoint, 400)
    found = sorted(map(tuple, states.latest_states(spark, out).collect()))
    assert found == expected(events, 400)
    assert {r[0]: r[-1] for r in found}["hot"] == "done"
    run(spark, folder, out, checkpoint, 400)  # nothing new
    assert sorted(map(tuple, states.latest_states(spark, out).collect())) == expected(events, 400)
    assert len(rows(spark.read.parquet(out), "batch")) >= 3
