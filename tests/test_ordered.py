import re

import numpy as np
import pytest
from conftest import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from permscan.operators import empirical, order_stats, summaries
from permscan.operators.ordering import CHUNK, chunk_offsets, dense_index, running_total, with_chunks

SLOW = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def facts(spark, triples):
    return spark.createDataFrame(triples, "source_file string, variant_id int, lrt_pvalue double")


def test_hot_group_is_spread_over_chunks(spark):
    values = spark.range(3000).select(F.when(F.col("id") < 2000, "hot").otherwise("cold").alias("g"), "id", F.lit(1).alias("w"))
    chunked = with_chunks(values, "g", "id")
    largest = chunked.groupBy("g", CHUNK).count().agg(F.max("count")).first()[0]
    assert chunked.where("g = 'hot'").select(CHUNK).distinct().count() > 1
    assert largest < 2000
    offsets = chunk_offsets(chunked, "w", ("g",), totals={"n": F.col("w")})
    got = running_total(chunked, offsets, "w", ("id",), "upto", ("g",))
    ids = {"hot": range(2000), "cold": range(2000, 3000)}
    expected = sorted((g, i, at + 1, len(r)) for g, r in ids.items() for at, i in enumerate(r))
    assert sorted(map(tuple, got.select("g", "id", "upto", "n").collect())) == expected


def test_dense_index(spark):
    names = [f"s{i}" for i in range(500)]
    got = dense_index(spark.createDataFrame([(n,) for n in names], "s string"), "s", out="i")
    assert {r.s: r.i for r in got.collect()} == {n: i for i, n in enumerate(sorted(names))}


@SLOW
@given(values=st.lists(st.one_of(st.none(), st.sampled_from([0.1, 0.25, 0.5, 1.0]), st.floats(0, 1)), max_size=60))
def test_pooled_distribution_against_numpy(spark, values):
    df = facts(spark, [("r", i, v) for i, v in enumerate(values)])
    row = summaries.pooled_null_distribution(df).first()
    known = np.array([v for v in values if v is not None])
    assert (row.n, row.n_non_null) == (len(values), len(known))
    if len(known) == 0:
        assert row["min"] is None and row["median"] is None and row["stddev"] is None
        return
    for name, q in (("p01", 0.01), ("median", 0.5), ("p99", 0.99)):
        assert row[name] == pytest.approx(np.quantile(known, q), rel=1e-9, abs=1e-12)
    assert row["mean"] == pytest.approx(known.mean(), rel=1e-9, abs=1e-12)
    if len(known) > 1:
        assert row["stddev"] == pytest.approx(known.std(ddof=1), rel=1e-6, abs=1e-9)
    else:
        assert row["stddev"] is None


@pytest.mark.parametrize("settle", [1, 40, 10**6])
@pytest.mark.parametrize("kind", ["distinct", "few", "one heavy", "tiny", "skewed"])
def test_quantiles_by_narrowing_brackets(spark, settle, kind):
    draw = np.random.default_rng(5)
    values = {
        "distinct": draw.normal(size=3000),
        "few": draw.integers(0, 7, 2000) / 7,
        "one heavy": np.r_[np.full(1500, 0.25), draw.random(700)],
        "tiny": np.array([3.0, -1.0]),
        "skewed": np.r_[draw.exponential(1e-6, 2000), draw.exponential(1e6, 900), -0.0],
    }[kind]
    probabilities = {"a": 0.0, "b": 0.013, "c": 0.5, "d": 0.9, "e": 1.0}
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)] * 9, "x double").repartition(3)
    found = order_stats.quantiles(df, "x", probabilities, settle)
    for name, q in probabilities.items():
        assert found.first()[name] == pytest.approx(np.quantile(values, q), rel=1e-12, abs=1e-18)
    assert "chunks" not in found._jdf.queryExecution().toString()


def test_quantiles_of_nothing(spark):
    empty = spark.createDataFrame([(None,)], "x double")
    assert order_stats.quantiles(empty, "x", {"a": 0.5}).collect() == [(None,)]


def test_pooled_mean_far_from_zero(spark):
    values = [1e9 + v for v in (0.0, 1.0, 2.0)]
    row = summaries.pooled_null_distribution(facts(spark, [("r", i, v) for i, v in enumerate(values)])).first()
    assert row["stddev"] == pytest.approx(1.0)


def bh(ps):
    ps = np.asarray(ps)
    order = np.argsort(ps)
    ranks = np.array([(ps <= p).sum() for p in ps])
    raw = ps * len(ps) / ranks
    q = np.empty(len(ps))
    low = 1.0
    for i in order[::-1]:
        low = min(low, raw[ps == ps[i]].min())
        q[i] = low
    return q


@SLOW
@given(data=st.lists(st.tuples(st.sampled_from(["a", "b"]), st.one_of(st.none(), st.sampled_from([0.01, 0.02, 1.0]), st.floats(0, 1))), min_size=1, max_size=50))
def test_bh_against_brute_force(spark, data):
    triples = [(run, i, p) for i, (run, p) in enumerate(data)]
    got = {(r.source_file, r.variant_id): r.q_value for r in empirical.bh_qvalues(facts(spark, triples)).collect()}
    expected = {}
    for run in "ab":
        known = [(i, p) for r, i, p in triples if r == run and p is not None]
        if known:
            for (i, _), q in zip(known, bh([p for _, p in known])):
                expected[(run, i)] = q
    assert got.keys() == expected.keys()
    for key, q in expected.items():
        assert got[key] == pytest.approx(q, rel=1e-12, abs=1e-300)


def test_empirical_p(spark):
    observed = facts(spark, [("perm_0000", 1, 0.3), ("perm_0000", 2, None), ("perm_0000", 3, 0.05)])
    null = facts(spark, [("perm_0001", 1, 0.3), ("perm_0002", 1, 0.4), ("perm_0003", 1, None), ("perm_0001", 2, 0.1), ("perm_0001", 3, 0.9)])
    assert rows(empirical.empirical_p_per_variant(observed, null)) == [(1, 2, 0.5), (3, 1, 0.0)]
    assert rows(empirical.empirical_p_pooled(observed, null)) == [(1, 0.5), (3, 0.0)]


def exploded(spark):
    """Rows whose number the optimizer underestimates, since an explode makes them."""
    runs = F.explode(F.array(*[F.lit(f"perm_{n:04d}") for n in range(4)])).alias("source_file")
    rows = spark.range(100).select(F.col("id").cast("int").alias("variant_id"), runs)
    return rows.withColumn("lrt_pvalue", (F.col("variant_id") % 7 + 1) / 8)


def test_salted_rows_do_not_pass_through_the_driver(spark):
    observed = exploded(spark).where("source_file = 'perm_0000'")
    found = empirical.empirical_p_per_variant(observed, exploded(spark).where("source_file > 'perm_0000'"))
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert rows(found) == sorted(((i, 3, 1.0) for i in range(100)), key=repr)


@pytest.mark.parametrize("operator", ["bh_qvalues", "empirical_p_pooled"])
def test_rows_meet_their_figures_without_the_driver(spark, operator):
    given = [exploded(spark)] if operator == "bh_qvalues" else [exploded(spark), exploded(spark)]
    found = getattr(empirical, operator)(*given)
    joins = re.findall(r"\w+Join", found._jdf.queryExecution().executedPlan().toString())
    assert joins[0] == "SortMergeJoin"
    assert found.count() == 400


@pytest.mark.parametrize("partitions", [1, 3, 40])
@pytest.mark.parametrize("step", [1, 10**6])
def test_rolling_eta_is_the_same_for_any_cut(spark, partitions, step):
    rng = np.random.default_rng(1)
    jobs = {"hot": rng.choice(400, 120, replace=False), "small": rng.choice(400, 5, replace=False)}
    data = [(job, int(p) * step, float(rng.integers(1, 9))) for job, ids in jobs.items() for p in ids]
    got = summaries.rolling_eta(spark.createDataFrame(data, "job string, perm_id long, elapsed double"), partitions=partitions)
    expected = []
    for job in jobs:
        run = sorted((p, e) for j, p, e in data if j == job)
        for i, (p, _) in enumerate(run):
            recent = [e for _, e in run[max(0, i - 9) : i + 1]]
            expected.append((job, p, pytest.approx(np.mean(recent) * (len(run) - i - 1))))
    assert [tuple(r) for r in got.orderBy("job", "perm_id").collect()] == sorted(expected, key=lambda r: r[:2])


def test_job_queue_states(spark):
    events = spark.createDataFrame(
        [("a", "converted"), ("a", "converted"), ("b", "converted"), ("b", "convert_failed"), ("c", "converted")],
        "job string, status string",
    )
    jobs = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "job string")
    states = {r.job: r.state for r in summaries.job_queue(jobs, events, 2).collect()}
    assert states == {"a": "done", "b": "error", "c": "running", "d": "queued"}
