import json
import random
import re

import pytest
from conftest import line, rows, write_run
from pyspark.sql import functions as F

from permscan.operators import dictionary, hashtree, normalize, redundancy
from permscan.operators.ordering import row_index
from permscan.plans import convert, layout, views
from permscan.plans.convert import stage_lines
from permscan.schema import RAW_HEADER
from permscan.sources import results, writers
from permscan.streaming import ingest

VARIANTS = [f"ACGT{i:03d}" for i in range(40)] + ["ACGT000"]


def run_files(tmp_path, n=3, variants=VARIANTS, name="run"):
    files = {
        f"perm_{p:04d}": [line(v, lrt=f"{(i * 7 + p) % 900 + 100}E-05") for i, v in enumerate(variants)]
        for p in range(1, n + 1)
    }
    return write_run(tmp_path / name, files)


def events(done):
    return {r.name: (r.status, r.error) for r in done.events.collect()}


def test_normalized_equals_inline(spark, tmp_path):
    path = run_files(tmp_path)
    norm = convert.write_normalized(spark, path, str(tmp_path / "n" / "permutations"))
    assert norm.reference_path == str(tmp_path / "n" / "reference" / "variants.parquet")
    inline = convert.write_inline(spark, path, str(tmp_path / "i"))
    columns = ["source_file", "perm_id", "variant", "lrt_pvalue", "beta", "notes"]
    a = views.open_dataset(spark, norm.facts_path, norm.reference_path)
    b = views.open_dataset(spark, inline.facts_path)
    # A repeated variant keeps both of its positions.
    assert rows(a.results, *columns) == rows(b.results, *columns)
    assert a.permutations.count() == 3 * len(VARIANTS)
    assert rows(a.variants) == sorted([(i, v) for i, v in enumerate(VARIANTS)], key=repr)
    assert "variant" not in a.permutations.columns and "filename" in a.results.columns
    assert set(events(norm).values()) == {("converted", None)}


def test_set_layout(spark, tmp_path):
    rng = random.Random(2)
    files = {}
    for p in (1, 2):
        shuffled = VARIANTS[:30] + [f"only{p}"]
        rng.shuffle(shuffled)
        files[f"perm_{p:04d}"] = [line(v) for v in shuffled]
    path = write_run(tmp_path / "r", files)
    done = convert.convert(spark, path, str(tmp_path / "f"), str(tmp_path / "v"), convert.SET_NORMALIZED)
    data = views.open_dataset(spark, done.facts_path, done.reference_path)
    assert rows(data.results, "source_file", "variant") == sorted(
        [(n, text.split("\t")[0]) for n, lines in files.items() for text in lines], key=repr
    )
    assert data.variants.count() == 32


def test_rows_of_the_set_layout_are_not_sorted_to_get_their_ids(spark, tmp_path, monkeypatch):
    """The rows stream past the hashed dictionary; without positions none are staged."""
    staged, joins = {}, []

    def stage(df, label, folder=None):
        staged[label] = df.columns
        return convert_stage(df, label, folder)

    def write_facts(facts, *where):
        joins.extend(re.findall(r"(\w+Join) \[variant#", facts._jdf.queryExecution().executedPlan().toString()))
        assert where[1] == 3 * len(VARIANTS)
        convert_facts(facts, *where)

    convert_stage, convert_facts = convert.stage, convert.write_facts
    monkeypatch.setattr(convert, "stage", stage)
    monkeypatch.setattr(convert, "write_facts", write_facts)
    path = run_files(tmp_path)
    done = convert.convert(spark, path, str(tmp_path / "f"), str(tmp_path / "v"), convert.SET_NORMALIZED)
    assert joins == ["ShuffledHashJoin"]
    assert not {"file_path", "block_start", "scan_seq"} & set(staged["lines"])
    data = views.open_dataset(spark, done.facts_path, done.reference_path)
    assert data.results.groupBy("variant").count().where("count != 3").collect() == [("ACGT000", 6)]


@pytest.mark.parametrize("held", ["ids", "one id", "no id"])
def test_no_task_sorts_many_facts(spark, tmp_path, monkeypatch, held):
    """Also where one id holds nearly all rows of one run."""
    monkeypatch.setattr(writers, "ROWS_PER_TASK", 500)
    ids = {"ids": F.col("id"), "one id": F.when(F.col("id") < 9, F.col("id")).otherwise(9), "no id": F.lit(None)}[held]
    facts = spark.range(6000).select(
        ids.cast("int").alias("variant_id"), F.lit("perm_0101").alias("source_file"), F.lit(101).alias("perm_id"),
        F.col("id").alias("beta"),
    )
    writers.write_facts(facts, str(tmp_path / "f"), 6000)
    found = results.read_facts(spark, str(tmp_path / "f"))
    assert rows(found, *facts.columns) == rows(facts) and found.select("perm_bucket").distinct().collect() == [(1,)]
    files = found.groupBy("filename").agg(F.count("*").alias("n"), F.min("variant_id").alias("low"), F.max("variant_id").alias("high"))
    files = files.orderBy("low", "high").collect()
    assert len(files) > 8 and max(f.n for f in files) < 1500
    assert all(a.high is None or a.high <= b.low for a, b in zip(files, files[1:]))


def test_a_dictionary_grows_and_keeps_its_ids(spark, tmp_path):
    path = str(tmp_path / "v")

    def grow(*names):
        return dictionary.grow(spark, path, spark.createDataFrame([(n,) for n in names], "variant string"))

    assert grow("b", "d", "b", None) == 1
    assert grow("a", "d", "c") == 2
    assert grow("a", "b") == 2 and grow() == 2
    now = dictionary.read_dictionary(spark, path)
    assert rows(now) == [(0, "b", 1), (1, "d", 1), (2, "a", 2), (3, "c", 2)]
    assert rows(dictionary.read_dictionary(spark, path, 1), "variant") == [("b",), ("d",)]


def test_runs_and_streams_share_a_dictionary(spark, tmp_path):
    first = write_run(tmp_path / "r1", {"perm_0001": [line(v) for v in VARIANTS[10:30]]})
    second = write_run(tmp_path / "r2", {"perm_0002": [line(v) for v in VARIANTS[:20]], "perm_0003": [line("zzz"), line("ACGT011")]})
    variants = str(tmp_path / "v")
    convert.convert(spark, first, str(tmp_path / "f" / "run=1" / "batch=0"), variants, convert.SET_NORMALIZED)
    before = rows(dictionary.read_dictionary(spark, variants))
    for attempt in ("c1", "c2"):  # a replay gives no new ids
        ingest.ingest_available(
            spark, second, str(tmp_path / "f" / "run=2"), str(tmp_path / "e"), str(tmp_path / attempt), reference_path=variants,
            layout=convert.SET_NORMALIZED, max_files=1, delete_source=False,
        )
    after = rows(dictionary.read_dictionary(spark, variants))
    assert set(before) < set(after) and len({r[0] for r in after}) == len({r[1] for r in after}) == len(after) == 31
    data = views.open_dataset(spark, str(tmp_path / "f"), variants)
    assert data.results.groupBy("source_file").count().orderBy("source_file").collect() == [
        ("perm_0001", 20), ("perm_0002", 20), ("perm_0003", 2)
    ]


def test_deletion_is_noted_and_can_be_repeated(spark, tmp_path):
    path = run_files(tmp_path, 3)
    done = convert.write_inline(spark, path, str(tmp_path / "out"), delete_source=True)
    ledger = spark.read.parquet(convert.ledger_path(str(tmp_path / "out")))
    assert rows(ledger, "name", "outcome") == [(f"perm_000{i}", "deleted") for i in (1, 2, 3)]
    again = convert.delete_converted(spark, done.events, str(tmp_path / "again"))
    assert rows(again, "outcome") == [("absent",)] * 3
    assert not list((tmp_path / "run").glob("*.txt"))


def test_order_mismatch_names_the_first_difference(spark, tmp_path):
    path = run_files(tmp_path)
    moved = VARIANTS[:5] + VARIANTS[6:8] + [VARIANTS[5]] + VARIANTS[8:]
    write_run(tmp_path / "run", {"perm_0002": [line(v) for v in moved]})
    with pytest.raises(normalize.ReferenceMismatch, match="perm_0002: .* row 5: expected 'ACGT005', found 'ACGT006'") as found:
        convert.write_normalized(spark, path, str(tmp_path / "n" / "f"))
    assert rows(found.value.differences) == [("perm_0002", 5, "ACGT005", "ACGT006")]
    assert not (tmp_path / "n" / "f").exists()


def test_existing_reference_is_checked_and_kept(spark, tmp_path):
    reference = str(tmp_path / "ref")
    convert.convert(spark, run_files(tmp_path), str(tmp_path / "f1"), reference)
    other = run_files(tmp_path, variants=VARIANTS[::-1], name="other")
    with pytest.raises(normalize.ReferenceMismatch):
        convert.convert(spark, other, str(tmp_path / "f2"), reference)
    assert spark.read.parquet(reference).where("variant_id = 1").first().variant == "ACGT001"
    with pytest.raises(Exception, match="already exists"):
        convert.convert(spark, run_files(tmp_path), str(tmp_path / "f1"), reference)


def test_bad_files_become_events(spark, tmp_path):
    path = run_files(tmp_path, 6)
    folder = tmp_path / "run"
    good = [line(v) for v in VARIANTS]
    write_run(folder, {"perm_0002": good[:3] + [line("x", beta="oops")] + good[4:]})
    write_run(folder, {"perm_0003": "\t".join(RAW_HEADER) + "\n", "perm_0004": ""})
    write_run(folder, {"perm_0005": ["A\t1"]}, header=["variant", "af"])
    write_run(folder, {"perm_0006": good[:-1] + ["short\t1"]})
    done = convert.write_inline(spark, path, str(tmp_path / "out"), delete_source=True)
    got = events(done)
    assert got["perm_0001"] == ("converted", None)
    assert got["perm_0002"] == ("convert_failed", "1 malformed values")
    assert got["perm_0003"][0] == "convert_failed" and "no rows" in got["perm_0003"][1]
    assert got["perm_0004"] == ("convert_failed", "empty file")
    assert got["perm_0005"][0] == "convert_failed" and got["perm_0006"][0] == "convert_failed"
    assert rows(results.read_facts(spark, done.facts_path).select("source_file").distinct()) == [("perm_0001",)]
    assert sorted(p.name for p in folder.glob("*.txt")) == [f"perm_000{i}.txt" for i in range(2, 7)]


@pytest.mark.parametrize("write", [convert.write_inline, convert.write_normalized])
def test_a_run_without_any_good_file_gives_events(spark, tmp_path, write):
    path = write_run(tmp_path / "run", {"perm_0001": ["A\t1"]}, header=["variant", "af"])
    write_run(tmp_path / "run", {"perm_0002": ""})
    got = events(write(spark, path, str(tmp_path / "n" / "f")))
    assert {name: status for name, (status, _) in got.items()} == {"perm_0001": "convert_failed", "perm_0002": "convert_failed"}


def test_first_file_bad_takes_the_next_as_reference(spark, tmp_path):
    path = run_files(tmp_path, 3)
    write_run(tmp_path / "run", {"perm_0001": [line("zzz", af="x")]})
    done = convert.write_normalized(spark, path, str(tmp_path / "n" / "f"))
    assert events(done)["perm_0001"][0] == "convert_failed"
    assert spark.read.parquet(done.reference_path).count() == len(VARIANTS)


def test_mixed_headers_are_matched_by_name(spark, tmp_path):
    path = run_files(tmp_path, 1)
    turned = "\t".join(line("T", notes="n").split("\t")[::-1])
    write_run(tmp_path / "run", {"perm_0002": [turned]}, header=RAW_HEADER[::-1])
    lines = stage_lines(spark, path)
    assert rows(lines.where("source_file = 'perm_0002'"), "variant", "notes", "n_bad") == [("T", "n", 0)]
    assert lines.count() == len(VARIANTS) + 1


def test_no_files(spark, tmp_path):
    (tmp_path / "empty").mkdir()
    with pytest.raises(ValueError, match="holds no result files"):
        convert.write_inline(spark, str(tmp_path / "empty"), str(tmp_path / "o"))


def test_text_round_trip_of_folder_runs(spark, tmp_path):
    first = results.read_results(spark, run_files(tmp_path, 2))
    numbered = first.withColumn("variant_id", F.substring("variant", 5, 3).cast("int"))
    writers.write_result_text(numbered, str(tmp_path / "text"))
    again = results.read_results(spark, str(tmp_path / "text"))
    assert rows(again) == rows(first)


def test_facts_named_by_file(spark, tmp_path):
    frame = spark.createDataFrame([(0, 0.5)], "variant_id int, lrt_pvalue float")
    frame.toPandas().to_parquet(tmp_path / "perm_0042.parquet")
    facts = results.read_facts(spark, str(tmp_path))
    assert rows(facts, "source_file", "perm_id") == [("perm_0042", 42)]
    assert rows(results.read_facts(spark, str(tmp_path / "*.parquet")), "source_file") == [("perm_0042",)]


def lists(spark, **files):
    data = [(n, i, v) for n, values in files.items() for i, v in enumerate(values)]
    return spark.createDataFrame(data, "source_file string, row_idx int, variant string")


@pytest.mark.parametrize(
    "a, b, expected",
    [
        (["x", "y", "y"], ["x", "y", "y"], "normalized"),
        (["x", "y"], ["y", "x"], "set_normalized"),
        (["x", "y", "y"], ["x", "y"], "set_normalized"),
        (list("abcde"), list("abcxy"), "set_normalized_overlap"),
        # union 8 of 10: exactly 0.8 is not below 0.8
        (list("abcde"), list("abxyz"), "inline"),
        (list("abc"), list("xyz"), "inline"),
    ],
)
def test_verdicts(spark, a, b, expected):
    row = redundancy.verdict(lists(spark, f1=a, f2=b)).first()
    assert row.verdict == expected
    assert (row.n_union, row.sum_unique) == (len({*a, *b}), len(set(a)) + len(set(b)))


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_first_differences_of_every_file(spark, monkeypatch, block):
    monkeypatch.setattr(hashtree, "FAN", 3)
    draw = random.Random(block)
    base = [f"v{i}" for i in range(200)]
    files = {"f0": base, "f1": base[::-1], "f2": base[:-1], "f3": [*base, "w"], "f4": []}
    files |= {f"g{n}": base[: (at := draw.randrange(200))] + [None] + base[at + 1 :] for n in range(8)}
    files |= {"h": ["x", *base]}
    found = lists(spark, **files)
    reference = lists(spark, r=base).select(F.col("row_idx").alias("variant_id"), "variant")
    expected = []
    for name, values in files.items():
        for at in range(max(len(values), len(base))):
            due = base[at] if at < len(base) else None
            met = values[at] if at < len(values) else None
            if due != met or (at < len(base)) != (at < len(values)):
                expected += [(name, at, due, met)] * bool(values)  # a file without rows is unknown
                break
    assert rows(hashtree.first_differences(found, reference, rows=block)) == sorted(expected, key=repr)
    same = lists(spark, a=base, b=base)
    assert hashtree.first_differences(same, reference, rows=block).isEmpty()
    assert rows(hashtree.first_differences(same, reference.where("false"), rows=block), "row_idx", "expected") == [(0, None)] * 2


def test_layout_of_the_first_files(spark, tmp_path):
    path = run_files(tmp_path, 3)
    write_run(tmp_path / "run", {"perm_0003": [line("other", notes="n")]})
    two = layout.check_run(spark, path, sample=2).first()
    assert (two.n_files, two.n_rows, two.verdict) == (2, 2 * len(VARIANTS), "normalized")
    assert layout.check_run(spark, path, sample=3).first().verdict == "set_normalized_overlap"
    assert layout.check_run(spark, path, sample=2, column="lrt_pvalue").first().verdict == "inline"
    assert layout.check_files(spark, path, sample=3).where("same_set").count() == 2
    with pytest.raises(ValueError, match="no column 'x'"):
        layout.check_run(spark, path, column="x")


def test_redundancy_by_file(spark):
    got = redundancy.redundancy_by_file(lists(spark, f1=["x", "y"], f2=["y", "x"], f3=["x", "z"]))
    columns = ("source_file", "n_rows", "identical", "n_unique", "n_shared", "same_set")
    assert rows(got, *columns) == [("f1", 2, True, 2, 2, True), ("f2", 2, False, 2, 2, True), ("f3", 2, False, 2, 1, False)]


def test_stream_restart_and_bad_file(spark, tmp_path):
    path = run_files(tmp_path, 3)
    write_run(tmp_path / "run", {"perm_0002": [line("x", beta="oops")]})
    out = {k: str(tmp_path / k) for k in ("facts", "events", "checkpoint")}

    def run():
        ingest.ingest_available(
            spark, path, out["facts"], out["events"], out["checkpoint"], reference_path=str(tmp_path / "ref"), max_files=2
        )

    run()
    assert sorted(p.name for p in (tmp_path / "run").glob("*.txt")) == ["perm_0002.txt"]
    write_run(tmp_path / "run", {"perm_0004": [line(v) for v in VARIANTS]})
    run()
    run()
    facts = results.read_facts(spark, out["facts"])
    assert rows(facts.groupBy("source_file").count()) == [(f"perm_000{p}", len(VARIANTS)) for p in (1, 3, 4)]
    assert rows(spark.read.parquet(out["events"]), "name", "status") == sorted(
        [("perm_0001", "converted"), ("perm_0002", "convert_failed"), ("perm_0003", "converted"), ("perm_0004", "converted")]
    )
    assert ingest.progress(spark, out["events"], 10).first() == (3, 1, 6)
    ledger = spark.read.parquet(f"{out['events']}/_deleted")
    assert {r[0] for r in rows(ledger, "name")} == {f"perm_000{p}" for p in (1, 3, 4)}
    assert [p.name for p in (tmp_path / "run").glob("*.txt")] == ["perm_0002.txt"]


def test_replayed_batch_overwrites_itself(spark, tmp_path):
    path = run_files(tmp_path, 2)
    out = {k: str(tmp_path / k) for k in ("facts", "events")}
    for attempt in ("c1", "c2"):  # a lost checkpoint makes the stream start over with batch 0
        ingest.ingest_available(
            spark, path, out["facts"], out["events"], str(tmp_path / attempt), delete_source=False
        )
    assert results.read_facts(spark, out["facts"]).count() == 2 * len(VARIANTS)


def test_stream_mismatch_stops(spark, tmp_path):
    path = run_files(tmp_path, 2)
    write_run(tmp_path / "run", {"perm_0002": [line(v) for v in VARIANTS[::-1]]})
    with pytest.raises(Exception, match="variants differ from the reference"):
        ingest.ingest_available(
            spark, path, str(tmp_path / "f"), str(tmp_path / "e"), str(tmp_path / "c"), reference_path=str(tmp_path / "ref")
        )
    assert json.dumps(sorted(p.name for p in (tmp_path / "run").glob("*.txt"))) == '["perm_0001.txt", "perm_0002.txt"]'
