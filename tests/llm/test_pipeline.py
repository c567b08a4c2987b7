import random

import corpus_pipeline
from pyspark.sql import functions as F

import __spark_entry__ as entry
from permscan.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark):
    draw = random.Random(1)
    words = ["".join(draw.choices("abcdefghi", k=draw.randint(2, 8))) for _ in range(400)]
    clean = [" ".join(f"{draw.choice(words)}{'.' if k % 9 == 8 else ''}" for k in range(120)) for _ in range(6)]
    rows = [(n, text, "en", f"s{n % 3}", None) for n, text in enumerate(clean)]
    rows += [(10, rows[0][1], "en", "s0", 1), (0, rows[0][1], "en", "s0", None), (11, "*** $$$ " * 80, "en", "s1", 2)]
    rows += [(12, None, None, None, None), (None, "", None, None, None), (13, rows[1][1] + " And more of it.", "en", None, 5)]
    return spark.createDataFrame(rows, SCHEMA)


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    docs, counts = documents(spark), []
    for name, apply in corpus_pipeline.STAGES[:-1]:
        docs_out = apply(spark, docs, "")
        assert docs_out.columns == docs.columns, name
        path = f"{tmp_path}/{len(counts)}"
        docs_out.write.parquet(path)
        docs = spark.read.parquet(path)
        counts.append(sorted(r.doc_id for r in docs.collect()))
    assert counts[0] == [0, 0, 1, 2, 3, 4, 5, 10, 13]
    assert 10 not in counts[1] and counts[1].count(0) == 1
    assert counts[1] == counts[2]
    assert set(counts[3]) <= set(counts[2]) and counts[3]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert len(last) == len(counts[3]) and all(r.n_tokens == len(r.ids) for r in last)


def test_near_duplicates_keep_one_row_of_each_component(spark):
    text = [r.text for r in documents(spark).collect()[:6]]
    rows = [(None, text[0], "en", "s1", 1), (None, text[0], "en", "s0", 1), (None, text[1], None, "s0", 2)]
    rows += [(7, text[2], "en", "s0", 3), (None, text[2], "en", "s0", 3), (None, text[3], "en", "s0", 4)]
    rows += [(7, text[4], "en", "s0", 5), (7, text[4], "de", "s0", 5), (8, text[4], "aa", "s0", 5), (9, None, "en", "s0", 0)]
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted((rows[n] for n in (1, 2, 3, 5, 7, 9)), key=repr)


CLASHING = "fingerprint _id _copies key copy copies size taken _0 _3 row root u _group draw _chunk kept end".split()


def test_columns_of_any_name_pass_through(spark):
    docs = documents(spark)
    for n, name in enumerate(CLASHING):
        docs = docs.withColumn(name, F.lit(n) if n % 2 else F.lit(f"x{n}"))
    plain = documents(spark)
    for name, apply in corpus_pipeline.STAGES[:-1]:
        found = apply(spark, docs, "")
        assert found.columns == docs.columns, name
        assert {tuple(r)[5:] for r in found.collect()} <= {tuple(docs.first())[5:]}, name
        assert sorted(map(tuple, found.select(*plain.columns).collect()), key=repr) == sorted(
            map(tuple, apply(spark, plain, "").collect()), key=repr
        ), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == docs.count()


def test_rows_without_an_id_are_mixed_with_their_source(spark):
    rows = [(None, f"word {n} of a", "en", "a", n) for n in range(40)] + [(7, f"word {n} of b", "en", "b", n) for n in range(40)]
    rows += [(None, "the same text", "en", "c", 0)] * 20
    mixed = corpus_pipeline.mix_sources(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    words = {s: sum(len(r.text.split()) for r in mixed if r.source == s) for s in "abc"}
    # Targets share 380 words by 5, 2 and 1; sources a and b have 160 each, c has 60.
    assert abs(words["a"] - 237.5) <= 4 and abs(words["b"] - 95) <= 4 and words["c"] in (0, 60)
    assert {r.doc_id for r in mixed if r.source == "a"} == {None}


def test_stages_on_an_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for _, apply in corpus_pipeline.STAGES:
        assert apply(spark, docs, "").count() == 0


def test_registered():
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
    assert len(corpus_pipeline.STAGES) == 5
