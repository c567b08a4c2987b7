"""Very long texts, repeated and null ids, and extra columns with clashing names, for the operators on texts and pages."""

import random

import public_tokenizers
import pytest

from permscan.llm import bpe, licenses, mixing, pages, quality, simhash, suffix, unigram

SCHEMA = "doc_id long, text string, source string, size string, ids string, matches string, fingerprint string, kept string"
LONG = " ".join(random.Random(1).choices(["the", "of", "and", "words", "énd.", "A", "x" * 30, "\n"], k=150_000))
TEXTS = [LONG, LONG + " end", "", None, " \n", "short text", "short text"]
IDS = [1, 2, 3, 4, None, 5, 5]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(n, t, "s", "a", "b", "c", "d", "e") for n, t in zip(IDS, TEXTS, strict=True)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def by_id(df, *columns):
    return sorted(((r["doc_id"], *[r[c] for c in columns]) for r in df.collect()), key=repr)


def words(text):
    return len((text or "").split())


def test_simhash(docs):
    found = by_id(simhash.near_duplicates(docs), "component_id")
    assert dict(found) == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, None: 3} and len(found) == len(IDS)


def test_mixing(docs):
    found = mixing.mix(docs).collect()
    assert sorted((r.doc_id or 0, r.size) for r in found) == sorted((n or 0, words(t)) for n, t in zip(IDS, TEXTS))
    assert all(0 <= r.taken <= 3 * r.size for r in found)
    assert sum(r.taken for r in found) == sum(map(words, TEXTS))


def test_bpe(docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    once = by_id(bpe.encode_and_decode(docs, path), "ids", "decoded")
    assert once == by_id(bpe.decode(bpe.encode(docs, path), path), "ids", "decoded")
    assert [len(r[1]) > 100_000 for r in once if r[0] in (1, 2)] == [True, True] and len(once) == len(IDS)
    assert len({tuple(r[1]) for r in once if r[0] == 5}) == 1


def test_quality(docs):
    found = by_id(quality.weak_quality(docs), "n_words", "base_failed")
    assert [r[:2] for r in found] == sorted(((n, words(t)) for n, t in zip(IDS, TEXTS)), key=repr)
    assert all(r[2] for r in found if r[0] not in (1, 2))
    assert quality.keep_good(docs).columns == docs.columns


def test_licenses(spark, docs):
    notice = "Licensed under the Apache License, Version 2.0."
    found = by_id(licenses.scan(docs), "matches")
    assert len(found) == len(IDS) and not any(r[1] for r in found)
    hit = spark.createDataFrame([(None, LONG + "\n" + notice), (8, notice), (8, notice)], "doc_id long, text string")
    assert all(r[1][0]["license"] == "Apache-2.0" for r in by_id(licenses.scan(hit), "matches"))


def test_suffix(docs):
    found = by_id(suffix.repeated_passages(docs, length=50), "n_bytes", "spans")
    sizes = {n: len((t or "").encode()) for n, t in zip(IDS, TEXTS)}
    assert [(r[0], r[1]) for r in found] == sorted(((n, sizes[n]) for n in IDS), key=repr)
    (second,) = [r[2] for r in found if r[0] == 2]
    assert [(s["start"], s["end"]) for s in second] == [(0, len(LONG.encode()))]
    assert all(not r[2] for r in found if r[0] != 2)


def test_unigram(docs):
    found = by_id(unigram.count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model")), "n_tokens")
    count = dict(found)
    assert count[3] == count[4] == 0 and count[1] > 100_000 and len(found) == len(IDS)


def test_pages(spark):
    paragraphs = [f"<p>Paragraph {n} tells about the long way home, and nobody knew how it would end.</p>" for n in range(4000)]
    long = f"<html><body><nav><a href=/>Home</a></nav><article>{''.join(paragraphs)}</article></body></html>"
    rows = [(1, "u", long, "x", "y"), (1, "u", long, "x", "y"), (None, None, None, "x", "y"), (2, "u", "", "x", "y")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars string")
    found = {(r.page_id, r.url): r.text for r in pages.extract(table).collect()}
    assert found[(None, None)] == found[(2, "u")] == ""
    assert found[(1, "u")].count("\n\n") >= 3900 and pages.extract(table).count() == 4
