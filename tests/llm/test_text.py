import hashlib
import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers

from permscan.llm import bpe, licenses, mixing, quality, unigram
from permscan.llm.queries import digests

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, source string, size string, ids string"
ODD = [None, "", " \t\n ", "x" * 9000, "the thing " * 3000, "<|endoftext|>a<|startoftext|>", "Ünïcödé İΣς 日本語\x0b1 2"]


def frame(spark, texts):
    return spark.createDataFrame([(n, t, "s", "a", "b") for n, t in enumerate(texts)], SCHEMA)


@pytest.mark.parametrize("piece", [3, 8, 50])
def test_tree_concatenation_equals_the_library(piece):
    library, encoder, draw = Tokenizer.from_file(PATH), bpe.TreeEncoder(PATH, piece), random.Random(piece)
    for _ in range(150):
        letters = draw.choice(["ab", "the ing", "aeiou", "théñß", "a1!<|", "日本語テキスト", "İΣς́ ", "AbC\x1c\x85"])
        text = "".join(draw.choices(letters, k=draw.choice([1, 5, 40, 300])))
        at = draw.randrange(len(text) + 1)
        text = text[:at] + draw.choice(["", "", "<|endoftext|>", " "]) + text[at:]
        (found, decoded), ids = encoder.encode_many([text.encode()])[0], library.encode(text, add_special_tokens=False).ids
        assert encoder.encode(text.encode()) == found
        assert " ".join(decoded) == library.decode(ids, skip_special_tokens=False)
        assert memoryview(found).cast("i").tolist() == library.encode(text, add_special_tokens=False).ids


def test_encode_and_decode_round_trip(spark):
    library = Tokenizer.from_file(PATH)
    found = digests(bpe.decode(bpe.encode(frame(spark, ODD), PATH), PATH)).collect()
    for row in found:
        ids = library.encode(ODD[row.doc_id] or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
    assert len(found) == len(ODD) and bpe.encode(frame(spark, []), PATH).count() == 0
    at_once = digests(bpe.encode_and_decode(frame(spark, ODD), PATH))
    assert sorted(map(tuple, at_once.collect())) == sorted(map(tuple, found))


def test_long_unsplit_texts_come_from_the_tree(spark, monkeypatch):
    draw = random.Random(3)
    texts = ["".join(draw.choices(letters, k=100_000)) for letters in ("abcdefgh", "theingao", "ñé日x", "!?-.", "xyz")]
    texts += ["a" * 100_000, "word " + "".join(draw.choices("theing", k=50_000)) + " end"]
    library, encoder, joins = Tokenizer.from_file(PATH), bpe.TreeEncoder(PATH), []
    joined = bpe.TreeEncoder._joined
    monkeypatch.setattr(bpe.TreeEncoder, "_joined", lambda self, level: joins.append(len(level)) or joined(self, level))
    for text, (packed, _) in zip(texts, encoder.encode_many([t.encode() for t in texts])):
        assert memoryview(packed).cast("i").tolist() == library.encode(text, add_special_tokens=False).ids
    assert max(joins) >= 32
    found = {r.doc_id: r for r in digests(bpe.encode_and_decode(frame(spark, texts), PATH)).collect()}
    for number, text in enumerate(texts):
        ids = library.encode(text, add_special_tokens=False).ids
        assert found[number].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert found[number].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_unigram_counts_equal_the_library(spark):
    small = [("a", -1.0), ("b", -1.0), ("ab", -2.0), ("aa", -2.0), ("ba", -2.0), ("aba", -3.0), ("▁", -1.0), ("▁a", -2.0)]
    draw = random.Random(2)
    for pieces, letters in ((small, "abcx ▁"), (unigram.vocabulary(public_tokenizers.path("piece_bpe_32k.model")), "the ané日x")):
        library = Tokenizer(models.Unigram([("<unk>", min(s for _, s in pieces)), *pieces], unk_id=0, byte_fallback=False))
        library.pre_tokenizer = pre_tokenizers.Metaspace()
        counter = unigram.Counter(pieces)
        for _ in range(500):
            text = "".join(draw.choices(letters, k=draw.randrange(14)))
            assert counter.total(text) == len(library.encode(text, add_special_tokens=False).ids), text
    counted = unigram.count_tokens(frame(spark, [None, "", "the thing"]), public_tokenizers.path("piece_bpe_32k.model"))
    assert [r.n_tokens for r in counted.orderBy("doc_id").collect()][:2] == [0, 0]


def test_unknown_characters_count_by_their_bytes(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    assert unigram.byte_fallback(path)
    pieces = unigram.vocabulary(path)
    octets = [(f"<0x{n:02X}>", 0.0) for n in range(256)]
    library = Tokenizer(models.Unigram([("<unk>", min(s for _, s in pieces)), *octets, *pieces], unk_id=0, byte_fallback=True))
    library.pre_tokenizer = pre_tokenizers.Metaspace()
    counter, draw = unigram.Counter(pieces, fallback=True), random.Random(8)
    texts = ["".join(draw.choices("the 𐍈ꙮ🧿ᚠ龘x", k=draw.randrange(14))) for _ in range(300)] + ["龘" * 5000]
    for text in texts:
        assert counter.total(text) == len(library.encode(text, add_special_tokens=False).ids), text
    rows = {r.doc_id: r.n_tokens for r in unigram.count_tokens(frame(spark, texts[-5:]), path).collect()}
    assert rows == {n: counter.total(t) for n, t in enumerate(texts[-5:])}


def brute_measures(text):
    words = [w for w in "".join(" " if c in "\t\n\x0b\f\r" else c for c in text or "").split(" ") if w]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines = [line for line in (text or "").split("\n") if line.strip(" \t\n\x0b\f\r")]
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


def test_measures_against_brute_force(spark):
    draw = random.Random(4)
    texts = [*ODD[:3], "a a a a", "a b c\na b c\n\n a b c", "# *x|<é>  y", "ab " * 400]
    texts += [" ".join(draw.choices("abcd\n", k=draw.randrange(80))) for _ in range(60)]
    texts += ["\n".join(f"w{draw.randrange(9)} x{n} y" for n in range(60)) * 2]
    found = quality.weak_quality(frame(spark, texts)).collect()
    for row in found:
        expected = brute_measures(texts[row.doc_id])
        assert tuple(row[m] for m in quality.MEASURES) == expected
        assert row.base_failed == (expected[0] < 50 or 100 * expected[4] > 50 * expected[0])
        assert not (row.base_failed and row.kept)


def test_votes_outweigh_single_rules():
    names = ["a", "b", "c"]
    good, bad, none = quality.GOOD, quality.BAD, quality.ABSTAIN
    patterns = [((none, none, good), 900), ((bad, none, good), 40), ((none, bad, good), 40), ((bad, bad, none), 20)]
    model = quality.maximise(names, patterns)
    assert model["a"][bad] < 0.5 < model["c"][good]
    assert quality.maximise(names, [])["a"][bad] == pytest.approx(quality.BELIEF[bad])


def test_quality_against_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    judged = quality.weak_quality(docs).where("not base_failed").drop("quality")
    rows = judged.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert sum(r.kept == (r.quality == 1) for r in rows) >= 0.98 * len(rows)
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == judged.where("kept").count()
    assert quality.keep_good(docs.limit(0)).count() == 0


def test_mix_meets_targets_and_never_exceeds_three_passes(spark):
    draw = random.Random(6)
    rows = [(n, " ".join(["w"] * draw.randrange(60)), draw.choice(["a", "b", "c", None]), "x", "y") for n in range(400)]
    rows += [(None, "w w", "d", "x", "y"), (7, "w w w", "a", "x", "y"), (7, "w w w", "a", "x", "y"), (8, None, "b", "x", "y")]
    found = mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(found) == len(rows) and all(0 <= r.taken <= 3 * r.size for r in found)
    total = sum(r.size for r in found)
    for source in {r.source for r in found}:
        mine = [r for r in found if r.source == source]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 1
        assert mine[0].target <= 3 * mine[0].source_size + 1e-9
    assert sum(r.taken for r in found) == pytest.approx(total, abs=len({r.source for r in found}))
    # The method, step by step: pieces of all passes by finish time, taken until the budget is spent.
    assert sum(r.taken for r in found) == total
    again = mixing.mix(spark.createDataFrame(rows[::-1], SCHEMA)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, found))
    copies = mixing.sequence(mixing.mix(spark.createDataFrame(rows, SCHEMA))).collect()
    times = [r.virtual_finish for r in copies]
    assert times == sorted(times) and max(r.copy for r in copies) <= 2
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_very_long_document_does_not_hold_up_its_source(spark, monkeypatch):
    monkeypatch.setattr(mixing, "GRAIN", 200)
    rows = [(n, "w " * 50, f"s{n % 3}", "x", "y") for n in range(90)] + [(100, "w " * 3000, "s1", "x", "y"), (101, "w " * 2000, None, "x", "y")]
    found = mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    total = sum(r.size for r in found)
    assert sum(r.taken for r in found) == total
    for source in {r.source for r in found}:
        mine = [r for r in found if r.source == source]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= -(-total // 200)


def test_targets_stop_at_three_times_the_size(spark):
    sources = spark.createDataFrame([("a", 10, 5.0), ("b", 1000, 1.0), ("c", 100, 1.0)], "source string, source_size long, weight double")
    found = {r.source: r.target for r in mixing.targets(sources).collect()}
    assert found == {"a": 30.0, "b": 780.0, "c": 300.0}


def test_license_scan(spark):
    mit = licenses.TEMPLATES["MIT"][2]
    texts = [
        None,
        "",
        "nothing here",
        "Intro.\nLicensed under the Apache License, Version 2.0.\nmore",
        "LICENSED under the *Apache* License version 2.0",
        mit.replace(" ", "  "),
        mit.replace(" of ", " \n"),
        "released under some other license entirely and not the MIT one",
    ]
    found = {r.doc_id: r.matches for r in licenses.scan(frame(spark, texts)).collect()}
    assert [bool(found[n]) for n in range(len(texts))] == [False, False, False, True, True, True, True, False]
    assert (found[3][0].license, found[3][0].line, found[3][0].score) == ("Apache-2.0", 2, 1.0)
    assert found[5][0].license == "MIT" and found[6][0].line == 0
    assert licenses.scan(frame(spark, [])).count() == 0


def test_size_bounds_and_anchors_lose_no_match():
    for name, texts in licenses.TEMPLATES.items():
        for text in texts:
            words, draw = licenses.normal_words(text), random.Random(name)
            for _ in range(30):
                some = [w for w in words if draw.random() > 0.1]
                grams = set(zip(some[:-1], some[1:], strict=True))
                shared = len({" ".join(g) for g in grams} & set(licenses.bigrams(text)))
                size = len(licenses.bigrams(text))
                if some and 2 * shared / (len(some) - 1 + size) >= licenses.LEAST_SCORE:
                    low, high = licenses.size_bounds(size)
                    assert low <= len(some) - 1 <= high
                    assert set(licenses.anchors(text)) & set(some)
