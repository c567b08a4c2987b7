import random

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from permscan.llm import components, simhash, suffix

SCHEMA = "doc_id long, text string, _group string, fingerprint string"
ODD = [
    (None, "x" * 100, "a", None),
    (None, "x" * 100, "a", None),
    (3, None, None, None),
    (4, "", None, "z"),
    (5, " \t\n", None, None),
    (6, "é" * 60, None, None),
    (7, "One two", None, None),
    (9, "ba" * 3000, None, None),
    (9, "ba" * 3000, None, None),
    (10, "x" * 51, None, None),
]


def texts(count, seed=1):
    draw = random.Random(seed)
    pool = ["".join(draw.choice("ab é") for _ in range(draw.choice([30, 60, 120, 300]))) for _ in range(20)]
    return [(draw.randrange(11, 90), "".join(draw.sample(pool, draw.randrange(6))) + draw.choice(["", "q"])) for _ in range(count)]


def brute_fingerprint(text, shingle=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    width = min(shingle, len(words))
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + width]), 42) for i in range(len(words) - width + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows, most=3):
    prints = [brute_fingerprint(t) for _, t in rows]
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(i):
                if (prints[i] ^ prints[j]).bit_count() <= most and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    least = {}
    for (number, _), root in zip(rows, label, strict=True):
        if number is not None:
            least[root] = min(number, least.get(root, number))
    return sorted(((n, f"{p:016x}", least.get(r)) for (n, _), p, r in zip(rows, prints, label, strict=True)), key=repr)


def test_spark_and_library_hash_alike(spark):
    words = ["a", "Eight by", "é" * 40, "x" * 33]
    found = spark.createDataFrame([(w,) for w in words], "w string").select(F.xxhash64("w")).collect()
    assert [r[0] % 2**64 for r in found] == [xxhash.xxh64_intdigest(w.encode(), 42) for w in words]


def test_near_duplicates_against_brute_force(spark):
    draw = random.Random(5)
    vocabulary = ["".join(draw.choices("abcdefgh", k=5)) for _ in range(300)]
    rows = [(n, t) for n, t, _, _ in ODD]
    for n in range(25):
        words = draw.choices(vocabulary, k=120)
        rows.append((100 + 3 * n, " ".join(words)))
        for k in (1, 2):
            words[draw.randrange(118)] = "edited"
            rows.append((100 + 3 * n + k, "  ".join(words).upper()))
    frame = spark.createDataFrame([(*r, "c", "f") for r in rows], SCHEMA)
    found = simhash.near_duplicates(frame).withColumn("fingerprint", simhash.fingerprint_hex("fingerprint")).collect()
    assert sorted((tuple(r) for r in found), key=repr) == brute_components(rows)


def test_index_links_what_brute_force_links():
    draw = np.random.default_rng(3)
    centre = draw.integers(0, 2**63, 5).astype(np.uint64)
    flips = np.uint64(1) << draw.integers(0, 64, (600, 4)).astype(np.uint64)
    bits = np.unique(centre[draw.integers(0, 5, 600)] ^ np.bitwise_xor.reduce(flips, axis=1))
    bits = bits[np.argsort(simhash.gray_rank(bits))]
    near = np.bitwise_count(bits[:, None] ^ bits[None, :]) <= 3
    i, j = np.nonzero(np.triu(near, 1))
    assert (simhash._link(bits, 3) == simhash._components(len(bits), i, j)).all()
    u, v = simhash._forest(np.zeros(len(bits), int), bits, 3)
    assert len(u) < len(bits) and (np.bitwise_count(bits[i] ^ bits[j]) <= 3).all()


def test_divided_nodes_lose_no_link(spark):
    draw = random.Random(8)
    centres = [draw.getrandbits(64) for _ in range(4)]
    values = {c ^ (1 << draw.randrange(64)) ^ (1 << draw.randrange(64)) for c in centres for _ in range(60)}
    signed = [simhash._signed(v) for v in values]
    frame = spark.createDataFrame([(s,) for s in signed], "fingerprint long")
    found = [
        {tuple(r) for r in components.connected_components(simhash.forest_edges(frame, 3, size)).collect()}
        for size in (10**6, 8)
    ]
    assert found[0] == found[1] and found[0]


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 3), (5, 4), (4, 6), (7, 6), (2, 1), (None, 9)]
    found = components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert sorted(map(tuple, found)) == [(2, 1), (3, 1), (5, 4), (6, 4), (7, 4)]
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def brute_passages(rows, length=50):
    last = 2**63 - 1
    first = {}
    for number, text in rows:
        data, rank = (text or "").encode(), last if number is None else number
        for p in range(len(data) - length + 1):
            key = data[p : p + length]
            first[key] = min(first.get(key, last), rank)
    out = []
    for number, text in rows:
        data, rank = (text or "").encode(), last if number is None else number
        gone = bytearray(len(data))
        for p in range(len(data) - length + 1):
            if first[data[p : p + length]] < rank:
                gone[p : p + length] = b"\1" * length
        edges = [p for p in range(len(data) + 1) if (p < len(data) and gone[p]) != (p > 0 and gone[p - 1])]
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        out.append((number, len(data), tuple(zip(edges[::2], edges[1::2], strict=True)), kept))
    return sorted(out, key=repr)


def test_repeated_passages_against_brute_force(spark):
    rows = [(n, t) for n, t, _, _ in ODD] + texts(120)
    frame = spark.createDataFrame([(*r, "c", "f") for r in rows], SCHEMA)
    found = suffix.repeated_passages(frame, groups=3).collect()
    got = [(r.doc_id, r.n_bytes, tuple((s.start, s.end) for s in r.spans), bytes(r.kept)) for r in found]
    assert sorted(got, key=repr) == brute_passages(rows)


def test_without_repeats_keeps_rows_and_whole_characters(spark):
    shared = "ñandú " * 20
    rows = [(1, shared + "one", "g", None), (2, "é" + shared + "é", None, "f"), (3, None, "g", None)]
    found = suffix.without_repeats(spark.createDataFrame(rows, SCHEMA), groups=2)
    assert found.columns == ["doc_id", "text", "_group", "fingerprint"]
    got = {r.doc_id: (r.text, r._group) for r in found.collect()}
    # The last é goes: its first byte also follows the passage in document 1, where it begins an ñ.
    assert got == {1: (shared + "one", "g"), 2: ("é", None), 3: ("", "g")}


def test_decisions_do_not_depend_on_the_order_of_rows():
    rows = [(n, t or "") for n, t, _, _ in ODD if n is not None] + texts(40)
    rows = [(n, n, t.encode(), 0) for n, t in rows]

    def group(some):
        return pa.table(dict(zip(("_id", "_rank", "_text", "_group"), map(list, zip(*some, strict=True)), strict=True)))

    answers = suffix._answer(suffix._announce(50, 1)(group(rows)))
    found = suffix._decide(50)(suffix._propose(50, 1)(group(rows), answers))
    expected = brute_passages([(n, t.decode()) for n, _, t, _ in rows])
    for seed in range(3):
        some = random.Random(seed).sample(rows, len(rows))
        out = suffix._apply(50, 1, suffix._spans)(group(some), found).to_pylist()
        got = [(r["doc_id"], r["n_bytes"], tuple((s["start"], s["end"]) for s in r["spans"]), r["kept"]) for r in out]
        assert sorted(got, key=repr) == expected


def _one_group(rows):
    """Rows as the steps get them, all in one group."""
    names = ("_id", "_rank", "_text", "_group")
    return pa.table(dict(zip(names, map(list, zip(*[(n, n, t, 0) for n, t in rows], strict=True)), strict=True)))


def _compared(rows, buckets, monkeypatch):
    """Contents proposed for rows in one group, suffixes sorted for them, and the spans found."""
    suffixes, sort = [], suffix.suffix_order
    monkeypatch.setattr(suffix, "suffix_order", lambda b, s, *a: suffixes.append(len(s)) or sort(b, s, *a))
    docs = _one_group(rows)

    def cells(column, run):
        announced = column.column("_bucket").to_pylist()
        return pa.concat_tables([run(column.filter(pa.array([x == b for x in announced]))) for b in range(buckets)])

    proposed = suffix._propose(50, buckets)(docs, cells(suffix._announce(50, buckets)(docs), suffix._answer))
    found = suffix._apply(50, buckets, suffix._spans)(docs, cells(proposed, suffix._decide(50))).to_pylist()
    spans = {r["doc_id"]: [(s["start"], s["end"]) for s in r["spans"]] for r in found}
    return sum(map(len, proposed.column("sizes").to_pylist())), sum(suffixes), spans


def _letters(seed, n):
    draw = random.Random(seed)
    return bytes(draw.choice(b"abcdefghijklmnopqrstuvwxyz ") for _ in range(n))


def test_phrases_that_texts_share_by_chance_are_not_compared(monkeypatch):
    rows = [(n, _letters(n, 60) + b"of the and that in 20" + _letters(1000 + n, 60)) for n in range(200)]
    proposed, suffixes, spans = _compared(rows, 3, monkeypatch)
    assert proposed == 0 and suffixes == 0 and not any(spans.values())


def test_only_suffixes_that_may_occur_again_are_sorted(monkeypatch):
    # A phrase longer than a seed brings the segments around it together, though no window of 50 bytes is common.
    phrase = b"this phrase of forty bytes and two comes!!"
    rows = [(n, _letters(n, 60) + phrase + _letters(1000 + n, 60)) for n in range(200)]
    rows.append((200, b"#" + rows[7][1][30:120]))
    proposed, suffixes, spans = _compared(rows, 3, monkeypatch)
    assert proposed > 200 and 0 < suffixes <= 2 * 41
    assert spans.pop(200) == [(1, 91)] and not any(spans.values())


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert simhash.near_duplicates(empty).count() == 0
    assert suffix.repeated_passages(empty).count() == 0
    assert suffix.without_repeats(empty).count() == 0
