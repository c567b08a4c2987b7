import functools
import random
import re
import zlib
from collections import Counter

import pytest

from permscan.llm import spelling

SCHEMA = "doc_id long, text string, word string, n string, key string"


def counts(rows, least_length=6, least_count=5):
    found = Counter()
    for number, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if number is None else number}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= least_length and n >= least_count}


def edits(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b))
    a, b = sorted((a, b), key=len)
    return 1 if len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b))) else 9


def brute(rows):
    n = counts(rows)
    near = {w: [x for x in n if edits(w, x) == 1] for w in n}
    form = {}
    for word, found in near.items():
        best = min(found, key=lambda x: (-n[x], x), default=None)
        form[word] = best if best is not None and n[best] >= 5 * n[word] else None
    out = []
    for word in n:
        root = word
        while form[root] is not None:
            root = form[root]
        out.append((word, form[word], root, n[word], len(near[word]), n.get(form[word])))
    return sorted(out, key=lambda r: r[0])


def grouped(spark, rows):
    table = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA).repartition(3)
    found = spelling.variants(table)
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted((tuple(r) for r in found.collect()), key=lambda r: r[0])


def texts(seed, documents=200):
    draw = random.Random(seed)
    base = ["".join(draw.choice("abé") for _ in range(draw.choice([6, 7, 8, 9, 12, 17]))) for _ in range(50)]
    rows = []
    for number in range(documents):
        words = []
        for _ in range(60):
            word = base[int(draw.random() ** 2 * len(base))]
            if draw.random() < 0.5:
                i = draw.randrange(len(word))
                word = draw.choice([word[:i] + word[i + 1 :], word[:i] + draw.choice("abÉ×") + word[i:], word[:i] + "b" + word[i + 1 :]])
            words.append(word.upper() if draw.random() < 0.3 else word)
        rows.append((number if number % 7 else None, draw.choice([" ", "-", "\n"]).join(words)))
    return rows


@pytest.mark.parametrize("size, long_list", [(65536, 50_000), (30, 3), (400, 0)])
def test_groups_equal_brute_force(spark, monkeypatch, size, long_list):
    monkeypatch.setattr(spelling, "gram_dictionary", functools.partial(spelling.gram_dictionary, size=size))
    monkeypatch.setattr(spelling, "word_postings", functools.partial(spelling.word_postings, long_list=long_list))
    rows = texts(5)
    assert grouped(spark, rows) == brute(rows)


def test_chains_ties_and_one_hot_word(spark):
    rows = [(i, "letters " * 900) for i in range(5)]
    rows += [(10, "letterss " * 500 + "lettersss " * 60 + "letttersss " * 6 + "lettera " * 7), (11, "xetters aetters " * 20)]
    found = grouped(spark, rows)
    assert found == brute(rows)
    chain = {r[0]: (r[1], r[2]) for r in found}
    assert chain["letttersss"] == ("lettersss", "letters")


def test_nulls_long_runs_and_other_alphabets(spark):
    rows = [(None, None), (None, ""), (1, " \n"), (2, "日本語日本語 абвгдеж 123456"), (3, "short " * 9)]
    rows += [(100 + i, "x" * 4000 + " " + "x" * 3999 + " " + "ab" * 2000) for i in range(6)]
    rows += [(None, "Übermaß übermaß ÜBERMASS")] * 6
    assert grouped(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert grouped(spark, []) == []


def test_one_edit_spares_a_gram_among_the_rarest():
    # The bound behind the lists: a pair one edit apart has a list in common, whatever the dictionary.
    draw = random.Random(2)
    for _ in range(3000):
        word = "".join(draw.choice("abc") for _ in range(draw.randrange(6, 20)))
        i = draw.randrange(len(word) + 1)
        other = draw.choice([word[:i] + "b" + word[i:], word[:i] + "c" + word[i + 1 :], word[:i] + word[i + 1 :]])
        if edits(word, other) != 1 or min(len(word), len(other)) < 6:
            continue
        grams = {}
        for _ in range(draw.choice([0, 5, 40])):
            at = draw.randrange(len(word) - 1)
            for width in range(2, draw.randrange(3, 9)):
                grams[word[at : at + width]] = draw.randrange(1, 9)
        keys = [{p[0] for p in spelling.word_postings(w, grams, 6, long_list=4)} for w in (word, other)]
        assert keys[0] & keys[1], (word, other, grams)
        for w in (word, other):
            spans = spelling.decompose(w, grams, 3)
            assert spans[0][0] == 0 and spans[-1][1] == len(w)
