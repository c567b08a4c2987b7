import base64
import gzip
import hashlib
import os
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from permscan.llm import ann, pages, warc
from permscan.staging import new_path

PAGES = "page_id long, url string, html string, payload string, first string"


def page_rows():
    rows = [(n, f"http://x/{n}", f"<p>page {n % 4}</p>") for n in range(12)]
    rows += [(20, None, None), (21, "http://e", ""), (None, "a\r\nb", "zz"), (None, None, "zz"), (3, "u", "<p>page 3</p>")]
    rows += [(100 + n, "u", os.urandom(2000).decode("latin1") + "\x1f\x8b\x08") for n in range(20)]
    return [(*r, "p", "f") for r in rows]


@pytest.mark.parametrize("split", [1 << 24, 777])
def test_archives_round_trip(spark, split):
    rows = page_rows()
    folder = "file:" + new_path(spark, "warc").removeprefix("file:")
    files = warc.write(spark.createDataFrame(rows, PAGES), folder)
    first = {}
    for number, _, html, *_ in rows:
        if number is not None:
            first[html or ""] = min(number, first.get(html or "", number))
    expected = Counter()
    for number, _, html, *_ in rows:
        payload = (html or "").encode()
        target = first.get(html or "")
        response = target is None or target == number
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        expected[number, len(payload), digest, response, None if response else target] += 1
    found = warc.read(files, split).collect()
    assert Counter(
        (r.page_id, r.payload_bytes, r.payload_digest, r.record_type == "response", r.refers_to) for r in found
    ) == expected
    assert all((r.payload is None) == (r.record_type == "revisit") for r in found)
    listed = warc.archives(spark, folder)
    assert listed.count() == files.count()
    path = files.first()["path"].removeprefix("file:")
    assert gzip.open(path).read().count(b"WARC/1.1\r\n") == files.first()["records"]


def test_small_payloads_are_all_responses_and_empty_tables_write_nothing(spark):
    frame = spark.createDataFrame(page_rows(), PAGES)
    found = warc.round_trip(frame, least_bytes=10**6).collect()
    assert {r.record_type for r in found} == {"response"} and len(found) == len(page_rows())
    assert warc.round_trip(frame.limit(0)).count() == 0


HTML = """<html><head><title>T</title></head><body><nav><ul><li><a href=/>Home</a><li><a href=/a>About</a></ul></nav>
<div class="ad">Buy now, great offer</div><article><h1>A&nbsp;title &amp; more</h1><p><b>First   paragraph of the
article.<br><p>Second one, with <i>markup</i> in it.</article><div class="comments"><div class="comment"><p>Great post!
</p></div></div><footer>&copy; 2020 all rights reserved</footer></body></html>"""


def test_labeller_on_held_out_pages_and_a_written_one(spark):
    model = pages.trained()
    made = [(b, y) for b, y in pages.generated(150, 99) if b]
    found = pages.predict(model, pages.features([b for b, _ in made]))
    right = np.concatenate([(p >= 0.5) == (y > 0) for p, (_, y) in zip(found, made, strict=True)])
    assert right.mean() > 0.98
    assert pages.extract_text(model, [HTML, "", "<p"]) == [
        "A title & more\n\nFirst paragraph of the article.\n\nSecond one, with markup in it.",
        "",
        "",
    ]
    frame = spark.createDataFrame([(1, "u", HTML, "a", "b"), (1, None, None, "a", "b"), (None, "u", "", "a", "b")], PAGES)
    rows = pages.extract(frame).collect()
    assert sorted(len(r.text) > 0 for r in rows) == [False, False, True] and rows[0].url == "u"
    assert pages.extract(frame.limit(0)).count() == 0


def test_an_open_head_ends_at_the_first_block():
    def texts(html):
        return [text for _, text, _ in pages.blocks_of(html)]

    assert texts("<html><head><title>x</title><p>One<p>Two") == ["One", "Two"]
    assert texts("<title>x</title><h1>A</h1>b") == ["A", "b"]
    assert texts("<head><template><p>no</template><meta name=a><style>p {}</style><div>yes</div>") == ["yes"]
    assert texts("<head><noscript><p>no</p></noscript><script>'<p>'</script></head><body>yes") == ["yes"]


# Layouts that the generator of training pages does not make.
HELD_OUT = [
    (
        """<!doctype html><html lang=en><head><title>News</title></head><body><table><tr><td class="leftcol"><a href=1>Home</a>
<br><a href=2>Sport</a><br><a href=3>Weather</a></td><td><h2>Storm reaches the coast</h2><p>The storm that formed over the
sea last week reached the coast on Monday, and many people left their houses before it came.</p><p>By the evening most
roads near the harbour were closed, and the trains did not run until the next day.</p></td></tr></table>
<center><a href=4>Terms</a> | <a href=5>Privacy</a></center></body></html>""",
        ["The storm that formed over the sea last week", "By the evening most roads near the harbour"],
        ["Sport", "Privacy"],
    ),
    (
        """<html><body><div id=top><a href=/>Start</a> <a href=/blog>Blog</a></div><main><section><h1>On old bridges</h1>
<p>Stone bridges last for centuries when their foundations are kept dry, which is why builders set them on rock.</p>
<blockquote>A bridge is a promise made to the people of both banks.</blockquote><p>Iron came later, and with it longer
spans that no mason of the time would have dared to draw.</p></section></main><aside><h3>Related</h3><ul><li><a href=/x>Ten
towers</a></li></ul></aside><footer>Copyright 2021</footer></body></html>""",
        ["Stone bridges last for centuries", "Iron came later, and with it longer"],
        ["Ten towers", "Copyright 2021"],
    ),
]


@pytest.mark.parametrize("html, article, furniture", HELD_OUT)
def test_layouts_that_the_generator_does_not_make(html, article, furniture):
    found = pages.extract_text(pages.trained(), [html])[0]
    assert all(text in found for text in article)
    assert not any(text in found for text in furniture)
    assert "\n\n" in found and "\n\n\n" not in found


def test_extract_gives_the_contract_of_the_query(spark):
    from permscan.llm.queries import op10_pages

    found = op10_pages(spark, "/root/testdata/sf0.001").collect()
    assert all(r.n_chars == len(r.text) and "\n\n" in r.text for r in found if r.text)
    assert all(block == " ".join(block.split()) != "" for r in found if r.text for block in r.text.split("\n\n"))


def test_training_gradient():
    """One weight of each matrix against finite differences."""
    draw = np.random.default_rng(1)
    made = [(draw.normal(size=(n, pages.INPUT)).astype(np.float32), (draw.random(n) > 0.5).astype(np.float32)) for n in (5, 3)]
    before = pages.train(made, epochs=0)
    after = pages.train(made, epochs=60)

    def loss(model):
        found = pages.predict(model, [x for x, _ in made])
        return -np.mean([np.mean(np.log(np.where(y > 0, p, 1 - p) + 1e-9)) for p, (_, y) in zip(found, made, strict=True)])

    assert loss(after) < 0.2 * loss(before)


def neighbours(spark, rows, **settings):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, number string, hash string")
    found = ann.search(frame, "id % 20 = 0", **settings).collect()
    out = {}
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, round(r.score, 9)))
    return out


def brute_neighbours(rows, k):
    kept = {}
    for number, vector, *_ in rows:
        fine = vector is not None and all(x is not None and np.isfinite(x) for x in vector) and any(vector)
        if number is not None and fine:
            kept[number] = min(kept.get(number, vector), vector)
    out = {}
    for number, vector in kept.items():
        others = [(-float(np.dot(vector, v)), n) for n, v in kept.items() if n != number]
        if number % 20 == 0 and others:
            out[number] = [(n, round(-s, 9)) for s, n in sorted(others, key=lambda x: (round(x[0], 12), x[1]))[:k]]
    return out


def test_search_with_one_leaf_is_exact(spark):
    draw = np.random.default_rng(4)
    rows = [(n, draw.normal(size=6).round(2).tolist(), "a", "b") for n in range(150)]
    rows += [(200 + n, [1.0, 0.0, 0.0, 0.0, 0.0, 0.5], "a", "b") for n in range(60)]
    rows += [(n, v, "a", "b") for n, v in ((400, None), (420, [0.0] * 6), (440, [None] + [1.0] * 5), (460, [float("nan")] * 6))]
    rows += [(480, [float("inf")] * 6, "a", "b"), (None, [1.0] * 6, "a", "b"), (20, [9.0] * 6, "a", "b")]
    assert neighbours(spark, rows, k=5) == brute_neighbours(rows, 5)
    assert neighbours(spark, rows[:1]) == {} and neighbours(spark, []) == {}
    assert neighbours(spark, rows[:3] + rows[-1:], k=5) == brute_neighbours(rows[:3] + rows[-1:], 5)


def test_recall_with_many_leaves(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, list(map(float, r.embedding)), "a", "b") for r in vectors.select("vec_id", "embedding").collect()]
    found, exact = neighbours(spark, rows, k=20, leaf=200, candidates=8000), brute_neighbours(rows, 20)
    hits = sum(len({n for n, _ in found[q]} & {n for n, _ in exact[q]}) for q in exact)
    assert hits >= 0.9 * 20 * len(exact)
    assert all(len(found[q]) == 20 for q in exact)


def recall(found, exact, k):
    return sum(len({n for n, _ in found.get(q, [])} & {n for n, _ in exact[q]}) for q in exact) / (k * len(exact))


def test_recall_does_not_depend_on_the_budget(spark):
    draw = np.random.default_rng(7)
    rows = [(n, draw.normal(size=24).tolist(), "a", "b") for n in range(1600)]
    assert recall(neighbours(spark, rows, k=10, leaf=25, candidates=200), brute_neighbours(rows, 10), 10) >= 0.9


def test_queries_outside_a_cone_get_all_their_neighbours(spark):
    draw = np.random.default_rng(9)
    rows = [(n, ([1.0] * 12 + draw.normal(size=12) * 0.001).tolist(), "a", "b") for n in range(1, 800) if n % 20]
    rows += [(20, [-1.0] * 12, "a", "b"), (40, [-1.0] * 6 + [1.0] * 6, "a", "b")]
    assert neighbours(spark, rows, k=10, leaf=25, candidates=200) == brute_neighbours(rows, 10)


def test_page_columns_are_not_read(spark):
    assert "first" not in pages.extract(spark.createDataFrame(page_rows(), PAGES)).columns
    assert warc.read(warc.write(spark.createDataFrame(page_rows(), PAGES), new_path(spark, "w"))).where(F.col("page_id") == 5).count() == 1
