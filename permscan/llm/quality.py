"""Quality rules under weak supervision: rules vote or abstain, expectation-maximisation weighs them."""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..staging import stage
from .common import WHITE, WORD

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_lines", "n_distinct", "n_capitals", "n_calls", "n_sentences")
GOOD, BAD, ABSTAIN = 1, -1, 0
MOST_ROUNDS = 50
SETTLED = 1e-6
# Share of good texts overall, and among those with a good and with a bad vote before any text is seen.
PRIOR = 0.9
BELIEF = {GOOD: 0.92, BAD: 0.05}
# Up to so many repeated windows of a text, every window is looked up among them.
FEW = 16

# rule → (measured value, bound for a bad vote, bound for a good vote or None for a rule that only finds faults). The
# direction follows from the two bounds, upwards for faults. Between them the rule abstains.
RULES = {
    "symbols": (lambda: _per_word("n_symbols"), 0.1, None),
    "repeats": (lambda: _per_word("n_repeat_words"), 0.3, None),
    "lines": (lambda: F.try_divide("n_dup_lines", "n_lines"), 0.4, None),
    "capitals": (lambda: _per_word("n_capitals"), 0.25, None),
    "calls": (lambda: _per_word("n_calls"), 0.2, None),
    "variety": (lambda: _per_word("n_distinct"), 0.1, 0.5),
    "sentences": (lambda: _per_word("n_sentences"), 0.002, 0.04),
    "word_length": (lambda: _per_word("word_chars"), 14.0, 7.0),
}


def _per_word(count: str) -> Column:
    return F.try_divide(F.col(count), F.col("n_words"))


def _count(pattern: str) -> Column:
    return F.regexp_count("_text", F.lit(pattern)).cast("long")


def _repeat_words(again: str, windows: str) -> Column:
    """Words covered by windows whose value occurs again; ``again`` lists such values.

    With few such values each window is looked up among them; with many, windows are sorted with their places and
    compared with their neighbours. Either way gives the same places.
    """

    def looked_up():
        places = F.transform(windows, lambda w, i: F.when(F.array_contains(F.col(again), w), i))
        return F.filter(places, lambda i: i.isNotNull())

    def from_pairs(pairs):
        def place(p, k):
            twice = (p["w"] == F.get(pairs, k - 1)["w"]) | (p["w"] == F.get(pairs, k + 1)["w"])
            return F.when(twice, p["i"])

        return F.sort_array(F.filter(F.transform(pairs, place), lambda i: i.isNotNull()))

    def covered(places):
        return F.aggregate(
            places,
            F.struct(F.lit(0).alias("end"), F.lit(0).alias("words")),
            lambda a, i: F.struct(
                (i + 3).alias("end"), (a["words"] + i + 3 - F.greatest(i, a["end"])).alias("words")
            ),
            lambda a: a["words"],
        )

    pairs = F.sort_array(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
    # The pairs are bound to a name by a one-element array, so that they are sorted once.
    sorted_places = F.element_at(F.transform(F.array(pairs), from_pairs), 1)
    places = F.when(F.size(again) <= FEW, looked_up()).otherwise(sorted_places)
    return F.when(F.size(again) == 0, 0).otherwise(covered(places)).cast("long")


def measure(texts: DataFrame) -> DataFrame:
    """Adds the measures to rows with a column ``_text``, computed inside the row; null texts have no words.

    Windows of three words are compared by 64-bit hashes.
    """
    words = texts.withColumn("_text", F.coalesce(F.col("_text"), F.lit(""))).withColumn(
        "_words", F.regexp_extract_all("_text", F.lit(WORD), F.lit(0))
    )
    counted = words.withColumns(
        {
            "_lines": F.filter(F.split("_text", "\n"), lambda x: x.rlike(WORD)),
            "_hashes": F.transform("_words", lambda w: F.xxhash64(w)),
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_symbols": _count(r"[#*$%&|<>]"),
            "n_capitals": _count(r"\p{Lu}{2,}"),
            "n_calls": _count("!"),
            "n_sentences": _count(rf"[.?!](?=[{WHITE}]|$)"),
        }
    )
    hashes = F.col("_hashes")
    windowed = counted.withColumns(
        {
            "_windows": F.slice(
                F.transform("_hashes", lambda h, i: F.xxhash64(h, F.get(hashes, i + 1), F.get(hashes, i + 2))),
                F.lit(1),
                F.greatest(F.size("_hashes") - 2, F.lit(0)),
            ),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_distinct": F.size(F.array_distinct("_hashes")).cast("long"),
        }
    )
    ordered = windowed.withColumn("_ordered", F.sort_array("_windows"))
    ordered = ordered.withColumn("_again", F.filter("_ordered", lambda w, k: w == F.get(F.col("_ordered"), k - 1)))
    measured = ordered.withColumn("n_repeat_words", _repeat_words("_again", "_windows"))
    return measured.drop("_text", "_words", "_lines", "_hashes", "_windows", "_ordered", "_again")


def votes(rules: dict = RULES) -> dict[str, Column]:
    """One column per rule: 1 for good, -1 for bad, 0 for an abstention. Texts without words get only abstentions."""
    out = {}
    for name, (value, bad, good) in rules.items():
        upwards = good is None or bad > good
        vote = F.when(value() >= bad if upwards else value() <= bad, BAD)
        if good is not None:
            vote = vote.when(value() <= good if upwards else value() >= good, GOOD)
        out[f"vote_{name}"] = vote.otherwise(ABSTAIN)
    return out


def _logit(share: float) -> float:
    return math.log(share / (1 - share))


def _evidence(model: dict, name: str) -> dict[int, float]:
    """What a rule's vote adds to the log odds of good."""
    return {v: _logit(share) - _logit(model["good"]) for v, share in model[name].items()}


def _posterior(names: list[str], model: dict) -> Column:
    """Probability that a text with these votes is good."""
    odds = F.lit(_logit(model["good"]))
    for name in names:
        adds = _evidence(model, name)
        odds = odds + F.when(F.col(name) == GOOD, adds[GOOD]).when(F.col(name) == BAD, adds[BAD]).otherwise(0.0)
    return 1 / (1 + F.exp(-odds))


def maximise(names: list[str], patterns: list[tuple]) -> dict:
    """Expectation-maximisation over ``(votes, number of texts)``, until no share moves by a millionth.

    A rule's accuracy is the share of good texts among those that get its good and its bad vote. Its prior weighs
    as much as the texts: ``BELIEF`` for bad votes, the overall share for good ones. Where faults of different kinds seldom meet in one text, no other rule
    can confirm a bad vote, and likelihood alone would leave its meaning open. A good vote never counts against a
    text nor a bad one for it, and abstentions say nothing.
    """
    model = {"good": PRIOR, **{n: dict(BELIEF) for n in names}}
    for _ in range(MOST_ROUNDS):
        adds = [{ABSTAIN: 0.0, **_evidence(model, n)} for n in names]
        odds = [
            _logit(model["good"]) + sum(a[v] for a, v in zip(adds, cast, strict=True)) for cast, _ in patterns
        ]
        good = [n / (1 + math.exp(-x)) for x, (_, n) in zip(odds, patterns, strict=True)]
        new = {"good": PRIOR}
        for k, name in enumerate(names):
            new[name] = {}
            for vote, belief in BELIEF.items():
                texts = sum(n for cast, n in patterns if cast[k] == vote)
                among = sum(g for g, (cast, _) in zip(good, patterns, strict=True) if cast[k] == vote)
                share = (among + belief * (texts + 1)) / (2 * texts + 1)
                new[name][vote] = max(share, PRIOR) if vote == GOOD else min(share, PRIOR)
        moved = max(abs(new[n][v] - model[n][v]) for n in names for v in BELIEF)
        model = new
        if moved < SETTLED:
            break
    return model


def fit(measured: DataFrame, rules: dict = RULES) -> dict:
    """The share of good texts among those with each rule's good or bad vote.

    All rows are counted by vote pattern; the driver gets these counts, which are 3 to the power of the number of rules at
    most. An empty table leaves the prior.
    """
    cast = votes(rules)
    patterns = measured.select(*[v.alias(n) for n, v in cast.items()]).groupBy(*cast).count().collect()
    return maximise(list(cast), sorted((tuple(p)[:-1], p["count"]) for p in patterns))


def judge(measured: DataFrame, model: dict, rules: dict = RULES) -> DataFrame:
    """Adds ``base_failed``, ``quality`` (posterior probability of good) and ``kept``."""
    cast = votes(rules)
    voted = measured.withColumns(cast)
    repeated = 100 * F.col("n_repeat_words") > 50 * F.col("n_words")
    judged = voted.withColumns(
        {"base_failed": (F.col("n_words") < 50) | repeated, "quality": _posterior(list(cast), model)}
    )
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= 0.5)).drop(*cast)


def weak_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: dict = RULES) -> DataFrame:
    """``(doc_id, measures, base_failed, quality, kept)`` for every row of ``docs``; other columns are not read.

    A text fails the base rules below 50 words or with over half of its words in repeated windows. ``kept`` is false
    for these, else whether the posterior probability of good is at least one half. Null and blank texts have no
    words and fail. Rows are judged one by one, so null or repeated ids change nothing. An empty table gives no rows.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    measured = stage(measure(texts), "measures")
    return judge(measured, fit(measured, rules), rules).select(
        "doc_id", *MEASURES, *MORE, "base_failed", "quality", "kept"
    )


def keep_good(docs: DataFrame, text_col: str = "text", rules: dict = RULES) -> DataFrame:
    """The rows of ``docs`` that :func:`weak_quality` keeps, with all their columns."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(text_col).alias("_text"))
    measured = stage(measure(rows), "measured")
    return judge(measured, fit(measured, rules), rules).where("kept").select("_row.*")
