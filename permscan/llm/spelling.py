"""Spelling variants: words one edit apart, found through an index of variable-length grams."""

from bisect import bisect_right
from itertools import islice

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import stage
from .common import shuffle_partitions

RUN = r"[A-Za-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Grams that the dictionary holds, at most, and the longest gram.
DICTIONARY = 65536
LONGEST = 8
SHORTEST = 2
# Lists of grams that occur more often than this are divided by one more piece of the word.
LONG_LIST = 50_000

# Polynomial hashes of parts; equal hashes are checked on the words.
BASE, PRIME = 1_000_003, (1 << 61) - 1

POSTINGS = "key long, word string, n long, start int, stop int, side int"


def word_counts(docs: DataFrame, least_length: int = 6, least_count: int = 5, spoil: int = 199) -> DataFrame:
    """``(word, n)``: altered runs of letters and how often they occur; counts are pre-aggregated before they move."""
    text = F.coalesce(F.col("text"), F.lit(""))
    runs = F.regexp_extract_all(text, F.lit(f"({RUN}{{{least_length},}})"), F.lit(1))
    run = docs.select("doc_id", F.explode(runs).alias("run"))
    lowered = F.when(F.col("run").rlike("[A-Z]"), F.translate("run", UPPER, LOWER)).otherwise(F.col("run"))
    run = run.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), lowered.alias("run"))
    run = run.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    place = (F.col("h") % F.length("run")).cast("int")
    spoilt = F.concat(F.substring("run", F.lit(1), place), F.substring("run", place + 2, F.length("run")))
    word = F.when(F.col("h") % spoil == 0, spoilt).otherwise(F.col("run"))
    counted = run.select(word.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where((F.length("word") >= least_length) & (F.col("n") >= least_count))


def gram_dictionary(words: DataFrame, size: int = DICTIONARY, longest: int = LONGEST) -> dict[str, int]:
    """The most frequent grams of up to ``longest`` code points over all words, with their numbers of occurrences.

    A gram's beginnings occur as often, so with ties going to the shorter the dictionary is a pruned trie.
    """
    length = F.length("word")
    starts = words.select("word", F.explode(F.sequence(F.lit(1), length - SHORTEST + 1)).alias("start"))
    room = F.least(F.lit(longest), F.floor(length / 2).cast("int"), length - F.col("start") + 1)
    widths = starts.where(room >= SHORTEST).withColumn("width", F.explode(F.sequence(F.lit(SHORTEST), room)))
    grams = widths.groupBy(F.col("word").substr(F.col("start"), F.col("width")).alias("gram"))
    counted = grams.agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    top = counted.orderBy(F.desc("n"), F.length("gram"), "gram").limit(size).toArrow()
    return dict(zip(top.column("gram").to_pylist(), top.column("n").to_pylist()))


def decompose(word: str, dictionary: dict[str, int], longest: int) -> list[tuple[int, int]]:
    """Spans of a word's variable grams.

    A gram grows from two code points while it is in the dictionary, up to ``longest``; a gram within an earlier
    one is left out. What ends a gram lies within it, so text after it has no influence on it.
    """
    spans, reached, length = [], 0, len(word)
    for start in range(length - SHORTEST + 1):
        stop, most = start + SHORTEST, min(length, start + longest)
        while stop < most and word[start:stop] in dictionary:
            stop += 1
        if stop > reached:
            spans.append((start, stop))
            reached = stop
    return spans


def affected(spans: list[tuple[int, int]], length: int, longest: int) -> int:
    """The most grams that one edit anywhere in the word can change or put out of the decomposition.

    An edit leaves alone the grams that end before it (an insertion at the very end can extend the last one), and of those
    that start behind it the ones that reach further than any gram from the edit or before can.
    """
    starts, stops = [a for a, _ in spans], [b for _, b in spans]
    most = 0
    for at in range(length + 1):
        if at < length:
            before = bisect_right(stops, at)
            after = len(spans) - max(bisect_right(starts, at), bisect_right(stops, at + longest))
            most = max(most, len(spans) - before - after)
        before = bisect_right(stops, at) if at < length else bisect_right(stops, length - 1)
        after = len(spans) - max(bisect_right(starts, at - 1), bisect_right(stops, at + longest - 1))
        most = max(most, len(spans) - before - after)
    return most


def longest_gram(shorter: int) -> int:
    """Up to half a word: then one edit spares at least one gram of it, the first or the last."""
    return min(LONGEST, shorter // 2)


def _key(*parts) -> int:
    return xxhash.xxh64_intdigest("\0".join(map(str, parts)).encode(), 7) - (1 << 63)


def word_postings(word: str, dictionary: dict[str, int], least_length: int, long_list: int = LONG_LIST):
    """Lists in which a word is entered: ``(key, start, stop, side)``, the span it shares with the list's other words.

    Two words one edit apart meet in the class of the shorter one's length, where both are decomposed alike. They
    share all grams but those the edit affects; so if each is entered under its rarest grams, one more than the edit can affect,
    they have a list in common. The shared gram is beside the edit, so what lies before it (side 0) or behind it (side
    1) is equal too and belongs to the list's key. Lists of very frequent grams also take half of the other part.
    """
    length = len(word)
    for shorter in (length, length - 1):
        if shorter < least_length:
            continue
        longest = longest_gram(shorter)
        spans = decompose(word, dictionary, longest)
        ranked = sorted(spans, key=lambda span: (dictionary.get(word[span[0] : span[1]], 0), word[span[0] : span[1]], span))
        for start, stop in ranked[: affected(spans, length, longest) + 1]:
            gram = word[start:stop]
            split = dictionary.get(gram, 0) > long_list
            for side, (a, b) in enumerate(((0, stop), (start, length))):
                shared, rest = word[a:b], word[stop:] if side == 0 else word[:start]
                # Where the gram starts or ends is the same in both words, seen from the shared end.
                head = (shorter, side, stop - start, shared)
                if not split:
                    yield _key(*head), a, b, side
                    continue
                half = (shorter - (b - a)) // 2
                yield _key(*head, "<", rest[:half]), a, b, side
                yield _key(*head, ">", rest[len(rest) - half :]), a, b, side


def _enter(dictionary, least_length):
    def run(batches):
        grams = dictionary.value
        for batch in batches:
            columns = [], [], [], [], [], []
            for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist()):
                for key, start, stop, side in word_postings(word, grams, least_length):
                    for column, value in zip(columns, (key, word, n, start, stop, side)):
                        column.append(value)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, kind) for c, kind in zip(columns, kinds)], ["key", "word", "n", "start", "stop", "side"]
            )

    return run


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one code point is inserted, deleted or replaced."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    first = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[first + (len(a) == len(b)) :] == b[first + 1 :]


def _without_one(text: str) -> list[int]:
    """Hash of what is left of a text without each of its code points, and of the whole text at the end."""
    heads, tail, scale, left = [0], 0, 1, []
    for letter in text:
        heads.append((heads[-1] * BASE + ord(letter)) % PRIME)
    for at in range(len(text) - 1, -1, -1):
        left.append((heads[at] * scale + tail) % PRIME)
        tail, scale = (ord(text[at]) * scale + tail) % PRIME, scale * BASE % PRIME
    return [*left[::-1], heads[-1]]


def _merged(entries: dict[str, tuple[int, str]]):
    """Pairs of a list whose other parts are one edit apart: parts that agree once one code point is left out."""
    if len(entries) == 2:
        (a, (n, _)), (b, (m, _)) = entries.items()
        if one_edit(a, b):
            yield a, n, b, m
        return
    hashed = [(word, n, _without_one(rest)) for word, (n, rest) in entries.items()]
    whole, replaced = {}, {}
    for word, n, forms in hashed:
        whole.setdefault(forms[-1], []).append((word, n))
    for word, n, forms in hashed:
        for form in set(forms[:-1]):  # runs of one letter give the same form
            for other, m in whole.get(form, ()):
                if one_edit(word, other):
                    yield word, n, other, m
        for at, form in enumerate(forms[:-1]):
            same = replaced.setdefault((at, form), [])
            for other, m in same:
                if one_edit(word, other):
                    yield word, n, other, m
            same.append((word, n))


def _merge(batches):
    """Postings in the order of their keys → both directions of every pair of words one edit apart."""
    names, kinds = ["word", "near", "m"], (pa.string(), pa.string(), pa.int64())

    def lists():
        key, entries = None, {}
        for batch in batches:
            rows = zip(*[batch.column(i).to_pylist() for i in range(6)])
            for at, word, n, start, stop, side in rows:
                if at != key:
                    if len(entries) > 1:
                        yield entries
                    key, entries = at, {}
                entries[word] = (n, word[stop:] if side == 0 else word[:start])
        if len(entries) > 1:
            yield entries

    def pairs():
        for entries in lists():
            for a, n, b, m in _merged(entries):
                yield a, b, m
                yield b, a, n

    found = pairs()
    while block := list(islice(found, 50_000)):
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*block), kinds)], names)


def near_words(words: DataFrame, least_length: int = 6) -> DataFrame:
    """``(word, near, m)``: every ordered pair of words one edit apart, once, with the second one's count."""
    spark = words.sparkSession
    dictionary = spark.sparkContext.broadcast(gram_dictionary(words))
    postings = words.select("word", "n").mapInArrow(_enter(dictionary, least_length), POSTINGS)
    dealt = postings.repartition(shuffle_partitions(spark), "key").sortWithinPartitions("key")
    found = dealt.mapInArrow(_merge, "word string, near string, m long")
    return found.repartition(shuffle_partitions(spark), "word").dropDuplicates(["word", "near"])


def roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` for words with a form: forms are followed to the last by doubling the step until none is open.

    A form occurs several times as often as its word, so there are no circles, and 64-bit counts allow few steps.
    """
    steps = stage(forms.select("word", F.col("form").alias("root")), "steps")
    while True:
        further = steps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        joined = steps.join(further, "root", "left")
        ahead = joined.select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("open"))
        ahead = stage(ahead, "steps")
        if ahead.where("open").isEmpty():
            return ahead.drop("open")
        steps = ahead.drop("open")


def variants(docs: DataFrame, least_length: int = 6, least_count: int = 5, factor: int = 5, spoil: int = 199) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` for the words of all texts.

    Words are maximal runs of letters (A to Z, a to z, U+00C0 to U+00FF) with A to Z lower-cased; where ``spoil`` divides the
    CRC-32 of ``<doc_id>:<run>`` the run loses one code point. Results of ``least_length`` code points and
    ``least_count`` occurrences count.
    A word's form is its near word (one code point inserted, deleted or replaced) of most occurrences, the first in
    code-point order among several, if it occurs ``factor`` times as often or more; ``root`` follows forms to the last.

    Null texts have no words, a null doc_id is the empty string, repeated rows count again, other columns are
    ignored. An empty table gives no rows.
    """
    words = stage(word_counts(docs.select("doc_id", "text"), least_length, least_count, spoil), "words")
    near = near_words(words, least_length)
    # The greatest count, then the first word: maxima of (count) and minima of words at it, in one aggregate.
    best = F.min(F.struct((-F.col("m")).alias("m"), F.col("near").alias("near")))
    met = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    joined = words.join(met, "word", "left")
    strong = -F.col("best.m") >= factor * F.col("n")
    judged = joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(strong, F.col("best.near")).alias("form"), F.when(strong, -F.col("best.m")).alias("form_n"),
    )
    judged = stage(judged, "forms")
    last = roots(judged.where("form is not null"))
    return judged.join(last, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
