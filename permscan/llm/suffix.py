"""Removal of repeated passages by longest previous factors in suffix order."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shuffle_partitions

# Bytes of a minimizer: the shorter, the more texts share one by chance, and the more so the more texts there are.
SEED = 24
# Windows in a segment at most: one bit of a 64-bit mask for each.
MOST_WINDOWS = 64
# Bytes hashed, and windows compared, at a time: what the steps hold of them stays in a core's cache.
CHUNK_BYTES = 1 << 16
SLICE_WINDOWS = 1 << 17
# Groups of documents, each held by one task at a time, for every shuffle partition of the session.
GROUPS_PER_PARTITION = 2
NO_ID = np.iinfo(np.int64).max

_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def _words(buffer: bytes | np.ndarray, count: int, at: int = 0) -> np.ndarray:
    """The 8 bytes from each of ``count`` positions on."""
    return np.ndarray((count,), "<u8", buffer, offset=at, strides=(1,))


def _seed(length: int) -> int:
    """Bytes of the seeds in a window: whole words, half of the window at most."""
    return min(SEED, length // 16 * 8)


def _window_minima(buffer: bytes, length: int) -> np.ndarray:
    """For every window of ``length`` bytes the least hash of the seeds inside it. Equal windows, equal values."""
    seed = _seed(length)
    seeds = len(buffer) - seed + 1
    value = _words(buffer, seeds) * _MIX[0]
    for at in range(8, seed, 8):
        value ^= value >> np.uint64(29)
        value += _words(buffer, seeds, at)
        value *= _MIX[1]
    value ^= value >> np.uint64(32)
    value *= _MIX[2]
    value ^= value >> np.uint64(32)
    width, have = length - seed + 1, 1
    while have < width:
        step = min(have, width - have)
        value = np.minimum(value[:-step], value[step:])
        have += step
    return value


class _Segments:
    """The texts of one group cut into segments: runs of windows of one document that share their least seed.

    A segment covers ``windows`` windows from byte ``start`` of the joined texts on.
    """

    def __init__(self, texts: list[bytes], length: int):
        self.length = length
        sizes = np.array([len(t) for t in texts], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(sizes)])
        self.joined = b"".join(texts)
        parts = [(np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)]
        at = 0
        while at < len(texts):
            end = np.searchsorted(self.offsets, self.offsets[at] + CHUNK_BYTES, side="right") - 1
            end = min(max(end, at + 1), len(texts))
            parts.append(self._cut(at, end))
            at = end
        self.key, self.start, self.windows, self.doc = (np.concatenate(x) for x in zip(*parts, strict=True))

    def _cut(self, first: int, last: int) -> tuple:
        base = self.offsets[first]
        buffer = self.joined[base : self.offsets[last]]
        if len(buffer) < self.length:
            return np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3
        least = _window_minima(buffer, self.length)
        begin = self.offsets[first:last] - base
        end = np.maximum(self.offsets[first + 1 : last + 1] - base - self.length + 1, begin)
        edge = np.ones(len(least) + 1, bool)
        edge[1:-1] = least[1:] != least[:-1]
        edge[begin[begin < len(edge)]] = True
        edge[end[end < len(edge)]] = True
        cuts = np.flatnonzero(edge)
        start, size = cuts[:-1], np.diff(cuts)
        doc = np.searchsorted(begin, start, side="right") - 1
        # Empty texts begin where the next one does; the last that begins there is the one that has the bytes.
        inside = start < end[doc]
        start, size, doc = start[inside], size[inside], doc[inside]
        pieces = -(-size // MOST_WINDOWS)
        nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = np.repeat(start, pieces) + nth * MOST_WINDOWS
        size = np.minimum(np.repeat(size, pieces) - nth * MOST_WINDOWS, MOST_WINDOWS)
        return least[start], start + base, size, np.repeat(doc, pieces) + first

    def content(self, at: np.ndarray) -> list[bytes]:
        joined, more = self.joined, self.length - 1
        return [
            joined[s : s + w + more]
            for s, w in zip(self.start[at].tolist(), self.windows[at].tolist(), strict=True)
        ]

    def seeds(self, ids: np.ndarray) -> tuple:
        """Order of segments by key, where each distinct key begins in it, and whether several documents have it."""
        order = np.argsort(self.key)
        key, owner = self.key[order], ids[self.doc[order]]
        begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, int)
        differs = np.zeros(len(key), bool)
        differs[1:] = (key[1:] == key[:-1]) & (owner[1:] != owner[:-1])
        several = np.logical_or.reduceat(differs, begin) if len(begin) else np.zeros(0, bool)
        return order, begin, several


def _texts(table: pa.Table) -> tuple[list[bytes], np.ndarray, pa.Table]:
    """Texts and ranks of a group and its other columns, by rank and text: a shuffle that is read again may bring
    the rows in another order, and the numbers given to segments must not depend on it."""
    texts, ranks = table.column("_text").to_pylist(), table.column("_rank").to_numpy()
    order = sorted(range(len(texts)), key=lambda i: (ranks[i], texts[i]))
    return [texts[i] for i in order], ranks[order], table.drop_columns(["_text", "_rank"]).take(order)


def _by_bucket(values: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Order by bucket (then by value) and the bounds of each bucket in it, for ascending unsigned values."""
    bucket = (values % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def _short(values: np.ndarray, buckets: int) -> np.ndarray:
    """32 bits of a key inside its bucket. A clash only makes two keys candidates of each other."""
    return (values // np.uint64(buckets)).astype(np.uint32)


def _slices(values: np.ndarray | bytes, bounds: np.ndarray) -> list[bytes]:
    """Bytes of the values between each two bounds. No memoryviews: Arrow never lets go of those it has read."""
    data, width = (values, 1) if isinstance(values, bytes) else (values.tobytes(), values.itemsize)
    at = (np.asarray(bounds) * width).tolist()
    return [data[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def _ends(sizes) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(np.asarray(sizes, np.int64))])


def _cells(columns: dict) -> pa.Table:
    types = {"_bucket": pa.int32(), "_group": pa.int32()}
    return pa.table({k: pa.array(v, types.get(k, pa.binary())) for k, v in columns.items()})


def _joined(table: pa.Table, column: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(column).to_pylist()), kind)


def _pack(text: bytes) -> bytes:
    """Segments overlap by most of a window, and Spark's own codec for shuffles leaves half as much again."""
    return pa.Codec("zstd", 1).compress(text, asbytes=True)


def _unpack(packed: bytes, size: int) -> bytes:
    return pa.Codec("zstd", 1).decompress(packed, size, asbytes=True) if size else b""


def _announce(length: int, buckets: int):
    """Group of documents → its distinct keys for every bucket."""

    def run(table: pa.Table) -> pa.Table:
        group = table.column("_group")[0].as_py()
        texts, ids, _ = _texts(table)
        parts = _Segments(texts, length)
        order, begin, several = parts.seeds(ids)
        keys = parts.key[order[begin]]
        by, bounds = _by_bucket(keys, buckets)
        return _cells(
            {
                "_bucket": range(buckets),
                "_group": [group] * buckets,
                "keys": _slices(_short(keys, buckets)[by], bounds),
                "several": _slices(several[by], bounds),
            }
        )

    return run


def _answer(table: pa.Table) -> pa.Table:
    """Bucket → for every group, which of its keys another document has too."""
    counts = [len(k) // 4 for k in table.column("keys").to_pylist()]
    every = _joined(table, "keys", np.uint32)
    # Sorting values, each with its place below it, takes a fraction of the time of sorting places by value.
    ordered = np.sort((every.astype(np.uint64) << np.uint64(32)) | np.arange(len(every), dtype=np.uint64))
    same = np.zeros(len(every) + 1, bool)
    same[1:-1] = ordered[1:] >> np.uint64(32) == ordered[:-1] >> np.uint64(32)
    shared = np.zeros(len(every), bool)
    shared[(ordered & np.uint64(0xFFFFFFFF)).astype(np.int64)] = same[1:] | same[:-1]
    shared |= _joined(table, "several", bool)
    bounds = _ends(counts).tolist()
    flags = [np.packbits(shared[a:b]).tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    return pa.table({"_bucket": table.column("_bucket"), "_group": table.column("_group"), "shared": flags})


def _candidates(parts: _Segments, ids: np.ndarray, shared: list[bytes], buckets: int) -> tuple:
    """Segments whose key is shared, by bucket and place, with the bounds of each bucket. ``shared``: by bucket."""
    order, begin, _ = parts.seeds(ids)
    keys = parts.key[order[begin]]
    by, bounds = _by_bucket(keys, buckets)
    found = np.zeros(len(keys), bool)
    flags = [
        np.unpackbits(np.frombuffer(f, np.uint8), count=n)
        for f, n in zip(shared, np.diff(bounds).tolist(), strict=True)
    ]
    found[by] = np.concatenate(flags).astype(bool)
    sizes = np.diff(np.append(begin, len(order)))
    segments = np.sort(order[np.repeat(found, sizes)])
    bucket = (parts.key[segments] % np.uint64(buckets)).astype(np.int64)
    place = np.argsort(bucket, kind="stable")
    return segments[place], np.searchsorted(bucket[place], np.arange(buckets + 1))


def _distinct(contents: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """Distinct contents in the order in which they first occur, and the number of each occurrence's content."""
    numbers: dict[bytes, int] = {}
    which = [numbers.setdefault(c, len(numbers)) for c in contents]
    return list(numbers), np.array(which, np.int64)


def _least(which: np.ndarray, count: int, ranks: np.ndarray) -> np.ndarray:
    least = np.full(count, NO_ID, np.int64)
    np.minimum.at(least, which, ranks)
    return least


def _propose(length: int, buckets: int):
    """Group of documents and its answers → the distinct segments to compare, for every bucket."""

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        texts, ids, _ = _texts(docs)
        shared = answers.sort_by("_bucket").column("shared").to_pylist()
        parts = _Segments(texts, length)
        segments, bounds = _candidates(parts, ids, shared, buckets)
        # Equal contents have equal keys, so their numbers, given in order of buckets, run on from bucket to bucket.
        contents, which = _distinct(parts.content(segments))
        first = np.full(len(contents), len(segments))
        np.minimum.at(first, which, np.arange(len(segments)))
        cells = np.searchsorted(first, bounds)
        sizes = np.array([len(c) for c in contents], np.uint8)
        return _cells(
            {
                "_bucket": range(buckets),
                "_group": [answers.column("_group")[0].as_py()] * buckets,
                "shared": shared,
                "text": [_pack(t) for t in _slices(b"".join(contents), _ends(sizes)[cells])],
                "sizes": _slices(sizes, cells),
                "keys": _slices(_short(parts.key[segments[first]], buckets), cells),
                "ranks": _slices(_least(which, len(contents), ids[parts.doc[segments]]), cells),
            }
        )

    return run


def suffix_order(buffer: bytes, starts: np.ndarray, group: np.ndarray, rank: np.ndarray, length: int) -> tuple:
    """Suffixes from ``starts`` on, compared over ``length`` bytes inside each ``group``, in ascending order.

    Suffixes equal over that length are ordered by ``rank``. Returns the order and, for each place in it,
    whether the suffix shares all ``length`` bytes with the one before.
    """
    padded = np.frombuffer(buffer + b"\0" * 8, np.uint8)
    position = group.astype(np.int64)
    for step in _steps(length):
        word = _words(padded, len(buffer), 0)[starts + step].byteswap()
        order = np.lexsort((word, position))
        differs = np.zeros(len(order), np.int64)
        differs[1:] = (position[order][1:] != position[order][:-1]) | (word[order][1:] != word[order][:-1])
        position = np.empty(len(order), np.int64)
        position[order] = np.cumsum(differs)
    order = np.lexsort((rank, position))
    same = np.zeros(len(order), bool)
    same[1:] = position[order][1:] == position[order][:-1]
    return order, same


def longest_previous(rank: np.ndarray, order: np.ndarray, same: np.ndarray, length: int) -> np.ndarray:
    """Longest previous factor of every suffix, counted up to ``length``: ``length`` if the previous smaller
    document in suffix order shares that many bytes, else 0.

    ``rank`` is the document's place. Equal suffixes stand in order of rank, so the previous smaller one is found
    going back over suffixes of the same rank, and the next smaller one never shares more.
    """
    ordered = rank[order]
    smaller = np.zeros(len(order), bool)
    smaller[1:] = same[1:] & (ordered[1:] > ordered[:-1])
    # A suffix of the same rank as the one before it has the same previous smaller document.
    repeats = np.zeros(len(order), bool)
    repeats[1:] = same[1:] & (ordered[1:] == ordered[:-1])
    source = np.maximum.accumulate(np.where(repeats, -1, np.arange(len(order))))
    found = np.zeros(len(order), np.int64)
    found[order] = np.where(smaller[source] if len(order) else smaller, length, 0)
    return found


def _decide(length: int):
    """Bucket → for every segment its first document and the windows that occur in a document before that one."""

    def run(table: pa.Table) -> pa.Table:
        contents = []
        counts = []
        for packed, size in zip(table.column("text").to_pylist(), table.column("sizes").to_pylist(), strict=True):
            ends = _ends(np.frombuffer(size, np.uint8))
            contents += _slices(_unpack(packed, int(ends[-1])), ends)
            counts.append(len(size))
        distinct, which = _distinct(contents)
        del contents
        least = _least(which, len(distinct), _joined(table, "ranks", np.int64))
        key = np.zeros(len(distinct), np.uint32)
        key[which] = _joined(table, "keys", np.uint32)
        masks = _earlier(distinct, key, least, length)
        cells = _ends(counts)
        return _cells(
            {
                "_group": table.column("_group").to_pylist(),
                "_bucket": table.column("_bucket").to_pylist(),
                "shared": table.column("shared").to_pylist(),
                "least": _slices(least[which], cells),
                "masks": _slices(masks[which], cells),
            }
        )

    return run


def _earlier(contents: list[bytes], key: np.ndarray, rank: np.ndarray, length: int) -> np.ndarray:
    """For each content a mask of its windows whose longest previous factor reaches ``length``.

    Contents are taken by key, some keys at a time; equal windows have equal keys. A content that is alone with its
    key shares a window with no other and is left out.
    """
    masks = np.zeros(len(contents), np.uint64)
    order = np.argsort(key, kind="stable")
    begin = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1])) if len(order) else order
    members = np.diff(np.append(begin, len(order)))
    order = order[np.repeat(members > 1, members)]
    members = members[members > 1]
    sizes = np.array([len(contents[i]) for i in order.tolist()], np.int64)
    group = np.repeat(np.arange(len(members)), members)
    last = np.cumsum(members)
    nth_slice = np.cumsum(sizes - length + 1)[last - 1] // SLICE_WINDOWS if len(last) else last
    cuts = [0, *last[np.flatnonzero(np.diff(nth_slice, append=-1))].tolist()]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        texts = [contents[i] for i in order[a:b].tolist()]
        masks[order[a:b]] = _previous(texts, sizes[a:b], group[a:b], rank[order[a:b]], length)
    return masks


def _previous(texts: list[bytes], sizes: np.ndarray, group: np.ndarray, rank: np.ndarray, length: int) -> np.ndarray:
    """Masks of :func:`_earlier` for some groups of contents of equal key.

    A window whose hash no other has occurs once and has no previous factor of that length; suffixes are sorted
    for the others.
    """
    buffer = b"".join(texts)
    windows = sizes - length + 1
    owner = np.repeat(np.arange(len(texts)), windows)
    ends = np.cumsum(windows)
    nth = np.arange(len(owner)) - np.repeat(ends - windows, windows)
    starts = np.repeat(np.cumsum(sizes) - sizes, windows) + nth
    again = _hashed_again(buffer, starts, length)
    owner, nth, starts = owner[again], nth[again], starts[again]
    masks = np.zeros(len(texts), np.uint64)
    if len(again):
        places = rank[owner]
        order, same = suffix_order(buffer, starts, group[owner], places, length)
        previous = longest_previous(places, order, same, length) >= length
        bits = np.where(previous, np.uint64(1) << nth.astype(np.uint64), np.uint64(0))
        begin = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        masks[owner[begin]] = np.bitwise_or.reduceat(bits, begin)
    return masks


def _steps(length: int) -> list[int]:
    """Where the words begin that cover ``length`` bytes."""
    steps = [*range(0, length - 7, 8)]
    return steps if steps[-1] + 8 >= length else [*steps, length - 8]


def _hashed_again(buffer: bytes, starts: np.ndarray, length: int) -> np.ndarray:
    """Numbers of the windows whose hash another window has too, ascending. Equal windows have equal hashes."""
    words = _words(buffer, len(buffer) - 7) if len(buffer) > 7 else np.zeros(0, "<u8")
    value = np.zeros(len(starts), np.uint64)
    for step in _steps(length):
        value ^= value >> np.uint64(29)
        value += words[starts + step]
        value *= _MIX[1]
    value ^= value >> np.uint64(32)
    value *= _MIX[2]
    low = np.uint64(max(len(starts), 2).bit_length())
    value >>= low
    value <<= low
    value |= np.arange(len(starts), dtype=np.uint64)
    value.sort()
    same = np.zeros(len(value) + 1, bool)
    same[1:-1] = value[1:] >> low == value[:-1] >> low
    found = value[same[1:] | same[:-1]] & ((np.uint64(1) << low) - np.uint64(1))
    return np.sort(found).astype(np.int64)


def _apply(length: int, buckets: int, result):
    """Group of documents and its decisions → ``result`` of what is removed from every document."""

    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        texts, ids, docs = _texts(docs)
        found = found.sort_by("_bucket")
        parts = _Segments(texts, length)
        here, _ = _candidates(parts, ids, found.column("shared").to_pylist(), buckets)
        _, which = _distinct(parts.content(here))
        later = ids[parts.doc[here]] > _joined(found, "least", np.int64)[which]
        masks = np.where(later, ~np.uint64(0), _joined(found, "masks", np.uint64)[which])
        masks &= ~np.uint64(0) >> (MOST_WINDOWS - parts.windows[here]).astype(np.uint64)
        some = np.flatnonzero(masks)
        bits = np.unpackbits(masks[some].astype("<u8").view(np.uint8), bitorder="little")
        hit = np.flatnonzero(bits)
        begins = np.zeros(len(parts.joined), bool)
        begins[parts.start[here][some][hit // MOST_WINDOWS] + hit % MOST_WINDOWS] = True
        return result(docs, parts, _covered(begins, length))

    return run


def _covered(begins: np.ndarray, length: int) -> np.ndarray:
    """Which bytes lie within ``length`` bytes from a marked one on."""
    start = np.flatnonzero(begins)
    if not len(start):
        return begins
    apart = np.flatnonzero(np.diff(start) > length)
    turns = np.empty(2 * len(apart) + 2, np.int64)
    turns[::2] = start[np.append(0, apart + 1)]
    turns[1::2] = start[np.append(apart, len(start) - 1)] + length
    covered = np.arange(len(turns) + 1) % 2 == 1
    return np.repeat(covered, np.diff(turns, prepend=0, append=len(begins)))


def _left(parts: _Segments, removed: np.ndarray) -> list[bytes]:
    left = np.frombuffer(parts.joined, np.uint8)[~removed].tobytes()
    at = np.searchsorted(np.flatnonzero(~removed), parts.offsets).tolist()
    return [left[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def _whole_characters(joined: bytes, removed: np.ndarray) -> np.ndarray:
    """``removed``, widened to every character of which a byte goes."""
    begins = np.flatnonzero(np.frombuffer(joined, np.uint8) & 0xC0 != 0x80)
    if not len(begins):
        return removed
    gone = np.logical_or.reduceat(removed, begins)
    return np.repeat(gone, np.diff(np.append(begins, len(removed))))


def _texts_left(docs: pa.Table, parts: _Segments, removed: np.ndarray) -> pa.Table:
    kept = _left(parts, _whole_characters(parts.joined, removed))
    return pa.table({"_row": docs.column("_row"), "_text": pa.array(kept, pa.binary()).cast(pa.string())})


def _spans(docs: pa.Table, parts: _Segments, removed: np.ndarray) -> pa.Table:
    offsets = parts.offsets
    edge = np.zeros(len(removed) + 1, bool)
    edge[1:-1] = removed[1:] != removed[:-1]
    edge[offsets] = True
    cuts = np.flatnonzero(edge)
    cuts, ends = cuts[:-1], cuts[1:]
    gone = removed[cuts] if len(cuts) else np.zeros(0, bool)
    spans_from, spans_to = cuts[gone], ends[gone]
    per_doc = np.searchsorted(spans_from, offsets)
    begin = np.repeat(offsets[:-1], np.diff(per_doc))
    spans = pa.ListArray.from_arrays(
        pa.array(per_doc, pa.int32()),
        pa.StructArray.from_arrays(
            [pa.array(spans_from - begin, pa.int64()), pa.array(spans_to - begin, pa.int64())], ["start", "end"]
        ),
    )
    return pa.table(
        {
            "doc_id": docs.column("_id"),
            "n_bytes": pa.array(np.diff(offsets), pa.int64()),
            "spans": spans,
            "kept": pa.array(_left(parts, removed), pa.binary()),
        }
    )


def repeated_passages(
    docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", groups: int | None = None
) -> DataFrame:
    """``(doc_id, n_bytes, spans, kept)`` per row: byte ranges covered by ``length``-byte strings that also start in
    a document of smaller doc_id, and the bytes that remain, joined.

    A null text is empty; texts shorter than ``length`` keep all. Overlapping matches join, and all are judged on the
    input. Matches never cross documents; rows of one doc_id do not match each other. A null doc_id counts as larger
    than any other, and such rows do not match each other. Other columns are not read. An empty table gives no rows.

    Texts are dealt once into ``groups`` (default: twice the shuffle partitions) by a hash of the id, and Spark reuses
    that exchange in three steps. (1) Every group names the distinct least seeds of its windows; a seed's bucket
    answers whether other documents have it. (2) Segments with shared seeds, each distinct one once per group,
    meet in the seed's bucket, where the suffixes whose first ``length`` bytes have a hash that occurs again are
    sorted over these bytes and longest previous factors tell which windows an earlier document has. (3) Groups look
    up the decisions for their segments. A passage that very many documents share thus arrives once from each group.
    """
    schema = "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary"
    return _removal(docs.select(*_dealt(id_col, text_col)), length, groups, _spans, schema)


def without_repeats(
    docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", groups: int | None = None
) -> DataFrame:
    """``docs`` with the passages found by :func:`repeated_passages` taken out of the texts.

    All rows and columns stay; a character of which any byte goes is taken out whole, and a null text becomes empty.
    """
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    dealt = docs.select(*_dealt(id_col, text_col), F.struct(*rest).alias("_row"))
    fields = [T.StructField("_row", dealt.schema["_row"].dataType), T.StructField("_text", T.StringType())]
    left = _removal(dealt, length, groups, _texts_left, T.StructType(fields))
    return left.select(
        *[F.col("_text").alias(c) if c == text_col else F.col(f"_row.`{c}`") for c in docs.columns]
    )


def _dealt(id_col: str, text_col: str) -> list:
    identity = F.col(id_col).cast("long")
    return [
        identity.alias("_id"),
        F.coalesce(identity, F.lit(int(NO_ID))).alias("_rank"),
        F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("_text"),
        F.xxhash64(identity, F.length(text_col)).alias("_group"),
    ]


def _removal(docs: DataFrame, length: int, groups: int | None, result, result_schema) -> DataFrame:
    buckets = groups or GROUPS_PER_PARTITION * shuffle_partitions(docs.sparkSession)
    dealt = docs.withColumn("_group", F.pmod("_group", F.lit(buckets)).cast("int")).repartition(buckets, "_group")
    blob = {n: "binary" for n in ("keys", "several", "shared", "text", "sizes", "ranks", "least", "masks")}

    def schema(*names):
        return ", ".join(f"{n} {blob.get(n, 'int')}" for n in names)

    announced = dealt.groupBy("_group").applyInArrow(
        _announce(length, buckets), schema("_bucket", "_group", "keys", "several")
    )
    answers = announced.groupBy("_bucket").applyInArrow(_answer, schema("_bucket", "_group", "shared"))
    proposed = (
        dealt.groupBy("_group")
        .cogroup(answers.groupBy("_group"))
        .applyInArrow(
            _propose(length, buckets), schema("_bucket", "_group", "shared", "text", "sizes", "keys", "ranks")
        )
    )
    decided = proposed.groupBy("_bucket").applyInArrow(
        _decide(length), schema("_group", "_bucket", "shared", "least", "masks")
    )
    return (
        dealt.groupBy("_group").cogroup(decided.groupBy("_group")).applyInArrow(_apply(length, buckets, result), result_schema)
    )
