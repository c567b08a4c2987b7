"""BPE encoding and decoding of whole texts, with tree concatenation of long unsplit text."""

import json
import re
from array import array
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Encoding, Tokenizer
from tokenizers.models import BPE
from tokenizers.pre_tokenizers import ByteLevel

# Bytes of a piece of unsplit text that is encoded at once; tokens on each side of a join re-encoded at first.
PIECE = 2048
FIRST_WINDOW = 4
CACHED_WORDS, CACHED_PIECES = 80_000, 200_000
# Texts that are split at a time: so many, or fewer of this many bytes together.
ROWS_AT_ONCE, BYTES_AT_ONCE = 256, 4 << 20


# The normalizer and the splitting of tokenizer files whose words this module can take apart itself.
KNOWN_NORMALIZER = {
    "type": "Sequence",
    "normalizers": [
        {"type": "NFC"},
        {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "},
        {"type": "Lowercase"},
    ],
}
KNOWN_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
# Words of printable ASCII and the letters of Latin-1, where those rules come down to lower case and this pattern.
_LETTERS = "a-zß-öø-ÿ"
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^{_LETTERS}0-9]+")


class TreeEncoder:
    """Encodes as a tokenizer of kind BPE with word ends does, word by word.

    White space (ASCII) always separates words here, and the tokenizer drops it, so words are encoded alone and
    remembered with their decoded text; words of common letters are taken apart into the tokenizer's pieces first, which
    many words share. Unsplit text longer than ``piece`` characters is halved down to that size, the
    halves are encoded in one parallel batch and joined up the tree, all joins of a level in one batch: around each a window
    of tokens is encoded again, growing until its first and last token are those that were there. Every pair of
    neighbours then occurs in some encoding, which makes the whole the encoding of the text.
    """

    def __init__(self, path: str, piece: int = PIECE):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path) as file:
            spec = json.load(file)
        self.path, self.suffix = path, spec["model"].get("end_of_word_suffix") or ""
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.tokens = {i: t for t, i in self.tokenizer.get_vocab(with_added_tokens=True).items()}
        self.piece = piece
        # Without a decoder the library joins the tokens by spaces; then words can be decoded alone.
        self.by_word = self.tokenizer.decoder is None
        self.cache: dict[bytes, tuple[bytes, str]] = {}
        self.pieces: dict[str, tuple[bytes, str]] = {}
        rules = spec.get("pre_tokenizer") or {}
        split, level = [*rules.get("pretokenizers", []), {}, {}][:2]
        known = (
            self.by_word
            and spec.get("normalizer") == KNOWN_NORMALIZER
            and (split.get("pattern"), split.get("behavior"), split.get("invert")) == ({"Regex": KNOWN_SPLIT}, "Removed", True)
            and (level.get("type"), level.get("add_prefix_space"), level.get("use_regex")) == ("ByteLevel", False, False)
            and len(rules["pretokenizers"]) == 2
        )
        self.plain = _PLAIN.fullmatch if known else lambda word: None
        self.marks = re.compile("|".join(map(re.escape, self.special)) or "(?!)").search
        # Letters as the byte-level alphabet writes their bytes.
        octets = ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {ord(c): octets.pre_tokenize_str(c)[0][0] for c in map(chr, range(0xC0, 0x100))}

    def encode(self, text: bytes) -> bytes:
        """Ids as packed 32-bit integers."""
        return self.encode_many([text])[0][0]

    def decode(self, ids: list[int]) -> str:
        """What the library's decode gives with special tokens kept."""
        if self.by_word:
            return " ".join([self.tokens[i] for i in ids if i in self.tokens])
        return self.tokenizer.decode(ids, skip_special_tokens=False)

    def _remembered(self, ids: list[int]) -> tuple[bytes, str]:
        return array("i", ids).tobytes(), self.decode(ids) if self.by_word else ""

    def encode_many(self, texts: list[bytes]) -> list[tuple[bytes, list[str]]]:
        """Of every text its packed ids and, where words can be decoded alone, their decoded texts."""
        split = [t.split() for t in texts]
        used = set().union(*split)
        fresh = [w for w in used if w not in self.cache]
        if len(self.cache) + len(fresh) > CACHED_WORDS:
            # Words in use just now are the likeliest to come again.
            self.cache = {w: self.cache[w] for w in used if w in self.cache}
        if len(self.pieces) > CACHED_PIECES:
            self.pieces.clear()
        others = []
        for word in fresh:
            if len(word) > self.piece:
                continue
            text = word.decode()
            if self.plain(text) and not self.marks(text):
                self.cache[word] = self._from_pieces(text)
            else:
                others.append((word, text))
        found = self.tokenizer.encode_batch_fast([text for _, text in others], add_special_tokens=False)
        for (word, _), encoding in zip(others, found, strict=True):
            self.cache[word] = self._remembered(encoding.ids)
        known = self.cache.__getitem__
        long = {w: self._remembered(self._unsplit(w.decode())) for w in fresh if len(w) > self.piece}
        if long:
            known = {**{w: self.cache[w] for w in used if w not in long}, **long}.__getitem__
        out = []
        for words in split:
            parts = list(map(known, words))
            out.append((b"".join([p[0] for p in parts]), [p[1] for p in parts if p[1]]))
        return out

    def _from_pieces(self, text: str) -> tuple[bytes, str]:
        """One word of plain letters by the tokenizer's pieces of it."""
        found = []
        for piece in _PIECES.findall(text.lower()):
            known = self.pieces.get(piece)
            if known is None:
                written = piece if piece.isascii() else piece.translate(self.letters)
                known = self.pieces[piece] = self._remembered([t.id for t in self.tokenizer.model.tokenize(written)])
            found.append(known)
        if len(found) == 1:
            return found[0]
        return b"".join([ids for ids, _ in found]), " ".join([decoded for _, decoded in found])

    def _unsplit(self, text: str) -> list[int]:
        """One long run without ASCII white space: special tokens, then the tokenizer's own pieces, then the tree."""
        ids: list[int] = []
        while text:
            found = [(text.find(s), -len(s), s) for s in self.special if s in text]
            at, _, special = min(found) if found else (len(text), 0, "")
            ids += self._plain(text[:at])
            if special:
                ids.append(self.tokenizer.token_to_id(special))
            text = text[at + len(special) :]
        return ids

    def _plain(self, text: str) -> list[int]:
        normal = self.tokenizer.normalizer.normalize_str(text) if self.tokenizer.normalizer else text
        split = self.tokenizer.pre_tokenizer.pre_tokenize_str(normal) if normal else []
        ids: list[int] = []
        for word, _ in split:
            ids += self.concatenate(word)
        return ids

    @cached_property
    def models(self) -> tuple[Tokenizer, Tokenizer]:
        """The merges for text that goes on and for the end of a word; only long unsplit text needs them."""
        with open(self.path) as file:
            model = json.load(file)["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        ends = BPE(vocab=model["vocab"], merges=merges, end_of_word_suffix=self.suffix or None)
        return Tokenizer(BPE(vocab=model["vocab"], merges=merges)), Tokenizer(ends)

    def _ids(self, texts: list[str], last: list[bool]) -> list[list[int]]:
        """Ids of pieces of a word, in one batch; ``last`` marks those that end it."""
        out: list[list[int]] = [[] for _ in texts]
        for end in (False, True):
            chosen = [i for i, x in enumerate(last) if x == end]
            if chosen:
                found: list[Encoding] = self.models[end].encode_batch_fast([texts[i] for i in chosen], add_special_tokens=False)
                for i, encoding in zip(chosen, found, strict=True):
                    out[i] = encoding.ids
        return out

    def _text(self, ids: list[int], last: bool) -> str:
        text = "".join(self.tokens[i] for i in ids)
        return text[: len(text) - len(self.suffix)] if last and self.suffix else text

    def concatenate(self, word: str) -> list[int]:
        """Encoding of one unsplit word by halves."""
        count = 1
        while len(word) > count * self.piece:
            count *= 2
        cuts = [len(word) * k // count for k in range(count + 1)]
        spans = [(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if a < b]
        level = self._ids([word[a:b] for a, b in spans], [b == len(word) for _, b in spans])
        while len(level) > 1:
            level = self._joined(level) + level[len(level) & ~1 :]
        return level[0] if level else []

    def _joined(self, level: list[list[int]]) -> list[list[int]]:
        """Neighbours of a level joined two by two."""
        pairs = list(zip(level[0::2], level[1::2]))
        done: list[list[int]] = [[] for _ in pairs]
        size, waiting = FIRST_WINDOW, list(range(len(pairs)))
        while waiting:
            texts, ends = [], []
            for k in waiting:
                left, right = pairs[k]
                a, b = min(size, len(left)), min(size, len(right))
                ends.append(2 * k + 2 == len(level) and b == len(right))
                texts.append(self._text(left[len(left) - a :] + right[:b], ends[-1]))
            still = []
            for k, window in zip(waiting, self._ids(texts, ends), strict=True):
                left, right = pairs[k]
                a, b = min(size, len(left)), min(size, len(right))
                agrees_left = a == len(left) or window[:1] == left[len(left) - a : len(left) - a + 1]
                agrees_right = b == len(right) or window[-1:] == right[b - 1 : b]
                if agrees_left and agrees_right:
                    done[k] = left[: len(left) - a] + window + right[b:]
                else:
                    still.append(k)
            size, waiting = size * 2, still
        return done


@lru_cache(maxsize=4)
def _encoder(path: str) -> TreeEncoder:
    return TreeEncoder(path)


def _parts(batch: pa.RecordBatch, column: int):
    """Slices of a batch of at most ``ROWS_AT_ONCE`` rows, cut earlier where they hold ``BYTES_AT_ONCE``."""
    sizes = np.array([len(x.as_buffer() or b"") if x.is_valid else 0 for x in batch.column(column)], np.int64)
    start, held = 0, 0
    for row, size in enumerate(sizes):
        if row > start and (row - start >= ROWS_AT_ONCE or held + size > BYTES_AT_ONCE):
            yield batch.slice(start, row - start)
            start, held = row, 0
        held += size
    if batch.num_rows > start:
        yield batch.slice(start)


def _lists(packed: list[bytes]) -> pa.ListArray:
    ends = np.cumsum([0, *(len(p) // 4 for p in packed)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(packed), np.int32)))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text")
    )


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, ids)`` for every row: the ids of the whole text without special tokens around it.

    ``tokenizer`` is the path of a tokenizer file on every executor. A null text is empty and gives an empty array;
    null and repeated ids stay. Other columns are not read. An empty table gives no rows.
    """
    rows = _texts(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        encoder = _encoder(tokenizer)
        for batch in batches:
            for part in _parts(batch, 1):
                ids = _lists([found for found, _ in encoder.encode_many(part.column(1).to_pylist())])
                yield pa.RecordBatch.from_arrays([part.column(0), ids], ["doc_id", "ids"])

    return rows.mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode(encoded: DataFrame, tokenizer: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(doc_id, ids, decoded)``: the text that the tokenizer's decode gives, special tokens included.

    Null ids count as none and decode to an empty text.
    """
    rows = encoded.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(ids_col), F.array()).alias("ids"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        encoder = _encoder(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                texts = [encoder.decode(ids.values.to_pylist()) for ids in part.column(1)]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"]
                )

    return rows.mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded string")


def encode_and_decode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, ids, decoded)``: what :func:`decode` gives of :func:`encode`, in one pass over the texts."""
    rows = _texts(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        encoder = _encoder(tokenizer)
        for batch in batches:
            for part in _parts(batch, 1):
                found = encoder.encode_many(part.column(1).to_pylist())
                ids = _lists([packed for packed, _ in found])
                if encoder.by_word:
                    texts = [" ".join(words) for _, words in found]
                else:
                    texts = [encoder.decode(row.values.to_pylist()) for row in ids]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), ids, pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"]
                )

    return rows.mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded string")
