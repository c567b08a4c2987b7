"""Token counts of a unigram tokenizer without building the tokens: Aho-Corasick matches and a counting Viterbi."""

from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
# Added to the least score of the vocabulary for a character that no piece covers.
UNKNOWN_PENALTY = 10.0
CACHED_WORDS = 400_000
ROWS_AT_ONCE = 512


def byte_fallback(model_file: str) -> bool:
    """Whether a sentencepiece model has a piece for every byte."""
    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    return sum(map(model.IsByte, range(model.GetPieceSize()))) == 256


def vocabulary(model_file: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece model, in the order of their ids; its plain pieces only."""
    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    special = (model.IsControl, model.IsUnknown, model.IsByte, model.IsUnused)
    return [
        (model.IdToPiece(i), model.GetScore(i)) for i in range(model.GetPieceSize()) if not any(f(i) for f in special)
    ]


class Counter:
    """Number of pieces of the best segmentation, with the library's rule for ties.

    Going through the characters, every piece that ends at a place is tried from the longest to the shortest, that is
    by where it begins, and replaces the best so far only if its score is greater. A character without a piece of
    its own is unknown at the least score minus ``UNKNOWN_PENALTY``; neighbouring unknowns are one piece, or with
    ``fallback`` a piece for each of their bytes.
    """

    def __init__(self, pieces: list[tuple[str, float]], fallback: bool = False):
        self.fallback = fallback
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        self.cache: dict[str, int] = {}

    def count(self, word: str) -> int:
        """Pieces of one word, which starts with the mark of a space."""
        size = len(word)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(size + 1)]
        for last, (length, score) in self.automaton.iter(word):
            ends[last + 1].append((length, score))
        best = [0.0] + [None] * size
        number = [0] * (size + 1)
        unknown = [False] * (size + 1)
        for end in range(1, size + 1):
            single = False
            for length, score in sorted(ends[end], reverse=True):
                single |= length == 1
                start = end - length
                total = best[start] + score
                if best[end] is None or total > best[end]:
                    best[end], number[end], unknown[end] = total, number[start] + 1, False
            if not single:
                total = best[end - 1] + self.unknown
                if best[end] is None or total > best[end]:
                    best[end] = total
                    more = len(word[end - 1].encode()) if self.fallback else not unknown[end - 1]
                    number[end] = number[end - 1] + more
                    unknown[end] = True
        return number[size]

    def total(self, text: str) -> int:
        """Pieces of a whole text: each space is a mark that starts a word, and so is the text's beginning."""
        if not text:
            return 0
        count, cache = 0, self.cache
        for word in text.replace(SPACE, " ").removeprefix(" ").split(" "):
            found = cache.get(word)
            if found is None:
                found = self.count(SPACE + word)
                if len(cache) >= CACHED_WORDS:
                    cache.clear()
                cache[word] = found
            count += found
        return count


@lru_cache(maxsize=4)
def _counter(model_file: str) -> Counter:
    return Counter(vocabulary(model_file), byte_fallback(model_file))


def count_tokens(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_tokens)`` for every row: the number of pieces of the whole text in the unigram tokenizer that has
    the model file's pieces and scores; a character that no piece covers counts by its bytes if the file has byte pieces.

    The tokenizer replaces each space by a mark, puts one in front unless the text begins with it, and segments the words that
    the marks start one by one, so words are counted once and remembered. Null and empty texts have no tokens;
    null and repeated ids stay. Other columns are not read. An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        counter = _counter(model_file)
        for batch in batches:
            counts = np.array([counter.total(t.as_py()) for t in batch.column(1)], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts)], ["doc_id", "n_tokens"])

    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long")
