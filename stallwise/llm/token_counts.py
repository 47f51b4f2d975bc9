"""Token counts by a count-only Viterbi search.

Pieces and scores of a vocabulary are taken as a unigram model. An Aho-Corasick automaton enumerates all pieces that end at each character; dynamic
programming keeps for each end only the best score and its number of pieces, no path. Ties go the tokenizer's way: of equal scores
the earlier start (the longer last piece) stays, as an edge only replaces a strictly worse one. A character that no piece of one character covers may
be unknown, at the lowest score less 10, and counts as its UTF-8 bytes (byte fallback). Scores are doubles.

Spaces become U+2581, one stands before a text that isn't empty. If no piece has U+2581 behind another character, as is usual, the best path
breaks before every run of it, so texts are cut there and each distinct word is searched once for each process (a cache of bounded size); else texts are
searched whole.

Defined results: null and empty texts have no tokens; repeated rows and null doc_ids are counted each; an empty table gives no row.
Only doc_id and text are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table, text_steps

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
#: Distinct words whose counts a process remembers.
CACHE = 500_000


class Counter:
    """pieces: (text, score) of all pieces that texts may be made of."""

    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        if pieces:
            self.automaton.make_automaton()
        self.single = {p for p, _ in pieces if len(p) == 1}
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        self.by_word = not any(SPACE in p.lstrip(SPACE) for p, _ in pieces)
        self.empty = not pieces
        self.known: dict[str, tuple[int, int, float]] = {}

    def search(self, text: str) -> tuple[int, int, float]:
        """(pieces, those of them that are bytes, score) of the best path."""
        n, none = len(text), float("-inf")
        best, count, fall = [0.0] + [none] * n, [0] * (n + 1), [0] * (n + 1)
        matches = iter(()) if self.empty else self.automaton.iter(text)
        end, value = next(matches, (n, None))
        for at, char in enumerate(text):
            to = at + 1
            # edges into `to` in the order of their starts: pieces from the longest to the shortest, then the unknown character
            while end == at:
                length, score = value
                total = best[to - length] + score
                if total > best[to]:
                    best[to], count[to], fall[to] = total, count[to - length] + 1, fall[to - length]
                end, value = next(matches, (n, None))
            if char not in self.single:
                total = best[at] + self.unknown
                if total > best[to]:
                    size = len(char.encode())
                    best[to], count[to], fall[to] = total, count[at] + size, fall[at] + size
        return count[n], fall[n], best[n]

    def __call__(self, text: str) -> tuple[int, int, float]:
        if not text:
            return 0, 0, 0.0
        text = SPACE + text.replace(" ", SPACE)
        if not self.by_word:
            return self.search(text)
        known, n, fell, total = self.known, 0, 0, 0.0
        if len(known) > CACHE:
            known.clear()
        for word in _WORD.findall(text):
            found = known.get(word)
            if found is None:
                found = known[word] = self.search(word)
            n, fell, total = n + found[0], fell + found[1], total + found[2]
        return n, fell, total


_WORD = re.compile(f"{SPACE}+[^{SPACE}]*")
_counters: dict[str, Counter] = {}


def pieces_of(path: str) -> list[tuple[str, float]]:
    """The pieces of a sentencepiece model file that texts are made of: no control, unknown, unused or byte pieces."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(m.IdToPiece(i), m.GetScore(i)) for i in range(m.GetPieceSize()) if not (m.IsControl(i) or m.IsUnknown(i) or m.IsUnused(i) or m.IsByte(i))]


def counter(path: str) -> Counter:
    """The one of this process, which later tasks use again."""
    if path not in _counters:
        _counters[path] = Counter(pieces_of(path))
    return _counters[path]


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, n_fallback (tokens that are bytes of unknown characters) and score (the best path's) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in batches:
            for a, b, data, at in text_steps(batch.column(1)):
                whole = data.tobytes()
                found = [count(whole[at[k] : at[k + 1]].decode()) for k in range(b - a)]
                columns = list(zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], ["doc_id", "n_tokens", "n_fallback", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, n_fallback long, score double")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op6_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), default_vocabulary())


QUERIES = {"op6_token_count": op6_token_count}
SQL: dict[str, str] = {}
