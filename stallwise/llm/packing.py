"""Packing of tokenised documents into fixed windows by minimum bin slack.

A document's ids are cut into full windows and one remainder. Remainders wait in a pool of bounded size as counts by
length. For each window the longest waiting remainder is set and a bitset subset-sum over the other lengths (one big
integer a step, bit s set if s tokens can be filled) finds the sum closest to the window's capacity; the steps are
walked back to get how many remainders of each length to take. Windows that this fills completely are written at
once. What no subset can fill stays in the pool; at the end of a task's rows it is cut into runs of powers of two,
which need no padding. There is no shuffle: each task packs its own rows, and a window never mixes tasks, so a lost
executor's tasks are simply run again.

Defined results: a null or empty text is the one token 1; rows come out piece by piece, repeated rows as often as they
stand in the input, null doc_ids are kept; an empty table gives no row. Only doc_id and text are read.
"""

from __future__ import annotations

import itertools
import re
from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table, text_steps

WINDOW = 2048
END_ID = 1
#: Remainders that wait in one task at most; the pool is emptied down to half of it when it is full.
POOL = 4096
#: Distinct chunks, and distinct words, whose ids a process remembers.
CACHE = 500_000
#: Stands between two chunks' ids. No ids hold it: each ends in a zero byte, as the vocabulary is below 2^24.
MARK = b"\xff\xff\xff\xff"
OUTPUT = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class ChunkTokenizer:
    """Ids of whole texts from the ids of their space-separated chunks.

    The tokenizer drops white space before it forms words, so no word spans two chunks and the ids of a text are its
    chunks' ids in order. Chunks repeat, so most are looked up: each distinct one of a call once, by Arrow's dictionary,
    and numpy sets the ids of all in order. A new chunk of Latin-1 characters is cut into its words by
    the tokenizer's own rule; words not seen yet are tokenised together, as one text whose ids fall into words at
    the vocabulary's end-of-word marks. Any other chunk (other characters, special tokens) is tokenised as it is.
    """

    #: The tokenizer's word rule, for lower-cased characters up to U+00FF. Fixed values.
    WORD = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼-¾]|[^\t\n\x0b\x0c\r \x85\xa0a-zªµºß-öø-ÿ0-9²³¹¼-¾]+")
    WORD_OR_SPACE = re.compile(f"{WORD.pattern}| ")
    WIDE = re.compile("[^\x00-\xff]")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[k for word, k in vocabulary.items() if word.endswith("</w>")]] = True
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.chunks: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn_words(self, new: list[str]) -> None:
        for a in range(0, len(new), 4096):
            part = new[a : a + 4096]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(part) and (not len(ids) or ends[-1] == len(ids)):
                whole, at = ids.tobytes(), 0
                for word, to in zip(part, (4 * ends).tolist(), strict=True):
                    self.words[word] = whole[at:to]
                    at = to
            else:
                self.words.update((w, self._whole(w)) for w in part)

    def _plain(self, chunk: str) -> bool:
        return (chunk.isascii() or not self.WIDE.search(chunk)) and ("<|" not in chunk or not any(s in chunk for s in self.special))

    def _learn(self, new: list[str]) -> None:
        """All new chunks are cut into words in one pass; a mark stands for each space between them, at which their ids are cut again."""
        cut = [c for c in new if self._plain(c)]
        if len(cut) < len(new):
            self.chunks.update((c, self._whole(c)) for c in set(new).difference(cut))
        if not cut:
            return
        words = self.WORD_OR_SPACE.findall(" ".join(cut).lower())
        self._learn_words(list(set(words).difference(self.words, " ")))
        self.words[" "] = MARK
        self.chunks.update(zip(cut, b"".join(map(self.words.__getitem__, words)).split(MARK), strict=True))

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (large strings without nulls), end to end, and each text's offset in them."""
        if len(self.chunks) > CACHE:
            self.chunks.clear()
        if len(self.words) > CACHE:
            self.words.clear()
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        chunks = lists.flatten().dictionary_encode()
        own = chunks.dictionary.to_numpy(zero_copy_only=False).tolist()  # some eight times as fast as to_pylist
        self._learn(list(set(own).difference(self.chunks)))
        parts = list(map(self.chunks.__getitem__, own))
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        code = np.asarray(chunks.indices)
        size, ends = sizes[code], np.zeros(len(code) + 1, np.int64)
        np.cumsum(size, out=ends[1:])
        first = (np.cumsum(sizes) - sizes)[code] - ends[:-1]
        ids = np.frombuffer(b"".join(parts), "<u4")[np.repeat(first, size) + np.arange(ends[-1])]
        return ids, ends[np.cumsum([0, *pc.list_value_length(lists).to_pylist()])]

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        ids, at = self.ids(pa.array(texts, pa.large_string()))
        return [ids[a:b].tobytes() for a, b in itertools.pairwise(at.tolist())]


_tokenizers: dict[str, ChunkTokenizer] = {}


def tokenizer(path: str) -> ChunkTokenizer:
    """The one of this process, which later tasks use again."""
    if path not in _tokenizers:
        _tokenizers[path] = ChunkTokenizer(path)
    return _tokenizers[path]


def fill(counts: dict[int, int], capacity: int) -> list[int]:
    """Lengths from counts (length -> how many) whose sum is as close to capacity as any subset comes, never above.

    Lengths are added from the longest to the shortest, each in binary groups (1, 2, 4, ... pieces), until the capacity
    itself can be reached.
    """
    reach, steps = 1, []
    mask, goal = (1 << (capacity + 1)) - 1, 1 << capacity
    for length in sorted([k for k in counts if k <= capacity], reverse=True):
        left = min(counts[length], capacity // length)
        size = 1
        while left:
            take = min(size, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left, size = left - take, size * 2
            if reach & goal:
                break
        if reach & goal:
            break
    at, taken = reach.bit_length() - 1, []
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            taken += [length] * take
            at -= length * take
    return taken


class Packer:
    """Windows of one task: add documents, then finish."""

    def __init__(self, window: int, first_sequence: int, pool: int = POOL):
        self.window, self.sequence, self.most = window, first_sequence, pool
        self.waiting: dict[int, deque] = defaultdict(deque)
        self.counts: dict[int, int] = {}
        self.n = 0

    def add(self, doc_id, ids: bytes) -> Iterator[tuple]:
        total = len(ids) // 4
        full = total // self.window * self.window
        for start in range(0, full, self.window):
            yield self._piece((doc_id, start, ids[4 * start : 4 * (start + self.window)], total), 0)
            self.sequence += 1
        if total > full:
            length = total - full
            self.waiting[length].append((doc_id, full, ids[4 * full :], total))
            self.counts[length] = self.counts.get(length, 0) + 1
            self.n += 1
        if self.n >= self.most:
            yield from self._windows(self.most // 2)

    def _piece(self, held: tuple, offset: int) -> tuple:
        doc_id, start, ids, total = held
        return doc_id, start, len(ids) // 4, ids, total, self.sequence, offset

    def _take(self, length: int) -> tuple:
        self.n -= 1
        self.counts[length] -= 1
        if not self.counts[length]:
            del self.counts[length]
        return self.waiting[length].popleft()

    def _windows(self, down_to: int) -> Iterator[tuple]:
        """Full windows, until down_to remainders wait or none of the longest can be completed."""
        aside: dict[int, int] = {}  # lengths with no exact complement among what waits
        while self.n > down_to and self.counts:
            longest = max(self.counts)
            others = dict(self.counts)
            others[longest] -= 1
            if not others[longest]:
                del others[longest]
            chosen = [longest, *fill(others, self.window - longest)]
            if sum(chosen) < self.window:
                aside[longest] = self.counts.pop(longest)
                continue
            offset = 0
            for length in chosen:
                held = self._take(length)
                yield self._piece(held, offset)
                offset += length
            self.sequence += 1
        for length, n in aside.items():
            self.counts[length] = self.counts.get(length, 0) + n
        if self.n >= self.most:  # nothing exact is left: free the pool
            yield from self._cut()

    def _cut(self) -> Iterator[tuple]:
        """All that waits, end to end, in full windows and then runs of powers of two, which are not padded."""
        rest = [held for length in sorted(self.waiting, reverse=True) for held in self.waiting[length]]
        self.waiting.clear()
        self.counts.clear()
        self.n = 0
        left = sum(len(held[2]) // 4 for held in rest)
        room, offset = 0, 0
        for doc_id, start, ids, total in rest:
            at, n = 0, len(ids) // 4
            while at < n:
                if not room:
                    room = self.window if left >= self.window else 1 << (left.bit_length() - 1)
                    offset = 0
                take = min(room, n - at)
                yield self._piece((doc_id, start + at, ids[4 * at : 4 * (at + take)], total), offset)
                at, offset, room, left = at + take, offset + take, room - take, left - take
                if not room:
                    self.sequence += 1

    def finish(self) -> Iterator[tuple]:
        yield from self._windows(0)
        yield from self._cut()


def _packer(tokenizer_path: str, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenize = tokenizer(tokenizer_path)
        packer = Packer(window, (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40)
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            ids = batch.column(0)
            for a, b, data, at in text_steps(batch.column(1)):
                found, cuts = tokenize.ids(pa.LargeStringArray.from_buffers(b - a, pa.py_buffer(np.ascontiguousarray(at)), pa.py_buffer(data)))
                rows = []
                for doc_id, (first, to) in zip(ids[a:b].to_pylist(), itertools.pairwise(cuts.tolist()), strict=True):
                    rows += packer.add(doc_id, found[first:to].tobytes() + end)
                yield _batch(rows)
        rows = []
        for row in packer.finish():
            rows.append(row)
            if len(rows) == 2048:
                yield _batch(rows)
                rows = []
        yield _batch(rows)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * 7
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW) -> DataFrame:
    """The pieces of all documents: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    Every token of a document, its end token included, is in exactly one piece; in each sequence the pieces stand
    gapless from offset 0. A sequence is full, or its length is a power of two.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    return rows.mapInArrow(_packer(tokenizer_path, window), OUTPUT)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(table(spark, sf_dir, "documents"), default_tokenizer())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


QUERIES = {"op7_pack": op7_pack}
SQL: dict[str, str] = {}
