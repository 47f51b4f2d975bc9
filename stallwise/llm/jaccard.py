"""N-gram Jaccard join: exact near-duplicate links between whole texts, and their connected components.

A document's set is its distinct word shingles, as 64-bit hashes. Documents with equal sets are one class (a 64-bit hash
of the set), told apart by nothing that follows, so copies never meet one another. The classes are joined:

1. Frequencies: one pass counts shingles in a sketch of fixed size (``CELLS`` counters); a shingle's rank is (log2 of its counter,
   hash), rare ones first. Any fixed order gives the same links; this one keeps frequent shingles out of the tiles.
2. Tiles: two sets with Jaccard j >= threshold t share one of their first n - ceil(t n) + 1 shingles in that order. These
   go, as packed arrays, to the tile of the shingle, with their place in the order. A tile is kept sorted by set size; only
   pairs whose sizes allow t, and whose places leave enough shingles behind them, are paired. A tile of up to ``SMALL`` classes gives
   all such pairs; a larger one gives neighbours in size and pairs with the leaders of a class's own and the next smaller
   size band, a number in proportion to its classes.
3. Bitmaps: each class has a bitmap of hashed bits, as wide as its size band asks (four bits and more a shingle); a wide one folds to
   the width of a narrow one. With x the bits in which two bitmaps differ, the intersection is at most (n1 + n2 - x) / 2; pairs
   whose bound is too small are gone.
4. The rest is intersected exactly, as sorted arrays: first each class with its smallest partners, then the pairs that still stand
   between components. Links become components by repeated contraction to minimum neighbours.
5. In tiles beyond ``SMALL``, pairs of classes that are in different components by now are tried as well: such a tile is cut into a
   grid of cells, by size band (own and next) and by blocks, so that a hot tile is spread over many tasks. Classes travel packed, some
   ``BLOCK`` in a row, three times for each block of the tile, of which there are ``STRIPS`` until blocks hold ``WIDE`` classes. A cell
   gives a pair only if it is the first tile that its classes share, and only if places and bitmaps allow it. These pairs go
   through 3 and 4; classes in one component need no further proof. First one pair for each two components of a cell is tried, then
   all that are left between components. So no link is lost.

``jaccard_components`` gives one row for each document: doc_id, n_shingles, component_id (the smallest doc_id reachable by links).
``jaccard_links`` gives every link, as pairs of classes, and the documents' classes; there nothing is left out for standing in one
component. Intermediate tables are written under spark.checkpoint.dir, and dropped when nothing reads them any more; no list of
links or components comes to the driver.

Defined results: A-Z are lower-cased; words are runs of other than ASCII white space; a text of 1 to 4 words is one shingle; null, empty
and blank texts have none, link with nothing and are their own component; repeated rows are linked copies, given each; null
doc_ids take part and get the smallest id of their component (null if there is none); a doc_id on rows of different texts
belongs to each one's component. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Workspace, hashed_words, mix, table, text_steps

WORDS = 5
#: The threshold as a fraction: 3 / 4.
NUM, DEN = 3, 4
CELLS = 1 << 22
#: Bytes of a chunk in which tasks send what they have counted, and groups of tasks that are added up first.
CHUNK, GROUPS = 1 << 16, 64
#: Bits of a bitmap, at least and at most.
BITS, MOST_BITS = 1 << 10, 1 << 20
SMALL = 16
#: Classes of a block of a large tile, on average; up to STRIPS blocks a tile, beyond which blocks grow to WIDE classes before they grow in number.
BLOCK, STRIPS, WIDE = 1024, 8, 16384
#: Bits of a bitmap in a cell at most: enough for four a shingle in texts of 2,000 words.
CELL_BITS = 1 << 13
#: Links between what remains of components that one task unites.
LAST = 20_000
#: Postings that one task sorts, on average.
TASK_POSTINGS = 1_000_000
BUCKETS = 2048
#: Bits of the filter of classes, at least and at most: it is broadcast.
BLOOM, MOST_BLOOM = 1 << 16, 1 << 29
_Q = np.array([pow(0xA0761D6478BD642F, k, 1 << 64) for k in range(WORDS)], np.uint64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash), distinct and sorted by row and hash, of all shingles of the rows."""
    h, row, _, _ = hashed_words(data, offsets)
    n, n_rows = len(h), len(offsets) - 1
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    per = np.bincount(row, minlength=n_rows)
    whole = h * _Q[0]
    for k in range(1, WORDS):
        whole[:-k] += h[k:] * _Q[k]  # sums over row ends are left out below, or cut for short rows
    keep = np.zeros(n, bool)
    if n >= WORDS:
        keep[: n - WORDS + 1] = row[: n - WORDS + 1] == row[WORDS - 1 :]
    rows, keys = row[keep], mix(whole[keep])
    for length in range(1, WORDS):
        short = np.flatnonzero(per == length)
        if len(short):
            first = np.searchsorted(row, short)
            sums = sum(h[first + k] * _Q[k] for k in range(length))
            rows, keys = np.concatenate((rows, short)), np.concatenate((keys, mix(sums + np.uint64(length))))
    order = np.lexsort((keys, rows))
    rows, keys = rows[order], keys[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (keys[1:] != keys[:-1])
    return rows[new], keys[new]


def _classes(rows: np.ndarray, keys: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set sizes, class ids, where each row's keys begin); the id is a hash of the whole set."""
    n = np.bincount(rows, minlength=n_rows)
    at = np.concatenate(([0], np.cumsum(n)))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(keys ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)))
    return n, mix((total[at[1:]] - total[at[:-1]]) ^ (n.astype(np.uint64) << np.uint64(40))).view(np.int64), at


def prefix_length(n):
    """How many of n ordered shingles can hold the first common one: n - ceil(NUM n / DEN) + 1."""
    return n - (NUM * n + DEN - 1) // DEN + 1


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, n, node of every row; the bitmap goes along with a class's first row in the task."""
    seen = np.zeros(0, np.int64)
    for batch in batches:
        for a, b, data, offsets in text_steps(batch.column(1)):
            rows, keys = shingle_sets(data, offsets)
            n, node, at = _classes(rows, keys, b - a)
            fresh = _fresh(node, n, seen)
            seen = np.union1d(seen, node[fresh])
            bits = [bitmap(keys[at[r] : at[r + 1]]).tobytes() if fresh[r] else None for r in range(b - a)]
            yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(n), pa.array(node), pa.array(bits, pa.binary())], ["doc_id", "n", "node", "bits"])


def _fresh(node: np.ndarray, n: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Which rows are the first of their class, with a set, and not among the classes seen."""
    fresh = np.zeros(len(node), bool)
    fresh[np.unique(node, return_index=True)[1]] = True
    return fresh & (n > 0) & ~np.isin(node, seen)


def _in_chunks(x: np.ndarray) -> pa.RecordBatch:
    """An array of bytes as rows (chunk, part, blob); part is one of GROUPS groups of tasks."""
    chunks = [x[a : a + CHUNK].tobytes() for a in range(0, len(x), CHUNK)]
    part = np.full(len(chunks), TaskContext.get().partitionId() % GROUPS, np.int32)
    return pa.RecordBatch.from_arrays([pa.array(range(len(chunks)), pa.int32()), pa.array(part), pa.array(chunks, pa.binary())], ["chunk", "part", "blob"])


def _merged(made: DataFrame, kind, into, add) -> DataFrame:
    """(chunk, blob) of all tasks' chunks put together: first within groups of tasks, so that no task receives the chunks of all."""

    def run(read):
        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[tuple[int, int], np.ndarray] = {}
            for batch in batches:
                for chunk, part, blob in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                    x = np.frombuffer(blob, read)
                    at = (chunk, part)
                    held[at] = add(held[at], x) if at in held else x.astype(into)
            for chunk, part in sorted(held):
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([part], pa.int32()), pa.array([held[chunk, part].tobytes()], pa.binary())], ["chunk", "part", "blob"])

        return merge

    out = "chunk int, part int, blob binary"
    first = made.repartition("chunk", "part").mapInArrow(run(kind), out)
    return first.withColumn("part", F.lit(0)).repartition("chunk").mapInArrow(run(into), out).select("chunk", "blob")


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One task's counters, each held to 255: enough for an order, and small to send."""
    cells = np.zeros(CELLS, np.int32)
    for batch in batches:
        for _, _, data, offsets in text_steps(batch.column(0)):
            keys, n = np.unique((shingle_sets(data, offsets)[1] % np.uint64(CELLS)).astype(np.int32), return_counts=True)
            cells[keys] += n.astype(np.int32)
    yield _in_chunks(np.minimum(cells, 255).astype(np.uint8))


def _ranks(texts: DataFrame) -> np.ndarray:
    """For each counter, the log2 of what it has beyond chance: 0 for counters within 2.5 deviations of the median. CELLS bytes."""
    total = np.zeros(CELLS, np.float32)
    for chunk, blob in _merged(texts.mapInArrow(_sketch, "chunk int, part int, blob binary"), np.uint8, np.float32, np.add).collect():  # 4 * CELLS bytes in all
        total[chunk * CHUNK : (chunk + 1) * CHUNK] = np.frombuffer(bytes(blob), np.float32)
    usual = float(np.median(total))
    return np.log2(np.maximum(total - usual - 2.5 * usual**0.5, 1)).astype(np.uint8)


def packed_place(place: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The place of a shingle in its class's prefix in one byte, rounded down."""
    return (place * 256 // prefix_length(n)).astype(np.uint8)


def least_place(packed: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The smallest place that packs to this byte."""
    return -(-packed.astype(np.int64) * prefix_length(n.astype(np.int64)) // 256)


def places_allow(left, n, other):
    """Whether left shingles from the first common one on, out of n, can be enough for a link with a set of the other size."""
    return (NUM + DEN) * left >= NUM * (n + other)


def _postings(sent, buckets: int):
    """Packed prefixes: for each bucket a blob of (ranked shingle, class, size, place)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, seen = sent.value, np.zeros(0, np.int64)
        for batch in batches:
            held = []
            for a, b, data, offsets in text_steps(batch.column(0)):
                rows, keys = shingle_sets(data, offsets)
                n, node, _ = _classes(rows, keys, b - a)
                fresh = _fresh(node, n, seen)  # a copy of what this task has had adds nothing
                seen = np.union1d(seen, node[fresh])
                here = fresh[rows]
                rows, keys = rows[here], keys[here]
                ranked = (rank[(keys % np.uint64(CELLS)).astype(np.int64)].astype(np.uint64) << np.uint64(58)) | (keys >> np.uint64(6))
                order = np.lexsort((ranked, rows))
                rows, ranked = rows[order], ranked[order]
                place = np.arange(len(rows)) - np.searchsorted(rows, rows)
                keep = place < prefix_length(n)[rows]
                rows, place = rows[keep], place[keep]
                held.append((ranked[keep], node[rows], n[rows].astype(np.int32), packed_place(place, n[rows])))
            if not held:
                continue
            ranked, node, n, place = (np.concatenate([x[k] for x in held]) for k in range(4))
            bucket = (mix(ranked) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            ranked, node, n, place, bucket = ranked[order], node[order], n[order], place[order], bucket[order]
            there, at = np.unique(bucket, return_index=True)
            ends = np.append(at[1:], len(bucket))
            for a in range(0, len(there), 512):
                blobs = [[x[i:j].tobytes() for i, j in zip(at[a : a + 512], ends[a : a + 512], strict=True)] for x in (ranked, node, n, place)]
                yield pa.RecordBatch.from_arrays([pa.array(there[a : a + 512].astype(np.int32)), *(pa.array(x, pa.binary()) for x in blobs)], ["bucket", "shingles", "nodes", "sizes", "places"])

    return run


def band(n: np.ndarray) -> np.ndarray:
    """Size band: in one band, the smaller of two sizes is over NUM / DEN of the larger, or nearly."""
    return np.floor(np.log(np.maximum(n, 1)) / np.log(DEN / NUM)).astype(np.int64)


def tile_pairs(shingle: np.ndarray, node: np.ndarray, n: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first, second, whether one leads, rows of large tiles): pairs of classes as indices, and indices of postings in tiles beyond SMALL.

    The postings are sorted by shingle, size and class, without repeats; place is the least place of the shingle in its class.
    """
    size = len(shingle)
    new = np.ones(size, bool)
    new[1:] = shingle[1:] != shingle[:-1]
    group = np.cumsum(new) - 1
    members = np.bincount(group)[group] if size else group
    left, right, leads, n = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)], n.astype(np.int64)

    def pair(i, j, lead=False):
        fit = (DEN * n[i] >= NUM * n[j]) & places_allow(n[i] - place[i], n[i], n[j]) & places_allow(n[j] - place[j], n[j], n[i])
        left.append(i[fit])
        right.append(j[fit])
        leads.append(np.full(len(left[-1]), lead))

    for d in range(1, SMALL):
        i = np.flatnonzero((group[d:] == group[:-d]) & ((members[d:] <= SMALL) | (d <= 2)))
        if len(i):
            pair(i, i + d)
    large = np.flatnonzero(members > SMALL)
    if len(large):
        b = band(n[large])
        start = np.ones(len(large), bool)
        start[1:] = (b[1:] != b[:-1]) | (group[large][1:] != group[large][:-1])
        run = np.cumsum(start) - 1
        leader = large[start]
        pair(leader[run], large, True)
        back = run > 0
        same = back & (group[leader[np.maximum(run - 1, 0)]] == group[large])
        pair(leader[run[same] - 1], large[same], True)
    i, j, lead = np.concatenate(left), np.concatenate(right), np.concatenate(leads)
    differ = node[i] != node[j]
    return i[differ], j[differ], lead[differ], large


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (kind 0: whether one leads, a < b with their sizes) and postings of large tiles (kind 1: shingle, class, size, least place)."""
    held = [[np.frombuffer(b"".join(batch.column(k).to_pylist()), t) for k, t in ((1, np.uint64), (2, np.int64), (3, np.int32), (4, np.uint8))] for batch in batches]
    if not held:
        return
    posts = [np.concatenate([x[k] for x in held]) for k in range(4)]
    del held

    def take(rows: np.ndarray) -> tuple[np.ndarray, ...]:
        posts[:] = [x[rows] for x in posts]
        return tuple(posts)

    shingle, node, n, place = take(np.argsort(posts[0], kind="stable"))
    alone = np.ones(len(shingle), bool)
    alone[1:] &= shingle[1:] != shingle[:-1]
    alone[:-1] &= shingle[1:] != shingle[:-1]
    shingle, node, n, place = take(~alone)
    shingle, node, n, place = take(np.lexsort((node, n, shingle)))
    new = np.ones(len(shingle), bool)
    new[1:] = (shingle[1:] != shingle[:-1]) | (node[1:] != node[:-1])
    shingle, node, n, place = take(new)
    place = least_place(place, n)
    i, j, lead, large = tile_pairs(shingle, node, n, place)
    swap = node[i] > node[j]
    i, j = np.where(swap, j, i), np.where(swap, i, j)
    order = np.lexsort((~lead, node[j], node[i]))
    i, j, lead = i[order], j[order], lead[order]
    new = np.ones(len(i), bool)
    new[1:] = (node[i][1:] != node[i][:-1]) | (node[j][1:] != node[j][:-1])
    i, j, lead = i[new], j[new], lead[new].astype(np.int64)
    names = ["kind", "x", "a", "b", "na", "nb"]
    for s in range(0, len(i), 1 << 16):
        p, q = i[s : s + (1 << 16)], j[s : s + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(p), np.int32)), pa.array(lead[s : s + (1 << 16)]), pa.array(node[p]), pa.array(node[q]), pa.array(n[p]), pa.array(n[q])], names)
    for s in range(0, len(large), 1 << 16):
        p = large[s : s + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(p), np.int32)), pa.array(shingle[p].view(np.int64)), pa.array(node[p]), pa.array(place[p]), pa.array(n[p]), pa.array(np.zeros(len(p), np.int32))], names)


# Proof of pairs --------------------------------------------------------------------------------------------------


def bitmap(keys: np.ndarray) -> np.ndarray:
    """Bits, each the parity of the keys hashed to it: a power of two, four times the keys and more, within BITS and MOST_BITS."""
    width = min(max(BITS, 1 << (4 * len(keys) - 1).bit_length()), MOST_BITS)
    return np.packbits(np.bincount((keys & np.uint64(width - 1)).astype(np.int64), minlength=width).astype(np.uint8) & 1)


def folded(bits: np.ndarray, n_bytes: int) -> np.ndarray:
    """Bitmaps (rows of bytes) at a smaller width: the parities of the bits that fall together."""
    while bits.shape[1] > n_bytes:
        half = bits.shape[1] // 2
        bits = bits[:, :half] ^ bits[:, half:]
    return bits


def _bloom(nodes: DataFrame, count: int) -> np.ndarray:
    """A filter of the classes in pairs, 16 bits for each up to MOST_BLOOM; what it lets through wrongly, the joins drop.

    A class, a hash, has the bit of its last digits. Spark's bitmap aggregate makes the filter in pieces, each once for all tasks.
    """
    n_bits = min(max(BLOOM, 1 << (16 * count - 1).bit_length()), MOST_BLOOM)
    at = F.col("node").bitwiseAND(F.lit(n_bits - 1)) + 1  # the aggregate counts from 1
    pieces = nodes.groupBy(F.bitmap_bucket_number(at).alias("piece")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    out = np.zeros(n_bits // 8, np.uint8)
    for piece, bits in pieces.collect():  # n_bits / 8 bytes in all
        out[(piece - 1) * len(bits) : piece * len(bits)] = np.frombuffer(bytes(bits), np.uint8)
    return out


def _passes(bloom: np.ndarray, node: np.ndarray) -> np.ndarray:
    at = node & np.int64(8 * len(bloom) - 1)
    return (bloom[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def _sets(sent):
    """Each class of the filter once for each task, with its sorted set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom, seen = sent.value, np.zeros(0, np.int64)
        for batch in batches:
            for a, b, data, offsets in text_steps(batch.column(0)):
                rows, keys = shingle_sets(data, offsets)
                n, node, at = _classes(rows, keys, b - a)
                found = np.flatnonzero(_fresh(node, n, seen) & _passes(bloom, node))
                seen = np.union1d(seen, node[found])
                made = [keys[at[r] : at[r + 1]].tobytes() for r in found]
                yield pa.RecordBatch.from_arrays([pa.array(node[found]), pa.array(made, pa.binary())], ["node", "made"])

    return run


def _filtered(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_passes(sent.value, np.asarray(batch.column(0)))))

    return run


def _ends(pairs: DataFrame) -> tuple[DataFrame, int]:
    """The classes in written pairs, and how many at most."""
    return pairs.select(F.explode(F.array("a", "b")).alias("node")), 2 * pairs.count()


def _with_both(pairs: DataFrame, made: DataFrame, *columns: str) -> DataFrame:
    made = made.dropDuplicates(["node"])
    side = lambda k: made.select(F.col("node").alias(k), F.col("made").alias(f"made_{k}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", *columns, "made_a", "made_b")


def bound(bits_a: np.ndarray, bits_b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """The largest intersection that the bitmaps (rows of bytes) allow."""
    n_bytes = min(bits_a.shape[1], bits_b.shape[1])
    return (na + nb - np.bitwise_count(folded(bits_a, n_bytes) ^ folded(bits_b, n_bytes)).sum(axis=1).astype(np.int64)) // 2


def linked(common: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    return DEN * common >= NUM * (na + nb - common)


def _bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        na, nb = np.asarray(batch.column("na")).astype(np.int64), np.asarray(batch.column("nb")).astype(np.int64)
        x, y = batch.column("made_a").to_pylist(), batch.column("made_b").to_pylist()
        width = np.array([[len(p), len(q)] for p, q in zip(x, y, strict=True)], np.int64).reshape(-1, 2)
        good = np.zeros(len(na), bool)
        for wx, wy in np.unique(width, axis=0):  # a few widths
            rows = np.flatnonzero((width == (wx, wy)).all(axis=1))
            bits = [np.frombuffer(b"".join(z[r] for r in rows), np.uint8).reshape(-1, w) for z, w in ((x, wx), (y, wy))]
            good[rows] = linked(bound(*bits, na[rows], nb[rows]), na[rows], nb[rows])
        yield batch.select(["a", "b", "lead"]).filter(pa.array(good))


def _narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bitmaps folded to CELL_BITS bits at most."""
    for batch in batches:
        x = [folded(np.frombuffer(b, np.uint8)[None], CELL_BITS // 8).tobytes() for b in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.binary())], ["node", "bits"])


class Bitmaps:
    """Bitmaps of several widths, each also folded to the smaller widths that occur."""

    def __init__(self, blobs: list[bytes]):
        self.width = np.array([len(b) for b in blobs], np.int64)
        self.rows, self.bits = np.zeros((0, 0), np.int64), {}
        widths = np.unique(self.width)
        self.rows = np.zeros((len(widths), len(blobs)), np.int64)
        self.kind = np.searchsorted(widths, self.width)
        for k, w in enumerate(widths):
            wide = np.flatnonzero(self.width >= w)
            self.rows[k, wide] = np.arange(len(wide))
            x = np.empty((len(wide), w), np.uint8)
            for v in widths[k:]:
                own = np.flatnonzero(self.width[wide] == v)
                x[own] = folded(np.frombuffer(b"".join(blobs[r] for r in wide[own]), np.uint8).reshape(-1, v), w)
            self.bits[k] = x.view(np.uint64)

    def differing(self, i: int, j: np.ndarray) -> np.ndarray:
        """In how many bits row i differs from each of the rows j, at the smaller of two widths."""
        out, kind = np.empty(len(j), np.int64), np.minimum(self.kind[i], self.kind[j])
        for k in np.unique(kind):
            at = np.flatnonzero(kind == k)
            x = self.bits[k]
            out[at] = np.bitwise_count(x[self.rows[k, i]] ^ x[self.rows[k, j[at]]]).sum(axis=1, dtype=np.int64)
        return out


def _cells(once: bool):
    """The pairs of one cell of a large tile: classes of side 0 with classes of side 1, in the same band or the next. A row holds a block's classes, or a part of them.

    once: of all pairs between the same two components, only the one whose bitmaps allow the most.
    """

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        shingle, packed = key[0].as_py(), rows.column("classes").combine_chunks()
        each, per = packed.flatten(), packed.value_lengths().to_numpy()
        side, band_ = (np.repeat(rows.column(k).to_numpy(), per) for k in ("side", "band"))
        node, n, place, label = (each.field(k).to_numpy() for k in ("node", "n", "place", "label"))
        n, own, earlier = n.astype(np.int64), each.field("own"), {}
        left, right, found = np.flatnonzero(side == 0), np.flatnonzero(side == 1), {}
        bits = Bitmaps(each.field("bits").to_pylist()) if len(left) and len(right) else None

        def before(i: int) -> set[int]:
            """The class's open tiles that come before this one."""
            if i not in earlier:
                earlier[i] = {x for x in own[i].as_py() if x < shingle}
            return earlier[i]

        for i in left.tolist() if len(right) else ():
            j = right[(label[right] != label[i]) & ((band_[right] > band_[i]) | (node[right] > node[i]))]
            j = j[(DEN * np.minimum(n[i], n[j]) >= NUM * np.maximum(n[i], n[j])) & places_allow(n[i] - place[i], n[i], n[j]) & places_allow(n[j] - place[j], n[j], n[i])]
            if not len(j):
                continue
            most = (n[i] + n[j] - bits.differing(i, j)) // 2
            fit = linked(most, n[i], n[j])
            for k, m in zip(j[fit].tolist(), most[fit].tolist(), strict=True):
                at = (min(label[i], label[k]), max(label[i], label[k])) if once else (i, k)
                if (at not in found or found[at] < (m, i, k)) and before(i).isdisjoint(before(k)):
                    found[at] = (m, i, k)
        i, j = np.array([(i, k) for _, i, k in found.values()], np.int64).reshape(-1, 2).T
        i, j = np.where(node[i] < node[j], i, j), np.where(node[i] < node[j], j, i)
        return pa.table({"a": node[i], "b": node[j], "lead": np.zeros(len(i), np.int64), "na": n[i].astype(np.int32), "nb": n[j].astype(np.int32)})

    return run


def _proven(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        good = []
        for x, y in zip(batch.column("made_a"), batch.column("made_b"), strict=True):
            p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            if len(p) > len(q):
                p, q = q, p
            at = np.minimum(np.searchsorted(q, p), len(q) - 1)
            common = int((q[at] == p).sum())
            good.append(bool(linked(np.int64(common), np.int64(len(p)), np.int64(len(q)))))
        yield batch.select(batch.schema.names[:-2]).filter(pa.array(good, pa.bool_()))


class Join:
    """The tables of one join: docs' texts, and what is written on the way."""

    def __init__(self, docs: DataFrame, ws: Workspace | None):
        self.spark, self.ws = docs.sparkSession, ws or Workspace(docs.sparkSession, "jaccard")
        self.texts = docs.select("text")
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        self.nodes = self.ws.write(rows.mapInArrow(_nodes, "doc_id long, n long, node long, bits binary"), "nodes")

    def tiles(self) -> tuple[DataFrame, DataFrame]:
        """(pairs a, b, lead, na, nb, distinct; shingle, node, n, place of the large tiles)."""
        postings = self.nodes.filter("bits is not null").agg(F.sum(F.floor(F.col("n") / DEN) + 1)).first()[0] or 0
        tasks = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-int(postings) // TASK_POSTINGS))
        buckets = max(BUCKETS, 8 * tasks)
        sent = self.spark.sparkContext.broadcast(_ranks(self.texts))
        packed = self.texts.mapInArrow(_postings(sent, buckets), "bucket int, shingles binary, nodes binary, sizes binary, places binary").repartition(tasks, "bucket")
        tiles = self.ws.write(packed.mapInArrow(_tiles, "kind int, x long, a long, b long, na int, nb int"), "tiles")
        self.ws.free()  # the postings' shuffle is the largest of all
        pairs = self.ws.write(tiles.filter("kind = 0").groupBy("a", "b").agg(F.max("x").alias("lead"), F.min("na").alias("na"), F.min("nb").alias("nb")), "pairs")
        large = tiles.filter("kind = 1").select(F.col("x").alias("shingle"), F.col("a").alias("node"), F.col("na").alias("n"), F.col("b").alias("place"))
        return pairs, large

    def bits(self, ends: DataFrame, count: int) -> DataFrame:
        """node, made: the bitmaps of the classes in ends (and of a few others), once and more."""
        sent = self.spark.sparkContext.broadcast(_bloom(ends, count))
        return self.nodes.filter("bits is not null").select("node", F.col("bits").alias("made")).mapInArrow(_filtered(sent), "node long, made binary")

    def allowed(self, pairs: DataFrame, name: str) -> DataFrame:
        """The pairs (a, b, lead, na, nb; written) whose bitmaps allow a link."""
        made = _with_both(pairs, self.bits(*_ends(pairs)), "lead", "na", "nb")
        return self.ws.write(made.mapInArrow(_bounded, "a long, b long, lead long"), f"bounded{name}")

    def prove(self, pairs: DataFrame, name: str) -> DataFrame:
        """The links among written pairs (a, b and more columns). Whole sets are made, in a pass of their own, only for the classes in them."""
        sent, more = self.spark.sparkContext.broadcast(_bloom(*_ends(pairs))), pairs.columns[2:]
        sets = self.texts.mapInArrow(_sets(sent), "node long, made binary")
        links = self.ws.write(_with_both(pairs, sets, *more).mapInArrow(_proven, pairs.schema), f"links{name}")
        self.ws.free()
        return links

    def first_links(self, pairs: DataFrame) -> DataFrame:
        """Labels (node, label) from one partner each way of every class, leaders before others: they settle most of what stands in one component."""
        pick = lambda x, y: pairs.groupBy(x).agg(F.min(F.struct(-F.col("lead"), y))[y].alias(y)).select("a", "b")
        first = self.ws.write(pick("a", "b").unionByName(pick("b", "a")).distinct(), "first")
        return components(self.prove(first, "1"), self.ws, "1")

    def apart(self, pairs: DataFrame, labels: DataFrame) -> DataFrame:
        """The pairs (a, b) whose classes are in different components, with these: la, lb."""
        side = lambda k: labels.select(F.col("node").alias(k), F.col("label").alias(f"l{k}"))
        both = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
        return both.select("a", "b", F.coalesce("la", "a").alias("la"), F.coalesce("lb", "b").alias("lb")).filter("la != lb")

    def large_tiles(self, large: DataFrame, labels: DataFrame) -> DataFrame:
        """Postings of the large tiles whose classes are not all of one component, with blocks, bits and own (the class's such tiles); written."""
        ws = self.ws
        named = ws.write(large.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "large")
        members = named.groupBy("shingle").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("members")).filter("low < high")
        m = F.col("members")
        blocks = F.when(m <= STRIPS * BLOCK, F.ceil(m / BLOCK)).otherwise(F.greatest(F.lit(STRIPS), F.ceil(m / WIDE))).cast("int")
        members = members.select("shingle", blocks.alias("blocks"), m).select("shingle", "blocks", F.ceil(m / F.col("blocks") / BLOCK).cast("int").alias("parts"))
        rest = ws.write(named.drop("label").join(members, "shingle"), "open")
        bits = self.bits(rest.select("node"), rest.count()).dropDuplicates(["node"]).mapInArrow(_narrow, "node long, bits binary")
        own = rest.groupBy("node").agg(F.collect_set("shingle").alias("own"))  # a part of the class's prefix at most
        return ws.write(rest.join(bits.join(own, "node"), "node"), "tiles2")

    def large_pairs(self, wide: DataFrame, labels: DataFrame, once: bool, name: str) -> DataFrame:
        """Pairs (a, b, lead, na, nb; written) of different components from large_tiles; once: see _cells."""
        wide = wide.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        wide = wide.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(DEN / NUM))).cast("int"))
        wide = wide.withColumn("block", F.pmod("node", "blocks").cast("int")).withColumn("part", F.pmod(F.shiftright("node", 32), F.col("parts")))
        classes = F.collect_list(F.struct("node", "n", "place", "label", "own", "bits")).alias("classes")  # some BLOCK classes
        packed = wide.groupBy("shingle", "blocks", "band", "block", "part").agg(classes)
        every = F.sequence(F.lit(0), F.col("blocks") - 1)
        cell = lambda lower, side: F.transform(every, lambda x: F.struct((F.col("band") - lower).alias("cell"), (x if side else F.col("block")).alias("i"), (F.col("block") if side else x).alias("j"), F.lit(side).alias("side")))
        rows = packed.select("shingle", "band", "classes", F.inline(F.concat(cell(0, 0), cell(0, 1), cell(1, 1))))
        return self.ws.write(rows.groupBy("shingle", "cell", "i", "j").applyInArrow(_cells(once), "a long, b long, lead long, na int, nb int"), f"more{name}")

    def merged(self, rest: DataFrame, labels: DataFrame, name: str) -> DataFrame:
        """The labels after the links among written pairs (a, b, la, lb)."""
        links = self.prove(rest, name).select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct()
        into = components(links, self.ws, name).select(F.col("node").alias("label"), F.col("label").alias("into"))
        every = labels.unionByName(into.select(F.col("label").alias("node"), "label")).distinct()  # a class without a link before is its own component
        return self.ws.write(every.join(into, "label", "left").select("node", F.coalesce("into", "label").alias("label")), f"labels{name}")


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, to) of one task's links, to being the smallest node of the component."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            low, high = sorted((root(a), root(b)))
            parent[high] = low
    yield pa.RecordBatch.from_arrays([pa.array(list(parent), pa.int64()), pa.array([root(x) for x in parent], pa.int64())], ["a", "to"])


def components(links: DataFrame, ws: Workspace, name: str) -> DataFrame:
    """node, label for every node of the links (a, b): some node of its component, the same for all.

    Each round sends every node to that neighbour, or itself, which comes first in an order drawn for the round (so that chains
    of any kind fall into short pieces), shortens these ways twice, and keeps the links between what remains. The last LAST links
    at most are united in one task. The ways of all rounds put together give the label.
    """
    edges, ways, k = ws.write(links.select("a", "b"), f"edges{name}"), None, 0

    def further(way: DataFrame) -> DataFrame:
        if ways is None:
            return way
        return ws.write(ways.join(way.select(F.col("a").alias("to"), F.col("to").alias("next")), "to", "left").select("a", F.coalesce("next", "to").alias("to")), f"ways{name}{k}")

    while (left := edges.count()) > LAST:
        drawn = lambda c: F.struct(F.xxhash64(F.lit(k), c).alias("order"), F.col(c).alias("to"))  # noqa: B023, E731
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        way = ws.write(both.groupBy("a").agg(F.min(drawn("b")).alias("first")).select("a", F.least(drawn("a"), "first")["to"].alias("to")), f"way{name}{k}")
        for j in range(2):
            step = way.select(F.col("a").alias("to"), F.col("to").alias("further"))
            way = ws.write(way.join(step, "to").select("a", F.col("further").alias("to")), f"short{name}{k}.{j}")
        ways = further(way)
        ends = edges.join(way.withColumnRenamed("to", "ta"), "a").join(way.select(F.col("a").alias("b"), F.col("to").alias("tb")), "b")
        edges = ws.write(ends.filter("ta != tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), f"edges{name}{k}")
        k += 1
    if left or ways is None:
        ways = further(ws.write(edges.coalesce(1).mapInArrow(_united, "a long, to long"), f"last{name}"))
    return ways.select(F.col("a").alias("node"), F.col("to").alias("label"))


def _component_labels(join: Join) -> DataFrame:
    """node, label of every class with a link."""
    ws, (pairs, large) = join.ws, join.tiles()
    allowed = join.allowed(pairs, "1")
    labels = join.first_links(allowed)
    wide = join.large_tiles(large, labels)
    some = bool(wide.head(1))
    # One pair for each two components of a cell unites most of them, so that few are left for the round of all pairs.
    tried = allowed.unionByName(join.allowed(join.large_pairs(wide, labels, True, "2"), "2")) if some else allowed
    rest = ws.write(join.apart(tried, labels).distinct(), "rest2")
    if rest.head(1):
        labels = join.merged(rest, labels, "2")
    if some:
        more = ws.write(join.large_pairs(wide, labels, False, "3").join(rest, ["a", "b"], "left_anti"), "untried")
        rest = ws.write(join.apart(join.allowed(more, "3"), labels), "rest3") if more.head(1) else more
        if rest.head(1):
            labels = join.merged(rest, labels, "3")
    return labels


def _classified(docs: DataFrame, ws: Workspace | None = None) -> DataFrame:
    """doc_id, n, node, label (of the component; null without words), component_id of every row of docs, written.

    Least ids are found class by class and then component by component, both before the shuffle; every join back has one row a key on
    one side and is read from written tables, so that Spark may split a large class or component over many tasks.
    """
    join = Join(docs, ws)
    ws, labels = join.ws, _component_labels(join)
    least = ws.write(join.nodes.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("least")), "least")
    low = ws.write(labels.join(least, "node").groupBy("label").agg(F.min("least").alias("low")), "low")
    named = ws.write(labels.join(low, "label").select("node", "label", "low"), "named")
    classes = ws.write(least.join(named, "node", "left").select("node", F.coalesce("label", "node").alias("label"), F.coalesce("low", "least").alias("component")), "classes")
    out = join.nodes.select("doc_id", "n", "node").join(classes, "node", "left")
    out = ws.write(out.select("doc_id", "n", "node", "label", F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id")), "result")
    ws.drop(*(name for name in list(ws.paths) if name != "result"))
    return out


def jaccard_components(docs: DataFrame, ws: Workspace | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs; see the module's text."""
    return _classified(docs, ws).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def jaccard_links(docs: DataFrame, ws: Workspace | None = None) -> tuple[DataFrame, DataFrame]:
    """(links, members): every link between different sets as classes a < b, each once, and doc_id, n_shingles and class of every row of docs."""
    join = Join(docs, ws)
    pairs, large = join.tiles()
    found = join.allowed(pairs, "1")
    own = large.select("node", F.col("node").alias("label")).distinct()  # no two classes count as one component
    wide = join.large_tiles(large, own)
    if wide.head(1):
        more = join.large_pairs(wide, own, False, "2")
        found = join.ws.write(found.unionByName(join.allowed(more, "2")).select("a", "b").distinct(), "all")
    return join.prove(found, "all").select("a", "b"), join.nodes.select("doc_id", F.col("n").alias("n_shingles"), F.col("node").alias("class"))


def _class_of(texts: pa.Array) -> pa.Array:
    """The class of each text, null without words."""
    found = [np.zeros(0, np.int64)]
    there = [np.zeros(0, bool)]
    for a, b, data, offsets in text_steps(texts):
        n, node, _ = _classes(*shingle_sets(data, offsets), b - a)
        found.append(node)
        there.append(n > 0)
    return pa.array(np.concatenate(found), pa.int64(), mask=~np.concatenate(there))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row of every component: that with the smallest doc_id (nulls last), then the smallest class; rows without words all stay.

    Rows are told apart by doc_id and class, so of the texts that share a doc_id only those that have a partner go. Rows of one doc_id and
    class (repeats) are one document: the one with the least text stays, and any of those with equal texts. All columns are kept.
    """
    ws = Workspace(docs.sparkSession, "keep_one")
    found = _classified(docs, ws).filter("n > 0")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("first")
    stays = ws.write(found.groupBy("label").agg(first), "stays")
    same = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("node") == F.col("first.node"))
    gone = ws.write(found.join(stays, "label").filter(~same).select(F.col("doc_id").alias("__gone_id"), F.col("node").alias("__gone")).distinct(), "gone")
    repeats = found.groupBy("doc_id", "node").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select(F.col("doc_id").alias("__gone_id"), F.col("node").alias("__gone"))
    repeats = ws.write(repeats, "repeats")
    rows = docs.withColumn("__class", F.arrow_udf(_class_of, "long")("text"))
    key = rows["doc_id"].cast("long").eqNullSafe(F.col("__gone_id")) & (F.col("__class") == F.col("__gone"))
    rows = rows.join(gone, key, "left_anti")
    if not repeats.head(1):
        return rows.select(*docs.columns)
    once = rows.join(repeats, key, "left_semi").groupBy("doc_id", "__class").agg(F.min_by(F.struct(*docs.columns), F.coalesce("text", F.lit(""))).alias("row"))
    return rows.join(repeats, key, "left_anti").select(*docs.columns).unionByName(once.select("row.*"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP2_SQL = r"""
with recursive w as (
  select row_number() over () rn, doc_id,
    list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') ws
  from documents),
s as (
  select distinct rn, array_to_string(list_slice(ws, p, p + 4), ' ') g
  from (select rn, ws, unnest(generate_series(1, greatest(len(ws) - 4, 1))) p from w where len(ws) > 0)),
n as (select rn, count(*) n from s group by rn),
i as (select a.rn x, b.rn y, count(*) c from s a join s b on a.g = b.g and a.rn <> b.rn group by all),
l as (select x, y from i join n p on p.rn = x join n q on q.rn = y where 100 * c >= 75 * (p.n + q.n - c)),
r as (select rn x, rn y from w union select r.x, l.y from r join l on r.y = l.x)
select w.doc_id, coalesce(n.n, 0)::bigint n_shingles, (select min(v.doc_id) from r join w v on v.rn = r.y where r.x = w.rn) component_id
from w left join n using (rn)
"""

QUERIES = {"op2_jaccard_join": op2_jaccard_join}
SQL = {"op2_jaccard_join": OP2_SQL}
