"""Language-model scoring: a hashed maximum-entropy model with a class-factored softmax.

P(text) is the product over its tokens (words and one end) of P(unknown), or for a known word (1 - P(unknown)) P(class | history)
P(word | class). Classes come from the training texts: the most frequent words, and the endings of all others, are clustered by the
words that stand next to them. P(class | history) is a softmax over sums of weight rows: a bias, the previous class (n-gram of
two), the class two and the class three back (skip features), and hashes of the last two and the last three classes. P(word | class)
is the word's share of its class's training tokens; P(unknown) is the share of training tokens that are their word's only one.

All statistics cover all training texts and are gathered by aggregation: word counts (written as a table, never collected),
neighbour counts of a fixed number of items, and counts of (three classes back, class), the exact sufficient statistics of the
class model. The weights start at the previous class's closed form and are trained by full-batch gradient updates: each step
broadcasts the weights (fixed size), the executors add up gradients over their share of the written counts, the driver applies Adam.

Scoring runs in numpy batches over whole texts. Counts of the ``TOP`` most frequent words are broadcast (a fixed number); each text's other
words meet the written counts in an equi-join on the word's 64-bit hash, where no key is frequent by construction.

Defined results: null and empty texts are one end token; with no training text every token is unknown; a null doc_id counts as held out and is never learned
from; repeated rows are learned from and scored each. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Workspace, hashed_words, mix, table, text_steps

FOLDS, HELD_OUT = 5, 1
#: Words whose counts are broadcast.
TOP = 1 << 17
#: Words with a class of their own choice, buckets of endings for all others, words that count as neighbours.
CLASS_WORDS, ENDINGS, NEIGHBOURS = 1024, 1024, 256
CLASSES, END, BEGIN, SLOTS = 60, 60, 61, 64
PAIRS, TRIPLES = 1 << 12, 1 << 14
STEPS, RATE, L2 = 10, 0.08, 2.0
GRADIENT_TASKS = 8
#: Rows of weights: bias, one back, two back, three back, hashed pairs, hashed triples.
_AT = np.cumsum([0, 1, SLOTS, SLOTS, SLOTS, PAIRS, TRIPLES])


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == HELD_OUT, F.lit(True))


def _endings(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Bucket of each word's last three bytes, A-Z as a-z."""
    low = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint64)
    out = np.zeros(len(start), np.uint64)
    for k in range(1, 4):
        at = end - k
        out = out * np.uint64(257) + np.where(at >= start, low[np.maximum(at, 0)], 0)
    return (mix(out) % np.uint64(ENDINGS)).astype(np.int64)


def _positions(row: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of each word, place of each row's end token, row of each place) when one end follows each row's words."""
    per = np.bincount(row, minlength=n_rows)
    ends = np.cumsum(per + 1) - 1
    return np.arange(len(row)) + row, ends, np.repeat(np.arange(n_rows), per + 1)


def _back(values: np.ndarray, owner: np.ndarray, k: int, none: int) -> np.ndarray:
    """The value k places before, none where that is another row's."""
    out = np.full(len(values), none, values.dtype)
    same = owner[k:] == owner[:-k] if len(owner) > k else np.zeros(0, bool)
    out[k:][same] = values[:-k][same]
    return out


def _lookup(keys: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Index in the sorted keys of each h, -1 for none."""
    if not len(keys):
        return np.full(len(h), -1, np.int64)
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return np.where(keys[at] == h, at, -1)


# Passes over the training texts ----------------------------------------------------------------------------------


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct words of each few steps with their counts and endings."""
    names, most = ["h", "n", "ending"], 1 << 19
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def merged() -> pa.RecordBatch:
        h, n, ending = (np.concatenate([x[k] for x in held]) for k in range(3))
        held.clear()
        order = np.argsort(h, kind="stable")
        h, n, ending = h[order], n[order], ending[order]
        first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        return pa.RecordBatch.from_arrays([pa.array(h[first].view(np.int64)), pa.array(np.add.reduceat(n, first)), pa.array(ending[first])], names)

    for batch in batches:
        for _, _, data, offsets in text_steps(batch.column(0)):
            h, _, s, e = hashed_words(data, offsets)
            keys, first, n = np.unique(h, return_index=True, return_counts=True)
            held.append((keys, n, _endings(data, s[first], e[first]).astype(np.int32)))
            if sum(len(x[0]) for x in held) > most:
                yield merged()
    if any(len(x[0]) for x in held):
        yield merged()


def _neighbour_counts(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, rank = sent.value
        width = 2 * (NEIGHBOURS + 1)
        total = np.zeros((CLASS_WORDS + ENDINGS) * width, np.int64)
        for batch in batches:
            for a, b, data, offsets in text_steps(batch.column(0)):
                h, row, s, e = hashed_words(data, offsets)
                at = _lookup(keys, h)
                top = np.where(at >= 0, rank[np.maximum(at, 0)], CLASS_WORDS)
                item = np.where(top < CLASS_WORDS, top, CLASS_WORDS + _endings(data, s, e))
                near = np.minimum(top, NEIGHBOURS)
                before, after = _back(near, row, 1, -1), np.full(len(near), -1)
                if len(near) > 1:
                    same = row[1:] == row[:-1]
                    after[:-1][same] = near[1:][same]
                for x, shift in ((before, 0), (after, NEIGHBOURS + 1)):
                    there = x >= 0
                    total += np.bincount(item[there] * width + shift + x[there], minlength=len(total))
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total[cells])], ["cell", "n"])

    return run


def cluster(vectors: np.ndarray, weight: np.ndarray, k: int) -> np.ndarray:
    """Cluster of each row: k-means on the leading singular directions of the rows' square-rooted shares; deterministic."""
    share = np.sqrt(vectors / np.maximum(vectors.sum(axis=1, keepdims=True), 1))
    values, directions = np.linalg.eigh(share.T @ (share * np.sqrt(weight)[:, None]))
    x = share @ directions[:, np.argsort(-values)[:32]]
    centres = [int(np.argmax(weight))]
    far = ((x - x[centres[0]]) ** 2).sum(axis=1)
    while len(centres) < k:
        centres.append(int(np.argmax(far * np.log1p(weight))))
        far = np.minimum(far, ((x - x[centres[-1]]) ** 2).sum(axis=1))
    c = x[centres]
    for _ in range(25):
        near = np.argmin((c**2).sum(axis=1)[None] - 2 * x @ c.T, axis=1)
        sums = np.stack([np.bincount(near, x[:, d] * weight, minlength=k) for d in range(x.shape[1])], axis=1)
        size = np.bincount(near, weight, minlength=k)
        c = np.where(size[:, None] > 0, sums / np.maximum(size, 1e-9)[:, None], c)
    return np.argmin((c**2).sum(axis=1)[None] - 2 * x @ c.T, axis=1).astype(np.int64)


class Classes:
    """Class of every word, known or not."""

    def __init__(self, keys: np.ndarray, of_key: np.ndarray, of_ending: np.ndarray):
        self.keys, self.of_key, self.of_ending = keys, of_key, of_ending

    def __call__(self, h: np.ndarray, ending: np.ndarray) -> np.ndarray:
        at = _lookup(self.keys, h)
        return np.where(at >= 0, self.of_key[np.maximum(at, 0)], self.of_ending[ending]) if len(self.keys) else self.of_ending[ending]


def _class_places(classes: Classes, data, offsets, n_rows):
    h, row, s, e = hashed_words(data, offsets)
    place, ends, owner = _positions(row, n_rows)
    c = np.full(len(owner), END, np.int64)
    c[place] = classes(h, _endings(data, s, e))
    context = (_back(c, owner, 1, BEGIN) * SLOTS + _back(c, owner, 2, BEGIN)) * SLOTS + _back(c, owner, 3, BEGIN)
    return h, place, ends, owner, c, context


def _class_counts(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS**4, np.uint32)
        for batch in batches:
            for a, b, data, offsets in text_steps(batch.column(0)):
                *_, c, context = _class_places(sent.value, data, offsets, b - a)
                keys, n = np.unique(context * SLOTS + c, return_counts=True)
                total[keys] += n.astype(np.uint32)
        cells = np.flatnonzero(total)
        for a in range(0, len(cells), 1 << 16):
            part = cells[a : a + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array((part // SLOTS).astype(np.int32)), pa.array((part % SLOTS).astype(np.int32)), pa.array(total[part].astype(np.int64))], ["context", "class", "n"])

    return run


# The class model ---------------------------------------------------------------------------------------------------


def rows_of(context: np.ndarray) -> np.ndarray:
    """The six weight rows of each context."""
    one, two, three = context // SLOTS**2, context // SLOTS % SLOTS, context % SLOTS
    pair = (mix((one * SLOTS + two).astype(np.uint64) + np.uint64(1 << 40)) % np.uint64(PAIRS)).astype(np.int64)
    triple = (mix(context.astype(np.uint64) + np.uint64(1 << 41)) % np.uint64(TRIPLES)).astype(np.int64)
    return np.stack([np.full(len(context), _AT[0]), _AT[1] + one, _AT[2] + two, _AT[3] + three, _AT[4] + pair, _AT[5] + triple], axis=1)


def log_softmax(weights: np.ndarray, context: np.ndarray) -> np.ndarray:
    """Natural log of P(class | context), contexts x SLOTS."""
    rows = rows_of(context)
    z = weights[rows[:, 0]].copy()
    for k in range(1, rows.shape[1]):
        z += weights[rows[:, k]]
    z -= z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def gradient(weights: np.ndarray, context: np.ndarray, cls: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, float]:
    """Gradient and value of the negative log likelihood of counted (context, class) rows."""
    seen, which = np.unique(context, return_inverse=True)
    out, loss = np.zeros_like(weights, np.float64), 0.0
    counts = np.zeros((len(seen), SLOTS), np.float32)
    np.add.at(counts, (which, cls), n)
    for a in range(0, len(seen), 1 << 12):
        part, real = seen[a : a + (1 << 12)], counts[a : a + (1 << 12)]
        logp = log_softmax(weights, part)
        loss -= float((real * logp).sum())
        miss = np.exp(logp) * real.sum(axis=1, keepdims=True) - real
        for column in rows_of(part).T:
            order = np.argsort(column, kind="stable")
            first = np.flatnonzero(np.append(True, np.diff(column[order]) != 0))
            out[column[order][first]] += np.add.reduceat(miss[order], first, axis=0)
    return out, loss


def _gradients(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[np.asarray(batch.column(k)) for k in range(3)] for batch in batches]
        if held:
            context, cls, n = (np.concatenate([x[k] for x in held]) for k in range(3))
            g, loss = gradient(sent.value, context.astype(np.int64), cls.astype(np.int64), n)
            rows = np.flatnonzero(g.any(axis=1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([rows.tobytes()], pa.binary()), pa.array([g[rows].astype(np.float32).tobytes()], pa.binary()), pa.array([loss])], ["at", "g", "loss"])

    return run


def _train_weights(spark: SparkSession, counts: DataFrame, steps: int) -> np.ndarray:
    """counts: the written table of context, class, n."""
    one = counts.groupBy((F.col("context") / SLOTS**2).cast("int").alias("one"), "class").agg(F.sum("n").alias("n")).collect()  # SLOTS^2 rows at most
    pair = np.zeros((SLOTS, SLOTS))
    for c, k, n in one:
        pair[c, k] = n
    share = (pair.sum(axis=0) + 0.5) / (pair.sum() + 0.5 * SLOTS)
    weights = np.zeros((_AT[-1], SLOTS), np.float32)
    weights[0] = np.log(share)
    weights[_AT[1] : _AT[2]] = np.log((pair + 5 * share) / (pair.sum(axis=1, keepdims=True) + 5)) - np.log(share)
    n_all = max(pair.sum(), 1.0)
    m, v = np.zeros_like(weights, np.float64), np.zeros_like(weights, np.float64)
    start = weights.copy()
    for t in range(1, steps + 1):
        sent = spark.sparkContext.broadcast(weights)
        g = np.zeros_like(m)
        # the counts are a table of bounded size, and GRADIENT_TASKS rows come back
        for at, blob, _loss in counts.coalesce(GRADIENT_TASKS).mapInArrow(_gradients(sent), "at binary, g binary, loss double").collect():
            g[np.frombuffer(bytes(at), np.int32)] += np.frombuffer(bytes(blob), np.float32).reshape(-1, SLOTS)
        sent.unpersist()
        g = (g + L2 * (weights - start)) / n_all
        m, v = 0.9 * m + 0.1 * g, 0.95 * v + 0.05 * g**2
        weights = (weights - RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.95**t)) + 1e-8)).astype(np.float32)
    return weights


class Model:
    """All that scoring broadcasts: of fixed size, whatever the corpus."""

    def __init__(self, classes: Classes, weights: np.ndarray, top: np.ndarray, top_n: np.ndarray, n: int, v: int, n_end: int, once: int, class_n: np.ndarray):
        self.classes, self.weights, self.top, self.top_n = classes, weights, top, top_n
        self.n, self.v, self.n_end, self.class_n = n, v, n_end, class_n
        self.unknown = (once + 0.5) / (n + 1.0)
        self.z = n + 0.5 * (v + 1)

    def table(self) -> np.ndarray:
        """log10 of (1 - P(unknown)) P(class | context) / (training tokens of the class), for all contexts."""
        out, share = np.empty((SLOTS**3, SLOTS), np.float32), np.log10(1 - self.unknown) - np.log10(np.maximum(self.class_n, 1))
        for a in range(0, SLOTS**3, 1 << 12):
            out[a : a + (1 << 12)] = log_softmax(self.weights, np.arange(a, a + (1 << 12))) / np.log(10) + share
        return out


def train(docs: DataFrame, ws: Workspace, steps: int = STEPS) -> tuple[Model, DataFrame]:
    """The model of the training rows among docs, and their written word counts (h, n, ending)."""
    spark = docs.sparkSession
    learn = docs.select("doc_id", "text").filter(~held_out(F.col("doc_id"))).select("text")
    counted = learn.mapInArrow(_word_counts, "h long, n long, ending int")
    vocabulary = ws.write(counted.groupBy("h").agg(F.sum("n").alias("n"), F.min("ending").alias("ending")), "vocabulary")
    n_words, v, once = vocabulary.agg(F.sum("n"), F.count(F.lit(1)), F.count_if(F.col("n") == 1)).first()
    n_end = learn.count()
    n, v = (n_words or 0) + n_end, v + (n_end > 0)
    ranked = vocabulary.orderBy(F.desc("n"), "h").limit(TOP).select("h", "n").toArrow()
    keys, top_n = ranked["h"].to_numpy().astype(np.int64).view(np.uint64), ranked["n"].to_numpy().astype(np.int64)
    del ranked

    first = keys[:CLASS_WORDS]
    order = np.argsort(first)
    sent = spark.sparkContext.broadcast((first[order], order.astype(np.int64)))
    width = 2 * (NEIGHBOURS + 1)
    cells = learn.mapInArrow(_neighbour_counts(sent), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # a fixed number of cells
    flat = np.zeros((CLASS_WORDS + ENDINGS) * width)
    flat[cells["cell"].to_numpy()] = cells["n"].to_numpy()
    del cells
    vectors = flat.reshape(-1, width)
    of_item = cluster(vectors, vectors.sum(axis=1) + 1e-6, CLASSES)
    classes = Classes(first[order], of_item[: len(first)][order], of_item[CLASS_WORDS:])

    sent = spark.sparkContext.broadcast(classes)
    tuples = learn.mapInArrow(_class_counts(sent), "context int, class int, n long")
    tuples = ws.write(tuples.groupBy("context", "class").agg(F.sum("n").alias("n")), "class_counts")
    class_n = np.zeros(SLOTS)
    for c, k in tuples.groupBy("class").agg(F.sum("n")).collect():
        class_n[c] = k
    weights = _train_weights(spark, tuples, steps)
    order = np.argsort(keys)
    return Model(classes, weights, keys[order], top_n[order], n, v, n_end, once or 0, class_n), vocabulary


_SCORED = "doc_id long, key long, n_tokens long, n_known long, base double, score double, rare array<struct<h: long, n: long, part: double>>"


def _scored(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        table_ = model.table()
        key = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        known_base, end_base = np.log10((model.top_n + 0.5) / model.z), float(np.log10((model.n_end + 0.5) / model.z))
        known_log = np.log10(np.maximum(model.top_n, 1))
        for batch in batches:
            for a, b, data, offsets in text_steps(batch.column(1)):
                rows = b - a
                h, place, ends, owner, c, context = _class_places(model.classes, data, offsets, rows)
                part = table_[context, c].astype(np.float64)
                row = owner[place]
                at = _lookup(model.top, h)
                top = at >= 0
                base = np.full(rows, end_base)
                known = np.full(rows, int(model.n_end > 0))
                score = part[ends] + np.log10(model.n_end) if model.n_end else np.full(rows, np.log10(model.unknown))
                base += np.bincount(row[top], known_base[at[top]], minlength=rows)
                known += np.bincount(row[top], minlength=rows)
                score += np.bincount(row[top], part[place][top] + known_log[at[top]], minlength=rows)
                rare_h, rare_row, rare_part = h[~top], row[~top], part[place][~top]
                order = np.lexsort((rare_h, rare_row))
                rare_h, rare_row, rare_part = rare_h[order], rare_row[order], rare_part[order]
                new = np.ones(len(rare_h), bool)
                new[1:] = (rare_h[1:] != rare_h[:-1]) | (rare_row[1:] != rare_row[:-1])
                first = np.flatnonzero(new)
                times = np.diff(np.append(first, len(rare_h)))
                sums = np.add.reduceat(rare_part, first) if len(first) else rare_part
                each = pa.StructArray.from_arrays([pa.array(rare_h[first].view(np.int64)), pa.array(times), pa.array(sums)], ["h", "n", "part"])
                at_row = np.searchsorted(rare_row[first], np.arange(rows + 1)).astype(np.int32)
                columns = [batch.column(0)[a:b], pa.array(key + np.arange(rows)), pa.array(np.diff(np.append(-1, ends))), pa.array(known), pa.array(base), pa.array(score), pa.ListArray.from_arrays(pa.array(at_row), each)]
                key += rows
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "key", "n_tokens", "n_known", "base", "score", "rare"])

    return run


def score(docs: DataFrame, model: Model, vocabulary: DataFrame, ws: Workspace) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score of every row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scored(sent), _SCORED)
    rows = ws.write(rows, "scored")
    rare = rows.select("key", F.explode("rare").alias("w")).select("key", F.col("w.h").alias("h"), F.col("w.n").alias("times"), F.col("w.part").alias("part"))
    found = rare.join(vocabulary.select("h", "n"), "h", "left")
    known = F.col("n").isNotNull()
    sums = found.groupBy("key").agg(
        F.sum(F.when(known, F.col("times")).otherwise(0)).alias("k"),
        F.sum(F.col("times") * F.log10((F.coalesce("n", F.lit(0)) + 0.5) / model.z)).alias("b"),
        F.sum(F.when(known, F.col("part") + F.col("times") * F.log10("n")).otherwise(F.col("times") * float(np.log10(model.unknown)))).alias("s"),
    )
    out = rows.drop("rare").join(sums, "key", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.select("doc_id", "n_tokens", (F.col("n_known") + zero("k")).alias("n_known"), (F.col("base") + zero("b")).alias("base_score"), (F.col("score") + zero("s")).alias("score"))


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, ws = table(spark, sf_dir, "documents"), Workspace(spark, "language-model")
    model, vocabulary = train(docs, ws)
    out = score(docs, model, vocabulary, ws)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), "base_score", "score")


QUERIES = {"op10_lm_score": op10_lm_score}
SQL: dict[str, str] = {}
