"""Toxicity by weak supervision.

Voters: each entry of a lexicon, each word or word beginning that the labelled training rows show to mark toxic texts,
and patterns (shouting, exclamation marks, second person). A voter fires or abstains; one more voter says "clean" where
no lexical voter fires.

A generative label model estimates each voter's accuracy and the voters' correlations from second moments over all
training-fold texts: for conditionally independent voters, the covariance of two is p(1-p) d_i d_j, where d is the difference
of a voter's firing rates in toxic and clean texts. The d are fitted to the covariances by alternating least squares with
p given by the labels; pairs whose residual is large are taken as correlated, left out, and the fit is repeated. The labelled
sample then corrects the accuracies, with the moments' estimate as its prior (mixed languages break independence). A
text's posterior adds the log odds of the voters that fire, each divided by one plus its residual correlations with the others that fire.

A linear (logistic) classifier over hashed words and word beginnings is then trained on these posteriors, over a sample of at
most ``sample`` labelled training rows in the order of a hash of doc_id, the only bounded step. Scores are its
probabilities, computed in numpy over whole texts.

Labels come only from rows whose crc32(doc_id as text) mod 5 is not 0; doc_id, lang and source are never inputs of a score.

Defined results: null and empty texts get the score of the classifier's bias; a null doc_id counts as held out and is never learned
from; several labels of one doc_id count as toxic if one is; null labels are ignored; with no labelled rows, or one class only, the
lexicon alone decides with fixed rates; repeated rows are scored each. Only doc_id and text (doc_id and toxic of the labels) are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import NOT_WORD, Workspace, hashed_words, table, text_steps, word_hash

#: Words that make a text toxic in themselves. Fixed values.
LEXICON = (
    "idiot", "idiots", "moron", "morons", "stupid", "loser", "losers", "trash", "scum", "worthless", "pathetic", "disgusting", "clown", "clowns",
    "dumb", "dumbass", "imbecile", "cretin", "filth", "filthy", "vermin", "garbage", "jerk", "bastard", "freak", "creep", "ugly", "fool", "foolish",
    "hate", "kill", "hurt", "shutup", "retard", "retarded", "pig", "pigs", "rat", "rats",
)
#: Words that address someone: a weak sign.
SECOND_PERSON = ("you", "your", "youre", "yourself")
PREFIXES = (3, 4, 5, 6)
#: Labelled rows that the classifier is trained on at most.
SAMPLE = 20_000
#: Voters that are found in the labelled sample at most, and features of the classifier.
FOUND_VOTERS, FEATURES = 96, 2048
FOLDS = 5


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(True))


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature hash): the words and their beginnings of PREFIXES bytes."""
    h, row, _, _, *more = hashed_words(data, offsets, NOT_WORD, PREFIXES)
    rows, keys = [row], [h]
    for m in more:
        there = m != 0
        rows.append(row[there])
        keys.append(m[there])
    return np.concatenate(rows), np.concatenate(keys)


def _hits(data: np.ndarray, offsets: np.ndarray, table_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, index into the sorted table_) of the features that the table has."""
    if not len(table_):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rows, keys = features(data, offsets)
    # a small filter first: most words are in no table
    some = np.zeros(1 << 16, bool)
    some[(table_ >> np.uint64(48)).astype(np.int64)] = True
    maybe = some[(keys >> np.uint64(48)).astype(np.int64)]
    rows, keys = rows[maybe], keys[maybe]
    at = np.minimum(np.searchsorted(table_, keys), len(table_) - 1)
    real = table_[at] == keys
    pair = np.unique(rows[real] * np.int64(len(table_)) + at[real])
    return pair // len(table_), pair % len(table_)


def patterns(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Row x 2: shouting (over 30 % capitals among ASCII letters, 20 letters at least), over 1 % exclamation marks."""
    def count(what):
        total = np.zeros(len(data) + 1, np.int64)
        np.cumsum(what, out=total[1:])
        return total[offsets[1:]] - total[offsets[:-1]]

    upper, lower = count((data >= 65) & (data <= 90)), count((data >= 97) & (data <= 122))
    shout = (upper + lower >= 20) & (upper > 0.3 * (upper + lower))
    return np.stack((shout, 100 * count(data == 33) > np.maximum(np.diff(offsets), 1)), axis=1)


class Voters:
    """The lexical voters (one feature hash each), the patterns, and "clean" as the last."""

    def __init__(self, found: np.ndarray):
        fixed = [word_hash(w) for w in (*LEXICON, *SECOND_PERSON)]
        self.table = np.unique(np.array([*fixed, *map(int, found)], np.uint64))
        address = np.isin(self.table, np.array([word_hash(w) for w in SECOND_PERSON], np.uint64))
        self.weak = address
        self.anchor = np.isin(self.table, np.array([word_hash(w) for w in LEXICON], np.uint64))
        self.n = len(self.table) + 3

    def votes(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        out = np.zeros((n, self.n), bool)
        row, which = _hits(data, offsets, self.table)
        out[row, which] = True
        out[:, -3:-1] = patterns(data, offsets)
        out[:, -1] = ~out[:, : len(self.table)][:, ~self.weak].any(axis=1)
        return out


class LabelModel:
    """Firing rates of the voters in toxic and clean texts, and their residual correlations.

    n, fired, both: numbers of texts, of texts where each voter fires, and each two. known, known_toxic: the same of the labelled sample
    and its toxic rows, which are weighed against the estimate from the moments as if that were ``PSEUDO`` labelled rows.
    """

    PSEUDO = 2.0
    CORRELATED = 0.1

    def __init__(self, n: float, both: np.ndarray, prior: float, start: np.ndarray, known: np.ndarray, known_toxic: np.ndarray):
        fired = np.diag(both)
        m = fired / max(n, 1)
        cov = both / max(n, 1) - np.outer(m, m)
        spread = np.sqrt(np.maximum(m * (1 - m), 1e-12))
        c, apart = prior * (1 - prior), ~np.eye(len(m), dtype=bool)
        free, d = apart, start * spread
        for _ in range(3):
            for _ in range(60):
                w = free / np.outer(spread, spread) ** 2
                d = 0.5 * d + 0.5 * ((w * cov) @ d / np.maximum(c * (w @ d**2), 1e-12))
            free = apart & (np.abs(cov - c * np.outer(d, d)) / np.outer(spread, spread) <= self.CORRELATED)
        # P(toxic | fires): the moments' estimate, then the labelled rows'
        guess = np.clip(prior + c * d / np.maximum(m, 1e-9), 0.01, 0.99)
        precision = (known_toxic + self.PSEUDO * guess) / (known + self.PSEUDO)
        d = m * (precision - prior) / c
        self.residual = np.maximum((cov - c * np.outer(d, d)) / np.outer(spread, spread), 0)
        self.residual[(self.residual < self.CORRELATED) | ~apart] = 0
        self.prior, self.precision = prior, precision
        self.ratio = np.log(precision / (1 - precision)) - np.log(prior / (1 - prior))

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        x = votes.astype(float)
        share = 1 / (1 + x @ self.residual)
        odds = np.log(self.prior / (1 - self.prior)) + (x * share) @ self.ratio
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def fit_linear(row: np.ndarray, which: np.ndarray, n_features: int, y: np.ndarray, l2: float = 2e-5, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic classifier on soft labels y; (row, which): the features that are present."""
    n, w, bias = len(y), np.zeros(n_features), float(np.log((y.mean() + 1e-4) / (1 - y.mean() + 1e-4)))
    m, v, mb, vb = np.zeros(n_features), np.zeros(n_features), 0.0, 0.0
    for t in range(1, steps + 1):
        z = bias + np.bincount(row, w[which], minlength=n)
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n
        gw, gb = np.bincount(which, g[row], minlength=n_features) + l2 * w, g.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw**2, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb**2
        rate = 0.1 / (1 + t / 200)
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        bias -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-9)
    return w, bias


class Model:
    def __init__(self, keys: np.ndarray, weights: np.ndarray, bias: float):
        order = np.argsort(keys)
        self.keys, self.weights, self.bias = keys[order], weights[order], bias

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        row, which = _hits(data, offsets, self.keys)
        z = self.bias + np.bincount(row, self.weights[which], minlength=len(offsets) - 1)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _moments(voters: Voters):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, both = 0, np.zeros((voters.n, voters.n))
        for batch in batches:
            for _, _, data, offsets in text_steps(batch.column(0)):
                x = voters.votes(data, offsets).astype(np.float64)
                n, both = n + len(x), both + x.T @ x
        flat = np.append(both.ravel(), n)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], ["cell", "total"])

    return run


def _feature_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each feature, how many rows have it and how many of them are toxic; added up over the rows of a batch."""
    for batch in batches:
        toxic = np.asarray(batch.column(1)).astype(np.int64)
        for a, b, data, offsets in text_steps(batch.column(0)):
            row, key = features(data, offsets)
            order = np.lexsort((row, key))
            row, key = row[order], key[order]
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
            row, key = row[new], key[new]
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
            up = np.add.reduceat(toxic[a:b][row], first) if len(first) else first
            yield pa.RecordBatch.from_arrays([pa.array(key[first].view(np.int64)), pa.array(np.diff(np.append(first, len(key)))), pa.array(up)], ["key", "df", "up"])


def _sample_hits(keys: np.ndarray):
    """Each row's label, which of the sorted keys it has, and its pattern votes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in text_steps(batch.column(0)):
                row, which = _hits(data, offsets, keys)
                ends = np.searchsorted(row, np.arange(b - a + 1))
                blobs = [which[ends[k] : ends[k + 1]].astype(np.int32).tobytes() for k in range(b - a)]
                marks = [p.tobytes() for p in patterns(data, offsets)]
                yield pa.RecordBatch.from_arrays([batch.column(1)[a:b], pa.array(blobs, pa.binary()), pa.array(marks, pa.binary())], ["toxic", "hits", "marks"])

    return run


def gathered_moments(learn: DataFrame, voters: Voters) -> tuple[np.ndarray, float]:
    """How often each two voters fire together, and the number of rows: summed on the executors, voters^2 numbers come back."""
    cells = learn.select("text").mapInArrow(_moments(voters), "cell long, total double").groupBy("cell").agg(F.sum("total").alias("total"))
    flat = np.zeros(voters.n**2 + 1)
    for cell, total in cells.collect():
        flat[cell] = total
    return flat[:-1].reshape(voters.n, voters.n), float(flat[-1])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The classifier; docs and labels may hold all rows: held-out ones are left out here.

    Voters are features of which 0.95 of the rows that have one are toxic, which chance explains for none of all features tried (Chernoff's
    bound); of nested ones (a word and its beginnings) that fire on the same rows, one is taken. Features are those that tell the
    classes apart best (z-score).
    """
    ws = Workspace(docs.sparkSession, "toxicity")
    learn = docs.select("doc_id", "text").filter(~held_out(F.col("doc_id")))
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    taken = known.orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(sample)  # bounded, so it is broadcast
    rows = ws.write(learn.join(F.broadcast(taken), "doc_id").select("text", "toxic"), "sample")
    n, p = rows.agg(F.count(F.lit(1)), F.avg("toxic")).first()
    lexicon = np.unique(np.array([word_hash(w) for w in LEXICON], np.uint64))
    if not n or p in (0.0, 1.0):
        return Model(lexicon, np.full(len(lexicon), 4.0), -2.2)

    stats = ws.write(rows.mapInArrow(_feature_counts, "key long, df long, up long").groupBy("key").agg(F.sum("df").alias("df"), F.sum("up").alias("up")), "features")
    rate = F.least(F.greatest(F.col("up") / F.col("df"), F.lit(1e-9)), F.lit(1 - 1e-9))
    evidence = F.col("df") * (rate * F.log(rate / p) + (1 - rate) * F.log((1 - rate) / (1 - p)))
    telling = stats.withColumn("evidence", evidence).filter((rate >= 0.95) & (F.col("evidence") > float(np.log(max(stats.count(), 1)) + 2)))
    telling = [r[0] for r in telling.orderBy(F.desc("evidence"), "key").limit(8 * FOUND_VOTERS).select("key").collect()]
    z = F.abs(F.col("up") - p * F.col("df")) / F.sqrt(p * (1 - p) * F.col("df"))
    used = [r[0] for r in stats.filter("df >= 3").withColumn("z", z).filter("z > 3").orderBy(F.desc("z"), "key").limit(FEATURES).select("key").collect()]
    voters = Voters(np.zeros(0, np.uint64))
    keys = np.unique(np.concatenate((voters.table, np.array(telling + used, np.int64).view(np.uint64))))

    taken_rows = rows.mapInArrow(_sample_hits(keys), "toxic int, hits binary, marks binary").collect()  # sample rows, of chosen features only
    y = np.array([r[0] for r in taken_rows], float)
    hits = [np.frombuffer(bytes(r[1]), np.int32) for r in taken_rows]
    row, which = np.repeat(np.arange(len(hits)), list(map(len, hits))), np.concatenate(hits).astype(np.int64)
    fired, found = set(), []
    by_key = np.argsort(which, kind="stable")
    begins = np.searchsorted(which[by_key], np.arange(len(keys) + 1))
    for key in np.array(telling, np.int64).view(np.uint64):
        k = int(np.searchsorted(keys, key))
        mark = row[by_key[begins[k] : begins[k + 1]]].tobytes()
        if mark not in fired and len(found) < FOUND_VOTERS:
            fired.add(mark)
            found.append(int(key))
    voters = Voters(np.array(found, np.uint64))
    both, n_all = gathered_moments(learn, voters)
    start = np.full(voters.n, 0.05)
    start[:-3] = np.where(voters.weak, 0.01, np.where(voters.anchor, 1.0, 0.5))
    start[-1] = -1.0

    votes = np.zeros((len(y), voters.n), bool)
    column = np.full(len(keys), -1)
    column[np.searchsorted(keys, voters.table)] = np.arange(len(voters.table))
    real = column[which] >= 0
    votes[row[real], column[which[real]]] = True
    votes[:, -3:-1] = np.array([np.frombuffer(bytes(r[2]), bool) for r in taken_rows])
    votes[:, -1] = ~votes[:, : len(voters.table)][:, ~voters.weak].any(axis=1)
    model = LabelModel(n_all, both, float(y.mean()), start, votes.sum(axis=0), votes[y > 0].sum(axis=0))
    weights, bias = fit_linear(row, which, len(keys), model.posterior(votes))
    ws.drop("sample", "features")
    return Model(keys, weights, bias)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [model.score(data, offsets) for _, _, data, offsets in text_steps(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(parts) if parts else np.zeros(0))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def with_score(docs: DataFrame, model: Model, name: str = "toxicity") -> DataFrame:
    """docs with one more column, the score of their text."""

    def run(text: pa.Array) -> pa.Array:
        parts = [model.score(data, offsets) for _, _, data, offsets in text_steps(text)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return docs.withColumn(name, F.arrow_udf(run, "double")(F.col("text")))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op3_toxicity": op3_toxicity}
SQL: dict[str, str] = {}
