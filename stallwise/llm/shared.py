"""Helpers that all operators of this subpackage use: tables, written intermediate results, hashed words.

Everything that must outlive an executor is written as Parquet under the folder that ``spark.checkpoint.dir`` names;
only where that setting is absent and Spark runs on one machine (tests, a laptop) a temporary folder is used in its place.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one numpy step handles at most; a longer single text is a step of its own.
STEP_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one, remembered in the session, only where Spark runs on one machine and none is named."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("stallwise.shared.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        folder = "file://" + tempfile.mkdtemp(prefix="stallwise-")
        spark.conf.set("stallwise.shared.dir", folder)
    return folder.rstrip("/")


class Workspace:
    """Written intermediate tables of one run; ``drop`` frees those that nothing reads any more."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.paths: dict[str, str] = {}

    def write(self, df: DataFrame, name: str, *partition_by: str) -> DataFrame:
        """Write df and read it back: the lineage ends here and any executor can be lost afterwards."""
        path = f"{self.root}/{name}"
        writer = df.write.mode("overwrite")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def free(self) -> None:
        """Let Spark delete the shuffle files of finished steps now: it does so when the driver's memory is collected, else up to half an hour later."""
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def ascii_lower(col):
    """Lower-case A-Z and nothing else."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# Hashed words in numpy -------------------------------------------------------------------------------------------

_RNG = np.random.default_rng(20240131)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_P, _PI = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
#: The words' separators: ASCII white space, 0x20 and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Everything in ASCII but letters and digits.
NOT_WORD = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift, multiply)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        n = max(n, STEP_BYTES + 1)
        for k, base in enumerate((_P, _PI)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def text_steps(texts: pa.Array, step_bytes: int = STEP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets of rows in them) for runs of rows; a null is an empty text."""
    texts = texts.cast(pa.large_binary()).fill_null(b"") if not pa.types.is_large_binary(texts.type) else texts.fill_null(b"")
    if not len(texts):
        return
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    a, n = 0, len(texts)
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + step_bytes, "right")) - 1)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def hashed_words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACE, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, ...]:
    """(64-bit hash, row, start, end) of every word, words being runs of bytes that are no separators, A-Z taken as a-z.

    For each length in prefixes, the hashes of the words' first so many bytes follow, 0 for a word that isn't longer.

    No word reaches over a row's end. Hashes depend on the word's bytes alone.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), *(np.zeros(0, np.uint64) for _ in prefixes)
    word = ~separators[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = word[:-1]
    start = np.flatnonzero(word & (~before | edge[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = word[1:]
    end = np.flatnonzero(word & (~after | edge[1:])) + 1
    up, down = _grown(n)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(_BYTE[data] * up[:n], out=total[1:])
    h = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    more = []
    for k in prefixes:
        part = mix((total[np.minimum(start + k, end)] - total[start]) * down[start] + np.uint64(k << 32))
        more.append(np.where(end - start > k, part, np.uint64(0)))
    return h, np.searchsorted(offsets, start, "right") - 1, start, end, *more


def word_hash(word: str, prefix: int = 0) -> int:
    """The hash that hashed_words gives this word, or with prefix a longer word that begins with it."""
    data = np.frombuffer(word.encode(), np.uint8)
    if prefix:
        data = np.append(data[:prefix], data[:1])
        return int(hashed_words(data, np.array([0, len(data)]), np.zeros(256, bool), (prefix,))[4][0])
    return int(hashed_words(data, np.array([0, len(data)]), np.zeros(256, bool))[0][0])
