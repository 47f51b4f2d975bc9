"""Single texts that are longer than a step of shared.text_steps, in the operators that go over texts in steps."""

import collections

import numpy as np
import pytest

from stallwise.llm import decontaminate, divergence, jaccard, mixing, packing, shared, substring, token_counts, toxicity

PASSAGE = " ".join(f"passage{i}" for i in range(60))
WORDS = [f"w{i * 7919 % 250_007}" for i in range(230_000)]
LONG = " ".join(WORDS)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, LONG, "en", "a"), (2, f"{LONG} {PASSAGE}", "en", "b"), (3, "short text between", "en", "a"), (4, f"{PASSAGE} {' '.join(reversed(WORDS))}", "en", "b"), (5, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").cache()


def test_text_is_longer_than_a_step():
    assert len(LONG) > shared.STEP_BYTES * 1.3


def test_contamination(spark, docs):
    bench = spark.createDataFrame([(7, PASSAGE)], "item_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["contaminated"]) for r in decontaminate.contamination(docs, bench).collect()}
    assert got == {1: (230_000, 0, False), 2: (230_060, 60, False), 3: (3, 0, False), 4: (230_060, 60, False), 5: (0, 0, False)}


def test_jaccard(docs):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(docs.select("doc_id", "text")).collect()}
    own = len({tuple(WORDS[k : k + 5]) for k in range(len(WORDS) - 4)})
    assert got == {1: (own, 1), 2: (own + 60, 1), 3: (1, 3), 4: (own + 60, 4), 5: (0, 5)}


def test_substring(docs):
    got = {r["doc_id"]: r["text"] for r in substring.dedup_units(docs.filter("doc_id != 4")).collect()}
    assert got[1] == LONG and got[3] == "short text between" and got[5] is None
    left = got[2].split()
    assert len(left) < 120 and set(PASSAGE.split()) <= set(left)  # all but the ends of what stands in document 1 is cut


def test_packing_and_token_counts(docs):
    from tokenizers import Tokenizer

    path, ids = packing.default_tokenizer(), collections.defaultdict(list)
    for r in packing.pack(docs.filter("doc_id in (1, 3)"), path).collect():
        ids[r["doc_id"]].append((r["start"], np.frombuffer(bytes(r["ids"]), "<u4").tolist()))
    whole = {i: [x for _, part in sorted(parts) for x in part] for i, parts in ids.items()}
    assert whole[1] == [*Tokenizer.from_file(path).encode(LONG, add_special_tokens=False).ids, 1]
    model = token_counts.default_vocabulary()
    count = token_counts.counter(model)
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(docs, model).collect()}
    assert got == {i: count(t or "")[0] for i, t in ((1, LONG), (2, f"{LONG} {PASSAGE}"), (3, "short text between"), (4, f"{PASSAGE} {' '.join(reversed(WORDS))}"), (5, ""))}


def test_toxicity_sees_the_end(spark, docs):
    rows = [(k, " ".join(["plain", "words", "only", "idiot" if k % 4 == 0 else "calm"])) for k in range(400)]
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(400)], "doc_id long, toxic int")
    model = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    ends = spark.createDataFrame([(1, LONG), (2, f"{LONG} idiot")], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in toxicity.score(ends, model).collect()}
    assert got[2] > got[1]


def test_mixing_and_divergence(docs):
    sizes = {r["doc_id"]: r["size"] for r in mixing.sized(docs, 1).collect()}
    assert sizes == {1: 230_000, 2: 230_060, 3: 3, 4: 230_060, 5: 0}
    got = divergence.audit(docs.select("text", "lang", "source"), least_docs=2).collect()
    assert {(r["lang"], r["source"], r["item"]) for r in got if r["part"] == "pair"} == {("en", "a", "b"), ("en", "b", "a")} and {r["item"] for r in got if r["part"] == "term" and r["source"] == "b"} >= {"passage"}


def test_hashed_words_of_one_long_text():
    """What the language model counts is made of these."""
    data = np.frombuffer(LONG.encode(), np.uint8)
    h, row, start, end = shared.hashed_words(data, np.array([0, len(data)]))
    assert len(h) == 230_000 and not row.any() and bytes(data[start[-1] : end[-1]]).decode() == WORDS[-1]
