"""URL filters and token counts against brute force."""

import datetime as dt
import random

from pyspark.sql import functions as F

from stallwise.llm import token_counts, urls

T = dt.datetime(2024, 1, 1)


def day(n):
    return T + dt.timedelta(days=n)


def test_intervals(spark):
    log = [("host", "A.com", day(1), True), ("host", "a.com", day(2), True), ("host", "a.com", day(3), False), ("host", "a.com", day(5), True), ("host", "b.com", day(1), False), ("host", "c.com", day(4), True), ("host", "c.com", day(4), False), ("host", None, day(1), True), ("prefix", "X.com/Ab", day(1), True), ("host", "a.com", day(1), True)]
    df = spark.createDataFrame(log, "kind string, pattern string, dated timestamp, listed boolean").withColumn("until", F.lit(1))
    got = {(r["kind"], r["pattern"], r["since"], r["until"]) for r in urls.intervals(df).collect()}
    assert got == {("host", "a.com", day(1), day(3)), ("host", "a.com", day(5), None), ("prefix", "x.com/Ab", day(1), None)}


def test_evaluate(spark):
    log = [("domain", "ex.com", day(2), True), ("domain", "ex.com", day(4), False), ("prefix", "q.org/a/b", day(0), True), ("url", "z.net/p?x=1", day(0), True), ("host", "h.io", day(9), True)]
    entries = spark.createDataFrame(log, "kind string, pattern string, dated timestamp, listed boolean")
    rows = [
        (1, "https://m.EX.com/x#y", day(3)), (2, "https://m.ex.com/x", day(4)), (3, "http://notex.com", day(3)), (4, "q.org/a/b/c?d", day(1)), (5, "https://q.org/a/bc", day(1)), (6, "http://u@z.net:80/p?x=1#f", day(1)),
        (7, None, day(3)), (8, "", day(3)), (9, "https://h.io/", None), (1, "https://m.EX.com/x#y", day(3)), (10, "https://h.io", day(9)),
    ]
    captures = spark.createDataFrame(rows, "page_id long, url string, fetched_at timestamp").withColumn("rules", F.lit("x")).withColumn("kind", F.lit(0))
    got = sorted((r["page_id"], list(r["rules"])) for r in urls.evaluate(captures, entries, "page_id").collect())
    want = {1: ["domain:ex.com"], 4: ["prefix:q.org/a/b"], 6: ["url:z.net/p?x=1"], 10: ["host:h.io"]}
    assert got == sorted((i, want.get(i, [])) for i, _, _ in rows)
    assert urls.evaluate(captures.limit(0), entries, "page_id").count() == 0
    assert not urls.evaluate(captures, entries.limit(0), "page_id").filter("blocked").count()


def test_very_long_urls(spark):
    """100,000 segments and 50,000 labels: only the depths that the list has are made."""
    long = "/".join(f"s{k}" for k in range(100_000))
    log = [("prefix", "q.org/s0/s1", day(0), True), ("prefix", "q.org/" + long, day(0), True), ("domain", "a.b", day(0), True)]
    entries = spark.createDataFrame(log, "kind string, pattern string, dated timestamp, listed boolean")
    rows = [(1, "https://q.org/" + long, day(1)), (2, "https://" + "x." * 50_000 + "a.b/" + long, day(1)), (3, "https://r.org/" + long, day(1)), (4, "q.org/s0/s1/", day(1)), (5, "q.org/s0", day(1))]
    captures = spark.createDataFrame(rows, "page_id long, url string, fetched_at timestamp")
    got = {r["page_id"]: list(r["rules"]) for r in urls.evaluate(captures, entries, "page_id").collect()}
    assert got == {1: ["prefix:q.org/" + long[:5], "prefix:q.org/" + long], 2: ["domain:a.b"], 3: [], 4: ["prefix:q.org/s0/s1"], 5: []}


def brute(pieces, text):
    """(count, bytes, score) by trying all edges start by start, as the tokenizer does."""
    table, n = dict(pieces), len(text)
    low = min(table.values(), default=0.0) - 10.0
    best = [(0, 0, 0.0)] + [None] * n
    for at in range(n):
        if best[at] is None:
            continue
        edges = [(at + k, 1, 0, table[text[at : at + k]]) for k in range(1, n - at + 1) if text[at : at + k] in table]
        if text[at] not in table:
            size = len(text[at].encode())
            edges.append((at + 1, size, size, low))
        for to, c, f, s in edges:
            new = (best[at][0] + c, best[at][1] + f, best[at][2] + s)
            if best[to] is None or new[2] > best[to][2]:
                best[to] = new
    return best[n]


def test_viterbi_and_ties():
    rng = random.Random(2)
    for _ in range(300):
        alphabet = "ab" + token_counts.SPACE + "é"
        pieces = {"".join(rng.choice(alphabet) for _ in range(rng.randint(1, 4))): float(-rng.randint(1, 4)) for _ in range(8)}
        count = token_counts.Counter(list(pieces.items()))
        for _ in range(10):
            text = "".join(rng.choice("ab é😀") for _ in range(rng.randint(0, 9)))
            whole = token_counts.SPACE + text.replace(" ", token_counts.SPACE) if text else ""
            assert count(text) == brute(pieces, whole)


def test_counts_agree_with_a_tokenizer_of_the_same_model():
    import sentencepiece
    from tokenizers import Tokenizer, models

    path = token_counts.default_vocabulary()
    m = sentencepiece.SentencePieceProcessor(model_file=path)
    other = Tokenizer(models.Unigram([(m.IdToPiece(i), m.GetScore(i)) for i in range(m.GetPieceSize())], 0, True))
    count, rng = token_counts.counter(path), random.Random(1)
    parts = ["the", "ing", " ", "  ", "é", "中", "\n", "zzzq", "hello", "▁", "œ", "😀", "a", "tion", "Un"]
    for _ in range(1000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        whole = token_counts.SPACE + text.replace(" ", token_counts.SPACE) if text else ""
        assert count(text)[0] == len(other.encode(whole, add_special_tokens=False).ids)


def test_counts_of_rows(spark):
    path = token_counts.default_vocabulary()
    rows = [(1, "hello world"), (2, None), (3, ""), (None, "x"), (1, "hello world"), (4, "word " * 20000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("s"))
    got = sorted(((r["doc_id"] or 0, r["n_tokens"]) for r in token_counts.token_counts(df, path).collect()))
    count = token_counts.counter(path)
    assert got == sorted((i or 0, count(t or "")[0]) for i, t in rows) and token_counts.token_counts(df.limit(0), path).count() == 0
