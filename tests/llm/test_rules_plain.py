"""Rules of the llm operators held to plain loops that share no code with them: lines of the substring dedup, votes, moments and posteriors of the toxicity model."""

import math
import re

import numpy as np
import pytest

from stallwise.llm import substring, toxicity


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def kept_lines(rows):
    """Every text without the lines of 8 words or more that an earlier line holds, by (doc_id, place)."""
    seen, out = set(), {}
    for d, t in sorted(rows):
        kept = []
        for line in t.splitlines(keepends=True) if t else []:
            words = tuple(re.findall(r"[^\x20\x09-\x0D]+", lower(line)))
            if len(words) < 8 or words not in seen:
                kept.append(line)
            if len(words) >= 8:
                seen.add(words)
        out[d] = "".join(kept)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_lines_by_a_plain_loop(spark, seed):
    """Lines of 7 to 30 words from a small store, each followed by one of its own, so that no run of words is shared but inside lines."""
    rng = np.random.default_rng(seed)
    store = [" ".join(f"s{k}{'Éa'[k % 2]}{i}" for i in range(7 + k % 24)) for k in range(60)]
    rows = []
    for d in range(120):
        lines = []
        for _ in range(int(rng.integers(0, 9))):
            line = store[int(rng.integers(60))]
            lines.append([line, line.upper(), line.replace(" ", " \t"), line + "  "][int(rng.integers(4))])
            lines.append(" ".join(f"own{x}" for x in rng.integers(0, 1 << 40, int(rng.integers(1, 12)))) + "\n" * int(rng.integers(0, 2)))
        rows.append((d, "\n".join(lines)))
    got = {r["doc_id"]: r for r in substring.dedup_units(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = kept_lines(rows)
    assert {d: r["text"] for d, r in got.items()} == want
    assert sum(len(t) for _, t in rows) > 1.2 * sum(map(len, want.values()))
    texts = dict(rows)
    for d, r in got.items():
        for x in r["removed"]:
            words = re.findall(r"[^\x20\x09-\x0D]+", lower(texts[d][x["start"] : x["end"]]))
            assert len(words) >= 8 and x["keeper"] <= d and " ".join(words) in " ".join(re.findall(r"[^\x20\x09-\x0D]+", lower(texts[x["keeper"]])))


def plain_votes(text):
    """By name: which lexicon words and second persons a text has, both patterns, and "clean"."""
    words = set(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(text or "")))
    out = {w: w in words for w in (*toxicity.LEXICON, *toxicity.SECOND_PERSON)}
    capitals, letters = len(re.findall("[A-Z]", text or "")), len(re.findall("[A-Za-z]", text or ""))
    out["shout"] = letters >= 20 and capitals > 0.3 * letters
    out["marks"] = 100 * (text or "").count("!") > max(len((text or "").encode()), 1)
    out["clean"] = not any(out[w] for w in toxicity.LEXICON)
    return out


def test_votes_and_moments_by_a_plain_loop(spark):
    rng = np.random.default_rng(5)
    pool = [*toxicity.LEXICON, *toxicity.SECOND_PERSON, "idiotic", "ratsé", "good", "day", "é", "中文", "Lo", "MI", "x9"]
    texts = []
    for _ in range(300):
        t = " ".join(rng.choice(pool, int(rng.integers(0, 12)))) + "!" * int(rng.integers(0, 3)) * int(rng.integers(0, 2))
        texts.append(t.upper() if rng.random() < 0.2 else t)
    texts += [None, "", "!" * 50, "A" * 19, "A" * 20, "you,YOU;You"]
    voters = toxicity.Voters(np.zeros(0, np.uint64))
    both, n = toxicity.gathered_moments(spark.createDataFrame([(t,) for t in texts], "text string").repartition(5), voters)
    votes = [plain_votes(t) for t in texts]
    at = {w: int(np.searchsorted(voters.table, np.uint64(toxicity.word_hash(w)))) for w in (*toxicity.LEXICON, *toxicity.SECOND_PERSON)}
    at |= {"shout": voters.n - 3, "marks": voters.n - 2, "clean": voters.n - 1}
    assert n == len(texts) and len(set(at.values())) == voters.n
    for a in at:
        for b in at:
            assert both[at[a], at[b]] == sum(v[a] and v[b] for v in votes), (a, b)


def simulated(n, prior, toxic_rates, clean_rates, seed):
    rng = np.random.default_rng(seed)
    y = rng.random(n) < prior
    return y, np.where(y[:, None], rng.random((n, len(toxic_rates))) < toxic_rates, rng.random((n, len(toxic_rates))) < clean_rates)


def test_moments_alone_find_the_accuracies_of_independent_voters():
    """Without one labelled row, P(toxic | voter fires) follows from how often each two voters fire together."""
    prior, up, down = 0.2, np.array([0.7, 0.5, 0.6, 0.4, 0.8, 0.3]), np.array([0.05, 0.02, 0.10, 0.05, 0.10, 0.02])
    _, votes = simulated(400_000, prior, up, down, 11)
    x = votes.astype(float)
    zero = np.zeros(6)
    model = toxicity.LabelModel(len(x), x.T @ x, prior, np.full(6, 0.5), zero, zero)
    truth = prior * up / (prior * up + (1 - prior) * down)
    assert np.abs(model.precision - truth).max() < 0.03, (model.precision, truth)
    assert not model.residual.any()  # independent voters leave no correlations


def test_two_equal_voters_are_found_correlated():
    prior, up, down = 0.2, np.array([0.7, 0.5, 0.6, 0.4, 0.8]), np.array([0.05, 0.02, 0.10, 0.05, 0.10])
    y, votes = simulated(200_000, prior, up, down, 12)
    x = np.concatenate((votes, votes[:, :1]), axis=1).astype(float)  # the last voter repeats the first
    model = toxicity.LabelModel(len(x), x.T @ x, prior, np.full(6, 0.5), x.sum(axis=0), x[y].sum(axis=0))
    tied = np.argwhere(model.residual > 0).tolist()
    assert tied == [[0, 5], [5, 0]]
    single = toxicity.LabelModel(len(x), x[:, :5].T @ x[:, :5], prior, np.full(5, 0.5), x[:, :5].sum(axis=0), x[y][:, :5].sum(axis=0))
    twice, once = model.posterior(np.array([[1, 0, 0, 0, 0, 1]])), single.posterior(np.array([[1, 0, 0, 0, 0]]))
    # Counted in full, the second vote would add its whole log odds.
    full = 1 / (1 + math.exp(-(math.log(prior / (1 - prior)) + 2 * single.ratio[0])))
    assert abs(twice[0] - once[0]) < abs(full - once[0])


def test_posterior_by_a_plain_loop():
    rng = np.random.default_rng(3)
    y, votes = simulated(5_000, 0.3, np.array([0.6, 0.5, 0.4, 0.7]), np.array([0.1, 0.2, 0.05, 0.1]), 4)
    votes[:, 3] = votes[:, 0] ^ (rng.random(5_000) < 0.05)  # correlated with the first
    x = votes.astype(float)
    model = toxicity.LabelModel(len(x), x.T @ x, 0.3, np.full(4, 0.5), x.sum(axis=0), x[y].sum(axis=0))
    for i in range(4):  # with many labelled rows the precision is theirs
        fires = [bool(b) for b, v in zip(y, votes, strict=True) if v[i]]
        assert model.precision[i] == pytest.approx(sum(fires) / len(fires), abs=0.01)
    got = model.posterior(votes[:200])
    for v, p in zip(votes[:200], got, strict=True):
        odds = math.log(0.3 / 0.7)
        for i in range(4):
            if v[i]:
                weight = 1 + sum(model.residual[j, i] for j in range(4) if v[j])
                odds += (math.log(model.precision[i] / (1 - model.precision[i])) - math.log(0.3 / 0.7)) / weight
        assert p == pytest.approx(1 / (1 + math.exp(-max(-30.0, min(30.0, odds)))), abs=1e-12)
