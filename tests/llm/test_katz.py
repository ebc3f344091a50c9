import math
import re
from collections import Counter

import pytest

from graphloom.llm import katz

SCHEMA = "doc_id long, text string"


def words(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def brute(texts, k=5, least=1):
    uni, bi, hist = Counter(), Counter(), Counter()
    for t in texts:
        w = words(t)
        uni.update(w)
        for h, x in zip(["<s>", *w], w):
            bi[h, x] += 1
            hist[h] += 1
    d1 = katz.discounts(Counter(uni.values()), k)
    d2 = katz.discounts(Counter(bi.values()), k, least)
    total = sum(uni.values())
    d = lambda c, t: t[c] if c < len(t) else 1.0
    p1 = {w: d(c, d1) * c / total for w, c in uni.items()}
    kept = {b: c for b, c in bi.items() if c >= least}
    mass, lower = Counter(), Counter()
    for (h, w), c in kept.items():
        mass[h] += d(c, d2) * c / hist[h]
        lower[h] += p1[w]

    def p(h, w):
        if (h, w) in kept:
            return d(kept[h, w], d2) * kept[h, w] / hist[h]
        alpha = (1 - mass[h]) / (1 - lower[h]) if 1 - lower[h] > 1e-12 else 0.0
        return alpha * p1[w]

    return p, p1, hist


def corpus():
    import random

    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)]
    return [" ".join(r.choices(vocabulary, [1 / (i + 1) for i in range(60)], k=r.randint(0, 40))) for _ in range(80)]


@pytest.mark.parametrize("least, size", [(1, 1 << 23), (2, 300), (4, 300)])
def test_scores_are_those_of_plain_recursion(spark, monkeypatch, least, size):
    monkeypatch.setattr(katz, "CHUNK", size)  # the functions sent to workers carry it along by value
    monkeypatch.setattr(katz, "SHARD", size)
    texts = [*corpus(), None, "", "!!!", corpus()[0]]
    docs = spark.createDataFrame([*enumerate(texts)], SCHEMA)
    p, p1, hist = brute(texts, least=least)
    got = {r["doc_id"]: r for r in katz.score(docs, min_count=least).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        w = words(t)
        want = sum(math.log(max(p(h, x), 1e-300)) for h, x in zip(["<s>", *w], w))
        assert got[i]["n_tokens"] == len(w)
        assert got[i]["log_prob"] == pytest.approx(want, abs=1e-3)
        assert (got[i]["perplexity"] is None) == (not w)


def test_query_keeps_bigrams_seen_once(spark, tmp_path):
    from graphloom.llm import queries

    texts = [*corpus(), "only here", None]
    spark.createDataFrame([*enumerate(texts)], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    p, _, _ = brute(texts)
    got = {r["doc_id"]: r["log_prob"] for r in queries.op2_katz_backoff(spark, str(tmp_path)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        w = words(t)
        assert got[i] == pytest.approx(sum(math.log(max(p(h, x), 1e-300)) for h, x in zip(["<s>", *w], w)), abs=1e-3)


@pytest.mark.parametrize("least", [1, 2])
def test_probabilities_after_each_history_sum_to_one(spark, least):
    texts = corpus()
    docs = spark.createDataFrame([*enumerate(texts)], SCHEMA)
    table, bigrams = (t.toPandas() for t in katz.model_tables(docs, min_count=least))
    unknown = 1 - table.p.sum()
    assert 0 <= unknown < 1
    lower = dict(zip(table.w, table.p))
    for h, m, alpha in table[["w", "m", "alpha"]].itertuples(index=False):
        if m:
            own = bigrams[bigrams.h == h]
            rest = sum(lower.values()) + unknown - sum(lower[w] for w in own.w)
            assert own.p.sum() + alpha * rest == pytest.approx(1)


def test_odd_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert katz.score(empty).count() == 0
    odd = spark.createDataFrame([(None, "a b a b", 1), (1, None, 2), (1, "a b", 3), (1, "a b", 4), (2, "x " * 40_000, 5)], "doc_id long, text string, chunk int")
    rows = katz.score(odd).collect()
    assert sorted(r["n_tokens"] for r in rows) == [0, 2, 2, 4, 40_000]
    assert [f.name for f in katz.score(odd).schema] == ["doc_id", "n_tokens", "log_prob", "perplexity"]
