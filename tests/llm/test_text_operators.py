"""Operators on texts against brute force, and on odd tables: nulls, empty and long texts, ties, repeats, extra columns."""

import random
import re

import numpy as np
import pytest

from graphloom.llm import bpe, decontaminate, importance, langid, simhash, spans, textcore, toxicity

SCHEMA = "doc_id long, text string, lang string"
ODD = [(None, "one two three", "en"), (1, None, None), (2, "", "en"), (3, "?!", ""), (4, "word " * 30_000, "en"), (5, "same text here", "de"), (5, "same text here", "de"), (5, "other", "de"), (6, "same text here", None)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, i, "x", i) for i, r in enumerate(ODD)], SCHEMA + ", tid long, gone string, `__tid` long").cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


def sentence(r, n=8, words=400):
    return " ".join(f"w{r.randrange(words)}" for _ in range(n)).capitalize() + ". "


# importance resampling


def test_importance_weights_and_draw(spark, odd, empty, no_labels):
    r = random.Random(1)
    rows = [(i, " ".join(f"{'good' if i % 2 else 'bad'}{r.randrange(20)}" for _ in range(30)), "en") for i in range(60)]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    got = importance.resample(docs, labels, share=0.5).toPandas().set_index("doc_id")
    assert got.selected.sum() == 30
    assert got[got.index % 2 == 1].selected.mean() > 0.9

    # weights by plain counting
    def grams(t):
        w = t.split()
        pairs = [textcore.ngrams(next(textcore.words([f"{a} {b}"])), 2)[0][0] for a, b in zip(w, w[1:])]
        return [int(x) % importance.BUCKETS for x in [*(textcore.word_hash(x) for x in w), *pairs]]

    target, raw = np.zeros(importance.BUCKETS), np.zeros(importance.BUCKETS)
    for i, t, _ in rows:
        for g in grams(t):
            raw[g] += 1
            target[g] += i < 40 and i % 2
    ratio = np.log((target + 1) / (target + 1).sum()) - np.log((raw + 1) / (raw + 1).sum())
    for i, t, _ in rows[:10]:
        assert got.log_weight[i] == pytest.approx(sum(ratio[g] for g in grams(t)), abs=1e-5)
    assert importance.resample(empty, no_labels).count() == 0
    out = importance.resample(odd, no_labels, share=0.5).collect()
    assert len(out) == len(ODD) and sum(x["selected"] for x in out) == 4
    assert not any(x["selected"] for x in out if x["log_weight"] is None)


def test_the_draw_is_a_gumbel_top_k(spark, no_labels):
    from pyspark.sql import functions as F

    r = random.Random(31)
    rows = [(i % 50, f"a{r.randrange(9)} b{r.randrange(9)}", "en") for i in range(200)]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(50)], "doc_id long, quality int, toxic int")
    tid = F.xxhash64("text")
    noise = {(x["doc_id"], x["text"]): x["n"] for x in docs.withColumn("n", F.xxhash64(F.lit(importance.SEED), "doc_id", tid)).collect()}
    weight = {}
    for x, y in zip(importance.weigh(docs.select("doc_id", "text"), importance.log_ratio(*importance.bucket_counts(docs.select("doc_id", "text"), labels.where("quality = 1").select("doc_id")))).collect(), rows):
        weight[y[0], y[1]] = x["log_weight"]

    def key(i, t):
        u = (int(textcore.mix(np.array([noise[i, t]], np.int64).view(np.uint64))[0]) >> 11) + 0.5
        return weight[i, t] - np.log(-np.log(u / 2.0**53))

    for k in (1, 60, 199):
        best = sorted((key(i, t) for i, t, _ in rows), reverse=True)[:k]
        got = importance.resample(docs, labels, k=k).where("selected").collect()
        assert len(got) == k
        assert sorted(x["log_weight"] for x in got) == pytest.approx(sorted(weight[i, t] for i, t in [min(weight, key=lambda it: abs(key(*it) - b)) for b in best]), abs=1e-6)


def test_kth_largest_is_exact(spark):
    r = random.Random(2)
    values = [r.choice([-(2**62), -5, 0, 7, r.getrandbits(60)]) for _ in range(200)]
    df = spark.createDataFrame([(v,) for v in values], "o long")
    top = sorted(values, reverse=True)
    for k in (1, 17, 200):
        least, above = importance.kth_largest(df, k)
        assert (least, above) == (top[k - 1], sum(v > top[k - 1] for v in values))


def test_words_of_long_texts_are_those_of_short_ones():
    r = random.Random(51)
    most = 64
    for _ in range(40):
        parts = ["x" * r.choice([1, 5, 63, 64, 65, 130, 400]) for _ in range(r.randint(1, 12))]
        text = r.choice(["", " ", "..."]) + r.choice([" ", ", "]).join(parts) + r.choice(["", " ", "!"])
        assert "".join(textcore.pieces(text, most)) == text
        got = next(textcore.words([text], (4,), most))
        assert got.lengths.tolist() == [len(p) for p in parts]
        assert got.hashes.tolist() == [textcore.word_hash(p) for p in parts]
    long = "z" * (2 * textcore.SLICE) + " end"
    assert next(textcore.words([long])).lengths.tolist() == [2 * textcore.SLICE, 3]


# language


def test_language_network(spark, odd, empty):
    r = random.Random(3)
    vocabulary = {"aa": ["the", "and", "thing", "over"], "bb": ["der", "und", "schön", "ging"], "cc": ["é", "que", "mañana", "pero"]}
    make = lambda k, n: " ".join(r.choices(vocabulary[k], k=n))
    docs = [(i, make(k, r.randint(5, 200)), k) for i, k in enumerate(["aa", "bb", "cc"] * 40)]
    net = langid.train([t for _, t, _ in docs], [k for _, _, k in docs])
    held_out = [(make(k, r.randint(5, 60)), k) for k in ["aa", "bb", "cc"] * 30]
    names, p = net.identify([t for t, _ in held_out])
    assert np.mean([a == b for a, (_, b) in zip(names, held_out)]) > 0.97
    assert ((p > 1 / 3 - 1e-9) & (p <= 1)).all()
    # a long text is all of its windows
    assert net.identify([make("aa", 3) + " " + make("bb", 60_000)])[0] == ["bb"]
    got = langid.identify(odd).collect()
    assert len(got) == len(ODD)
    assert all((x["language"] is None) == (x["confidence"] is None) for x in got)
    assert sum(x["language"] is None for x in got) == 2
    assert langid.identify(empty).count() == 0


def plain_network(net, window):
    """A window's probabilities, one position and filter at a time."""
    wide, e = len(net.filters) // net.embedding.shape[1], net.embedding.shape[1]
    pooled = []
    for k in range(net.filters.shape[1]):
        best = -np.inf
        for at in range(len(window)):
            total = 0.0
            for o in range(wide):
                if at + o < len(window):
                    for j in range(e):
                        total += float(net.embedding[window[at + o], j]) * float(net.filters[o * e + j, k])
            best = max(best, total)
        pooled.append(max(best + float(net.bias[k]), 0.0))
    z = [sum(p * float(net.out[i, c]) for i, p in enumerate(pooled)) + float(net.out_bias[c]) for c in range(len(net.languages))]
    top = max(z)
    return np.array([x - top - np.log(sum(np.exp(y - top) for y in z)) for x in z])


def test_language_network_against_loops():
    r = np.random.default_rng(8)
    net = langid.train(["abc abd " * 30, "xyz xyy " * 30], ["p", "q"], epochs=1)
    w = r.integers(0, 256, (3, 20), np.uint8)
    w[0, 9:] = 0
    assert np.allclose(net.log_probabilities(w), [plain_network(net, x) for x in w], atol=1e-4)
    # gradients by small steps, in double precision
    for f in ("embedding", "filters", "bias", "out", "out_bias"):
        setattr(net, f, getattr(net, f).astype(np.float64))
    label, weight, mask = np.array([0, 1, 1]), np.array([1.0, 0.5, 2.0]), np.ones(net.filters.shape)
    loss = lambda: -(net.log_probabilities(w)[np.arange(3), label] * weight).mean()
    grads = net.gradients(w, label, weight, mask)
    for f, g in zip(("embedding", "filters", "bias", "out", "out_bias"), grads):
        p = getattr(net, f)
        for at in [tuple(r.integers(0, n) for n in p.shape) for _ in range(12)]:
            if f == "embedding":
                at = (int(w[1, at[0] % 20]) or 1, at[1])
            old = p[at]
            p[at] = old + 1e-6
            up = loss()
            p[at] = old - 1e-6
            down = loss()
            p[at] = old
            assert g[at] == pytest.approx((up - down) / 2e-6, abs=1e-5)


def test_languages_of_repeated_ids_are_sampled(spark):
    rows = [(7, f"aa text {i}", "aa") for i in range(300)] + [(None, f"bb text {i}", "bb") for i in range(300)] + [(i, "cc same", "cc") for i in range(100)] + [(5, "cc twice", "cc")] * 40
    few = langid.labelled(spark.createDataFrame(rows, SCHEMA), per_language=50).toPandas()
    assert few.groupby("lang").size().to_dict() == {"aa": 50, "bb": 50, "cc": 50}
    few = langid.labelled(spark.createDataFrame(rows, SCHEMA), per_language=500, most=2).toPandas()
    assert few.groupby("lang").size().to_dict() == {"aa": 300, "bb": 300}


# toxicity


def plain_features(text, lexicon):
    """The features of one text, a word and a character at a time."""
    words = re.findall(r"[^\W_]+", text.lower())
    second = set(toxicity.SECOND)
    hit = [w in lexicon for w in words]
    you = [i for i, w in enumerate(words) if w in second]
    near = sum(h and any(abs(i - y) <= toxicity.NEAR for y in you) for i, h in enumerate(hit))
    letters = [c for c in text if textcore.word_table()[ord(c)]]
    capitals = sum(c.isupper() for c in text)
    odd = sum(text[i] in "@$*#0134579!|" and all(textcore.word_table()[ord(c)] and not c.isdigit() for c in (text[i - 1], text[i + 1])) for i in range(1, len(text) - 1))
    size = max(sum(not c.isspace() for c in text), 1)
    marks = sum(not c.isspace() and not textcore.word_table()[ord(c)] for c in text)
    n = max(len(words), 1)
    return [sum(hit) / n, np.log1p(sum(hit)), near / max(sum(hit), 1), len(you) / n, capitals / max(len(letters), 1), float(capitals > 0.5 * max(len(letters), 1)), text.count("!") / size, marks / size, odd / size, np.log1p(len(words))]


def test_toxicity_features_against_loops():
    r = random.Random(41)
    pieces = ["idiot", "you", "YOUR", "m0ron", "moron!", "nice", "st*pid", "A", "3rd", "...", "trash,", "é", "\n", "x" * 30]
    texts = [" ".join(r.choices(pieces, k=r.randint(0, 60))) for _ in range(60)] + ["", "!!!", "you " * 90_000 + "idiot", "m0ron " * 60_000 + "yo@u " * 180_000]
    lexicon = {0: np.sort(np.array([textcore.word_hash(w) for w in toxicity.BASE], np.uint64))}
    assert len(texts[-1]) > textcore.SLICE
    assert np.allclose(toxicity.features([*texts, None], lexicon), [plain_features(t, toxicity.BASE) for t in [*texts, ""]])


def plain_boost(x, y, rounds, depth, rate, bins, l2):
    """Boosted trees, every cut of every feature tried on every node."""
    cuts = [sorted(set(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1]))) for j in range(x.shape[1])]
    margin = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-margin))
        g, h, leaves = y - q, q * (1 - q), [np.arange(len(y))]
        for _ in range(depth):
            new = []
            for rows in leaves:
                best, split = 1e-6, (rows, rows[:0])
                for j, own in enumerate(cuts):
                    for c in own:
                        a, b = rows[x[rows, j] <= c], rows[x[rows, j] > c]
                        gain = sum(g[k].sum() ** 2 / (h[k].sum() + l2) * s for k, s in ((a, 1), (b, 1), (rows, -1)))
                        if gain > best + 1e-12:
                            best, split = gain, (a, b)
                new += split
            leaves = new
        for rows in leaves:
            margin[rows] += rate * g[rows].sum() / (h[rows].sum() + l2)
    return margin


def test_boosting_against_loops():
    r = np.random.default_rng(9)
    x = np.round(r.normal(size=(120, 3)), 2)
    y = (x[:, 0] + x[:, 1] ** 2 + 0.3 * r.normal(size=120) > 0.8).astype(float)
    trees = toxicity.boost(x, y, rounds=4, depth=2, rate=0.3, bins=8, l2=1.0)
    assert np.allclose(trees.margin(x), plain_boost(x, y, 4, 2, 0.3, 8, 1.0))


def test_isotonic_against_its_definition():
    r = np.random.default_rng(10)
    x, y = r.integers(0, 30, 80) / 10, r.integers(0, 2, 80).astype(float)
    at, p = toxicity.isotonic(x, y)
    groups = [y[x == u] for u in at]
    mean = lambda a, b: np.concatenate(groups[a : b + 1]).mean()
    want = [max(min(mean(a, b) for b in range(i, len(at))) for a in range(i + 1)) for i in range(len(at))]
    assert np.allclose(p, want)


def test_toxicity(spark, odd, empty, no_labels):
    r = random.Random(4)
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        words = [f"w{r.randrange(300)}" for _ in range(40)]
        if bad:
            for _ in range(4):
                words[r.randrange(40)] = r.choice(["you idiot", "zorgling", "zorgath", "moron"])
        rows.append((i, " ".join(words), "en"))
        labels.append((i, 1, int(bad)))
    docs = spark.createDataFrame(rows, SCHEMA)
    got = toxicity.classify(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).toPandas()
    assert (got.toxic == (got.doc_id % 4 == 0)).mean() > 0.97
    kept = toxicity.drop_toxic(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert kept.columns == docs.columns and {x["doc_id"] for x in kept.collect()} == set(got.doc_id[~got.toxic])
    out = toxicity.classify(odd, no_labels).collect()
    assert len(out) == len(ODD) and not any(x["toxic"] for x in out)
    assert toxicity.drop_toxic(odd, no_labels).columns == odd.columns
    assert toxicity.classify(empty, no_labels).count() == 0


def test_isotonic_is_monotone():
    r = np.random.default_rng(1)
    x = r.random(200)
    at, p = toxicity.isotonic(x, (r.random(200) < x).astype(float))
    assert (np.diff(at) > 0).all() and (np.diff(p) >= 0).all()


# near duplicates


def test_simhash_recall_and_components(spark, odd, empty):
    r = random.Random(5)
    base = [" ".join(f"w{r.randrange(5000)}" for _ in range(80)) for _ in range(60)]
    rows = [(i, t, "en") for i, t in enumerate(base)]
    for i in range(30):  # near copies: two of 80 words changed; and copies
        words = base[i].split()
        words[r.randrange(80)] = "changed"
        words[r.randrange(80)] = "again"
        rows += [(100 + i, " ".join(words), "en"), (200 + i, base[i], "en")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {x["doc_id"]: x["kept_id"] for x in simhash.duplicates(docs).collect()}
    assert all(got.get(200 + i) == i for i in range(30))
    # pairs by brute force on the same signatures
    sig = simhash.signatures(docs).toPandas()
    bits = np.unpackbits(np.ascontiguousarray(sig[["s0", "s1", "s2", "s3"]].to_numpy(np.int64)).view(np.uint8), axis=1)
    near = {(a, b) for i, a in enumerate(sig.doc_id) for j, b in enumerate(sig.doc_id) if a < b and (bits[i] != bits[j]).sum() <= simhash.MAX_DISTANCE}
    assert near and all(got.get(a, a) == got.get(b, b) for a, b in near)
    assert not any(30 <= k < 100 for k in got)
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and {x["doc_id"] for x in kept.collect()} == {r[0] for r in rows} - set(got)
    out = simhash.drop_near_duplicates(odd).collect()
    # rows are judged by their text, whatever their id; documents without words stay
    assert sorted((x["doc_id"] is None, x["doc_id"] or 0) for x in out) == [(False, 1), (False, 2), (False, 3), (False, 4), (False, 5), (False, 5), (True, 0)]
    assert simhash.duplicates(empty).count() == 0


def test_simhash_of_repeated_ids(spark):
    r = random.Random(12)
    base = [" ".join(f"w{r.randrange(5000)}" for _ in range(80)) for _ in range(30)]
    near = lambda t: " ".join([*t.split()[:-1], "changed"])
    # each of the ids has two different texts; a near copy of either has an id of its own
    rows = [(i, base[2 * i + k], "en") for i in range(10) for k in range(2)]
    rows += [(100 + 2 * i + k, near(base[2 * i + k]), "en") for i in range(10) for k in range(2)]
    rows += [(None, near(base[0]), "en"), (None, base[25], "en"), (None, base[25], "en"), (None, "", "en"), (None, None, "en"), (200, base[26], "en"), (200, base[26], "en")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {x["doc_id"]: x["kept_id"] for x in simhash.duplicates(docs).collect()}
    assert got == {100 + n: n // 2 for n in range(20)}
    kept = simhash.drop_near_duplicate_rows(docs)
    assert kept.columns == docs.columns
    want = [*rows[:20], (None, base[25], "en"), (None, "", "en"), (None, None, "en"), (200, base[26], "en")]
    assert sorted(map(str, map(tuple, kept.collect()))) == sorted(map(str, want))


def test_variants_meet_within_the_radius():
    r = np.random.default_rng(6)
    a = r.integers(-(2**63), 2**63 - 1, (200, 4), np.int64)
    bits = np.unpackbits(a.view(np.uint8), axis=1)
    for row in bits:
        row[r.choice(256, 2 * simhash.SEGMENTS - 1, replace=False)] ^= 1
    b = np.packbits(bits, axis=1).view(np.int64)
    who = np.repeat(np.arange(400), 256)
    keys = np.concatenate([simhash._variant_keys(x, simhash.SEGMENTS).ravel() for x in (a, b)])
    met = {*zip(*(x.tolist() for x in simhash._runs_to_pairs(keys, who, simhash.SEGMENTS)))}
    assert met >= {(i, 200 + i) for i in range(200)}
    # and hardly anything else gets past the ring
    assert len(met) < 210


@pytest.mark.parametrize("segments", [7, 13, 20])
def test_pairs_within_the_radius_are_all_found(spark, segments):
    r = np.random.default_rng(7)
    bits = r.integers(0, 2, (40, 256), np.uint8)
    rows = [bits]
    for _ in range(6):  # chains of signatures, each a little farther off
        rows.append(rows[-1] ^ (r.random((40, 256)) < 0.03).astype(np.uint8))
    bits = np.concatenate(rows)
    sig = np.packbits(bits, axis=1).view(np.int64)
    groups = spark.createDataFrame([(i, *map(int, x)) for i, x in enumerate(sig)], "rep long, s0 long, s1 long, s2 long, s3 long")
    distance = (bits[:, None] != bits[None]).sum(-1)
    want = {(i, j, int(distance[i, j])) for i, j in zip(*np.nonzero(distance <= 2 * segments - 1)) if i < j}
    assert {tuple(x) for x in simhash.near_pairs(groups, segments).collect()} == want and want


def test_large_buckets_lose_no_pair():
    r = np.random.default_rng(8)
    bits = (r.random((2500, 256)) < 0.12).astype(np.uint8)  # many share a segment, few are near
    bits = np.concatenate([bits, bits[:100] ^ (r.random((100, 256)) < 0.05).astype(np.uint8)])
    sig = np.packbits(bits, axis=1).view(np.int64)
    ones = bits.sum(1, dtype=np.int64)
    distance = ones[:, None] + ones - 2 * (bits.astype(np.float32) @ bits.T.astype(np.float32)).astype(np.int64)
    want = {(i, j) for i, j in zip(*(x.tolist() for x in np.nonzero(distance <= simhash.MAX_DISTANCE))) if i < j}
    keys = simhash._variant_keys(sig, simhash.SEGMENTS).ravel()
    a, b = simhash._runs_to_pairs(keys, np.repeat(np.arange(len(sig)), 256), simhash.SEGMENTS)
    near = simhash._apart(sig, a, b) <= simhash.MAX_DISTANCE
    assert {*zip(a[near].tolist(), b[near].tolist())} == want and len(want) > 50


@pytest.mark.parametrize("segments", [7, 13, 20])
def test_links_connect_what_pairs_connect(spark, segments):
    r = np.random.default_rng(9)
    bits = r.integers(0, 2, (30, 256), np.uint8)
    rows = [bits]
    for _ in range(5):
        rows.append(rows[-1] ^ (r.random((30, 256)) < 0.04).astype(np.uint8))
    sig = np.packbits(np.concatenate(rows), axis=1).view(np.int64)
    groups = spark.createDataFrame([(i, *map(int, x)) for i, x in enumerate(sig)], "rep long, s0 long, s1 long, s2 long, s3 long")
    pairs, links = simhash.near_pairs(groups, segments).select("a", "b"), simhash.near_links(groups, segments)
    assert {tuple(x) for x in simhash.components(links).collect()} == {tuple(x) for x in simhash.components(pairs).collect()} != set()


def near_to_each_other(spark, n):
    r = random.Random(21)
    base = [f"w{r.randrange(5000)}" for _ in range(200)]
    return spark.createDataFrame([(i, " ".join([*base[: i % 200], f"x{i}", *base[i % 200 + 1 :]]), "en") for i in range(n)], SCHEMA)


def count_links(monkeypatch):
    counts, real = [], simhash.components
    monkeypatch.setattr(simhash, "components", lambda pairs: counts.append(pairs.count()) or real(pairs))
    return counts


def test_rows_of_a_large_group_are_not_linked_one_by_one(spark, monkeypatch):
    counts = count_links(monkeypatch)
    assert [x["doc_id"] for x in simhash.drop_near_duplicate_rows(near_to_each_other(spark, 300)).collect()] == [0]
    # 39340 pairs of signatures are near
    assert 0 < counts[0] <= 2 * simhash.SEGMENTS * 300


def test_documents_of_a_large_group_are_not_linked_one_by_one(spark, monkeypatch):
    counts = count_links(monkeypatch)
    got = {(x["doc_id"], x["kept_id"]) for x in simhash.duplicates(near_to_each_other(spark, 300)).collect()}
    assert got == {(i, 0) for i in range(1, 300)}
    assert 0 < counts[0] <= 2 * simhash.SEGMENTS * 300


# substring dedup


def split(t):
    return re.findall(r"[^.!?,;:\n]*[.!?,;:\n]+\s*|[^.!?,;:\n]+$", t or "")


def brute_spans(docs):
    """Without the sentences of any run that has been there before, of whatever length, that has 12 words and 2 sentences."""
    seen, gone = set(), {}
    for i, t in docs:
        s = [x.strip(" \t\r\n").lower() for x in split(t)]
        w = [x.count(" ") + 1 for x in s]
        for p in range(len(s)):
            for n in range(1, len(s) - p + 1):
                if sum(w[p : p + n]) >= spans.WORDS if n > 1 else w[p] > spans.SINGLE_WORDS:
                    run = tuple(s[p : p + n])
                    if run in seen:
                        gone.setdefault(i, set()).update(range(p, p + n))
                    seen.add(run)
    return {i: "".join(x for k, x in enumerate(split(t)) if k not in gone.get(i, ())) for i, t in docs}


def test_spans(spark, odd, empty):
    r = random.Random(7)
    shared = ["".join(sentence(r, 9) for _ in range(3)) for _ in range(4)]
    docs = []
    for i in range(40):
        parts = [sentence(r, r.randint(1, 12)) for _ in range(r.randint(1, 10))]
        for s in r.sample(shared, r.randint(0, 2)):
            parts.insert(r.randint(0, len(parts)), s)
        docs.append((i, "".join(parts), "en"))
    got = {x["doc_id"]: x["text"] for x in spans.deduplicate(spark.createDataFrame(docs, SCHEMA)).collect()}
    assert got == brute_spans([d[:2] for d in docs])
    out = spans.deduplicate(odd, removed_col="n")
    assert out.columns == [*odd.columns, "n"]
    assert sorted(str(x["text"]) for x in out.collect()) == sorted(str(x[1]) for x in ODD)
    assert spans.deduplicate(empty).count() == 0
    clash = spark.createDataFrame([(1, "a b c", 5, 6)], "doc_id long, text string, `__tidr` long, `__gone` long")
    assert spans.deduplicate(clash).columns == clash.columns and spans.deduplicate(clash).count() == 1


def test_spans_of_repeated_and_missing_ids(spark):
    r = random.Random(21)
    a, b, c = ("".join(sentence(r, 9, 10**9) for _ in range(3)) for _ in range(3))
    last = (1 << 63) - 1
    rows = [(1, a + b, "en"), (1, b + a, "en"), (1, b + a, "en"), (None, a, "en"), (None, c, "en"), (None, c, "en"), (last, c, "en"), (2, c + c, "en")]
    out = [(x["doc_id"], x["text"]) for x in spans.deduplicate(spark.createDataFrame(rows, SCHEMA)).collect()]
    # of the two texts of id 1 one stays whole; equal rows alike; in document 2, which comes next, only the first time stays
    assert sorted(len(t) for i, t in out if i == 1) in ([0, 0, len(a + b)], [0, len(a + b), len(a + b)])
    assert {(i, t) for i, t in out if i != 1} == {(None, ""), (last, ""), (2, c)}


def test_spans_of_a_text_longer_than_a_slice(spark):
    r = random.Random(22)
    a, b = ("".join(sentence(r, 9, 10**9) for _ in range(4000)) for _ in range(2))
    assert len(a) > textcore.SLICE
    out = {x["doc_id"]: x["text"] for x in spans.deduplicate(spark.createDataFrame([(1, a, "en"), (2, b + a[-400:], "en"), (3, b, "en")], SCHEMA)).collect()}
    assert out[1] == a and out[3] == "" and out[2].startswith(b) and len(out[2]) < len(b) + 100


def brute_passages(docs, least=50):
    """The sentences that lie in a passage of more than ``least`` words that an earlier document has too."""
    cut, gone = [[x.strip(" \t\r\n").lower() for x in split(t)] for _, t in docs], {}
    for k, (i, _) in enumerate(docs):
        for a in cut[:k]:
            for p in range(len(cut[k])):
                for q in range(len(a)):
                    n = 0
                    while p + n < len(cut[k]) and q + n < len(a) and cut[k][p + n] == a[q + n]:
                        n += 1
                    if sum(len(x.split()) for x in a[q : q + n]) > least:
                        gone.setdefault(i, set()).update(range(p, p + n))
    return gone


def test_spans_find_passages_of_any_sentences(spark):
    r = random.Random(11)
    text = lambda sizes: "".join(sentence(r, n, 10**9) for n in sizes)
    shared = [text(x) for x in ([1] * 60, [2] * 30, [3, 1] * 14, [1, 2, 1, 30, 1, 1, 20, 2, 1], [60], [25, 25, 1])]
    docs = [(i, text([5, 2, 9]) + shared[i % 6] + text([1, 12, 2]), "en") for i in range(12)]
    docs.append((12, text([1] * 80 + [12, 3]), "en"))  # short sentences, but nothing that repeats
    gone = brute_passages([d[:2] for d in docs])
    assert set(gone) == set(range(6, 12))
    got = {x["doc_id"]: x for x in spans.deduplicate(spark.createDataFrame(docs, SCHEMA), removed_col="n").collect()}
    for i, t, _ in docs:
        parts = split(t)
        assert got[i]["text"] == "".join(x for k, x in enumerate(parts) if k not in gone.get(i, ())) and got[i]["n"] == len(gone.get(i, ()))


# decontamination


def brute_leaks(docs, items, n, threshold):
    cut = lambda t: [tuple(w[i : i + n]) for w in [re.findall(r"\w+", (t or "").lower())] for i in range(len(w) - n + 1)]
    out = {}
    for item, text in items:
        own = cut(text)
        for doc, t in docs if own else ():
            s = cut(t)
            best = max((len(set(s[i : i + len(own)]) & set(own)) for i in range(len(s))), default=0) / len(set(own))
            if best >= threshold - 1e-9:
                out[doc, item] = round(best, 6)
    return out


@pytest.mark.parametrize("max_broadcast", [decontaminate.MAX_BROADCAST, 0])
def test_decontamination(spark, odd, empty, max_broadcast):
    r = random.Random(8)
    word = lambda: f"w{r.randrange(300)}"
    items = [(i, " ".join(word() for _ in range(r.randint(4, 30)))) for i in range(12)] + [(50, None), (51, ""), (52, "a b")]
    docs = []
    for i in range(30):
        w = [word() for _ in range(r.randint(0, 80))]
        if i % 2:
            passage = items[i % 12][1].split()
            for _ in range(r.randint(0, 3)):
                passage[r.randrange(len(passage))] = "edited"
            at = r.randint(0, len(w))
            w[at:at] = passage
        docs.append((i, " ".join(w), "en"))
    table = spark.createDataFrame(items, "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]): x["containment"] for x in decontaminate.leaks(spark.createDataFrame(docs, SCHEMA), table, max_broadcast=max_broadcast).collect()}
    assert got == brute_leaks([d[:2] for d in docs], items, decontaminate.N, decontaminate.THRESHOLD)
    if max_broadcast:
        kept = decontaminate.drop_leaks(odd, table)
        assert kept.columns == odd.columns and kept.count() == len(ODD)
        assert decontaminate.leaks(empty, table).count() == 0
        assert decontaminate.leaks(odd, table.limit(0)).count() == 0


# byte-pair encoding


def test_bpe_ids_are_those_of_the_library(spark, odd, empty):
    tiktoken = pytest.importorskip("tiktoken")
    import public_tokenizers as P

    r = random.Random(9)
    enc = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in enumerate(bpe.read_vocabulary())}, special_tokens={})
    signs = "ab' \n\t  sreveltdm.!?9é日　 ABC'''  "
    texts = ["".join(r.choice(signs) for _ in range(r.randint(0, 60))) for _ in range(3000)] + ["a" * 3000, "it's they'll we've 'd", "<|endoftext|>", "x y " * 200_000]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], SCHEMA)
    coded = bpe.encode(docs).cache()
    for x in coded.collect():
        assert x["round_trip"] and list(x["ids"]) == enc.encode_ordinary(texts[x["doc_id"]])
    assert {x["doc_id"]: x["text"] for x in bpe.decode(coded).collect()} == dict(enumerate(texts))
    out = bpe.encode(odd).collect()
    assert len(out) == len(ODD) and sum(x["ids"] is None for x in out) == 1 and sum(x["n_tokens"] == 0 for x in out) == 1
    assert bpe.encode(empty).count() == 0
    codec = bpe.Codec(*bpe.split_table())
    for t in texts[:300]:
        assert codec.encode_plain(t).tolist() == enc.encode_ordinary(t)
