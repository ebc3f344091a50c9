"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

The features of a text are the density and the number of its words from a lexicon, how many of those have a second-person
word near them, rates of capitals, words in capitals, exclamation and other punctuation marks, signs inside words, and its
length. The lexicon is a base list and the words and word beginnings that labelled toxic texts use and others don't.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm import samples, store, textcore

#: The most labelled documents that the model is fitted on.
MAX_LABELLED = 20_000
BASE = "idiot moron stupid worthless pathetic loser scum trash clown disgusting".split()
SECOND = "you your yours yourself u ur du dich dir dein deine ihr euch euer tu te ti tus toi vous votre vos usted ustedes".split()
STEMS = (4, 5, 6, 7)
NEAR = 5
FEATURES = ("density", "hits", "near_second_person", "second_person", "capitals", "capital_words", "exclaims", "punctuation", "obfuscation", "length")
_LEET = np.array([ord(c) for c in "@$*#0134579!|"], np.uint32)


def _per_text(texts: list[str]) -> np.ndarray:
    """By text: letters, capitals, exclamation marks, other marks, signs inside words, characters."""
    out = np.zeros((len(texts), 6))
    lo = 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= textcore.SLICE):
            size += len(texts[hi]) + 1
            hi += 1
        step = 4 * textcore.SLICE
        for a in range(0, max(size, 1), step):  # a single text may be longer than a slice
            # with a character on either side, which tells what is inside a word
            part = texts[lo:hi] if size <= step else [texts[lo][max(a - 1, 0) : a + step + 1]]
            codes = textcore.codes_of("\n".join(part) + "\n")
            edge = np.concatenate([[0], np.cumsum([len(t) + 1 for t in part])])
            word = textcore.word_table()[codes]
            upper = textcore.upper_table()[codes]
            space = (codes == 32) | (codes == 10) | (codes == 9) | (codes == 13)
            odd = np.zeros(len(codes), bool)
            letter = word & ~((codes >= 48) & (codes <= 57))
            odd[1:-1] = np.isin(codes[1:-1], _LEET) & letter[:-2] & letter[2:]
            for k, x in enumerate((word, upper, codes == 33, ~word & ~space, odd, ~space)):
                out[lo:hi, k] += np.add.reduceat(x, edge[:-1], dtype=np.int64) if size <= step else x[min(a, 1) : min(a, 1) + step].sum()
        lo = hi
    return out


def features(texts: list[str | None], lexicon: dict[int, np.ndarray]) -> np.ndarray:
    """One row of ``FEATURES`` for each text; a null text is as an empty one. ``lexicon``: sorted hashes by stem length, 0 for words."""
    texts = [t or "" for t in texts]
    signs = _per_text(texts)
    out = np.zeros((len(texts), len(FEATURES)))
    second = np.sort(np.array([textcore.word_hash(w) for w in SECOND], np.uint64))
    for w in textcore.words(texts, STEMS):
        n = np.maximum(np.diff(w.offsets), 1)
        hit = _member(w.hashes, lexicon.get(0))
        for length in STEMS:
            hit |= _member(w.prefixes[length], lexicon.get(length))
        you = _member(w.hashes, second)
        near = np.zeros(len(hit), bool)
        at, yous = np.flatnonzero(hit), np.flatnonzero(you)
        if len(yous) and len(at):
            doc = w.doc
            for side in (np.searchsorted(yous, at), np.searchsorted(yous, at) - 1):
                y = yous[np.clip(side, 0, len(yous) - 1)]
                near[at] |= (np.abs(y - at) <= NEAR) & (doc[y] == doc[at])
        rows = slice(w.lo, w.hi)
        hits = textcore.row_sums(hit, w.offsets)
        out[rows, 0], out[rows, 1] = hits / n, np.log1p(hits)
        out[rows, 2], out[rows, 3] = textcore.row_sums(near, w.offsets) / np.maximum(hits, 1), textcore.row_sums(you, w.offsets) / n
        out[rows, 9] = np.log1p(np.diff(w.offsets))
    size = np.maximum(signs[:, 5], 1)
    out[:, 4] = signs[:, 1] / np.maximum(signs[:, 0], 1)
    out[:, 5] = (signs[:, 1] > 0.5 * np.maximum(signs[:, 0], 1)).astype(float)
    out[:, 6], out[:, 7], out[:, 8] = signs[:, 2] / size, signs[:, 3] / size, signs[:, 4] / size
    return out


def _member(x: np.ndarray, known: np.ndarray | None) -> np.ndarray:
    if known is None or not len(known):
        return np.zeros(len(x), bool)
    # a sieve on 16 bits first: few words are in a lexicon
    sieve = np.zeros(1 << 16, bool)
    sieve[(known >> np.uint64(48)).astype(np.int64)] = True
    out = sieve[(x >> np.uint64(48)).astype(np.int64)] & (x != 0)
    at = np.flatnonzero(out)
    out[at] = known[np.minimum(np.searchsorted(known, x[at]), len(known) - 1)] == x[at]
    return out


@dataclass
class Trees:
    """Boosted trees of one depth as arrays: (tree, inner node) -> feature and cut, (tree, leaf) -> value."""

    base: float
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows, depth = np.arange(len(x)), int(np.log2(self.leaf.shape[1])) if self.leaf.size else 0
        for f, c, v in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, f[node]] > c[node])
            out += v[node - (len(v) - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, l2: float = 1.0) -> Trees:
    """Logistic loss, second-order gains, cuts at quantiles; the same result for the same rows in any order but for rounding."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    code = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)  # code <= i where x <= cut i
    p = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    base = float(np.log(p / (1 - p)))
    margin = np.full(len(y), base)
    inner, leaves = 2**depth - 1, 2**depth
    fs, cs, vs = [], [], []
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-margin))
        g, h = y - q, q * (1 - q)
        node = np.zeros(len(y), np.int64)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            for k in range(2**level - 1, 2 ** (level + 1) - 1):
                own = np.flatnonzero(node == k)
                best = 1e-6
                gs, hs = g[own].sum(), h[own].sum()
                for j, c in enumerate(cuts):
                    if not len(c) or not len(own):
                        continue
                    a = np.cumsum(np.bincount(code[own, j], g[own], len(c) + 1))[:-1]
                    b = np.cumsum(np.bincount(code[own, j], h[own], len(c) + 1))[:-1]
                    gain = a**2 / (b + l2) + (gs - a) ** 2 / (hs - b + l2) - gs**2 / (hs + l2)
                    i = int(np.argmax(gain))
                    if gain[i] > best:
                        best, feature[k], cut[k] = gain[i], j, c[i]
            node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > cut[node])
        at = node - inner
        value = rate * np.bincount(at, g, leaves) / (np.bincount(at, h, leaves) + l2)
        margin = margin + value[at]
        fs.append(feature)
        cs.append(cut)
        vs.append(value)
    return Trees(base, np.array(fs), np.array(cs), np.array(vs))


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: scores in order, and the non-decreasing probability at each."""
    u, back = np.unique(score, return_inverse=True)
    weight = np.bincount(back).astype(float)
    mean = np.bincount(back, y) / weight
    stack: list[list[float]] = []  # mean, weight, number of scores
    for m, w in zip(mean, weight):
        stack.append([m, w, 1])
        while len(stack) > 1 and stack[-2][0] >= stack[-1][0]:
            b, a = stack.pop(), stack.pop()
            stack.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    return u, np.repeat([s[0] for s in stack], [int(s[2]) for s in stack])


@dataclass
class Model:
    lexicon: dict[int, np.ndarray]
    trees: Trees | None = None
    at: np.ndarray | None = None
    probability: np.ndarray | None = None

    def predict(self, texts: list[str | None]) -> np.ndarray:
        if self.trees is None:
            return np.zeros(len(texts))
        return np.interp(self.trees.margin(features(texts, self.lexicon)), self.at, self.probability)


def learn_lexicon(sample: DataFrame, least: int = 4, odds: float = 8.0) -> dict[int, np.ndarray]:
    """Words and beginnings of words that at least ``least`` toxic texts use, relatively ``odds`` times as often as others."""

    def cut(batches):
        for b in batches:
            ys = b.column("y").to_numpy().astype(np.int64)
            for w in textcore.words(b.column("text").to_pylist(), STEMS):
                doc = w.doc
                for length, h in [(0, w.hashes), *w.prefixes.items()]:
                    both = np.unique(np.stack([doc.astype(np.int64), h.view(np.int64)], 1)[h != 0], axis=0)
                    n = len(both)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, length, np.int32)), pa.array(both[:, 1]), pa.array(ys[w.lo + both[:, 0]])], ["len", "h", "y"])

    total = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    lexicon: dict[int, list[int]] = {0: [textcore.word_hash(w) for w in BASE]}
    if total.get(1) and total.get(0):
        rate = (F.col("bad") / total[1]) / ((F.col("all") - F.col("bad") + 1) / total[0])
        counts = sample.mapInArrow(cut, "len int, h long, y long").groupBy("len", "h").agg(F.sum("y").alias("bad"), F.count("*").alias("all"))
        for r in counts.where((F.col("bad") >= least) & (rate >= odds)).select("len", "h").toLocalIterator():
            lexicon.setdefault(r["len"], []).append(r["h"] & (1 << 64) - 1)
    return {k: np.sort(np.array(v, np.uint64)) for k, v in lexicon.items()}


def fit(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> Model:
    """A model from at most ``most`` labelled documents: 40 % for the lexicon, 40 % for the trees, 20 % for calibration.

    With no document of one of the classes in a part, nothing is called toxic.
    """
    sample = store.written(samples.sampled_texts(store.id_text(docs), samples.labelled(labels, "toxic", most)).withColumn("part", F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(10))), "labelled")
    lexicon = learn_lexicon(sample.where("part < 4").select("text", "y"))

    def measure(batches):
        for b in batches:
            x = features(b.column("text").to_pylist(), lexicon)
            yield pa.RecordBatch.from_arrays([b.column("part"), b.column("y"), *(pa.array(x[:, k]) for k in range(x.shape[1]))], ["part", "y", *FEATURES])

    rows = sample.where("part >= 4").select("part", "y", "text").mapInArrow(measure, "part long, y int, " + ", ".join(f"{f} double" for f in FEATURES)).toPandas()
    rows = rows.sort_values(list(rows.columns), kind="stable")
    x, y, late = rows[list(FEATURES)].to_numpy(float), rows["y"].to_numpy(float), rows["part"].to_numpy() >= 8
    if not all(len(np.unique(y[k])) == 2 for k in (late, ~late)):
        return Model(lexicon)
    trees = boost(x[~late], y[~late])
    return Model(lexicon, trees, *isotonic(trees.margin(x[late]), y[late]))


def probability(docs: DataFrame, model: Model, text: Column) -> Column:
    """The calibrated probability that a text is toxic; null for a null text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(s: pd.Series) -> pd.Series:
        return pd.Series(shared.value.predict(s.tolist())).round(6)

    return F.when(text.isNotNull(), F.pandas_udf(predict, "double")(text))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, most: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, toxicity, toxic): one row for every row, whatever its id; a null text has no toxicity and isn't toxic.

    An empty text is judged as one without words. Texts count whole, however long; repeated rows and ids give a row each; extra
    columns are left out; an empty table gives an empty result. Ids that are labelled but have no document teach nothing.
    """
    t = store.id_text(docs)
    p = probability(docs, fit(docs, labels, most), F.col("text"))
    return t.select("doc_id", p.alias("toxicity")).select("doc_id", "toxicity", F.coalesce(F.col("toxicity") >= threshold, F.lit(False)).alias("toxic"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, most: int = MAX_LABELLED) -> DataFrame:
    """``docs`` without the rows called toxic; all columns as they were."""
    name = store.fresh(docs, "toxicity")
    p = probability(docs, fit(docs, labels, most), docs["text"].cast("string"))
    return docs.withColumn(name, p).where(F.coalesce(F.col(name), F.lit(0.0)) < threshold).drop(name)
