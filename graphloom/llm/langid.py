"""Language identification by a byte convolutional network, trained and run in numpy.

Bytes are embedded, filters of several widths slide over windows of fixed length, each filter's largest answer in a window
is kept, and a softmax turns these into languages. A text is all of its windows: their log-probabilities are averaged.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.llm import store

#: The most labelled documents that the network is trained on, for each language.
PER_LANGUAGE = 300
#: The most languages that a network is trained to tell apart: the commonest.
MAX_LANGUAGES = 256
WINDOW = 128
WIDTHS = (2, 3, 4)
FILTERS = 12
EMBEDDING = 8
BLOCK = 128


def windows(texts: list[bytes], length: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """All windows of all texts, the last of each filled up with zeros, and how many each text has; none for an empty one."""
    size = np.array([len(t) for t in texts], np.int64)
    count = -(-size // length)
    out = np.zeros(int(count.sum()) * length, np.uint8)
    raw = np.frombuffer(b"".join(texts), np.uint8)
    # place of each text's first byte, minus where it is in the joined bytes
    shift = (np.cumsum(count) - count) * length - (np.cumsum(size) - size)
    out[np.arange(len(raw)) + np.repeat(shift, size)] = raw
    return out.reshape(-1, length), count


@dataclass
class Network:
    languages: list[str]
    embedding: np.ndarray  # 256 x EMBEDDING; byte 0 is the filling
    filters: np.ndarray  # widest width * EMBEDDING x filters; narrower ones have zeros at the end
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def patches(self, w: np.ndarray) -> np.ndarray:
        """Each position's embedded bytes, as many as the widest filter has: windows * positions x width * EMBEDDING."""
        n, length = w.shape
        e, wide = self.embedding.shape[1], len(self.filters) // self.embedding.shape[1]
        x = np.zeros((n, length + wide - 1, e), self.embedding.dtype)
        x[:, :length] = self.embedding[w]
        view = np.lib.stride_tricks.as_strided(x, (n, length, wide * e), (x.strides[0], x.strides[1], x.strides[2]))
        return view.reshape(n * length, wide * e)

    def pooled(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a = (self.patches(w) @ self.filters).reshape(len(w), w.shape[1], -1)
        return a, np.maximum(a.max(1) + self.bias, 0)

    def gradients(self, x: np.ndarray, label: np.ndarray, weight: np.ndarray, mask: np.ndarray) -> list[np.ndarray]:
        """Of the weighted mean cross-entropy of some windows: by embedding, filters, bias, and both parts of the output."""
        n, wide, e = len(x), len(self.filters) // self.embedding.shape[1], self.embedding.shape[1]
        a, pooled = self.pooled(x)
        z = pooled @ self.out + self.out_bias
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(n), label] -= 1
        dz = (p * weight[:, None] / n).astype(self.out.dtype)
        dpool = (dz @ self.out.T) * (pooled > 0)
        # only the position that won is answerable
        at = a.argmax(1) + np.arange(n)[:, None] * x.shape[1]
        patch = self.patches(x)[at]  # n x k x wide*e
        dfilters = np.einsum("nkd,nk->dk", patch, dpool) * mask
        dpatch = dpool[:, :, None] * self.filters.T[None]
        padded = np.concatenate([x, np.zeros((n, wide - 1), np.uint8)], 1)
        rows = at // x.shape[1], at % x.shape[1]
        taken = np.stack([padded[rows[0], rows[1] + o] for o in range(wide)], 2)
        dembedding = np.zeros_like(self.embedding)
        np.add.at(dembedding, taken.ravel(), dpatch.reshape(-1, e))
        dembedding[0] = 0
        return [dembedding, dfilters, dpool.sum(0), pooled.T @ dz, dz.sum(0)]

    def log_probabilities(self, w: np.ndarray) -> np.ndarray:
        out = np.zeros((len(w), len(self.languages)))
        for i in range(0, len(w), BLOCK):
            z = self.pooled(w[i : i + BLOCK])[1] @ self.out + self.out_bias
            z = z - z.max(1, keepdims=True)
            out[i : i + BLOCK] = z - np.log(np.exp(z).sum(1, keepdims=True))
        return out

    def identify(self, texts: list[str | None]) -> tuple[list[str | None], np.ndarray]:
        """The language of each text and its share of the averaged probability; None for a text without bytes."""
        score, some = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), bool)
        lo = 0
        while lo < len(texts):
            hi, size = lo, 0
            while hi < len(texts) and (hi == lo or size + len(texts[hi] or "") < 1 << 20):
                size += len(texts[hi] or "")
                hi += 1
            w, count = windows([(t or "").encode() for t in texts[lo:hi]])
            if len(w) and self.languages:
                some[lo:hi] = count > 0
                own = np.flatnonzero(count)
                total = np.add.reduceat(self.log_probabilities(w), (np.cumsum(count) - count)[own], axis=0)
                score[lo + own] = total / count[own, None]
            lo = hi
        if not self.languages:
            return [None] * len(texts), np.zeros(len(texts))
        p = np.exp(score - score.max(1, keepdims=True))
        best = score.argmax(1)
        return [self.languages[b] if s else None for b, s in zip(best, some)], (p.max(1) / p.sum(1))


def train(texts: list[str], languages: list[str], epochs: int = 4, batch: int = 64, rate: float = 4e-3, seed: int = 1) -> Network:
    """Adam on the cross-entropy of windows; the same result for the same rows in the same order."""
    names = sorted(set(languages))
    rng = np.random.default_rng(seed)
    wide, e, k = max(WIDTHS), EMBEDDING, FILTERS * len(WIDTHS)
    mask = np.concatenate([np.repeat(np.arange(wide) < w, e)[:, None].repeat(FILTERS, 1) for w in WIDTHS], 1).astype(np.float32)
    net = Network(
        names,
        rng.normal(0, 0.5, (256, e)).astype(np.float32),
        (rng.normal(0, 1, (wide * e, k)) * mask / np.sqrt(mask.sum(0))).astype(np.float32),
        np.zeros(k, np.float32),
        rng.normal(0, 0.3, (k, len(names))).astype(np.float32),
        np.zeros(len(names), np.float32),
    )
    net.embedding[0] = 0
    if not texts:
        return net
    w, count = windows([t.encode() for t in texts])
    label = np.repeat([names.index(x) for x in languages], count)
    # languages count alike, however many windows they have
    weight = (len(label) / np.maximum(np.bincount(label, minlength=len(names)), 1) / len(names))[label]
    params = [net.embedding, net.filters, net.bias, net.out, net.out_bias]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        order = rng.permutation(len(w))
        for lo in range(0, len(order), batch):
            own = order[lo : lo + batch]
            gradients = net.gradients(w[own], label[own], weight[own], mask)
            step += 1
            for q, g, m, v in zip(params, gradients, first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                q -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def labelled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, most: int = MAX_LANGUAGES) -> DataFrame:
    """(lang, h, text): up to ``per_language`` different rows of each of the ``most`` commonest languages, those with the smallest hashes.

    Rows are told apart by id and text together, so a language whose rows share an id, or have none, is sampled like any other.
    """
    t = docs.select(docs[lang_col].cast("string").alias("lang"), docs[text_col].cast("string").alias("text"), F.xxhash64(F.lit(3), docs[id_col].cast("long"), docs[text_col].cast("string")).alias("h"))
    t = t.where("lang <> '' and text <> ''")
    common = t.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most).select("lang")
    # the texts stay behind until it is known which of them are needed
    rank = F.row_number().over(W.partitionBy("lang").orderBy("h"))
    few = t.select("lang", "h").distinct().join(F.broadcast(common), "lang").withColumn("r", rank).where(F.col("r") <= per_language).select("lang", "h")
    return t.join(F.broadcast(few), ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text"))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> Network:
    """A network trained on up to ``per_language`` documents of each language, all windows of each.

    Rows with a null or empty language or text teach nothing. Without any labelled row the network knows no language.
    """
    rows = labelled(docs, id_col, text_col, lang_col, per_language).toPandas().sort_values(["lang", "h"])
    return train(rows["text"].tolist(), rows["lang"].tolist())


def identify(docs: DataFrame, network: Network | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> DataFrame:
    """(doc_id, language, confidence): one row for every row, over its whole text, however long and whatever its id.

    Null and empty texts have a null language and confidence. Without ``network`` one is trained on the documents' own
    ``lang_col``. Repeated rows and ids give a row each; extra columns are left out; an empty table gives an empty result. The
    network is a few kilobytes, whatever the data's size.
    """
    shared = docs.sparkSession.sparkContext.broadcast(network or fit(docs, id_col, text_col, lang_col, per_language))

    def run(batches):
        for b in batches:
            names, p = shared.value.identify(b.column("text").to_pylist())
            none = np.array([x is None for x in names], bool)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(names, pa.string()), pa.array(np.round(p, 4), mask=none)], ["doc_id", "language", "confidence"])

    return store.id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, language string, confidence double")
