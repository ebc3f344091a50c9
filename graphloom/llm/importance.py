"""Importance resampling: documents drawn by how much likelier their n-grams are in target text than in raw text.

Words and pairs of neighbouring words are hashed into buckets. A target model (documents labelled good) and a raw model (all
documents) are smoothed distributions over the buckets; a document's importance is the logarithm of the ratio of its
probabilities under the two. Sampling without replacement in proportion to importance is a Gumbel top-k: add Gumbel noise
to each logarithm and keep the k largest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import samples, store, textcore

BUCKETS = 1 << 14
#: The most labelled documents that the target model is made of.
MAX_LABELLED = 20_000
SHARE = 0.75
#: Added to every bucket's count.
SMOOTHING = 1.0
SEED = 1


def _buckets(w: textcore.Words, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all words and word pairs of a slice of texts, and which text each is of."""
    pair, at = textcore.ngrams(w, 2)
    doc = w.doc
    return np.concatenate([w.hashes, pair]).astype(np.uint64) % np.uint64(buckets), np.concatenate([doc, doc[at]])


def bucket_counts(docs: DataFrame, good: DataFrame, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """By bucket: n-grams of the documents whose ids ``good`` has, and of all documents.

    ``good`` is a bounded sample; what comes to the driver is bounded by the number of buckets.
    """
    wanted = docs.sparkSession.sparkContext.broadcast(np.sort(np.array([r["doc_id"] for r in good.collect()], np.int64)))

    def count(batches):
        n = np.zeros((2, buckets), np.int64)
        for b in batches:
            ids = b.column("doc_id")
            chosen = np.isin(ids.fill_null(0).to_numpy(), wanted.value) & ~ids.is_null().to_numpy(zero_copy_only=False)
            for w in textcore.words(b.column("text").to_pylist()):
                at, doc = _buckets(w, buckets)
                at = at.astype(np.int64)
                n[1] += np.bincount(at, minlength=buckets)
                n[0] += np.bincount(at[chosen[w.lo + doc]], minlength=buckets)
        some = np.flatnonzero(n[1])
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[0][some]), pa.array(n[1][some])], ["bucket", "target", "raw"])

    rows = docs.mapInArrow(count, "bucket int, target long, raw long").groupBy("bucket").agg(F.sum("target").alias("target"), F.sum("raw").alias("raw")).toPandas()
    out = np.zeros((2, buckets), np.int64)
    out[:, rows["bucket"].to_numpy(np.int64)] = rows[["target", "raw"]].to_numpy(np.int64).T
    return out[0], out[1]


def log_ratio(target: np.ndarray, raw: np.ndarray, smoothing: float = SMOOTHING) -> np.ndarray:
    """By bucket, the logarithm of target over raw probability; 0 without any target text."""
    if not target.sum():
        return np.zeros(len(target))
    t, r = (np.log(x + smoothing) - np.log(x.sum() + smoothing * len(x)) for x in (target, raw))
    return t - r


def weigh(docs: DataFrame, ratio: np.ndarray, seed: int = SEED) -> DataFrame:
    """(doc_id, tid, log_weight, o): the importance of each row, and the order of its noisy importance, as an integer.

    The Gumbel noise depends on id, text and seed only.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    def score(batches):
        for b in batches:
            texts = b.column("text").to_pylist()
            out = np.zeros(len(texts))
            for w in textcore.words(texts):
                at, doc = _buckets(w, len(shared.value))
                out[w.lo : w.hi] = np.bincount(doc, shared.value[at.astype(np.int64)], w.hi - w.lo)
            u = (textcore.mix(b.column("noise").to_numpy().view(np.uint64)) >> np.uint64(11)).astype(np.float64) + 0.5
            noise = -np.log(-np.log(u / 2.0**53))
            none = b.column("text").is_null().to_numpy(zero_copy_only=False)
            out = np.round(out, 6) + 0.0
            bits = (out + noise).view(np.int64)
            order = bits ^ ((bits >> 63) & np.int64(2**63 - 1))  # integers in the order of the keys
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("tid"), pa.array(out, mask=none), pa.array(order, mask=none)], ["doc_id", "tid", "log_weight", "o"])

    t = docs.withColumn("tid", store.text_key(F.col("text"))).withColumn("noise", F.xxhash64(F.lit(seed), "doc_id", "tid"))
    return t.mapInArrow(score, "doc_id long, tid long, log_weight double, o long")


def kth_largest(keys: DataFrame, k: int) -> tuple[int, int]:
    """Of a column ``o`` of integers: the k-th largest, and how many of the k are above it. Exact, by narrowing a histogram.

    Each of the four rounds brings at most 2**16 counts to the driver, however many rows there are.
    """
    prefix, above = 0, 0
    keys = keys.select(F.col("o").bitwiseXOR(F.lit(-(1 << 63))).alias("o"))  # unsigned
    for shift in (48, 32, 16, 0):
        part = F.shiftrightunsigned("o", shift)
        inside = keys if shift == 48 else keys.where(F.shiftrightunsigned("o", shift + 16) == prefix)
        counts = {r["b"]: r["n"] for r in inside.groupBy(part.bitwiseAND(0xFFFF).alias("b")).agg(F.count("*").alias("n")).collect()}
        for b in sorted(counts, reverse=True):
            if above + counts[b] >= k:
                break
            above += counts[b]
        prefix = prefix << 16 | b
    return prefix - (1 << 63), above


def resample(docs: DataFrame, labels: DataFrame, share: float = SHARE, k: int | None = None, buckets: int = BUCKETS, most: int = MAX_LABELLED, seed: int = SEED) -> DataFrame:
    """(doc_id, log_weight, selected): every row with its importance, and whether the Gumbel top-k drew it.

    k is ``share`` of the rows with a text, unless given. Null texts have no importance and are never drawn; empty ones have
    importance 0. Of equal keys (rows equal in id and text) either may be drawn, but exactly k rows are. An empty table
    gives an empty result; without labelled good documents all importances are 0 and the draw is uniform. Texts count whole,
    however long; extra columns are left out.
    """
    t = store.id_text(docs)
    good = samples.labelled(labels, "quality", most).where("y = 1").select("doc_id")
    ratio = log_ratio(*bucket_counts(t, good, buckets))
    weighed = store.written(weigh(t, ratio, seed), "weighed")
    keyed = weighed.where("o is not null").select("o")
    n = keyed.count()
    k = min(n, int(round(share * n)) if k is None else k)
    if k <= 0:
        return weighed.select("doc_id", "log_weight", F.lit(False).alias("selected"))
    least, above = kth_largest(keyed, k)
    # ties at the k-th key: the smallest ids and texts, counted off on one machine only for that one key
    from pyspark.sql import Window as W

    tied = weighed.where(F.col("o") == least).withColumn("r", F.row_number().over(W.partitionBy("o").orderBy("doc_id", "tid")))
    rest = weighed.where(F.col("o").isNull() | (F.col("o") != least))
    out = rest.select("doc_id", "log_weight", F.coalesce(F.col("o") > least, F.lit(False)).alias("selected"))
    return out.union(tied.select("doc_id", "log_weight", (F.col("r") <= k - above).alias("selected")))
