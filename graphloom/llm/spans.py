"""Substring deduplication over sliding runs of consecutive sentences."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm import store

#: A sentence ends with its terminators and the white space after them; joined, the sentences are the text again. Commas,
#: semicolons and colons end one too, so that a passage that begins and ends inside longer sentences has whole ones.
SENTENCE = r"[^.!?,;:\n]*[.!?,;:\n]+[ \t\n\x0b\f\r]*|[^.!?,;:\n]+$"
#: A run has at least this many words, and two sentences at least.
WORDS = 12
#: A sentence of more than this many words is a run by itself.
SINGLE_WORDS = 24
_SENTENCE = re.compile(SENTENCE)
_BATCH = 1 << 21


def sentences(text: Column) -> Column:
    """The sentences of a text, white space included; null gives no sentence."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(SENTENCE), F.lit(0))


def _prefix(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1, values.dtype)
    np.cumsum(values, out=out[1:])
    return out


def _polynomial(values: np.ndarray, first: np.ndarray, n: np.ndarray, base: int) -> np.ndarray:
    """A hash of the ``n`` values from ``first`` on, for each."""
    power = np.full(len(values) + 1, base, np.uint64)
    power[0] = 1
    power = np.cumprod(power, dtype=np.uint64)
    back = np.full(len(values) + 1, pow(base, -1, 1 << 64), np.uint64)
    back[0] = 1
    back = np.cumprod(back, dtype=np.uint64)
    total = _prefix(values * power[:-1])
    h = (total[first + n] - total[first]) * back[first] + n.astype(np.uint64)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def runs_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Every run that counts, of all texts: two 64-bit hashes, its text, its first sentence there, and its sentences.

    From each sentence on, the shortest run of two sentences or more that has ``WORDS``; up to each sentence, likewise; and
    each sentence of more than ``SINGLE_WORDS``. Any longer run is covered by these, and repeats if and only if they do.
    """
    bare, counts = [], np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        own = [x.strip(" \t\r\n").lower() for x in _SENTENCE.findall(t)]
        counts[i] = len(own)
        bare += own
    if not bare:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none
    digest = b"".join([xxhash.xxh3_128_digest(x.encode("utf-8", "surrogatepass")) for x in bare])
    a, b = np.frombuffer(digest, "<u8").reshape(-1, 2).T
    w = np.fromiter((x.count(" ") + 1 for x in bare), np.int64, len(bare))
    start = _prefix(counts)
    doc = np.repeat(np.arange(len(texts)), counts)
    lo, hi, at = start[doc], start[doc + 1], np.arange(len(bare))
    words = _prefix(w)
    # the end (exclusive) of the shortest run from each sentence on, and the beginning of the shortest one up to each
    end = np.maximum(np.searchsorted(words, words[:-1] + WORDS, "left"), at + 2)
    begin = np.minimum(np.searchsorted(words, words[1:] - WORDS, "right") - 1, at - 1)
    on, back, alone = np.flatnonzero(end <= hi), np.flatnonzero(begin >= lo), np.flatnonzero(w > SINGLE_WORDS)
    # leave out those that are the same run
    back = back[~((end[np.maximum(begin[back], 0)] == back + 1) & (begin[back] >= 0))]
    first = np.concatenate([on, begin[back], alone])
    n = np.concatenate([end[on] - on, back + 1 - begin[back], np.ones(len(alone), np.int64)])
    k1, k2 = _polynomial(a, first, n, 0x9E3779B97F4A7C15), _polynomial(b, first, n, 0xC2B2AE3D27D4EB4F)
    d = doc[first]
    return k1.view(np.int64), k2.view(np.int64), d, first - start[d], n


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", once: bool = False) -> DataFrame:
    """(k1, k2, doc_id, tid, pos, n, again): a 128-bit hash of every run that counts, where it starts and how long it is.

    ``again``: the row has had the run before. With ``once`` only (k1, k2, doc_id, tid) of those that it hasn't.
    """

    def cut(batches):
        for b in batches:
            texts = [x or "" for x in b.column("text").to_pylist()]
            ids, tid = b.column("doc_id"), b.column("tid")
            edge, size = [0], 0
            for i, t in enumerate(texts):
                size += len(t)
                if size > _BATCH:
                    edge.append(i + 1)
                    size = 0
            for x, z in zip(edge, [*edge[1:], len(texts)]):
                k1, k2, d, pos, n = runs_of(texts[x:z])
                order = np.lexsort((pos, k2, k1, d))
                k1, k2, d, pos, n = k1[order], k2[order], d[order], pos[order], n[order]
                again = np.zeros(len(d), bool)
                again[1:] = (k1[1:] == k1[:-1]) & (k2[1:] == k2[:-1]) & (d[1:] == d[:-1])
                if once:
                    k1, k2, d = (v[~again] for v in (k1, k2, d))
                own = pa.array(d + x)
                out = [pa.array(k1), pa.array(k2), ids.take(own), tid.take(own)]
                names = ["k1", "k2", "doc_id", "tid"]
                if not once:
                    out += [pa.array(pos.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(again)]
                    names += ["pos", "n", "again"]
                yield pa.RecordBatch.from_arrays(out, names)

    t = store.id_text(docs, id_col, text_col)
    return t.select("doc_id", "text", _key(F.col("doc_id"), F.col("text")).alias("tid")).mapInArrow(cut, "k1 long, k2 long, doc_id long, tid long" + ("" if once else ", pos int, n int, again boolean"))


def _key(doc_id: Column, text: Column) -> Column:
    """Tells apart texts of one id; those without an id from those of the id that takes their place in the order."""
    return F.xxhash64(F.coalesce(text, F.lit("")), doc_id.isNull())


_LAST = (1 << 63) - 1


def covered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, tid, gone): for each document with a repeated run that isn't the first, the sentences such runs cover.

    The first occurrence of a run is the one with the smallest (doc_id, text key, position), a null doc_id coming last. Runs
    are only ever added up by their hash, which combines before the shuffle: a passage in a third of all documents is one
    row of each task. The texts are read again to find where the repeated runs are.
    """
    order = F.coalesce("doc_id", F.lit(_LAST))
    once = runs(docs, id_col, text_col, once=True).groupBy("k1", "k2").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.min("tid").alias("t0"), F.max("tid").alias("t1"))
    repeated = store.written(once.where("first < last or t0 < t1").select("k1", "k2", "first"), "repeated")
    places = runs(docs, id_col, text_col).join(repeated, ["k1", "k2"], "left").where("first is not null or again")
    places = store.written(places, "places")
    # in the first document itself: of several texts under its id, all but the one with the smallest key come later
    own = places.where(order == F.col("first")).groupBy("k1", "k2").agg(F.min("tid").alias("t0"), F.max("tid").alias("t1")).where("t0 < t1")
    later = places.where((order > F.col("first")) | F.col("again")).select("doc_id", "tid", "pos", "n")
    tied = places.where((order == F.col("first")) & ~F.col("again")).join(own, ["k1", "k2"]).where("tid > t0").select("doc_id", "tid", "pos", "n")
    cut = F.sort_array(F.array_distinct(F.flatten(F.collect_list(F.sequence(F.col("pos"), F.col("pos") + F.col("n") - 1)))))
    return later.union(tied).groupBy("doc_id", "tid").agg(cut.alias("gone"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", removed_col: str | None = None) -> DataFrame:
    """``docs`` without the sentences covered by a repeated run that isn't its first occurrence.

    A run is two or more consecutive sentences with 12 words or more, or one of more than 24 words; a sentence ends at a full
    stop, an exclamation or question mark, a comma, semicolon or colon, or a line's end. Every run of any length is looked at,
    by way of the shortest ones within it. Sentences compare without case and the white space around them. Every row stays,
    all columns as they were, but for the text; a text may become empty. With ``removed_col``, the number of removed
    sentences is added. Null texts stay null; texts count whole, however long. Rows equal in id and text count as one
    document, so they do not empty each other; a null doc_id is an id that comes last. An empty table gives an empty
    result.
    """
    tid, gone, key, tid_r = (store.fresh(docs, x) for x in ("tid", "gone", "key", "tidr"))
    cut = covered(docs, id_col, text_col).select(F.col("doc_id").alias(key), F.col("tid").alias(tid_r), F.col("gone").alias(gone))
    marked = docs.withColumn(tid, _key(docs[id_col].cast("long"), docs[text_col].cast("string")))
    joined = marked.join(cut, marked[id_col].cast("long").eqNullSafe(cut[key]) & (marked[tid] == cut[tid_r]), "left")
    g = F.col(gone)
    # what lies between the places that go, one slice each
    between = lambda s, i: F.slice(s, F.coalesce(F.get(g, i - 1) + 1, F.lit(0)) + 1, F.coalesce(F.get(g, i), F.size(s)) - F.coalesce(F.get(g, i - 1) + 1, F.lit(0)))
    rest = F.get(F.transform(F.array(sentences(F.col(text_col))), lambda s: F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(g)), lambda i: between(s, i))), "")), F.lit(0))
    out = [F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(rest).alias(c) if c == text_col else F.col(c) for c in docs.columns]
    if removed_col:
        out.append(F.coalesce(F.size(gone), F.lit(0)).alias(removed_col))
    return joined.select(*out)
