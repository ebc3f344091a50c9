"""Benchmark decontamination by a prefix-filtered set join.

A document leaks an item if some window of the document, as long as the item, holds at least ``threshold`` of the
item's distinct shingles. The shingles of each item are ordered by rarity in the corpus; a window that holds enough of
them must hold one of the rarest |S| - ceil(threshold * |S|) + 1, so only those prefixes are joined. A pair that meets goes on
if the document is long enough, and if within an item's length of where they met it has as many shingles of any item as the
item needs. Only for such pairs the item's shingles are fetched, and the windows gone through exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.llm import store, textcore

N = 3
THRESHOLD = 0.7
#: Benchmark shingles up to this many (16 MB) go to the executors as one sorted array; beyond, both sides are shuffled.
MAX_BROADCAST = 2_000_000


def shingles(items: DataFrame, n: int) -> DataFrame:
    """(item_id, sh, size, length): distinct shingles of each item, how many those are, and shingle positions in all.

    Rows that share an item_id are joined to one item by their union; null ids, and texts of fewer than ``n`` words,
    have no shingles.
    """

    def cut(batches):
        for b in batches:
            ids, texts = b.column("item_id").to_numpy(zero_copy_only=False), b.column("text").to_pylist()
            for w in textcore.words(texts):
                g, at = textcore.ngrams(w, n)
                yield pa.RecordBatch.from_arrays([pa.array(ids[w.lo + w.doc[at]], pa.int64()), pa.array(g.view(np.int64))], ["item_id", "sh"])

    rows = items.where("item_id is not null").mapInArrow(cut, "item_id long, sh long")
    sizes = rows.groupBy("item_id").agg(F.count_distinct("sh").cast("int").alias("size"), F.count("*").cast("int").alias("length"))
    return rows.distinct().join(sizes, "item_id")


def document_hits(docs: DataFrame, wanted: DataFrame, n: int, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """(doc_id, tid, total, at, sh): by document, in order, the places where a shingle of the benchmark begins, and which."""
    several = wanted.limit(max_broadcast + 1).count()
    known = None
    if several <= max_broadcast:
        known = docs.sparkSession.sparkContext.broadcast(np.sort(wanted.toPandas()["sh"].to_numpy(np.int64).view(np.uint64)))

    def find(batches):
        for b in batches:
            ids, tid, texts = b.column("doc_id"), b.column("tid"), b.column("text").to_pylist()
            for w in textcore.words(texts):
                g, at = textcore.ngrams(w, n)
                if known is not None:
                    if not len(known.value):
                        continue
                    # a first sieve on 16 bits spares most of the binary searches
                    sieve = np.zeros(1 << 16, bool)
                    sieve[(known.value >> np.uint64(48)).astype(np.int64)] = True
                    maybe = np.flatnonzero(sieve[(g >> np.uint64(48)).astype(np.int64)])
                    place = np.minimum(np.searchsorted(known.value, g[maybe]), len(known.value) - 1)
                    maybe = maybe[known.value[place] == g[maybe]]
                    g, at = g[maybe], at[maybe]
                if not len(g):
                    continue
                doc = w.doc[at]
                edge = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1], [True]]))
                own = doc[edge[:-1]]
                total = np.maximum(np.diff(w.offsets) - n + 1, 0)[own]
                offsets = pa.array(edge.astype(np.int32))
                places = pa.ListArray.from_arrays(offsets, pa.array((at - w.offsets[doc]).astype(np.int32)))
                rows = pa.array(own + w.lo)
                yield pa.RecordBatch.from_arrays([ids.take(rows), tid.take(rows), pa.array(total.astype(np.int32)), places, pa.ListArray.from_arrays(offsets, pa.array(g.view(np.int64)))], ["doc_id", "tid", "total", "at", "sh"])

    t = store.id_text(docs).withColumn("tid", store.text_key(F.col("text")))
    hits = t.mapInArrow(find, "doc_id long, tid long, total int, at array<int>, sh array<long>")
    if known is None:
        each = hits.select("doc_id", "tid", "total", F.explode(F.arrays_zip("at", "sh")).alias("x")).select("doc_id", "tid", "total", F.col("x.sh").alias("sh"), F.col("x.at").alias("at"))
        there = each.join(wanted, "sh", "left_semi").groupBy("doc_id", "tid").agg(F.max("total").alias("total"), F.sort_array(F.collect_set(F.struct("at", "sh"))).alias("x"))
        hits = there.select("doc_id", "tid", "total", F.col("x.at").alias("at"), F.col("x.sh").alias("sh"))
    return hits


def best_window(at: np.ndarray, sh: np.ndarray, item: np.ndarray, length: int) -> int:
    """The most distinct shingles of a sorted item that any ``length`` places in a row hold; ``at`` is in order."""
    place = np.minimum(np.searchsorted(item, sh), len(item) - 1)
    own = item[place] == sh
    at, which = at[own].tolist(), place[own].tolist()
    count: dict[int, int] = {}
    best = lo = 0
    for p, w in zip(at, which):
        count[w] = count.get(w, 0) + 1
        while at[lo] <= p - length:
            old = which[lo]
            count[old] -= 1
            if not count[old]:
                del count[old]
            lo += 1
        best = max(best, len(count))
    return best


def leaks(docs: DataFrame, benchmark: DataFrame, n: int = N, threshold: float = THRESHOLD, max_broadcast: int = MAX_BROADCAST, with_key: bool = False) -> DataFrame:
    """(doc_id, item_id, containment): every document that leaks an item, with the best window's containment.

    Words compare in lower case; a shingle is ``n`` of them. Null doc_ids and item_ids take part in no pair (``with_key`` keeps
    null doc_ids, and tells texts of one id apart); null, empty and shorter texts have no shingles; texts count whole, however long.
    Rows equal in id and text count once; rows that share only the id are looked at one by one, and the best containment
    counts. Extra columns are left out. Empty tables give an empty result. ``max_broadcast`` changes how the rows are brought
    together, not what comes out.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    keys = ["doc_id", "tid"]
    items = store.written(shingles(benchmark.select(benchmark["item_id"].cast("long").alias("item_id"), benchmark["text"].cast("string").alias("text")), n), "items")
    hits = document_hits(docs if with_key else docs.where("doc_id is not null"), items.select("sh").distinct(), n, max_broadcast)
    hits = store.written(hits, "hits")
    each = hits.select(*keys, "total", F.explode(F.arrays_zip("at", "sh")).alias("x")).select(*keys, "total", F.col("x.at").alias("pos"), F.col("x.sh").alias("sh"))
    need = F.ceil(F.col("size") * F.lit(threshold) - 1e-9).cast("int")
    rarity = each.groupBy("sh").agg(F.count("*").alias("freq"))
    rank = F.row_number().over(W.partitionBy("item_id").orderBy("freq", "sh"))
    ordered = items.join(rarity, "sh", "left").fillna(0, ["freq"]).withColumn("need", need).withColumn("i", rank)
    prefix = store.written(ordered.where("i <= size - need + 1").select("sh", "item_id", "need", "length"), "prefix")
    # length bound: the document has as many places as it needs
    met = each.join(store.small(prefix, max_broadcast // 4), "sh").where("total >= need")
    near = met.groupBy(*keys, "item_id").agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.max("need").alias("need"), F.max("length").alias("length"))
    near = store.written(near.withColumns({"id_": F.col("doc_id"), "tid_": F.col("tid")}).drop(*keys), "near")
    # positional bound: every window of a leak lies within one item length of a place where the prefix was met
    pairs = hits.join(store.small(near, max_broadcast // 4), hits["doc_id"].eqNullSafe(near["id_"]) & (hits["tid"] == near["tid_"]))
    around = F.filter("at", lambda p: (p > F.col("first") - F.col("length")) & (p < F.col("last") + F.col("length")))
    pairs = pairs.where(F.size(around) >= F.col("need")).select(*keys, "item_id", "at", "sh")
    sets = items.groupBy("item_id", "size", "length").agg(F.sort_array(F.collect_list("sh")).alias("item"))
    pairs = pairs.join(store.small(sets, max_broadcast // 100), "item_id").select(*keys, "item_id", "size", "length", "at", "sh", "item")

    def verify(batches):
        for b in batches:
            inside = [best_window(np.asarray(at.values), np.asarray(sh.values), np.asarray(item.values), length) for at, sh, item, length in zip(b.column("at"), b.column("sh"), b.column("item"), b.column("length").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("tid"), b.column("item_id"), b.column("size"), pa.array(inside, pa.int32())], ["doc_id", "tid", "item_id", "size", "inside"])

    found = pairs.mapInArrow(verify, "doc_id long, tid long, item_id long, size int, inside int").where(F.col("inside") >= need)
    by = [*keys, "item_id"] if with_key else ["doc_id", "item_id"]
    return found.groupBy(*by).agg(F.round(F.max(F.col("inside") / F.col("size")), 6).alias("containment"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """``docs`` without the rows that leak an item, whatever their id; all columns as they were."""
    tid, bad_id, bad_tid = (store.fresh(docs, x) for x in ("tid", "bad", "bad_tid"))
    bad = leaks(docs, benchmark, with_key=True, **how).select(F.col("doc_id").alias(bad_id), F.col("tid").alias(bad_tid)).distinct()
    bad = store.small(store.written(bad, "leaks"))
    marked = docs.withColumn(tid, store.text_key(docs["text"].cast("string")))
    return marked.join(bad, marked["doc_id"].cast("long").eqNullSafe(bad[bad_id]) & (marked[tid] == bad[bad_tid]), "left_anti").drop(tid)
