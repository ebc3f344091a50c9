"""Katz backoff scoring with a word bigram model counted on the whole corpus.

The documents are packed into chunks of about ``CHUNK`` characters. A chunk sends its distinct n-grams to the shards that own
them, packed into one binary row for each shard, so the shuffle moves blobs and not words. There is a shard for each
``SHARD`` characters, so none grows with the corpus. A shard adds the counts up, answers each chunk with the counts it asked about,
and writes its part of the model as rows of arrays. Backoff weights come from the shards of bigrams, which ask the shards
of words for the probabilities of the words they have. A chunk's tokens are scored recursively:

    p(w | h) = d(c(h w)) * c(h w) / c(h)    if the bigram is in the model
    p(w | h) = alpha(h) * p(w)              else
    p(w)     = d(c(w)) * c(w) / N           for words of the corpus

d are Good-Turing discounts (Katz's, for counts up to ``K``), alpha(h) makes the probabilities after h sum to 1 exactly, and
what the discounts leave of the unigrams is the share of unknown words. Tokens that back off are few, or none where the scored
documents are those counted: they become rows that are joined with the tables of weights and words. Bigrams seen fewer than
``min_count`` times are left out of the model and backed off from; by default none is. A document begins with a start sign.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm import store, textcore

K = 5
MIN_COUNT = 1
#: Characters in a chunk, which one Python worker holds at once; and in the part of the corpus that one shard answers for.
CHUNK = 1 << 23
SHARD = 1 << 23
#: N-grams in a row of the model's tables.
ROW = 1 << 16
START = np.uint64(0x5747_5254_5353_4F42)
_SCHEMA = "kind string, shard int, chunk long, n long, m long, a binary, b binary, c binary, hs array<long>, ws array<long>, ns array<long>"
_TYPES = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), *[pa.list_(pa.int64())] * 3]
_NAMES = ["kind", "shard", "chunk", "n", "m", "a", "b", "c", "hs", "ws", "ns"]
_EMPTY = np.zeros(0, np.uint64)


def discounts(n_r: dict[int, int], k: int = K, least: int = 1) -> np.ndarray:
    """d(0..k); ``n_r``: how many n-grams have each count. Counts under ``least`` get 0; above k nothing is discounted.

    Where the counts of counts don't allow Good-Turing (a missing one, or a discount outside (0, 1]), nothing is.
    """
    d = np.ones(k + 1)
    n1, top = n_r.get(1, 0), (k + 1) * n_r.get(k + 1, 0)
    if n1 and top < n1:
        for r in range(1, k + 1):
            if n_r.get(r) and n_r.get(r + 1):
                x = ((r + 1) * n_r[r + 1] / (r * n_r[r]) - top / n1) / (1 - top / n1)
                d[r] = x if 0 < x <= 1 else 1.0
    d[:least] = 0
    return d


def _tokens(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts: word hashes, the hash before each (or the start sign), and each word's text."""
    ws, hs, docs = [_EMPTY], [_EMPTY], [np.zeros(0, np.int32)]
    for x in textcore.words(texts):
        h = np.empty_like(x.hashes)
        h[1:] = x.hashes[:-1]
        h[x.offsets[:-1][np.diff(x.offsets) > 0]] = START
        ws.append(x.hashes)
        hs.append(h)
        docs.append((x.doc + x.lo).astype(np.int32))
    return np.concatenate(ws), np.concatenate(hs), np.concatenate(docs)


def _shard(key: np.ndarray, shards: int) -> np.ndarray:
    return ((key >> np.uint64(20)) % np.uint64(shards)).astype(np.int64)


def _key(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    return textcore.mix(h * np.uint64(0xD6E8FEB86659FD93) + w)


def _bigrams(w: np.ndarray, h: np.ndarray, shards: int):
    """Distinct bigrams by shard, history and key: (shard, h, w, count), and for each token which one it is.

    Bigrams of one history share a shard, so that it is sent once; with many shards a history is split over some of them,
    so that the commonest one is never more than a few shards' usual load.
    """
    key = _key(h, w)
    uniq, first, back, n = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    hs, ws, n = h[first], w[first], n.astype(np.int32)
    part = textcore.mix(ws) % np.uint64(1 + shards // 64)
    del key, first
    shard = _shard(textcore.mix(hs + part * np.uint64(0x9E3779B97F4A7C15)), shards)
    del part
    order = np.lexsort((uniq, hs, shard))
    del uniq
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order), dtype=np.int32)
    return shard[order], hs[order], ws[order], n[order], place[back]


def _packed_histories(h: np.ndarray) -> bytes:
    """A run of equal histories is sent once, with its length."""
    edge = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1], [True]]))
    return len(edge[:-1]).to_bytes(8, "little") + h[edge[:-1]].tobytes() + np.diff(edge).astype(np.int32).tobytes()


def _histories(b: bytes) -> np.ndarray:
    n = int.from_bytes(b[:8], "little")
    return np.repeat(np.frombuffer(b, np.uint64, n, 8), np.frombuffer(b, np.int32, n, 8 + 8 * n))


def _packed_counts(n: np.ndarray) -> bytes:
    """Counts in as few bytes each as the largest of them takes."""
    kind = next(t for t in (np.uint8, np.uint16, np.uint32, np.int64) if not len(n) or n.max() <= np.iinfo(t).max)
    return np.dtype(kind).itemsize.to_bytes(1, "little") + n.astype(kind).tobytes()


def _counts(b: bytes) -> np.ndarray:
    return np.frombuffer(b, {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.int64}[b[0]], offset=1).astype(np.int64)


def _pack(docs: DataFrame) -> DataFrame:
    """(chunk, chars, docs): rows (doc_id, text) as they come, so many of them that they have ``CHUNK`` characters, compressed.

    A text that is longer than that is a chunk by itself.
    """

    def run(batches):
        part, several, ids, texts, size = TaskContext.get().partitionId(), 0, [], [], 0

        def row():
            raw = pickle.dumps((ids, texts))
            blob = len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)
            return pa.RecordBatch.from_arrays([pa.array([part << 20 | several], pa.int64()), pa.array([size], pa.int64()), pa.array([blob], pa.binary())], ["chunk", "chars", "docs"])

        for b in batches:
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                ids.append(i)
                texts.append(t)
                size += len(t or "") + 1
                if size >= CHUNK:
                    yield row()
                    several, ids, texts, size = several + 1, [], [], 0
        if ids:
            yield row()

    return docs.select("doc_id", "text").mapInArrow(run, "chunk long, chars long, docs binary")


def _unpack(b: pa.Buffer) -> tuple[list, list]:
    return pickle.loads(pa.decompress(b[8:], int.from_bytes(b[:8].to_pybytes(), "little"), "zstd"))


def _unigrams(w: np.ndarray, h: np.ndarray, shards: int):
    """Distinct words and histories by shard, then hash: (shard, word, count as word, count as history)."""
    uniq, back = np.unique(np.concatenate([w, h]), return_inverse=True)
    n = np.bincount(back[: len(w)], minlength=len(uniq))
    m = np.bincount(back[len(w) :], minlength=len(uniq))
    shard = _shard(uniq, shards)
    order = np.argsort(shard, kind="stable")
    return shard[order], uniq[order], n[order], m[order]


def _runs(shard: np.ndarray):
    edge = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1], [True]])) if len(shard) else np.zeros(1, np.int64)
    return zip(shard[edge[:-1]].tolist(), edge[:-1].tolist(), edge[1:].tolist())


def _row(kind: str, shard: int, **what) -> tuple:
    return (kind, shard, *(what.get(x) for x in _NAMES[2:]))


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * len(_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES)], _NAMES)


def _table(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_batches([_rows(rows)])


def _count_chunks(chunks: DataFrame, shards: int) -> DataFrame:
    """One row by chunk and shard with the chunk's bigrams, and one with its words."""

    def ask(batches):
        for batch in batches:
            for chunk, docs in zip(batch.column("chunk").to_pylist(), batch.column("docs")):
                w, h, _ = _tokens(_unpack(docs.as_buffer())[1])
                s, hs, ws, n, _ = _bigrams(w, h, shards)
                yield _rows([_row("bigrams", k, chunk=chunk, a=_packed_histories(hs[lo:hi]), b=ws[lo:hi].tobytes(), c=_packed_counts(n[lo:hi])) for k, lo, hi in _runs(s)])
                s, ws, n, m = _unigrams(w, h, shards)
                yield _rows([_row("words", k, chunk=chunk, a=ws[lo:hi].tobytes(), b=_packed_counts(n[lo:hi]), c=_packed_counts(m[lo:hi])) for k, lo, hi in _runs(s)])

    return chunks.select("chunk", "docs").mapInArrow(ask, _SCHEMA)


def _counts_of_counts(kind: str, shard: int, n: np.ndarray) -> list[tuple]:
    r = np.bincount(np.minimum(n, K + 2))
    return [_row(kind, shard, n=int(r[i]), m=i) for i in range(1, min(len(r), K + 2))]


def _pieces(kind: str, shard: int, hs: np.ndarray | None, ws: np.ndarray, ns: np.ndarray) -> list[tuple]:
    """Rows of a table of the model."""
    at = range(0, len(ws), ROW)
    return [_row(kind, shard, hs=None if hs is None else hs[i : i + ROW].view(np.int64), ws=ws[i : i + ROW].view(np.int64), ns=ns[i : i + ROW]) for i in at]


def _add_up(asked: DataFrame, shards: int, min_count: int) -> DataFrame:
    """By shard: the model's rows (bigram, word), answers to chunks, words asked for by shards of bigrams, and counts of counts."""

    def add(t: pa.Table) -> pa.Table:
        kind, chunk, shard = t.column("kind").to_pylist(), t.column("chunk").to_pylist(), t.column("shard")[0].as_py()
        a, b, c = (t.column(x).to_pylist() for x in "abc")
        rows = []
        own = [i for i, x in enumerate(kind) if x == "bigrams"]
        if own:
            h, w = np.concatenate([_histories(a[i]) for i in own]), np.concatenate([np.frombuffer(b[i], np.uint64) for i in own])
            n = np.concatenate([_counts(c[i]) for i in own])
            _, first, back = np.unique(_key(h, w), return_index=True, return_inverse=True)
            total = np.zeros(len(first), np.int64)
            np.add.at(total, back, n)
            at = 0
            for i in own:
                size = len(b[i]) // 8
                rows.append(_row("answer", shard, chunk=chunk[i], a=_packed_counts(total[back[at : at + size]])))
                at += size
            rows += _counts_of_counts("count2", shard, total)
            first, total = first[total >= min_count], total[total >= min_count]
            h, w = h[first], w[first]
            order = np.lexsort((w, h))
            h, w, total = h[order], w[order], total[order]
            rows += _pieces("bigram", shard, h, w, total)
            uniq = np.unique(w)
            s = _shard(uniq, shards)
            order = np.argsort(s, kind="stable")
            # the shard that asks goes by the name of chunk
            rows += [_row("want", k, chunk=shard, a=uniq[order[lo:hi]].tobytes()) for k, lo, hi in _runs(s[order])]
        own = [i for i, x in enumerate(kind) if x == "words"]
        if own:
            w = np.concatenate([np.frombuffer(a[i], np.uint64) for i in own])
            uniq, back = np.unique(w, return_inverse=True)
            n, m = np.zeros((2, len(uniq)), np.int64)
            np.add.at(n, back, np.concatenate([_counts(b[i]) for i in own]))
            np.add.at(m, back, np.concatenate([_counts(c[i]) for i in own]))
            at = 0
            for i in own:
                size = len(a[i]) // 8
                rows.append(_row("history", shard, chunk=chunk[i], a=_packed_counts(m[back[at : at + size]])))
                at += size
            rows += _pieces("word", shard, m, uniq, n)
            rows += _counts_of_counts("count1", shard, n)
            rows.append(_row("total", shard, n=int(n.sum()), m=0))
        return _table(rows)

    return asked.groupBy("shard").applyInArrow(add, _SCHEMA)


class Model:
    """Tables of the shared folder: words (w, n, m, p), histories (h, alpha) and bigrams (h, w, n, p); and discounts.

    ``n`` counts occurrences, ``m`` those as a history. All tables are written by shard, so that each is read in parts.
    """

    def __init__(self, counted: DataFrame, shards: int, min_count: int):
        self.counted, self.shards, self.min_count = counted, shards, min_count
        few = counted.where(F.col("kind").isin("count1", "count2", "total")).groupBy("kind", "m").agg(F.sum("n").alias("n")).collect()
        n_r = {k: {r["m"]: r["n"] for r in few if r["kind"] == k} for k in ("count1", "count2")}
        self.total = sum(r["n"] for r in few if r["kind"] == "total")
        self.d1, self.d2 = discounts(n_r["count1"]), discounts(n_r["count2"], least=min_count)
        each = counted.where("kind = 'word'").select(F.explode(F.arrays_zip("hs", "ws", "ns")).alias("x"))
        self.words = each.select(F.col("x.ws").alias("w"), F.col("x.ns").alias("n"), F.col("x.hs").alias("m"), (self._discounted(F.col("x.ns"), self.d1) / F.lit(float(max(self.total, 1)))).alias("p"))
        self.histories = store.written(self._weights(), "histories")
        #: The probability of a word that the corpus doesn't have.
        self.unknown = max(0.0, 1 - (sum(self.d1[r] * r * n for r, n in n_r["count1"].items() if r <= K) + self._above(n_r["count1"])) / max(self.total, 1))

    def _above(self, n_r: dict[int, int]) -> int:
        """How many tokens are of words seen more than ``K`` times."""
        return self.total - sum(r * n for r, n in n_r.items() if r <= K)

    @staticmethod
    def _discounted(n: Column, d: np.ndarray) -> Column:
        return F.get(F.array(*(F.lit(float(x)) for x in d), F.lit(1.0)), F.least(n, F.lit(len(d))).cast("int")) * n

    def _weights(self) -> DataFrame:
        """(h, alpha): what the bigrams of a history leave, shared out over the words that don't follow it there."""
        shards, d1, d2, total = self.shards, np.append(self.d1, 1.0), np.append(self.d2, 1.0), max(self.total, 1)

        def answer(wants: pa.Table, words: pa.Table) -> pa.Table:
            if not wants.num_rows:
                return _table([])
            w = np.concatenate([np.asarray(x.values) for x in words.column("ws")]).view(np.uint64)
            n = np.concatenate([np.asarray(x.values) for x in words.column("ns")])
            order = np.argsort(w)
            p = (d1[np.minimum(n, len(d1) - 1)] * n / total)[order]
            w = w[order]
            shard = wants.column("shard")[0].as_py()
            return _table([_row("p", asks, chunk=shard, a=p[np.searchsorted(w, np.frombuffer(blob, np.uint64))].tobytes()) for asks, blob in zip(wants.column("chunk").to_pylist(), wants.column("a").to_pylist())])

        def add(bigrams: pa.Table, got: pa.Table) -> pa.Table:
            if not bigrams.num_rows:
                return pa.table({"hs": pa.array([], pa.list_(pa.int64())), "mass": pa.array([], pa.list_(pa.float64())), "lower": pa.array([], pa.list_(pa.float64()))})
            h, w, n = (np.concatenate([np.asarray(x.values) for x in bigrams.column(c)]) for c in ("hs", "ws", "ns"))
            h, w = h.view(np.uint64), w.view(np.uint64)
            uniq = np.unique(w)
            order = np.argsort(_shard(uniq, shards), kind="stable")
            p = np.empty(len(uniq))
            p[order] = np.concatenate([np.frombuffer(x, np.float64) for _, x in sorted(zip(got.column("chunk").to_pylist(), got.column("a").to_pylist()))])
            hs, back = np.unique(h, return_inverse=True)
            mass = np.bincount(back, d2[np.minimum(n, len(d2) - 1)] * n)
            lower = np.bincount(back, p[np.searchsorted(uniq, w)])
            at = range(0, len(hs), ROW)
            return pa.table({"hs": pa.array([hs[i : i + ROW].view(np.int64) for i in at], pa.list_(pa.int64())), "mass": pa.array([mass[i : i + ROW] for i in at], pa.list_(pa.float64())), "lower": pa.array([lower[i : i + ROW] for i in at], pa.list_(pa.float64()))})

        wants = self.counted.where("kind = 'want'").select("shard", "chunk", "a")
        words = self.counted.where("kind = 'word'").select("shard", "ws", "ns")
        got = wants.groupBy("shard").cogroup(words.groupBy("shard")).applyInArrow(answer, _SCHEMA).select("shard", "chunk", "a")
        bigrams = self.counted.where("kind = 'bigram'").select("shard", "hs", "ws", "ns")
        parts = bigrams.groupBy("shard").cogroup(got.groupBy("shard")).applyInArrow(add, "hs array<long>, mass array<double>, lower array<double>")
        each = parts.select(F.explode(F.arrays_zip("hs", "mass", "lower")).alias("x"))
        # a history may be split over shards
        sums = each.groupBy(F.col("x.hs").alias("h")).agg(F.sum("x.mass").alias("mass"), F.sum("x.lower").alias("lower"))
        m = self.words.where("m > 0").select(F.col("w").alias("h"), "m")
        left, rest = 1 - F.coalesce(F.col("mass") / F.col("m"), F.lit(0.0)), 1 - F.coalesce("lower", F.lit(0.0))
        return m.join(sums, "h", "left").select("h", F.when(rest > 1e-12, F.greatest(left, F.lit(0.0)) / rest).otherwise(0.0).alias("alpha"))

    @property
    def bigrams(self) -> DataFrame:
        each = self.counted.where("kind = 'bigram'").select(F.explode(F.arrays_zip("hs", "ws", "ns")).alias("x"))
        found = each.select(F.col("x.hs").alias("h"), F.col("x.ws").alias("w"), F.col("x.ns").alias("n"))
        return found.join(self.words.select(F.col("w").alias("h"), "m"), "h").select("h", "w", "n", (self._discounted(F.col("n"), self.d2) / F.col("m")).alias("p"))


def _shards_of(chunks: DataFrame) -> int:
    return max(1, math.ceil((chunks.agg(F.sum("chars").alias("n")).collect()[0]["n"] or 0) / SHARD))


def train(chunks: DataFrame, min_count: int = MIN_COUNT) -> Model:
    """The model of all documents of the chunks, with the shards' answers to them."""
    shards = _shards_of(chunks)
    return Model(store.written(_add_up(_count_chunks(chunks, shards), shards, min_count), "katz", by="kind"), shards, min_count)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_count: int = MIN_COUNT) -> DataFrame:
    """(doc_id, n_tokens, log_prob, perplexity): one row for every row, scored by the model of all rows.

    ``log_prob`` is the natural logarithm of the whole text's probability, however long it is. Texts without words (null, empty)
    have 0 tokens, log_prob 0 and a null perplexity. Repeated rows count as often as they occur; ids may be null or
    repeated. Extra columns are left out; an empty table gives an empty result. A probability of 0 counts as 1e-300.
    """
    chunks = store.written(_pack(store.id_text(docs, id_col, text_col)), "chunks")
    model = train(chunks, min_count)
    shards, d2 = model.shards, np.append(model.d2, 1.0)

    def evaluate(texts: pa.Table, got: pa.Table) -> pa.Table:
        ids, raw = _unpack(texts.column("docs")[0].as_buffer())
        chunk, several = texts.column("chunk")[0].as_py(), len(ids)
        w, h, doc = _tokens(raw)
        del raw
        answers = sorted(zip(got.column("kind").to_pylist(), got.column("shard").to_pylist(), got.column("a").to_pylist()))

        def together(what: str) -> np.ndarray:
            return np.concatenate([_counts(x) for kind, _, x in answers if kind == what])

        total, away = np.zeros(several), [_EMPTY, _EMPTY]
        open_ = np.zeros(several, np.int64)
        if len(w):
            which = _bigrams(w, h, shards)[-1]
            n = together("answer")[which]
            del which
            uniq = _unigrams(w, h, shards)[1]
            order = np.argsort(uniq)
            m = together("history")[order[np.searchsorted(uniq, h, sorter=order)]]
            kept = n >= min_count
            lp = np.where(kept, np.log(np.maximum(d2[np.minimum(n, len(d2) - 1)] * n, 1e-300) / np.maximum(m, 1)), 0)
            total = np.bincount(doc, lp, several)
            away = [h[~kept], w[~kept]]
            open_ = np.bincount(doc[~kept], minlength=several)
        tokens = np.bincount(doc, minlength=several)
        edge = pa.array(np.concatenate([[0], np.cumsum(open_)]).astype(np.int32))
        lists = [pa.ListArray.from_arrays(edge, pa.array(x.view(np.int64))) for x in away]
        rid = (chunk << 24) + np.arange(several)
        return pa.Table.from_arrays([pa.array(rid), pa.array(ids, pa.int64()), pa.array(tokens.astype(np.int64)), pa.array(total), *lists], ["rid", "doc_id", "n_tokens", "log_prob", "hs", "ws"])

    answers = model.counted.where("kind in ('answer', 'history')").select("kind", "shard", "chunk", "a")
    scored = chunks.select("chunk", "docs").groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(evaluate, "rid long, doc_id long, n_tokens long, log_prob double, hs array<long>, ws array<long>")
    scored = store.written(scored, "scored")
    open_ = scored.where("size(hs) > 0").select("rid", F.explode(F.arrays_zip("hs", "ws")).alias("x")).select("rid", F.col("x.hs").alias("h"), F.col("x.ws").alias("w"))
    lp = F.col("log_prob")
    if not open_.isEmpty():
        p = F.greatest(F.coalesce("alpha", F.lit(1.0)) * F.coalesce("p", F.lit(model.unknown)), F.lit(1e-300))
        backed = open_.join(model.words.select("w", "p"), "w", "left").join(model.histories, "h", "left").groupBy("rid").agg(F.sum(F.log(p)).alias("lower"))
        scored, lp = scored.join(backed, "rid", "left"), lp + F.coalesce("lower", F.lit(0.0))
    perplexity = F.when(F.col("n_tokens") > 0, F.round(F.exp(F.least(-lp / F.col("n_tokens"), F.lit(700.0))), 4))
    return scored.select("doc_id", "n_tokens", F.round(lp + 0.0, 4).alias("log_prob"), perplexity.alias("perplexity"))


def model_tables(docs: DataFrame, text_col: str = "text", min_count: int = MIN_COUNT) -> tuple[DataFrame, DataFrame]:
    """The model itself: words (w, n, m, p, alpha) and bigrams (h, w, n, p)."""
    chunks = store.written(_pack(docs.select(F.lit(None).cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))), "chunks")
    model = train(chunks, min_count)
    return model.words.join(model.histories.withColumnRenamed("h", "w"), "w", "left").select("w", "n", "m", "p", F.coalesce("alpha", F.lit(1.0)).alias("alpha")), model.bigrams
