"""SimHash near-duplicate search over deletion-variant signatures.

Every document gets a 256-bit SimHash of its words, each weighted by the logarithm of one more than its count in the
document, so a signature depends on the document alone. Cutting 256 bits into m segments, two signatures at distance
<= 2m - 1 have a segment that differs by at most one bit (with exact-match segments the same radius needs 2m of them). Each
segment is indexed once for each of its bits, with that bit deleted, so such pairs meet in an equality join.

A meeting also carries what follows its segment around the ring of segments. Of a pair within distance D some segment begins a
ring of which the first l segments differ in at most l * D / m bits, for every l; meetings where the next segments differ
in more are dropped on the spot. Segments that are equal meet at each of their bits, of which the first one counts. Every other
meeting is verified on the full signature, where it happens: a signature travels once for each half of each segment, of which
one is equal if the segment differs by at most one bit, and its variants are made there. Nothing within ``2m - 1`` is lost and
nothing beyond it is accepted: with 13 segments that is 25 bits of 256. Signatures are collapsed before the join, so
thousands of exact copies cost one signature; to find groups, only the links that connect them leave the place where pairs meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm import store, textcore

BITS = 256
SEGMENTS = 13
#: The farthest that two near-duplicates are apart, and what the index finds for certain.
MAX_DISTANCE = 2 * SEGMENTS - 1
#: Bits of a key that hold which segment and bit it is about; the bits of the ring after a segment take what is left of 64.
_PLACE = 8
#: Bits of a shard's number that hold the bits of a half segment.
_HALF = 24
_SIG = [f"s{i}" for i in range(BITS // 64)]
_U = np.uint64


def _counted(w: textcore.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct words of each text, ordered within a text: hashes, their counts, and offsets by text."""
    order = np.lexsort((w.hashes, w.doc))
    h, d = w.hashes[order], w.doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    at = np.flatnonzero(new)
    return h[at], np.diff(np.append(at, len(h))), np.searchsorted(d[at], np.arange(w.hi - w.lo + 1))


def weights_of(counts: np.ndarray) -> np.ndarray:
    """Integer weights (16ths of the logarithm of one more than a word's count), so that sums are exact in any order."""
    return np.round(16 * np.log1p(counts)).astype(np.float32)


def _signatures(w: textcore.Words) -> tuple[np.ndarray, np.ndarray]:
    """For each text of a slice, its 256 bits as four 64-bit values, and whether it has any word."""
    h, counts, off = _counted(w)
    weight = weights_of(counts)
    n = w.hi - w.lo
    score = np.zeros((n, BITS), np.float64)
    for a in range(0, len(h), 1 << 14):
        z = min(a + (1 << 14), len(h))
        x = np.empty((z - a, BITS // 64), _U)
        for k in range(BITS // 64):
            x[:, k] = textcore.mix(h[a:z] + _U((k + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        bits = np.unpackbits(x.view(np.uint8), axis=1).astype(np.float32)
        wt = weight[a:z]
        for d in range(int(np.searchsorted(off, a, "right")) - 1, n):
            lo, hi = max(int(off[d]), a), min(int(off[d + 1]), z)
            if lo >= z:
                break
            if lo < hi:
                score[d] += 2 * (wt[lo - a : hi - a] @ bits[lo - a : hi - a]) - wt[lo - a : hi - a].sum()
    packed = np.ascontiguousarray(np.packbits(score > 0, axis=1)).view(np.int64)
    return packed, np.diff(off) > 0


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", null_ids: bool = False) -> DataFrame:
    """(doc_id, tid, s0..s3): one row for every row that has an id (or with ``null_ids`` none) and at least one word."""
    t = store.id_text(docs, id_col, text_col).withColumn("tid", store.text_key(F.col("text")))

    def sign(batches):
        for b in batches:
            texts = b.column("text").to_pylist()
            for w in textcore.words(texts):
                sig, some = _signatures(w)
                own = (b.column(c).slice(w.lo, w.hi - w.lo).filter(pa.array(some)) for c in ("doc_id", "tid"))
                yield pa.RecordBatch.from_arrays([*own, *(pa.array(sig[some, k]) for k in range(sig.shape[1]))], ["doc_id", "tid", *_SIG])

    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("tid", T.LongType()), *(T.StructField(c, T.LongType()) for c in _SIG)])
    return (t if null_ids else t.where("doc_id is not null")).mapInArrow(sign, schema)


def _cuts(segments: int) -> list[tuple[int, int]]:
    edge = [round(i * BITS / segments) for i in range(segments + 1)]
    return list(zip(edge, edge[1:]))


def _ring(segments: int) -> tuple[int, int, list[tuple[int, int]]]:
    """Bits of the widest key, bits of the ring that fit behind it and the deleted bit, and (bits, most differences) to test there."""
    cuts = _cuts(segments)
    wide = max(hi - lo for lo, hi in cuts) - 1
    room = 64 - _PLACE - wide - 1
    tests, radius = [], 2 * segments - 1
    for several in range(1, segments):
        # the bits of the next ``several`` segments, wherever on the ring one begins
        ends = [sum(cuts[(s + i) % segments][1] - cuts[(s + i) % segments][0] for i in range(1, several + 1)) for s in range(segments)]
        most = (several + 1) * radius // segments
        # at the shortest of them, so that the test is right for every segment
        tests.append((min(min(ends), room), most))
        if min(ends) >= room:
            break
    return wide, room, tests if room else []


def _halves(segments: int) -> list[tuple[int, int, int, int]]:
    """(from, to, lo, hi) of each half of each segment, in bits, and of the other half of that segment."""
    both = [((lo, (lo + hi) // 2), ((lo + hi) // 2, hi)) for lo, hi in _cuts(segments)]
    return [(*one, *other) for x, y in both for one, other in ((x, y), (y, x))]


def _words(sig: np.ndarray) -> np.ndarray:
    """The four values of each signature, as numbers of which the highest bit comes first."""
    return np.ascontiguousarray(sig).view(">u8").astype(_U)


def _window(words: np.ndarray, at: int, width: int) -> np.ndarray:
    """The ``width`` bits (63 at most) of each signature from bit ``at`` on, around the ring."""
    if not width:
        return np.zeros(len(words), _U)
    k, r = at % BITS // 64, at % 64
    x = words[:, k] << _U(r)
    if r:
        x |= words[:, (k + 1) % (BITS // 64)] >> _U(64 - r)
    return x >> _U(64 - width)


def _variant_keys(sig: np.ndarray, segments: int, start: int = 0, stop: int = BITS) -> np.ndarray:
    """One-deletion variants: row r, column b - start is the key of signature r's segment around bit b without that bit.

    From the top: the place b, the other bits of the segment, bit b, and as many of the bits after the segment as there is room for.
    """
    words = _words(sig)
    wide, room, _ = _ring(segments)
    keys = np.empty((len(sig), stop - start), _U)
    for lo, hi in _cuts(segments):
        if hi <= start or lo >= stop:
            continue
        value, after = _window(words, lo, hi - lo), _window(words, hi, room)
        for b in range(max(lo, start), min(hi, stop)):
            place = hi - 1 - b
            # bits above the deleted one move down by one place
            gone = ((value >> _U(place + 1)) << _U(place)) | (value & _U((1 << place) - 1))
            keys[:, b - start] = (((((_U(b) << _U(wide)) | gone) << _U(1)) | ((value >> _U(place)) & _U(1))) << _U(room)) | after
    return keys


def _meetings(key: np.ndarray, segments: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of all pairs of keys of one place and variant that don't differ too much in the ring after it, in parts."""
    wide, room, tests = _ring(segments)
    first = np.zeros(BITS, bool)
    first[[lo for lo, _ in _cuts(segments)]] = True
    order = np.argsort(key)
    k = key[order]
    begin = np.flatnonzero(np.concatenate([[True], (k[1:] ^ k[:-1]) >> _U(room + 1) != 0]))
    size = np.diff(np.append(begin, len(k)))
    size = np.repeat(size, size)
    bits, most = tests[-1]
    widest, same, low = _U(((1 << bits) - 1) << (room - bits)), _U(2 << room), _U((1 << room) - 1)
    step, then, out, n = 1, 1, [], 0
    while len(k):
        if step == then:
            # now and then, rows of runs that are too short by now are left out
            more = size > step
            k, order, size = k[more], order[more], size[more]
            then = max(step + 1, step * 5 // 4)
        # each row with the row ``step`` places further on, if that is in the same run; slices stay in the processor's cache
        for a in range(0, len(k) - step, 1 << 13):
            z = min(a + (1 << 13), len(k) - step)
            differ = k[a + step : z + step] ^ k[a:z]
            near = np.bitwise_count(differ & widest) <= most
            near &= differ < same
            at = np.flatnonzero(near)
            if not len(at):
                continue
            differ = differ[at]
            at += a
            # an equal segment counts at its first bit only
            fine = (differ >> _U(room) != 0) | first[(k[at] >> _U(wide + room + 1)).astype(np.int64)]
            differ &= low
            for b, m in tests[:-1]:
                fine &= np.bitwise_count(differ >> _U(room - b)) <= m
            at = at[fine]
            out.append((order[at], order[at + step]))
            n += len(at)
            if n > 1 << 18:
                yield tuple(map(np.concatenate, zip(*out)))
                out, n = [], 0
        step += 1
    if n:
        yield tuple(map(np.concatenate, zip(*out)))


def _runs_to_pairs(key: np.ndarray, who: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (a < b) of different ``who``, numbers below 2**31, that meet, each once."""
    out = np.zeros(0, np.int64)
    for x, y in _meetings(key, segments):
        x, y = who[x], who[y]
        out = np.unique(np.concatenate([out, (np.minimum(x, y) << 32 | np.maximum(x, y))[x != y]]))
    return out >> 32, out & 0xFFFFFFFF


def _sharded(groups: DataFrame, segments: int) -> DataFrame:
    """(shard, rep, s0..s3): each signature once for each half of each segment, beside those that are equal in that half, in order.

    A segment that differs by one bit at most has a half that doesn't differ, so the variants of a segment need not travel: they are made where
    they meet, one half of its bits in each of the two shards.
    """
    if segments < 1 or BITS // segments > 48:
        raise ValueError("a segment must have 1 to 48 bits")
    halves = _halves(segments)

    def spread(batches):
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                part = b.slice(at, 2048)
                words = _words(np.stack([part.column(c).to_numpy() for c in _SIG], 1))
                shard = np.concatenate([_U(i << _HALF) | _window(words, lo, hi - lo) for i, (lo, hi, _, _) in enumerate(halves)])
                again = pa.array(np.tile(np.arange(part.num_rows), len(halves)))
                yield pa.RecordBatch.from_arrays([pa.array(shard.view(np.int64)), *(part.column(c).take(again) for c in ("rep", *_SIG))], ["shard", "rep", *_SIG])

    fields = ", ".join(f"{c} long" for c in ("shard", "rep", *_SIG))
    return groups.select("rep", *_SIG).mapInArrow(spread, fields).repartition("shard").sortWithinPartitions("shard")


def _whole_shards(batches: Iterator[pa.RecordBatch], most: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(shard, rep, signatures) of several whole shards at once, of about ``most`` rows, or of one that is larger."""
    held, n = [], 0
    for b in batches:
        if b.num_rows:
            held.append((b.column("shard").to_numpy(), b.column("rep").to_numpy(), np.stack([b.column(c).to_numpy() for c in _SIG], 1)))
            n += b.num_rows
        if n >= most and held[0][0][0] != held[-1][0][-1]:
            shard, rep, sig = map(np.concatenate, zip(*held))
            cut = int(np.searchsorted(shard, shard[-1]))
            yield shard[:cut], rep[:cut], sig[:cut]
            held, n = [(shard[cut:], rep[cut:], sig[cut:])], len(shard) - cut
    if held:
        yield tuple(map(np.concatenate, zip(*held)))


def _keys_of_shards(shard: np.ndarray, sig: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """The variants that are due in each row's shard, and which row each of them belongs to."""
    halves, half = _halves(segments), shard >> _HALF
    keys, who = [], []
    for i in np.unique(half):
        lo, hi = np.searchsorted(half, [i, i + 1])
        k = _variant_keys(sig[lo:hi], segments, *halves[i][2:])
        keys.append(k.ravel())
        who.append(np.repeat(np.arange(lo, hi), k.shape[1]))
    return np.concatenate(keys), np.concatenate(who)


def _apart(sig: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    # without signs: of a negative number bitwise_count takes the absolute value
    return np.bitwise_count((sig[a] ^ sig[b]).view(_U)).sum(1, dtype=np.int32)


def _begins(differ: np.ndarray, segments: int) -> np.ndarray:
    """For each XOR of two signatures, the first segment at which they meet."""
    words, (_, room, tests) = _words(differ), _ring(segments)
    at = np.full(len(words), segments)
    for s, (lo, hi) in reversed(list(enumerate(_cuts(segments)))):
        after = _window(words, hi, room)
        meets = np.bitwise_count(_window(words, lo, hi - lo)) <= 1
        for bits, most in tests:
            meets &= np.bitwise_count(after >> _U(room - bits)) <= most
        at[meets] = s
    return at


def near_pairs(groups: DataFrame, segments: int = SEGMENTS) -> DataFrame:
    """(a, b, distance) with a < b: the pairs of distinct signatures (rep, s0..s3) within 2 * segments - 1, every one of them.

    There is no cap on the size of a bucket.
    """

    def meet(batches):
        for shard, rep, sig in _whole_shards(batches):
            a, b = _runs_to_pairs(*_keys_of_shards(shard, sig, segments), segments)
            apart = _apart(sig, a, b)
            # a pair that meets at several segments counts at the first
            once = apart < 2 * segments
            once[once] = _begins(sig[a[once]] ^ sig[b[once]], segments) == shard[a[once]] >> (_HALF + 1)
            a, b = rep[a[once]], rep[b[once]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(apart[once])], ["a", "b", "distance"])

    return _sharded(groups, segments).mapInArrow(meet, "a long, b long, distance int")


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links from each number that occurs in a pair, but the smallest it is connected to, to that one."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(ids))
    while True:
        lower = root.copy()
        np.minimum.at(lower, x, root[y])
        np.minimum.at(lower, y, root[x])
        lower = lower[lower]
        if (lower == root).all():
            break
        root = lower
    more = root != np.arange(len(ids))
    return ids[root[more]], ids[more]


def near_links(groups: DataFrame, segments: int = SEGMENTS) -> DataFrame:
    """(a, b) with a < b: links that connect just those signatures that ``near_pairs`` connects.

    Of the pairs that are found together only as many are returned as it takes to connect them, so a signature has at most one row for each
    half of each segment, however many others are near it.
    """

    def meet(batches):
        for shard, rep, sig in _whole_shards(batches):
            key, who = _keys_of_shards(shard, sig, segments)
            found, n = [], 0
            for a, b in _meetings(key, segments):
                a, b = who[a], who[b]
                near = _apart(sig, a, b) < 2 * segments
                found.append((rep[a[near]], rep[b[near]]))
                n += len(found[-1][0])
                if n > 1 << 20:
                    found = [_stars(*map(np.concatenate, zip(*found)))]
                    n = len(found[0][0])
            if n:
                a, b = _stars(*map(np.concatenate, zip(*found)))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return _sharded(groups, segments).mapInArrow(meet, "a long, b long").distinct()


def components(pairs: DataFrame) -> DataFrame:
    """(id, root): for every id in a pair (a, b), the smallest id it is connected to.

    Labels spread to neighbours and then jump to their label's label, so rounds grow with the logarithm of a
    component's diameter; each round is written to the shared folder.
    """
    edges = store.written(pairs.select("a", "b").union(pairs.select("b", "a")), "edges")
    labels = store.written(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("root")), "labels")
    while True:
        seen = edges.join(labels, edges.b == labels.id).select(F.col("a").alias("id"), "root")
        lower = seen.union(labels).groupBy("id").agg(F.min("root").alias("root"))
        to = labels.select(F.col("id").alias("root"), F.col("root").alias("further"))
        new = store.written(lower.join(to, "root", "left").select("id", F.least("root", F.coalesce("further", "root")).alias("root")), "labels")
        changed = new.join(labels.withColumnRenamed("root", "was"), "id").where("root <> was").limit(1).count()
        labels = new
        if not changed:
            return labels


def duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", segments: int = SEGMENTS) -> DataFrame:
    """(doc_id, kept_id): every document that repeats another one, with the document of its group that stays.

    Groups are the connected components of verified pairs; the smallest doc_id stays. Null ids and documents without
    any word (null, empty, only punctuation) take part in no group. Rows that share a doc_id are one document to this
    operator: it is a copy if any of its rows is. Texts count whole, however long. Extra columns are left out; an empty
    table gives an empty result.
    """
    sig = store.written(signatures(docs, id_col, text_col).select("doc_id", *_SIG), "signatures")
    groups = _groups(sig, F.min("doc_id").alias("first"))
    first = groups.select("rep", "first")
    near = near_links(groups, segments).join(first.toDF("a", "x"), "a").join(first.toDF("b", "y"), "b").where("x <> y")
    # one id may carry several signatures (repeated ids): its groups are then one
    same = sig.join(groups, _SIG).where("doc_id <> first").select("first", "doc_id").distinct()
    return components(near.select(F.col("x").alias("a"), F.col("y").alias("b")).union(same)).where("id <> root").select(F.col("id").alias("doc_id"), F.col("root").alias("kept_id"))


def _groups(sig: DataFrame, *what: Column) -> DataFrame:
    """(rep, s0..s3, ...): the distinct signatures, each with a key of its own, and what else is asked of their rows."""
    return store.written(sig.groupBy(*_SIG).agg(*what).withColumn("rep", F.monotonically_increasing_id()), "groups")


def drop_near_duplicate_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", segments: int = SEGMENTS) -> DataFrame:
    """``docs`` with one row for each group of near-duplicate texts, all columns as they were.

    Rows are judged by their own text: those that share a doc_id but not a text are as different as any others, and a null
    doc_id is an id that comes last. The row with the smallest (doc_id, text key) stays; of rows equal in both, one does.
    Texts without any word are no copies, but of rows of one id and text.
    """
    from pyspark.sql import Window as W

    sig = store.written(signatures(docs, id_col, text_col, null_ids=True), "signatures")
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tid")
    groups = _groups(sig, F.min(row).alias("first"), F.max(row).alias("last"))
    roots = components(near_links(groups, segments))
    linked = groups.join(roots, groups["rep"] == roots["id"], "left").where("id is not null or first <> last").withColumn("root", F.coalesce("root", "rep"))
    stays = linked.groupBy("root").agg(F.min("first").alias("stays"))
    rows = sig.join(linked.select(*_SIG, "root"), _SIG).join(stays, "root").where(row != F.col("stays")).select(F.col("doc_id").alias("__gone"), F.col("tid").alias("__gone_tid")).distinct()
    rows = store.small(store.written(rows, "gone"))
    tid, rank, key_id, key_tid = (store.fresh(docs, x) for x in ("tid", "rank", "key", "key_tid"))
    marked = docs.withColumn(tid, store.text_key(docs[text_col].cast("string")))
    kept = marked.join(rows, marked[id_col].cast("long").eqNullSafe(rows["__gone"]) & (marked[tid] == rows["__gone_tid"]), "left_anti")
    # of rows equal in id and text one stays; only those are brought together
    own = kept.select(F.col(id_col).cast("long").alias(key_id), F.col(tid).alias(key_tid))
    twice = own.groupBy(key_id, key_tid).agg(F.count("*").alias("n")).where("n > 1").drop("n")
    # without an id, only rows with words
    some = sig.where("doc_id is null").select(F.col("tid").alias(key_tid)).distinct()
    twice = twice.where(F.col(key_id).isNotNull()).unionByName(twice.where(F.col(key_id).isNull()).join(some, key_tid, "left_semi"))
    twice = store.small(store.written(twice, "twice"))
    same = kept[id_col].cast("long").eqNullSafe(twice[key_id]) & (kept[tid] == twice[key_tid])
    once = kept.join(twice, same, "left_anti")
    first = F.row_number().over(W.partitionBy(F.col(id_col).cast("long"), tid).orderBy(tid))
    one = kept.join(twice, same, "left_semi").withColumn(rank, first).where(F.col(rank) == 1).drop(rank)
    return once.unionByName(one).drop(tid)


drop_near_duplicates = drop_near_duplicate_rows
