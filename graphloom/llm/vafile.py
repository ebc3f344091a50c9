"""Exact nearest neighbours with a vector-approximation file.

Every dimension is cut into cells; a vector's approximation is its cell in each dimension, a few bits, and how far it is from
the middle of its cells. Blocks of queries scan blocks of approximations, which hold no vectors. A query's distances from the middles, one
matrix product, are off by no more than that, so they bound its distances from the vectors on both sides. A query keeps the vectors whose
lower bound isn't above the k-th smallest upper bound. Only then exact vectors are read, in the order of the lower bounds: the first few of
each query, whose k-th best distance is certain but for vectors with a lower bound below it, and then those.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.llm import store

BITS = 6
#: Queries in a block, and vectors scanned at once.
QUERIES = 1024
BLOCK = 4096
#: Candidates, and queries, up to this many go to the executors whole; beyond, both sides are shuffled.
MAX_BROADCAST = 500_000


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", d: int | None = None) -> tuple[DataFrame, int]:
    """(id, v): one finite vector by id, of length ``d`` or the commonest length (of several such, the longest), and that length.

    Rows with a null id, a null vector, null, NaN or infinite elements, or another length are left out. Of rows that share
    an id the smallest vector counts.
    """
    v = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[vector_col].cast("array<float>").alias("v"))
    good = v.where(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    if d is None:
        sizes = good.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
        d = sizes[0]["d"] if sizes else 0
    return good.where(F.size("v") == d).groupBy("id").agg(F.min("v").alias("v")), d


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, d)


def grid(rows: DataFrame, d: int, bits: int = BITS) -> np.ndarray:
    """Cell edges by dimension (2**bits + 1 of them), from all vectors: the outermost are those of the data, the others lie evenly
    within three standard deviations of the mean."""

    def gather(batches):
        n, low, high, total, square = 0, np.full(d, np.inf), np.full(d, -np.inf), np.zeros(d), np.zeros(d)
        for b in batches:
            x = _matrix(b.column("v"), d).astype(np.float64)
            if len(x):
                n += len(x)
                low, high = np.minimum(low, x.min(0)), np.maximum(high, x.max(0))
                total, square = total + x.sum(0), square + (x * x).sum(0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d, dtype=np.int32)), pa.array(np.full(d, n)), *(pa.array(a) for a in (low, high, total, square))], ["d", "n", "low", "high", "total", "square"])

    t = rows.select("v").mapInArrow(gather, "d int, n long, low double, high double, total double, square double")
    t = t.groupBy("d").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("total").alias("total"), F.sum("square").alias("square")).toPandas().sort_values("d")
    mean = (t.total / t.n).to_numpy()
    spread = np.sqrt(np.maximum((t.square / t.n).to_numpy() - mean**2, 0))
    inner = mean[:, None] + spread[:, None] * np.linspace(-3, 3, 2**bits - 1)
    low, high = t.low.to_numpy()[:, None], t.high.to_numpy()[:, None]
    return np.concatenate([low, np.clip(inner, low, high), high], 1)


def cells(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The cell of each vector in each dimension."""
    return np.stack([np.searchsorted(edges[j, 1:-1], x[:, j], "right") for j in range(x.shape[1])], 1).astype(np.uint8)


class Grid:
    """The cells, moved and scaled so that single precision holds every coordinate."""

    def __init__(self, edges: np.ndarray):
        self.edges = edges
        self.center = edges.mean(1)
        self.scale = max(float(np.abs(edges - self.center[:, None]).max()), 1e-300)
        self.low, self.high = edges[:, :-1], edges[:, 1:]

    def middle(self, code: np.ndarray) -> np.ndarray:
        j = np.arange(len(self.edges))
        return (self.low[j, code] + self.high[j, code]) / 2

    def place(self, x: np.ndarray) -> np.ndarray:
        return (x - self.center) / self.scale


def _packed(code: np.ndarray, bits: int) -> np.ndarray:
    return np.packbits(np.unpackbits(code[:, :, None], axis=2)[:, :, 8 - bits :].reshape(len(code), -1), axis=1)


def _unpacked(raw: np.ndarray, d: int, bits: int) -> np.ndarray:
    return np.unpackbits(raw, axis=1)[:, : d * bits].reshape(len(raw), d, bits) @ (1 << np.arange(bits - 1, -1, -1, dtype=np.uint8))


class Search:
    """Candidates so far of a block of queries: (query, id, squared lower bound), scaled."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int, grid: Grid):
        self.ids, self.q, self.k, self.grid = ids, q.astype(np.float64), k, grid
        self.at = grid.place(self.q)
        self.norm = np.einsum("nd,nd->n", self.at, self.at)
        #: At least the k-th smallest distance of each query, from upper bounds.
        self.most = np.full(len(ids), np.inf)
        self.up = np.full((len(ids), k), np.inf)
        self.rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def scan(self, ids: np.ndarray, code: np.ndarray, off: np.ndarray) -> None:
        """Go through a block of approximations; ``off``: how far each vector is from the middle of its cells, scaled."""
        mid = self.grid.place(self.grid.middle(code))
        norm = np.einsum("nd,nd->n", mid, mid)
        square = self.norm[:, None] + norm[None] - 2 * (self.at.astype(np.float32) @ mid.astype(np.float32).T).astype(np.float64)
        # what single precision may be off by
        slack = 1e-6 * (len(self.grid.edges) + 8) * (self.norm[:, None] + norm[None]) + 1e-12
        low = np.maximum(np.sqrt(np.maximum(square - slack, 0)) - off[None], 0)
        # a row isn't its own neighbour
        low[self.ids[:, None] == ids[None]] = np.inf
        few = min(self.k, len(ids))
        near = np.argpartition(low, few - 1, axis=1)[:, :few]
        row = np.arange(len(self.ids))[:, None]
        up = np.sqrt(np.maximum(square[row, near] + slack[row, near], 0)) + off[near]
        up[np.isinf(low[row, near])] = np.inf
        self.up = np.sort(np.concatenate([self.up, up], 1), axis=1)[:, : self.k]
        self.most = self.up[:, -1] * (1 + 1e-9)
        who, at = np.nonzero((low <= self.most[:, None]) & np.isfinite(low))
        self.rows.append((who, ids[at], low[who, at]))
        if sum(len(r[0]) for r in self.rows) > 1 << 21:
            self.rows = [self.candidates()]

    def candidates(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        w, ids, bound = (np.concatenate([r[i] for r in self.rows]) if self.rows else np.zeros(0) for i in range(3))
        w = w.astype(np.int64)
        fine = bound <= self.most[w]
        return w[fine], ids[fine].astype(np.int64), bound[fine]


def candidates(rows: DataFrame, asked: DataFrame, grid_: Grid, k: int, bits: int = BITS, queries: int = QUERIES, block: int = BLOCK) -> DataFrame:
    """(q, id, low): for each query every vector that its approximation doesn't rule out, with its lower bound, scaled."""
    spark, d = rows.sparkSession, len(grid_.edges)

    def approximate(batches):
        for b in batches:
            for lo in range(0, b.num_rows, block):
                part = b.slice(lo, block)
                x = _matrix(part.column("v"), d).astype(np.float64)
                code = cells(x, grid_.edges)
                off = (x - grid_.middle(code)) / grid_.scale
                off = np.sqrt(np.einsum("nd,nd->n", off, off)) * (1 + 1e-6) + 1e-12
                yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()]) for a in (part.column("id").to_numpy(), _packed(code, bits), off)], ["ids", "code", "off"])

    def ask(batches):
        for b in batches:
            for lo in range(0, b.num_rows, queries):
                part = b.slice(lo, queries)
                yield pa.RecordBatch.from_arrays([pa.array([part.column("id").to_numpy().tobytes()]), pa.array([_matrix(part.column("v"), d).tobytes()])], ["q_ids", "q_x"])

    data = store.written(rows.mapInArrow(approximate, "ids binary, code binary, off binary"), "approximations")
    # as few blocks of queries as there can be
    several = asked.count()
    blocks = store.written(asked.repartition(max(1, -(-several // queries))).mapInArrow(ask, "q_ids binary, q_x binary"), "queries")

    def scan(batches):
        searches: dict[bytes, Search] = {}
        for b in batches:
            for r in range(b.num_rows):
                q_ids, q_x, ids, code, off = (b.column(c)[r].as_py() for c in ("q_ids", "q_x", "ids", "code", "off"))
                if q_ids not in searches:
                    searches[q_ids] = Search(np.frombuffer(q_ids, np.int64), np.frombuffer(q_x, np.float32).reshape(-1, d), k, grid_)
                ids = np.frombuffer(ids, np.int64)
                searches[q_ids].scan(ids, _unpacked(np.frombuffer(code, np.uint8).reshape(len(ids), -1), d, bits), np.frombuffer(off, np.float64))
        for s in searches.values():
            w, ids, bound = s.candidates()
            yield pa.RecordBatch.from_arrays([pa.array(s.ids[w]), pa.array(ids), pa.array(bound), pa.array(s.most[w])], ["q", "id", "low", "most"])

    cores = spark.sparkContext.defaultParallelism
    found = blocks.crossJoin(data.repartition(4 * cores)).mapInArrow(scan, "q long, id long, low double, most double")
    found = store.written(found, "candidates")
    # the smallest upper bound that any part of the scan had
    least = found.groupBy("q").agg(F.min("most").alias("most"))
    return found.drop("most").join(store.small(least, MAX_BROADCAST), "q").where(F.col("low") <= F.col("most")).select("q", "id", "low")


def read(pairs: DataFrame, rows: DataFrame, asked: DataFrame, d: int) -> DataFrame:
    """(q, id, distance): the exact distances of pairs (q, id)."""

    def measure(batches):
        for b in batches:
            diff = _matrix(b.column("v"), d).astype(np.float64) - _matrix(b.column("w"), d)
            yield pa.RecordBatch.from_arrays([b.column("q"), b.column("id"), pa.array(np.sqrt(np.einsum("nd,nd->n", diff, diff)))], ["q", "id", "distance"])

    with_query = pairs.select("q", "id").join(store.small(asked.select(F.col("id").alias("q"), F.col("v").alias("w")), MAX_BROADCAST // d), "q")
    return rows.join(store.small(with_query, MAX_BROADCAST // d), "id").select("q", "id", "v", "w").mapInArrow(measure, "q long, id long, distance double")


def top_k(vectors: DataFrame, k: int = 10, queries: DataFrame | None = None, id_col: str = "vec_id", vector_col: str = "embedding", bits: int = BITS) -> DataFrame:
    """(vec_id, rank, neighbor_id, distance): for every query its k nearest vectors by Euclidean distance, ties by id.

    ``queries`` is a table of the same columns, or None for all rows. Rows that ``usable`` leaves out are neither queries nor
    neighbours; a row isn't the neighbour of a query of its id. Fewer than k others give fewer rows; an empty table none.
    Extra columns are left out. Vectors may be as long and as large as single precision allows.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    rows, d = usable(vectors, id_col, vector_col)
    if not d:
        return vectors.sparkSession.createDataFrame([], "vec_id long, rank int, neighbor_id long, distance double")
    rows = store.written(rows, "vectors")
    asked = rows if queries is None else store.written(usable(queries, id_col, vector_col, d)[0], "asked")
    cut = Grid(grid(rows, d, bits))
    ordered = F.row_number().over(W.partitionBy("q").orderBy("low", "id"))
    found = store.written(candidates(rows, asked, cut, k, bits).withColumn("turn", ordered), "found")
    early = F.col("turn") <= 2 * k
    first = store.written(read(found.where(early), rows, asked, d), "first")
    rank = F.row_number().over(W.partitionBy("q").orderBy("distance", "id"))
    certain = first.withColumn("rank", rank).where(F.col("rank") == k).select("q", F.col("distance").alias("kth"))
    # a lower bound over the k-th best distance rules a vector out
    open_ = found.where(~early).join(store.small(certain, MAX_BROADCAST), "q").where(F.col("low") * cut.scale * (1 - 1e-9) <= F.col("kth"))
    both = first.union(read(open_, rows, asked, d))
    return both.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select(F.col("q").alias("vec_id"), "rank", F.col("id").alias("neighbor_id"), F.round("distance", 6).alias("distance"))
