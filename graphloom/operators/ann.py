"""An approximate index over one vector field, completed exactly where it finds too little.

Vectors are hashed by the side of random planes that they lie on, in several tables. A search looks only at rows that share a
bucket with the query in some table, or one that differs in a single plane. Where fewer than k rows come of that, after filters, the
search is done again over all rows: a filter never makes a result short.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.errors import GraphError
from graphloom.functions import filters
from graphloom.operators import lineage, similarity
from graphloom.plans.specs import Near


@dataclass(frozen=True)
class PlaneIndex:
    """(id, buckets) of a field's rows, and the planes that made them."""

    field: str
    target: str
    rows: DataFrame
    planes: np.ndarray  # tables x planes x dimensions

    @classmethod
    def build(cls, g, field: str, dimensions: int, target: str = "nodes", tables: int = 8, planes: int = 10, seed: int = 1) -> PlaneIndex:
        """Every row with a vector of the right length is in the index; the others are in no search either."""
        if tables < 1 or not 1 <= planes <= 30:
            raise GraphError("an index has at least one table, and 1 to 30 planes in each")
        normal = np.random.default_rng(seed).normal(size=(tables, planes, dimensions)).astype(np.float32)
        shared = g.spark.sparkContext.broadcast(normal)
        table, _ = g._target(target)
        v = f"vec_{field}"
        if v not in table.columns:
            raise GraphError(f"there is no vector field {field!r}")

        def hashed(batches):
            for b in batches:
                x = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(list(buckets(x, shared.value)), pa.list_(pa.int64()))], ["id", "buckets"])

        rows = table.where(F.size(v) == dimensions).select(F.col("id").cast("long").alias("id"), F.col(v).cast("array<float>").alias("v"))
        return cls(field, target, lineage.cut(rows.mapInArrow(hashed, "id long, buckets array<long>")), normal)

    def probes(self, query: Sequence[float]) -> list[int]:
        """The query's bucket in each table, and those one plane away."""
        own = buckets(np.asarray(query, np.float32)[None], self.planes)[0]
        return sorted({int(b) ^ (1 << i) if i >= 0 else int(b) for b in own for i in range(-1, self.planes.shape[1])})

    def search(self, g, near: Near, k: int = 10, where: object = None) -> DataFrame:
        """(id, similarity): the k best of the rows that the index comes up with; of all rows where those are fewer than k."""
        (near,) = g._with_vectors([near], self.target)
        if near.field != self.field or near.weight <= 0:
            raise GraphError(f"this index is of {self.field!r}, for conditions of positive weight")
        similarity.check_k([near], k)
        rows, access = g._target(self.target)
        rows = rows.where((filters.compile_filter if self.target == "nodes" else filters.compile_via)(where, access))
        few = self.rows.where(F.arrays_overlap("buckets", F.array(*(F.lit(p).cast("long") for p in self.probes(near.query))))).select("id")
        found = lineage.cut(similarity.best(similarity.scored(rows.join(few, "id", "left_semi"), [near], access), k).select("id", "similarity"))
        if found.count() < k:
            found = similarity.best(similarity.scored(rows, [near], access), k).select("id", "similarity")
        return found


def buckets(x: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """By row and table: the sides of the planes as bits, and the table's number above them."""
    side = np.einsum("nd,tpd->ntp", x, planes) > 0
    several = planes.shape[1]
    return side @ (1 << np.arange(several, dtype=np.int64)) + (np.arange(len(planes), dtype=np.int64) << several)
