"""Exact cosine search over vector columns ``vec_<field>``: alone, in batches, and as beams inside a traversal."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.errors import GraphError
from graphloom.functions.filters import Access
from graphloom.plans.specs import Boost, Near


def cosine_to(vector: Column, query: Column, size: Column | int) -> Column:
    """In double precision; null for a null, zero or wrongly sized vector."""
    product = F.aggregate(F.zip_with(vector, query, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda a, x: a + x)
    square = F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    length = F.aggregate(query, F.lit(0.0), lambda a, x: a + x * x)
    return F.when((F.size(vector) == size) & (square > 0), product / (F.sqrt(square) * F.sqrt(length)))


def cosine(vector: Column, query: Sequence[float]) -> Column:
    return cosine_to(vector, F.array(*(F.lit(float(x)) for x in query)), len(query))


def _sim(n: Near) -> str:
    return f"__sim_{n.field}"


def scored(df: DataFrame, near: Sequence[Near], access: Access, boost: Sequence[Boost] = (), partition: Sequence[str] = ()) -> DataFrame:
    """``df`` with ``similarity`` and each field's, for rows that count and pass all floors.

    ``boost`` ranges are over these rows, by ``partition`` if given.
    """
    for n in near:
        if f"vec_{n.field}" not in df.columns:
            raise GraphError(f"there is no vector field {n.field!r}")
        df = df.withColumn(_sim(n), cosine(F.col(f"vec_{n.field}"), n.query))
    keep = reduce(lambda a, b: a | b, (F.col(_sim(n)).isNotNull() for n in near))
    for n in near:
        if n.missing == "exclude":
            keep = keep & F.col(_sim(n)).isNotNull()
        if n.min_similarity is not None:
            keep = keep & (F.coalesce(F.col(_sim(n)), F.lit(0.0)) >= n.min_similarity)
    df = df.where(keep)
    score = reduce(lambda a, b: a + b, (F.lit(float(n.weight)) * F.coalesce(F.col(_sim(n)), F.lit(0.0)) for n in near))
    return _boosted(df.withColumn("similarity", score), boost, access, partition)


def _boosted(df: DataFrame, boost: Sequence[Boost], access: Access, partition: Sequence[str]) -> DataFrame:
    if not boost:
        return df
    for i, b in enumerate(boost):
        value = access.number(b.key) if isinstance(b.key, str) else b.key(access).cast("double")
        df = df.withColumn(f"__boost_{i}", F.coalesce(value, F.lit(float(b.default))))
    ranged = [i for i, b in enumerate(boost) if b.scale == "normalized"]
    if ranged:
        # a range over all candidates is one aggregate joined back, never a window over a single partition
        ends = [f(f"__boost_{i}").alias(f"__{n}_{i}") for i in ranged for n, f in (("low", F.min), ("high", F.max))]
        limits = df.groupBy(*partition).agg(*ends)
        df = df.join(limits, list(partition)) if partition else df.crossJoin(F.broadcast(limits))
        for i in ranged:
            low, high = F.col(f"__low_{i}"), F.col(f"__high_{i}")
            df = df.withColumn(f"__boost_{i}", F.when(high > low, (F.col(f"__boost_{i}") - low) / (high - low)).otherwise(0.0)).drop(f"__low_{i}", f"__high_{i}")
    terms = [F.col(f"__boost_{i}") * float(b.weight) for i, b in enumerate(boost)]
    return df.withColumn("similarity", F.col("similarity") + reduce(lambda a, b: a + b, terms))


def best(df: DataFrame, k: int | None, partition: Sequence[str] = (), id_col: str = "id") -> DataFrame:
    """The k rows of the highest similarity, ties by id; with ``partition`` of each group."""
    if k is None:
        return df
    if not partition:
        return df.orderBy(F.desc("similarity"), id_col).limit(k)
    rank = F.row_number().over(W.partitionBy(*partition).orderBy(F.desc("similarity"), id_col))
    return df.withColumn("__rank", rank).where(F.col("__rank") <= k).drop("__rank")


def check_k(near: Sequence[Near], k: int | None) -> None:
    if not near:
        raise GraphError("a vector search needs at least one Near")
    if k is None and all(n.min_similarity is None for n in near):
        raise GraphError("k=None needs a min_similarity")
    if k is not None and (isinstance(k, bool) or not isinstance(k, int) or k < 1):
        raise GraphError("k must be a positive integer")


def report(df: DataFrame, near: Sequence[Near], boost: Sequence[Boost]) -> list[Column]:
    """Columns of a hit: the score, each field's similarity, and each boost's term."""
    sims = F.create_map(*(x for n in near for x in (F.lit(n.field), F.col(_sim(n)))))
    out = [F.col("similarity"), sims.alias("similarities")]
    if boost:
        names = dict.fromkeys(b.name for b in boost)
        out.append(F.create_map(*(x for name in names for x in (F.lit(name), reduce(lambda a, b: a + b, (F.col(f"__boost_{i}") * float(b.weight) for i, b in enumerate(boost) if b.name == name))))).alias("boosts"))
    return out


def many(df: DataFrame, queries: Sequence[Sequence[Near]], k: int | None, access: Access) -> DataFrame:
    """(query, id, similarity): the hits of each query; all queries have the same fields, weights, floors and missing rules.

    The queries travel as a small table, as long as the request itself.
    """
    shape = [[(n.field, n.weight, n.min_similarity, n.missing) for n in q] for q in queries]
    if not queries or any(s != shape[0] for s in shape):
        raise GraphError("all queries of a batch need the same fields, weights, floors and missing rules")
    first = queries[0]
    check_k(first, k)
    rows = [(i, *([float(x) for x in n.query] for n in q)) for i, q in enumerate(queries)]
    asked = df.sparkSession.createDataFrame(rows, "query int, " + ", ".join(f"__q_{n.field} array<double>" for n in first))
    df = df.crossJoin(F.broadcast(asked))
    keep = F.lit(False)
    for n in first:
        df = df.withColumn(_sim(n), cosine_to(F.col(f"vec_{n.field}"), F.col(f"__q_{n.field}"), F.size(f"__q_{n.field}")))
        keep = keep | F.col(_sim(n)).isNotNull()
    for n in first:
        if n.missing == "exclude":
            keep = keep & F.col(_sim(n)).isNotNull()
        if n.min_similarity is not None:
            keep = keep & (F.coalesce(F.col(_sim(n)), F.lit(0.0)) >= n.min_similarity)
    score = reduce(lambda a, b: a + b, (F.lit(float(n.weight)) * F.coalesce(F.col(_sim(n)), F.lit(0.0)) for n in first))
    hits = best(df.where(keep).withColumn("similarity", score), k, ["query"])
    return hits.select("query", "id", "similarity")
