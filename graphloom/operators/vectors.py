"""The life of vector fields: declared, given columns, filled, emptied.

A field ``x`` is the column ``vec_x`` of the nodes or edges. The registry belongs to the graph's handle; what is written gives a new
graph, as every other write does.
"""

from __future__ import annotations

import dataclasses
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.errors import GraphError
from graphloom.operators.mutate import Change

_NAME = re.compile(r"[a-z][a-z0-9_]{0,58}")
_TARGETS = ("nodes", "edges")


@dataclass(frozen=True)
class Vector:
    """A field of vectors of one length. ``embed`` makes vectors of texts, those of the property ``source`` if it is told to."""

    name: str
    dimensions: int
    embed: Callable[[list[str]], Sequence[Sequence[float]]] | None = None
    source: str | None = None

    def __post_init__(self):
        if not isinstance(self.name, str) or not _NAME.fullmatch(self.name):
            raise GraphError(f"a field's name is lower-case letters, digits and underscores, 59 at most, not {self.name!r}")
        if isinstance(self.dimensions, bool) or not isinstance(self.dimensions, int) or self.dimensions < 1:
            raise GraphError("dimensions is a positive integer")
        if self.embed is not None and not callable(self.embed):
            raise GraphError("embed is a function of a list of texts")
        object.__setattr__(self, "source", self.source or self.name)

    @property
    def column(self) -> str:
        return f"vec_{self.name}"

    def of_text(self, texts: list[str]) -> list[list[float]]:
        if self.embed is None:
            raise GraphError(f"{self.name!r} has no embedder for texts")
        out = [list(map(float, v)) for v in self.embed(texts)]
        if len(out) != len(texts) or any(len(v) != self.dimensions for v in out):
            raise GraphError(f"the embedder of {self.name!r} must give {len(texts)} vectors of {self.dimensions} numbers")
        return out


def _table(g, target: str) -> DataFrame:
    return g.nodes_table if target == "nodes" else g.edges_table


def _with(g, target: str, table: DataFrame):
    return dataclasses.replace(g, **{f"{target}_table": table})


def define_vectors(g, nodes: Sequence[Vector] = (), edges: Sequence[Vector] = (), migrate: bool = False):
    """``g`` with fields declared; one declared again is replaced. With ``migrate`` the columns are made at once."""
    registry = {t: dict(g.vectors.get(t, {})) for t in _TARGETS}
    for target, fields in (("nodes", nodes), ("edges", edges)):
        names = [v.name for v in fields]
        if len(set(names)) < len(names):
            raise GraphError("a field is declared twice")
        registry[target] |= {v.name: v for v in fields}
    out = dataclasses.replace(g, vectors=registry)
    return migrate_vectors(out) if migrate else out


def _sizes(g, target: str, columns: Sequence[str]) -> dict[str, tuple[int | None, int | None]]:
    """The shortest and longest vector of each column, in this graph; one pass."""
    rows = g.nodes if target == "nodes" else g.edges
    if not columns:
        return {}
    r = rows.agg(*(f(F.size(F.when(F.col(c).isNotNull(), F.col(c)))).alias(f"{n}{c}") for c in columns for n, f in (("a", F.min), ("z", F.max)))).first()
    return {c: (r[f"a{c}"] if (r[f"a{c}"] or 0) >= 0 else None, r[f"z{c}"] if (r[f"z{c}"] or 0) >= 0 else None) for c in columns}


def _is_vector(t: T.DataType) -> bool:
    return isinstance(t, T.ArrayType) and isinstance(t.elementType, T.FloatType | T.DoubleType)


def migrate_vectors(g):
    """``g`` with a column for every declared field. Columns that are there already must hold vectors of the declared length."""
    for target in _TARGETS:
        table, fields = _table(g, target), g.vectors.get(target, {})
        there = [v for v in fields.values() if v.column in table.columns]
        for v in there:
            if not _is_vector(table.schema[v.column].dataType):
                raise GraphError(f"{v.column} is {table.schema[v.column].dataType.simpleString()}, not an array of numbers")
        sizes = _sizes(g, target, [v.column for v in there])
        for v in there:
            if any(n not in (None, v.dimensions) for n in sizes[v.column]):
                raise GraphError(f"{v.column} holds vectors of {sizes[v.column]} numbers, declared are {v.dimensions}")
        new = {v.column: F.lit(None).cast("array<float>") for v in fields.values() if v.column not in table.columns}
        if new:
            g = _with(g, target, table.withColumns(new))
    return g


def load_vectors(g):
    """``g`` with the fields that its columns show declared, their lengths read off the rows; embedders that are known stay."""
    registry = {t: dict(g.vectors.get(t, {})) for t in _TARGETS}
    for target in _TARGETS:
        table = _table(g, target)
        columns = [f.name for f in table.schema.fields if f.name.startswith("vec_") and _is_vector(f.dataType)]
        for c, (low, high) in _sizes(g, target, columns).items():
            if low != high:
                raise GraphError(f"{c} holds vectors of {low} to {high} numbers")
            if low:
                old = registry[target].get(c[4:])
                registry[target][c[4:]] = Vector(c[4:], low, old.embed if old else None, old.source if old else None)
    return dataclasses.replace(g, vectors=registry)


def drop_vectors(g, *names: str, target: str = "nodes"):
    """``g`` with these fields empty, in this graph only; without names, all of them. The declarations stay."""
    if target not in _TARGETS:
        raise GraphError("target is 'nodes' or 'edges'")
    table, fields = _table(g, target), g.vectors.get(target, {})
    for n in names:
        if n not in fields:
            raise GraphError(f"there is no vector field {n!r}")
    own = (F.col(g.graph_col) == g.name) if g.graph_col else F.lit(True)
    columns = [fields[n].column for n in names or fields if fields[n].column in table.columns]
    return _with(g, target, table.withColumns({c: F.when(~own, F.col(c)) for c in columns}))


def _frame(g, target: str, rows: Sequence[dict]) -> DataFrame:
    """Rows that came as dictionaries, texts embedded in one call for each field."""
    fields = g.vectors.get(target, {})
    table = _table(g, target)
    names = list(dict.fromkeys(k for r in rows for k in r if k != "id"))
    values: dict[str, list] = {}
    for n in names:
        if n not in fields:
            raise GraphError(f"there is no vector field {n!r}")
        own = [r.get(n) for r in rows]
        texts = [i for i, v in enumerate(own) if isinstance(v, str)]
        if texts:
            for i, v in zip(texts, fields[n].of_text([own[i] for i in texts])):
                own[i] = v
        values[n] = [None if v is None else list(map(float, v)) for v in own]
    kind = table.schema["id"].dataType.simpleString()
    schema = f"id {kind}" + "".join(f", `{n}` array<float>, `__has_{n}` boolean" for n in names)
    return g.spark.createDataFrame([(r.get("id"), *(x for n in names for x in (values[n][i], n in r))) for i, r in enumerate(rows)], schema)


def _embedded(rows: DataFrame, v: Vector) -> DataFrame:
    """A column of texts made vectors on the executors, in batches."""
    schema = T.StructType([f if f.name != v.name else T.StructField(v.name, T.ArrayType(T.FloatType())) for f in rows.schema.fields])
    at = rows.columns.index(v.name)

    def run(batches):
        for b in batches:
            texts = b.column(at).to_pylist()
            some = [t for t in texts if t is not None]
            got = iter(v.of_text(some) if some else [])
            column = pa.array([None if t is None else next(got) for t in texts], pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([column if i == at else c for i, c in enumerate(b.columns)], rows.columns)

    return rows.mapInArrow(run, schema)


def _set(g, target: str, rows: Sequence[dict] | DataFrame) -> tuple[object, int]:
    fields, table = g.vectors.get(target, {}), _table(g, target)
    if not isinstance(rows, DataFrame):
        if not rows:
            return g, 0
        if any("id" not in r or r["id"] is None for r in rows):
            raise GraphError("every row needs an id")
        new = _frame(g, target, rows)
        names = [c for c in new.columns if c != "id" and not c.startswith("__has_")]
    else:
        names = [c for c in rows.columns if c != "id"]
        unknown = [n for n in names if n not in fields]
        if "id" not in rows.columns or unknown:
            raise GraphError(f"there is no vector field {unknown[0]!r}" if unknown else "the rows need an id column")
        new = rows
        for n in names:
            if isinstance(rows.schema[n].dataType, T.StringType):
                new = _embedded(new, fields[n])
        new = new.withColumns({f"__has_{n}": F.lit(True) for n in names})
    missing = [n for n in names if fields[n].column not in table.columns]
    if missing:
        raise GraphError(f"{missing[0]!r} has no column yet: migrate_vectors makes it")
    own = g.nodes if target == "nodes" else g.edges
    wrong = [F.col(n).isNotNull() & ((F.size(n) != fields[n].dimensions) | F.exists(n, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))) for n in names]
    bad = F.lit(False)
    for w in wrong:
        bad = bad | w
    there = own.select("id", F.lit(True).alias("__there"))
    seen = new.join(there, "id", "left").groupBy("id").agg(F.count("*").alias("n"), F.max(bad).alias("wrong"), F.max("__there").alias("there"))
    fault = seen.where("n > 1 or wrong or there is null").limit(1).collect()
    if fault:
        f = fault[0]
        raise GraphError(f"row {f['id']}: " + ("it comes twice" if f["n"] > 1 else "its vector has another length, or numbers that aren't finite" if f["wrong"] else f"there is no such id among the {target}"))
    scope = (F.col(g.graph_col) == g.name) if g.graph_col else F.lit(True)
    fresh = new.select("id", *(F.col(n).alias(f"__new_{n}") for n in names), *(f"__has_{n}" for n in names))
    joined = table.join(fresh, "id", "left")
    values = {fields[n].column: F.when(scope & F.coalesce(f"__has_{n}", F.lit(False)), F.col(f"__new_{n}").cast(table.schema[fields[n].column].dataType)).otherwise(F.col(fields[n].column)) for n in names}
    return _with(g, target, joined.withColumns(values).select(*table.columns)), seen.count()


def set_vectors(g, nodes: Sequence[dict] | DataFrame = (), edges: Sequence[dict] | DataFrame = ()) -> Change:
    """Rows (id, field, ...) of vectors, texts to embed, or nulls; a field that a dictionary lacks stays as it is.

    All or nothing: an id that comes twice or isn't there, an unknown field, or a vector of another length is refused.
    """
    g, n = _set(g, "nodes", nodes)
    g, e = _set(g, "edges", edges)
    return Change(g, n, e)
