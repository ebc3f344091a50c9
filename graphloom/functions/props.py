"""Access to the properties of nodes and edges, whichever way they are stored.

``BagAccess`` reads a VARIANT column; ``TypedAccess`` reads ordinary columns, of which a null one counts as a missing key.
Every operator is written once against this interface.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.errors import GraphError

JSON_TYPES = ("string", "number", "boolean", "object", "array", "null")
_FALSE = F.lit


def false() -> Column:
    return F.lit(False)


class TypedAccess:
    """Properties are columns."""

    def __init__(self, df: DataFrame, reserved: Iterable[str]):
        self.reserved = {*reserved}
        self.types = {f.name: f.dataType for f in df.schema.fields if f.name not in self.reserved and not f.name.startswith("vec_")}

    def keys(self) -> list[str]:
        return list(self.types)

    def raw(self, key: str) -> Column:
        return F.col(f"`{key}`") if key in self.types else F.lit(None)

    def _kind(self, key: str) -> str | None:
        t = self.types.get(key)
        if t is None:
            return None
        if isinstance(t, T.BooleanType):
            return "boolean"
        if isinstance(t, T.NumericType):
            return "number"
        if isinstance(t, T.ArrayType):
            return "array"
        return "object" if isinstance(t, T.StructType | T.MapType) else "string"

    def text(self, key: str) -> Column:
        if self._kind(key) in ("array", "object"):
            return F.to_json(self.raw(key))
        return self.raw(key).cast("string")

    def json_type(self, key: str) -> Column:
        return F.when(self.raw(key).isNotNull(), F.lit(self._kind(key))) if key in self.types else F.lit(None).cast("string")

    def number(self, key: str) -> Column:
        return self.raw(key).cast("double") if self._kind(key) == "number" else F.lit(None).cast("double")

    def numeric_text(self, key: str) -> Column:
        if self._kind(key) == "number":
            return self.raw(key).cast("double")
        return self.text(key).try_cast("double") if key in self.types else F.lit(None).cast("double")

    def has(self, key: str) -> Column:
        return self.raw(key).isNotNull() if key in self.types else false()

    def equals(self, key: str, value: object) -> Column:
        """Containment of one key: false, never null, for a missing one."""
        kind = self._kind(key)
        if kind is None or value is None:
            return false()
        if isinstance(value, bool):
            ok = kind == "boolean"
        elif isinstance(value, int | float):
            ok = kind == "number"
        elif isinstance(value, str):
            ok = kind == "string"
        elif isinstance(value, dict):
            if kind != "object":
                return false()
            out = self.raw(key).isNotNull()
            for k, v in value.items():
                out = out & F.coalesce(self.raw(key).getField(k) == F.lit(v), false())
            return out
        else:
            if kind != "array":
                return false()
            out = self.raw(key).isNotNull()
            for v in value:
                out = out & F.coalesce(F.array_contains(self.raw(key), v), false())
            return out
        column = self.raw(key)
        if isinstance(value, str) and not isinstance(self.types[key], T.StringType):
            column = column.cast("string")
        # a plain comparison is what reaches the Parquet scan; null counts as false all the same
        return F.coalesce(column == F.lit(value), false()) if ok else false()

    def pushable(self, key: str, value: object) -> Column | None:
        """The comparison without its null guard, for use at the top of a conjunction, where null is as good as false."""
        kind = self._kind(key)
        if isinstance(value, bool) and kind == "boolean" or isinstance(value, str) and isinstance(self.types.get(key), T.StringType):
            return self.raw(key) == F.lit(value)
        if isinstance(value, int | float) and not isinstance(value, bool) and kind == "number":
            return self.raw(key) == F.lit(value)
        return None


class BagAccess:
    """Properties are one VARIANT column."""

    def __init__(self, column: str = "properties"):
        self.column = F.col(column)

    def path(self, key: str) -> str:
        if '"' in key or "\\" in key:
            raise GraphError(f"a property key can't have quotes or backslashes: {key!r}")
        return f'$["{key}"]'

    def raw(self, key: str) -> Column:
        return F.variant_get(self.column, self.path(key), "variant")

    def text(self, key: str) -> Column:
        return F.try_variant_get(self.column, self.path(key), "string")

    def json_type(self, key: str) -> Column:
        return json_type(self.raw(key))

    def number(self, key: str) -> Column:
        return F.when(self.json_type(key) == "number", F.try_variant_get(self.column, self.path(key), "double"))

    def numeric_text(self, key: str) -> Column:
        return self.text(key).try_cast("double")

    def has(self, key: str) -> Column:
        return self.raw(key).isNotNull()

    def equals(self, key: str, value: object) -> Column:
        return F.coalesce(variant_contains(self.column, self.path(key), value), false())

    def pushable(self, key: str, value: object) -> Column | None:
        return None


def json_type(variant: Column) -> Column:
    """The JSON type of a variant; null where there is none."""
    kind = F.schema_of_variant(variant)
    return (
        F.when(variant.isNull(), F.lit(None))
        .when(kind.isin("STRING", "DATE", "TIMESTAMP", "TIMESTAMP_NTZ", "BINARY"), "string")
        .when(kind == "BOOLEAN", "boolean")
        .when(kind == "VOID", "null")
        .when(kind.startswith("OBJECT"), "object")
        .when(kind.startswith("ARRAY"), "array")
        .otherwise("number")
    )


def variant_contains(column: Column, path: str, value: object) -> Column:
    """Whether the variant at a path contains a JSON value: numbers by value, objects and arrays by what they have."""
    at = F.variant_get(column, path, "variant")
    kind = json_type(at)
    if value is None:
        return kind == "null"
    if isinstance(value, bool):
        return (kind == "boolean") & (F.try_variant_get(column, path, "boolean") == F.lit(value))
    if isinstance(value, int | float):
        return (kind == "number") & (F.try_variant_get(column, path, "double") == F.lit(float(value)))
    if isinstance(value, str):
        return (kind == "string") & (F.try_variant_get(column, path, "string") == F.lit(value))
    if isinstance(value, dict):
        out = kind == "object"
        for k, v in value.items():
            if '"' in k or "\\" in k:
                raise GraphError(f"a property key can't have quotes or backslashes: {k!r}")
            out = out & F.coalesce(variant_contains(column, f'{path}["{k}"]', v), false())
        return out
    items = F.try_variant_get(column, path, "array<variant>")
    out = kind == "array"
    for v in value:
        out = out & F.coalesce(F.exists(items, lambda x, v=v: F.coalesce(variant_contains(x, "$", v), false())), false())
    return out


def bag(value: dict) -> Column:
    """A literal property bag."""
    return F.parse_json(F.lit(json.dumps(value)))
