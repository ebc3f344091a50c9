"""Names, descriptions and schemas of graphs, as a small table beside their data; and nodes and edges from CSV files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.errors import GraphError
from graphloom.operators import lineage
from graphloom.operators.schema import GraphSchema

_SCHEMA = "name string, description string, extra string, schema string"


class Registry:
    """A folder with one row for each graph. Few rows, written by one application at a time."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.path = spark, f"{folder.rstrip('/')}/graphs.json"

    def _rows(self) -> dict[str, dict]:
        fs, p = lineage._file_system(self.spark, self.path)
        if not fs.exists(p):
            return {}
        return {r["name"]: r.asDict() for r in self.spark.read.schema(_SCHEMA).json(self.path).collect()}

    def _save(self, rows: dict[str, dict]) -> None:
        # a new folder, then the name: a reader sees all of the old rows or all of the new ones
        fs, p = lineage._file_system(self.spark, self.path)
        new = f"{self.path}.new"
        self.spark.createDataFrame([tuple(r[k] for k in ("name", "description", "extra", "schema")) for r in rows.values()], _SCHEMA).coalesce(1).write.mode("overwrite").json(new)
        fs.delete(p, True)
        if not fs.rename(lineage._file_system(self.spark, new)[1], p):
            raise GraphError(f"{self.path} can't be written")

    def create_graph(self, name: str, description: str = "", **extra) -> dict:
        """Name a graph, or describe one anew; its schema stays."""
        if not isinstance(name, str) or not name:
            raise GraphError("a graph needs a name")
        rows = self._rows()
        rows[name] = {"name": name, "description": description, "extra": json.dumps(extra), "schema": rows.get(name, {}).get("schema")}
        self._save(rows)
        return self.graph_info(name)

    def graph_info(self, name: str) -> dict | None:
        r = self._rows().get(name)
        return r and {"name": name, "description": r["description"], **json.loads(r["extra"] or "{}")}

    def graphs(self) -> list[str]:
        return sorted(self._rows())

    def save_schema(self, name: str, schema: GraphSchema) -> None:
        rows = self._rows()
        rows[name] = rows.get(name, {"name": name, "description": "", "extra": "{}"}) | {"schema": schema.document()}
        self._save(rows)

    def load_schema(self, name: str) -> GraphSchema | None:
        """The schema that was saved, checked as it is read."""
        r = self._rows().get(name)
        return GraphSchema.from_document(r["schema"]) if r and r["schema"] else None


def from_csv(spark: SparkSession, nodes: str, edges: str, node_schema: str, edge_schema: str, header: bool = True, bags: bool = False, **options) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of CSV files with the given columns; a row that doesn't fit them is an error.

    With ``bags`` a column ``properties`` of JSON becomes a bag.
    """
    read = lambda path, schema: spark.read.csv(path, schema=schema, header=header, mode="FAILFAST", escape='"', multiLine=bags, **options)
    out = read(nodes, node_schema), read(edges, edge_schema)
    return tuple(t.withColumn("properties", F.parse_json("properties")) for t in out) if bags else out
