"""An extension: a stream of edges taken into a saved graph, batch by batch, each a new version."""

from __future__ import annotations

from pyspark.sql import DataFrame

from graphloom.sources import snapshots


def ingest_edges(stream: DataFrame, folder: str, checkpoint: str):
    """Starts a query that appends (id, start_id, end_id, ...) rows to the graph in ``folder``.

    An edge whose id is there already is left out, so a batch that is run again after a failure changes nothing.
    """

    def add(batch: DataFrame, _: int) -> None:
        g = snapshots.load(batch.sparkSession, folder)
        new = batch.dropDuplicates(["id"]).join(g.edges_table.select("id"), "id", "left_anti")
        g.edges_table = g.edges_table.unionByName(new, allowMissingColumns=True)
        snapshots.save(g, folder)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
