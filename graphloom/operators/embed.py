"""Filling vector columns with what an embedder makes of a text property."""

from __future__ import annotations

import dataclasses
import random
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import functions as F

from graphloom.errors import GraphError


#: Answers of a server after which asking again makes sense.
RETRY_STATUS = {408, 409, 429, *range(500, 600)}
#: The longest that a server's Retry-After is heeded, in seconds.
MAX_WAIT = 120.0


def client_of(client: object, model: str | None = None, query: bool = False) -> Callable[[list[str]], Sequence]:
    """A function of texts for the usual shapes of embedding clients, by the methods that they have.

    With ``query``, the texts are questions, for clients that treat these differently.
    """
    if query and hasattr(client, "embed_query"):
        return lambda texts: [client.embed_query(t) for t in texts]
    for name in ("embed_documents", "get_text_embedding_batch", "encode"):
        if hasattr(client, name):
            return getattr(client, name)
    if hasattr(client, "embeddings") and hasattr(client.embeddings, "create"):

        def create(texts):
            got = client.embeddings.create(model=model, input=texts).data
            return [x.embedding for x in sorted(got, key=lambda x: x.index)]

        return create
    if hasattr(client, "embed"):
        return lambda texts: client.embed(texts, model=model).embeddings
    if callable(client):
        return client
    raise GraphError("this client has no method that embeds texts")


def _pause(error: Exception, attempt: int, backoff: float) -> float | None:
    """Seconds to wait after a failure; None where trying again is no use."""
    status = getattr(error, "status_code", getattr(error, "status", getattr(error, "code", None)))
    if not isinstance(error, ConnectionError | TimeoutError) and status not in RETRY_STATUS:
        return None
    headers = getattr(getattr(error, "response", error), "headers", None) or {}
    try:
        return min(max(float(headers.get("Retry-After", headers.get("retry-after"))), 0.0), MAX_WAIT)
    except (TypeError, ValueError):
        return random.uniform(0, backoff * 2**attempt)


@dataclass(frozen=True)
class Embedder:
    """``client(texts)`` gives one vector for each text; failures are tried again with growing, random pauses, or as the server asks.

    ``client`` may be an object of one of the shapes that ``client_of`` knows.
    """

    client: Callable[[list[str]], Sequence[Sequence[float]]] | object
    dimensions: int
    batch_size: int = 100
    retries: int = 2
    backoff: float = 0.5
    model: str | None = None

    def __call__(self, texts: list[str], query: bool = False) -> list[list[float]]:
        out: list[list[float]] = []
        embed = client_of(self.client, self.model, query)
        for i in range(0, len(texts), self.batch_size):
            part = texts[i : i + self.batch_size]
            for attempt in range(self.retries + 1):
                try:
                    got = [list(map(float, v)) for v in embed(part)]
                    break
                except Exception as e:
                    wait = _pause(e, attempt, self.backoff)
                    if wait is None or attempt == self.retries:
                        raise
                    time.sleep(wait)
            if len(got) != len(part) or any(len(v) != self.dimensions for v in got):
                raise GraphError(f"the embedder must give {len(part)} vectors of {self.dimensions} numbers")
            out += got
        return out


def stale_counts(g, name: str, source: str, dimensions: int) -> tuple[int, int]:
    """How many nodes ``embed_stale`` would embed, and how many it would leave as they have no text."""
    column = F.col(f"vec_{name}") if f"vec_{name}" in g.nodes_table.columns else F.lit(None).cast("array<float>")
    text = F.when(g.node_access.json_type(source) == "string", F.trim(g.node_access.text(source)))
    has = F.coalesce(text != "", F.lit(False))
    r = g.nodes.where(column.isNull() | (F.size(column) != dimensions)).agg(F.count_if(has).alias("a"), F.count_if(~has).alias("b")).first()
    return r["a"], r["b"]


def embed_stale(g, name: str, source: str, embedder: Embedder):
    """A graph whose nodes without a vector of the right length have one made of their text; blank texts are left.

    The embedder runs on the executors, over batches of rows.
    """
    column = f"vec_{name}"
    nodes = g.nodes_table if column in g.nodes_table.columns else g.nodes_table.withColumn(column, F.lit(None).cast("array<float>"))
    g = dataclasses.replace(g, nodes_table=nodes)
    text = F.when(g.node_access.json_type(source) == "string", F.trim(g.node_access.text(source)))
    stale = g.nodes.where(F.col(column).isNull() | (F.size(column) != embedder.dimensions)).select("id", text.alias("t")).where("t <> ''")

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(embedder(b.column("t").to_pylist()), pa.list_(pa.float32()))], ["id", "__new"])

    made = stale.mapInArrow(run, "id long, __new array<float>")
    out = nodes.join(made, "id", "left").withColumn(column, F.coalesce("__new", column)).select(*nodes.columns)
    return dataclasses.replace(g, nodes_table=out)
