"""networkx graphs, where that library is there."""

from __future__ import annotations

from graphloom.operators import mutate


def add_networkx(g, network) -> mutate.Change:
    """The nodes and edges of a networkx graph with integer nodes, with their attributes."""
    nodes = mutate.add_nodes(g, [{"id": int(n), **a} for n, a in network.nodes(data=True)])
    edges = mutate.add_edges(nodes.graph, [{"start_id": int(a), "end_id": int(b), **d} for a, b, d in network.edges(data=True)])
    return mutate.Change(edges.graph, nodes.nodes, edges.edges)
