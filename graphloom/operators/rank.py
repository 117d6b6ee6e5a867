"""The nine rankings behind one name each."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..graph import Graph
from . import centrality as c
from . import closure, measures
from .project import projection

METRICS = {
    "fan_in": measures.fan_in, "fan_out": measures.fan_out, "complexity": measures.complexity, "blast_radius": closure.blast_sizes,
    **{k: (lambda g, f=getattr(c, k): f(projection(g))) for k in ("pagerank", "betweenness", "closeness", "eigenvector", "katz")},
}


@dataclass(frozen=True)
class Answer:
    metric: str
    measured: bool
    total: int
    rows: DataFrame | None
    reason: str = ""


def rank(g: Graph, metric: str) -> DataFrame | None:
    """(id, value), or None where the metric cannot be measured on this graph."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric: {metric}")
    return METRICS[metric](g)


def rank_answer(g: Graph, metric: str, limit: int = measures.LIMIT) -> Answer:
    """The top rows, and the total before they were cut."""
    got = rank(g, metric)
    if got is None:
        return Answer(metric, False, 0, None, "did not settle, or more nodes than it is offered for")
    got = got.cache()
    return Answer(metric, True, got.count(), measures.top(got, limit))
