"""Kernels. PageRank is the flagship; the others are extensions in the same published model of delta-based accumulative computation."""

from __future__ import annotations

from pyspark.sql import functions as F

from deltarill.plans.kernel import Kernel

INF = float("inf")


def _plus(a, b):
    return a + b


def pagerank(damping: float = 0.8) -> Kernel:
    """Unnormalised scores: they sum to the number of vertices where there are no sinks."""
    return Kernel(
        "pagerank", lambda i: F.lit(0.0), lambda i: F.lit(1.0 - damping if damping != 0.8 else 0.2), 0.0, F.sum, _plus,
        lambda delta, value, degree, weight: delta * F.lit(damping) / degree,
    )


def shortest_paths(source: int) -> Kernel:
    return Kernel(
        "shortest_paths", lambda i: F.lit(INF), lambda i: F.when(i == source, 0.0).otherwise(INF), INF, F.min, F.least,
        lambda delta, value, degree, weight: delta + weight, lambda value, delta: -delta, improves=True,
    )


def connected_components() -> Kernel:
    """The largest id of the component; edges must go both ways."""
    return Kernel(
        "connected_components", lambda i: F.lit(-INF), lambda i: i.cast("double"), -INF, F.max, F.greatest,
        lambda delta, value, degree, weight: delta, improves=True,
    )


def katz(source: int, beta: float) -> Kernel:
    return Kernel(
        "katz", lambda i: F.lit(0.0), lambda i: F.when(i == source, 1.0).otherwise(0.0), 0.0, F.sum, _plus,
        lambda delta, value, degree, weight: F.lit(beta) * weight * delta,
    )


#: by name
REGISTRY = {"pagerank": pagerank, "shortest_paths": shortest_paths, "connected_components": connected_components, "katz": katz}
