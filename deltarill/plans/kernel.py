"""What a computation is: a kernel of column expressions.

A vertex holds a value and a pending delta. A round adds the delta to the value, sends messages along the edges, resets the
delta to the identity and combines what arrives into the next delta.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Kernel:
    """
    init_value, init_delta: from the vertex id, and from columns of the vertex data given to ``superstep.initial``.
    identity: the neutral element of ``combine``; a delta that equals it is not pending.
    agg, combine: the same commutative and associative operation as an aggregate and between two columns.
    message: from (delta, value after the update, out-degree, edge weight).
    priority: from (value, delta); used when only a portion of the vertices is scheduled.
    pre_step: optional rewrite of the delta from (id, delta, value) before it is applied.
    fan_out: optional, instead of ``message`` where an edge carries any number of messages to any vertices: from (dst, delta, value after
        the update, out-degree, edge weight) to an array of structs ``dst, m``.
    improves: vertices send only if the delta changes the value (for min and max, which would otherwise never end).
    """

    name: str
    init_value: Callable[[Column], Column]
    init_delta: Callable[[Column], Column]
    identity: float
    agg: Callable[[Column], Column]
    combine: Callable[[Column, Column], Column]
    message: Callable[[Column, Column, Column, Column], Column]
    priority: Callable[[Column, Column], Column] = lambda value, delta: delta
    pre_step: Callable[[Column, Column, Column], Column] | None = None
    improves: bool = False
    fan_out: Callable[[Column, Column, Column, Column, Column], Column] | None = None

    @property
    def id_column(self) -> Column:
        return F.lit(float(self.identity))

    def pending(self, value: Column, delta: Column) -> Column:
        p = delta != self.id_column
        return p & (self.combine(value, delta) != value) if self.improves else p
