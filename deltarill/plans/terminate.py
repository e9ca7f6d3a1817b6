"""When to stop: callables of (previous progress, progress, round)."""

from __future__ import annotations

from collections.abc import Callable

Terminator = Callable[[float | None, float, int], bool]


def diff(tolerance: float) -> Terminator:
    """Stop once progress changes by no more than ``tolerance``; the first check never stops."""
    return lambda before, now, round_: before is not None and abs(now - before) <= tolerance


def max_rounds(n: int) -> Terminator:
    return lambda before, now, round_: round_ >= n


def any_of(*terminators: Terminator) -> Terminator:
    return lambda before, now, round_: any(t(before, now, round_) for t in terminators)
