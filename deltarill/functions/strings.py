"""String helpers as columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLANK = r"[ \f\n\r\t\x0B]"


def trim_left(s: Column) -> Column:
    return F.regexp_replace(s, rf"\A{_BLANK}+", "")


def trim_right(s: Column) -> Column:
    return F.regexp_replace(s, rf"{_BLANK}+\z", "")


def trim(s: Column) -> Column:
    return trim_right(trim_left(s))


def split_set(s: Column, delimiters: str) -> Column:
    """Split at any of the signs; empty parts inside stay, an empty one at the end does not."""
    cls = "".join("\\" + c if re.match(r"[\W_]", c) else c for c in delimiters)
    parts = F.split(s, f"[{cls}]")
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def join(parts: Column, delimiter: str = " ") -> Column:
    return F.array_join(parts, delimiter)


def find_bounded(s: Column, needle: str, length: int) -> Column:
    """Place, from 0, of the needle within the first ``length`` signs; -1 if it is not there."""
    return F.instr(F.substring(s, 1, length), needle) - 1


#: fixed values: what a whole number and a number are written like
INTEGER, NUMBER = r"\A[-+]?[0-9]+\z", r"\A[-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?\z"


def parse(s: Column, kind: str) -> Column:
    """``int, unsigned, long, short, float, double``: the number, or null where the text is none or out of range; ``char``: the first sign;
    ``bool``: whether it is 1. A null text is null in all of them but ``bool``, where it is false."""
    if kind == "char":
        return F.substring(s, 1, 1)
    whole = F.when(s.rlike(INTEGER), s)
    if kind == "bool":
        return F.coalesce(whole.try_cast("int") == 1, F.lit(False))
    if kind == "unsigned":
        n = whole.try_cast("long")
        return F.when((n >= 0) & (n <= 4294967295), n)
    if kind in ("float", "double"):
        return F.when(s.rlike(NUMBER), s).try_cast(kind)
    return whole.try_cast({"short": "smallint", "long": "bigint"}.get(kind, kind))
