"""Several values packed in one field: infer the separators, split, keep the place.

Separators are inferred per source. Every candidate is scored on the rows of the source that contain it
outside quotes:

* piece type regularity: the share of its occurrences that touch a typed piece (a number, an id or a
  quoted value); a blank inside a label touches words only;
* piece-count consistency: the probability that two rows split by it have the same number of pieces, or,
  where the source declares the number, the share of rows in which that number comes out.

``score = 0.8 * regularity + 0.2 * consistency``; candidates from ``MIN_SCORE`` on are separators of the source.
Both passes are column expressions; only one row per source and candidate ever leaves the executors.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: fixed values: separators that are tried
CANDIDATES = (",", ";", "；", "|", "/", "\t", "\n", " ")
MIN_SCORE = 0.5
_QUOTED = r"""(?:"(?:[^"]++|"")*+"|'(?:[^']++|'')*+')"""
_DECIMAL = r"[-+]?(?:[0-9]+\.[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?"


@dataclass(frozen=True)
class Layout:
    """What is known of a packed column before its separators are inferred.

    decimal_suffix: a comma directly followed by a number with a decimal point belongs to the value.
    list_quotes: one pair of quotes may stand around the whole list.
    """

    decimal_suffix: bool = False
    list_quotes: bool = False


def _cls(chars) -> str:
    return "".join(re.escape(c) if c not in "\t\n" else {"\t": "\\t", "\n": "\\n"}[c] for c in chars)


def _bare(value: Column, layout: Layout) -> Column:
    """The field without blanks around it and, where allowed, without quotes around the whole list."""
    s = F.regexp_replace(value, r"\A[ \t\r\n]+|[ \t\r\n]+\z", "")
    if not layout.list_quotes:
        return s
    whole = rf"\A{_QUOTED}\z"
    inner = F.substring(s, F.lit(2), F.length(s) - 2)
    return F.when(s.rlike(whole), F.regexp_replace(inner, r"\A[ \t]+|[ \t]+\z", "")).otherwise(s)


def score_candidates(df: DataFrame, value: str, source: Column | None = None, declared: str | None = None,
                     layout: Layout = Layout()) -> DataFrame:
    """One row per source and candidate: ``source, candidate, rows, regularity, consistency, score``.

    Null and empty fields are ignored. A source without any candidate gives no row.
    """
    s = _bare(F.col(value), layout)
    masked = F.regexp_replace(s, _QUOTED, "0")
    if layout.decimal_suffix:
        masked = F.regexp_replace(masked, rf",(?={_DECIMAL}(?:[ \t,;；|/]|\z))", ".")
    hard = _cls([c for c in CANDIDATES if c not in " \t\n"])
    tight = F.regexp_replace(masked, rf"[ \t]*([{hard}\n])[ \t]*", "$1")
    picked = (
        df.where(F.col(value).rlike(f"[{_cls(CANDIDATES)}]"))
        .select(
            (source if source is not None else F.lit("")).alias("source"),
            (F.col(declared).cast("long") if declared else F.lit(None).cast("long")).alias("declared"),
            tight.alias("s"),
        )
    )
    scored = []
    for c in CANDIDATES:
        k = _cls([c])
        times = F.regexp_count("s", F.lit(f"{k}+" if c in " \t" else k))
        typed = F.regexp_count("s", F.lit(f"(?:[0-9]{k}+)|(?:(?<![0-9]){k}+[-+.]?[0-9])"))
        scored.append(F.struct(F.lit(c).alias("candidate"), times.alias("times"), F.least(times, typed).alias("typed")))
    counted = (
        picked.select("source", "declared", F.explode(F.array(*scored)).alias("c"))
        .select("source", "declared", "c.*")
        .where("times > 0")
        .groupBy("source", "candidate", "times")
        .agg(
            F.count("*").alias("rows"),
            F.sum("typed").alias("typed"),
            F.sum((F.col("declared") == F.col("times") + 1).cast("long")).alias("as_declared"),
            F.count("declared").alias("with_declared"),
        )
    )
    return (
        counted.groupBy("source", "candidate")
        .agg(
            F.sum("rows").alias("rows"),
            (F.sum("typed") / F.sum(F.col("times") * F.col("rows"))).alias("regularity"),
            F.when(F.sum("with_declared") > 0, F.sum("as_declared") / F.sum("with_declared"))
            .otherwise(F.sum(F.col("rows").cast("double") * F.col("rows")) / (F.sum("rows").cast("double") * F.sum("rows")))
            .alias("consistency"),
        )
        .withColumn("score", 0.8 * F.col("regularity") + 0.2 * F.col("consistency"))
    )


def piece_pattern(separators, layout: Layout = Layout()) -> str:
    """A Java pattern whose successive matches are the pieces of a field, each with the separator that ends it."""
    soft = " " in separators
    hard = [c for c in separators if not (soft and c in " \t")]
    h = f"[{_cls(hard)}]" if hard else r"(?!)"
    if soft:
        end = rf"(?:[ \t]*+{h}[ \t]*+|[ \t]++|\z)"
        stop = r" \t" + _cls(hard)
    else:
        end = rf"(?:{h}|\z)"
        stop = _cls(hard)
    plain = f"[^{stop}]*+" if stop else ".*+"
    if layout.decimal_suffix and "," in separators:
        plain += rf"(?:,(?={_DECIMAL}(?:[{stop}]|\z))[^{stop}]*+)?"
    around = "" if soft else "[ ]*+"
    return rf"(?s)(?:{around}{_QUOTED}{around}(?={end})|{plain}){end}"


def split_packed(df: DataFrame, row_id: str, value: str, separators, layout: Layout = Layout()) -> DataFrame:
    """``row_id, pos, val, n_values``: one row per non-empty value of ``value``, in JVM expressions, without a shuffle.

    ``pos`` counts from 1; an empty place between two separators counts but gives no row. ``val`` has no quotes and no
    blanks around it; a doubled quote inside quotes is one quote. ``n_values`` is the number of values of the field.
    Null, empty and separator-only fields give no row; repeated rows each give their own values. Text of any length is
    read whole: all pattern loops are possessive, so they neither recurse nor go back.
    """
    pattern = separators if isinstance(separators, Column) else F.lit(piece_pattern(separators, layout))
    cut = rf"[ \t]*[{_cls(CANDIDATES)}]?[ \t]*\z"

    def clean(piece: Column) -> Column:
        quoted = piece.rlike(rf"(?s)\A[ \t]*{_QUOTED}[ \t]*.?[ \t]*\z")
        core = F.regexp_replace(F.regexp_replace(piece, cut, ""), r"\A[ \t\r\n]+|[ \t\r\n]+\z", "")
        q = F.substring(core, 1, 1)
        inner = F.trim(F.substring(core, F.lit(2), F.length(core) - 2))
        return F.when(quoted & q.isin('"', "'"), F.replace(inner, F.concat(q, q), q)).otherwise(core)

    bare = _bare(F.col(value), layout)
    pieces = F.regexp_extract_all(bare, pattern, F.lit(0))
    if not isinstance(separators, Column):  # most fields hold one value, which needs no cutting
        pieces = F.when(bare.rlike(f"[{_cls(separators)}]"), pieces).otherwise(F.array(bare)) if separators else F.array(bare)
    return (
        df.where(F.col(value).isNotNull())
        .select(F.col(row_id).alias("row_id"), F.transform(pieces, clean).alias("vals"))
        .withColumn("n_values", F.size(F.filter("vals", lambda v: v != "")))
        .where("n_values > 0")
        .select("row_id", "n_values", F.posexplode("vals").alias("pos", "val"))
        .where("val <> ''")
        .select("row_id", (F.col("pos") + 1).cast("int").alias("pos"), "val", "n_values")
    )


def unpack(df: DataFrame, row_id: str, value: str, *, declared: str | None = None, layout: Layout = Layout()) -> DataFrame:
    """Infer the separators of one source and split by them.

    What reaches the driver is one row per candidate, whatever the size of the table. An empty table, or one in which
    no candidate is regular, comes out with every field as one value.
    """
    scores = score_candidates(df, value, None, declared, layout).where(F.col("score") >= MIN_SCORE)
    return split_packed(df, row_id, value, sorted(r.candidate for r in scores.collect()), layout)


def unpack_by_source(df: DataFrame, row_id: str, value: str, source: str, *, declared: str | None = None,
                     layout: Layout = Layout()) -> DataFrame:
    """As :func:`unpack`, with separators of their own for each value of ``source``.

    The patterns are joined to the rows and never collected; Spark broadcasts them only below its size threshold, and
    splits a source that holds most rows (skew join). A null source is a source of its own.
    """
    scores = score_candidates(df, value, F.col(source), declared, layout).where(F.col("score") >= MIN_SCORE)
    chosen = scores.groupBy("source").agg(F.array_sort(F.collect_list("candidate")).alias("separators"))
    subsets = {}
    for bits in range(1 << len(CANDIDATES)):
        seps = sorted(c for i, c in enumerate(CANDIDATES) if bits >> i & 1)
        subsets["".join(seps)] = piece_pattern(seps, layout)
    known = df.sparkSession.createDataFrame(list(subsets.items()), "separators string, pattern string")
    patterns = chosen.select("source", F.array_join("separators", "").alias("separators")).join(known, "separators")
    rows = df.select(F.col(row_id).alias("_id"), F.col(value).alias("_value"), F.col(source).alias("_source"))
    joined = rows.join(patterns.select("source", "pattern"), F.col("_source").eqNullSafe(F.col("source")), "left")
    out = joined.withColumn("pattern", F.coalesce(F.col("pattern"), F.lit(piece_pattern([], layout))))
    return split_packed(out, "_id", "_value", F.col("pattern"), layout)
