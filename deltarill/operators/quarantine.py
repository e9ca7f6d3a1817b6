"""Rows that fail to parse: cells, a rule table, one reason per faulty record, and the valid rows loaded.

Records are cut into cells, cells are exploded to ``(row, column, value)``, joined to a small rule table and judged by its
patterns, limits and numbers; what fails is aggregated per row to the rule of lowest rank, and clean rows are those left by an
anti-join. Only failing cells are shuffled. Other rules, or other patterns in them, give other results.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deltarill.session import materialize

#: fixed values of the two layouts
MAX_ID = 4294967295
ID = r"\A[0-9]+\z"
NUMBER = r"\A[-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?\z"
QUOTED = r'(?s)\A(?:"(?:[^"]++|"")*+"|[^"]*+)\z'
SEPARATOR = {"input_graph": "\t", "edge_with_value": ","}


class Rule(NamedTuple):
    """What a column of the exploded cells must be: match ``pattern``, be an integer of ``most`` at most; and how many ``cells`` go with it:
    a number, or ``cells`` = -1 for as many as the value itself says. Of the rules a record breaks, the one of lowest ``rank`` names the reason."""

    feed: str
    col: str
    rank: int
    reason: str
    pattern: str | None = None
    most: int | None = None
    cells: int | None = None


#: the rule table. Columns: raw (a cell as it stands), row (the record, which goes with its cells), the fields, and of a list its
#: count (which goes with its neighbours), ids and weights.
RULES = [
    Rule("input_graph", "raw", 1, "quoting", QUOTED),
    Rule("input_graph", "row", 2, "columns", cells=2),
    Rule("input_graph", "src", 3, "src", ID, MAX_ID),
    Rule("input_graph", "edge_count", 4, "edge_count", ID, MAX_ID, -1),
    Rule("input_graph", "dst", 5, "dst", ID, MAX_ID),
    Rule("input_graph", "weight", 5, "dst", NUMBER),
    Rule("edge_with_value", "raw", 1, "quoting", QUOTED),
    Rule("edge_with_value", "row", 2, "columns", cells=4),
    Rule("edge_with_value", "src", 3, "src", ID, MAX_ID),
    Rule("edge_with_value", "dst", 4, "dst", ID, MAX_ID),
    Rule("edge_with_value", "value", 5, "value", rf"\A\z|{NUMBER}"),
]
RULE_SCHEMA = "feed string, col string, rank int, reason string, pattern string, most long, cells int"


def rule_table(spark: SparkSession, rules: list[Rule] = RULES) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rules], RULE_SCHEMA)


def _cells(text: Column, sep: str, blanks: str) -> Column:
    """Raw cells without the blanks around them: a chunk in quotes never ends a cell, a quote that isn't closed is a plain sign."""
    s = "\\t" if sep == "\t" else sep
    one = rf'(?s)((?:"(?:[^"]++|"")*+"|[^"{s}]++|")*+)(?:{s}|\z)'
    # with a separator put at the end, the last match is always the empty one behind it
    found = F.regexp_extract_all(F.concat(text, F.lit(sep)), F.lit(one), F.lit(1))
    quoted = F.slice(found, 1, F.greatest(F.size(found) - 1, F.lit(0)))
    return F.transform(F.when(text.contains('"'), quoted).otherwise(F.split(text, s, -1)), lambda c: F.btrim(c, F.lit(" " + blanks)))


def _unquote(cell: Column) -> Column:
    return F.when(cell.startswith('"') & cell.endswith('"') & (F.length(cell) > 1), F.replace(F.substring(cell, F.lit(2), F.length(cell) - 2), F.lit('""'), F.lit('"'))).otherwise(cell)


def records(raw: DataFrame, row_id: str = "line_id", text: str = "line_text", feed: str = "feed") -> DataFrame:
    """``line_id, feed, cells, n_cells, items``: the records of the two feeds; null, blank and comment rows and those of no known feed are left out.

    ``items`` are the blank-separated parts of an adjacency list. Columns are taken by name, so others may be there.
    """
    t = F.col(text)
    kept = raw.where(t.isNotNull() & ~t.rlike(r"\A[#%]") & t.rlike(r"\S") & F.col(feed).isin(*SEPARATOR)).select(
        F.col(row_id).alias("line_id"), F.col(feed).alias("feed"), t.alias("text")
    )
    cells = F.when(F.col("feed") == "input_graph", _cells(F.col("text"), "\t", "")).otherwise(_cells(F.col("text"), ",", "\t"))
    listed = F.filter(F.split(_unquote(F.get("cells", F.lit(1))), r"[ \t]+"), lambda x: x != "")
    return kept.withColumn("cells", cells).select(
        "line_id", "feed", "cells", F.size("cells").alias("n_cells"),
        F.when((F.col("feed") == "input_graph") & (F.size("cells") == 2), listed).alias("items"),
    )


def exploded_cells(recs: DataFrame) -> DataFrame:
    """``line_id, feed, col, val, n`` with one row per cell, and for the list one per count, neighbour and weight.

    ``n`` is what a count is compared with: the cells of the row, or the neighbours of the list.
    """
    def cell(col: str, val: Column, n: Column = F.lit(None).cast("int")) -> Column:
        return F.struct(F.lit(col).alias("col"), val.alias("val"), n.alias("n"))

    def named(i: int) -> Column:
        return _unquote(F.get("cells", F.lit(i)))

    raw_cells = F.transform("cells", lambda c: cell("raw", c))
    row = F.array(cell("row", F.lit(""), F.col("n_cells")))
    items = F.col("items")
    neighbours = F.slice(items, 2, F.greatest(F.size(items) - 1, F.lit(0)))
    ids = F.transform(neighbours, lambda x: cell("dst", F.substring_index(x, ",", 1)))
    weights = F.transform(F.filter(neighbours, lambda x: x.contains(",")), lambda x: cell("weight", F.substring(x, F.instr(x, ",") + 1, F.length(x))))
    graph = F.concat(
        F.array(cell("src", named(0)), cell("edge_count", F.coalesce(F.get(items, F.lit(0)), F.lit("")), F.size(neighbours))), ids, weights
    )
    edge = F.array(cell("src", named(0)), cell("dst", named(1)), cell("value", named(2)))
    own = F.when(F.col("n_cells") != F.when(F.col("feed") == "input_graph", 2).otherwise(4), F.array().cast(
        "array<struct<col:string,val:string,n:int>>")).when(F.col("feed") == "input_graph", graph).otherwise(edge)
    return recs.select("line_id", "feed", F.explode(F.concat(raw_cells, row, own)).alias("c")).select("line_id", "feed", "c.*")


def _judged(cells: DataFrame, rules: list[Rule]) -> DataFrame:
    """The cells with their rules and ``good``. Each pattern of the table is compiled once, so it is a literal where it is tried."""
    patterns = sorted({r.pattern for r in rules if r.pattern is not None})
    table = rule_table(cells.sparkSession, rules).withColumn("try", F.array_position(F.array(*[F.lit(p) for p in patterns]), F.col("pattern")) if patterns else F.lit(0))
    # as many rows as rules
    judged = cells.join(F.broadcast(table), ["feed", "col"])
    v, matches = F.col("val"), F.lit(True)
    for i, p in enumerate(patterns, 1):
        matches = F.when(F.col("try") == i, v.rlike(p)).otherwise(matches)
    number = F.when(F.col("most").isNotNull(), v.try_cast("long"))
    right = F.when(F.col("cells") == -1, number == F.col("n")).when(F.col("cells").isNotNull(), F.col("cells") == F.col("n")).otherwise(True)
    return judged.withColumn("good", F.coalesce(matches, F.lit(False)) & (F.col("most").isNull() | F.coalesce(number <= F.col("most"), F.lit(False))) & F.coalesce(right, F.lit(False)))


def _faults(recs: DataFrame, rules: list[Rule]) -> DataFrame:
    failed = _judged(exploded_cells(recs), rules).where(~F.col("good"))
    return (
        failed.groupBy("line_id", "feed")
        .agg(F.min(F.struct("rank", "reason")).alias("first"))
        .select("line_id", "feed", F.col("first.reason").alias("reason"))
    )


def faults(raw: DataFrame, rules: list[Rule] = RULES, **columns: str) -> DataFrame:
    """``line_id, feed, reason``: one row per faulty record, with the first reason that applies.

    A row id that is repeated is judged once, by the worst of its records. An empty table gives no row; texts of any length are
    read whole. A column without a rule is not judged.
    """
    return _faults(records(raw, **columns), rules)


def loaded(raw: DataFrame, feed: str, rules: list[Rule] = RULES, **columns: str) -> DataFrame:
    """The valid records of one feed as rows.

    ``input_graph``: ``line_id, src, edge_count, dst, weight``, one row per neighbour, a record without neighbours as one
    row of null ``dst``; a neighbour without a weight has a null one. ``edge_with_value``: ``line_id, src, dst, value, note``;
    empty value and note are null. The records are parsed once and kept in the shared folder for the anti-join.
    """
    recs = materialize(records(raw, **columns).where(F.col("feed") == feed))
    clean = recs.join(_faults(recs, rules).select("line_id"), "line_id", "left_anti")
    cell = lambda i: _unquote(F.get("cells", F.lit(i)))
    if feed == "edge_with_value":
        return clean.select(
            "line_id", cell(0).cast("long").alias("src"), cell(1).cast("long").alias("dst"),
            F.nullif(cell(2), F.lit("")).cast("double").alias("value"), F.nullif(cell(3), F.lit("")).alias("note"),
        )
    one = F.explode_outer(F.slice("items", 2, F.greatest(F.size("items") - 1, F.lit(0))))
    return clean.select(
        "line_id", cell(0).cast("long").alias("src"), F.get("items", F.lit(0)).cast("long").alias("edge_count"), one.alias("n")
    ).select(
        "line_id", "src", "edge_count", F.split("n", ",")[0].cast("long").alias("dst"), F.get(F.split("n", ","), F.lit(1)).cast("double").alias("weight")
    )
