"""References to records that do not exist: a fixpoint cascade of semi-joins down the foreign-key graph.

A row is *directly* orphaned if its key is not null and no record of the parent is there for it: for a ``Presence`` at the time
of the row, for a table that must hold the key at all. A row is *indirectly* orphaned if it refers to a key of a child table all
of whose own records are orphaned, directly or not. Each round looks only at the keys that became orphaned in the round before,
one step further down the graph, whatever its depth; a cycle is followed until it adds nothing, and the cascade ends when a
round finds none.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deltarill.operators import hot
from deltarill.session import materialize, release


@dataclass(frozen=True)
class Presence:
    """A parent table whose records are there from ``start`` on and until ``end`` (null: still there)."""

    table: DataFrame
    key: str
    start: str
    end: str


@dataclass(frozen=True)
class Reference:
    """Rows of ``table`` refer by ``key`` to ``parent``: a Presence, or the name of a child table (its own included) by its column ``parent_key``.

    A child table has the same ``table``, ``row_id`` and ``time`` in all its references and needs none to a Presence.
    ``required``: a key that the parent table does not hold at all makes a direct orphan; else only what it holds can be orphaned.
    """

    child: str
    table: DataFrame
    row_id: str
    time: str
    key: str
    parent: Presence | str
    parent_key: str | None = None
    required: bool = False


def _merged(spans: DataFrame, *by: str) -> DataFrame:
    """``k, s, e``: overlapping spans of the same ``by`` as one."""
    by_start = Window.partitionBy(*by).orderBy("s")
    before = F.max("e").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    opened = spans.withColumn("opens", (before.isNull() | (F.col("s") > before)).cast("int"))
    return opened.withColumn("span", F.sum("opens").over(by_start)).groupBy(*by, "span").agg(F.min("s").alias("s"), F.max("e").alias("e")).select("k", "s", "e")


def merged_presence(p: Presence) -> DataFrame:
    """``key, start_at, end_at``: per key disjoint spans, overlapping and repeated records merged.

    Records without a key or a start are never there, nor is one that ends at or before its start. Equal records are
    collapsed before the shuffle by key ends; the spans of a key with very many records are merged month by month first.
    """
    end = F.coalesce(F.col(p.end), F.lit("9999-12-31").cast(dict(p.table.dtypes)[p.end]))
    spans = p.table.select(F.col(p.key).alias("k"), F.col(p.start).alias("s"), end.alias("e")).where("k is not null and s is not null and e > s")
    often = hot.hot_keys(spans, "k")
    spans = spans.groupBy("k", "s").agg(F.max("e").alias("e"))
    if often:
        busy = spans.where(F.col("k").isin(often)).withColumn("month", F.trunc("s", "month"))
        spans = spans.where(~F.col("k").isin(often)).unionByName(_merged(busy, "k", "month"))
    return _merged(spans, "k").select(F.col("k").alias("key"), F.col("s").alias("start_at"), F.col("e").alias("end_at"))


def _rows(ref: Reference) -> DataFrame:
    return ref.table.where(F.col(ref.key).isNotNull()).select(
        F.lit(ref.child).alias("ref_table"), F.col(ref.row_id).alias("row_id"), F.col(ref.time).alias("at"), F.col(ref.key).alias("key")
    )


def direct_orphans(ref: Reference, spans: DataFrame) -> DataFrame:
    """``ref_table, row_id, at, key``: rows whose key is in no span at their time.

    An anti-join by key with the time as a condition: it carries one row per reference and per span; the references of a hot
    key are split over many tasks by a salt, its spans repeated for each. The work of a reference grows with the disjoint
    spans of its own key, which merging keeps few. A row with a null time has no moment at which its record could be there, so
    it counts as an orphan.
    """
    rows = _rows(ref)
    often, n = hot.hot_keys(rows, "key"), hot.splits(rows)
    rows = rows.withColumn("_salt", hot.salt(F.col("key"), often, n, F.col("row_id")))
    s = hot.repeated(spans, "key", often, n).alias("s") if often else spans.withColumn("_salt", F.lit(0)).alias("s")
    same = (rows.key == F.col("s.key")) & (rows["_salt"] == F.col("s._salt")) if often else rows.key == F.col("s.key")
    return rows.join(s, same & (F.col("s.start_at") <= rows["at"]) & (F.col("s.end_at") > rows["at"]), "left_anti").drop("_salt")


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _direct(references: list[Reference], tables: dict[str, Reference]) -> DataFrame | None:
    spans: dict[int, DataFrame] = {}
    found = []
    for r in references:
        if isinstance(r.parent, Presence):
            found.append(direct_orphans(r, spans.setdefault(id(r.parent), merged_presence(r.parent))))
        elif r.required:
            held = tables[r.parent].table.select(F.col(r.parent_key).alias("key")).where("key is not null").distinct()
            found.append(_rows(r).join(held, "key", "left_anti").select("ref_table", "row_id", "at", "key"))
    return _union(found) if found else None


def orphan_rows(references: list[Reference], cascade: bool = True) -> DataFrame:
    """``ref_table, ref_month, row_id, key, kind, level``: each orphaned row once, ``kind`` being ``direct`` or ``inherited``.

    ``level`` is 0 for direct orphans and the round of the cascade otherwise; without ``cascade`` only level 0 is looked for. Null
    keys are no references. A row that is orphaned by several references comes out with one of them. Repeated row ids of one
    table are one row where an inner reference leads to or from it, else each counts. Every round adds rows that were not known, so
    the cascade ends by itself. Empty tables give no rows. Columns are taken by name, so tables may share other column names.
    """
    tables: dict[str, Reference] = {}
    for r in references:
        tables.setdefault(r.child, r)
    inner = [r for r in references if not isinstance(r.parent, Presence)]
    for r in inner:
        if r.parent not in tables or not r.parent_key:
            raise ValueError(f"{r.parent} is no child table with references of its own, or its key is not named")
    found = _direct(references, tables)
    if found is None:
        raise ValueError("no reference can be orphaned directly")
    several = len(references) > len(tables) and any(r.required for r in inner)
    level0 = found.withColumn("level", F.lit(0))
    if several:
        level0 = level0.dropDuplicates(["ref_table", "row_id"])
    if not inner or not cascade:
        return _with_month(level0)
    parts = [materialize(level0)]
    for level in count(1):
        so_far, fresh = _union(parts), parts[-1]
        step = []
        for r in inner:
            keys = _fully_orphaned(tables[r.parent], r.parent_key, so_far, fresh)
            known = so_far.where(F.col("ref_table") == r.child).select("row_id")
            step.append(_rows(r).join(keys, "key", "left_semi").join(known, "row_id", "left_anti").select("ref_table", "row_id", "at", "key"))
        new = materialize(_union(step).dropDuplicates(["ref_table", "row_id"]).withColumn("level", F.lit(level)))
        if new.isEmpty():
            release(new)
            break
        parts.append(new)
    return _with_month(_union(parts))


def _fully_orphaned(parent: Reference, parent_key: str, so_far: DataFrame, fresh: DataFrame) -> DataFrame:
    """Keys of the parent table all of whose rows are orphaned, at least one of them in the last round."""
    same = F.col("ref_table") == parent.child
    rows = parent.table.where(F.col(parent_key).isNotNull()).select(F.col(parent_key).alias("key"), F.col(parent.row_id).alias("row_id"))
    touched = rows.join(fresh.where(same).select("row_id"), "row_id", "left_semi").select("key").distinct()
    gone = so_far.where(same).select("row_id", F.lit(True).alias("gone")).dropDuplicates(["row_id"])
    marked = rows.join(touched, "key", "left_semi").join(gone, "row_id", "left")
    return marked.groupBy("key").agg(F.count("*").alias("n"), F.count("gone").alias("n_gone")).where("n = n_gone").select("key")


def _with_month(df: DataFrame) -> DataFrame:
    kind: Column = F.when(F.col("level") == 0, "direct").otherwise("inherited")
    return df.select(
        "ref_table", F.date_format("at", "yyyy-MM").alias("ref_month"), "row_id", "key", kind.alias("kind"), "level"
    )


def orphan_report(orphans: DataFrame) -> DataFrame:
    """``ref_table, ref_month, direct, inherited``: orphaned rows per table and month."""
    return orphans.groupBy("ref_table", "ref_month").agg(
        F.count_if(F.col("kind") == "direct").alias("direct"), F.count_if(F.col("kind") == "inherited").alias("inherited")
    )
