"""Queries of the general data problems over the tables of TESTDATA.md, with SQL where it is fast enough."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltarill import data_sql
from deltarill.operators import orphans, packed, quarantine, skew

GRAPH_LAYOUT = packed.Layout(decimal_suffix=True, list_quotes=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- 3: several values packed in one field


def _unpacked(spark: SparkSession, d: str) -> DataFrame:
    graph = packed.unpack(table(spark, d, "input_graph"), "line_no", "dst", declared="edge_count", layout=GRAPH_LAYOUT)
    edges = packed.unpack(table(spark, d, "edge_with_value"), "edge_id", "value")
    return graph.withColumn("ref_table", F.lit("input_graph")).unionByName(edges.withColumn("ref_table", F.lit("edge_with_value")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _unpacked(spark, d).where("n_values >= 2").select("ref_table", "row_id", "pos", "val")


def p3_separators(spark: SparkSession, d: str) -> DataFrame:
    """The inferred separators per table, with their scores."""
    graph = packed.score_candidates(table(spark, d, "input_graph"), "dst", F.lit("input_graph"), "edge_count", GRAPH_LAYOUT)
    edges = packed.score_candidates(table(spark, d, "edge_with_value"), "value", F.lit("edge_with_value"))
    return graph.unionByName(edges).select(
        F.col("source").alias("ref_table"), F.format_string("U+%04X", F.ascii("candidate")).alias("separator"), "rows",
        F.round("regularity", 6).alias("regularity"), F.round("consistency", 6).alias("consistency"),
        (F.col("score") >= packed.MIN_SCORE).alias("accepted"),
    )


# --- 4: references to records that do not exist


def _references(spark: SparkSession, d: str) -> list[orphans.Reference]:
    buckets = orphans.Presence(table(spark, d, "state_bucket"), "k", "put_at", "removed_at")
    edges, lines = table(spark, d, "edge_with_value"), table(spark, d, "input_graph")
    return [
        orphans.Reference("edge_with_value", edges, "edge_id", "ingested_at", "dst", buckets),
        orphans.Reference("input_graph", lines, "line_no", "loaded_at", "src", buckets),
        # an edge whose source has only orphaned adjacency lines is a child of those lines
        orphans.Reference("edge_with_value", edges, "edge_id", "ingested_at", "src", "input_graph", "src"),
    ]


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """The direct orphans of the whole cascade, which runs to its end; the inherited ones are counted in ``p4_report``."""
    return orphans.orphan_rows(_references(spark, d)).where("kind = 'direct'").select("ref_table", "ref_month", "row_id")


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_report(orphans.orphan_rows(_references(spark, d)))


def p4_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Three steps down: an adjacency line refers to its vertex, a neighbour listed in it to the line, the weight of a neighbour to the
    neighbour. What hangs on an orphaned line is orphaned with it, one level a step."""
    lines = table(spark, d, "input_graph").withColumn("id", F.col("line_no").cast("string"))
    buckets = orphans.Presence(table(spark, d, "state_bucket"), "k", "put_at", "removed_at")
    values = packed.unpack(lines.withColumn("line", F.struct("id", "loaded_at")), "line", "dst", declared="edge_count", layout=GRAPH_LAYOUT)
    listed = values.select(F.col("row_id.id").alias("line"), F.col("row_id.loaded_at").alias("loaded_at"), F.concat_ws(":", "row_id.id", F.col("pos").cast("string")).alias("id"), "val")
    weights = listed.where(F.col("val").contains(",")).select(F.col("id").alias("neighbour"), F.concat("id", F.lit(":w")).alias("id"), "loaded_at")
    found = orphans.orphan_rows([
        orphans.Reference("weight", weights, "id", "loaded_at", "neighbour", "neighbour", "id"),
        orphans.Reference("neighbour", listed, "id", "loaded_at", "line", "line", "id"),
        orphans.Reference("line", lines, "id", "loaded_at", "src", buckets),
    ])
    return found.groupBy("ref_table", "ref_month", "kind", "level").agg(F.count("*").alias("n_rows"))


P4_DIRECT = """
SELECT 'edge_with_value' AS ref_table, strftime(ingested_at, '%Y-%m') AS ref_month, edge_id AS row_id, src AS own_key
FROM edge_with_value e WHERE dst IS NOT NULL AND NOT EXISTS (
  SELECT 1 FROM state_bucket b WHERE b.k = e.dst AND b.put_at <= e.ingested_at AND (b.removed_at IS NULL OR b.removed_at > e.ingested_at))
UNION ALL
SELECT 'input_graph', strftime(loaded_at, '%Y-%m'), line_no, src
FROM input_graph g WHERE src IS NOT NULL AND NOT EXISTS (
  SELECT 1 FROM state_bucket b WHERE b.k = g.src AND b.put_at <= g.loaded_at AND (b.removed_at IS NULL OR b.removed_at > g.loaded_at))
"""

# --- 5: rows that fail to parse


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return quarantine.faults(table(spark, d, "raw_lines")).select("line_id", "reason")


def p5_loaded_edges(spark: SparkSession, d: str) -> DataFrame:
    return quarantine.loaded(table(spark, d, "raw_lines"), "edge_with_value")


def p5_loaded_graph(spark: SparkSession, d: str) -> DataFrame:
    return quarantine.loaded(table(spark, d, "raw_lines"), "input_graph")


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return quarantine.faults(table(spark, d, "raw_lines")).groupBy("feed", "reason").agg(F.count("*").alias("n_lines"))


# --- 6: a few keys holding most records

P6_SHARE = 0.016
P6_NUMBER = "[-+]?(?:[0-9]+[.]?[0-9]*|[.][0-9]+)(?:[eE][-+]?[0-9]+)?"


def _p6_fields(spark: SparkSession, d: str):
    edges, buckets = table(spark, d, "edge_with_value"), table(spark, d, "state_bucket")
    yield "edge_with_value.src", edges, "src", "dst"
    yield "edge_with_value.dst", edges, "dst", "src"
    yield "state_bucket.edge_count", buckets, "edge_count", "value"


def _union(parts) -> DataFrame:
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p)
    return out


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _union(
        skew.heavy_keys(df, key, value, P6_SHARE).select(F.lit(fld).alias("fld"), F.col("key_val").cast("long").alias("key_val"))
        for fld, df, key, value in _p6_fields(spark, d)
    )


def p6_totals(spark: SparkSession, d: str) -> DataFrame:
    return _union(
        skew.per_key_totals(skew.compress(df, key, value)).select(
            F.lit(fld).alias("fld"), F.col("key_val").cast("long").alias("key_val"), "n_rows", "n_distinct",
            F.col("mode").cast("double").alias("mode"), "mode_rows",
        )
        for fld, df, key, value in _p6_fields(spark, d)
    )


def p6_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return _union(
        skew.per_key_percentiles(skew.compress(df, key, value), [0.5, 0.9]).select(
            F.lit(fld).alias("fld"), F.col("key_val").cast("long").alias("key_val"), "share", F.col("value").cast("double").alias("value")
        )
        for fld, df, key, value in _p6_fields(spark, d)
    )


def _p6_times(spark: SparkSession, d: str):
    edges, buckets = table(spark, d, "edge_with_value"), table(spark, d, "state_bucket")
    for key in ("src", "dst"):
        for time in ("added_at", "ingested_at"):
            yield f"edge_with_value.{key}", edges, key, time
    for time in ("put_at", "removed_at"):
        yield "state_bucket.edge_count", buckets, "edge_count", time


def p6_times(spark: SparkSession, d: str) -> DataFrame:
    """Rows, distinct times, first and last time of each time column per key."""
    return _union(
        skew.per_key_times(skew.compress(df, key, time)).select(
            F.lit(fld).alias("fld"), F.lit(time).alias("time_column"), F.col("key_val").cast("long").alias("key_val"), "n_rows", "n_distinct", "first", "last"
        )
        for fld, df, key, time in _p6_times(spark, d)
    )


def _p6_numbers(spark: SparkSession, d: str):
    """Every number there is: those of an edge's field one by one, also where it holds several; labels are none."""
    edges, buckets = table(spark, d, "edge_with_value"), table(spark, d, "state_bucket")
    ends = edges.withColumn("ends", F.struct("src", "dst"))
    single = packed.unpack(ends, "ends", "value").select("row_id.src", "row_id.dst", F.expr(f"CASE WHEN val rlike '^(?:{P6_NUMBER})$' THEN try_cast(val AS DOUBLE) END").alias("number"))
    numbers = single.where("number is not null")
    yield "edge_with_value.src", numbers, "src", "number"
    yield "edge_with_value.dst", numbers, "dst", "number"
    yield "state_bucket.edge_count", buckets.where("value is not null"), "edge_count", "value"


def p6_value_totals(spark: SparkSession, d: str) -> DataFrame:
    """Count and sum of the numeric values per key; keys without one give no row."""
    return _union(
        skew.per_key_sums(skew.compress(df, key, value)).select(
            F.lit(fld).alias("fld"), F.col("key_val").cast("long").alias("key_val"), "n_values", F.round("total", 4).alias("total")
        )
        for fld, df, key, value in _p6_numbers(spark, d)
    )


def p6_value_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Exact percentiles of the numeric values per key."""
    return _union(
        skew.per_key_percentiles(skew.compress(df, key, value), [0.5, 0.9]).select(F.lit(fld).alias("fld"), F.col("key_val").cast("long").alias("key_val"), "share", "value")
        for fld, df, key, value in _p6_numbers(spark, d)
    )


_P6 = [("edge_with_value.src", "edge_with_value", "src", "dst"), ("edge_with_value.dst", "edge_with_value", "dst", "src"),
       ("state_bucket.edge_count", "state_bucket", "edge_count", "value")]

QUERIES = {f.__name__: f for f in (p3_found, p3_separators, p4_found, p4_report, p4_cascade, p5_found, p5_loaded_edges, p5_loaded_graph,
                                   p5_report, p6_found, p6_totals, p6_percentiles, p6_times, p6_value_totals, p6_value_percentiles)}

ORACLES = {
    **data_sql.ORACLES,
    "p4_found": f"SELECT ref_table, ref_month, row_id FROM ({P4_DIRECT})",
    "p4_report": f"""
WITH direct AS ({P4_DIRECT}),
lines AS (SELECT g.src, count(*) AS n, count(o.row_id) AS gone FROM input_graph g
  LEFT JOIN (SELECT row_id FROM direct WHERE ref_table = 'input_graph') o ON o.row_id = g.line_no WHERE g.src IS NOT NULL GROUP BY 1),
inherited AS (SELECT strftime(ingested_at, '%Y-%m') AS ref_month FROM edge_with_value
  WHERE src IN (SELECT src FROM lines WHERE n = gone) AND edge_id NOT IN (SELECT row_id FROM direct WHERE ref_table = 'edge_with_value')),
allrows AS (SELECT ref_table, ref_month, 1 AS direct, 0 AS inherited FROM direct UNION ALL SELECT 'edge_with_value', ref_month, 0, 1 FROM inherited)
SELECT ref_table, ref_month, CAST(sum(direct) AS BIGINT) AS direct, CAST(sum(inherited) AS BIGINT) AS inherited FROM allrows GROUP BY 1, 2""",
    "p4_cascade": data_sql.PACKED.rsplit("SELECT", 1)[0] + f""", direct AS ({P4_DIRECT}),
gone AS (SELECT row_id AS line_no, ref_month FROM direct WHERE ref_table = 'input_graph'),
neighbour AS (SELECT ref_month, v FROM clean JOIN gone ON clean.row_id = gone.line_no WHERE clean.ref_table = 'input_graph' AND v <> ''),
allrows AS (SELECT 'line' AS ref_table, ref_month, 'direct' AS kind, 0 AS level FROM gone UNION ALL SELECT 'neighbour', ref_month, 'inherited', 1 FROM neighbour
  UNION ALL SELECT 'weight', ref_month, 'inherited', 2 FROM neighbour WHERE contains(v, '~'))
SELECT ref_table, ref_month, kind, level, count(*) AS n_rows FROM allrows GROUP BY ALL""",
    "p6_found": " UNION ALL ".join(
        f"SELECT '{f}' AS fld, CAST({k} AS BIGINT) AS key_val FROM {t} WHERE {k} IS NOT NULL GROUP BY {k} "
        f"HAVING count(*) >= {P6_SHARE} * (SELECT count({k}) FROM {t})" for f, t, k, _ in _P6),
    "p6_totals": " UNION ALL ".join(
        f"""SELECT '{f}' AS fld, key_val, CAST(sum(n) AS BIGINT) AS n_rows, count(v) AS n_distinct,
CAST(arg_min(v, (-n, v)) FILTER (v IS NOT NULL) AS DOUBLE) AS mode, CAST(max(n) FILTER (v IS NOT NULL) AS BIGINT) AS mode_rows
FROM (SELECT CAST({k} AS BIGINT) AS key_val, {v} AS v, count(*) AS n FROM {t} WHERE {k} IS NOT NULL GROUP BY 1, 2) GROUP BY key_val"""
        for f, t, k, v in _P6),
    "p6_times": " UNION ALL ".join(
        f"SELECT '{t}.{k}' AS fld, '{c}' AS time_column, CAST({k} AS BIGINT) AS key_val, count(*) AS n_rows, count(DISTINCT {c}) AS n_distinct, "
        f"min({c}) AS first, max({c}) AS last FROM {t} WHERE {k} IS NOT NULL GROUP BY {k}"
        for t, k, cs in (("edge_with_value", "src", ("added_at", "ingested_at")), ("edge_with_value", "dst", ("added_at", "ingested_at")),
                         ("state_bucket", "edge_count", ("put_at", "removed_at"))) for c in cs),
    "p6_percentiles": " UNION ALL ".join(
        f"SELECT '{f}' AS fld, CAST({k} AS BIGINT) AS key_val, CAST({s} AS DOUBLE) AS share, CAST(quantile_disc({v}, {s}) AS DOUBLE) AS value "
        f"FROM {t} WHERE {k} IS NOT NULL AND {v} IS NOT NULL GROUP BY {k}" for f, t, k, v in _P6 for s in (0.5, 0.9)),
}
