"""Queries of the training-data problems over the tables of TESTDATA.md, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltarill.llm import heavy, leaks, mixing, packing, pii

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(f):
    QUERIES[f.__name__] = f
    return f


# --- 1: filling containers

_PACKED = {"shard_flushinfo": ("shovel_id", "numedges"), "state_bucket": ("slot_id", "edge_count")}


def _packed(spark: SparkSession, d: str):
    limits = {r.item_table: r.capacity for r in table(spark, d, "pack_limits").collect()}
    for name, (row_id, size) in _PACKED.items():
        yield name, limits[name], packing.pack(table(spark, d, name), row_id, size, limits[name])


def _union(parts) -> DataFrame:
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p)
    return out


@query
def p1_pack(spark: SparkSession, d: str) -> DataFrame:
    return _union(p.withColumn("item_table", F.lit(name)) for name, _, p in _packed(spark, d))


@query
def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return _union(packing.report(p, c).withColumn("item_table", F.lit(name)) for name, c, p in _packed(spark, d))


@query
def p1_check(spark: SparkSession, d: str) -> DataFrame:
    """Totals of the items and the faults of their packing, of which there are none."""
    return _union(
        packing.check(p, table(spark, d, name), *_PACKED[name], c).withColumn("item_table", F.lit(name)) for name, c, p in _packed(spark, d))


ORACLES["p1_check"] = " UNION ALL ".join(f"""SELECT '{name}' AS item_table, CAST(count(*) AS BIGINT) AS n_items, CAST(coalesce(sum(greatest(ceil({size} / capacity), 1)), 0) AS BIGINT) AS n_pieces,
CAST(coalesce(sum({size}), 0) AS BIGINT) AS total_size, CAST(ceil(coalesce(sum({size}), 0) / max(capacity)) AS BIGINT) AS least_containers, 0::BIGINT AS overfull, 0::BIGINT AS gaps, 0::BIGINT AS wrong_size, 0::BIGINT AS split, true AS near_least
FROM {name}, pack_limits WHERE item_table = '{name}' AND {size} >= 0""" for name, (_, size) in _PACKED.items())


# --- 2: most frequent items

P2_SHARE = 0.004


@query
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return heavy.items_over_share(table(spark, d, "edge_with_value"), "dst", P2_SHARE).select(F.col("item").alias("dst"))


@query
def p2_top(spark: SparkSession, d: str) -> DataFrame:
    """The 100 vertices most edges point to, and those tied with the last."""
    return heavy.top_items(table(spark, d, "edge_with_value"), "dst", 100).select(F.col("item").alias("dst"), F.col("n").alias("n_edges"))


ORACLES["p2_found"] = f"""SELECT dst FROM edge_with_value WHERE dst IS NOT NULL GROUP BY dst
HAVING count(*) >= {P2_SHARE} * (SELECT count(dst) FROM edge_with_value)"""
ORACLES["p2_top"] = """SELECT dst, n_edges FROM (
  SELECT dst, count(*) AS n_edges, rank() OVER (ORDER BY count(*) DESC) AS r FROM edge_with_value WHERE dst IS NOT NULL GROUP BY dst) WHERE r <= 100"""


# --- 8: mixing sources


def _mixed(spark: SparkSession, d: str):
    docs = table(spark, d, "documents")
    return docs, *mixing.mixture(docs, table(spark, d, "source_targets"))


@query
def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    """The mixture: whole documents, once per use."""
    docs, _, rated = _mixed(spark, d)
    return mixing.records(docs.select("doc_id", "source", "lang", "text"), rated)


@query
def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    _, drawn, rated = _mixed(spark, d)
    return mixing.shares(drawn, rated)


@query
def p8_check(spark: SparkSession, d: str) -> DataFrame:
    """The documents of each listed source and the faults of the mixture, of which there are none."""
    docs, drawn, rated = _mixed(spark, d)
    return mixing.check(drawn, rated, docs)


ORACLES["p8_check"] = """SELECT source, count(doc_id) AS n_docs, 0::BIGINT AS over_used, 0::BIGINT AS foreign, true AS near_target
FROM source_targets LEFT JOIN documents USING (source) GROUP BY source"""


# --- 7: evaluation texts leaking


@query
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


@query
def p7_items(spark: SparkSession, d: str) -> DataFrame:
    """In how many documents each item was found."""
    return leaks.leaked_items(p7_found(spark, d), table(spark, d, "eval_items"))


# --- 9: personal information


@query
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.found_pieces(table(spark, d, "documents"), table(spark, d, "name_list"))


@query
def p9_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.redact(table(spark, d, "documents"), table(spark, d, "name_list"))
