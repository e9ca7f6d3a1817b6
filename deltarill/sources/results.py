"""Sinks: results as ``id<TAB>value`` text, and the metadata of a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def result_lines(state: DataFrame, digits: int | None = None) -> DataFrame:
    """``line``: ``id<TAB>value`` per vertex."""
    v = F.col("value") if digits is None else F.format_string(f"%.{digits}f", "value")
    return state.select(F.concat_ws("\t", F.col("id").cast("string"), v.cast("string")).alias("line"))


def write_result(state: DataFrame, path: str) -> None:
    result_lines(state).write.mode("overwrite").text(path)


def totals(state: DataFrame) -> DataFrame:
    """``sum_delta, sum_value`` over all vertices."""
    return state.agg(F.sum("delta").alias("sum_delta"), F.sum("value").alias("sum_value"))


def summary(edges: DataFrame) -> DataFrame:
    """``n_edges, n_vertices_dense, max_id``: dense means ids from 0 to the largest."""
    return edges.agg(F.count("*").alias("n_edges"), F.max(F.greatest("src", "dst")).alias("max_id")).select(
        "n_edges", "max_id", (F.coalesce("max_id", F.lit(-1)) + 1).alias("n_vertices_dense")
    )


def out_degrees(edges: DataFrame) -> DataFrame:
    """``src, n``."""
    return edges.groupBy("src").agg(F.count("*").alias("n"))


def write_metadata(edges: DataFrame, sharded: DataFrame, base: str) -> None:
    """Vertex count, edges per shard, the last source of each shard and out-degrees, as Parquet under ``base``."""
    summary(edges).write.mode("overwrite").parquet(f"{base}/summary")
    sharded.groupBy("shard").agg(F.count("*").alias("n_edges"), F.max("src").alias("last_src")).write.mode("overwrite").parquet(f"{base}/shards")
    out_degrees(edges).write.mode("overwrite").parquet(f"{base}/out_degrees")
