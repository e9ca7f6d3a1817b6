"""Edges that arrive as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from deltarill.sources import adjacency


def append_edges(lines: DataFrame, path: str, checkpoint: str, line: str = "line") -> StreamingQuery:
    """Parse a stream of adjacency lines and append their edges as Parquet, exactly once; wrong records go to ``<path>_quarantine``."""
    def write(batch: DataFrame, batch_id: int) -> None:
        adjacency.edges(batch, line).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        adjacency.quarantine(batch, line).write.mode("overwrite").parquet(f"{path}_quarantine/batch={batch_id}")

    return lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_edges(edges: DataFrame, time: str, width: str, late: str) -> DataFrame:
    """``start, n_edges``: edges per window of event time; edges later than ``late`` are not waited for."""
    return edges.withWatermark(time, late).groupBy(F.window(time, width).alias("w")).agg(F.count("*").alias("n_edges")).select(
        F.col("w.start").alias("start"), "n_edges"
    )
