"""Prepared edges on disk, reused while their source has not changed."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession

from deltarill.operators import partition
from deltarill.sources import adjacency, results


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def fingerprint(spark: SparkSession, path: str) -> str:
    """Names, sizes and times of the files of a source."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return ""
    seen = []
    it = fs.listFiles(p, True)
    while it.hasNext():
        f = it.next()
        seen.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return hashlib.sha256(json.dumps(sorted(seen)).encode()).hexdigest()


def manifest(spark: SparkSession, base: str) -> dict | None:
    """What was prepared under ``base``, or None."""
    fs, p = _fs(spark, f"{base}/manifest.json")
    if not fs.exists(p):
        return None
    return json.loads("".join(r.value for r in spark.read.text(f"{base}/manifest.json").collect()))


def is_fresh(spark: SparkSession, source: str, base: str) -> bool:
    m = manifest(spark, base)
    return m is not None and m["source"] == fingerprint(spark, source)


def delete(spark: SparkSession, base: str) -> None:
    fs, p = _fs(spark, base)
    fs.delete(p, True)


def edges(spark: SparkSession, source: str, base: str, shards: int | str = "auto", reuse: bool = True, check_time: bool = True,
          budget_mb: int = 1024) -> tuple[DataFrame, bool]:
    """The edges of adjacency text with their ``shard``, and whether they were there already.

    They are taken from ``base`` if they were prepared there from the same files for as many shards, else parsed and written in
    contiguous shards of equal size by source, one folder a shard, with their metadata beside them. ``auto`` makes as many
    shards as the budget asks for. ``check_time=False`` takes what is there as it is.
    """
    m = manifest(spark, base)
    if reuse and m is not None and m.get("asked") == shards and (not check_time or is_fresh(spark, source, base)):
        return spark.read.parquet(f"{base}/edges"), True
    delete(spark, base)
    seen = fingerprint(spark, source)
    e = adjacency.edges(adjacency.read_lines(spark, source))
    size = results.summary(e).first()
    n = partition.auto_shards(size.n_edges, 4, budget_mb) if shards == "auto" else shards
    sharded = partition.equal_edge_shards(e, n, "src", "dst")
    sharded.select("src", "dst", "weight", "shard").write.partitionBy("shard").parquet(f"{base}/edges")
    out = spark.read.schema("src long, dst long, weight double, shard int").parquet(f"{base}/edges")
    results.write_metadata(out.drop("shard"), out, base)
    fs, p = _fs(spark, f"{base}/manifest.json")
    f = fs.create(p, True)
    f.write(bytearray(json.dumps({"source": seen, "asked": shards, "shards": n, "n_edges": size.n_edges, "max_id": -1 if size.max_id is None else size.max_id}).encode()))
    f.close()
    return out, False


def prepare(spark: SparkSession, source: str, base: str, num_shards: int | str = "auto", reuse: bool = True, check_time: bool = True) -> DataFrame:
    """As :func:`edges`, the edges alone."""
    return edges(spark, source, base, num_shards, reuse, check_time)[0].drop("shard")
