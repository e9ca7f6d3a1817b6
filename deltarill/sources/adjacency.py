"""Adjacency-list text: ``src n dst dst ...`` per line, a neighbour being ``dst`` or ``dst,weight``.

Tokens are separated by any run of blanks or tabs; lines that begin with ``#`` or ``%`` and blank lines are no records; ``n`` may
be 0. A line whose count or tokens are wrong is kept aside whole, with a reason, and gives no edges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_ID = r"\A[0-9]{1,18}\z"
_NEIGHBOUR = r"\A[0-9]{1,18}(,[-+]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][-+]?[0-9]+)?)?\z"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``line``: the lines of text files."""
    return spark.read.text(path).withColumnRenamed("value", "line")


def drop_comments(lines: DataFrame, line: str = "line") -> DataFrame:
    """Lines that are records. Null lines are none."""
    return lines.where(F.col(line).isNotNull() & ~F.col(line).rlike(r"\A[#%]") & F.col(line).rlike(r"\S"))


def parsed(lines: DataFrame, line: str = "line") -> DataFrame:
    """The records with ``src, declared, neighbours`` (tokens) and ``reason``, null where the record is good."""
    t = F.filter(F.split(F.col(line), r"[ \t\r\n]+"), lambda x: x != "")
    d = drop_comments(lines, line).withColumn("_t", t)
    d = d.withColumn("neighbours", F.slice("_t", 3, F.greatest(F.size("_t") - 2, F.lit(0))))
    src, n = F.get("_t", F.lit(0)), F.get("_t", F.lit(1))
    reason = (
        F.when(~src.rlike(_ID), "src")
        .when(n.isNull() | ~n.rlike(_ID), "count")
        .when(~F.forall("neighbours", lambda x: x.rlike(_NEIGHBOUR)), "neighbour")
        .when(n.try_cast("long") != F.size("neighbours"), "mismatch")
    )
    return d.withColumn("reason", reason).withColumn("src", src.try_cast("long")).withColumn("declared", n.try_cast("long")).drop("_t")


def edges(lines: DataFrame, line: str = "line") -> DataFrame:
    """``src, dst, weight``: the edges of good records; a neighbour without a weight has weight 0."""
    part: Column = F.split("n", ",")
    return parsed(lines, line).where("reason is null").select("src", F.explode("neighbours").alias("n")).select(
        "src", part[0].cast("long").alias("dst"), F.coalesce(F.get(part, F.lit(1)).cast("double"), F.lit(0.0)).alias("weight")
    )


def vertices(lines: DataFrame, line: str = "line") -> DataFrame:
    """``id, degree``: the sources of good records, also those without neighbours; repeated sources are added up."""
    return parsed(lines, line).where("reason is null").groupBy(F.col("src").alias("id")).agg(F.sum(F.size("neighbours")).cast("long").alias("degree"))


def quarantine(lines: DataFrame, line: str = "line") -> DataFrame:
    """``line, declared, parsed, reason``: the records kept aside."""
    return parsed(lines, line).where("reason is not null").select(
        F.col(line).alias("line"), "declared", F.size("neighbours").cast("long").alias("parsed"), "reason"
    )


def to_lines(edges_: DataFrame, weighted: bool = False) -> DataFrame:
    """``src, line``: edges as text, neighbours in order. A source's neighbours stand in one line, as the format wants it."""
    one = F.concat_ws(",", F.col("dst").cast("string"), F.col("weight").cast("string")) if weighted else F.col("dst").cast("string")
    per = edges_.groupBy("src").agg(F.array_sort(F.collect_list(F.struct(F.col("dst"), one.alias("t")))).alias("a"))
    text = F.concat(F.col("src").cast("string"), F.lit("\t"), F.size("a").cast("string"), F.lit(" "), F.array_join(F.col("a.t"), " "))
    return per.select("src", text.alias("line"))
