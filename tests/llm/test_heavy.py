import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from deltarill.llm import heavy


def column(spark, seed=1, n=4000):
    r = random.Random(seed)
    vals = [None if r.random() < 0.1 else 7 if r.random() < 0.33 else r.randrange(30) if r.random() < 0.5 else r.randrange(10**9) for _ in range(n)]
    return vals, spark.createDataFrame([(v, 1) for v in vals], "v long, h int").withColumn("item", F.lit("x"))


def test_items_over_share(spark, rows):
    vals, df = column(spark)
    c = Counter(v for v in vals if v is not None)
    want = sorted(((v, n) for v, n in c.items() if n >= 0.012 * sum(c.values())), key=repr)
    assert rows(heavy.items_over_share(df, "v", 0.012)) == want
    with pytest.raises(ValueError):
        heavy.items_over_share(df, "v", 0)


@pytest.mark.parametrize("k", [1, 10, 40])
def test_top_items_with_ties(spark, rows, k):
    vals, df = column(spark, k)
    c = Counter(v for v in vals if v is not None)
    cut = sorted(c.values(), reverse=True)[k - 1]
    assert rows(heavy.top_items(df, "v", k)) == sorted(((v, n) for v, n in c.items() if n >= cut), key=repr)


def test_few_values_strings_and_nothing(spark, rows):
    df = spark.createDataFrame([("a",), ("a",), ("b",), ("",), (None,)], "v string")
    assert rows(heavy.top_items(df, "v", 10)) == [("", 1), ("a", 2), ("b", 1)]
    assert rows(heavy.top_items(df, "v", 1)) == [("a", 2)]
    empty = df.limit(0)
    assert heavy.top_items(empty, "v", 3).count() == 0 and heavy.items_over_share(empty, "v", 0.5).count() == 0


def test_nearly_flat_values_do_not_reach_the_driver(spark, rows, monkeypatch):
    k, distinct = 10, 60_000
    df = spark.range(distinct * 3).select((F.col("id") % distinct).alias("v"))
    df = df.unionByName(spark.range(200).select((F.col("id") % 20 + 5).alias("v")))  # twenty values have ten rows more
    seen = []
    cls = type(df)
    collect = cls.collect
    monkeypatch.setattr(cls, "collect", lambda self: seen.append(len(r := collect(self))) or r)
    out = heavy.top_items(df, "v", k)
    monkeypatch.undo()
    assert rows(out) == sorted([(v, 13) for v in range(5, 25)], key=repr)
    assert seen and max(seen) <= max(heavy.LISTED + 1, heavy.CANDIDATES_PER_K * k, 64)
    # every value once: all are tied
    assert heavy.top_items(spark.range(5000).select(F.col("id").alias("v")), "v", 3).count() == 5000
