import pytest
from pyspark.sql import functions as F

from deltarill.llm import mixing


def test_rates(spark):
    counted = spark.createDataFrame([("a", 600), ("b", 300), ("c", 10), (None, 50), ("x", 70)], "source string, n_tokens long")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.4, 2), ("c", 0.05, 4), ("empty", 0.05, 4), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    r = {x.source: x.rate for x in mixing.rates(counted, targets, "source").collect()}
    total = 10 * 4 * 0.95 / 0.05
    assert r["c"] == pytest.approx(4) and r["a"] == pytest.approx(total * 0.5 / 0.95 / 600) and r["empty"] == 0
    r = {x.source: x.rate for x in mixing.rates(counted, targets, "source", total_tokens=1100).collect()}
    assert r["c"] == 4 and r["a"] * 600 + r["b"] * 300 + 40 == pytest.approx(1100) and r["a"] <= 1
    r = {x.source: x.rate for x in mixing.rates(counted, targets, "source", total_tokens=10**6).collect()}
    assert r == {"a": 1, "b": 2, "c": 4, "empty": 0}


def test_mixture(spark):
    docs = [(i, "some words here " * (1 + i % 7), "a" if i % 3 else "b") for i in range(2000)] + [(5000, None, "a"), (5001, "", "b"), (5002, "x", None), (5003, "x", "other")]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("rate", F.lit(3)).withColumn("n", F.lit(1))
    t = spark.createDataFrame([("a", 0.3, 2), ("b", 0.7, 3), ("none", 0.0, 1)], "source string, target_share double, max_repeats int")
    drawn, rated = mixing.mixture(d, t)
    s = {r.source: r for r in mixing.shares(drawn, rated).collect()}
    assert s["a"].actual_share == pytest.approx(0.3, abs=0.02) and s["b"].actual_share == pytest.approx(0.7, abs=0.02)
    assert s["b"].most_uses <= 3 and s["none"].n_uses == 0
    assert {r.source for r in drawn.select("source").distinct().collect()} == {"a", "b"}
    again, _ = mixing.mixture(d, t)
    assert again.exceptAll(drawn).count() == 0
    assert drawn.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3


def test_token_counts(spark):
    d = spark.createDataFrame([(1, "Hello, world!"), (2, None), (3, ""), (4, "a " * 50_000)], "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in mixing.token_counts(d, "text", ["doc_id"]).collect()}
    assert got[1] == 4 and got[2] == got[3] == 0 and got[4] >= 50_000


def test_empty(spark):
    d = spark.createDataFrame([], "doc_id long, text string, source string")
    t = spark.createDataFrame([("a", 1.0, 2)], "source string, target_share double, max_repeats int")
    drawn, rated = mixing.mixture(d, t)
    assert drawn.count() == 0 and mixing.shares(drawn, rated).first().actual_share == 0
    drawn, rated = mixing.mixture(d, t.limit(0))
    assert drawn.count() == 0 and mixing.shares(drawn, rated).count() == 0


def test_records_are_whole_documents(spark):
    docs = [(i, f"text {i}", "a" if i % 3 else "b", i) for i in range(300)] + [(900, None, "a", 0), (901, "x", None, 0)]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string, copy int").withColumns({"rate": F.lit(3), "n": F.lit(1), "n_tokens": F.lit(9)})
    t = spark.createDataFrame([("a", 0.3, 2), ("b", 0.7, 3)], "source string, target_share double, max_repeats int")
    drawn, rated = mixing.mixture(d, t)
    out = mixing.records(d, rated)
    assert out.columns == [*d.columns, "copy_"]
    assert sorted(tuple(r) for r in out.select("doc_id", "source", "copy_").collect()) == sorted(tuple(r) for r in drawn.select("doc_id", "source", "copy").collect())
    assert all(r.text is None or r.text == f"text {r.doc_id}" for r in out.collect())
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan


def test_check_finds_faults(spark):
    d = spark.createDataFrame([(1, "x", "a"), (2, "x", "b"), (3, "x", None)], "doc_id long, text string, source string")
    rated = spark.createDataFrame([("a", 0.5, 1, 10, 1.0), ("b", 0.5, 2, 10, 1.0), ("c", 0.1, 1, 0, 0.0)], "source string, target_share double, max_repeats int, tokens long, rate double")
    drawn = spark.createDataFrame([(1, "a", 1, 1000), (1, "a", 2, 1000), (3, "b", 1, 1)], "doc_id long, source string, copy int, n_tokens long")
    got = {r.source: tuple(r)[1:] for r in mixing.check(drawn, rated, d).collect()}
    assert got == {"a": (1, 1, 0, True), "b": (1, 0, 1, True), "c": (0, 0, 0, True)}
    many = drawn.unionByName(spark.range(400).selectExpr("1L as doc_id", "'a' as source", "1 as copy", "10L as n_tokens"))
    assert not {r.source: r.near_target for r in mixing.check(many, rated, d).collect()}["a"]
