from pyspark.sql import functions as F

from deltarill.functions import stats, strings
from deltarill.operators import partition, state
from deltarill.plans import algorithms


def test_shard_arithmetic():
    assert partition.shard_sizes(6078254, 4) == [1519564, 1519563, 1519563, 1519564]
    assert partition.shard_sizes(6078254, 2)[1] == 3039126
    assert sum(partition.shard_sizes(10, 3)) == 10 and partition.shard_sizes(0, 3) == [0, 0, 0]
    assert partition.auto_shards(6078254, 4, 48) == 13
    assert partition.fits_in_memory(1000, 1000, 1) and not partition.fits_in_memory(1000, 1000, 1, shards=2)


def test_equal_shards_keep_all_edges(spark, rows):
    e = spark.createDataFrame([(5 if i % 3 else i, i, i) for i in range(101)], "src long, dst long, idx2 long")
    s = partition.equal_edge_shards(e, 4, "src", "dst")
    assert rows(s.groupBy("shard").count()) == list(enumerate(partition.shard_sizes(101, 4)))
    assert [r.idx for r in s.orderBy("src", "dst").select("idx").collect()] == list(range(101))
    assert partition.equal_edge_shards(e.limit(0), 4, "src", "dst").count() == 0


def test_sharders(spark, rows):
    df = spark.createDataFrame([(-7, "12_a"), (9, "x_1"), (None, None)], "k long, s string")
    got = rows(df.select(partition.mod_int(F.col("k"), 4), partition.mod_str(F.col("s"), 5)))
    assert got == sorted([(-3, 2), (1, None), (None, None)], key=repr)


def test_state_table(spark, rows):
    s = spark.createDataFrame([(1, 2, 0.5, 0.1, 0.1), (2, 3, 1.0, 0.0, 0.0)], "k long, degree int, value double, delta double, priority double")
    new = spark.createDataFrame([(2, 9, 7.0, 0.2, 0.2), (3, 1, 0.0, 0.3, 0.3), (None, 1, 0.0, 0.0, 0.0)], s.schema)
    assert rows(state.put(s, new, "k", ["degree"])) == [(1, 2, 0.5, 0.1, 0.1), (2, 3, 7.0, 0.2, 0.2), (3, 1, 0.0, 0.3, 0.3)]
    keys = spark.createDataFrame([(1,), (1,), (5,), (None,)], "k long")
    assert rows(state.contains(s, keys, "k")) == sorted([(1, True), (5, False), (None, False)], key=repr)
    assert rows(state.lookup(s, keys, "k"), "k") == [(1,)] and rows(state.remove(s, keys, "k"), "k") == [(2,)]
    k = algorithms.pagerank()
    m = spark.createDataFrame([(1, 1.0), (1, 2.0), (8, 1.0), (None, 1.0)], "k long, m double")
    assert rows(state.accumulate_delta(s, m, k, "k"), "k", "delta", "priority") == [(1, 3.1, 3.1), (2, 0.0, 0.0)]
    assert rows(state.accumulate_value(s, k), "k", "value") == [(1, 0.6), (2, 1.0)]
    assert rows(state.update_delta(s, k, F.col("k") == 1), "k", "delta", "priority") == [(1, 0.0, 0.0), (2, 0.0, 0.0)]
    assert rows(state.update_value(s, F.lit(4.0), F.col("k") == 2), "k", "value") == [(1, 0.5), (2, 4.0)]
    twice = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, None, "c"), (None, 1, "d")], "k long, at int, v string")
    assert rows(state.latest(twice, "k", "at"), "k", "v") == [(1, "b"), (2, "c")]


def test_strings(spark):
    s = F.lit(" \f\n abc def;  \x0b\t")
    row = spark.range(1).select(
        strings.trim(s).alias("t"), strings.split_set(F.lit("a,b;;c,"), ",;").alias("p"), strings.join(F.array(F.lit("a"), F.lit("b"))).alias("j"),
        strings.find_bounded(F.lit("hello"), "lo", 5).alias("f"), strings.find_bounded(F.lit("hello"), "lo", 4).alias("g"),
        *[strings.parse(F.lit(v), k).alias(f"{k}{i}") for i, (v, k) in enumerate([("12", "int"), ("x", "int"), ("-1", "unsigned"), ("ab", "char"), ("1", "bool"), ("2", "bool"), ("1.5", "double"), ("7", "short")])],
    ).first()
    assert (row.t, row.p, row.j, row.f, row.g) == ("abc def;", ["a", "b", "", "c"], "a b", 3, -1)
    assert (row.int0, row.int1, row.unsigned2, row.char3, row.bool4, row.bool5, row.double6, row.short7) == (12, None, None, "a", True, False, 1.5, 7)


def test_stats(spark, rows):
    df = spark.createDataFrame([(0.0,), (1e-10,), (1.0,), (1.0,), (None,)], "v double")
    h = stats.log_histogram(df, "v")
    assert rows(h)[0] == (0, 2) and rows(h)[1][1] == 2
    assert {r.line for r in stats.histogram_text(h).collect()} == {"#" * 80}
    a = spark.createDataFrame([("x", 1.0), ("y", None)], "key string, value double")
    assert rows(stats.merge_stats(a, a)) == [("x", 2.0), ("y", 0.0)]
