import math
import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from deltarill.operators import skew


def test_totals_and_percentiles(spark, rows):
    r = random.Random(5)
    data = [(1 if r.random() < 0.4 else r.choice([None, 2, 3, 4]), r.choice([None, 5, 5, 5]) if r.random() < 0.3 else r.randrange(200), 0) for _ in range(3000)]
    df = spark.createDataFrame(data, "k int, v int, n int")
    c = skew.compress(df, "k", "v")
    per = defaultdict(list)
    for k, v, _ in data:
        if k is not None:
            per[k].append(v)
    want = []
    for k, vs in per.items():
        have = Counter(v for v in vs if v is not None)
        mode = min(have, key=lambda v: (-have[v], v))
        want.append((k, len(vs), len(have), mode, have[mode]))
    assert rows(skew.per_key_totals(c)) == sorted(want)
    pct = [(k, s, sorted(v for v in vs if v is not None)[max(1, math.ceil(s * sum(v is not None for v in vs))) - 1]) for k, vs in per.items() for s in (0.1, 0.5, 0.9)]
    assert rows(skew.per_key_percentiles(c, [0.1, 0.5, 0.9])) == sorted(pct)


def test_heavy_keys_ties_and_nulls(spark, rows):
    df = spark.createDataFrame([(1, 1)] * 5 + [(2, None)] * 5 + [(3, 1)] * 4 + [(None, 1)] * 9, "k int, v int")
    assert rows(skew.heavy_keys(df, "k", "v", 5 / 14)) == [(1, 5), (2, 5)]


def test_empty_and_null_only(spark, rows):
    empty = spark.createDataFrame([], "k int, v int")
    assert skew.heavy_keys(empty, "k", "v", 0.1).count() == 0
    assert skew.per_key_percentiles(skew.compress(empty, "k", "v"), [0.5]).count() == 0
    nulls = spark.createDataFrame([(1, None), (None, 2)], "k int, v int")
    assert rows(skew.per_key_totals(skew.compress(nulls, "k", "v"))) == [(1, 1, 0, None, None)]
    assert skew.per_key_percentiles(skew.compress(nulls, "k", "v"), [0.5]).count() == 0


def test_times_and_values_of_a_hot_key(spark, rows, tmp_path):
    from deltarill import data_queries as q

    fields = ["1.5", "2;3;4.5", "abc", "7;x", None, "-2e1", '"8";9']
    data = [(i, 1 if i % 3 else i % 5, i % 2, fields[i % 7], i, 2 * i) for i in range(210)]
    edges = spark.createDataFrame(data, "edge_id long, src long, dst long, value string, a long, b long")
    edges.select("edge_id", "src", "dst", "value", F.timestamp_seconds("a").alias("added_at"), F.timestamp_seconds("b").alias("ingested_at")).write.parquet(f"{tmp_path}/edge_with_value.parquet")
    buckets = spark.createDataFrame([(4, 1.0, 3, 9), (4, None, 5, None), (None, 2.0, 1, 1), (6, None, 2, 2)], "edge_count int, value double, p long, r long")
    buckets.select("edge_count", "value", F.timestamp_seconds("p").alias("put_at"), F.timestamp_seconds("r").alias("removed_at")).write.parquet(f"{tmp_path}/state_bucket.parquet")
    numbers = [[1.5], [2, 3, 4.5], [], [7], [], [-20], [8, 9]]
    times, values = defaultdict(list), defaultdict(list)
    for i, s, t, _, a, b in data:
        for fld, k in (("edge_with_value.src", s), ("edge_with_value.dst", t)):
            times[fld, "added_at", k].append(a)
            times[fld, "ingested_at", k].append(b)
            values[fld, k] += numbers[i % 7]
    want = [(*k, len(v), len(set(v)), min(v), max(v)) for k, v in times.items()]
    want += [("state_bucket.edge_count", "put_at", 4, 2, 2, 3, 5), ("state_bucket.edge_count", "removed_at", 4, 2, 1, 9, 9),
             ("state_bucket.edge_count", "put_at", 6, 1, 1, 2, 2), ("state_bucket.edge_count", "removed_at", 6, 1, 1, 2, 2)]
    got = q.p6_times(spark, str(tmp_path)).withColumns({c: F.unix_timestamp(c) for c in ("first", "last")})
    assert rows(got) == sorted(want, key=repr)
    values["state_bucket.edge_count", 4] = [1.0]
    values = {k: sorted(v) for k, v in values.items() if v}
    assert rows(q.p6_value_totals(spark, str(tmp_path))) == sorted([(*k, len(v), float(sum(v))) for k, v in values.items()], key=repr)
    assert rows(q.p6_value_percentiles(spark, str(tmp_path))) == sorted([(*k, s, float(v[math.ceil(s * len(v)) - 1])) for k, v in values.items() for s in (0.5, 0.9)], key=repr)
