import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from deltarill import data_queries
from deltarill.operators import orphans

T = dt.datetime


def tables(spark, buckets, edges, lines):
    b = spark.createDataFrame(buckets, "k long, put_at timestamp, removed_at timestamp, key long")
    e = spark.createDataFrame(edges, "edge_id long, src long, dst long, ingested_at timestamp, level int")
    g = spark.createDataFrame(lines, "line_no long, src long, loaded_at timestamp, kind string")
    p = orphans.Presence(b, "k", "put_at", "removed_at")
    return [
        orphans.Reference("edges", e, "edge_id", "ingested_at", "dst", p),
        orphans.Reference("lines", g, "line_no", "loaded_at", "src", p),
        orphans.Reference("edges", e, "edge_id", "ingested_at", "src", "lines", "src"),
    ]


def day(n):
    return T(2024, 1, 1) + dt.timedelta(days=n)


def test_direct_and_inherited(spark, rows):
    buckets = [(1, day(0), day(5), 0), (1, day(10), None, 0), (2, None, None, 0), (None, day(0), None, 0), (3, day(4), day(4), 0), (1, day(0), day(5), 0)]
    edges = [(1, 9, 1, day(3), 0), (2, 9, 1, day(5), 0), (3, 9, 1, day(40), 0), (4, 9, 2, day(3), 0), (5, 9, None, day(3), 0), (6, 7, 1, day(0), 0), (7, 9, 1, None, 0)]
    lines = [(1, 7, day(1), "x"), (2, 1, day(1), "x"), (3, None, day(1), "x")]
    out = orphans.orphan_rows(tables(spark, buckets, edges, lines))
    assert rows(out, "ref_table", "ref_month", "row_id", "kind", "level") == sorted(
        [("edges", "2024-01", 2, "direct", 0), ("edges", "2024-01", 4, "direct", 0), ("edges", None, 7, "direct", 0), ("lines", "2024-01", 1, "direct", 0), ("edges", "2024-01", 6, "inherited", 1)], key=repr
    )
    assert rows(orphans.orphan_report(out)) == sorted([("edges", "2024-01", 2, 1), ("edges", None, 1, 0), ("lines", "2024-01", 1, 0)], key=repr)


def test_like_brute_force(spark, rows):
    r = random.Random(3)
    buckets = [(r.randrange(12), day(a := r.randrange(60)), r.choice([None, day(a + r.randrange(20))]), 0) for _ in range(60)]
    edges = [(i, r.randrange(15), 1 if r.random() < 0.3 else r.randrange(15), day(r.randrange(80)), 0) for i in range(300)]
    lines = [(i, r.randrange(15), day(r.randrange(80)), "x") for i in range(40)]

    def there(k, t):
        return any(b == k and p <= t and (q is None or q > t) for b, p, q, _ in buckets)

    direct_lines = {i for i, s, t, _ in lines if not there(s, t)}
    gone = {s for _, s, _, _ in lines} - {s for i, s, _, _ in lines if i not in direct_lines}
    want = [("edges", i, "direct") for i, _, d, t, _ in edges if not there(d, t)]
    want += [("edges", i, "inherited") for i, s, d, t, _ in edges if there(d, t) and s in gone]
    want += [("lines", i, "direct") for i in direct_lines]
    assert rows(orphans.orphan_rows(tables(spark, buckets, edges, lines)), "ref_table", "row_id", "kind") == sorted(want, key=repr)


def test_empty_tables(spark):
    assert orphans.orphan_rows(tables(spark, [], [], [])).count() == 0
    assert orphans.orphan_rows(tables(spark, [], [(1, 2, 3, day(0), 0)], [])).count() == 1


def test_three_levels_without_a_presence_and_a_cycle(spark, rows):
    """Parents given as tables: A -> parent, B -> A, C -> B, and D whose rows refer to each other."""
    t = day(1)
    frame = lambda data: spark.createDataFrame([(*x, t) for x in data], "id long, ref long, at timestamp")
    parent, a, b, c = frame([(1, None), (2, None)]), frame([(10, 1), (11, 7), (12, None), (13, 2)]), frame([(20, 10), (21, 11), (22, 11), (23, 12)]), frame([(30, 20), (31, 21), (32, 22), (33, 99)])
    ref = lambda child, df, up, required=False: orphans.Reference(child, df, "id", "at", "ref", up, "id", required)
    out = orphans.orphan_rows([ref("c", c, "b"), ref("b", b, "a"), ref("a", a, "parent", True), ref("parent", parent, "parent")])
    assert rows(out, "ref_table", "row_id", "kind", "level") == sorted(
        [("a", 11, "direct", 0), ("b", 21, "inherited", 1), ("b", 22, "inherited", 1), ("c", 31, "inherited", 2), ("c", 32, "inherited", 2)], key=repr)
    # a cycle that hangs on nothing is no orphan; one that a chain of orphans leads into is
    d = frame([(1, 2), (2, 1), (5, 99), (6, 5), (7, 6), (8, 7)])
    assert rows(orphans.orphan_rows([ref("d", d, "d", True)]), "row_id", "level") == [(5, 0), (6, 1), (7, 2), (8, 3)]
    with pytest.raises(ValueError):
        orphans.orphan_rows([ref("c", c, "nowhere")])


def test_a_key_of_several_rows_is_gone_with_the_last(spark, rows):
    t = day(1)
    a = spark.createDataFrame([(1, 5, 9, t), (2, 5, 8, t), (3, 6, 9, t)], "id long, k long, ref long, at timestamp")
    b = spark.createDataFrame([(1, 5, t), (2, 6, t)], "id long, ref long, at timestamp")
    p = spark.createDataFrame([(8, day(0), None)], "key long, s timestamp, e timestamp")
    refs = [orphans.Reference("a", a, "id", "at", "ref", orphans.Presence(p, "key", "s", "e")), orphans.Reference("b", b, "id", "at", "ref", "a", "k")]
    assert rows(orphans.orphan_rows(refs), "ref_table", "row_id", "level") == [("a", 1, 0), ("a", 3, 0), ("b", 2, 1)]
    assert rows(orphans.orphan_rows(refs, cascade=False), "ref_table", "row_id") == [("a", 1), ("a", 3)]


def test_p4_found_comes_from_the_whole_cascade(spark, rows, tmp_path, monkeypatch):
    """Edge 4 hangs on the only line of its source, which is orphaned: the cascade behind p4_found goes on to it, the result is the direct rows."""
    b, e, g = (tmp_path / f"{n}.parquet" for n in ("state_bucket", "edge_with_value", "input_graph"))
    spark.createDataFrame([(1, day(0), None), (2, day(0), day(5))], "k long, put_at timestamp, removed_at timestamp").write.parquet(str(b))
    spark.createDataFrame([(3, 1, 2, day(40)), (4, 7, 1, day(3)), (5, 7, 9, day(3)), (6, 1, 1, day(3)), (7, 7, None, day(3))],
                          "edge_id long, src long, dst long, ingested_at timestamp").write.parquet(str(e))
    spark.createDataFrame([(1, 7, day(1)), (2, 1, day(1)), (3, 2, day(1)), (4, 2, day(6))], "line_no long, src long, loaded_at timestamp").write.parquet(str(g))
    cascades, orphan_rows = [], orphans.orphan_rows

    def recorded(*args, **kwargs):
        cascades.append(orphan_rows(*args, **kwargs))
        return cascades[-1]

    monkeypatch.setattr(orphans, "orphan_rows", recorded)
    found = data_queries.p4_found(spark, str(tmp_path))
    direct = [("edge_with_value", "2024-01", 5), ("edge_with_value", "2024-02", 3), ("input_graph", "2024-01", 1), ("input_graph", "2024-01", 4)]
    assert rows(found) == sorted(direct, key=repr)
    # edge 5 is direct, so it is not inherited as well; edge 7 has no dst but hangs on the line as edge 4 does
    [cascade] = cascades
    assert rows(cascade, "ref_table", "row_id", "kind", "level") == sorted(
        [(t, i, "direct", 0) for t, _, i in direct] + [("edge_with_value", 4, "inherited", 1), ("edge_with_value", 7, "inherited", 1)], key=repr)


def test_a_hot_key_is_split(spark, rows):
    """Half of the references and of the records have one key."""
    n = 4000
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        e = spark.range(n).select(F.col("id").alias("edge_id"), F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id")).alias("dst"), F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, cast(id % 300 as int))").alias("at"))
        b = spark.range(400).select(F.when(F.col("id") < 200, 7).otherwise(F.col("id") * 3).alias("k"), F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, cast(id as int))").alias("s"))
        b = b.withColumn("e", F.expr("s + make_interval(0, 0, 0, 0, 12)"))
        p, ref = orphans.Presence(b, "k", "s", "e"), orphans.Reference("e", e, "edge_id", "at", "dst", orphans.Presence(b, "k", "s", "e"))
        found = orphans.direct_orphans(ref, orphans.merged_presence(p))
        per = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
        spans = {}
        for r in b.collect():
            spans.setdefault(r.k, []).append((r.s, r.e))
        want = [r.edge_id for r in e.collect() if not any(s <= r.at < x for s, x in spans.get(r.dst, []))]
        assert rows(found, "row_id") == sorted([(i,) for i in want], key=repr)
        assert max(per) <= 0.4 * sum(per) and len(per) == 4
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
