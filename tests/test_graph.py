import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from deltarill.plans import algorithms, schedule, superstep, terminate
from deltarill.plans.kernel import Kernel


def daic(edges, rounds, init=0.2, d=0.8):
    """Synchronous rounds by hand."""
    out = defaultdict(list)
    ids = set()
    for s, t in edges:
        out[s].append(t)
        ids |= {s, t}
    value, delta = dict.fromkeys(ids, 0.0), dict.fromkeys(ids, init)
    for _ in range(rounds):
        nxt = dict.fromkeys(ids, 0.0)
        for v in ids:
            value[v] += delta[v]
            for t in out[v]:
                nxt[t] += delta[v] * d / len(out[v])
        delta = nxt
    return value, delta


def edges_of(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


def test_rounds_like_by_hand(spark):
    r = random.Random(1)
    pairs = [(r.randrange(20), 3 if r.random() < 0.3 else r.randrange(25)) for _ in range(150)] + [(1, 1), (1, 2), (1, 2)]
    prepared = superstep.prepare(edges_of(spark, pairs))
    s = superstep.run_rounds(prepared, algorithms.pagerank(), 11)  # longer than one chain
    value, delta = daic(pairs, 11)
    for row in s.collect():
        assert row.value == pytest.approx(value[row.id]) and row.delta == pytest.approx(delta[row.id])
    assert s.count() == len(value)


def test_closed_form_and_mass(spark):
    n, k = 12, 5
    prepared = superstep.prepare(edges_of(spark, [(i, (i + 1) % n) for i in range(n)]))
    t = superstep.run_rounds(prepared, algorithms.pagerank(), k).agg(F.sum("value"), F.sum("delta")).first()
    assert t[0] == pytest.approx(n * (1 - 0.8**k)) and t[1] == pytest.approx(0.2 * n * 0.8**k)


def test_missing_destinations(spark, rows):
    e = edges_of(spark, [(1, 2), (1, 3), (2, 1), (None, 1), (1, None)])
    k = algorithms.pagerank()
    assert {r[0] for r in rows(superstep.run_rounds(superstep.prepare(e), k, 2))} == {1, 2, 3}
    assert {r[0] for r in rows(superstep.run_rounds(superstep.prepare(e, missing="drop"), k, 2))} == {1, 2}
    with pytest.raises(ValueError):
        superstep.prepare(e, missing="error")
    extra = spark.createDataFrame([(9,), (None,)], "id long")
    assert {r[0] for r in rows(superstep.run_rounds(superstep.prepare(e, extra), k, 1))} == {1, 2, 3, 9}


def test_empty_graph(spark):
    prepared = superstep.prepare(edges_of(spark, []))
    assert superstep.run_rounds(prepared, algorithms.pagerank(), 3).count() == 0


def test_run_until_progress_stands(spark):
    prepared = superstep.prepare(edges_of(spark, [(1, 2), (2, 1), (2, 3), (3, 1)]))
    run = superstep.run_daic(prepared, algorithms.pagerank(), terminate.diff(0.01), check_every=4)
    last = run.metrics[-1]
    assert last["terminated"] and last["diff"] <= 0.01 and last["progress"] == pytest.approx(3, abs=0.1)
    assert [m["round"] for m in run.metrics] == list(range(4, last["round"] + 1, 4))


def test_scheduling_reaches_the_same_end(spark):
    r = random.Random(2)
    pairs = [(i, r.randrange(30)) for i in range(30)] + [(r.randrange(30), r.randrange(30)) for _ in range(60)]
    prepared = superstep.prepare(edges_of(spark, pairs))
    k = algorithms.pagerank()
    run = superstep.run_daic(prepared, k, terminate.max_rounds(40), portion=0.5, min_rows_for_threshold=5)
    value, _ = daic(pairs, 200)
    left = run.state.agg(F.sum("delta")).first()[0]
    assert sum(abs(row.value - value[row.id]) for row in run.state.collect()) <= left / 0.2 + 1e-6
    with pytest.raises(ValueError):
        superstep.run_daic(prepared, k, terminate.max_rounds(1), portion=0)


def test_threshold_takes_all_of_small_tables(spark):
    s = spark.createDataFrame([(i, 0.0, float(i)) for i in range(100)], "id long, value double, delta double")
    k = algorithms.pagerank()
    assert schedule.threshold(s, k, 0.2) is None
    cut = schedule.threshold(s, k, 0.2, min_rows=10, exact=True)
    assert 15 <= s.where(cut).count() <= 21
    same = s.withColumn("delta", F.lit(1.0))
    assert same.where(schedule.threshold(same, k, 0.2, min_rows=10)).count() == 100
    assert schedule.any_pending(s, k) and not schedule.any_pending(s.withColumn("delta", F.lit(0.0)), k)


def test_shortest_paths_and_components(spark):
    pairs = [(0, 1, 1.0), (1, 2, 1.0), (0, 2, 5.0), (2, 3, 1.0), (7, 8, 1.0), (3, 0, 1.0)]
    e = spark.createDataFrame(pairs, "src long, dst long, weight double")
    run = superstep.run_daic(superstep.prepare(e), algorithms.shortest_paths(0), lambda *_: False)
    got = {r.id: r.value for r in run.state.collect()}
    assert got[2] == 2 and got[3] == 3 and got[0] == 0 and got[8] == float("inf")
    both = e.select("src", "dst").unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    run = superstep.run_daic(superstep.prepare(both), algorithms.connected_components(), lambda *_: False)
    assert {r.id: r.value for r in run.state.collect()} == {0: 3, 1: 3, 2: 3, 3: 3, 7: 8, 8: 8}


def test_pre_step_and_progress(spark):
    k = Kernel("halved", lambda i: F.lit(0.0), lambda i: F.lit(1.0), 0.0, F.sum, lambda a, b: a + b, lambda d, v, n, w: d * w, pre_step=lambda i, d, v: d / 2)
    e = spark.createDataFrame([(1, 2, 3.0), (2, 1, None)], "src long, dst long, weight double")
    s = superstep.run_rounds(superstep.prepare(e), k, 1)
    assert {r.id: (r.value, r.delta) for r in s.collect()} == {1: (0.5, 0.0), 2: (0.5, 1.5)}
    assert superstep.progress(s, k).first()[0] == 1.0
    assert set(algorithms.REGISTRY) == {"pagerank", "shortest_paths", "connected_components", "katz"}


def test_shortest_paths_query_goes_to_the_end(spark, tmp_path):
    from deltarill.graph_queries import sssp_user_next

    walk = [*range(40), 0, 39, 5]  # a chain of 39 edges, dear short cuts
    events = [(i, i, u, 500.0 if u in (0, 39) and i >= 39 else 1.0) for i, u in enumerate(walk)]
    spark.createDataFrame(events, "event_id long, ts long, user_id long, value double").withColumn("ts", F.timestamp_seconds("ts")).write.parquet(f"{tmp_path}/events.parquet")
    edges = [(a[2], b[2], a[3]) for a, b in zip(events, events[1:])]
    best = {0: 0.0}
    for _ in range(len(edges)):  # Bellman-Ford
        for a, b, w in edges:
            if a in best and best[a] + w < best.get(b, math.inf):
                best[b] = best[a] + w
    assert max(best.values()) == 39.0 and len(best) == 40
    assert {r.id: r.value for r in sssp_user_next(spark, str(tmp_path)).collect()} == best


def test_a_limit_of_rounds_is_no_silent_end(spark):
    prepared = superstep.prepare(edges_of(spark, [(i, i + 1) for i in range(5)]))
    with pytest.raises(RuntimeError):
        superstep.run_daic(prepared, algorithms.shortest_paths(0), lambda *_: False, limit=2)
    assert superstep.run_daic.__kwdefaults__["limit"] is None


def test_a_hot_source_is_split_in_every_round(spark):
    """Half of all edges have one source: no task gets more than its part of them, in the first round and later."""
    n = 3000
    edges = spark.range(n).select(F.when(F.col("id") % 2 == 0, 1).otherwise(F.col("id") % 200 + 2).alias("src"), (F.col("id") % 211).alias("dst"))
    k = algorithms.pagerank()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        prepared = superstep.prepare(edges)
        assert prepared.where("salt > 0").select("src").distinct().collect() == [(1,)]
        state = superstep.initial(prepared, k)
        for _ in range(3):
            per = [r["count"] for r in superstep.messages(state, prepared, k).groupBy(F.spark_partition_id()).count().collect()]
            assert max(per) <= 0.4 * sum(per) and len(per) == 4
            state = superstep.superstep(state, prepared, k)
        value, delta = daic([tuple(r) for r in edges.collect()], 3)
        got = {r.id: (r.value, r.delta) for r in state.collect()}
        assert set(got) == set(value) and all(got[i] == (pytest.approx(value[i]), pytest.approx(delta[i])) for i in value)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_large_states_are_joined_by_sorting(spark, monkeypatch):
    prepared = superstep.prepare(edges_of(spark, [(1, 2), (2, 3), (3, 1)]))
    plan = lambda: superstep.superstep(superstep.initial(prepared, algorithms.pagerank()), prepared, algorithms.pagerank())._jdf.queryExecution().optimizedPlan().toString()
    assert "shuffle_hash" in plan()
    monkeypatch.setattr(superstep, "HASH_BYTES", 0)
    assert "shuffle_hash" not in plan()


def test_a_limit_may_end_a_run_that_has_not_converged(spark):
    prepared = superstep.prepare(edges_of(spark, [(i, i + 1) for i in range(5)]))
    run = superstep.run_daic(prepared, algorithms.shortest_paths(0), lambda *_: False, limit=2, stop_at_limit=True)
    assert not run.converged and [m["round"] for m in run.metrics] == [1, 2]
    assert superstep.run_daic(prepared, algorithms.shortest_paths(0), lambda *_: False).converged


def test_checks_are_as_rare_as_asked_for_with_a_portion(spark):
    r = random.Random(4)
    pairs = [(i, r.randrange(30)) for i in range(30)] + [(r.randrange(30), r.randrange(30)) for _ in range(60)]
    run = superstep.run_daic(superstep.prepare(edges_of(spark, pairs)), algorithms.pagerank(), terminate.max_rounds(6), portion=0.5, check_every=3, min_rows_for_threshold=5)
    assert [m["round"] for m in run.metrics] == [3, 6] and 0 < run.metrics[1]["updates"] < 30


def test_vertex_data_and_many_messages(spark):
    """First values from the vertices' own data; an edge sends to its end and to the vertex ten further."""
    data = spark.createDataFrame([(1, 5.0), (2, 7.0)], "id long, mass double")
    k = Kernel("spread", lambda i: F.lit(0.0), lambda i: F.coalesce(F.col("mass"), F.lit(0.0)), 0.0, F.sum, lambda a, b: a + b, lambda d, v, n, w: d,
               fan_out=lambda dst, d, v, n, w: F.array(F.struct(dst.alias("dst"), d.alias("m")), F.struct((dst + 10).alias("dst"), (d * 2).alias("m"))))
    ids = spark.createDataFrame([(11,), (12,)], "id long")
    prepared = superstep.prepare(edges_of(spark, [(1, 2), (2, 1)]), ids)
    s = superstep.superstep(superstep.initial(prepared, k, data), prepared, k)
    assert {r.id: (r.value, r.delta) for r in s.collect()} == {1: (5.0, 7.0), 2: (7.0, 5.0), 11: (0.0, 14.0), 12: (0.0, 10.0)}
