import random
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from deltarill.llm import packing


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=80))
def test_best_fit_is_a_packing(sizes):
    where, fills = packing.best_fit(sizes, 50)
    got = Counter()
    for s, b in zip(sizes, where):
        got[b] += s
    assert all(f <= 50 for f in fills) and [got[b] for b in range(len(fills))] == fills
    assert len(fills) <= max(1, 2 * -(-sum(sizes) // 50)) or not sizes


def check(out, items, capacity):
    fill, per, n = Counter(), defaultdict(list), Counter()
    for i, piece, size, box in out:
        if box is not None:
            fill[box] += size
            per[i].append((piece, size))
    assert all(f <= capacity for f in fill.values())
    assert set(fill) == set(range(1, len(fill) + 1))
    want = Counter((i, s) for i, s in items if s is not None and s >= 0)
    for (i, s), k in want.items():
        n[i] += s * k
    assert {i: sum(s for _, s in ps) for i, ps in per.items()} == dict(n)
    return len(fill)


@pytest.mark.parametrize("partitions", [1, 5, 20])
def test_pack(spark, partitions):
    r = random.Random(partitions)
    items = [(i, r.choice([0, 0, 1, 3, 7, 40, 99, 100])) for i in range(800)] + [(9001, 250), (9002, 300), (9003, None), (9004, -5), (9005, 100)]
    df = spark.createDataFrame(items, "piece long, bin int")  # names that the operator uses itself
    out = [tuple(x) for x in packing.pack(df, "piece", "bin", 100, partitions).collect()]
    n = check(out, items, 100)
    assert n <= 1.03 * -(-sum(s for _, s in items if s and s > 0) // 100) + 1
    assert sorted(o for o in out if o[0] in (9003, 9004)) == [(9003, None, None, None), (9004, None, None, None)]
    assert sorted(o[1:3] for o in out if o[0] == 9001) == [(1, 100), (2, 100), (3, 50)]


def test_repeated_rows_and_empty_table(spark, rows):
    df = spark.createDataFrame([(1, 60), (1, 60), (1, 60)], "id long, size int")
    assert len(rows(packing.pack(df, "id", "size", 100))) == 3
    empty = packing.pack(df.limit(0), "id", "size", 100)
    assert empty.count() == 0
    assert packing.report(empty, 100).first().n_containers == 0
    assert packing.report(packing.pack(df, "id", "size", 100), 100).first().least_containers == 2
    with pytest.raises(ValueError):
        packing.pack(df, "id", "size", 0)


def test_many_underfull_containers_stay_in_the_tree(spark, monkeypatch):
    """Items of more than half a container, as many as need several nodes, and as many that fit with them: none is set aside."""
    monkeypatch.setattr(packing, "NODE", 40)
    items = [(i, 60) for i in range(300)] + [(1000 + i, 40) for i in range(300)]
    df = spark.createDataFrame(items, "id long, size int").repartition(1).orderBy("id")
    n = check([tuple(x) for x in packing.pack(df, "id", "size", 100, 10).collect()], items, 100)
    assert n <= 315
    only = items[:300]
    assert check([tuple(x) for x in packing.pack(spark.createDataFrame(only, "id long, size int"), "id", "size", 100, 10).collect()], only, 100) == 300


def test_blocks_of_one_partition_are_merged(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 7)
    items = [(i, 10 + i % 37) for i in range(300)]
    df = spark.createDataFrame(items, "id long, size int")
    assert check([tuple(x) for x in packing.pack(df, "id", "size", 100, 1).collect()], items, 100) <= 1.12 * sum(s for _, s in items) / 100


def test_check_finds_faults(spark):
    items = spark.createDataFrame([(1, 60), (2, 50), (3, 250), (4, None)], "id long, size int")
    good = packing.check(packing.pack(items, "id", "size", 100), items, "id", "size", 100).first()
    assert tuple(good) == (3, 5, 360, 4, 0, 0, 0, 0, True)
    bad = spark.createDataFrame([(1, 1, 60, 1), (2, 1, 50, 1), (3, 1, 100, 2), (3, 2, 100, 5)], "item_id long, piece int, size long, container_id long")
    assert tuple(packing.check(bad, items, "id", "size", 100).first()) == (3, 5, 360, 4, 1, 2, 1, 1, True)
    none = items.limit(0)
    assert tuple(packing.check(packing.pack(none, "id", "size", 100), none, "id", "size", 100).first()) == (0, 0, 0, 0, 0, 0, 0, 0, True)
