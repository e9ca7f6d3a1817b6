import pytest

from deltarill.sources import adjacency, config, prepared, results
from deltarill.streaming import ingest

LINES = ["# c", "% c", "0\t2 1 2", "1\t1 2", "2\t1 0,2.5", "3\t3 0 1", "4\t0", "5\t1 x", "6\t1 0,abc", "", "7 1 0", None, "8", "1\t1 9"]


def lines(spark):
    return spark.createDataFrame([(x,) for x in LINES], "line string")


def test_adjacency(spark, rows):
    df = lines(spark)
    assert rows(adjacency.edges(df)) == sorted([(0, 1, 0.0), (0, 2, 0.0), (1, 2, 0.0), (2, 0, 2.5), (7, 0, 0.0), (1, 9, 0.0)])
    assert rows(adjacency.quarantine(df), "line", "reason") == sorted([("3\t3 0 1", "mismatch"), ("5\t1 x", "neighbour"), ("6\t1 0,abc", "neighbour"), ("8", "count")])
    assert rows(adjacency.vertices(df)) == [(0, 2), (1, 2), (2, 1), (4, 0), (7, 1)]


def test_round_trip(spark, rows):
    e = spark.createDataFrame([(1, 2, 0.5), (1, 2, 0.5), (1, 1, 2.0), (3, 1, 1.0)], "src long, dst long, weight double")
    assert rows(adjacency.edges(adjacency.to_lines(e, weighted=True))) == rows(e)
    assert rows(adjacency.to_lines(e), "line") == [("1\t3 1 2 2",), ("3\t1 1",)]


def test_prepared_edges_are_reused(spark, tmp_path):
    src, base = tmp_path / "g.txt", str(tmp_path / "prepared")
    src.write_text("0\t1 1\n1\t1 0\n")
    assert prepared.prepare(spark, str(src), base, num_shards=2).count() == 2
    assert prepared.is_fresh(spark, str(src), base)
    src.write_text("0\t2 1 2\n1\t1 0\n")
    assert not prepared.is_fresh(spark, str(src), base)
    assert prepared.prepare(spark, str(src), base, num_shards=2, check_time=False).count() == 2
    assert prepared.prepare(spark, str(src), base, num_shards=2).count() == 3
    prepared.delete(spark, base)
    assert prepared.manifest(spark, base) is None


def test_result_sink_and_metadata(spark, tmp_path, rows):
    s = spark.createDataFrame([(1, 0.5, 0.1), (2, 1.0, 0.2)], "id long, value double, delta double")
    results.write_result(s, str(tmp_path / "out"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == ["1\t0.5", "2\t1.0"]
    assert results.totals(s).first().sum_value == 1.5
    e = spark.createDataFrame([(0, 5, 0), (2, 1, 1)], "src long, dst long, shard int")
    results.write_metadata(e, e, str(tmp_path / "meta"))
    assert rows(spark.read.parquet(str(tmp_path / "meta/summary"))) == [(2, 5, 6)]


def test_config(tmp_path):
    f = tmp_path / "a.cnf"
    f.write_text("# c\n% c\n TERMTHRESH = 0.01 \nNSHARDS=4\nDISABLE-MODTIME-CHECK=1\nUNKNOWN=2\nPORTION=0.2\nMENBUDGET_MB=48\nnothing\n")
    c = config.load(str(f))
    assert (c.tolerance, c.num_shards, c.reuse_prepared, c.portion, c.budget_mb) == (0.01, "4", True, 0.2, 48)
    assert c.set("PORTION", "1").portion == 1 and c.portion == 0.2
    with pytest.raises(ValueError):
        config.parse("PORTION=0")


def test_stream(spark, tmp_path, rows):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.txt").write_text("0\t1 1\nbad\n")
    stream = spark.readStream.text(str(src)).withColumnRenamed("value", "line")
    for name in (None, "b.txt"):
        if name:
            (src / name).write_text("2\t2 0 1\n")
        ingest.append_edges(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "out")), "src", "dst") == [(0, 1), (2, 0), (2, 1)]
    assert spark.read.parquet(str(tmp_path / "out_quarantine")).count() == 1


def test_windowed_edges(spark, rows):
    e = spark.sql("select * from values (timestamp'2024-01-01 00:01:00'), (timestamp'2024-01-01 00:04:00'), (timestamp'2024-01-01 00:06:00') t(at)")
    assert [r.n_edges for r in ingest.windowed_edges(e, "at", "5 minutes", "1 minute").orderBy("start").collect()] == [2, 1]
