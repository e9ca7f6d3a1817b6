"""From a configuration to the result, and what is prepared on the way."""

import pytest
from pyspark.sql import functions as F

from deltarill import run
from deltarill.functions import stats
from deltarill.operators import hot, partition
from deltarill.sources import config, prepared

TEXT = "0\t2 1 2\n1\t1 2\n2\t1 0\n3\t1 0\n# a comment\n4\t3 0\n5\t0\n"


def test_from_configuration_to_result(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text(TEXT)
    (tmp_path / "c.cnf").write_text(f"INPUT={tmp_path}/in\nRESULT={tmp_path}/out\nNSHARDS=auto\nTERMTHRESH=0.0001\n")
    c = config.load(str(tmp_path / "c.cnf"))
    job = run.run(spark, c)
    assert job.run.converged and not job.reused and job.shards == 1 and job.mode == "memory"
    got = dict(r.line.split("\t") for r in run.written(spark, c).collect())
    assert set(got) == {"0", "1", "2", "3", "5"}  # line 4 has a wrong count
    assert float(got["3"]) == pytest.approx(0.2) and sum(map(float, got.values())) == pytest.approx(3.2 + 0.8 * 0.25 - 0.2, abs=1)
    assert run.run(spark, c).reused
    (tmp_path / "in" / "b.txt").write_text("6\t1 0\n")
    assert run.run(spark, c.set("DISABLE-MODTIME-CHECK", "1")).reused
    job = run.run(spark, c.set("NSHARDS", "2"))
    assert not job.reused and job.shards == 2 and "6" in {r.line.split("\t")[0] for r in run.written(spark, c).collect()}
    with pytest.raises(ValueError):
        run.run(spark, c.set("ALGORITHM", "none"))


def test_shards_hold_equal_numbers_of_edges(spark, tmp_path):
    (tmp_path / "a.txt").write_text("".join(f"{s}\t{n} " + " ".join(str(i) for i in range(n)) + "\n" for s, n in ((1, 50), (2, 1), (3, 7), (9, 30))))
    e, reused = prepared.edges(spark, str(tmp_path / "a.txt"), str(tmp_path / "p"), 5)
    per = {r.shard: r["count"] for r in e.groupBy("shard").count().collect()}
    assert not reused and sorted(per) == list(range(5)) and per == dict(enumerate(partition.shard_sizes(88, 5)))
    assert [r.n_edges for r in spark.read.parquet(str(tmp_path / "p" / "shards")).orderBy("shard").collect()] == partition.shard_sizes(88, 5)
    assert prepared.edges(spark, str(tmp_path / "a.txt"), str(tmp_path / "p"), 5)[1]
    assert not prepared.edges(spark, str(tmp_path / "a.txt"), str(tmp_path / "p"), "auto")[1]


@pytest.mark.parametrize("n, shards", [(0, 3), (1, 4), (7, 7), (20, 3), (101, 8)])
def test_every_place_gets_its_shard(spark, n, shards):
    out = partition.equal_edge_shards(spark.range(n), shards, "id").orderBy("id").collect()
    want = [s for s, size in enumerate(partition.shard_sizes(n, shards)) for _ in range(size)]
    assert [r.shard for r in out] == want and [r.idx for r in out] == list(range(n))


def test_hot_keys(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 400, 7).when(F.col("id") < 700, None).otherwise(F.col("id")).alias("k"))
    assert hot.hot_keys(df, "k") == [7]
    assert hot.hot_keys(df.limit(0), "k") == []
    assert hot.hot_keys(spark.range(1000), "id") == []


def test_uniform(spark):
    x = [r.u for r in spark.range(1000).select(stats.uniform(2.0, 4.0, 7).alias("u")).collect()]
    assert 2 <= min(x) and max(x) < 4 and 2.9 < sum(x) / 1000 < 3.1
