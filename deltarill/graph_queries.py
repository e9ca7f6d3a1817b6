"""Queries of the graph engine, with SQL. Fixed numbers of rounds are checked with recursive SQL; values are rounded to 6 places."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltarill import graph
from deltarill import run as run_module
from deltarill.functions import stats, strings
from deltarill.operators import partition, state
from deltarill.plans import algorithms, schedule, superstep, terminate
from deltarill.session import materialize, shared_dir
from deltarill.sources import adjacency, config, prepared, results

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


# fixed SQL of the graphs
SUPP_PART = """p AS (SELECT DISTINCT l_suppkey * 2 AS s, l_partkey * 2 + 1 AS p FROM lineitem),
e AS (SELECT s AS src, p AS dst, 1.0 AS weight FROM p UNION ALL SELECT p, s, 1.0 FROM p)"""
USER_NEXT = """e AS (SELECT * FROM (SELECT user_id AS src, lead(user_id) OVER (ORDER BY ts, event_id) AS dst, value AS weight FROM events) WHERE dst IS NOT NULL)"""
NATION_TRADE = """e AS (SELECT CAST(c_nationkey AS BIGINT) AS src, CAST(s_nationkey AS BIGINT) AS dst, sum(l_extendedprice) AS weight FROM lineitem
JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)"""
CUSTOMER_NATION = "e AS (SELECT c_custkey * 2 AS src, CAST(c_nationkey AS BIGINT) * 2 + 1 AS dst, 1.0 AS weight FROM customer)"


def _pagerank_sql(edges: str, rounds: int, tail: str, sinks: str = "add") -> str:
    ids = "SELECT src AS id FROM e UNION SELECT dst FROM e" if sinks == "add" else "SELECT DISTINCT src AS id FROM e"
    drop = "" if sinks == "add" else "WHERE dst IN (SELECT src FROM e)"
    return f"""WITH RECURSIVE {edges}, deg AS (SELECT src, count(*) AS n FROM e GROUP BY 1), w AS (SELECT e.src, e.dst, deg.n FROM e JOIN deg USING (src) {drop}),
ids AS ({ids}), r(i, id, delta) AS (SELECT 0, id, CAST(0.2 AS DOUBLE) FROM ids UNION ALL
SELECT i + 1, dst, s FROM (SELECT r.i, w.dst, sum(r.delta * 0.8 / w.n) AS s FROM r JOIN w ON r.id = w.src WHERE r.i < {rounds} GROUP BY r.i, w.dst))
{tail}"""


_VALUES = "SELECT id, round(sum(delta) FILTER (i < {k}), 6) AS value FROM r GROUP BY id"


def _ranked(spark: SparkSession, edges: DataFrame, rounds: int, missing: str = "add") -> DataFrame:
    prepared = superstep.prepare(edges, missing=missing)
    return superstep.run_rounds(prepared, algorithms.pagerank(), rounds)


def _rounded(s: DataFrame) -> DataFrame:
    return s.select("id", F.round("value", 6).alias("value"))


@query(_pagerank_sql(SUPP_PART, 9, _VALUES.format(k=10)))
def pagerank_supp_part_k10(spark: SparkSession, d: str) -> DataFrame:
    """Ten rounds over the supplier-part graph."""
    return _rounded(_ranked(spark, graph.supp_part(spark, d), 10))


@query(_pagerank_sql(USER_NEXT, 9, _VALUES.format(k=10)))
def pagerank_user_next_k10(spark: SparkSession, d: str) -> DataFrame:
    """Ten rounds with parallel edges and self-loops."""
    return _rounded(_ranked(spark, graph.user_next(spark, d), 10))


@query(_pagerank_sql(CUSTOMER_NATION, 3, _VALUES.format(k=4)))
def pagerank_sinks_added(spark: SparkSession, d: str) -> DataFrame:
    """Destinations without edges get a row and send nothing."""
    return _rounded(_ranked(spark, graph.customer_nation(spark, d), 4))


@query(_pagerank_sql(CUSTOMER_NATION, 3, _VALUES.format(k=4), "drop"))
def pagerank_sinks_dropped(spark: SparkSession, d: str) -> DataFrame:
    """Messages to destinations without a row are lost."""
    return _rounded(_ranked(spark, graph.customer_nation(spark, d), 4, "drop"))


@query(_pagerank_sql(SUPP_PART, 5, "SELECT round(sum(delta) FILTER (i = 5), 5) AS sum_delta, round(sum(delta) FILTER (i < 5), 5) AS sum_value FROM r"))
def pagerank_totals(spark: SparkSession, d: str) -> DataFrame:
    """Sums of deltas and values after five rounds."""
    return results.totals(_ranked(spark, graph.supp_part(spark, d), 5)).select(F.round("sum_delta", 5).alias("sum_delta"), F.round("sum_value", 5).alias("sum_value"))


def _progress_sql(edges: str, rounds: int) -> str:
    """``prog(round, progress, updates)`` of full rounds."""
    return _pagerank_sql(edges, rounds - 1, "").rstrip() + f""", per AS (SELECT i + 1 AS round, sum(delta) AS d, count(*) AS updates FROM r WHERE i < {rounds} GROUP BY i),
prog AS (SELECT round, sum(d) OVER (ORDER BY round) AS progress, updates FROM per)"""


@query(_progress_sql(USER_NEXT, 12) + """
SELECT CAST(round AS INT) AS round, round(progress, 5) AS progress, round(abs(progress - lag(progress) OVER (ORDER BY round)), 5) AS diff,
CAST(updates AS BIGINT) AS updates, round = 12 AS terminated FROM prog""")
def pagerank_progress(spark: SparkSession, d: str) -> DataFrame:
    """Progress, its change, updates and the end, per round, with a limit of 12 rounds."""
    prepared = superstep.prepare(graph.user_next(spark, d))
    stop = terminate.any_of(terminate.diff(1e-9), terminate.max_rounds(12))
    run = superstep.run_daic(prepared, algorithms.pagerank(), stop)
    return spark.createDataFrame(run.metrics, "round int, progress double, diff double, updates long, terminated boolean").select(
        "round", F.round("progress", 5).alias("progress"), F.round("diff", 5).alias("diff"), "updates", "terminated"
    )


@query(f"""WITH {SUPP_PART}, deg AS (SELECT src, count(*) AS n FROM e GROUP BY 1),
s1 AS (SELECT dst AS id, CAST(0.2 AS DOUBLE) AS value, round(sum(0.2 * 0.8 / n), 9) AS delta FROM e JOIN deg USING (src) GROUP BY dst),
cut AS (SELECT percentile_disc(0.8) WITHIN GROUP (ORDER BY delta) AS c, max(delta) AS m, count(*) AS n FROM s1),
st AS (SELECT id, value, delta, CASE WHEN n <= 1000 THEN true WHEN c = m THEN delta >= c ELSE delta > c END AS runs FROM s1, cut),
msg AS (SELECT e.dst AS id, sum(st.delta * 0.8 / deg.n) AS m FROM e JOIN st ON e.src = st.id JOIN deg ON deg.src = e.src WHERE st.runs GROUP BY 1)
SELECT st.id, round(value + CASE WHEN runs THEN delta ELSE 0 END, 6) AS value, round(CASE WHEN runs THEN 0 ELSE delta END + coalesce(m, 0), 6) AS delta
FROM st LEFT JOIN msg USING (id)""")
def scheduled_round(spark: SparkSession, d: str) -> DataFrame:
    """A second round in which only the fifth of highest priority runs, by an exact cut."""
    prepared = superstep.prepare(graph.supp_part(spark, d))
    k = algorithms.pagerank()
    s = superstep.run_rounds(prepared, k, 1).select("id", "value", F.round("delta", 9).alias("delta"))
    s = superstep.materialize(s)
    out = superstep.superstep(s, prepared, k, schedule.threshold(s, k, 0.2, exact=True))
    return out.select("id", F.round("value", 6).alias("value"), F.round("delta", 6).alias("delta"))


_CHECKS = """, c AS (SELECT *, abs(progress - lag(progress) OVER (ORDER BY round)) AS diff FROM prog WHERE round % 4 = 0),
stop AS (SELECT min(round) AS last FROM c WHERE diff <= 0.05)"""


@query(_progress_sql(USER_NEXT, 96) + _CHECKS + """
SELECT CAST(round AS INT) AS round, round(progress, 4) AS progress, round(diff, 4) AS diff, round = last AS terminated FROM c, stop WHERE round <= last""")
def diff_stop(spark: SparkSession, d: str) -> DataFrame:
    """A run that its change of progress ends, looked at every fourth round."""
    run = superstep.run_daic(superstep.prepare(graph.user_next(spark, d)), algorithms.pagerank(), terminate.diff(0.05), check_every=4)
    return spark.createDataFrame(run.metrics, "round int, progress double, diff double, updates long, terminated boolean").select(
        "round", F.round("progress", 4).alias("progress"), F.round("diff", 4).alias("diff"), "terminated"
    )


@query(_pagerank_sql(NATION_TRADE, 31, "SELECT id, round(sum(delta) FILTER (i < 32), 4) AS value, true AS reached FROM r GROUP BY id"))
def daic_portion(spark: SparkSession, d: str) -> DataFrame:
    """Full rounds, and whether a run in which only the half of highest priority is scheduled, until its progress stands, reaches the same."""
    prepared, k = superstep.prepare(graph.nation_trade(spark, d)), algorithms.pagerank()
    full = superstep.run_rounds(prepared, k, 32)
    run = superstep.run_daic(prepared, k, terminate.diff(0.05), portion=0.5, check_every=8, min_rows_for_threshold=5, exact_threshold=True)
    some = run.state.select("id", F.col("value").alias("scheduled"))
    return full.join(some, "id").select("id", F.round("value", 4).alias("value"), (F.abs(F.col("value") - F.col("scheduled")) < 0.02).alias("reached"))


def _base(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/deltarill-query-{uuid.uuid4().hex}"


_EQUAL_SQL = """q AS (SELECT *, row_number() OVER (ORDER BY src, dst) - 1 AS idx FROM e), n AS (SELECT count(*) AS m FROM q),
z(done, taken, size) AS (SELECT 0, CAST(0 AS BIGINT), m // 5 + 1 FROM n UNION ALL SELECT done + 1, taken + size, (m - taken - size) // (5 - done - 1) FROM z, n WHERE done < 4)"""


@query(f"""WITH RECURSIVE {SUPP_PART}, {_EQUAL_SQL}, s AS (SELECT q.*, z.done AS shard FROM q JOIN z ON idx >= taken AND idx < taken + size),
runs AS (SELECT * FROM (VALUES (1, false), (2, true), (3, false), (4, true)) t(run, reused))
SELECT run, reused, CAST(shard AS INT) AS shard, count(*) AS n_edges, min(src) AS first_src, max(src) AS last_src FROM s, runs GROUP BY ALL""")
def prepared_reuse(spark: SparkSession, d: str) -> DataFrame:
    """Equal-edge shards written, found again, written anew once the text has changed its time, and taken as they are when told not to look."""
    base = _base(spark)
    lines = adjacency.to_lines(graph.supp_part(spark, d)).select("line")
    out = None
    for run, look in enumerate((True, True, True, False), 1):
        if run != 2:
            lines.write.mode("overwrite").text(f"{base}/text")
        e, reused = prepared.edges(spark, f"{base}/text", f"{base}/prepared", 5, check_time=look)
        one = materialize(e.groupBy("shard").agg(F.count("*").alias("n_edges"), F.min("src").alias("first_src"), F.max("src").alias("last_src")).select(
            F.lit(run).alias("run"), F.lit(reused).alias("reused"), F.col("shard").cast("int").alias("shard"), "n_edges", "first_src", "last_src"))
        out = one if out is None else out.unionByName(one)
    prepared.delete(spark, base)
    return out


@query(_progress_sql(USER_NEXT, 96) + _CHECKS + """
SELECT r.id, round(sum(r.delta), 3) AS value, CAST(max(last) AS INT) AS rounds, 2 AS shards, true AS converged FROM r, stop WHERE r.i < last GROUP BY r.id""")
def config_run(spark: SparkSession, d: str) -> DataFrame:
    """From a configuration to the lines of the result: text prepared in two shards, run until progress stands, dumped and read again."""
    base = _base(spark)
    adjacency.to_lines(graph.user_next(spark, d)).select("line").write.text(f"{base}/text")
    c = config.parse(f"# a run\nALGORITHM=pagerank\nINPUT={base}/text\nRESULT={base}/result\nNSHARDS=2\nTERMTHRESH = 0.05\nTERMCHECKINTERVAL=4\n")
    job = run_module.run(spark, c)
    line = F.split("line", "\t")
    out = run_module.written(spark, c).select(
        line[0].cast("long").alias("id"), F.round(line[1].cast("double"), 3).alias("value"), F.lit(job.run.metrics[-1]["round"]).alias("rounds"),
        F.lit(job.shards).alias("shards"), F.lit(job.run.converged).alias("converged"))
    prepared.delete(spark, base)
    return out


@query(_pagerank_sql(SUPP_PART, 9, "SELECT CAST(id AS VARCHAR) || chr(9) || format('{:.4f}', round(sum(delta) FILTER (i < 10), 4)) AS line FROM r GROUP BY id"))
def result_dump(spark: SparkSession, d: str) -> DataFrame:
    """The result sink's lines."""
    s = _ranked(spark, graph.supp_part(spark, d), 10)
    return results.result_lines(s.select("id", F.round("value", 4).alias("value")), digits=4)


# --- other kernels


@query(f"""WITH RECURSIVE {USER_NEXT}, w AS (SELECT src, dst, min(weight) AS weight FROM e WHERE src <> dst AND weight IS NOT NULL AND weight >= 0 GROUP BY 1, 2),
first AS (SELECT min(src) AS s FROM w), size AS (SELECT count(*) AS n FROM (SELECT src FROM w UNION SELECT dst FROM w)),
r(i, id, d) AS (SELECT 0, s, CAST(0 AS DOUBLE) FROM first UNION ALL
SELECT i + 1, dst, m FROM (SELECT r.i, w.dst, min(r.d + w.weight) AS m FROM r JOIN w ON r.id = w.src WHERE r.i < (SELECT n FROM size) GROUP BY r.i, w.dst))
SELECT id, round(min(d), 6) AS value FROM r GROUP BY id""")
def sssp_user_next(spark: SparkSession, d: str) -> DataFrame:
    """Shortest paths from the user of least id, run until nothing is pending; the SQL follows as many edges as there are vertices, which no shortest path exceeds."""
    e = graph.user_next(spark, d).where("src <> dst and weight >= 0").groupBy("src", "dst").agg(F.min("weight").alias("weight"))
    prepared = superstep.prepare(e)
    source = prepared.where("not self").agg(F.min("src")).first()[0]
    kernel = algorithms.shortest_paths(-1 if source is None else source)
    s = superstep.run_daic(prepared, kernel, lambda before, now, round_: False, check_every=4).state
    return s.where("value < double('inf')").select("id", F.round("value", 6).alias("value"))


@query(f"""WITH RECURSIVE {SUPP_PART}, r(i, id, c) AS (SELECT 0, src, src FROM (SELECT DISTINCT src FROM e) UNION ALL
SELECT i + 1, dst, m FROM (SELECT r.i, e.dst, max(r.c) AS m FROM r JOIN e ON r.id = e.src WHERE r.i < 8 GROUP BY r.i, e.dst))
SELECT id, CAST(max(c) AS DOUBLE) AS value FROM r GROUP BY id""")
def wcc_supp_part(spark: SparkSession, d: str) -> DataFrame:
    """Connected components, run until nothing is pending."""
    prepared = superstep.prepare(graph.supp_part(spark, d))
    run = superstep.run_daic(prepared, algorithms.connected_components(), lambda before, now, round_: False)
    return run.state.select("id", "value")


@query(f"""WITH RECURSIVE {NATION_TRADE}, w AS (SELECT src, dst, weight / (SELECT max(weight) FROM e) AS weight FROM e),
r(i, id, delta) AS (SELECT 0, min(src), CAST(1 AS DOUBLE) FROM w UNION ALL
SELECT i + 1, dst, s FROM (SELECT r.i, w.dst, sum(0.05 * w.weight * r.delta) AS s FROM r JOIN w ON r.id = w.src WHERE r.i < 5 GROUP BY r.i, w.dst)),
ids AS (SELECT src AS id FROM w UNION SELECT dst FROM w)
SELECT ids.id, round(coalesce(sum(delta), 0), 6) AS value FROM ids LEFT JOIN r ON r.id = ids.id GROUP BY ids.id""")
def katz_nation_trade(spark: SparkSession, d: str) -> DataFrame:
    """Katz centrality from the first nation, six rounds over normalised weights."""
    e = graph.nation_trade(spark, d)
    most = e.agg(F.max("weight"), F.min("src")).first()
    prepared = superstep.prepare(e.withColumn("weight", F.col("weight") / F.lit(most[0])))
    return _rounded(superstep.run_rounds(prepared, algorithms.katz(most[1], 0.05), 6))


# --- sources

#: fixed value: small lines of every kind
BAD_LINES = ["# c", "% c", "0\t2 1 2", "1\t1 2", "2\t1 0,2.5", "3\t3 0 1", "4\t0", "5\t1 x", "6\t1 0,abc", "", "7 1 0"]
_BAD_SQL = "(VALUES " + ", ".join("('" + x.replace("\t", "' || chr(9) || '") + "')" for x in BAD_LINES) + ") t(line)"
_PARSE_SQL = r"""rec AS (SELECT *, list_filter(regexp_split_to_array(line, '[ \t\r\n]+'), lambda x: x <> '') AS t FROM {src}
  WHERE line IS NOT NULL AND NOT regexp_matches(line, '^[#%]') AND regexp_matches(line, '\S')),
parsed AS (SELECT *, t[3:] AS nb, CASE WHEN NOT regexp_full_match(t[1], '[0-9]{1,18}') THEN 'src'
  WHEN t[2] IS NULL OR NOT regexp_full_match(t[2], '[0-9]{1,18}') THEN 'count'
  WHEN len(list_filter(t[3:], lambda x: NOT regexp_full_match(x, '[0-9]{1,18}(,[-+]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][-+]?[0-9]+)?)?'))) > 0 THEN 'neighbour'
  WHEN CAST(t[2] AS BIGINT) <> len(t) - 2 THEN 'mismatch' END AS reason FROM rec)"""


def _parse_sql(src: str) -> str:
    return _PARSE_SQL.replace("{src}", src)


_RAW_SQL = "(SELECT line_id, line_text AS line FROM raw_lines WHERE feed = 'input_graph') q"


def _raw(spark: SparkSession, d: str) -> DataFrame:
    return graph.table(spark, d, "raw_lines").where("feed = 'input_graph'").select("line_id", F.col("line_text").alias("line"))


@query(f"WITH {SUPP_PART} SELECT src, dst, CAST(0 AS DOUBLE) AS weight FROM e")
def adj_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Edges to adjacency text and back."""
    return adjacency.edges(adjacency.to_lines(graph.supp_part(spark, d)))


@query(f"WITH {SUPP_PART} SELECT src, CAST(src AS VARCHAR) || chr(9) || count(*) || ' ' || string_agg(dst, ' ' ORDER BY dst) AS line FROM e GROUP BY src")
def adj_lines(spark: SparkSession, d: str) -> DataFrame:
    """The adjacency text itself."""
    return adjacency.to_lines(graph.supp_part(spark, d))


@query(f"WITH {_parse_sql(_BAD_SQL)} SELECT line, try_cast(t[2] AS BIGINT) AS declared, CAST(greatest(len(t) - 2, 0) AS BIGINT) AS parsed, reason FROM parsed WHERE reason IS NOT NULL")
def adj_quarantine(spark: SparkSession, d: str) -> DataFrame:
    """What is kept aside of small lines of every kind."""
    return adjacency.quarantine(spark.createDataFrame([(x,) for x in BAD_LINES], "line string"))


@query(f"WITH {_parse_sql(_RAW_SQL)} SELECT line_id, reason FROM parsed WHERE reason IS NOT NULL")
def adj_quarantine_raw(spark: SparkSession, d: str) -> DataFrame:
    """What the blank-tolerant reader keeps aside of the raw records (it knows no quotes)."""
    return adjacency.parsed(_raw(spark, d)).where("reason is not null").select("line_id", "reason")


@query(r"SELECT line_id FROM raw_lines WHERE line_text IS NOT NULL AND NOT regexp_matches(line_text, '^[#%]') AND regexp_matches(line_text, '\S')")
def adj_comments(spark: SparkSession, d: str) -> DataFrame:
    """The raw rows that are records."""
    return adjacency.drop_comments(graph.table(spark, d, "raw_lines"), "line_text").select("line_id")


@query(f"""WITH {_parse_sql(_RAW_SQL)}, n AS (SELECT CAST(t[1] AS BIGINT) AS src, unnest(nb) AS x FROM parsed WHERE reason IS NULL)
SELECT src, CAST(split_part(x, ',', 1) AS BIGINT) AS dst, CASE WHEN contains(x, ',') THEN CAST(split_part(x, ',', 2) AS DOUBLE) ELSE 0 END AS weight FROM n""")
def adj_weighted(spark: SparkSession, d: str) -> DataFrame:
    """The weighted edges of the raw records."""
    return adjacency.edges(_raw(spark, d))


@query(f"WITH {_parse_sql(_RAW_SQL)} SELECT CAST(t[1] AS BIGINT) AS id, CAST(sum(len(nb)) AS BIGINT) AS degree FROM parsed WHERE reason IS NULL GROUP BY 1")
def adj_vertices(spark: SparkSession, d: str) -> DataFrame:
    """Sources with their degrees, sinks included."""
    return adjacency.vertices(_raw(spark, d))


@query("SELECT src, dst FROM edge_with_value WHERE src IS NOT NULL AND dst IS NOT NULL UNION ALL SELECT l_suppkey, l_partkey FROM lineitem")
def edge_union_all(spark: SparkSession, d: str) -> DataFrame:
    """Edge sets one after the other, repeats kept."""
    li = graph.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"))
    return graph.vertex_edges(spark, d).select("src", "dst").unionByName(li)


@query("SELECT src, dst, try_cast(value AS DOUBLE) AS weight FROM edge_with_value WHERE src IS NOT NULL AND dst IS NOT NULL")
def edge_projection(spark: SparkSession, d: str) -> DataFrame:
    """Edges with their payload as a weight."""
    return graph.vertex_edges(spark, d)


# --- summaries and sharding


@query("SELECT src, count(*) AS n FROM edge_with_value WHERE src IS NOT NULL AND dst IS NOT NULL GROUP BY src")
def out_degree(spark: SparkSession, d: str) -> DataFrame:
    return results.out_degrees(graph.vertex_edges(spark, d))


@query("SELECT count(*) AS n_edges, max(greatest(src, dst)) AS max_id, max(greatest(src, dst)) + 1 AS n_vertices_dense FROM edge_with_value WHERE src IS NOT NULL AND dst IS NOT NULL")
def graph_summary(spark: SparkSession, d: str) -> DataFrame:
    return results.summary(graph.vertex_edges(spark, d))


SHARDS = 7
_SHARD_SQL = f"""WITH q AS (SELECT src, dst, edge_id, row_number() OVER (ORDER BY src, edge_id) - 1 AS idx FROM edge_with_value WHERE src IS NOT NULL AND dst IS NOT NULL),
n AS (SELECT count(*) AS e FROM q),
z(done, taken, size) AS (SELECT 0, CAST(0 AS BIGINT), e // {SHARDS} + 1 FROM n UNION ALL
SELECT done + 1, taken + size, (e - taken - size) // ({SHARDS} - done - 1) FROM z, n WHERE done < {SHARDS} - 1),
s AS (SELECT q.*, z.done AS shard FROM q JOIN z ON idx >= taken AND idx < taken + size)"""


def _sharded(spark: SparkSession, d: str) -> DataFrame:
    e = graph.table(spark, d, "edge_with_value").where("src is not null and dst is not null").select("src", "dst", "edge_id")
    return partition.equal_edge_shards(e, SHARDS, "src", "edge_id")


@query(_SHARD_SQL.replace("WITH", "WITH RECURSIVE", 1) + " SELECT CAST(shard AS INT) AS shard, count(*) AS n_edges FROM s GROUP BY shard")
def shard_counts(spark: SparkSession, d: str) -> DataFrame:
    return _sharded(spark, d).groupBy("shard").agg(F.count("*").alias("n_edges"))


@query(_SHARD_SQL.replace("WITH", "WITH RECURSIVE", 1) + " SELECT CAST(shard AS INT) AS shard, max(src) AS last_src FROM s GROUP BY shard")
def shard_intervals(spark: SparkSession, d: str) -> DataFrame:
    return _sharded(spark, d).groupBy("shard").agg(F.max("src").alias("last_src"))


@query("""SELECT CAST(floor(1 + n * 12 / (mb * 1048576.0 / 8) + 0.5) AS INT) AS shards, mb FROM (SELECT count(*) AS n FROM edge_with_value WHERE src IS NOT NULL AND dst IS NOT NULL), (VALUES (1), (48), (1024)) t(mb)""")
def auto_shards(spark: SparkSession, d: str) -> DataFrame:
    n = graph.vertex_edges(spark, d).count()
    return spark.createDataFrame([(partition.auto_shards(n, 4, mb), mb) for mb in (1, 48, 1024)], "shards int, mb int")


@query("""SELECT mb, 2 * v * 4 + e * 4 + 2 * v * 4 + v * 4 < mb * 1048576.0 / 3 * 4 AS fits FROM (SELECT count(*) AS e, max(greatest(src, dst)) + 1 AS v FROM edge_with_value WHERE src IS NOT NULL AND dst IS NOT NULL), (VALUES (1), (48), (1024)) t(mb)""")
def memory_mode(spark: SparkSession, d: str) -> DataFrame:
    s = results.summary(graph.vertex_edges(spark, d)).first()
    return spark.createDataFrame([(mb, partition.fits_in_memory(s.n_vertices_dense, s.n_edges, mb)) for mb in (1, 48, 1024)], "mb int, fits boolean")


@query("SELECT edge_id, src % 8 AS shard FROM edge_with_value WHERE src IS NOT NULL")
def shard_mod_int(spark: SparkSession, d: str) -> DataFrame:
    return graph.table(spark, d, "edge_with_value").where("src is not null").select("edge_id", partition.mod_int(F.col("src"), 8).alias("shard"))


@query("SELECT shovel_id, try_cast(split_part(CAST(shovel_id AS VARCHAR) || '_' || shovelname, '_', 1) AS INT) % 5 AS shard FROM shard_flushinfo")
def shard_mod_str(spark: SparkSession, d: str) -> DataFrame:
    key = F.concat_ws("_", F.col("shovel_id").cast("string"), F.coalesce("shovelname", F.lit("")))
    return graph.table(spark, d, "shard_flushinfo").select("shovel_id", partition.mod_str(key, 5).alias("shard"))


@query("SELECT src, count(*) AS n_edges, 1::BIGINT AS n_shards, true AS in_range, true AS spread FROM edge_with_value WHERE src IS NOT NULL GROUP BY src")
def shard_mod_hash(spark: SparkSession, d: str) -> DataFrame:
    """Shards by a hash of the source: all edges of a source in one, numbers in range, and no shard with more than twice its share of the sources."""
    e = graph.table(spark, d, "edge_with_value").where("src is not null").select("src", partition.mod_hash(F.col("src"), 4).alias("shard"))
    per = e.groupBy("src").agg(F.count("*").alias("n_edges"), F.count_distinct("shard").alias("n_shards"), F.min("shard").alias("lo"), F.max("shard").alias("hi"))
    fullest = per.groupBy("lo").agg(F.count("*").alias("n")).agg(F.max("n"), F.sum("n")).first()
    return per.select("src", "n_edges", "n_shards", ((F.col("lo") >= 0) & (F.col("hi") < 4)).alias("in_range"), F.lit((fullest[0] or 0) <= 2 * (fullest[1] or 0) / 4).alias("spread"))


@query("SELECT src, dst, edge_id, CAST(row_number() OVER (ORDER BY dst, src, edge_id) - 1 AS BIGINT) AS idx FROM edge_with_value WHERE src IS NOT NULL AND dst IS NOT NULL")
def edge_order(spark: SparkSession, d: str) -> DataFrame:
    """The place of every edge by destination, then source."""
    e = graph.table(spark, d, "edge_with_value").where("src is not null and dst is not null").select("src", "dst", "edge_id")
    return partition.with_index(e, "dst", "src", "edge_id").select("src", "dst", "edge_id", "idx")


# --- the state table

_LATEST = """latest AS (SELECT * FROM (SELECT k, edge_count AS degree, value, delta, priority, row_number() OVER (PARTITION BY k ORDER BY put_at DESC, slot_id DESC) AS r
FROM state_bucket WHERE k IS NOT NULL {more}) WHERE r = 1)"""


def _latest(spark: SparkSession, d: str, where: str = "true") -> DataFrame:
    b = graph.table(spark, d, "state_bucket").where(where).select("k", "slot_id", "put_at", F.col("edge_count").alias("degree"), "value", "delta", "priority")
    return state.latest(b, "k", "put_at", "slot_id").select("k", "degree", "value", "delta", "priority")


@query(f"WITH {_LATEST.format(more='')} SELECT k, degree, value, delta, priority FROM latest")
def state_put(spark: SparkSession, d: str) -> DataFrame:
    """The row last put of each vertex."""
    return _latest(spark, d)


@query(f"""WITH {_LATEST.format(more="AND put_at < TIMESTAMP '2024-02-01'")}, l2 AS (SELECT * FROM (SELECT k, edge_count AS degree, value, delta, priority,
row_number() OVER (PARTITION BY k ORDER BY put_at DESC, slot_id DESC) AS r FROM state_bucket WHERE k IS NOT NULL AND put_at >= TIMESTAMP '2024-02-01') WHERE r = 1)
SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN b.degree ELSE a.degree END AS degree, CASE WHEN b.k IS NULL THEN a.value ELSE b.value END AS value,
CASE WHEN b.k IS NULL THEN a.delta ELSE b.delta END AS delta, CASE WHEN b.k IS NULL THEN a.priority ELSE b.priority END AS priority FROM latest a FULL JOIN l2 b ON a.k = b.k""")
def state_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Later rows into an earlier state: new keys come in, known ones are replaced but for their degree."""
    split = "timestamp'2024-02-01 00:00:00'"
    return state.put(_latest(spark, d, f"put_at < {split}"), _latest(spark, d, f"put_at >= {split}"), "k", ["degree"])


@query(f"WITH {_LATEST.format(more='')} SELECT k, degree, value, delta, priority FROM latest WHERE k IN (SELECT dst FROM edge_with_value)")
def state_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The rows of the vertices that edges point to."""
    return state.lookup(_latest(spark, d), graph.table(spark, d, "edge_with_value").select(F.col("dst").alias("k")), "k")


@query("SELECT dst AS k, coalesce(dst IN (SELECT k FROM state_bucket WHERE k IS NOT NULL), false) AS found FROM (SELECT DISTINCT dst FROM edge_with_value)")
def state_contains(spark: SparkSession, d: str) -> DataFrame:
    return state.contains(graph.table(spark, d, "state_bucket"), graph.table(spark, d, "edge_with_value").select(F.col("dst").alias("k")), "k")


@query(f"WITH {_LATEST.format(more='')} SELECT k, degree, value, CASE WHEN priority > 0.05 THEN 0 ELSE delta END AS delta, CASE WHEN priority > 0.05 THEN 0 ELSE priority END AS priority FROM latest")
def state_update(spark: SparkSession, d: str) -> DataFrame:
    """Deltas and priorities of the vertices of high priority reset."""
    return state.update_delta(_latest(spark, d), algorithms.pagerank(), F.col("priority") > 0.05)


@query(f"""WITH {_LATEST.format(more='')}, m AS (SELECT dst, sum(1.0) AS m FROM edge_with_value WHERE dst IS NOT NULL GROUP BY dst)
SELECT k, degree, round(value, 6) AS value, round(CASE WHEN m IS NULL THEN delta ELSE delta + m END, 6) AS delta, round(CASE WHEN m IS NULL THEN priority ELSE delta + m END, 6) AS priority
FROM latest LEFT JOIN m ON k = dst""")
def state_accumulate_delta(spark: SparkSession, d: str) -> DataFrame:
    """A message of 1 along every edge, combined into the deltas."""
    m = graph.table(spark, d, "edge_with_value").select(F.col("dst").alias("k"), F.lit(1.0).alias("m"))
    s = state.accumulate_delta(_latest(spark, d), m, algorithms.pagerank(), "k")
    return s.select("k", "degree", *[F.round(c, 6).alias(c) for c in ("value", "delta", "priority")])


@query(f"WITH {_LATEST.format(more='')} SELECT k, degree, round(value + delta, 6) AS value, delta, priority FROM latest")
def state_accumulate_value(spark: SparkSession, d: str) -> DataFrame:
    return state.accumulate_value(_latest(spark, d), algorithms.pagerank()).withColumn("value", F.round("value", 6)).select("k", "degree", "value", "delta", "priority")


@query(f"WITH {_LATEST.format(more='')} SELECT k, degree, value, delta, priority FROM latest WHERE k NOT IN (SELECT k FROM state_bucket WHERE removed_at IS NOT NULL AND k IS NOT NULL)")
def state_remove(spark: SparkSession, d: str) -> DataFrame:
    return state.remove(_latest(spark, d), graph.table(spark, d, "state_bucket").where("removed_at is not null").select("k"), "k")


@query("SELECT round(sum(value) FILTER (value <> 0), 4) AS progress FROM state_bucket WHERE k IS NOT NULL")
def state_progress(spark: SparkSession, d: str) -> DataFrame:
    """The sum of the values that are not the identity."""
    s = graph.table(spark, d, "state_bucket").where("k is not null").select("value", "delta")
    return superstep.progress(s, algorithms.pagerank()).select(F.round("progress", 4).alias("progress"))


# --- helpers


@query("""SELECT CAST(CASE WHEN v < 1e-9 THEN 0 ELSE 1 + floor(ln(v / 1e-9 + 1.1) / ln(1.1)) END AS BIGINT) AS bucket, count(*) AS n
FROM (SELECT priority AS v FROM state_bucket WHERE priority IS NOT NULL) GROUP BY 1""")
def log_histogram(spark: SparkSession, d: str) -> DataFrame:
    return stats.log_histogram(graph.table(spark, d, "state_bucket"), "priority")


@query("SELECT key, sum(value) AS value FROM (SELECT event_type AS key, CAST(1 AS DOUBLE) AS value FROM events UNION ALL SELECT o_orderstatus, CAST(2 AS DOUBLE) FROM orders) GROUP BY key")
def stats_merge(spark: SparkSession, d: str) -> DataFrame:
    a = graph.table(spark, d, "events").select(F.col("event_type").alias("key"), F.lit(1.0).alias("value"))
    b = graph.table(spark, d, "orders").select(F.col("o_orderstatus").alias("key"), F.lit(2.0).alias("value"))
    return stats.merge_stats(a, b)


@query(r"""WITH q AS (SELECT shovel_id, ' ' || coalesce(shovelname, '') || '; ' AS s FROM shard_flushinfo), p AS (SELECT shovel_id, s, regexp_split_to_array(regexp_replace(s, '^[ \f\n\r\t\v]+|[ \f\n\r\t\v]+$', '', 'g'), '[/.;]') AS a FROM q)
SELECT shovel_id, regexp_replace(s, '^[ \f\n\r\t\v]+|[ \f\n\r\t\v]+$', '', 'g') AS trimmed, array_to_string(CASE WHEN a[-1] = '' THEN a[:-2] ELSE a END, '+') AS joined, instr(substr(s, 1, 12), 'run') - 1 AS place FROM p""")
def str_trim_split_join(spark: SparkSession, d: str) -> DataFrame:
    s = F.concat(F.lit(" "), F.coalesce("shovelname", F.lit("")), F.lit("; "))
    t = strings.trim(s)
    return graph.table(spark, d, "shard_flushinfo").select(
        "shovel_id", t.alias("trimmed"), strings.join(strings.split_set(t, "/.;"), "+").alias("joined"),
        strings.find_bounded(s, "run", 12).cast("long").alias("place"),
    )


_IS_NUMBER = r"regexp_full_match(value, '[-+]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][-+]?[0-9]+)?')"
_IS_WHOLE = "regexp_full_match(value, '[-+]?[0-9]+')"


@query(f"""SELECT edge_id, CASE WHEN {_IS_NUMBER} THEN try_cast(value AS DOUBLE) END AS as_double, CASE WHEN {_IS_NUMBER} THEN round(CAST(try_cast(value AS FLOAT) AS DOUBLE), 3) END AS as_float,
CASE WHEN {_IS_WHOLE} THEN try_cast(value AS INT) END AS as_int, CASE WHEN {_IS_WHOLE} THEN try_cast(value AS SMALLINT) END AS as_short, CASE WHEN {_IS_WHOLE} THEN try_cast(value AS BIGINT) END AS as_long,
CASE WHEN {_IS_WHOLE} THEN CAST(try_cast(value AS UINTEGER) AS BIGINT) END AS as_unsigned, coalesce({_IS_WHOLE} AND try_cast(value AS INT) = 1, false) AS is_one, substr(value, 1, 1) AS first_sign
FROM edge_with_value""")
def parse_values(spark: SparkSession, d: str) -> DataFrame:
    """Typed readings of every payload, null where it is no such number."""
    v = F.col("value")
    kinds = {"as_double": "double", "as_int": "int", "as_short": "short", "as_long": "long", "as_unsigned": "unsigned", "is_one": "bool", "first_sign": "char"}
    return graph.table(spark, d, "edge_with_value").select(
        "edge_id", F.round(strings.parse(v, "float").cast("double"), 3).alias("as_float"), *[strings.parse(v, k).alias(n) for n, k in kinds.items()]
    )


@query("SELECT src, dst, count(*) AS n, any_value(src || ',' || dst) AS pair FROM edge_with_value WHERE src IS NOT NULL AND dst IS NOT NULL GROUP BY src, dst")
def composite_keys(spark: SparkSession, d: str) -> DataFrame:
    """Grouping by a pair as one key."""
    e = graph.vertex_edges(spark, d).groupBy(F.struct("src", "dst").alias("p")).agg(F.count("*").alias("n"))
    return e.select("p.src", "p.dst", "n", F.concat_ws(",", "p.src", "p.dst").alias("pair"))


@query("""SELECT line_no, CAST(len(range(0, coalesce(edge_count, 0), 2)) AS INT) AS steps, list_contains(range(0, coalesce(edge_count, 0), 2), 4) AS has_four, format('{:d}:{:d}', line_no, coalesce(edge_count, 0)) AS label FROM input_graph""")
def array_helpers(spark: SparkSession, d: str) -> DataFrame:
    """Ranges with a step, membership and formatted strings."""
    n = F.coalesce("edge_count", F.lit(0))
    seq = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(2))).otherwise(F.array().cast("array<int>"))
    return graph.table(spark, d, "input_graph").select(
        "line_no", F.size(seq).alias("steps"), F.array_contains(seq, 4).alias("has_four"), F.format_string("%d:%d", "line_no", n).alias("label")
    )
