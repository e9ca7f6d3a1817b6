"""The round as one join and one aggregate, and the loops around it.

The prepared edges hold, besides each edge, one row per vertex that leads to itself (``self``). A round joins the state with
them once: the self row carries the updated value on, the others carry messages, and one aggregate by destination gives the
next state. So a plan of k rounds is a chain, not a tree, and a round shuffles once: what the aggregate leaves is already
partitioned for the next join, and the exchange of the edges is the same in every round, so Spark computes it once.

Hot destinations are combined map-side. The edges of a hot source are spread by a salt when they are prepared, and its state
row is repeated for each salt in every round; where there is such a source a round shuffles the state, which is small beside the
edges, once more. State is written to the shared folder every ``CHAIN`` rounds, so lineage stays short and a lost executor
costs at most that many.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deltarill.operators import hot
from deltarill.plans.kernel import Kernel
from deltarill.plans.schedule import threshold
from deltarill.plans.terminate import Terminator
from deltarill.session import materialize, release

#: rounds in one plan
CHAIN = 8
MISSING = ("add", "drop", "error")
#: bytes of a partition of the state up to which it may be built into a hash table, and of a row of it there
HASH_BYTES, ROW_BYTES = 64 << 20, 128


def prepare(edges: DataFrame, vertices: DataFrame | None = None, missing: str = "add") -> DataFrame:
    """``src, dst, weight, degree, self, salt``: edges with the out-degree of their source, and a self row per vertex.

    ``edges`` has ``src, dst`` and perhaps ``weight`` (1 where there is none; null weights are 0). Parallel edges and self-loops
    count and stay; rows with a null end are no edges. Vertices without an edge may be given in ``vertices(id)``. A
    destination that is no source and not given gets a row (``add``), loses its messages (``drop``) or is an error. ``salt`` is 0
    but for the edges of sources that hold more than a task's share of them.
    """
    if missing not in MISSING:
        raise ValueError(f"missing must be one of {MISSING}")
    weight = F.coalesce(F.col("weight").cast("double"), F.lit(0.0)) if "weight" in edges.columns else F.lit(1.0)
    e = edges.where("src is not null and dst is not null").select("src", "dst", weight.alias("weight"))
    often, n = hot.hot_keys(e, "src"), hot.splits(e)
    degrees = e.groupBy("src").agg(F.count("*").alias("degree"))
    ids = degrees.select(F.col("src").alias("id"))
    if vertices is not None:
        ids = ids.unionByName(vertices.where("id is not null").select("id")).distinct()
    if missing == "add":
        ids = ids.unionByName(e.select(F.col("dst").alias("id"))).distinct()
    elif missing == "error":
        lost = e.join(ids, F.col("dst") == F.col("id"), "left_anti")
        if not lost.isEmpty():
            raise ValueError("an edge leads to a vertex that is not there")
    own = ids.join(degrees, F.col("id") == F.col("src"), "left").select(
        F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(0.0).alias("weight"), F.coalesce("degree", F.lit(0)).alias("degree"),
        F.lit(True).alias("self"), F.lit(0).alias("salt"),
    )
    salted = e.withColumn("salt", hot.salt(F.col("src"), often, n, F.col("dst")))
    by = ["src", "salt"] if often else ["src"]
    known = hot.repeated(degrees, "src", often, n, "salt") if often else degrees
    out = salted.join(known, by).select("src", "dst", "weight", "degree", F.lit(False).alias("self"), "salt")
    return materialize(out.unionByName(own))


def _layout(prepared: DataFrame) -> tuple[list, int, int]:
    """Hot sources, their salts and the number of vertices, looked up once per prepared table."""
    known = getattr(prepared, "_deltarill_layout", None)
    if known is None:
        # hot sources are few, see hot.hot_keys
        row = prepared.agg(F.collect_set(F.when(F.col("salt") > 0, F.col("src"))), F.max("salt"), F.count_if("self")).first()
        known = row[0], 1 + (row[1] or 0), row[2]
        prepared._deltarill_layout = known
    return known


def initial(prepared: DataFrame, kernel: Kernel, data: DataFrame | None = None) -> DataFrame:
    """``id, value, delta``. The kernel's first values may use columns of ``data``, which has one row per ``id``."""
    i = F.col("id")
    ids = prepared.where("self").select(F.col("src").alias("id"))
    if data is not None:
        ids = ids.join(data, "id", "left")
    return ids.select("id", kernel.init_value(i).cast("double").alias("value"), kernel.init_delta(i).cast("double").alias("delta"))


def messages(state: DataFrame, prepared: DataFrame, kernel: Kernel, scheduled: Column | None = None) -> DataFrame:
    """``dst, kept, m``: what reaches each vertex in a round, its own updated value (``kept``) included."""
    value, delta = F.col("value"), F.col("delta")
    if kernel.pre_step:
        state = state.withColumn("delta", kernel.pre_step(F.col("id"), delta, value))
    runs = kernel.pending(value, delta)
    if scheduled is not None:
        runs = runs & scheduled
    s = state.select("id", value.alias("value"), delta.alias("delta"), runs.alias("runs"))
    often, n, vertices = _layout(prepared)
    # said in every round, so that the scan and its exchange are the same in all of them
    known = prepared.where("src is not null and dst is not null")
    on = F.col("src") == F.col("id")
    if often:
        s, on = hot.repeated(s, "id", often, n), on & (F.col("salt") == F.col("_salt"))
    if vertices * ROW_BYTES <= HASH_BYTES * int(prepared.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        s = s.hint("shuffle_hash")  # the edges need no sort; larger states are joined by sorting, which spills
    j = known.join(s, on)
    after = F.when(F.col("runs"), kernel.combine(value, delta)).otherwise(value)
    j = j.where(F.col("self") | F.col("runs"))
    kept = F.when(F.col("self"), after).alias("kept")
    own = F.when(F.col("runs"), kernel.id_column).otherwise(F.when(kernel.pending(value, delta), delta).otherwise(kernel.id_column) if kernel.improves else delta)
    if kernel.fan_out is None:
        return j.select("dst", kept, F.when(F.col("self"), own).otherwise(kernel.message(delta, after, F.col("degree"), F.col("weight"))).alias("m"))
    mine = F.array(F.struct(F.col("dst").alias("dst"), own.cast("double").alias("m")))
    many = F.when(F.col("self"), mine).otherwise(kernel.fan_out(F.col("dst"), delta, after, F.col("degree"), F.col("weight")))
    return j.select(kept, F.explode(many).alias("_x")).select("_x.dst", "kept", "_x.m")


def superstep(state: DataFrame, prepared: DataFrame, kernel: Kernel, scheduled: Column | None = None) -> DataFrame:
    """The next state. ``scheduled`` restricts the vertices that run, as a predicate over ``value`` and ``delta``."""
    return (
        messages(state, prepared, kernel, scheduled)
        .groupBy("dst")
        .agg(F.max("kept").alias("value"), kernel.agg(F.col("m")).alias("delta"))
        .where("value is not null")  # destinations without a row of their own (missing='drop')
        .select(F.col("dst").alias("id"), "value", "delta")
    )


def run_rounds(prepared: DataFrame, kernel: Kernel, rounds: int, state: DataFrame | None = None) -> DataFrame:
    """The state after a number of full rounds, lazily: one job of at most ``CHAIN`` rounds after another."""
    state, held = state if state is not None else initial(prepared, kernel), None
    for i in range(1, rounds + 1):
        state = superstep(state, prepared, kernel)
        if i % CHAIN == 0 and i < rounds:
            state = materialize(state)
            if held is not None:
                release(held)
            held = state
    return state


def _progress(kernel: Kernel) -> Column:
    finite = F.when((F.col("value") != kernel.id_column) & ~F.isnan("value"), F.col("value"))
    return F.coalesce(F.sum(finite), F.lit(0.0)).alias("progress")


def progress(state: DataFrame, kernel: Kernel) -> DataFrame:
    """``progress``: the sum of the values that are not the identity."""
    return state.agg(_progress(kernel))


@dataclass
class Run:
    """``converged``: the terminator ended it or nothing is pending; false only where a limit did."""

    state: DataFrame
    metrics: list[dict] = field(default_factory=list)
    converged: bool = False


def run_daic(prepared: DataFrame, kernel: Kernel, stop: Terminator, *, portion: float = 1.0, check_every: int = 1, min_rows_for_threshold: int = 1000,
             exact_threshold: bool = False, limit: int | None = None, stop_at_limit: bool = False, state: DataFrame | None = None) -> Run:
    """Rounds until ``stop``; progress is looked at every ``check_every`` rounds, as one number.

    With ``portion`` below 1 only the vertices of highest priority run in a round (all of them in tables of at most
    ``min_rows_for_threshold`` rows). A kernel that only improves ends when nothing is pending. Metrics hold a row per check;
    ``updates`` are the vertices that ran in the first of its rounds. There is no limit of rounds unless one is given; reaching
    it is an error, or with ``stop_at_limit`` a run that has not ``converged``. ``state`` is where to begin, if not at :func:`initial`.
    """
    if not 0 < portion <= 1:
        raise ValueError("portion must be in (0, 1]")
    if check_every < 1:
        raise ValueError("check_every must be positive")

    def looked_at(s: DataFrame) -> tuple[float, int]:
        """Progress and pending vertices, in one pass over the table that was just written."""
        waiting = F.count_if(kernel.pending(F.col("value"), F.col("delta")))
        return tuple(s.agg(_progress(kernel), waiting.alias("pending")).first())

    state, before, metrics, done = materialize(initial(prepared, kernel) if state is None else state), None, [], 0
    pending = looked_at(state)[1]
    while True:
        if limit is not None and done >= limit:
            if stop_at_limit:
                return Run(state, metrics)
            raise RuntimeError(f"not ended after {done} rounds")
        updates, written = pending, [state]
        for i in range(check_every):
            chosen = None
            if i and (portion < 1 or i % CHAIN == 0):  # the cut is taken from a table, not from the plan of the rounds before
                state = materialize(state)
                written.append(state)
            if portion < 1:
                chosen = threshold(state, kernel, portion, min_rows_for_threshold, exact_threshold)
                if chosen is not None and not i:
                    updates = state.where(kernel.pending(F.col("value"), F.col("delta")) & chosen).count()
            state = superstep(state, prepared, kernel, chosen)
            done += 1
        state = materialize(state)
        for t in written:
            release(t)
        now, pending = looked_at(state)
        ended = stop(before, now, done) or (kernel.improves and pending == 0)
        metrics.append({"round": done, "progress": now, "diff": None if before is None else abs(now - before), "updates": updates, "terminated": ended})
        before = now
        if ended:
            return Run(state, metrics, True)
