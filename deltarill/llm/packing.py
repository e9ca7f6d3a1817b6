"""Filling fixed-capacity containers with items: hierarchical residual packing.

Each partition packs its own items best-fit in decreasing size and emits the containers that are nearly full. The others
travel on as items of their filled size: a round merges the underfull containers of ``FAN_IN`` partitions into one node and packs
again, until one node is left. Containers are spread over the nodes of a round by a hash, so each node sees a mixture of them,
and a round has as many nodes as keep each at about ``NODE`` containers: where very many stay underfull (items that are all larger
than half a container, say) the tree is as wide as they need, none is set aside, and it ends when a round as wide as the last
saves next to nothing. Items themselves are shuffled once and never gathered; only underfull containers climb the tree, and
only their ids and sizes.

An item larger than the capacity is cut into full pieces and a remainder, which is packed like any other item.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deltarill.session import materialize, release, ship

#: partitions merged into one by a round
FAN_IN = 8
#: a container is nearly full from this share of its capacity on
NEARLY_FULL = 0.999
#: items of a partition of the lowest level, on average; there are at least two partitions
PARTITION_ITEMS = 50_000
#: items a partition packs at a time, where it is given more
BLOCK = 100_000
#: underfull containers of a node, on average
NODE = 50_000
#: share of the underfull containers that a round must save to be followed by one as wide
WORTH = 0.001
#: pieces of one item that one row is unfolded to at a time
_RUN = 10_000

_SCHEMA = T.StructType([
    T.StructField("row", T.LongType()), T.StructField("piece", T.IntegerType()), T.StructField("size", T.LongType()),
    T.StructField("part", T.IntegerType()), T.StructField("bin", T.LongType()), T.StructField("fill", T.LongType()),
])


def best_fit(sizes: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Container of each item and fill of each container, by best fit in decreasing size. Sizes are in 0..capacity.

    Open containers are kept by their free room: one stack per distinct room and a sorted list of the rooms there are.
    """
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    where, fills = [0] * len(sizes), []
    stacks: dict[int, list[int]] = {}
    rooms: list[int] = []
    for i in order:
        s = sizes[i]
        at = bisect_left(rooms, s)
        if at == len(rooms):
            b, room = len(fills), capacity
            fills.append(0)
        else:
            room = rooms[at]
            stack = stacks[room]
            b = stack.pop()
            if not stack:
                del stacks[room]
                rooms.pop(at)
        where[i] = b
        fills[b] += s
        left = room - s
        if left in stacks:
            stacks[left].append(b)
        else:
            stacks[left] = [b]
            insort(rooms, left)
    return where, fills


def _packer(capacity: int):
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Packs a partition block by block; a container number is the block's first row number plus its place in the block."""
        held: list[pd.DataFrame] = []
        n, base = 0, 0

        def flush() -> pd.DataFrame:
            nonlocal base
            block = pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]
            where, fills = best_fit(block["size"].tolist(), capacity)
            out = block.assign(bin=[base + b for b in where], fill=[fills[b] for b in where])
            base += len(fills)
            return out

        for b in batches:
            held.append(b)
            n += len(b)
            if n >= BLOCK:
                yield flush()[_SCHEMA.names]
                held, n = [], 0
        if n:
            yield flush()[_SCHEMA.names]

    return pack


def pieces(items: DataFrame, item_id: str, size: str, capacity: int) -> DataFrame:
    """``row, piece, size``: items as they are, oversized ones as full pieces and a remainder; numbered from 1.

    A null or negative size is no size: such items are left out (see :func:`pack`).
    """
    n = F.greatest(F.ceil(F.col("whole") / capacity), F.lit(1))
    one = items.select(F.col(item_id).cast("long").alias("row"), F.col(size).cast("long").alias("whole")).where("whole >= 0")
    # two steps, so that no row holds a list as long as the pieces of a huge item
    runs = one.select("row", "whole", n.alias("n"), F.explode(F.sequence(F.lit(0), F.floor((n - 1) / _RUN))).alias("run"))
    first = F.col("run") * _RUN + 1
    each = runs.select("row", "whole", F.explode(F.sequence(first, F.least(first + _RUN - 1, F.col("n")))).alias("piece"))
    return each.select("row", F.col("piece").cast("int").alias("piece"), F.least(F.col("whole") - (F.col("piece") - 1) * capacity, F.lit(capacity)).alias("size"))


def pack(items: DataFrame, item_id: str, size: str, capacity: int, partitions: int | None = None) -> DataFrame:
    """``item_id, piece, size, container_id``: a container number, from 1 on, for every item or piece.

    Containers of full pieces hold nothing else. Items of size 0 take no room but are put somewhere. An item with a null or
    negative size has no place: one row with null ``piece``, ``size`` and ``container_id``. Repeated rows are separate items
    and come out as often as they went in. An empty table gives no row. The result is the same for the same partitioning.
    Unless told otherwise, there is a partition for ``PARTITION_ITEMS`` pieces, and two at least.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    ship(items.sparkSession)
    cut = pieces(items, item_id, size, capacity)
    parts = partitions or max(2, -(-cut.count() // PARTITION_ITEMS))
    # by the place in the input, so that neither equal ids nor equal sizes gather; the place is the same when a task runs again
    spread = cut.withColumn("place", F.monotonically_increasing_id()).repartition(parts, "place").drop("place")
    local = spread.withColumn("part", F.spark_partition_id()).withColumn("bin", F.lit(0).cast("long")).withColumn("fill", F.lit(0).cast("long"))
    level = materialize(local.mapInPandas(_packer(capacity), _SCHEMA))
    steps: list[DataFrame] = []  # per round: the underfull containers of the round before, and where they went
    under, n = _underfull(level, capacity)
    single = False
    while n > 1 and not single:
        wide = max(-(-parts // FAN_IN), -(-n // NODE))
        up = under.select(
            F.col("part").alias("from_part"), F.col("bin").alias("from_bin"), F.col("fill").alias("size"),
            F.pmod(F.xxhash64("part", "bin", F.lit(len(steps))), F.lit(wide)).cast("int").alias("part"),
        )
        packed = up.repartition(wide, "part").groupBy("part").applyInPandas(_merger(capacity), "from_part int, from_bin long, part int, bin long, fill long")
        steps.append(materialize(packed))
        saved = n - steps[-1].select("part", "bin").distinct().count()
        single = wide == 1 or (wide >= parts and saved < WORTH * n)
        parts = wide
        under, n = _underfull(steps[-1], capacity)
    final = materialize(_placed(level, steps))
    for t in (level, *steps):
        release(t)
    return _dense(items, item_id, size, final)


def _underfull(bins: DataFrame, capacity: int) -> tuple[DataFrame, int]:
    under = bins.where(F.col("fill") < F.lit(NEARLY_FULL * capacity)).select("part", "bin", "fill").distinct()
    return under, under.count()


def _merger(capacity: int):
    def merge(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["from_part", "from_bin"], ignore_index=True)
        where, fills = best_fit(block["size"].tolist(), capacity)
        return block.assign(bin=where, fill=[fills[b] for b in where])[["from_part", "from_bin", "part", "bin", "fill"]]

    return merge


def _placed(level: DataFrame, steps: list[DataFrame]) -> DataFrame:
    """``row, piece, size, r, p, b``: follow each local container to the round, node and number it ended in."""
    where = None  # from (part, bin) of underfull containers to the final (round, part, bin), built from the top down
    for r in range(len(steps) - 1, -1, -1):
        s = steps[r].select("from_part", "from_bin", F.col("part").alias("p"), F.col("bin").alias("b"))
        if where is None:
            where = s.select("from_part", "from_bin", F.lit(r + 1).alias("r"), "p", "b")
        else:
            up = where.select(F.col("from_part").alias("p"), F.col("from_bin").alias("b"), F.col("r").alias("r2"), F.col("p").alias("p2"), F.col("b").alias("b2"))
            where = s.join(up, ["p", "b"], "left").select(
                "from_part", "from_bin", F.coalesce("r2", F.lit(r + 1)).alias("r"), F.coalesce("p2", "p").alias("p"), F.coalesce("b2", "b").alias("b")
            )
    if where is None:
        return level.select("row", "piece", "size", F.lit(0).alias("r"), F.col("part").alias("p"), F.col("bin").alias("b"))
    up = where.select(F.col("from_part").alias("part"), F.col("from_bin").alias("bin"), "r", F.col("p").alias("p2"), F.col("b").alias("b2"))
    return level.join(up, ["part", "bin"], "left").select(
        "row", "piece", "size", F.coalesce("r", F.lit(0)).alias("r"), F.coalesce("p2", "part").alias("p"), F.coalesce("b2", "bin").alias("b")
    )


def _dense(items: DataFrame, item_id: str, size: str, final: DataFrame) -> DataFrame:
    """Container numbers without gaps: a rank within each partition of a round plus the containers of those before.

    Ranks within a partition come from the partition's own containers (bounded by its items); one row per partition is summed.
    """
    used = final.select("r", "p", "b").distinct()
    ranked = used.withColumn("i", F.row_number().over(Window.partitionBy("r", "p").orderBy("b")))
    per = sorted((x.r, x.p, x.n) for x in used.groupBy("r", "p").agg(F.count("*").alias("n")).collect())
    offsets, total = [], 0
    for r, p, n in per:
        offsets.append((r, p, total))
        total += n
    before = items.sparkSession.createDataFrame(offsets or [(0, 0, 0)], "r int, p int, before long")
    # one row per partition of a round: as many as the job has tasks
    numbers = ranked.join(F.broadcast(before), ["r", "p"]).select("r", "p", "b", (F.col("before") + F.col("i")).alias("container_id"))
    placed = final.join(numbers, ["r", "p", "b"]).select(F.col("row").alias("item_id"), "piece", "size", "container_id")
    lost = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(size).alias("s")).where("s is null or s < 0")
    nothing = lost.select("item_id", F.lit(None).cast("int").alias("piece"), F.lit(None).cast("long").alias("size"), F.lit(None).cast("long").alias("container_id"))
    return placed.unionByName(nothing)


def check(packed: DataFrame, items: DataFrame, item_id: str, size: str, capacity: int) -> DataFrame:
    """One row on whether a packing is one: ``n_items, n_pieces, total_size, least_containers`` and the faults ``overfull``
    (containers beyond the capacity), ``gaps`` (container numbers that are not used), ``wrong_size`` (item ids whose pieces do not add up
    to their sizes) and ``split`` (pieces beyond those an item must be cut into); ``near_least`` is whether there are at most 1% and
    two containers more than the least possible.
    """
    p = packed.where("container_id is not null")
    bins = p.groupBy("container_id").agg(F.sum("size").alias("fill")).agg(
        F.count_if(F.col("fill") > capacity).alias("overfull"), (F.coalesce(F.max("container_id"), F.lit(0)) - F.count("*")).alias("gaps"), F.count("*").alias("n"))
    got = p.groupBy("item_id").agg(F.sum("size").alias("got"), F.count("*").alias("pieces"))
    whole = F.col(size).cast("long")
    asked = items.where(whole >= 0).groupBy(F.col(item_id).cast("long").alias("item_id")).agg(
        F.sum(whole).alias("asked"), F.count("*").alias("n_rows"), F.sum(F.greatest(F.ceil(whole / capacity), F.lit(1))).alias("least"))
    both = asked.join(got, "item_id", "full_outer").agg(
        F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_items"), F.coalesce(F.sum("least"), F.lit(0)).alias("n_pieces"), F.coalesce(F.sum("asked"), F.lit(0)).alias("total_size"),
        F.count_if(~F.col("asked").eqNullSafe(F.col("got"))).alias("wrong_size"), F.count_if(~F.col("least").eqNullSafe(F.col("pieces"))).alias("split"))
    one = both.withColumn("one", F.lit(1)).join(bins.withColumn("one", F.lit(1)), "one")  # of one row each
    least = F.ceil(F.col("total_size") / capacity)
    return one.select("n_items", "n_pieces", "total_size", least.alias("least_containers"), "overfull", "gaps", "wrong_size", "split", (F.col("n") <= 1.01 * least + 2).alias("near_least"))


def report(packed: DataFrame, capacity: int) -> DataFrame:
    """``n_items, n_pieces, total_size, n_containers, least_containers, unused_share``: one row.

    ``least_containers`` is the total size over the capacity, rounded up; no packing can use fewer.
    """
    p = packed.where("container_id is not null")
    return p.agg(
        F.count_if(F.col("piece") == 1).alias("n_items"), F.count("*").alias("n_pieces"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_size"),
        F.coalesce(F.max("container_id"), F.lit(0)).alias("n_containers"),
    ).select(
        "*", F.ceil(F.col("total_size") / capacity).alias("least_containers"),
        F.when(F.col("n_containers") > 0, 1 - F.col("total_size") / (F.col("n_containers") * F.lit(capacity))).alias("unused_share"),
    )
