"""Most frequent items among billions: exact prefix refinement.

Values are hashed to 64 bits. A round counts the rows under each hash prefix; a prefix whose rows are fewer than a lower
bound of what is asked cannot hold a wanted value and is dropped; the remaining prefixes are lengthened, and when they are
long enough the full values under them are counted. Each round is one scan of one column with a map-side aggregate, so
what is held and shuffled is bounded by ``2 ** STEP_BITS`` groups per kept prefix. Counts are exact.

Few kept prefixes are a condition of the next scan; more of them stay a table in the shared folder, which the scan is joined
with, so what the driver holds is bounded whatever the distribution. Where nearly all values are equally frequent no prefix can
be dropped: the aggregates then spill to disk, as those of any exact count do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deltarill.session import materialize, release

#: bits of the first prefix, and by how much a round lengthens it
FIRST_BITS = 14
STEP_BITS = 12
#: the length from which on full values are counted under the kept prefixes
LAST_BITS = 26
#: a first lower bound for top-k comes from the exact counts of this many candidates taken from the fullest prefixes
CANDIDATES_PER_K = 4
#: kept prefixes that the driver reads and writes into the next scan as a condition
LISTED = 1_000


def _prefix(h: Column, bits: int) -> Column:
    return F.shiftrightunsigned(h, 64 - bits)


def _hashed(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).select(F.col(column).alias("item"), F.xxhash64(F.col(column)).alias("h"))


def _within(hashed: DataFrame, kept: list[int], bits: int) -> DataFrame:
    return hashed.where(_prefix(F.col("h"), bits).isin(kept)) if kept else hashed.where(F.lit(False))


def refine(df: DataFrame, column: str, at_least: float) -> DataFrame:
    """``item, n``: every value with at least ``at_least`` rows, with its exact count. Nulls are left out.

    At most ``rows / at_least`` prefixes are kept in a round.
    """
    hashed = _hashed(df, column)
    rows, bits, table = hashed, 0, None
    while bits < LAST_BITS:
        bits = min(LAST_BITS, bits + STEP_BITS if bits else FIRST_BITS)
        full = rows.groupBy(_prefix(F.col("h"), bits).alias("p")).agg(F.count("*").alias("n")).where(F.col("n") >= F.lit(at_least)).select("p")
        few = full.limit(LISTED + 1).collect()
        if len(few) <= LISTED:
            rows = _within(hashed, [r.p for r in few], bits)
        else:
            last, table = table, materialize(full)
            rows = hashed.join(table, _prefix(F.col("h"), bits) == F.col("p"), "left_semi")
            if last is not None:
                release(last)
    return rows.groupBy("item").agg(F.count("*").alias("n")).where(F.col("n") >= F.lit(at_least))


def items_over_share(df: DataFrame, column: str, share: float) -> DataFrame:
    """``item, n``: the values that have at least ``share`` of the rows in which the column is not null.

    There are at most ``1 / share`` of them. An empty column gives no row.
    """
    if not 0 < share <= 1:
        raise ValueError("share must be in (0, 1]")
    rows = df.agg(F.count(column)).first()[0]
    return refine(df, column, max(1.0, share * rows))


def _kth_lower_bound(df: DataFrame, column: str, k: int) -> int:
    """A number of rows that at least k different values reach.

    The fullest prefixes are refined greedily: of each of the ``CANDIDATES_PER_K * k`` fullest prefixes the fullest longer
    prefix is followed to the end, where the values are counted exactly. The k-th of these counts is a lower bound of the
    k-th count over all values; if fewer than k values were found, the bound is 1.
    """
    hashed = _hashed(df, column)
    wide = max(64, CANDIDATES_PER_K * k)
    bits, kept = FIRST_BITS, None
    while True:
        rows = hashed if kept is None else _within(hashed, kept, bits - STEP_BITS)
        counted = rows.groupBy(_prefix(F.col("h"), bits).alias("p")).agg(F.count("*").alias("n"))
        kept = [r.p for r in counted.orderBy(F.desc("n"), "p").limit(wide).collect()]
        if bits >= LAST_BITS:
            break
        bits += STEP_BITS
    best = _within(hashed, kept, bits).groupBy("item").agg(F.count("*").alias("n")).orderBy(F.desc("n")).limit(k).select("n").collect()
    return best[-1].n if len(best) == k else 1


def top_items(df: DataFrame, column: str, k: int) -> DataFrame:
    """``item, n``: the k most frequent values and every value tied with the k-th, with exact counts.

    ``k`` must be bounded by the caller (it sizes driver lists). Fewer than k values: all come out. Nulls are left out.
    """
    if k < 1:
        raise ValueError("k must be positive")
    counted = materialize(refine(df, column, _kth_lower_bound(df, column, k)))
    kth = counted.orderBy(F.desc("n")).limit(k).agg(F.min("n")).first()[0]
    return counted.where(F.col("n") >= F.lit(kth if kth is not None else 0))
