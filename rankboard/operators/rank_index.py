"""Ranks from counts: a score histogram instead of a sort of the whole board.

Members of a board are dealt into ranges of ``user_id`` (``bucket``).  A *cell* is all members of a bucket
with the same points and answers; a member's *seat* is its position by ``user_id`` among them.  Board
order is points and answers, both descending, then ``user_id``, so

    rank = members of the cells before + seat

where the cells before are those of better scores, and those of the same score in lower ranges.  Users
whose totals change touch the seats and the cells of their own buckets only; the rest of the
index stays as it is.  The cells are one row per score and bucket, whatever the number of members.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCORE = ["total_points", "questions_answered"]
SEAT_COLUMNS = ["user_id", "display_name", "email", *SCORE, "seat", "bucket"]
# The most ranges of user ids: their bounds are literals of the plans.
MAX_BUCKETS = 256


def range_bounds(members: DataFrame, buckets: int, key: str = "user_id") -> list[str]:
    """The smallest key of every range but the first: at most ``buckets - 1`` values (a sampled, even split)."""
    if buckets > MAX_BUCKETS:
        raise ValueError(f"at most {MAX_BUCKETS} ranges of user ids")
    if buckets < 2:
        return []
    split = members.select(key).where(F.col(key).isNotNull()).repartitionByRange(buckets, key)
    lows = split.groupBy(F.spark_partition_id().alias("_p")).agg(F.min(key).alias("low")).collect()   # <= buckets rows
    return sorted(r["low"] for r in lows)[1:]


def bucket_of(bounds: list[str], key: str = "user_id") -> Column:
    """The range that a key falls into, by a binary search written out as nested conditions."""
    def within(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col(key) < F.lit(bounds[mid]), within(lo, mid)).otherwise(within(mid + 1, hi))
    return F.when(F.col(key).isNull(), F.lit(0)).otherwise(within(0, len(bounds))).cast("int")


def seated(members: DataFrame) -> DataFrame:
    """``members`` (with ``bucket``) and their ``seat``, 1 for the first of a cell."""
    cell = Window.partitionBy("bucket", *SCORE).orderBy("user_id")
    return members.withColumn("seat", F.row_number().over(cell).cast("long"))


def count_cells(seats: DataFrame) -> DataFrame:
    return seats.groupBy("bucket", *SCORE).agg(F.count(F.lit(1)).alias("n"))


def offsets(cells: DataFrame) -> DataFrame:
    """The cells and how many members stand before each (``before``).

    The running sum over the scores is one task's; a board has at most one row per pair of points and
    answers there.  The running sum inside a score is over its buckets.
    """
    better = Window.orderBy(*(F.col(c).desc() for c in SCORE)).rowsBetween(Window.unboundedPreceding, -1)
    lower = Window.partitionBy(*SCORE).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    scores = (cells.groupBy(*SCORE).agg(F.sum("n").alias("_n"))
                   .withColumn("_better", F.coalesce(F.sum("_n").over(better), F.lit(0))).drop("_n"))
    return (cells.join(scores, SCORE)
                 .withColumn("before", F.col("_better") + F.coalesce(F.sum("n").over(lower), F.lit(0)))
                 .select("bucket", *SCORE, "n", "before"))


def with_rank(seats: DataFrame, placed: DataFrame) -> DataFrame:
    """Seats with their ``rank``; ``placed`` are the cells' ``offsets``.  No row is sorted, and where the cells are
    few enough to be broadcast none is shuffled."""
    return (seats.join(placed.select("bucket", *SCORE, "before"), ["bucket", *SCORE])
                 .withColumn("rank", (F.col("before") + F.col("seat")).cast("long")).drop("before"))
