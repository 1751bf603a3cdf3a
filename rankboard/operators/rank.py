"""Global ranking without a single-partition exchange.

``row_number() OVER (ORDER BY ...)`` with no PARTITION BY moves every row into
one task.  ``global_row_number`` instead:

1. range-partitions on the full (total) ordering and sorts inside partitions, so
   partition ``p`` holds a contiguous slice of the order and even one very hot
   score value is spread over many partitions;
2. tags each row with ``monotonically_increasing_id()`` (partition index in the
   upper 31 bits, position inside the sorted partition in the lower 33 bits);
3. cuts the lineage by writing that frame as parquet to the shared folder
   (``session.cut_lineage``), so the sampled range bounds, and therefore the ids,
   are fixed for both passes below even if an executor is lost; the partition
   and position travel inside the id, so reading the files back in any split is
   fine;
4. counts rows per partition (one row per partition: its size is bounded by the
   partition count, not by the data), turns the counts into prefix offsets, and
   broadcasts that tiny table back: ``rank = offset(p) + position + 1``.

Step 3 is a write: these functions run a job when they are called and leave the
cut in the shared folder for the readers of the result.  Call them inside
``session.lineage_scope`` and consume the result there; the scope releases the cut.

The first few rows need none of this: ``orderBy(...).limit(k)`` plans as
TakeOrderedAndProject (a k-row heap per task).  ``top_k`` does that for a display
limit and refuses a larger one; any other range of positions is a filter on the
distributed rank (``rank_window``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, shared_path

_POS_BITS = 33
_POS_MASK = (1 << _POS_BITS) - 1

# The most rows a display may ask for at once: they are numbered in one task.
DISPLAY_MAX = 10_000


def global_row_number(df: DataFrame, order: Sequence[Column], out_col: str = "rank",
                      num_partitions: int | None = None) -> DataFrame:
    """See ``global_row_number_with_cut``; the lineage cut stays for the result's readers."""
    return global_row_number_with_cut(df, order, out_col, num_partitions)[0]


def global_row_number_with_cut(df: DataFrame, order: Sequence[Column], out_col: str = "rank",
                               num_partitions: int | None = None) -> tuple[DataFrame, str]:
    """Add ``out_col`` = 1-based position of each row in ``order``.

    ``order`` must be a total order (end it with a unique key); ties would
    otherwise be numbered arbitrarily, as plain ``row_number`` does.

    Without ``num_partitions`` the range shuffle is sized by AQE from the data
    (adjacent ranges are merged up to the advisory partition size, which keeps
    every partition a contiguous slice of the order).

    Returns the ranked frame and the path of its lineage cut, which the caller
    may release once the result has been materialised elsewhere.
    """
    ranged = (df.repartitionByRange(num_partitions, *order) if num_partitions
              else df.repartitionByRange(*order))
    tagged = (ranged
                .sortWithinPartitions(*order)
                .withColumn("_rk_mid", F.monotonically_increasing_id()))
    cut = shared_path(df.sparkSession, "lineage", "rank")
    tagged = cut_lineage(tagged, "rank", cut)
    tagged = tagged.withColumn("_rk_pid", F.shiftright(F.col("_rk_mid"), _POS_BITS))
    before = Window.orderBy("_rk_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (tagged.groupBy("_rk_pid").agg(F.count(F.lit(1)).alias("_rk_n"))
                     .withColumn("_rk_off", F.coalesce(F.sum("_rk_n").over(before), F.lit(0)))
                     .select("_rk_pid", "_rk_off"))
    pos = F.col("_rk_mid").bitwiseAND(F.lit(_POS_MASK))
    out = (tagged.join(F.broadcast(offsets), "_rk_pid")
                 .withColumn(out_col, (F.col("_rk_off") + pos + F.lit(1)).cast("long"))
                 .drop("_rk_pid", "_rk_mid", "_rk_off"))
    return out, cut


def top_k(df: DataFrame, order: Sequence[Column], k: int, out_col: str = "rank") -> DataFrame:
    """The first ``k`` rows of ``order``, numbered 1..k (the limit is the feature)."""
    if k > DISPLAY_MAX:
        raise ValueError(f"at most {DISPLAY_MAX} rows can be displayed; for more use rank_window")
    head = df.orderBy(*order).limit(k)
    return head.withColumn(out_col, F.row_number().over(Window.orderBy(*order)).cast("long"))


def rank_window(df: DataFrame, order: Sequence[Column], first: int, last: int,
                out_col: str = "rank", num_partitions: int | None = None) -> DataFrame:
    """Rows whose 1-based position in ``order`` lies in ``[first, last]``: a filter on the
    distributed rank, wherever the range lies."""
    ranked = global_row_number(df, order, out_col, num_partitions)
    return ranked.where((F.col(out_col) >= first) & (F.col(out_col) <= last))
