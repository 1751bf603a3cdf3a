"""Snapshot model: seeded participants with a mutable score column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import first_token, last_token
from .joins import left_join_skew_safe
from .pages import RankedPages
from .rank import global_row_number, top_k
from .roster import label_status


def participants_seed(roster: DataFrame, num_partitions: int | None = None,
                      with_timestamp: bool = True) -> DataFrame:
    """Roster -> snapshot rows: seed rank by ``user_name``, score 0, status from the label.

    Real directory rows are numbered in ``user_name`` order; substituted demo
    rows keep their list order (their ids sort in that order).  The seed rank is
    never recomputed afterwards; the viewer uses it only to break score ties.
    """
    return _seed_columns(global_row_number(label_status(roster), _seed_order(), "_seed_rank", num_partitions),
                         with_timestamp)


def participants_top(roster: DataFrame, n: int = K.DISPLAY_LIMIT, with_timestamp: bool = True) -> DataFrame:
    """The first ``n`` participants in seed order (the display limit of the participants list)."""
    return _seed_columns(top_k(label_status(roster), _seed_order(), n, "_seed_rank"), with_timestamp)


def _seed_order():
    is_demo = F.col("status_label") != F.lit(K.STATUS_ACTIVE_LABEL)
    return [F.when(is_demo, F.col("user_id")).otherwise(F.col("user_name")).asc_nulls_last(), F.col("user_id").asc()]


def _seed_columns(seeded: DataFrame, with_timestamp: bool) -> DataFrame:
    active = F.col("status_label") == F.lit(K.STATUS_ACTIVE_LABEL)
    cols = [F.col("user_id").alias("participant_id"),
            F.col("_seed_rank").cast("int").alias("rank"),
            "display_name", "email", F.col("user_name").alias("username"),
            active.alias("is_active"),
            F.when(active, F.lit(K.STATUS_ACTIVE)).otherwise(F.lit(K.STATUS_INACTIVE)).alias("status"),
            F.lit(0).cast("int").alias("score")]
    if with_timestamp:
        cols.append(F.current_timestamp().alias("last_updated"))
    return seeded.select(*cols)


def score_deltas(increments: DataFrame) -> DataFrame:
    """Sum increments ``(email, points)`` per email (partial aggregation first)."""
    return (increments.where(F.col("email").isNotNull())
                      .groupBy("email").agg(F.sum("points").cast("long").alias("_delta")))


def apply_increments(snapshot: DataFrame, increments: DataFrame,
                     share: int | None = None, hot: DataFrame | None = None) -> DataFrame:
    """Bulk form of ``UPDATE t SET score = score + p WHERE email = e``.

    Every snapshot row with that email gets the summed increments; rank and
    last_updated are untouched.  Increments are summed per email first; snapshot
    rows sharing one email (e.g. ``''``) are salted across reducers and rows
    without an email are scattered (``joins.left_join_skew_safe``).  With ``hot`` (the
    table's stored statistics) the snapshot is read once.
    """
    deltas = score_deltas(increments)
    joined = left_join_skew_safe(snapshot, deltas, "email", "email", share, hot)
    score = (F.col("score") + F.coalesce(F.col("_delta"), F.lit(0))).cast("int")
    return joined.withColumn("score", score).select(*snapshot.columns)


def viewer_order():
    return [F.col("score").desc(), F.col("rank").asc(), F.col("participant_id").asc()]


def view_rows(snapshot: DataFrame) -> DataFrame:
    """The viewer's rows with the keys that order them; no position yet."""
    return snapshot.select("participant_id", "rank", first_token("display_name").alias("first_name"),
                           last_token("display_name").alias("last_name"), "email", "score")


VIEW_COLUMNS = ["position", "first_name", "last_name", "email", "score"]


def leaderboard_view(snapshot: DataFrame, num_partitions: int | None = None) -> DataFrame:
    """Viewer rows ``first_name, last_name, email, score`` with their ``position``."""
    return global_row_number(view_rows(snapshot), viewer_order(), "position", num_partitions).select(*VIEW_COLUMNS)


def view_sorted(snapshot: DataFrame, by: str, ascending: bool = True,
                num_partitions: int | None = None) -> DataFrame:
    """The view re-sorted on any of its columns (NULLs last, then the viewer's own order)."""
    first = F.col(by).asc_nulls_last() if ascending else F.col(by).desc_nulls_last()
    return global_row_number(view_rows(snapshot), [first, *viewer_order()], "position",
                             num_partitions).select(*VIEW_COLUMNS)


def view_pages(snapshot: DataFrame, path: str | None = None, num_partitions: int | None = None) -> RankedPages:
    """The view written in its order, to be read by pages."""
    return RankedPages.write(view_rows(snapshot), viewer_order(), path, num_partitions)


def view_page(snapshot: DataFrame | RankedPages, page_no: int, page_size: int = K.PAGE_SIZE,
              num_partitions: int | None = None) -> DataFrame:
    """Page ``page_no`` (1-based) of the view (of a snapshot, or of ``view_pages`` that are there already)."""
    pages = snapshot if isinstance(snapshot, RankedPages) else view_pages(snapshot, num_partitions=num_partitions)
    return pages.page(page_no, page_size, "position").select(*VIEW_COLUMNS, F.lit(page_no).alias("page"))


def highlighted(view: DataFrame) -> DataFrame:
    """The view with its first rows marked."""
    return view.withColumn("highlight", F.col("position") <= F.lit(K.HIGHLIGHT_TOP))
