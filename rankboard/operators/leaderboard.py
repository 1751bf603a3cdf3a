"""Response-sum leaderboard: totals, zero-fill join, ranking, progress, top-k, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import answered_label, is_complete, medal, progress_label, progress_pct, row_class, tier
from .joins import left_join_skew_safe
from ..sources.literal import literal_frame
from .pages import RankedPages
from .rank import global_row_number, global_row_number_with_cut, top_k


def score_totals(graded: DataFrame, key: str = "user_id") -> DataFrame:
    """Per-key ``total_points`` and ``questions_answered`` (responses, not distinct questions).

    The hash aggregate runs partially in every map task, so however many
    responses one user has, at most one row per user and task is shuffled.
    """
    return (graded.where(F.col(key).isNotNull())
                  .groupBy(key)
                  .agg(F.sum("points_earned").cast("long").alias("total_points"),
                       F.count("response_id").alias("questions_answered")))


def leaderboard(roster: DataFrame, graded: DataFrame, key: str = "user_id",
                response_key: str = "user_id", keep_key: bool = False) -> DataFrame:
    """Every roster row with its total points and answer count (0/0 without answers).

    ``key`` is the roster column matched against the responses' ``response_key``
    (``"user_id"`` normally, ``"email"`` when responses are keyed by login email).
    Responses are aggregated *before* the join so the join sees one row per user;
    this equals the join-then-group form when ``key`` is unique in the roster,
    and when it is not, each roster row still receives its key's totals.
    """
    totals = score_totals(graded, response_key)
    return board_from_totals(roster, totals, key, response_key, keep_key)


def board_from_totals(roster: DataFrame, totals: DataFrame, key: str = "user_id",
                      totals_key: str = "user_id", keep_key: bool = False) -> DataFrame:
    """Zero-filled left join of the roster with per-key totals.

    For a key other than the primary key ``user_id`` (e.g. ``email``), roster
    rows sharing a key are salted and NULL keys scattered (``left_join_skew_safe``).
    """
    t = totals.select(F.col(totals_key).alias("_resp_key"), "total_points", "questions_answered")
    if key == "user_id":
        joined = roster.join(t, F.col(key) == F.col("_resp_key"), "left").drop("_resp_key")
    else:
        joined = left_join_skew_safe(roster, t, key, "_resp_key")
    cols = ["user_id"] if keep_key else []
    return joined.select(
        *cols, "display_name", "email",
        F.coalesce(F.col("total_points"), F.lit(0)).cast("long").alias("total_points"),
        F.coalesce(F.col("questions_answered"), F.lit(0)).cast("long").alias("questions_answered"))


def board_order() -> list[Column]:
    """Points, then answers, both descending; ``user_id`` makes the order total."""
    return [F.col("total_points").desc(), F.col("questions_answered").desc(), F.col("user_id").asc()]


def podium(df: DataFrame) -> DataFrame:
    """Medal, tier, row class and highlight from a ``rank`` column."""
    return (df.withColumn("medal", medal("rank"))
              .withColumn("tier", tier("rank"))
              .withColumn("row_class", row_class("rank"))
              .withColumn("highlight", F.col("rank") <= F.lit(K.HIGHLIGHT_TOP)))


def ranked(board: DataFrame, num_partitions: int | None = None) -> DataFrame:
    """Full board with 1-based ``rank`` (ties get distinct ranks) and podium columns.

    ``board`` must carry ``user_id`` (``leaderboard(..., keep_key=True)``).
    """
    return ranked_with_cut(board, num_partitions)[0]


def ranked_with_cut(board: DataFrame, num_partitions: int | None = None) -> tuple[DataFrame, str]:
    """``ranked`` plus the path of the rank's lineage cut (release it after materialising)."""
    out, cut = global_row_number_with_cut(board, board_order(), "rank", num_partitions)
    return podium(out), cut


def top(board: DataFrame, n: int = K.DISPLAY_LIMIT) -> DataFrame:
    """The first ``n`` board rows with rank and podium columns."""
    return podium(top_k(board, board_order(), n, "rank"))


def board_pages(board: DataFrame, path: str | None = None, num_partitions: int | None = None) -> RankedPages:
    """The board written in rank order, to be read by pages (``pages.RankedPages``)."""
    return RankedPages.write(board, board_order(), path, num_partitions)


def board_page(pages: RankedPages, page_no: int, page_size: int = K.PAGE_SIZE) -> DataFrame:
    """Page ``page_no`` (1-based) with podium columns: a scan of the files that hold its ranks."""
    return podium(pages.page(page_no, page_size)).withColumn("page", F.lit(page_no))


def page(board: DataFrame, page_no: int, page_size: int = K.PAGE_SIZE,
         num_partitions: int | None = None) -> DataFrame:
    """Page ``page_no`` (1-based) of a board that is not published; keep ``board_pages`` for more than one."""
    return board_page(board_pages(board, num_partitions=num_partitions), page_no, page_size)


def progress(board: DataFrame, max_score: int, n_questions: int) -> DataFrame:
    """Progress percentage (not capped), its label, completeness and the answered label."""
    p = progress_pct("total_points", max_score)
    return (board.withColumn("progress", p)
                 .withColumn("progress_label", progress_label("progress"))
                 .withColumn("complete", is_complete("progress"))
                 .withColumn("answered_label", answered_label("questions_answered", n_questions)))


def sorted_by(board: DataFrame, by: str, ascending: bool = True,
              num_partitions: int | None = None) -> DataFrame:
    """Board re-sorted on any column, with a ``position`` column (NULLs last)."""
    c = F.col(by)
    first = c.asc_nulls_last() if ascending else c.desc_nulls_last()
    return global_row_number(board, [first, F.col("user_id").asc()], "position", num_partitions)


def user_scores(graded: DataFrame, user_ids: list[str]) -> DataFrame:
    """``(user_id, total_points)`` of a few users, 0 for those without responses, from one scan.

    Where the log keeps ids in another type, filter it on that type first: a predicate on a
    cast column does not reach the scan."""
    totals = score_totals(graded.where(F.col("user_id").isin(user_ids)))
    wanted = literal_frame(graded.sparkSession, [(u,) for u in user_ids], "user_id string")
    return wanted.join(totals, "user_id", "left").select(
        "user_id", F.coalesce("total_points", F.lit(0)).cast("long").alias("total_points"))


def user_score(graded: DataFrame, user_id: str) -> DataFrame:
    """One row ``(user_id, total_points)``; 0 when the user has no responses."""
    mine = graded.where(F.col("user_id") == F.lit(user_id))
    return mine.agg(F.coalesce(F.sum("points_earned"), F.lit(0)).cast("long").alias("total_points")) \
               .select(F.lit(user_id).alias("user_id"), "total_points")


def participant_count(board: DataFrame) -> DataFrame:
    return board.agg(F.count(F.lit(1)).alias("participants"))
