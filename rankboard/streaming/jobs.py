"""Streaming re-expression of the reference's polling loop.

T1  ``start_grading``: response stream -> guard -> join with the answer key -> grade; graded
    answers and those whose question the bank lacks go to two sinks, a directory per
    micro-batch (a retried batch overwrites its own; response ids come from the source).
T2  ``start_leaderboard``: running per-user totals in the state store
    (``update`` mode: only users whose totals changed are emitted), merged by
    ``foreachBatch`` into a totals table that is partitioned by a hash of the
    user.  A trigger replaces the buckets of the users it changed and no others
    (``sources.buckets``: new directories, old ones kept).  The same users bring the
    rank index up to date (``live_index``), and the board is published from it at every
    trigger, without a sort of all users.  A board version is a directory named after the
    batch id, so a retried batch is idempotent.
T3  ``refresh_now``: T2 with ``availableNow`` (the refresh button), ranked once at the end.

Why foreachBatch: a static-left outer join with a streaming right side and
sorting outside complete mode are both unsupported in Structured Streaming, and
the zero-filled board needs both.
"""

from __future__ import annotations

import threading
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException
from pyspark.sql.streaming import StreamingQuery

from ..operators.grading import grade, grade_or_flag, valid_submissions
from ..operators.leaderboard import board_from_totals, podium, score_totals
from ..operators.leaderboard import ranked_with_cut
from ..session import STREAMING_CONF, lineage_scope
from ..sources.buckets import bucket_count, create_bucket_table, in_buckets, replace_buckets
from ..sources.tables import points_at, publish_version, table_location, table_property
from .live_index import RankIndex

TOTALS_DDL = "user_id STRING, total_points BIGINT, questions_answered BIGINT"
# Buckets of a totals table at least; a larger roster gets one for so many users (fixed when the table is created).
BUCKETS = 64
USERS_PER_BUCKET = 250_000
BATCH_PROPERTY = "rankboard.batch"
# A live board is published every so many triggers.
RANK_EVERY = 1

# Publishes of one board (micro-batches and on-demand rebuilds, all in the
# driver) are serialised, so a rebuild never reads totals a batch is replacing
# and never lands on top of a newer board.
_locks: dict[str, threading.Lock] = {}
_locks_guard = threading.Lock()


def _board_lock(board_table: str) -> threading.Lock:
    with _locks_guard:
        return _locks.setdefault(board_table, threading.Lock())


def _board(roster: DataFrame, totals: DataFrame, ranked: bool) -> tuple[DataFrame, str | None]:
    """The zero-filled board (and the rank's lineage cut, if ranked).

    Ranked boards are written in rank order, so readers paging with
    ``rank BETWEEN a AND b`` skip row groups by their statistics.
    """
    board = board_from_totals(roster, totals, keep_key=True)
    if not ranked:
        return board, None
    out, cut = ranked_with_cut(board)
    return out.sortWithinPartitions("rank"), cut


def _roster(spark: SparkSession, roster: DataFrame | str) -> DataFrame:
    """A roster given by table name is resolved afresh (its current version and files) on each use."""
    if isinstance(roster, str):
        spark.catalog.refreshTable(roster)
        return spark.table(roster)
    return roster


def _publish_board(spark, roster, totals_table, board_table, path, ranked) -> None:
    with lineage_scope(spark):   # the published version holds the ranks: release the cut
        board, _ = _board(_roster(spark, roster), spark.table(totals_table).drop("bucket"), ranked)
        publish_version(board, board_table, path)


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def stream_files(spark: SparkSession, path: str, schema, glob: str | None = None,
                 max_files_per_trigger: int | None = None) -> DataFrame:
    """A parquet file stream with a fixed schema (optionally one file name pattern)."""
    r = spark.readStream.schema(schema)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return r.parquet(path)


def _trigger(writer, trigger: str | None):
    if trigger is None or trigger == "availableNow":
        return writer.trigger(availableNow=True)
    return writer.trigger(processingTime=trigger)


class GradingSink:
    """``foreachBatch`` body of T1: one micro-batch into two sinks, each a directory of the batch's own.

    A batch that is run again overwrites its own two directories, so every valid answer is in exactly one
    of the sinks: graded, or (its question is not in the bank) ungraded.
    """

    def __init__(self, bank: DataFrame, graded_path: str, ungraded_path: str):
        self.bank, self.graded_path, self.ungraded_path = bank, graded_path.rstrip("/"), ungraded_path.rstrip("/")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        answers = grade_or_flag(valid_submissions(batch), self.bank).persist()
        try:
            out = (("known", self.graded_path, ["known"]), ("NOT known", self.ungraded_path, ["known", "correct_answer", "points_earned"]))
            for which, path, without in out:
                answers.where(which).drop(*without).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id:012d}")
        finally:
            answers.unpersist()


def start_grading(responses: DataFrame, bank: DataFrame, sink_path: str, checkpoint: str,
                  trigger: str | None = None, ungraded_path: str | None = None) -> StreamingQuery:
    """T1: grade a response stream into ``sink_path``, and what cannot be graded into ``ungraded_path``
    (default: ``<sink_path>_ungraded``); both parquet, partitioned by ``batch_id``."""
    sink = GradingSink(bank, sink_path, ungraded_path or f"{sink_path.rstrip('/')}_ungraded")
    w = responses.writeStream.option("checkpointLocation", checkpoint).foreachBatch(sink)
    return _trigger(w, trigger).start()


def merge_totals(changed: DataFrame, totals_table: str, batch_id: int) -> list[int]:
    """Replace the totals of the ``changed`` users: only the buckets they fall into are read and rewritten.

    The new buckets are written beside the old ones and then published (``replace_buckets``), the batch id
    last; the values are absolute, so a merge that was cut short is completed by running it again, and
    until then every user has the old or the new totals.  Returns the buckets.
    """
    spark = changed.sparkSession
    n = bucket_count(spark, totals_table)
    changed = changed.select("user_id", "total_points", "questions_answered",
                             F.pmod(F.xxhash64("user_id"), F.lit(n)).cast("int").alias("bucket")).persist()
    try:
        touched = sorted(r["bucket"] for r in changed.select("bucket").distinct().collect())   # <= buckets
        held = in_buckets(spark.table(totals_table), touched)
        merged = held.join(changed.select("user_id"), "user_id", "left_anti").unionByName(changed)
        replace_buckets(merged, totals_table, touched, f"{batch_id:012d}", {BATCH_PROPERTY: batch_id}, none_empty=True)
        return touched
    finally:
        changed.unpersist()


def last_batch(spark: SparkSession, totals_table: str) -> int:
    """The last micro-batch merged into the totals (-1: none)."""
    return int(table_property(spark, totals_table, BATCH_PROPERTY) or -1)


class LeaderboardRefresher:
    """``foreachBatch`` body: merge changed totals, bring the rank index up to date, and publish the board every
    ``rank_every``-th batch (0: neither index nor board, ``refresh_now`` ranks at the end).

    ``batch`` holds the *current* running totals of users that changed in this
    micro-batch (absolute values, not deltas), so re-applying a batch is
    harmless; a batch already merged, and a board already published for it, are left alone.
    ``roster`` may be a table name: it is then re-read on every micro-batch, so
    a roster sync reaches the board with the next micro-batch (or at once with
    ``rebuild_board``) and no stale roster version is held.
    """

    def __init__(self, roster: DataFrame | str, totals_table: str, board_table: str, root: str,
                 ranked: bool = True, rank_every: int = RANK_EVERY, index_buckets: int | None = None):
        self.rank_every = rank_every
        self.index_buckets = index_buckets
        self.roster = roster
        self.totals_table = totals_table
        self.board_table = board_table
        self.root = root.rstrip("/")
        self.ranked = ranked

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        with _board_lock(self.board_table):
            self._apply(batch, batch_id)

    def _apply(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if last_batch(spark, self.totals_table) < batch_id:
            merge_totals(batch, self.totals_table, batch_id)
        if not self.rank_every:
            return
        index = None
        if self.ranked:
            index = RankIndex(spark, self.board_table, self.root, self.index_buckets)
            index.update(batch, batch_id, self.roster, spark.table(self.totals_table).drop("bucket"))
        if batch_id % self.rank_every == 0:
            path = f"{self.root}/board/v{batch_id:012d}"
            if points_at(spark, self.board_table, path):
                return
            if index is None:
                _publish_board(spark, self.roster, self.totals_table, self.board_table, path, ranked=False)
            else:
                publish_version(podium(index.board()), self.board_table, path)


def _publish_batch(spark, roster, totals_table, board_table, root, batch_id, ranked) -> None:
    path = f"{root}/board/v{batch_id:012d}"
    if not points_at(spark, board_table, path):
        _publish_board(spark, roster, totals_table, board_table, path, ranked)


def _init_tables(spark: SparkSession, roster: DataFrame | str, totals_table: str, board_table: str,
                 root: str, zero_board: bool = True, ranked: bool = True) -> None:
    if not spark.catalog.tableExists(totals_table):
        users = _roster(spark, roster).count()
        create_bucket_table(spark, totals_table, TOTALS_DDL, f"{root}/totals", max(BUCKETS, -(-users // USERS_PER_BUCKET)))
    if not spark.catalog.tableExists(board_table):
        shape = _board(_roster(spark, roster), spark.table(totals_table).drop("bucket"), ranked=False)[0]
        if ranked:   # the ranked schema, built lazily (ranking itself would run jobs)
            shape = podium(shape.withColumn("rank", F.lit(None).cast("long")))
        spark.sql(f"CREATE TABLE {board_table} ({_ddl(shape)}) USING parquet "
                  f"LOCATION '{root}/board/initial'")
        if zero_board:
            _publish_zero_board(spark, roster, totals_table, board_table, root, ranked)


def _publish_zero_board(spark, roster, totals_table, board_table, root, ranked=True) -> None:
    """Every roster row at 0/0: the board before any answer has been processed."""
    _publish_board(spark, roster, totals_table, board_table, f"{root}/board/initial-zero", ranked)


def _log_has_entries(spark: SparkSession, path: str) -> bool:
    """Whether a streaming metadata log (e.g. ``<checkpoint>/offsets``) holds any batch."""
    try:
        return bool(spark.read.text(path).limit(1).collect())
    except AnalysisException:
        return False


def _guard_restart(spark: SparkSession, totals_table: str, root: str, checkpoint: str) -> None:
    """Refuse a fresh checkpoint over tables an earlier run already published.

    Merged batches are known by their id; a run whose batch ids start over would
    take merged batches for its own and skip them.
    """
    if _log_has_entries(spark, f"{checkpoint}/offsets"):
        return                                   # a restart: batch ids continue
    if spark.catalog.tableExists(totals_table) and last_batch(spark, totals_table) >= 0:
        raise RuntimeError(f"{totals_table} was published by an earlier run but the checkpoint "
                           f"{checkpoint} is empty: use a new root and tables, or the old checkpoint")


def start_leaderboard(graded: DataFrame, roster: DataFrame | str, totals_table: str, board_table: str,
                      root: str, checkpoint: str, trigger: str | None = None,
                      zero_board: bool = True, ranked: bool = True,
                      rank_every: int = RANK_EVERY) -> StreamingQuery:
    """T2: after every trigger ``board_table`` equals the batch ``leaderboard`` of everything seen.

    With ``rank_every`` over 1 only every so many batches are published (the first included), and what comes after
    the last of them waits for ``rebuild_board``.

    With ``zero_board`` an all-zero board is published before the first trigger,
    so readers of a live board never find it empty.  Pass the roster as a table
    name for long-running streams (see ``LeaderboardRefresher``).  The board keeps one
    previous version, and so does each bucket of the totals; read them by name on every refresh.
    """
    spark = graded.sparkSession
    if trigger not in (None, "availableNow") and not isinstance(roster, str):
        raise ValueError("a live board needs the roster as a table name: it is re-read every "
                         "micro-batch, while a DataFrame would pin one (later released) version")
    for k, v in STREAMING_CONF.items():   # only where the session has not chosen already
        if spark.conf.get(k, None) in (None, ""):
            spark.conf.set(k, v)
    _guard_restart(spark, totals_table, root, checkpoint)
    _init_tables(spark, roster, totals_table, board_table, root, zero_board, ranked)
    totals = score_totals(graded, "user_id")
    w = (totals.writeStream.outputMode("update")
               .option("checkpointLocation", checkpoint)
               .foreachBatch(LeaderboardRefresher(roster, totals_table, board_table, root, ranked, rank_every)))
    return _trigger(w, trigger).start()


def refresh_now(graded: DataFrame, roster: DataFrame | str, totals_table: str, board_table: str,
                root: str, checkpoint: str, ranked: bool = True) -> DataFrame:
    """T3: process everything available, then return the published board."""
    q = start_leaderboard(graded, roster, totals_table, board_table, root, checkpoint, "availableNow",
                          zero_board=False, ranked=ranked, rank_every=0)
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    spark = graded.sparkSession
    batch_id = last_batch(spark, totals_table)
    with _board_lock(board_table):
        if batch_id >= 0:
            _publish_batch(spark, roster, totals_table, board_table, root, batch_id, ranked)
        elif points_at(spark, board_table, f"{root}/board/initial"):
            _publish_zero_board(spark, roster, totals_table, board_table, root, ranked)   # nothing to process
    return spark.read.parquet(table_location(spark, board_table))


def rebuild_board(spark: SparkSession, roster: DataFrame | str, totals_table: str, board_table: str,
                  root: str, ranked: bool = True) -> str:
    """Republish the board from the current totals and roster now (e.g. right after a
    roster sync on a quiet stream); the next micro-batch publishes as usual.

    Call it in the driver that runs the stream: it takes the board's publish lock,
    so it neither races a micro-batch nor reads totals that one is replacing.
    """
    path = f"{root.rstrip('/')}/board/rebuild-{uuid.uuid4().hex[:12]}"
    with _board_lock(board_table):
        _publish_board(spark, roster, totals_table, board_table, path, ranked)
    return path


def graded_stream(responses: DataFrame, bank: DataFrame) -> DataFrame:
    """Guard and grade a response stream; every micro-batch plans its join from the bank's size then."""
    return grade(valid_submissions(responses), bank)

