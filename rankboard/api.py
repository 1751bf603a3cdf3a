"""Table-level operations of the workshop leaderboard, by table name.

These mirror what the reference application does against its warehouse tables
(create, sync users, check eligibility, submit answers, read scores and the
board; seed, refresh, raise and view the snapshot), as Spark jobs over catalog
tables.  ``users``, ``responses``, ``eligible_logins`` and ``get_leaderboard`` are
lazy; ``is_user_eligible`` and ``get_user_score`` aggregate to one row.
``ranked_leaderboard`` and ``Snapshot.view`` run the ranking when they are called and
leave its lineage cut in the shared folder; call and consume them inside
``session.lineage_scope(spark)``, which releases the cut, or publish the board with
``refresh_leaderboard_table`` and read the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import constants as K
from . import schemas as S
from .operators import grading as G
from .operators import leaderboard as L
from .operators import roster as R
from .operators import snapshot as P
from .operators.joins import hot_share
from .operators.pages import RankedPages
from .session import delete_path, lineage_scope, shared_path
from .sources import colocated as CO
from .sources import statistics as ST
from .sources import tables as TB
from .sources.buckets import set_properties

PAGES, PAGES_BEFORE = "rankboard.pages", "rankboard.pages.previous"


class Workshop:
    """Response-sum model over a roster table and an append-only response table."""

    def __init__(self, spark: SparkSession, users_table: str = K.USERS_TABLE,
                 responses_table: str = K.RESPONSES_TABLE, location: str | None = None, colocated: int | None = None):
        """``colocated``: keep roster and responses in so many buckets of the user, so that a board is joined without
        moving either (``sources.colocated``); needs a ``location``."""
        if colocated and not location:
            raise ValueError("co-located tables need a location")
        self.spark = spark
        self.colocated = colocated
        self.users_table = users_table
        self.responses_table = responses_table
        self.location = location.rstrip("/") if location else None

    def _loc(self, table: str) -> str | None:
        return f"{self.location}/{table.replace('.', '_')}/v0" if self.location else None

    # -- DDL ---------------------------------------------------------------------
    def create_tables(self) -> None:
        if "." in self.users_table:
            TB.ensure_namespace(self.spark, self.users_table.rsplit(".", 1)[0])
        if "." in self.responses_table:
            TB.ensure_namespace(self.spark, self.responses_table.rsplit(".", 1)[0])
        if self.colocated:
            for table, ddl in ((self.users_table, S.ROSTER_DDL), (self.responses_table, S.RESPONSES_DDL)):
                CO.create(self.spark, table, ddl, "user_id", self.colocated, self._loc(table))
            return
        TB.create_roster_table(self.spark, self.users_table, self._loc(self.users_table))
        TB.create_responses_table(self.spark, self.responses_table, self._loc(self.responses_table))

    # -- users -------------------------------------------------------------------
    def users(self) -> DataFrame:
        return self.spark.table(self.users_table)

    def sync_users(self, pages: DataFrame, missing_active: bool = False) -> str:
        """Ingest directory pages and MERGE them into the roster; returns the new version path."""
        source = R.ingest_directory(pages, missing_active=missing_active)   # one row per user
        if TB.has_row_level_operations(self.spark, self.users_table):
            TB.native_merge(source, self.users_table, "user_id", ["email", "display_name", "user_name"])
            return TB.table_location(self.spark, self.users_table)
        rewrite = CO.rewrite if self.colocated else TB.rewrite
        return rewrite(self.spark, self.users_table, lambda users: R.upsert(users, source, source_is_unique=True))

    def is_user_eligible(self, email: str) -> bool:
        return bool(R.eligibility(self.users(), email).first()["eligible"])

    def eligible_logins(self, logins: DataFrame) -> DataFrame:
        return R.eligible_logins(logins, self.users())

    # -- responses -----------------------------------------------------------------
    def responses(self) -> DataFrame:
        return self.spark.table(self.responses_table)

    def submit_responses(self, answers: DataFrame, bank: DataFrame | None = None, once: bool = False) -> None:
        """Guard, grade (against ``bank``, or the supplied ``correct_answer``) and append.

        Answers whose question the bank lacks go to the table of ``ungraded``.  Re-submissions append
        further rows, as in the reference; with ``once`` the answers carry their ``response_id`` and ids that
        are stored already are left out, so a load may be sent again.
        """
        if once and "response_id" not in answers.columns:
            raise ValueError("answers need a response_id to be stored once")
        valid = G.valid_submissions(answers)
        if bank is not None:   # ids are drawn after the split: the sides share no row
            unknown = G.ungraded(valid, bank)
            cols = [c for c in S.RESPONSE_COLUMNS if c in unknown.columns and c not in ("correct_answer", "points_earned")]
            table = self._ungraded_table()
            TB.create_responses_table(self.spark, table, self._loc(table))
            self._append(G.assign_response_ids(unknown.select(*cols)), table, once)
            graded = G.grade(valid, bank)
        else:
            graded = G.grade_supplied(valid)
        self._append(G.assign_response_ids(graded), self.responses_table, once)

    def _ungraded_table(self) -> str:
        return f"{self.responses_table}_ungraded"

    def _append(self, rows: DataFrame, table: str, once: bool) -> None:
        cols = [c for c in S.RESPONSE_COLUMNS if c in rows.columns]
        if once:
            TB.append_new(rows, table, "response_id", cols)
        else:
            TB.insert(rows, table, cols)

    def ungraded(self) -> DataFrame:
        """Submitted answers that no bank had a question for (no grade, no points)."""
        table = self._ungraded_table()
        if not self.spark.catalog.tableExists(table):
            return self.responses().where("false")
        return self.spark.table(table)

    def get_user_score(self, user_id: str) -> int:
        return int(L.user_score(self.responses(), user_id).first()["total_points"])

    def get_leaderboard(self, keep_key: bool = False) -> DataFrame:
        return L.leaderboard(self.users(), self.responses(), keep_key=keep_key)

    def ranked_leaderboard(self) -> DataFrame:
        return L.ranked(self.get_leaderboard(keep_key=True))

    def sync_stream(self, path: str, checkpoint: str, missing_active: bool = False, trigger: str | None = "30 seconds"):
        """Keep the roster in step with directory pages that arrive as files under ``path``, in any order
        (``streaming.directory``); returns the ``StreamingQuery``.  Not for co-located tables."""
        from .streaming import directory as SD
        if self.colocated:
            raise ValueError("a co-located roster is synced with sync_users")
        pages = SD.stream_directory_pages(self.spark, path)
        return SD.start_directory_sync(pages, self.users_table, checkpoint, missing_active, trigger=trigger)

    def live_board(self, answers: DataFrame, bank: DataFrame, root: str,
                   board_table: str = K.LEADERBOARD_TABLE, trigger: str | None = "30 seconds"):
        """Start the refreshing board (T2) over a stream of answers.

        ``answers`` is a streaming DataFrame of ``response_id, user_id,
        question_id, user_answer`` (ids from the source keep retries idempotent);
        state, versions and the stream checkpoint live under ``root`` (shared
        storage).  Returns the ``StreamingQuery``; ``trigger=None`` processes what
        is available and stops.
        """
        from .streaming import jobs as ST
        graded = ST.graded_stream(answers, bank)
        totals_table = f"{board_table}_totals"
        # the roster goes in by name: each micro-batch reads its current version
        return ST.start_leaderboard(graded, self.users_table, totals_table, board_table, root.rstrip("/"),
                                    f"{root.rstrip('/')}/checkpoint", trigger)

    def live_page(self, board_table: str = K.LEADERBOARD_TABLE, page_no: int = 1, page_size: int = K.PAGE_SIZE) -> DataFrame:
        """A page of a live board, read through its rank index: only the buckets that hold these ranks."""
        from .streaming.live_index import RankIndex
        first = (page_no - 1) * page_size + 1
        return L.podium(RankIndex.of(self.spark, board_table).ranks(first, first + page_size - 1))

    def live_rank(self, user_id: str, board_table: str = K.LEADERBOARD_TABLE) -> DataFrame:
        """One user's place on a live board, by a look into the user's bucket."""
        from .streaming.live_index import RankIndex
        return L.podium(RankIndex.of(self.spark, board_table).rank_of(user_id))

    def refresh_leaderboard_table(self, table: str = K.LEADERBOARD_TABLE) -> str:
        """Materialise the ranked board into ``table`` (created on first use), as one new version, with its pages
        (``board_page``)."""
        pages = L.board_pages(self.get_leaderboard(keep_key=True), shared_path(self.spark, "pages", table))
        board = L.podium(pages.all())
        if not self.spark.catalog.tableExists(table):
            loc = f" LOCATION '{self._loc(table)}'" if self.location else ""
            cols = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in board.schema.fields)
            self.spark.sql(f"CREATE TABLE {table} ({cols}) USING parquet{loc}")
        path = TB.refresh(board, table)
        old = {k: TB.table_property(self.spark, table, k) for k in (PAGES, PAGES_BEFORE)}
        set_properties(self.spark, table, {PAGES: pages.path, PAGES_BEFORE: old[PAGES] or ""})
        if old[PAGES_BEFORE]:   # as with the versions, the previous pages stay for their readers
            delete_path(self.spark, old[PAGES_BEFORE])
        return path

    def board_page(self, page_no: int, page_size: int = K.PAGE_SIZE, table: str = K.LEADERBOARD_TABLE) -> DataFrame:
        """A page of the board that ``refresh_leaderboard_table`` published last: a scan of the files of its ranks."""
        return L.board_page(RankedPages(self.spark, TB.table_property(self.spark, table, PAGES)), page_no, page_size)


class Snapshot:
    """Snapshot model: seeded participants with a mutable score column."""

    def __init__(self, spark: SparkSession, table: str = K.SNAPSHOT_TABLE, location: str | None = None):
        self.spark = spark
        self.table = table
        self.location = location

    def create_table(self) -> None:
        if "." in self.table:
            TB.ensure_namespace(self.spark, self.table.rsplit(".", 1)[0])
        loc = f"{self.location.rstrip('/')}/{self.table.replace('.', '_')}/v0" if self.location else None
        TB.create_snapshot_table(self.spark, self.table, loc)

    def refresh(self, roster: DataFrame, demo_when_empty: bool = True) -> str:
        """Full refresh from the roster: every score back to 0 (as the reference does)."""
        src = R.label_status(roster)
        with lineage_scope(self.spark):
            if demo_when_empty:   # the roster is evaluated once
                src = R.stored_with_defaults(src, R.demo_participants(self.spark))
            path = TB.refresh(P.participants_seed(src), self.table)
        if not TB.has_row_level_operations(self.spark, self.table):
            ST.record(self.spark, self.table, "email")
        return path

    def add_points(self, increments: DataFrame) -> str:
        """Apply ``(email, points)`` increments: the format's own MERGE where it has one, else a new version; if another
        writer came first, they are applied to what it left.  Hot emails are known from the table's statistics."""
        if TB.has_row_level_operations(self.spark, self.table):
            TB.native_increment(P.score_deltas(increments), self.table, "email", "score", "_delta")
            return TB.table_location(self.spark, self.table)
        known = []

        def change(snap: DataFrame) -> DataFrame:
            known[:] = [ST.current(self.spark, self.table, "email")]
            return P.apply_increments(snap, increments, hot=ST.hot_keys(self.spark, self.table, "email", hot_share(snap)))

        path = TB.rewrite(self.spark, self.table, change)
        ST.carry(self.spark, self.table, "email", known[0])   # increments change no email
        return path

    def add_points_to(self, email: str, points: int) -> str:
        """``UPDATE ... SET score = score + points WHERE email = ...``: one statement where the format has it."""
        if TB.has_row_level_operations(self.spark, self.table):
            TB.native_update(self.spark, self.table, "score", points, "email", email)
            return TB.table_location(self.spark, self.table)
        return self.add_points(self.spark.createDataFrame([(email, points)], "email string, points int"))

    def view(self) -> DataFrame:
        return P.leaderboard_view(self.spark.table(self.table))
