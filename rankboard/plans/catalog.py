"""The query catalogue: one Spark plan per operator key of the survey.

Every query reads the driver's tables (``customer``, ``events``, ``part``) and
derives its inputs with ``plans.inputs``; the matching DuckDB SQL is in
``plans.oracle.SQL`` under the same key.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from .. import schemas as S
from ..operators import grading as G
from ..operators import leaderboard as L
from ..operators import roster as R
from ..operators import snapshot as P
from ..operators.joins import hot_share
from ..session import cut_lineage, ensure_checkpoint_dir, lineage_scope, shared_path
from ..sources import colocated as CO
from ..sources import directory as D
from ..sources import statistics as SX
from ..sources import tables as TB
from ..streaming import directory as SD
from ..streaming import jobs as ST
from ..streaming.live_index import RankIndex
from . import inputs as I

GRADED_COLUMNS = ["response_id", "user_id", "question_id", "user_answer", "correct_answer",
                  "points_earned"]
PODIUM_COLUMNS = ["rank", "user_id", "display_name", "email", "total_points", "questions_answered",
                  "medal", "tier", "row_class", "highlight"]
SEED_COLUMNS = [c for c in S.SNAPSHOT_COLUMNS if c != "last_updated"]


def _t(spark, sf, name):
    return I.table(spark, sf, name)


def _roster(spark, sf):
    return I.roster(_t(spark, sf, "customer"))


def _graded(spark, sf, responses=None):
    r = responses if responses is not None else I.responses(_t(spark, sf, "events"))
    return G.grade(G.valid_submissions(r), I.quiz_bank(spark))


def _board(spark, sf, keep_key=True):
    return L.leaderboard(_roster(spark, sf), _graded(spark, sf), keep_key=keep_key)


def _unique(name: str) -> str:
    return f"{name}_{uuid.uuid4().hex[:10]}"


# --- roster -------------------------------------------------------------------

def _export(spark, sf) -> str:
    """Write the directory export (JSON Lines pages) to the shared folder."""
    ensure_checkpoint_dir(spark)
    path = shared_path(spark, "directory_export")
    D.write_directory_pages(I.directory_pages(_t(spark, sf, "customer")), path)
    return path


def q_roster_ingest(spark, sf):
    return R.ingest_directory(D.read_directory_pages(spark, _export(spark, sf)))


def q_roster_active_strict(spark, sf):
    users = R.directory_users(D.read_directory_pages(spark, _export(spark, sf)))
    return R.flatten_users(users, missing_active=False)


def q_roster_active_lenient(spark, sf):
    users = R.directory_users(D.read_directory_pages(spark, _export(spark, sf)))
    return R.flatten_users(users, missing_active=True)


def q_roster_ingest_lenient(spark, sf):
    """The second directory client's defaults: missing flag = active, missing email = ''."""
    pages = D.read_directory_pages(spark, _export(spark, sf))
    return R.ingest_directory(pages, missing_active=True, missing_email="")


def q_roster_counts(spark, sf):
    users = R.directory_users(D.read_directory_pages(spark, _export(spark, sf)))
    return R.roster_counts(users)


def q_roster_upsert(spark, sf):
    """Create the roster table, load it, MERGE the update batch, read the new version."""
    ensure_checkpoint_dir(spark)
    table = _unique("rb_roster")
    TB.create_roster_table(spark, table, shared_path(spark, "tables", table, "v0", unique=False))
    TB.insert(_roster(spark, sf), table, S.ROSTER_COLUMNS)
    source = I.update_batch(_t(spark, sf, "customer"))   # one row per key: c_custkey is unique
    TB.rewrite(spark, table, lambda roster: R.upsert(roster, source, source_is_unique=True))
    return spark.table(table).select(*S.ROSTER_COLUMNS)


def _empty_roster(roster):
    """The roster filtered to nothing by a data predicate (the scan still runs)."""
    return roster.where(F.col("user_id").isNull())


def q_default_rows_empty(spark, sf):
    return R.stored_with_defaults(_empty_roster(_roster(spark, sf)), R.default_users(spark))


def q_default_rows_nonempty(spark, sf):
    return R.stored_with_defaults(_roster(spark, sf), R.default_users(spark))


def q_eligibility_check(spark, sf):
    return R.eligibility(_roster(spark, sf), I.PROBE_EMAIL)


def q_eligible_logins(spark, sf):
    return R.eligible_logins(I.logins(_t(spark, sf, "customer")), _roster(spark, sf))


def q_rejected_logins(spark, sf):
    return R.rejected_logins(I.logins(_t(spark, sf, "customer")), _roster(spark, sf))


# --- grading ----------------------------------------------------------------------

def q_valid_submissions(spark, sf):
    return G.valid_submissions(I.responses_with_blanks(_t(spark, sf, "events"))).select(
        "response_id", "user_id", "question_id", "user_answer")


def q_grade_responses(spark, sf):
    return _graded(spark, sf).select(*GRADED_COLUMNS)


def q_grade_with_blanks(spark, sf):
    """Grading behind the submission guard: NULL and empty answers are not stored."""
    return _graded(spark, sf, I.responses_with_blanks(_t(spark, sf, "events"))).select(*GRADED_COLUMNS)


def q_ungraded_responses(spark, sf):
    """What a bank that lacks some questions cannot grade."""
    valid = G.valid_submissions(I.responses(_t(spark, sf, "events")))
    return G.ungraded(valid, I.narrow_bank(spark)).select("response_id", "user_id", "question_id", "user_answer")


def q_response_ids(spark, sf):
    """Generated response ids, written once and read back: how many, how many different, all well-formed."""
    rows = G.assign_response_ids(I.responses(_t(spark, sf, "events")).drop("response_id")).select("response_id")
    held = cut_lineage(rows, "response_ids")
    well = F.col("response_id").rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$")
    return held.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("response_id").alias("n_ids"),
                    F.bool_and(well).alias("well_formed"))


def q_submit_append(spark, sf):
    """Grade, append to the response table (created idempotently), read the table back."""
    ensure_checkpoint_dir(spark)
    table = _unique("rb_responses")
    TB.create_responses_table(spark, table, shared_path(spark, "tables", table, "v0", unique=False))
    TB.create_responses_table(spark, table)  # idempotent
    TB.insert(_graded(spark, sf), table, GRADED_COLUMNS)  # submitted_at takes its DEFAULT
    return spark.table(table).select(*GRADED_COLUMNS)


def q_submit_once(spark, sf):
    """Replay-safe append: the same graded answers sent twice are stored once."""
    ensure_checkpoint_dir(spark)
    table = _unique("rb_responses")
    TB.create_responses_table(spark, table, shared_path(spark, "tables", table, "v0", unique=False))
    graded = cut_lineage(_graded(spark, sf).select(*GRADED_COLUMNS), "graded")
    for _ in range(2):
        TB.append_new(graded, table, "response_id", GRADED_COLUMNS)
    return spark.table(table).select(*GRADED_COLUMNS)


def q_answer_feedback(spark, sf):
    return G.answer_feedback(_graded(spark, sf).select(*GRADED_COLUMNS))


def q_question_options(spark, sf):
    return G.question_options(I.nation_bank(_t(spark, sf, "nation"), _t(spark, sf, "region")))


def q_max_score(spark, sf):
    return G.max_score(I.nation_bank(_t(spark, sf, "nation"), _t(spark, sf, "region")))


# --- response-sum leaderboard ---------------------------------------------------------

def q_leaderboard(spark, sf):
    return L.leaderboard(_roster(spark, sf), _graded(spark, sf))


def q_leaderboard_colocated(spark, sf):
    """The board from roster and responses that are stored in buckets of the user: joined where they lie."""
    ensure_checkpoint_dir(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    users, answers = _unique("rb_users"), _unique("rb_answers")
    place = lambda t: shared_path(spark, "tables", t, "v0", unique=False)
    CO.create(spark, users, S.ROSTER_DDL, "user_id", n, place(users))
    CO.create(spark, answers, "response_id STRING, user_id STRING, points_earned INT", "user_id", n, place(answers))
    CO.publish(_roster(spark, sf).withColumn("created_at", F.current_timestamp()), users)
    CO.publish(_graded(spark, sf).select("response_id", "user_id", "points_earned"), answers)
    return L.leaderboard(spark.table(users), spark.table(answers))


def q_leaderboard_by_email(spark, sf):
    graded = _graded(spark, sf, I.responses_by_email(_t(spark, sf, "events")))
    return L.leaderboard(_roster(spark, sf), graded, key="email", response_key="user_id")


def q_leaderboard_ranked(spark, sf):
    return L.ranked(_board(spark, sf)).select(*PODIUM_COLUMNS)


def q_leaderboard_top200(spark, sf):
    return L.top(_board(spark, sf), K.DISPLAY_LIMIT).select(*PODIUM_COLUMNS)


def q_leaderboard_top20(spark, sf):
    return L.top(_board(spark, sf), K.FALLBACK_DISPLAY_LIMIT).select(*PODIUM_COLUMNS)


def q_leaderboard_page(spark, sf):
    return L.page(_board(spark, sf), 2, K.PAGE_SIZE).select(*PODIUM_COLUMNS, "page")


def q_leaderboard_page_last(spark, sf):
    """The last page, by the same path as any other; its number comes from the page index."""
    pages = L.board_pages(_board(spark, sf))
    return L.board_page(pages, pages.last_page(K.PAGE_SIZE)).select(*PODIUM_COLUMNS, "page")


def q_leaderboard_progress(spark, sf):
    n = len(I.EVENT_QUIZ)
    return L.progress(_board(spark, sf), n * K.POINTS_PER_QUESTION, n)


def q_leaderboard_sorted(spark, sf):
    return L.sorted_by(_board(spark, sf), "display_name", ascending=False)


def q_user_score(spark, sf):
    users = [I.PROBE_USER, I.ABSENT_USER]
    numbers = [int(u) for u in users if u.isdigit()]   # the log's own type
    events = _t(spark, sf, "events").where(F.col("user_id").isin(numbers))
    return L.user_scores(_graded(spark, sf, I.responses(events)), users)


def q_participant_count(spark, sf):
    return L.participant_count(_board(spark, sf, keep_key=False))


# --- snapshot model -------------------------------------------------------------------

def _seed(spark, sf, with_timestamp=False):
    return P.participants_seed(_roster(spark, sf), with_timestamp=with_timestamp)


def q_participants_seed(spark, sf):
    return _seed(spark, sf)


def q_participants_seed_demo(spark, sf):
    """An empty roster seeds the substituted demo participants: inactive, in list order."""
    roster = R.with_defaults(R.label_status(_empty_roster(_roster(spark, sf))), R.demo_participants(spark))
    return P.participants_seed(roster, with_timestamp=False)


def q_participants_top200(spark, sf):
    """The participants list as displayed: the first rows in userName order."""
    return P.participants_top(_roster(spark, sf), K.DISPLAY_LIMIT, with_timestamp=False)


def _stored_snapshot(spark, sf) -> str:
    """A snapshot table, refreshed from the seed; the rank's cut is released once it is stored."""
    ensure_checkpoint_dir(spark)
    table = _unique("rb_snapshot")
    TB.create_snapshot_table(spark, table, shared_path(spark, "tables", table, "v0", unique=False))
    with lineage_scope(spark):
        TB.replace_contents(_seed(spark, sf, with_timestamp=True), table)
    SX.record(spark, table, "email")
    return table


def q_snapshot_refresh(spark, sf):
    """Create the snapshot table, fully refresh it from the seed, read it back."""
    return spark.table(_stored_snapshot(spark, sf)).select(*SEED_COLUMNS)


def _incremented(spark, sf):
    """The stored snapshot with the increments applied; its hot emails are known from the stored statistics."""
    table = _stored_snapshot(spark, sf)
    snapshot = spark.table(table)
    hot = SX.hot_keys(spark, table, "email", hot_share(snapshot))
    return P.apply_increments(snapshot, I.increments(_t(spark, sf, "events"), _roster(spark, sf)), hot=hot)


def q_score_increment(spark, sf):
    return _incremented(spark, sf).select(*SEED_COLUMNS)


def q_leaderboard_view(spark, sf):
    return P.leaderboard_view(_incremented(spark, sf))


def q_view_sorted(spark, sf):
    return P.view_sorted(_incremented(spark, sf), "last_name", ascending=False)


def q_view_page(spark, sf):
    return P.view_page(_incremented(spark, sf), 2, K.PAGE_SIZE)


def q_view_highlight(spark, sf):
    return P.highlighted(P.leaderboard_view(_incremented(spark, sf)))


def q_namespace_roundtrip(spark, sf):
    """Write the roster through a namespace that is ensured twice, and read it back by its full name."""
    ensure_checkpoint_dir(spark)
    space = _unique("rb_space")
    TB.ensure_namespace(spark, space)
    TB.ensure_namespace(spark, space)
    table = f"{space}.eligible_users"
    TB.create_roster_table(spark, table, shared_path(spark, "tables", space, "v0", unique=False))
    TB.insert(_roster(spark, sf), table, S.ROSTER_COLUMNS)
    return spark.table(table).select(*S.ROSTER_COLUMNS)


# --- scalar functions ----------------------------------------------------------------

def q_name_split(spark, sf):
    from ..functions import first_token, last_token
    n = I.names(spark, _t(spark, sf, "part"))
    return n.select("name", first_token("name").alias("first_name"), last_token("name").alias("last_name"))


def q_id_truncate(spark, sf):
    from ..functions import truncate_id
    names = _t(spark, sf, "customer").select(F.col("c_name").alias("name")).unionByName(
        _t(spark, sf, "part").select(F.col("p_name").alias("name")))
    return names.select("name", truncate_id("name").alias("short_id"))


def q_demo_flag(spark, sf):
    roster = R.label_status(_roster(spark, sf))
    demo = R.demo_participants(spark)
    empty = R.with_defaults(_empty_roster(roster), demo)
    full = R.with_defaults(roster, demo)
    return (R.contains_demo_rows(empty).select(F.lit("empty_roster").alias("input"), "is_demo")
            .unionByName(R.contains_demo_rows(full).select(F.lit("roster").alias("input"), "is_demo")))


def q_submitted_clock(spark, sf):
    from ..functions import clock_label
    r = I.responses(_t(spark, sf, "events"))
    return r.select("response_id", clock_label("submitted_at").alias("clock"))


# --- streaming ------------------------------------------------------------------------

def _event_stream(spark, sf):
    schema = _t(spark, sf, "events").schema
    return ST.stream_files(spark, sf, schema, glob="events.parquet")


def _event_stream_in_batches(spark, sf, root):
    """The events as two files, read one per trigger, so the board takes more than one micro-batch."""
    events = _t(spark, sf, "events")
    path = f"{root}/events"
    events.repartition(2, "user_id").write.option("maxRecordsPerFile", 0).parquet(path)
    return ST.stream_files(spark, path, events.schema, max_files_per_trigger=1)


def q_stream_ungraded(spark, sf):
    """The grading stream's second sink: what a bank that lacks some questions cannot grade."""
    ensure_checkpoint_dir(spark)
    root = shared_path(spark, "stream_ungraded")
    q = ST.start_grading(I.responses(_event_stream(spark, sf)), I.narrow_bank(spark), f"{root}/sink", f"{root}/checkpoint")
    _finish(q)
    return spark.read.parquet(f"{root}/sink_ungraded").select("response_id", "user_id", "question_id", "user_answer")


def q_roster_stream(spark, sf):
    """The directory export as a stream of page files, several triggers long, MERGEd into the roster table."""
    export = _export(spark, sf)
    table, root = _unique("rb_roster"), shared_path(spark, "roster_stream")
    TB.create_roster_table(spark, table, f"{root}/v0")
    files = -(-len(spark.read.text(export).inputFiles()) // 3)
    _finish(SD.start_directory_sync(SD.stream_directory_pages(spark, export, files), table, f"{root}/checkpoint"))
    return spark.table(table).select(*S.ROSTER_COLUMNS)


def _live_board(spark, sf) -> str:
    """A live board after all events, a file a trigger; it is published from the rank index at every trigger."""
    ensure_checkpoint_dir(spark)
    root, board = shared_path(spark, "live_board"), _unique("rb_live")
    graded = ST.graded_stream(I.responses(_event_stream_in_batches(spark, sf, root)), I.quiz_bank(spark))
    _finish(ST.start_leaderboard(graded, _roster(spark, sf), _unique("rb_totals"), board, root, f"{root}/checkpoint",
                                 zero_board=False))
    return board


def q_stream_live_board(spark, sf):
    return spark.table(_live_board(spark, sf)).select(*PODIUM_COLUMNS)


def q_live_board_page(spark, sf):
    """The second page of a live board, looked up in its rank index."""
    first = K.PAGE_SIZE + 1
    page = RankIndex.of(spark, _live_board(spark, sf)).ranks(first, first + K.PAGE_SIZE - 1)
    return L.podium(page).select(*PODIUM_COLUMNS, F.lit(2).alias("page"))


def _finish(q):
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()


def q_stream_grade(spark, sf):
    ensure_checkpoint_dir(spark)
    root = shared_path(spark, "stream_grade")
    events = _event_stream(spark, sf)
    bank = I.quiz_bank(spark)
    q = ST.start_grading(I.responses(events), bank, f"{root}/sink", f"{root}/checkpoint")
    _finish(q)
    return spark.read.parquet(f"{root}/sink").select(*GRADED_COLUMNS)


def q_stream_leaderboard(spark, sf):
    ensure_checkpoint_dir(spark)
    root = shared_path(spark, "stream_leaderboard")
    events = _event_stream_in_batches(spark, sf, root)
    bank = I.quiz_bank(spark)
    graded = ST.graded_stream(I.responses(events), bank)
    board = ST.refresh_now(graded, _roster(spark, sf), _unique("rb_totals"), _unique("rb_board"),
                           root, f"{root}/checkpoint")
    return board.select(*PODIUM_COLUMNS)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "leaderboard": q_leaderboard,
    "roster_ingest": q_roster_ingest,
    "roster_ingest_lenient": q_roster_ingest_lenient,
    "roster_active_strict": q_roster_active_strict,
    "roster_active_lenient": q_roster_active_lenient,
    "roster_counts": q_roster_counts,
    "roster_upsert": q_roster_upsert,
    "default_rows_empty": q_default_rows_empty,
    "default_rows_nonempty": q_default_rows_nonempty,
    "eligibility_check": q_eligibility_check,
    "eligible_logins": q_eligible_logins,
    "rejected_logins": q_rejected_logins,
    "valid_submissions": q_valid_submissions,
    "grade_responses": q_grade_responses,
    "grade_with_blanks": q_grade_with_blanks,
    "ungraded_responses": q_ungraded_responses,
    "response_ids": q_response_ids,
    "submit_append": q_submit_append,
    "stream_grade": q_stream_grade,
    "answer_feedback": q_answer_feedback,
    "question_options": q_question_options,
    "max_score": q_max_score,
    "stream_leaderboard": q_stream_leaderboard,
    "stream_live_board": q_stream_live_board,
    "live_board_page": q_live_board_page,
    "stream_ungraded": q_stream_ungraded,
    "roster_stream": q_roster_stream,
    "submit_once": q_submit_once,
    "leaderboard_colocated": q_leaderboard_colocated,
    "leaderboard_by_email": q_leaderboard_by_email,
    "leaderboard_ranked": q_leaderboard_ranked,
    "leaderboard_progress": q_leaderboard_progress,
    "leaderboard_top200": q_leaderboard_top200,
    "leaderboard_top20": q_leaderboard_top20,
    "leaderboard_page": q_leaderboard_page,
    "leaderboard_page_last": q_leaderboard_page_last,
    "leaderboard_sorted": q_leaderboard_sorted,
    "user_score": q_user_score,
    "participant_count": q_participant_count,
    "participants_seed": q_participants_seed,
    "participants_seed_demo": q_participants_seed_demo,
    "participants_top200": q_participants_top200,
    "namespace_roundtrip": q_namespace_roundtrip,
    "snapshot_refresh": q_snapshot_refresh,
    "score_increment": q_score_increment,
    "leaderboard_view": q_leaderboard_view,
    "view_sorted": q_view_sorted,
    "view_page": q_view_page,
    "view_highlight": q_view_highlight,
    "name_split": q_name_split,
    "id_truncate": q_id_truncate,
    "demo_flag": q_demo_flag,
    "submitted_clock": q_submitted_clock,
}
