import os
import uuid

from rankboard.operators import grading as G
from rankboard.operators import leaderboard as L
from rankboard.plans import inputs as I
from rankboard.streaming import jobs as ST

SF = "/root/testdata/sf0.001"


def _split_events(spark, scratch):
    """Copy the smoke events into two files so the stream sees two micro-batches."""
    ev = I.table(spark, SF, "events")
    src = f"{scratch}/events_src"
    ev.where("event_id % 2 = 0").coalesce(1).write.parquet(f"{src}/part=a")
    ev.where("event_id % 2 = 1").coalesce(1).write.parquet(f"{src}/part=b")
    return ev, src


def _stream(spark, src, schema):
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", "1")
            .option("recursiveFileLookup", "true").parquet(src))


def test_stream_grade_equals_batch(spark, scratch):
    ev, src = _split_events(spark, scratch)
    bank = I.quiz_bank(spark)
    q = ST.start_grading(I.responses(_stream(spark, src, ev.schema)), bank, f"{scratch}/sink", f"{scratch}/ck")
    q.awaitTermination()
    cols = ["response_id", "points_earned", "correct_answer"]
    got = sorted(tuple(r) for r in spark.read.parquet(f"{scratch}/sink").select(*cols).collect())
    want = sorted(tuple(r) for r in G.grade(G.valid_submissions(I.responses(ev)), bank).select(*cols).collect())
    assert got == want


def test_stream_leaderboard_equals_batch_over_two_batches(spark, scratch):
    ev, src = _split_events(spark, scratch)
    bank = I.quiz_bank(spark)
    roster = I.roster(I.table(spark, SF, "customer"))
    graded = ST.graded_stream(I.responses(_stream(spark, src, ev.schema)), bank)
    totals_t, board_t = f"t_{uuid.uuid4().hex[:8]}", f"b_{uuid.uuid4().hex[:8]}"
    board = ST.refresh_now(graded, roster, totals_t, board_t, f"{scratch}/lb", f"{scratch}/lb_ck")
    assert "v000000000001" in ST.table_location(spark, board_t)       # two micro-batches ran
    want = L.ranked(L.leaderboard(roster, G.grade(G.valid_submissions(I.responses(ev)), bank), keep_key=True))
    cols = ["user_id", "total_points", "questions_answered", "rank", "medal", "tier"]
    assert sorted(tuple(r) for r in board.select(*cols).collect()) == \
        sorted(tuple(r) for r in want.select(*cols).collect())


def _files(path):
    return sorted(os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.startswith("part-"))


def test_a_trigger_rewrites_only_the_buckets_it_touches(spark, scratch):
    roster = spark.createDataFrame([(str(i), f"{i}@x", "N", "n") for i in range(400)],
                                   "user_id string, email string, display_name string, user_name string")
    totals_t, board_t = f"t_{uuid.uuid4().hex[:8]}", f"b_{uuid.uuid4().hex[:8]}"
    root = f"{scratch}/lb"
    ST._init_tables(spark, roster, totals_t, board_t, root, zero_board=False)
    schema = "user_id string, total_points long, questions_answered long"
    fn = ST.LeaderboardRefresher(roster, totals_t, board_t, root, rank_every=2)
    fn(spark.createDataFrame([(str(i), 10, 1) for i in range(400)], schema), 0)
    before, board = _files(f"{root}/totals"), ST.table_location(spark, board_t)
    assert len({os.path.dirname(f) for f in before}) > 50
    fn(spark.createDataFrame([("7", 20, 2), ("9", 30, 3)], schema), 1)
    after = _files(f"{root}/totals")
    assert set(before) <= set(after)                             # what a reader may hold stays
    new = {os.path.dirname(f) for f in set(after) - set(before)}
    assert 1 <= len(new) <= 2                                    # two users: at most two buckets rewritten
    assert ST.table_location(spark, board_t) == board            # not ranked in this trigger
    got = {r["user_id"]: r["total_points"] for r in spark.table(totals_t).collect()}
    assert len(got) == 400 and got["7"] == 20 and got["9"] == 30 and got["8"] == 10
    fn(spark.createDataFrame([("8", 50, 4)], schema), 2)
    assert {r["user_id"]: r["rank"] for r in spark.table(board_t).where("rank <= 3").collect()} == {"8": 1, "9": 2, "7": 3}


def test_refresher_batch_retry_is_idempotent(spark, scratch):
    roster = spark.createDataFrame([("1", "a@x", "A", "a"), ("2", "b@x", "B", "b"), ("3", "c@x", "C", "c")],
                                   "user_id string, email string, display_name string, user_name string")
    totals_t, board_t = f"t_{uuid.uuid4().hex[:8]}", f"b_{uuid.uuid4().hex[:8]}"
    root = f"{scratch}/lb"
    ST._init_tables(spark, roster, totals_t, board_t, root)
    fn = ST.LeaderboardRefresher(roster, totals_t, board_t, root)
    schema = "user_id string, total_points long, questions_answered long"
    b0 = spark.createDataFrame([("1", 10, 1), ("3", 20, 2)], schema)
    b1 = spark.createDataFrame([("1", 30, 3), ("2", 10, 1)], schema)   # user 3 unchanged
    fn(b0, 0)
    fn(b1, 1)
    published = ST.table_location(spark, board_t)
    files = _files(f"{root}/totals"), _files(f"{root}/board/v000000000001")
    fn(b1, 1)   # retried batch: already published, nothing is rewritten
    assert ST.table_location(spark, board_t) == published
    assert files == (_files(f"{root}/totals"), _files(f"{root}/board/v000000000001"))
    want = {"1": (30, 3), "2": (10, 1), "3": (20, 2)}
    got = {r["user_id"]: (r["total_points"], r["questions_answered"])
           for r in spark.read.parquet(published).collect()}
    assert got == want
    assert {r["user_id"]: (r["total_points"], r["questions_answered"])
            for r in spark.table(totals_t).collect()} == want
    ranks = {r["user_id"]: r["rank"] for r in spark.read.parquet(published).collect()}
    assert ranks == {"1": 1, "3": 2, "2": 3}


def test_refresh_with_no_input_gives_zero_board(spark, scratch):
    ev = I.table(spark, SF, "events")
    src = f"{scratch}/empty_src"
    ev.where("false").write.parquet(src)
    roster = I.roster(I.table(spark, SF, "customer"))
    graded = ST.graded_stream(I.responses(_stream(spark, src, ev.schema)), I.quiz_bank(spark))
    board = ST.refresh_now(graded, roster, f"t_{uuid.uuid4().hex[:8]}", f"b_{uuid.uuid4().hex[:8]}",
                           f"{scratch}/lb", f"{scratch}/lb_ck")
    assert board.count() == roster.count()
    assert board.where("total_points <> 0 OR questions_answered <> 0").count() == 0


def test_refresher_releases_superseded_board_versions(spark, scratch):
    roster = spark.createDataFrame([("1", "a@x", "A", "a"), ("2", "b@x", "B", "b")],
                                   "user_id string, email string, display_name string, user_name string")
    totals_t, board_t = f"t_{uuid.uuid4().hex[:8]}", f"b_{uuid.uuid4().hex[:8]}"
    root = f"{scratch}/lb"
    ST._init_tables(spark, roster, totals_t, board_t, root)
    fn = ST.LeaderboardRefresher(roster, totals_t, board_t, root)
    schema = "user_id string, total_points long, questions_answered long"
    for i in range(3):
        fn(spark.createDataFrame([("1", 10 * (i + 1), i + 1)], schema), i)
    assert spark.read.parquet(f"{root}/board/v000000000002").count() == 2
    assert spark.read.parquet(f"{root}/board/v000000000001").count() == 2   # previous version kept
    assert spark.read.parquet(f"{root}/board/v000000000000").count() == 0   # older version released


def test_refresher_reads_roster_by_name_across_syncs(spark, scratch):
    from rankboard.operators import roster as R
    from rankboard.sources import tables as TB
    roster_t = f"r_{uuid.uuid4().hex[:8]}"
    TB.create_roster_table(spark, roster_t, f"{scratch}/roster/v0")
    cols = "user_id string, email string, display_name string, user_name string"
    TB.insert(spark.createDataFrame([("1", "a@x", "A", "a")], cols), roster_t)
    totals_t, board_t = f"t_{uuid.uuid4().hex[:8]}", f"b_{uuid.uuid4().hex[:8]}"
    root = f"{scratch}/lb"
    ST._init_tables(spark, roster_t, totals_t, board_t, root)
    fn = ST.LeaderboardRefresher(roster_t, totals_t, board_t, root)
    schema = "user_id string, total_points long, questions_answered long"
    fn(spark.createDataFrame([("1", 10, 1)], schema), 0)
    for i in (2, 3):   # two syncs, each adding a user
        TB.replace_contents(R.upsert(spark.table(roster_t), spark.createDataFrame([(str(i), f"{i}@x", "N", "n")], cols)),
                            roster_t)
    fn(spark.createDataFrame([("2", 20, 2)], schema), 1)
    got = {r["user_id"]: (r["total_points"], r["rank"]) for r in spark.table(board_t).collect()}
    assert got == {"2": (20, 1), "1": (10, 2), "3": (0, 3)}


def test_fresh_checkpoint_over_published_tables_is_refused(spark, scratch):
    import pytest
    ev, src = _split_events(spark, scratch)
    roster = I.roster(I.table(spark, SF, "customer"))
    totals_t, board_t = f"t_{uuid.uuid4().hex[:8]}", f"b_{uuid.uuid4().hex[:8]}"
    graded = ST.graded_stream(I.responses(_stream(spark, src, ev.schema)), I.quiz_bank(spark))
    ST.refresh_now(graded, roster, totals_t, board_t, f"{scratch}/lb", f"{scratch}/ck1")
    # same checkpoint again: a restart, batch ids continue, nothing to do
    ST.refresh_now(graded, roster, totals_t, board_t, f"{scratch}/lb", f"{scratch}/ck1")
    with pytest.raises(RuntimeError, match="checkpoint"):
        ST.refresh_now(graded, roster, totals_t, board_t, f"{scratch}/lb", f"{scratch}/ck2")


def test_live_board_needs_roster_by_name(spark, scratch):
    import pytest
    ev, src = _split_events(spark, scratch)
    graded = ST.graded_stream(I.responses(_stream(spark, src, ev.schema)), I.quiz_bank(spark))
    with pytest.raises(ValueError, match="table name"):
        ST.start_leaderboard(graded, I.roster(I.table(spark, SF, "customer")), "t_x", "b_x",
                             f"{scratch}/lb", f"{scratch}/ck", trigger="30 seconds")


def test_rebuild_board_picks_up_roster_sync(spark, scratch):
    from rankboard.sources import tables as TB
    roster_t = f"r_{uuid.uuid4().hex[:8]}"
    TB.create_roster_table(spark, roster_t, f"{scratch}/roster/v0")
    cols = "user_id string, email string, display_name string, user_name string"
    TB.insert(spark.createDataFrame([("1", "a@x", "A", "a")], cols), roster_t)
    totals_t, board_t = f"t_{uuid.uuid4().hex[:8]}", f"b_{uuid.uuid4().hex[:8]}"
    ST._init_tables(spark, roster_t, totals_t, board_t, f"{scratch}/lb")
    TB.insert(spark.createDataFrame([("2", "b@x", "B", "b")], cols), roster_t)
    ST.rebuild_board(spark, roster_t, totals_t, board_t, f"{scratch}/lb")
    assert sorted(r["user_id"] for r in spark.table(board_t).collect()) == ["1", "2"]


def test_rebuild_and_batches_are_serialised(spark, scratch):
    import threading
    roster = spark.createDataFrame([("1", "a@x", "A", "a"), ("2", "b@x", "B", "b")],
                                   "user_id string, email string, display_name string, user_name string")
    totals_t, board_t = f"t_{uuid.uuid4().hex[:8]}", f"b_{uuid.uuid4().hex[:8]}"
    root = f"{scratch}/lb"
    ST._init_tables(spark, roster, totals_t, board_t, root)
    fn = ST.LeaderboardRefresher(roster, totals_t, board_t, root)
    schema = "user_id string, total_points long, questions_answered long"
    batches = [spark.createDataFrame([("1", 10 * (i + 1), i + 1)], schema) for i in range(3)]
    t = threading.Thread(target=lambda: [fn(b, i) for i, b in enumerate(batches)])
    t.start()
    for _ in range(2):
        ST.rebuild_board(spark, roster, totals_t, board_t, root)
    t.join()
    ST.rebuild_board(spark, roster, totals_t, board_t, root)
    got = {r["user_id"]: (r["total_points"], r["rank"]) for r in spark.table(board_t).collect()}
    assert got == {"1": (30, 1), "2": (0, 2)}
