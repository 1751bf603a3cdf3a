"""Row-level formats, stored hot-key statistics, replay-safe appends, co-located tables, single-pass defaults."""

import uuid

import pytest
from pyspark.sql import functions as F

from rankboard import api
from rankboard.operators import joins as J
from rankboard.operators import leaderboard as L
from rankboard.operators import roster as R
from rankboard.sources import colocated as C
from rankboard.sources import statistics as ST
from rankboard.sources import tables as TB

ROSTER = "user_id string, email string, display_name string, user_name string"
ANSWERS = "response_id string, user_id string, question_id int, user_answer string, correct_answer string, points_earned int"


def _name(prefix):
    return f"{prefix}_{uuid.uuid4().hex[:8]}"


def _snapshot(spark, scratch, rows=3):
    s = api.Snapshot(spark, _name("snap"), location=scratch)
    s.create_table()
    s.refresh(spark.createDataFrame([(f"p{i}", f"{i % 2}@x", f"N {i}", f"n{i}") for i in range(rows)], ROSTER))
    return s


# -- what the format can do ---------------------------------------------------------------------

def test_row_level_formats_get_no_set_location(spark, scratch, monkeypatch):
    """A table that claims MERGE and UPDATE: every change goes to the format (which parquet refuses), none to a new version."""
    s = _snapshot(spark, scratch)
    at = TB.table_location(spark, s.table)
    monkeypatch.setattr(TB, "has_row_level_operations", lambda *a: True)
    increments = spark.createDataFrame([("0@x", 5), ("0@x", 5)], "email string, points int")
    with pytest.raises(Exception, match="MERGE"):
        s.add_points(increments)
    with pytest.raises(Exception, match="UPDATE"):
        s.add_points_to("0@x", 5)
    asked = []
    monkeypatch.setattr(TB, "native_refresh", lambda df, table: asked.append((df.count(), table)))
    s.refresh(spark.createDataFrame([("p9", "9@x", "N 9", "n9")], ROSTER))
    assert asked == [(1, s.table)]
    assert TB.table_location(spark, s.table) == at and spark.table(s.table).where("score <> 0").count() == 0


def test_native_refresh_is_one_overwrite(spark, scratch, monkeypatch):
    from pyspark.sql.readwriter import DataFrameWriterV2
    s = _snapshot(spark, scratch)
    asked = []
    monkeypatch.setattr(DataFrameWriterV2, "overwrite", lambda self, condition: asked.append(str(condition)))
    TB.native_refresh(spark.table(s.table), s.table)
    assert asked == ["Column<'true'>"]


def test_providers_that_have_row_level_operations(spark, scratch):
    s = _snapshot(spark, scratch)
    assert not TB.has_row_level_operations(spark, s.table)
    assert {"delta", "iceberg"} <= TB.ROW_LEVEL_PROVIDERS


def test_versioned_tables_take_single_updates(spark, scratch):
    s = _snapshot(spark, scratch)
    s.add_points_to("0@x", 7)
    assert sorted((r["email"], r["score"]) for r in spark.table(s.table).collect()) == [("0@x", 7), ("0@x", 7), ("1@x", 0)]


# -- statistics ---------------------------------------------------------------------------------

def _relations(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation ")


def test_a_sketch_names_the_hot_keys(spark, scratch):
    table = _name("hot")
    TB.create_responses_table(spark, table, f"{scratch}/hot")
    rows = lambda hot, n, m: spark.range(n).select(
        F.col("id").cast("string").alias("response_id"), F.when(F.col("id") < m, F.lit(hot)).when(F.col("id") % 9 == 0, None)
        .otherwise(F.col("id").cast("string")).alias("user_id"))
    TB.insert(rows("a", 900, 300), table, ["response_id", "user_id"])
    assert ST.hot_keys(spark, table, "user_id", 8) is None         # nothing stored
    ST.record(spark, table, "user_id")
    same = lambda: ({tuple(r) for r in ST.hot_keys(spark, table, "user_id", 8).collect()}
                    == {tuple(r) for r in J.hot_keys(spark.table(table), "user_id", 8).collect()})
    assert same()
    ST.append(rows("b", 900, 400), table, "user_id", ["response_id", "user_id"])
    assert same() and {r["_hk"] for r in ST.hot_keys(spark, table, "user_id", 8).collect()} == {"a", "b"}
    TB.insert(rows("c", 900, 900), table, ["response_id", "user_id"])
    assert ST.hot_keys(spark, table, "user_id", 8) is None         # another version: not used


def test_with_statistics_the_table_is_read_once(spark, scratch):
    s = _snapshot(spark, scratch, 60)
    increments = spark.createDataFrame([("0@x", 5), ("1@x", 1)], "email string, points int")
    from rankboard.operators import snapshot as P
    snap = spark.table(s.table)
    hot = ST.hot_keys(spark, s.table, "email", J.hot_share(snap))
    assert {r["_hk"] for r in hot.collect()} == {"0@x", "1@x"}
    with_stats, without = P.apply_increments(snap, increments, hot=hot), P.apply_increments(snap, increments)
    reads = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count(f"{s.table}[")
    assert reads(with_stats) == 1 < reads(without)
    assert sorted(map(tuple, with_stats.collect())) == sorted(map(tuple, without.collect()))
    s.add_points(increments)
    assert ST.current(spark, s.table, "email")                     # an increment changes no email: the sketch holds
    s.add_points(increments)
    assert {(r["email"], r["score"]) for r in spark.table(s.table).collect()} == {("0@x", 10), ("1@x", 2)}


# -- appends ------------------------------------------------------------------------------------

def test_an_append_that_is_sent_again_adds_nothing(spark, scratch):
    table = _name("answers")
    TB.create_responses_table(spark, table, f"{scratch}/answers")
    batch = spark.createDataFrame([("r1", "u", 1, "x", "x", 10), ("r2", "u", 2, "y", "x", 0), ("r2", "u", 2, "z", "x", 0),
                                   (None, "v", 1, "x", "x", 10)], ANSWERS)
    for _ in range(2):
        TB.append_new(batch, table, "response_id")
    more = spark.createDataFrame([("r2", "u", 2, "q", "x", 0), ("r3", "u", 3, "x", "x", 10)], ANSWERS)
    TB.append_new(more, table, "response_id")
    got = sorted((str(r["response_id"]), r["user_answer"]) for r in spark.table(table).collect())
    assert got == [("None", "x"), ("None", "x"), ("r1", "x"), ("r2", "z"), ("r3", "x")]
    assert spark.table(table).where("submitted_at IS NULL").count() == 0


def test_submissions_lose_no_answer(spark, scratch):
    w = api.Workshop(spark, _name("users"), _name("responses"), scratch)
    w.create_tables()
    bank = spark.createDataFrame([(1, "q", ["a"], "a")], "id int, question string, options array<string>, correct_answer string")
    assert w.ungraded().count() == 0
    answers = spark.createDataFrame([("r1", "u", 1, "a"), ("r2", "u", 9, "a"), ("r3", "u", None, "a"), ("r4", "u", 1, None)],
                                    "response_id string, user_id string, question_id int, user_answer string")
    for _ in range(2):
        w.submit_responses(answers, bank, once=True)
    assert [r["response_id"] for r in w.responses().collect()] == ["r1"]
    assert sorted(r["response_id"] for r in w.ungraded().collect()) == ["r2", "r3"]
    w.submit_responses(answers.drop("response_id"), bank)
    ids = [r["response_id"] for r in w.responses().unionByName(w.ungraded()).collect()]
    assert len(ids) == 6 == len(set(ids)) and None not in ids
    with pytest.raises(ValueError, match="response_id"):
        w.submit_responses(answers.drop("response_id"), bank, once=True)


# -- co-located tables ----------------------------------------------------------------------------

@pytest.fixture
def no_broadcast(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, before)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_refresh_of_colocated_tables_moves_nothing(spark, scratch, no_broadcast):
    users, answers = _name("co_users"), _name("co_answers")
    C.create(spark, users, "user_id STRING, email STRING, display_name STRING, user_name STRING, created_at TIMESTAMP", "user_id", 4, f"{scratch}/u/v0")
    C.create(spark, answers, "response_id STRING, user_id STRING, points_earned INT", "user_id", 4, f"{scratch}/a/v0")
    roster = spark.createDataFrame([(f"u{i}", f"{i}@x", f"N {i}", f"n{i}") for i in range(50)], ROSTER).withColumn("created_at", F.current_timestamp())
    graded = spark.createDataFrame([(f"r{i}", f"u{i % 7}", 10 * (i % 2)) for i in range(90)], "response_id string, user_id string, points_earned int")
    C.publish(roster, users)
    C.publish(graded, answers)
    board = L.leaderboard(spark.table(users), spark.table(answers), keep_key=True)
    assert "Exchange" not in _plan(board) and "SortMergeJoin" in _plan(board)
    assert sorted(map(tuple, board.collect())) == sorted(map(tuple, L.leaderboard(roster, graded, keep_key=True).collect()))

    source, n = spark.createDataFrame([("u3", "new@x", "N 3", "n3"), ("u99", "99@x", "N 99", "n99")], ROSTER), []
    staged = _name("co_source")
    C.create(spark, staged, ROSTER, "user_id", 4, f"{scratch}/s/v0")
    C.publish(source, staged)
    C.rewrite(spark, users, lambda old: n.append(_plan(R.upsert(old, spark.table(staged), source_is_unique=True)))
              or R.upsert(old, spark.table(staged), source_is_unique=True))
    assert "Exchange" not in n[0]
    now = {r["user_id"]: r["email"] for r in spark.table(users).collect()}
    assert len(now) == 51 and now["u3"] == "new@x" and now["u99"] == "99@x"
    again = L.leaderboard(spark.table(users), spark.table(answers), keep_key=True)
    assert "Exchange" not in _plan(again) and again.count() == 51
    assert len(spark.table(users).inputFiles()) <= 4                # a file a bucket


def test_a_colocated_workshop(spark, scratch, no_broadcast):
    import json

    from rankboard.sources import directory as D
    w = api.Workshop(spark, _name("users"), _name("responses"), scratch, colocated=4)
    w.create_tables()
    w.create_tables()
    for n in (20, 30):   # a sync, and another that adds users
        users = [{"id": f"u{i}", "userName": f"n{i}", "displayName": f"N {i}", "active": True, "emails": []} for i in range(n)]
        path = f"{scratch}/pages-{n}"
        spark.createDataFrame([(json.dumps({"Resources": users}),)], "value string").write.text(path)
        w.sync_users(D.read_directory_pages(spark, path))
    answers = [(f"u{i % 6}", i, "a" if i % 2 else "b", "a") for i in range(40)]
    for half in (answers[:25], answers[25:]):
        w.submit_responses(spark.createDataFrame(half, "user_id string, question_id int, user_answer string, correct_answer string"))
    board = w.get_leaderboard(keep_key=True)
    assert "Exchange" not in _plan(board)
    got = {r["user_id"]: (r["total_points"], r["questions_answered"]) for r in board.collect()}
    assert len(got) == 30 and got["u9"] == (0, 0)
    for k in range(6):
        mine = [a for a in answers if a[0] == f"u{k}"]
        assert got[f"u{k}"] == (10 * sum(a[2] == "a" for a in mine), len(mine))
    with pytest.raises(ValueError, match="location"):
        api.Workshop(spark, "x", "y", colocated=4)


# -- defaults -------------------------------------------------------------------------------------

def test_defaults_evaluate_the_source_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = spark.range(40).repartition(3).selectExpr("cast(id as string) user_id").mapInArrow(count, "user_id string")
    got = R.stored_with_defaults(rows, spark.createDataFrame([("d",)], "user_id string"))
    assert got.count() == 40 and got.count() == 40 and seen.value == 40
    none = R.stored_with_defaults(rows.where("false"), spark.createDataFrame([("d", 1)], "user_id string, extra int"))
    assert [tuple(r) for r in none.collect()] == [("d", 1)]
    assert _relations(got) == 1
