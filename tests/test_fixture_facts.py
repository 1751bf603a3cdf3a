"""The FIXTURES.md §B facts about the derived inputs at sf0.01, and hot-key behaviour."""

from pyspark.sql import functions as F

from rankboard.operators import grading as G
from rankboard.operators import leaderboard as L
from rankboard.operators import snapshot as P
from rankboard.plans import inputs as I

SF = "/root/testdata/sf0.01"


def test_sf001_facts(spark):
    customer = I.table(spark, SF, "customer")
    events = I.table(spark, SF, "events")
    roster = I.roster(customer)
    assert roster.count() == 1157
    assert roster.where(F.col("email").isNotNull()).select("email").distinct().count() == 1068
    graded = G.grade(I.responses(events), I.quiz_bank(spark))
    board = L.leaderboard(roster, graded)
    assert board.count() == 1157
    assert board.where("questions_answered = 0").count() == 1041
    orphans = graded.join(roster.select("user_id"), "user_id", "left_anti").count()
    assert orphans == 2254


def test_hot_user_and_hot_email(spark):
    # one user holds a third of all responses
    n = 3000
    rows = [(f"r{i}", "hot" if i % 3 == 0 else f"u{i % 97}", (i % 5) + 1, "Parquet") for i in range(n)]
    responses = spark.createDataFrame(rows, "response_id string, user_id string, question_id int, user_answer string")
    roster = spark.createDataFrame([("hot", "h@x", "Hot User", "hot")] +
                                   [(f"u{i}", f"u{i}@x", f"User {i}", f"u{i}") for i in range(97)],
                                   "user_id string, email string, display_name string, user_name string")
    board = L.leaderboard(roster, G.grade(responses, G.question_bank(spark)), keep_key=True)
    hot = board.where("user_id = 'hot'").first()
    assert (hot["questions_answered"], hot["total_points"]) == (1000, 2000)   # question 2 is Parquet
    assert board.agg(F.sum("questions_answered")).first()[0] == n
    plan = board._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in plan and "partial_count" in plan      # map-side combine before the shuffle

    # a third of the snapshot shares the empty email; NULL emails bypass the join
    snap = spark.createDataFrame(
        [(f"p{i}", i + 1, "A B", "" if i % 3 == 0 else (None if i % 3 == 1 else f"e{i}@x"), "u", True, "Active", 0)
         for i in range(300)],
        "participant_id string, rank int, display_name string, email string, username string, "
        "is_active boolean, status string, score int")
    inc = spark.createDataFrame([("", 10), ("", 5), ("e2@x", 10)], "email string, points int")
    out = {r["participant_id"]: r["score"] for r in P.apply_increments(snap, inc).collect()}
    assert len(out) == 300
    assert out["p0"] == 15 and out["p1"] == 0 and out["p2"] == 10 and out["p5"] == 0
