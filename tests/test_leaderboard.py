import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from rankboard.operators import grading as G
from rankboard.operators import leaderboard as L
from rankboard.operators.rank import global_row_number, rank_window, top_k

ROSTER = [("1", "demo@example.com", "Demo User", "demo"),
          ("2", "test@example.com", "Test User", "test"),
          ("3", "admin@example.com", "Admin User", "admin")]
RSCHEMA = "user_id string, email string, display_name string, user_name string"
# response_id, user_id, question_id, user_answer
RESPONSES = [("r1", "1", 2, "Parquet"),
             ("r2", "1", 2, " parquet "),      # repeat of a question; NBSP padding
             ("r3", "1", 3, "VACUUM"),
             ("r4", "2", 1, "\tall of the above"),
             ("r5", "ghost", 1, "All of the above"),  # unknown user: vanishes
             ("r6", "2", 4, None),                   # NULL answer: not stored
             ("r7", "2", 5, ""),                     # empty answer: not stored
             ("r8", "2", 9, "x")]                    # unknown question: dropped
QSCHEMA = "response_id string, user_id string, question_id int, user_answer string"


def _graded(spark):
    responses = spark.createDataFrame(RESPONSES, QSCHEMA)
    return G.grade(G.valid_submissions(responses), G.question_bank(spark))


def test_valid_submissions(spark):
    ids = sorted(r[0] for r in G.valid_submissions(spark.createDataFrame(RESPONSES, QSCHEMA)).collect())
    assert ids == ["r1", "r2", "r3", "r4", "r5", "r8"]


def test_grade_by_question_id(spark):
    got = {r["response_id"]: (r["correct_answer"], r["points_earned"]) for r in _graded(spark).collect()}
    assert got == {"r1": ("Parquet", 10), "r2": ("Parquet", 10), "r3": ("OPTIMIZE", 0),
                   "r4": ("All of the above", 10), "r5": ("All of the above", 10)}


def test_leaderboard_zero_fill_and_counts(spark):
    board = L.leaderboard(spark.createDataFrame(ROSTER, RSCHEMA), _graded(spark))
    assert board.columns == ["display_name", "email", "total_points", "questions_answered"]
    got = {r["email"]: (r["total_points"], r["questions_answered"]) for r in board.collect()}
    assert got == {"demo@example.com": (20, 3), "test@example.com": (10, 1), "admin@example.com": (0, 0)}
    assert dict(board.dtypes)["total_points"] == "bigint"


def test_leaderboard_by_email_key(spark):
    roster = spark.createDataFrame(ROSTER + [("4", None, "No Mail", "nomail")], RSCHEMA)
    responses = spark.createDataFrame([("a", "test@example.com", 2, "Parquet"), ("b", None, 2, "Parquet")], QSCHEMA)
    graded = G.grade(responses, G.question_bank(spark))
    got = {r["display_name"]: r["total_points"]
           for r in L.leaderboard(roster, graded, key="email").collect()}
    assert got == {"Demo User": 0, "Test User": 10, "Admin User": 0, "No Mail": 0}


def test_ranked_podium_and_progress(spark):
    board = L.leaderboard(spark.createDataFrame(ROSTER, RSCHEMA), _graded(spark), keep_key=True)
    r = L.ranked(board).orderBy("rank").collect()
    assert [(x["user_id"], x["rank"], x["medal"], x["tier"], x["highlight"]) for x in r] == [
        ("1", 1, "🥇", "gold", True), ("2", 2, "🥈", "silver", True), ("3", 3, "🥉", "bronze", True)]
    p = {x["user_id"]: (x["progress"], x["progress_label"], x["complete"], x["answered_label"])
         for x in L.progress(board, 50, 5).collect()}
    assert p["1"] == (40.0, "40%", False, "3/5")
    assert p["3"] == (0.0, "0%", False, "0/5")


def test_user_score(spark):
    g = _graded(spark)
    assert L.user_score(g, "1").first()["total_points"] == 20
    assert L.user_score(g, "nobody").first()["total_points"] == 0


def _random_board(spark, n=5000, seed=7):
    rnd = random.Random(seed)
    # a third of the rows share one score pair: a hot tie group
    rows = [(f"u{i:05d}", f"Name {rnd.randint(0, 50)}", None,
             0 if i % 3 == 0 else rnd.randint(0, 5) * 10, 0 if i % 3 == 0 else rnd.randint(0, 6))
            for i in range(n)]
    return spark.createDataFrame(rows, "user_id string, display_name string, email string, "
                                       "total_points long, questions_answered long").repartition(13)


def test_global_row_number_equals_row_number(spark):
    board = _random_board(spark)
    order = L.board_order()
    mine = global_row_number(board, order, "rank", num_partitions=7)
    plain = board.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    a = sorted((r["user_id"], r["rank"]) for r in mine.collect())
    b = sorted((r["user_id"], r["rank"]) for r in plain.collect())
    assert a == b
    # the only single-partition exchange carries the per-partition counts (one row each)
    lines = mine._jdf.queryExecution().executedPlan().toString().splitlines()
    for i, line in enumerate(lines):
        if "SinglePartition" in line:
            assert "_rk_pid" in lines[i + 1] and "count(1)" in lines[i + 1]


def test_top_k_page_and_deep_window(spark):
    board = _random_board(spark)
    order = L.board_order()
    full = {r["user_id"]: r["rank"] for r in global_row_number(board, order, "rank").collect()}
    top = {r["user_id"]: r["rank"] for r in top_k(board, order, 20).collect()}
    assert top == {u: k for u, k in full.items() if k <= 20}
    pg = {r["user_id"]: r["rank"] for r in L.page(board, 3, 100).collect()}
    assert pg == {u: k for u, k in full.items() if 201 <= k <= 300}
    deep = {r["user_id"]: r["rank"] for r in rank_window(board, order, 4001, 4100).collect()}
    assert deep == {u: k for u, k in full.items() if 4001 <= k <= 4100}


def test_sorted_by_with_position(spark):
    board = _random_board(spark, 500)
    got = [(r["display_name"], r["user_id"]) for r in L.sorted_by(board, "display_name", False).orderBy("position").collect()]
    assert got == sorted(got, key=lambda t: (t[0], [-ord(c) for c in t[1]]), reverse=True)


def test_question_options_and_max_score(spark):
    bank = G.question_bank(spark)
    opts = G.question_options(bank).where("question_id = 3").orderBy("pos").collect()
    assert [(o["pos"], o["option"], o["is_correct"]) for o in opts] == [
        (1, "VACUUM", False), (2, "OPTIMIZE", True), (3, "COMPACT", False), (4, "MERGE", False)]
    m = G.max_score(bank).first()
    assert (m["n_questions"], m["max_score"]) == (5, 50)


def test_answer_feedback_disagreement(spark):
    fb = {r["response_id"]: (r["feedback"], r["disagrees"]) for r in G.answer_feedback(_graded(spark)).collect()}
    assert fb["r1"] == ("Correct! ✅", False)
    assert fb["r2"] == ("Incorrect. The correct answer is: Parquet", True)
    assert fb["r3"][1] is False
