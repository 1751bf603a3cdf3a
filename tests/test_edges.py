import pytest

from rankboard.operators import grading as G
from rankboard.operators import leaderboard as L
from rankboard.operators.rank import global_row_number, top_k

BOARD = "user_id string, display_name string, email string, total_points long, questions_answered long"


def _board(spark, n):
    return spark.createDataFrame([(f"u{i}", f"N {i}", None, (i % 4) * 10, i % 3) for i in range(n)], BOARD)


def test_page_past_the_end_is_empty(spark):
    assert L.page(_board(spark, 150), 3, 100).count() == 0
    assert L.page(_board(spark, 150), 2, 100).count() == 50


def test_top_k_larger_than_board(spark):
    got = top_k(_board(spark, 7), L.board_order(), 200).collect()
    assert sorted(r["rank"] for r in got) == list(range(1, 8))


def test_rank_of_empty_frame(spark):
    empty = spark.createDataFrame([], BOARD)
    assert global_row_number(empty, L.board_order()).count() == 0
    assert L.ranked(empty).count() == 0


def test_unknown_question_is_not_graded_but_not_lost(spark):
    r = spark.createDataFrame([("r1", "1", 99, "x"), ("r2", "1", 1, "All of the above")],
                              "response_id string, user_id string, question_id int, user_answer string")
    got = [(x["response_id"], x["points_earned"]) for x in G.grade(r, G.question_bank(spark)).collect()]
    assert got == [("r2", 10)]
    assert [x["response_id"] for x in G.ungraded(r, G.question_bank(spark)).collect()] == ["r1"]


def test_question_id_twice_raises(spark):
    bank = G.question_bank(spark)
    r = spark.createDataFrame([("r2", "1", 1, "All of the above")],
                              "response_id string, user_id string, question_id int, user_answer string")
    with pytest.raises(Exception, match="more than once"):
        G.grade(r, bank.unionByName(bank.where("id = 1"))).collect()


def test_display_limit_is_refused_beyond_its_bound(spark):
    with pytest.raises(ValueError, match="displayed"):
        L.top(_board(spark, 3), 5_000_000)


def test_sorted_by_puts_nulls_last(spark):
    b = spark.createDataFrame([("a", None, None, 0, 0), ("b", "Zed", None, 0, 0), ("c", "Al", None, 0, 0)], BOARD)
    for asc in (True, False):
        order = [r["user_id"] for r in L.sorted_by(b, "display_name", asc).orderBy("position").collect()]
        assert order[-1] == "a"


def test_progress_can_exceed_100_and_is_not_complete(spark):
    b = spark.createDataFrame([("a", "A", None, 60, 6)], BOARD)
    r = L.progress(b, 50, 5).first()
    assert (r["progress"], r["progress_label"], r["complete"], r["answered_label"]) == (120.0, "120%", False, "6/5")
