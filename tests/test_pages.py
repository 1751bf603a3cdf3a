"""Pages of a ranked board, read from the files that hold them."""

import random
import uuid

from pyspark.sql import functions as F

from rankboard import api
from rankboard.operators import leaderboard as L
from rankboard.operators.pages import RankedPages
from rankboard.session import lineage_scope
from rankboard.sources import tables as TB


def _board(spark, n, seed=1):
    rng = random.Random(seed)
    rows = [(f"u{i:05d}", f"N {i}", f"{i}@x", 10 * rng.randint(0, 5), rng.randint(0, 3)) for i in range(n)]
    want = [r[0] for r in sorted(rows, key=lambda r: (-r[3], -r[4], r[0]))]
    return spark.createDataFrame(rows, "user_id string, display_name string, email string, total_points long, "
                                       "questions_answered long").repartition(4), want


def _ids(df):
    return [r["user_id"] for r in sorted(df.collect(), key=lambda r: r["rank"])]


def test_pages_are_slices_of_the_ranking(spark, scratch):
    board, want = _board(spark, 2500)
    pages = L.board_pages(board, f"{scratch}/pages", num_partitions=8)
    assert pages.total() == 2500 and pages.last_page(100) == 25 and pages.last_page(999) == 3
    for first, last in ((1, 100), (2401, 2500), (1, 1), (250, 950), (2499, 9999)):
        got = pages.ranks(first, last)
        assert _ids(got) == want[first - 1:last]
        assert sorted(r["rank"] for r in got.collect()) == list(range(first, min(last, 2500) + 1))
    assert L.board_page(pages, 26, 100).count() == 0
    assert _ids(pages.all()) == want
    reopened = RankedPages(spark, f"{scratch}/pages")
    assert _ids(reopened.page(3, 50)) == want[100:150]


def test_a_page_reads_its_files_only_and_moves_nothing(spark, scratch):
    board, _ = _board(spark, 4000)
    pages = L.board_pages(board, f"{scratch}/pages", num_partitions=16)
    page = L.board_page(pages, 20, 100)
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan and "PushedFilters: [IsNotNull(_rk_mid), GreaterThanOrEqual(_rk_mid" in plan
    assert len(page.inputFiles()) <= 2 < len(spark.read.parquet(f"{scratch}/pages/rows").inputFiles())


def test_files_cut_short_and_empty_boards(spark, scratch):
    board, want = _board(spark, 700)
    spark.conf.set("spark.sql.files.maxRecordsPerFile", 90)   # several files a partition
    try:
        pages = L.board_pages(board, f"{scratch}/small", num_partitions=2)
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    assert _ids(pages.ranks(60, 400)) == want[59:400] and _ids(pages.all()) == want
    none = L.board_pages(board.where("false"), f"{scratch}/none")
    assert none.total() == 0 and none.last_page(100) == 1 and none.page(1, 100).count() == 0 and none.all().count() == 0


def test_a_scope_releases_its_pages(spark):
    board, want = _board(spark, 50)
    with lineage_scope(spark) as cuts:
        pages = L.board_pages(board)
        assert _ids(pages.page(1, 10)) == want[:10]
        assert len(cuts) == 2
    assert spark.read.parquet(f"{pages.path}/rows").count() == 0


def test_workshop_pages_follow_the_refresh(spark, scratch):
    sfx = uuid.uuid4().hex[:8]
    w = api.Workshop(spark, f"pg_users_{sfx}", f"pg_answers_{sfx}", scratch)
    w.create_tables()
    TB.insert(spark.createDataFrame([(f"u{i}", f"{i}@x", f"N {i}", f"n{i}") for i in range(30)],
                                    "user_id string, email string, display_name string, user_name string"), w.users_table)
    table = f"pg_board_{sfx}"
    w.refresh_leaderboard_table(table)
    held = w.board_page(1, 5, table)
    assert [r["total_points"] for r in held.collect()] == [0] * 5
    answers = spark.createDataFrame([("u7", 2, "a", "a"), ("u9", 2, "b", "a")],
                                    "user_id string, question_id int, user_answer string, correct_answer string")
    w.submit_responses(answers)
    w.refresh_leaderboard_table(table)
    assert _ids(w.board_page(1, 3, table))[:2] == ["u7", "u9"]
    assert held.count() == 5                                     # the previous pages stay for one refresh
    assert _ids(w.board_page(1, 30, table)) == _ids(spark.table(table))
    w.refresh_leaderboard_table(table)
    assert w.board_page(6, 5, table).where(F.col("rank") == 30).count() == 1
