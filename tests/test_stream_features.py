"""Dead letters of the grading stream, and the directory as a stream."""

import json
import random
import uuid

from rankboard.operators import grading as G
from rankboard.operators import roster as R
from rankboard.sources import directory as D
from rankboard.sources import tables as TB
from rankboard.streaming import directory as SD
from rankboard.streaming import jobs as ST

ANSWERS = "response_id string, user_id string, question_id int, user_answer string"


def _bank(spark):
    return spark.createDataFrame([(1, "q", ["a"], "a"), (2, "p", ["b"], "b")],
                                 "id int, question string, options array<string>, correct_answer string")


def test_graded_and_ungraded_make_up_the_valid_answers_after_a_retry(spark, scratch):
    sink = ST.GradingSink(_bank(spark), f"{scratch}/graded", f"{scratch}/ungraded")
    batches = [spark.createDataFrame([(f"r{b}{i}", "u" if i % 5 else None, q, a) for i, (q, a) in enumerate(
        [(1, "a"), (2, " B"), (7, "x"), (None, "y"), (1, None), (2, ""), (9, "z"), (1, "no")])], ANSWERS) for b in range(3)]
    for b, batch in enumerate(batches):
        sink(batch, b)
    sink(batches[2], 2)      # retried
    sink(batches[0], 0)
    valid = {r["response_id"] for batch in batches for r in G.valid_submissions(batch).collect()}
    graded = spark.read.parquet(f"{scratch}/graded").collect()
    ungraded = spark.read.parquet(f"{scratch}/ungraded").collect()
    ids = [r["response_id"] for r in [*graded, *ungraded]]
    assert len(ids) == len(set(ids)) and set(ids) == valid
    assert {r["question_id"] for r in ungraded} == {7, None, 9} and {r["question_id"] for r in graded} == {1, 2}
    assert {r["response_id"]: r["points_earned"] for r in graded}["r01"] == 10


def test_the_stream_keeps_what_it_cannot_grade(spark, scratch):
    for i in range(2):
        spark.createDataFrame([(f"r{i}", "u", 1, "a"), (f"s{i}", "u", 50, "a")], ANSWERS).coalesce(1).write.parquet(f"{scratch}/in/part={i}")
    stream = (spark.readStream.schema(ANSWERS).option("maxFilesPerTrigger", "1").option("recursiveFileLookup", "true")
              .parquet(f"{scratch}/in"))
    ST.start_grading(stream, _bank(spark), f"{scratch}/out", f"{scratch}/ck").awaitTermination()
    assert sorted(r["response_id"] for r in spark.read.parquet(f"{scratch}/out").collect()) == ["r0", "r1"]
    assert sorted(r["response_id"] for r in spark.read.parquet(f"{scratch}/out_ungraded").collect()) == ["s0", "s1"]


def _page(start, users):
    return json.dumps({"startIndex": start, "Resources": users})


def test_pages_in_any_order_and_again_give_the_batch_roster(spark, scratch):
    rng = random.Random(2)
    user = lambda i, email: {"id": f"u{i}", "userName": f"n{i}", "displayName": f"N {i}", "active": i % 4 != 3,
                             "emails": [{"value": email}] if email else []}
    listed = [user(rng.randint(0, 25), rng.choice([f"{k}@x", None])) for k in range(60)]   # users listed several times
    pages = [_page(10 * p + 1, listed[10 * p:10 * p + 10]) for p in range(6)]
    spark.createDataFrame([(p,) for p in pages], "value string").write.text(f"{scratch}/all")
    want = R.ingest_directory(D.read_directory_pages(spark, f"{scratch}/all"))

    table = f"r_{uuid.uuid4().hex[:8]}"
    TB.create_roster_table(spark, table, f"{scratch}/roster/v0")
    order = [4, 1, 5, 1, 0, 3, 2, 5]
    for i, p in enumerate(order):
        spark.createDataFrame([(pages[p],)], "value string").coalesce(1).write.text(f"{scratch}/in/arrival={i}")
        if i in (3, 7):      # two runs over one checkpoint
            stream = SD.stream_directory_pages(spark, f"{scratch}/in", max_files_per_trigger=2)
            SD.start_directory_sync(stream, table, f"{scratch}/ck").awaitTermination()
    cols = ["user_id", "email", "display_name", "user_name"]
    got = spark.table(table)
    assert sorted(map(str, (tuple(r) for r in got.select(*cols).collect()))) == sorted(map(str, (tuple(r) for r in want.select(*cols).collect())))
    assert got.where("created_at IS NULL").count() == 0


def test_a_merge_that_runs_again_changes_nothing(spark, scratch):
    table = f"r_{uuid.uuid4().hex[:8]}"
    TB.create_roster_table(spark, table, f"{scratch}/roster/v0")
    batch = spark.createDataFrame([("u1", "a@x", "A", "a")], "user_id string, email string, display_name string, user_name string")
    merge = SD.RosterMerge(table)
    merge(batch, 0)
    first = [tuple(r) for r in spark.table(table).collect()]
    merge(batch, 0)
    merge(batch.where("false"), 1)
    assert [tuple(r) for r in spark.table(table).collect()] == first


def test_a_workshop_syncs_from_a_stream(spark, scratch):
    import pytest

    from rankboard.api import Workshop
    sfx = uuid.uuid4().hex[:8]
    w = Workshop(spark, f"ws_users_{sfx}", f"ws_answers_{sfx}", scratch)
    w.create_tables()
    user = {"id": "u1", "userName": "n", "displayName": "N", "active": True, "emails": [{"value": "a@x"}]}
    spark.createDataFrame([(_page(1, [user]),)], "value string").write.text(f"{scratch}/in")
    w.sync_stream(f"{scratch}/in", f"{scratch}/ck", trigger=None).awaitTermination()
    assert [r["email"] for r in w.users().collect()] == ["a@x"]
    with pytest.raises(ValueError, match="sync_users"):
        Workshop(spark, "x", "y", scratch, colocated=2).sync_stream(scratch, scratch)
