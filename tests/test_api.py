import json
import uuid

from rankboard.api import Snapshot, Workshop
from rankboard.operators import grading as G
from rankboard.sources import directory as D


def _pages(spark, scratch, users):
    path = f"{scratch}/pages-{uuid.uuid4().hex[:6]}"
    spark.createDataFrame([(json.dumps({"Resources": users}),)], "value string").write.text(path)
    return D.read_directory_pages(spark, path)


def test_workshop_end_to_end(spark, scratch):
    sfx = uuid.uuid4().hex[:8]
    w = Workshop(spark, f"rb_api_{sfx}.eligible_users", f"rb_api_{sfx}.user_responses", location=scratch)
    w.create_tables()
    w.create_tables()
    users = [{"id": "1", "userName": "demo", "displayName": "Demo User", "active": True,
              "emails": [{"value": "demo@example.com"}]},
             {"id": "2", "userName": "test", "displayName": "Test User", "active": True,
              "emails": [{"value": "test@example.com"}]}]
    w.sync_users(_pages(spark, scratch, users))
    users[1]["emails"] = [{"value": "test2@example.com"}]
    users.append({"id": "3", "userName": "admin", "displayName": "Admin User", "active": True,
                  "emails": [{"value": "admin@example.com"}]})
    w.sync_users(_pages(spark, scratch, users))
    assert w.users().count() == 3
    assert w.is_user_eligible("test2@example.com") and not w.is_user_eligible("test@example.com")

    answers = spark.createDataFrame([("1", 2, "Parquet"), ("1", 2, "parquet"), ("2", 3, "VACUUM"), ("2", 1, None)],
                                    "user_id string, question_id int, user_answer string")
    w.submit_responses(answers, G.question_bank(spark))
    supplied = spark.createDataFrame([("3", 5, " 30 DAYS ", "30 days")],
                                     "user_id string, question_id int, user_answer string, correct_answer string")
    w.submit_responses(supplied)
    assert w.responses().count() == 4
    assert w.get_user_score("1") == 20 and w.get_user_score("nobody") == 0
    board = {r["email"]: (r["total_points"], r["questions_answered"]) for r in w.get_leaderboard().collect()}
    assert board == {"demo@example.com": (20, 2), "test2@example.com": (0, 1), "admin@example.com": (10, 1)}
    top = w.ranked_leaderboard().orderBy("rank").first()
    assert (top["user_id"], top["medal"]) == ("1", "🥇")
    lb = f"rb_api_{sfx}.leaderboard"
    w.refresh_leaderboard_table(lb)
    w.refresh_leaderboard_table(lb)
    assert [r["user_id"] for r in spark.table(lb).orderBy("rank").collect()] == ["1", "3", "2"]


def test_snapshot_end_to_end(spark, scratch):
    s = Snapshot(spark, f"rb_snap_{uuid.uuid4().hex[:8]}", location=scratch)
    s.create_table()
    roster = spark.createDataFrame([("a", "a@x", "Ann Lee", "ann"), ("b", "b@x", "Bob Stone", "bob")],
                                   "user_id string, email string, display_name string, user_name string")
    s.refresh(roster)
    s.add_points(spark.createDataFrame([("b@x", 10)], "email string, points int"))
    s.add_points(spark.createDataFrame([("b@x", 10), ("a@x", 10)], "email string, points int"))
    got = [(r["position"], r["first_name"], r["score"]) for r in s.view().orderBy("position").collect()]
    assert got == [(1, "Bob", 20), (2, "Ann", 10)]
    s.refresh(roster.where("false"))   # empty roster -> demo participants
    assert {r["status"] for r in spark.table(s.table).collect()} == {"Inactive"}


def test_live_board_over_a_stream(spark, scratch):
    sfx = uuid.uuid4().hex[:8]
    w = Workshop(spark, f"rb_live_{sfx}.eligible_users", f"rb_live_{sfx}.user_responses", location=scratch)
    w.create_tables()
    w.sync_users(_pages(spark, scratch, [
        {"id": "1", "userName": "a", "displayName": "A A", "active": True, "emails": [{"value": "a@x"}]},
        {"id": "2", "userName": "b", "displayName": "B B", "active": True, "emails": [{"value": "b@x"}]}]))
    src = f"{scratch}/answers"
    spark.createDataFrame([("r1", "2", 2, "parquet"), ("r2", "2", 3, "OPTIMIZE"), ("r3", "1", 1, "no")],
                          "response_id string, user_id string, question_id int, user_answer string") \
         .write.parquet(src)
    stream = spark.readStream.schema("response_id string, user_id string, question_id int, user_answer string") \
                  .parquet(src)
    q = w.live_board(stream, G.question_bank(spark), f"{scratch}/live", f"rb_live_{sfx}.leaderboard", trigger=None)
    q.awaitTermination()
    board = {r["user_id"]: (r["rank"], r["total_points"]) for r in spark.table(f"rb_live_{sfx}.leaderboard").collect()}
    assert board == {"2": (1, 20), "1": (2, 0)}


def test_sync_users_takes_the_formats_own_merge(spark, scratch, monkeypatch):
    from rankboard.sources import tables as TB
    w = Workshop(spark, f"rb_merge_{uuid.uuid4().hex[:8]}.users", f"rb_merge_{uuid.uuid4().hex[:8]}.responses", location=scratch)
    w.create_tables()
    calls = []
    monkeypatch.setattr(TB, "has_row_level_operations", lambda *a: True)
    monkeypatch.setattr(TB, "native_merge", lambda source, table, key, cols: calls.append((table, key, cols, source.count())))
    w.sync_users(_pages(spark, scratch, [{"id": "1", "userName": "a", "displayName": "A", "active": True, "emails": []}]))
    assert calls == [(w.users_table, "user_id", ["email", "display_name", "user_name"], 1)]
