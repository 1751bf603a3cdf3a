import json

from pyspark.sql import functions as F

from rankboard.operators import roster as R
from rankboard.sources import directory as D

PAGE_1 = {"Resources": [
    {"id": "u1", "userName": "ann", "displayName": "Ann Lee", "active": True,
     "emails": [{"value": "ann@x.com"}, {"value": "ann2@x.com"}]},
    {"id": "u2", "userName": "bob", "displayName": "Bob", "active": False, "emails": [{"value": "bob@x.com"}]},
    {"id": "u3", "userName": "cy", "displayName": "Cy Young", "emails": [{"value": "cy@x.com"}]},
]}
PAGE_2 = {"Resources": [
    {"id": "u4", "userName": "di", "displayName": "Di", "active": True, "emails": []},
    {"id": "u5", "userName": "ed", "displayName": "Ed", "active": True},
]}


def _pages(spark, scratch):
    path = f"{scratch}/export"
    spark.createDataFrame([(json.dumps(PAGE_1),), (json.dumps(PAGE_2),)], "value string") \
         .write.text(path)
    return D.read_directory_pages(spark, path)


def test_ingest_strict(spark, scratch):
    got = {r["user_id"]: tuple(r) for r in R.ingest_directory(_pages(spark, scratch)).collect()}
    assert sorted(got) == ["u1", "u4", "u5"]
    assert got["u1"] == ("u1", "ann@x.com", "Ann Lee", "ann")   # first of two emails
    assert got["u4"][1] is None and got["u5"][1] is None          # empty / missing emails


def test_ingest_lenient_and_empty_email(spark, scratch):
    users = R.directory_users(_pages(spark, scratch))
    got = {r["user_id"]: r["email"] for r in R.flatten_users(users, True, "").collect()}
    assert sorted(got) == ["u1", "u3", "u4", "u5"]
    assert got["u4"] == "" and got["u5"] == ""


def test_parse_pages_from_text_column(spark):
    text = spark.createDataFrame([(json.dumps(PAGE_1),)], "value string")
    assert R.ingest_directory(D.parse_directory_pages(text)).count() == 1


def test_counts(spark, scratch):
    r = R.roster_counts(R.directory_users(_pages(spark, scratch))).first()
    assert (r["total_users"], r["active_users"]) == (5, 3)


def _roster(spark):
    return spark.createDataFrame([("1", "demo@example.com", "Demo User", "demo"),
                                  ("2", "test@example.com", "Test User", "test"),
                                  ("3", "admin@example.com", "Admin User", "admin")],
                                 "user_id string, email string, display_name string, user_name string")


def test_eligibility_exact_and_case_sensitive(spark):
    roster = _roster(spark)
    assert R.eligibility(roster, "demo@example.com").first()["eligible"] is True
    assert R.eligibility(roster, "Demo@example.com").first()["eligible"] is False
    assert R.eligibility(roster, " demo@example.com").first()["eligible"] is False


def test_semi_and_anti_logins(spark):
    logins = spark.createDataFrame([("demo@example.com",), ("nobody@example.com",), (None,)], "email string")
    ok = [r[0] for r in R.eligible_logins(logins, _roster(spark)).collect()]
    bad = sorted(r[0] or "" for r in R.rejected_logins(logins, _roster(spark)).collect())
    assert ok == ["demo@example.com"]
    assert bad == ["", "nobody@example.com"]


def test_default_rows_only_when_empty(spark):
    roster = _roster(spark)
    d = R.default_users(spark)
    assert sorted(r["user_id"] for r in R.with_defaults(roster.where(F.lit(False)), d).collect()) == ["1", "2", "3"]
    assert sorted(r["email"] for r in R.with_defaults(roster, d).collect()) == [
        "admin@example.com", "demo@example.com", "test@example.com"]


def test_demo_flag(spark):
    roster = R.label_status(_roster(spark))
    demo = R.demo_participants(spark)
    assert R.contains_demo_rows(R.with_defaults(roster.where(F.lit(False)), demo)).first()["is_demo"] is True
    assert R.contains_demo_rows(R.with_defaults(roster, demo)).first()["is_demo"] is False


def test_upsert_semantics(spark):
    target = spark.createDataFrame(
        [("1", "old@x", "Old", "old", "2024-01-01 00:00:00"), ("2", "keep@x", "Keep", "keep", "2024-01-02 00:00:00")],
        "user_id string, email string, display_name string, user_name string, created_at string"
    ).withColumn("created_at", F.to_timestamp("created_at"))
    source = spark.createDataFrame([("1", "new@x", "New", "new"), ("9", "nine@x", "Nine", "nine")],
                                   "user_id string, email string, display_name string, user_name string")
    out = {r["user_id"]: r for r in R.upsert(target, source).collect()}
    assert sorted(out) == ["1", "2", "9"]
    assert (out["1"]["email"], out["1"]["display_name"], out["1"]["user_name"]) == ("new@x", "New", "new")
    assert str(out["1"]["created_at"]) == "2024-01-01 00:00:00"      # untouched on update
    assert out["2"]["email"] == "keep@x"                              # absent from source: kept
    assert out["9"]["created_at"] is not None                         # inserted: now()


def test_dedupe_by_key_is_deterministic(spark):
    df = spark.createDataFrame([("1", "a@x"), ("1", "b@x"), ("2", "c@x")], "user_id string, email string")
    got = sorted(tuple(r) for r in R.dedupe_by_key(df).collect())
    assert got == [("1", "b@x"), ("2", "c@x")]


def test_upsert_last_source_row_wins_with_order(spark):
    target = spark.createDataFrame([("7", "old@x", "Old", "old")],
                                   "user_id string, email string, display_name string, user_name string")
    source = spark.createDataFrame([("7", "z@old", "Z", "z", 1), ("7", "a@new", "A", "a", 2)],
                                   "user_id string, email string, display_name string, user_name string, seq int")
    assert R.upsert(target, source, order_col="seq").first()["email"] == "a@new"
    assert R.upsert(target, source.drop("seq")).first()["email"] == "z@old"   # no order: greatest row


def test_ingest_last_listed_entry_wins(spark, scratch):
    p1 = {"startIndex": 1, "Resources": [
        {"id": "u1", "userName": "a", "displayName": "A", "active": True, "emails": [{"value": "z@old"}]}]}
    p2 = {"startIndex": 2, "Resources": [
        {"id": "u1", "userName": "a", "displayName": "A", "active": True, "emails": [{"value": "a@new"}]}]}
    path = f"{scratch}/ordered"
    spark.createDataFrame([(json.dumps(p2),), (json.dumps(p1),)], "value string").write.text(path)
    got = R.ingest_directory(D.read_directory_pages(spark, path)).collect()
    assert [(r["user_id"], r["email"]) for r in got] == [("u1", "a@new")]
    assert R.ingest_directory(D.read_directory_pages(spark, path)).columns == \
        ["user_id", "email", "display_name", "user_name"]


def test_dedupe_with_null_order_keeps_values(spark):
    df = spark.createDataFrame([("1", "a@x", None), ("1", "b@x", None), ("2", "c@x", 5)],
                               "user_id string, email string, seq long")
    got = sorted(tuple(r) for r in R.dedupe_by_key(df, "user_id", "seq").collect())
    assert got == [("1", "b@x"), ("2", "c@x")]
