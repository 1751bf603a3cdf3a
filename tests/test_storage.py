import uuid

from pyspark.sql import functions as F

from rankboard import schemas as S
from rankboard.operators import roster as R
from rankboard.sources import tables as TB


def _name(prefix):
    return f"{prefix}_{uuid.uuid4().hex[:8]}"


def test_ddl_is_idempotent_and_defaults_apply(spark, scratch):
    TB.ensure_namespace(spark, "rb_test_ns")
    TB.ensure_namespace(spark, "rb_test_ns")
    t = f"rb_test_ns.{_name('responses')}"
    TB.create_responses_table(spark, t, f"{scratch}/resp")
    TB.create_responses_table(spark, t, f"{scratch}/resp")
    df = spark.createDataFrame([("r1", "1", 2, "Parquet", "Parquet", 10)],
                               "response_id string, user_id string, question_id int, user_answer string, "
                               "correct_answer string, points_earned int")
    TB.insert(df, t)
    TB.insert(df, t)   # re-submission appends another row (no uniqueness check)
    rows = spark.table(t).collect()
    assert len(rows) == 2 and all(r["submitted_at"] is not None for r in rows)
    assert spark.table(t).columns == S.RESPONSE_COLUMNS


def test_upsert_publishes_a_new_version_of_the_table_it_reads(spark, scratch):
    t = _name("roster")
    TB.create_roster_table(spark, t, f"{scratch}/roster/v0")
    TB.insert(spark.createDataFrame([("1", "a@x", "A", "a"), ("2", "b@x", "B", "b")],
                                    "user_id string, email string, display_name string, user_name string"), t)
    before = {r["user_id"]: r["created_at"] for r in spark.table(t).collect()}
    src = spark.createDataFrame([("2", "b2@x", "B2", "b2"), ("3", "c@x", "C", "c")],
                                "user_id string, email string, display_name string, user_name string")
    old_loc = TB.table_location(spark, t)
    TB.replace_contents(R.upsert(spark.table(t), src), t)
    assert TB.table_location(spark, t) != old_loc
    after = {r["user_id"]: r for r in spark.table(t).collect()}
    assert sorted(after) == ["1", "2", "3"]
    assert after["2"]["email"] == "b2@x" and after["2"]["created_at"] == before["2"]
    assert after["3"]["created_at"] is not None


def test_snapshot_full_refresh_replaces_rows(spark, scratch):
    t = _name("snap")
    TB.create_snapshot_table(spark, t, f"{scratch}/snap/v0")
    row = ("p1", 1, "Ann Lee", "a@x", "ann", True, "Active", 30)
    TB.insert(spark.createDataFrame([row], "participant_id string, rank int, display_name string, email string, "
                                           "username string, is_active boolean, status string, score int"), t)
    seed = spark.table(t).withColumn("score", F.lit(0)).withColumn("last_updated", F.current_timestamp())
    TB.replace_contents(seed, t)
    r = spark.table(t).collect()
    assert len(r) == 1 and r[0]["score"] == 0 and r[0]["last_updated"] is not None


def test_points_at_ignores_scheme(spark, scratch):
    t = _name("loc")
    TB.create_roster_table(spark, t, f"{scratch}/loc/v0")
    assert TB.points_at(spark, t, f"{scratch}/loc/v0")
    assert TB.points_at(spark, t, f"file:{scratch}/loc/v0/")
    assert not TB.points_at(spark, t, f"{scratch}/loc/v1")
    assert TB._bare("hdfs://nn:8020/a/b") == "/a/b" and TB._bare("s3a://bucket/a/b/") == "/a/b"


def test_retention_keeps_one_previous_version(spark, scratch):
    t = _name("ret")
    TB.create_roster_table(spark, t, f"{scratch}/ret/v0")
    cols = "user_id string, email string, display_name string, user_name string"
    for i in (1, 2, 3):
        df = spark.createDataFrame([(str(i), f"{i}@x", "N", "n")], cols).withColumn("created_at", F.current_timestamp())
        TB.publish_version(df, t, f"{scratch}/ret/v{i}")
    assert TB.points_at(spark, t, f"{scratch}/ret/v3")
    assert TB._bare(TB.table_property(spark, t, TB.PREVIOUS_PROPERTY)) == f"{scratch}/ret/v2"
    assert spark.read.parquet(f"{scratch}/ret/v2").count() == 1      # previous: kept for readers
    assert spark.read.parquet(f"{scratch}/ret/v1").count() == 0      # older: released
    assert [r["user_id"] for r in spark.table(t).collect()] == ["3"]


def test_held_dataframe_survives_one_rewrite_and_opt_out_keeps_all(spark, scratch):
    cols = "user_id string, email string, display_name string, user_name string"
    for release_older, rewrites in ((True, 1), (False, 3)):
        t = _name("held")
        TB.create_roster_table(spark, t, f"{scratch}/{t}/v0")
        TB.insert(spark.createDataFrame([("1", "a@x", "A", "a")], cols), t)
        held = spark.table(t)
        for i in range(rewrites):
            TB.replace_contents(spark.table(t).withColumn("email", F.lit(f"v{i}@x")), t, release_older)
        assert held.count() == 1
        assert spark.table(t).first()["email"] == f"v{rewrites - 1}@x"


def test_lineage_scope_releases_cuts(spark):
    from rankboard.session import cut_lineage, lineage_scope
    with lineage_scope(spark) as paths:
        n = cut_lineage(spark.range(10), "scope-test").count()
    assert n == 10 and len(paths) == 1
    assert spark.read.parquet(paths[0]).count() == 0


def test_user_supplied_location_is_never_released(spark, scratch):
    t = _name("own")
    cols = "user_id string, email string, display_name string, user_name string"
    spark.createDataFrame([("1", "a@x", "A", "a")], cols).withColumn("created_at", F.current_timestamp()) \
         .write.parquet(f"{scratch}/own/users_data")
    spark.sql(f"CREATE TABLE {t} ({S.ROSTER_DDL}) USING parquet LOCATION '{scratch}/own/users_data'")
    for i in range(3):
        TB.replace_contents(spark.table(t).withColumn("email", F.lit(f"v{i}@x")), t)
    assert spark.read.parquet(f"{scratch}/own/users_data").count() == 1   # the user's data is intact


SNAP = "participant_id string, rank int, display_name string, email string, username string, is_active boolean, " \
       "status string, score int"


def test_interleaved_increments_lose_nothing(spark, scratch):
    from rankboard.operators import snapshot as P
    t = _name("inc")
    TB.create_snapshot_table(spark, t, f"{scratch}/inc/v0")
    TB.insert(spark.createDataFrame([("p1", 1, "A B", "a@x", "a", True, "Active", 0)], SNAP), t)
    ten = spark.createDataFrame([("a@x", 10)], "email string, points int")
    calls = []

    def change(snap):
        calls.append(1)
        if len(calls) == 1:   # another writer publishes after this one has read
            TB.rewrite(spark, t, lambda s: P.apply_increments(s, ten))
        return P.apply_increments(snap, ten)

    TB.rewrite(spark, t, change)
    assert len(calls) == 2 and [r["score"] for r in spark.table(t).collect()] == [20]


def test_publish_over_a_newer_version_is_refused(spark, scratch):
    import pytest
    t = _name("old")
    TB.create_snapshot_table(spark, t, f"{scratch}/old/v0")
    seen = TB.table_location(spark, t)
    TB.replace_contents(spark.table(t), t)
    with pytest.raises(TB.ConcurrentRewrite):
        TB.publish_version(spark.table(t), t, f"{scratch}/old/late", read_from=seen)


def test_parquet_has_no_row_level_operations(spark, scratch):
    t = _name("cap")
    TB.create_roster_table(spark, t, f"{scratch}/cap/v0")
    assert not TB.has_row_level_operations(spark, t)


def test_unique_source_is_not_aggregated_again(spark):
    rows = spark.createDataFrame([("1", "a@x", "A", "a")], "user_id string, email string, display_name string, user_name string")
    target = rows.withColumn("created_at", F.current_timestamp())
    plan = lambda unique: R.upsert(target, rows, source_is_unique=unique)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan(False) and "Aggregate" not in plan(True)


def test_ranked_view_inside_a_scope_leaves_no_cut(spark, scratch):
    from rankboard.operators import snapshot as P
    from rankboard.session import lineage_scope
    rows = [(f"p{i}", i, "A B", "a@x", "a", True, "Active", i % 7) for i in range(50)]
    with lineage_scope(spark) as cuts:
        assert P.leaderboard_view(spark.createDataFrame(rows, SNAP)).count() == 50
    assert cuts and all(spark.read.parquet(c).count() == 0 for c in cuts)
