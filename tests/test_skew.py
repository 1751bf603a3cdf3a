"""A key holding a third of the rows: AQE splits it in shuffled semi/anti/outer joins."""

from pyspark.sql import functions as F

from rankboard.operators import roster as R
from rankboard.operators import snapshot as P

SKEW_CONF = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


def _with_conf(spark, fn):
    old = {k: spark.conf.get(k, None) for k in SKEW_CONF}
    for k, v in SKEW_CONF.items():
        spark.conf.set(k, v)
    try:
        return fn()
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def _final_plan(df):
    df.collect()   # runs this DataFrame's own adaptive plan to its final form
    return df._jdf.queryExecution().executedPlan().toString()


def test_hot_login_email_is_split(spark):
    n = 30000
    # each attempt carries an incompressible payload, as real rows do (AQE measures compressed bytes)
    logins = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot@x")).otherwise(F.format_string("u%d@x", F.col("id") % 5000))
        .alias("email"), F.sha2(F.col("id").cast("string"), 256).alias("payload"))
    roster = spark.range(2500).select(F.format_string("u%d@x", "id").alias("email")).unionByName(
        spark.range(1).select(F.lit("hot@x").alias("email")))

    def run():
        ok = R.eligible_logins(logins, roster)
        bad = R.rejected_logins(logins, roster)
        return ok.count(), bad.count(), _final_plan(ok), _final_plan(bad)

    n_ok, n_bad, plan_ok, plan_bad = _with_conf(spark, run)
    hot = n // 3
    assert n_ok + n_bad == n
    assert n_ok == hot + sum(1 for i in range(n) if i % 3 and i % 5000 < 2500)
    assert "isSkewJoin=true" in plan_ok.replace(" ", "") or "skew=true" in plan_ok
    assert "isSkewJoin=true" in plan_bad.replace(" ", "") or "skew=true" in plan_bad


def test_hot_snapshot_email_is_split(spark):
    snap = spark.range(30000).select(
        F.format_string("p%d", "id").alias("participant_id"), F.col("id").cast("int").alias("rank"),
        F.lit("A B").alias("display_name"),
        F.when(F.col("id") % 3 == 0, F.lit("")).otherwise(F.format_string("e%d@x", "id")).alias("email"),
        F.sha2(F.col("id").cast("string"), 256).alias("username"), F.lit(True).alias("is_active"),
        F.lit("Active").alias("status"), F.lit(0).alias("score"))
    inc = spark.range(20000).select(
        F.when(F.col("id") % 2 == 0, F.lit("")).otherwise(F.format_string("e%d@x", "id")).alias("email"),
        F.lit(1).alias("points"))

    def run():
        # AQE cannot split here (the deltas come straight from an aggregate): explicit salting
        out = P.apply_increments(snap, inc, share=32)
        spread = (out.where("email = ''").select(F.spark_partition_id().alias("p")).distinct().count())
        return out.agg(F.sum("score"), F.count(F.lit(1))).first(), spread

    (total, rows), spread = _with_conf(spark, run)
    # 10000 '' increments reach each of the 10000 '' participants; odd e<i> exist for i < 20000
    assert rows == 30000
    assert total == 10000 * 10000 + sum(1 for i in range(1, 20000, 2) if i % 3)
    assert spread > 1     # the 10000 rows of the hot '' key are joined on several reducers
