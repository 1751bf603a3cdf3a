from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from rankboard.operators.joins import hot_keys, left_join_skew_safe
from rankboard.operators.rank import global_row_number

ROWS = st.lists(st.tuples(st.integers(0, 3), st.integers(0, 2)), min_size=0, max_size=120)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=ROWS, parts=st.integers(1, 9))
def test_global_row_number_matches_row_number(spark, rows, parts):
    data = [(f"u{i:04d}", a, b) for i, (a, b) in enumerate(rows)]
    df = spark.createDataFrame(data, "user_id string, a long, b long")
    order = [F.col("a").desc(), F.col("b").asc(), F.col("user_id").asc()]
    mine = sorted(tuple(r) for r in global_row_number(df, order, "rank", parts).select("user_id", "rank").collect())
    plain = sorted(tuple(r) for r in df.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
                   .select("user_id", "rank").collect())
    assert mine == plain


def test_every_hot_key_is_spread(spark):
    keys = [f"h{i}" for i in range(5) for _ in range(1000)] + [f"c{i}" for i in range(3000)]
    left = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k string, v int").repartition(4)
    hot = {r["_hk"]: r["_hs"] for r in hot_keys(left, "k", 64).collect()}
    assert hot == {f"h{i}": 8 for i in range(5)}     # an eighth of the rows: 8 of 64 shares
    right = spark.createDataFrame([(k, 1) for k in sorted(set(keys))], "rk string, w int")
    old = {k: spark.conf.get(k, None) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        for k, v in zip(old, ("-1", "false"), strict=True):
            spark.conf.set(k, v)
        out = left_join_skew_safe(left, right, "k", "rk", 64)
        spread = {r["k"]: r["n"] for r in out.where("k LIKE 'h%'").withColumn("p", F.spark_partition_id())
                  .groupBy("k").agg(F.count_distinct("p").alias("n")).collect()}
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert len(spread) == 5 and min(spread.values()) > 1
    assert out.where("w IS NULL").count() == 0 and out.count() == len(keys)


def test_null_keys_bypass_the_join(spark):
    left = spark.createDataFrame([("a", 1), (None, 2), (None, 3), ("b", 4)], "k string, v int")
    right = spark.createDataFrame([("a", 10), ("z", 99)], "rk string, w int")
    got = sorted((r["v"], r["w"]) for r in left_join_skew_safe(left, right, "k", "rk").collect())
    assert got == [(1, 10), (2, None), (3, None), (4, None)]


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(keys=st.lists(st.one_of(st.none(), st.sampled_from(["a", "b", "c", "d"])), max_size=80),
       rkeys=st.lists(st.sampled_from(["a", "b", "c", "e"]), unique=True), share=st.integers(1, 40))
def test_skew_safe_join_equals_left_join(spark, keys, rkeys, share):
    left = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "v int, k string")
    right = spark.createDataFrame([(k, ord(k)) for k in rkeys], "rk string, w int")
    got = sorted((r["v"], r["w"]) for r in left_join_skew_safe(left, right, "k", "rk", share).collect())
    want = sorted((r["v"], r["w"]) for r in left.join(right, left.k == right.rk, "left").collect())
    assert got == want


def test_global_row_number_with_aqe_coalesced_ranges(spark):
    keys = ["spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.minPartitionSize",
            "spark.sql.shuffle.partitions"]
    old = {k: spark.conf.get(k) for k in keys}
    spark.conf.set(keys[0], "96k")
    spark.conf.set(keys[1], "1k")
    spark.conf.set(keys[2], "40")
    try:
        df = spark.range(60000).select((F.col("id") % 5).alias("a"), F.format_string("u%06d", "id").alias("user_id"))
        order = [F.col("a").desc(), F.col("user_id").asc()]
        ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
        ranged.write.format("noop").mode("overwrite").save()
        mine = global_row_number(df, order)
        got = {r["user_id"]: r["rank"] for r in mine.collect()}
        want = {r["user_id"]: r["rank"] for r in
                df.withColumn("rank", F.row_number().over(Window.orderBy(*order))).collect()}
        assert got == want
        n_parts = ranged.select(F.spark_partition_id().alias("p")).distinct().count()
        assert 1 < n_parts < 40   # sized by AQE, not by the configured count
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_skew_safe_join_with_int_keys_and_nulls(spark):
    left = spark.createDataFrame([(1, 5), (2, None), (3, None), (4, 7)], "v int, k int")
    right = spark.createDataFrame([(5, "five"), (9, "nine")], "rk int, w string")
    got = sorted((r["v"], r["w"]) for r in left_join_skew_safe(left, right, "k", "rk", 1).collect())
    assert got == [(1, "five"), (2, None), (3, None), (4, None)]
