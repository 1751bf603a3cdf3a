"""A left join that survives hot and NULL keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hot_share(df: DataFrame) -> int:
    """A key is hot from one ``hot_share``-th of the rows on: a quarter of an even shuffle partition."""
    return 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


# The most items that a frequent-items sketch may track.
_SKETCH_MAX = 1_000_000


def key_sketch(df: DataFrame, key: str, tracked: int) -> DataFrame:
    """One row ``(s, total)``: a frequent-items sketch of ``tracked`` keys and the non-NULL rows.

    Every task sketches its own rows, so what is shuffled is bounded by the tasks, not by the keys."""
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias("k"))
    return rows.agg(F.expr(f"approx_top_k_accumulate(k, {tracked})").alias("s"), F.count(F.lit(1)).alias("total"))


def hot_from_sketch(sketches: DataFrame, share: int) -> DataFrame:
    """``(_hk, _hs)`` from one row of ``key_sketch``.

    A sketch never under-counts a key and over-counts it by 3.5 / tracked of the rows at most: with 8 * share
    tracked keys no hot one is missed, and 2 * share places hold all that look hot."""
    rows = sketches.select(F.explode(F.expr(f"approx_top_k_estimate(s, {2 * share})")).alias("i"), "total")
    parts = F.col("i.count") * share / F.col("total")
    return rows.where(parts >= 1).select(F.col("i.item").alias("_hk"), F.ceil(parts).cast("int").alias("_hs"))


def hot_keys(df: DataFrame, key: str, share: int | None = None) -> DataFrame:
    """``(_hk, _hs)``: the keys that hold at least one ``share``-th of the non-NULL rows, and over how
    many reducers (``_hs``) each is to be spread.  There can be at most ``share`` of them; a key that holds
    a little less may be among them too.

    One pass over one column, sketched in the tasks; no key is shuffled.
    """
    share = share or hot_share(df)
    if 8 * share > _SKETCH_MAX:
        raise ValueError(f"hot keys of one {share}-th of the rows cannot be told: at most one {_SKETCH_MAX // 8}-th")
    return hot_from_sketch(key_sketch(df, key, 8 * share), share)


def left_join_skew_safe(left: DataFrame, right: DataFrame, left_key: str, right_key: str,
                        share: int | None = None, hot: DataFrame | None = None) -> DataFrame:
    """Left outer equi-join that survives hot left keys and many NULL keys.

    ``right`` should hold one row per key (e.g. an aggregate).  AQE cannot split
    a skewed partition when the right side comes straight out of an aggregate,
    so hot keys are salted explicitly.  The join keys are ``(key, salt)``:

    * every hot key of ``left`` (``hot_keys``: at most ``share`` keys, so the
      broadcast is bounded by construction) is spread over salts in proportion to its
      rows; each matching right row is replicated once per salt;
    * a NULL key never matches, so its rows take the whole row hash as salt:
      they scatter over all partitions instead of piling onto one reducer.

    ``hot`` may be passed when the statistics are at hand.  Results equal a plain left join.
    """
    lk = F.col(left_key)
    hot = F.broadcast(hot if hot is not None else hot_keys(left, left_key, share))
    row_hash = F.xxhash64(*[F.col(c) for c in left.columns])
    flagged = left.join(hot, lk == F.col("_hk"), "left")
    salt = (F.when(lk.isNull(), row_hash)
             .when(F.col("_hs").isNotNull(), F.pmod(row_hash, F.col("_hs").cast("long")))
             .otherwise(F.lit(0).cast("long")))
    l2 = flagged.select(*[F.col(c) for c in left.columns], lk.alias("_jk"), salt.alias("_js"))
    r = right.withColumnRenamed(right_key, "_jk_r")
    reps = F.coalesce(F.col("_hs"), F.lit(1))
    r2 = (r.join(hot, F.col("_jk_r") == F.col("_hk"), "left")
           .select(*[F.col(c) for c in r.columns],
                   F.explode(F.sequence(F.lit(0).cast("long"), (reps - 1).cast("long"))).alias("_js_r")))
    cond = (F.col("_jk") == F.col("_jk_r")) & (F.col("_js") == F.col("_js_r"))
    return l2.join(r2, cond, "left").drop("_jk", "_js", "_jk_r", "_js_r")
