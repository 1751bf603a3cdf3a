"""Roster: directory flattening, active filters, counts, eligibility, defaults, upsert."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from .. import schemas as S
from ..functions import first_email
from ..session import cut_lineage
from ..sources.literal import literal_frame


def directory_users(pages: DataFrame) -> DataFrame:
    """One row per directory entry from pages shaped ``{Resources: [user, ...]}``.

    ``_seq`` is the entry's position in the listing (``startIndex`` + position
    in the page) when the page carries a ``startIndex``, else NULL.
    """
    start = F.col("startIndex") if "startIndex" in pages.columns else F.lit(None).cast("long")
    return (pages.select(start.alias("_start"), F.posexplode("Resources").alias("_pos", "u"))
                 .select("u.*", (F.col("_start") + F.col("_pos")).cast("long").alias("_seq")))


def flatten_users(users: DataFrame, missing_active: bool = False,
                  missing_email: str | None = None, keep_seq: bool = False) -> DataFrame:
    """Active directory entries as roster rows ``user_id, email, display_name, user_name``.

    ``missing_active`` is what an absent ``active`` flag means: the first
    directory client treats it as inactive, the SDK client as active.
    ``missing_email`` replaces an absent/empty ``emails`` list (NULL in the first
    client, ``''`` in the SDK client).
    """
    email = first_email("emails")
    if missing_email is not None:
        email = F.coalesce(email, F.lit(missing_email))
    seq = [F.col("_seq")] if keep_seq and "_seq" in users.columns else []
    return (users.where(F.coalesce(F.col("active"), F.lit(missing_active)))
                 .select(F.col("id").alias("user_id"), email.alias("email"),
                         F.col("displayName").alias("display_name"),
                         F.col("userName").alias("user_name"), *seq))


def dedupe_by_key(df: DataFrame, key: str = "user_id", order_col: str | None = None) -> DataFrame:
    """One row per ``key`` (the table's primary key).

    With ``order_col`` the row with the greatest ``order_col`` wins (the last one
    in source order, as sequential per-row MERGEs would leave it; rows without
    an order rank below ordered ones); ties and unordered rows fall back to the
    greatest row, deterministically.  ``max(struct)`` aggregates partially, so a
    key holding a large share of the rows is combined map-side first.
    """
    rest = [c for c in df.columns if c not in (key, order_col)]
    if not rest:
        return df.select(key).distinct()
    row = F.struct(*rest).alias("r")
    pick = F.max(F.struct(F.col(order_col).alias("o"), row)).getField("r") if order_col else F.max(row)
    return (df.groupBy(key).agg(pick.alias("_row"))
              .select(key, *[F.col("_row")[c].alias(c) for c in rest]))


def ingest_directory(pages: DataFrame, missing_active: bool = False,
                     missing_email: str | None = None, dedupe: bool = True) -> DataFrame:
    """Directory pages -> flat roster, one row per ``user_id`` (the last listed wins)."""
    flat = flatten_users(directory_users(pages), missing_active, missing_email, keep_seq=True)
    if not dedupe:
        return flat.drop("_seq")
    return dedupe_by_key(flat, "user_id", "_seq")


def roster_counts(users: DataFrame, missing_active: bool = False) -> DataFrame:
    """Total directory entries and how many of them are active (one row)."""
    active = F.coalesce(F.col("active"), F.lit(missing_active))
    return users.agg(F.count(F.lit(1)).alias("total_users"),
                     F.sum(F.when(active, 1).otherwise(0)).cast("long").alias("active_users"))


def eligibility(roster: DataFrame, email: str) -> DataFrame:
    """One row ``(email, eligible)``: exact, case-sensitive email match in the roster."""
    hits = roster.where(F.col("email") == F.lit(email))
    return hits.agg((F.count(F.lit(1)) > 0).alias("eligible")).select(
        F.lit(email).alias("email"), "eligible")


def eligible_logins(logins: DataFrame, roster: DataFrame) -> DataFrame:
    """Login attempts whose email is on the roster (semi-join: no roster columns, no fan-out)."""
    return logins.join(roster.select("email"), "email", "left_semi")


def rejected_logins(logins: DataFrame, roster: DataFrame) -> DataFrame:
    """Login attempts whose email is not on the roster."""
    return logins.join(roster.select("email"), "email", "left_anti")


def default_users(spark: SparkSession) -> DataFrame:
    return literal_frame(spark, K.DEFAULT_USERS, "user_id string, email string, "
                         "display_name string, user_name string")


def demo_participants(spark: SparkSession) -> DataFrame:
    return (literal_frame(spark, K.DEMO_PARTICIPANTS, "user_id string, display_name string, "
                          "email string, user_name string")
                 .select(*S.ROSTER_COLUMNS, F.lit(K.STATUS_DEMO_LABEL).alias("status_label")))


def with_defaults(df: DataFrame, defaults: DataFrame) -> DataFrame:
    """``df``, or ``defaults`` when ``df`` is empty (lazily, in one plan).

    The anti-join side is ``df.limit(1)``: at most one row, so broadcasting it is
    bounded.  Read errors are not masked with fake rows.
    """
    probe = F.broadcast(df.select(F.lit(1).alias("_any")).limit(1))
    fill = defaults.join(probe, how="left_anti")
    return df.unionByName(fill, allowMissingColumns=True)


def stored_with_defaults(df: DataFrame, defaults: DataFrame) -> DataFrame:
    """``with_defaults`` that evaluates ``df`` once: its rows are written to the shared folder when this is called, and
    whether there are any is told by what was written.

    For a source that is costly to evaluate (a directory export that is parsed, a join); the write is
    released by an enclosing ``session.lineage_scope``."""
    held = cut_lineage(df, "defaults")
    if held.isEmpty():
        return held.unionByName(defaults, allowMissingColumns=True)
    return held


def label_status(roster: DataFrame) -> DataFrame:
    """Directory rows carry the active label unless they already have one."""
    if "status_label" in roster.columns:
        return roster
    return roster.withColumn("status_label", F.lit(K.STATUS_ACTIVE_LABEL))


def contains_demo_rows(df: DataFrame) -> DataFrame:
    """One row: whether any row's status label starts with the demo marker."""
    flag = F.coalesce(F.col("status_label").startswith(K.DEMO_MARKER), F.lit(False))
    return df.agg(F.coalesce(F.bool_or(flag), F.lit(False)).alias("is_demo"))


def upsert(target: DataFrame, source: DataFrame, key: str = "user_id",
           update_cols=("email", "display_name", "user_name"),
           created_col: str = "created_at", order_col: str | None = None,
           source_is_unique: bool = False) -> DataFrame:
    """Set-based MERGE: matched keys take the source's ``update_cols``; new keys are
    inserted with ``created_col`` = now; target rows absent from the source stay.

    The source is reduced to one row per key first (a MERGE with two source rows
    for one target row is ambiguous): the last by ``order_col`` when given (the
    reference merges row by row, so its last row wins), else the greatest.  With
    ``source_is_unique`` (an ingest that has been reduced already, a primary key) that
    aggregate is left out.
    """
    cols = [key, *update_cols]
    src_cols = cols + ([order_col] if order_col else [])
    src = source.select(*cols) if source_is_unique else dedupe_by_key(source.select(*src_cols), key, order_col)
    src = src.withColumn("_in_src", F.lit(True))
    tgt = target.withColumn("_in_tgt", F.lit(True))
    s = src.alias("s")
    t = tgt.alias("t")
    j = t.join(s, F.col(f"t.{key}") == F.col(f"s.{key}"), "full_outer")
    in_src = F.coalesce(F.col("s._in_src"), F.lit(False))
    in_tgt = F.coalesce(F.col("t._in_tgt"), F.lit(False))
    out = [F.coalesce(F.col(f"t.{key}"), F.col(f"s.{key}")).alias(key)]
    out += [F.when(in_src, F.col(f"s.{c}")).otherwise(F.col(f"t.{c}")).alias(c) for c in update_cols]
    extra = [c for c in target.columns if c not in cols]
    for c in extra:
        if c == created_col:
            out.append(F.when(in_tgt, F.col(f"t.{c}")).otherwise(F.current_timestamp()).alias(c))
        else:
            out.append(F.col(f"t.{c}").alias(c))
    return j.select(*out)
