"""Logical inputs derived from the TPC-H-style tables (see FIXTURES.md §B).

Each derivation is written with the same expressions as the oracle SQL in
``plans.oracle`` so both engines see identical inputs.  Everything is a lazy
projection of ``customer`` / ``events`` / ``part``; nothing is materialised.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..operators import roster as R
from ..sources.literal import literal_frame

# FIXTURE VALUES: question id -> correct answer for the event-based quiz.
EVENT_QUIZ = [(1, "view"), (2, "signup"), (3, "error"), (4, "click"), (5, "purchase")]
EVENT_TYPES = ["view", "signup", "error", "click", "purchase"]
DIRECTORY_PAGE_SIZE = 100
PROBE_EMAIL = "customer#000000001@example.com"
PROBE_USER = "8"
ABSENT_USER = "no-such-user"
NAME_EDGES = ["", "Ann", "Ann ", " Ann", None]


# Declared schemas of the driver's tables this package reads: no footer-inference pass.
TABLE_SCHEMAS = {
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "region": "r_regionkey INT, r_name STRING",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    ddl = TABLE_SCHEMAS.get(name)
    return spark.read.schema(ddl).parquet(path) if ddl else spark.read.parquet(path)


def _email(c_name) -> F.Column:
    return F.concat(F.lower(c_name), F.lit("@example.com"))


def directory_users(customer: DataFrame) -> DataFrame:
    """Directory entries (SCIM shape) plus their page number ``_page``.

    ``active`` is missing for ``c_custkey % 7 = 0`` and false for ``% 10 = 0``;
    ``emails`` is empty for ``% 13 = 0`` and has a second address for ``% 3 = 0``.
    """
    k = F.col("c_custkey")
    primary = F.struct(_email(F.col("c_name")).alias("value"))
    second = F.struct(F.concat(F.lit("alt."), _email(F.col("c_name"))).alias("value"))
    emails = (F.when(k % 13 == 0, F.array().cast(S.DIRECTORY_USER["emails"].dataType))
               .when(k % 3 == 0, F.array(primary, second))
               .otherwise(F.array(primary)))
    active = F.when(k % 7 == 0, F.lit(None).cast("boolean")).otherwise(k % 10 != 0)
    return customer.select(
        k.cast("string").alias("id"),
        F.lower("c_name").alias("userName"),
        F.replace(F.col("c_name"), F.lit("#"), F.lit(" ")).alias("displayName"),
        active.alias("active"),
        emails.alias("emails"),
        F.floor(k / DIRECTORY_PAGE_SIZE).alias("_page"))


def directory_pages(customer: DataFrame) -> DataFrame:
    """Pages of at most ``DIRECTORY_PAGE_SIZE`` entries (bounded groups)."""
    users = directory_users(customer)
    fields = [f.name for f in S.DIRECTORY_USER.fields]
    return users.groupBy("_page").agg(
        (F.col("_page") * DIRECTORY_PAGE_SIZE + 1).cast("long").alias("startIndex"),
        F.collect_list(F.struct(*fields)).alias("Resources"))


def roster(customer: DataFrame) -> DataFrame:
    """The strict-active roster (what ingest stores), straight from the entries."""
    return R.flatten_users(directory_users(customer), missing_active=False)


def responses(events: DataFrame) -> DataFrame:
    eid = F.col("event_id")
    et = F.col("event_type")
    answer = (F.when(eid % 3 == 0, et)
               .when(eid % 3 == 1, F.concat(F.lit(" "), F.upper(et), F.lit(" ")))
               .otherwise(F.concat(et, F.lit("!"))))
    return events.select(
        eid.cast("string").alias("response_id"),
        F.col("user_id").cast("string").alias("user_id"),
        (eid % 5 + 1).cast("int").alias("question_id"),
        answer.alias("user_answer"),
        F.col("ts").alias("submitted_at"))


def responses_by_email(events: DataFrame) -> DataFrame:
    """Responses whose ``user_id`` is the login email (customer names are ``Customer#%09d``)."""
    email = F.concat(F.lit("customer#"), F.lpad(F.col("user_id").cast("string"), 9, "0"),
                     F.lit("@example.com"))
    return responses(events).withColumn("user_id", email)


def responses_with_blanks(events: DataFrame) -> DataFrame:
    """Responses with a NULL answer where ``event_id % 11 = 0`` and ``''`` where ``% 17 = 0``."""
    eid = F.col("response_id").cast("long")
    blank = (F.when(eid % 11 == 0, F.lit(None).cast("string"))
              .when(eid % 17 == 0, F.lit(""))
              .otherwise(F.col("user_answer")))
    return responses(events).withColumn("user_answer", blank)


def quiz_bank(spark: SparkSession) -> DataFrame:
    """The event quiz used for grading: question ``i`` is answered by ``EVENT_QUIZ[i]``."""
    rows = [(i, f"Which event is answer {i}?", list(EVENT_TYPES), a) for i, a in EVENT_QUIZ]
    return literal_frame(spark, rows, S.QUESTION_BANK)


def nation_bank(nation: DataFrame, region: DataFrame) -> DataFrame:
    """A question bank from tables: one question per nation, the regions as its options, its own as the answer."""
    options = region.agg(F.array_sort(F.collect_list(F.struct("r_regionkey", "r_name"))).alias("o")).select(
        F.transform("o", lambda r: r["r_name"])).scalar()
    return (nation.join(region, nation["n_regionkey"] == region["r_regionkey"])
                  .select((F.col("n_nationkey") + 1).cast("int").alias("id"),
                          F.concat(F.lit("Which region is "), "n_name", F.lit(" in?")).alias("question"),
                          options.alias("options"), F.col("r_name").alias("correct_answer")))


def narrow_bank(spark: SparkSession) -> DataFrame:
    """The event quiz without its last two questions, which the responses still answer."""
    return quiz_bank(spark).where(F.col("id") <= 3)


def logins(customer: DataFrame) -> DataFrame:
    """Login attempts: every customer's email, and an unknown address for every customer."""
    k = F.col("c_custkey")
    good = customer.select(_email(F.col("c_name")).alias("email"))
    bad = customer.select(F.concat(F.lit("x"), k.cast("string"), F.lit("@example.com")).alias("email"))
    return good.unionByName(bad)


def update_batch(customer: DataFrame) -> DataFrame:
    """A directory sync over every customer (even keys changed their email), plus a new
    user per customer (id ``c_custkey + 1000000``)."""
    k = F.col("c_custkey")
    email = F.when(k % 2 == 0, F.concat(F.lit("updated."), _email(F.col("c_name")))).otherwise(
        _email(F.col("c_name")))
    existing = customer.select(
        k.cast("string").alias("user_id"), email.alias("email"),
        F.replace(F.col("c_name"), F.lit("#"), F.lit(" ")).alias("display_name"),
        F.lower("c_name").alias("user_name"))
    new = customer.select(
        (k + 1000000).cast("string").alias("user_id"),
        F.concat(F.lit("new"), k.cast("string"), F.lit("@example.com")).alias("email"),
        F.replace(F.col("c_name"), F.lit("#"), F.lit(" ")).alias("display_name"),
        F.concat(F.lower("c_name"), F.lit("-new")).alias("user_name"))
    return existing.unionByName(new)


def increments(events: DataFrame, roster_df: DataFrame) -> DataFrame:
    """Score increments ``(email, points)``: 10 per purchase event of a roster user.

    Purchases are counted per user before the roster join, so the join sees one
    row per buying user instead of one per event.
    """
    per_user = (events.where(F.col("event_type") == "purchase")
                      .groupBy(F.col("user_id").cast("string").alias("user_id"))
                      .agg((F.count(F.lit(1)) * 10).alias("points")))
    return per_user.join(roster_df.select("user_id", "email"), "user_id").select("email", "points")


def names(spark: SparkSession, part: DataFrame) -> DataFrame:
    edges = literal_frame(spark, [(n,) for n in NAME_EDGES], "name string")
    return part.select(F.col("p_name").alias("name")).unionByName(edges)
