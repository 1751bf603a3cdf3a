"""Schemas of the tables the library reads and writes.

Fixed values: names, order and types of the columns are those that users' tables have.
"""

from pyspark.sql import types as T

ROSTER = T.StructType([
    T.StructField("user_id", T.StringType(), False),
    T.StructField("email", T.StringType(), True),
    T.StructField("display_name", T.StringType(), True),
    T.StructField("user_name", T.StringType(), True),
    T.StructField("created_at", T.TimestampType(), True),
])
ROSTER_COLUMNS = ["user_id", "email", "display_name", "user_name"]

RESPONSES = T.StructType([
    T.StructField("response_id", T.StringType(), False),
    T.StructField("user_id", T.StringType(), True),
    T.StructField("question_id", T.IntegerType(), True),
    T.StructField("user_answer", T.StringType(), True),
    T.StructField("correct_answer", T.StringType(), True),
    T.StructField("points_earned", T.IntegerType(), True),
    T.StructField("submitted_at", T.TimestampType(), True),
])
RESPONSE_COLUMNS = [f.name for f in RESPONSES.fields]

SNAPSHOT = T.StructType([
    T.StructField("participant_id", T.StringType(), False),
    T.StructField("rank", T.IntegerType(), True),
    T.StructField("display_name", T.StringType(), True),
    T.StructField("email", T.StringType(), True),
    T.StructField("username", T.StringType(), True),
    T.StructField("is_active", T.BooleanType(), True),
    T.StructField("status", T.StringType(), True),
    T.StructField("score", T.IntegerType(), True),
    T.StructField("last_updated", T.TimestampType(), True),
])
SNAPSHOT_COLUMNS = [f.name for f in SNAPSHOT.fields]

QUESTION_BANK = T.StructType([
    T.StructField("id", T.IntegerType(), False),
    T.StructField("question", T.StringType(), True),
    T.StructField("options", T.ArrayType(T.StringType()), True),
    T.StructField("correct_answer", T.StringType(), True),
])

# One directory page: {"startIndex": n, "Resources": [{id, userName, displayName, active, emails: [{value}]}]}
DIRECTORY_USER = T.StructType([
    T.StructField("id", T.StringType(), True),
    T.StructField("userName", T.StringType(), True),
    T.StructField("displayName", T.StringType(), True),
    T.StructField("active", T.BooleanType(), True),
    T.StructField("emails", T.ArrayType(T.StructType([
        T.StructField("value", T.StringType(), True),
    ])), True),
])
DIRECTORY_PAGE = T.StructType([
    T.StructField("startIndex", T.LongType(), True),   # SCIM: 1-based index of the page's first entry
    T.StructField("Resources", T.ArrayType(DIRECTORY_USER), True),
])

LEADERBOARD_COLUMNS = ["display_name", "email", "total_points", "questions_answered"]
VIEWER_COLUMNS = ["first_name", "last_name", "email", "score"]



def _ddl(schema: T.StructType, now: str | None = None) -> str:
    """The DDL body of a schema; the column ``now`` defaults to the current time (works on parquet tables)."""
    def column(f: T.StructField) -> str:
        rest = " NOT NULL" if not f.nullable else " DEFAULT current_timestamp()" if f.name == now else ""
        return f"{f.name} {f.dataType.simpleString().upper()}{rest}"
    return ", ".join(column(f) for f in schema.fields)


ROSTER_DDL = _ddl(ROSTER, now="created_at")
RESPONSES_DDL = _ddl(RESPONSES, now="submitted_at")
SNAPSHOT_DDL = _ddl(SNAPSHOT)
