"""Catalog tables: idempotent DDL, appends, and overwrite-by-new-version.

Parquet tables have no MERGE/UPDATE/DELETE, and Spark refuses to overwrite a
table that the same plan reads.  Rewrites therefore write a fresh directory
and then repoint the table at it (``ALTER TABLE ... SET LOCATION``, one catalog
operation), so readers see either the old or the new version, never a mix.

Retention: every publish records the replaced location in table properties
and releases the version before it, so storage stays at about two versions per
table.  Only directories written by ``publish_version`` are ever released; the
location a table was created with (possibly a user's own directory) never is.
A DataFrame obtained from a table survives one later rewrite (Spark's own
INSERT OVERWRITE invalidates it at once); long-lived readers read the table by
name per refresh.  ``release_older=False`` keeps every version.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable
from zlib import crc32

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..session import release_path


def ensure_namespace(spark: SparkSession, name: str) -> None:
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {name}")


def _create(spark: SparkSession, table: str, ddl: str, location: str | None) -> None:
    loc = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({ddl}) USING parquet{loc}")


def create_roster_table(spark: SparkSession, table: str, location: str | None = None) -> None:
    _create(spark, table, S.ROSTER_DDL, location)


def create_responses_table(spark: SparkSession, table: str, location: str | None = None) -> None:
    _create(spark, table, S.RESPONSES_DDL, location)


def create_snapshot_table(spark: SparkSession, table: str, location: str | None = None) -> None:
    _create(spark, table, S.SNAPSHOT_DDL, location)


def table_location(spark: SparkSession, table: str) -> str:
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED {table}").where("col_name = 'Location'").collect()
    return rows[0]["data_type"]


def _bare(path: str) -> str:
    """A path without its URI scheme and authority: the catalog reports qualified
    locations (``file:/x``, ``hdfs://nn/x``) for paths given as ``/x``."""
    p = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:", "", path.rstrip("/"))
    if p.startswith("//"):
        p = "/" + p[2:].split("/", 1)[-1]
    return p


def points_at(spark: SparkSession, table: str, path: str) -> bool:
    """Whether ``table`` is currently published at ``path``."""
    return _bare(table_location(spark, table)) == _bare(path)


def append_new(df: DataFrame, table: str, key: str, columns: list[str] | None = None) -> None:
    """``insert`` of the rows whose ``key`` the table does not hold yet, one for each key: sending them again adds nothing.

    Rows of the batch that share a key are reduced to the greatest; a NULL key is always new.  The
    keys that are there already are found by a semi-join on the table's key column alone, where the
    batch is the side that adaptive execution may broadcast, so a large table is scanned but not
    shuffled for a small batch.
    """
    spark = df.sparkSession
    cols = columns or df.columns
    rows = df.select(*cols)
    one = (rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(*[c for c in cols if c != key])).alias("_r"))
               .select(key, "_r.*").select(*cols))
    there = spark.table(table).select(key).join(one.select(key), key, "left_semi").distinct()
    insert(one.join(there, key, "left_anti").select(*cols).unionByName(rows.where(F.col(key).isNull())), table, cols)


def insert(df: DataFrame, table: str, columns: list[str] | None = None) -> None:
    """``INSERT INTO table (columns) SELECT ...``: omitted columns take their DEFAULT."""
    spark = df.sparkSession
    cols = columns or df.columns
    view = f"_rb_insert_{uuid.uuid4().hex}"
    df.select(*cols).createOrReplaceTempView(view)
    try:
        spark.sql(f"INSERT INTO {table} ({', '.join(cols)}) SELECT {', '.join(cols)} FROM {view}")
    finally:
        spark.catalog.dropTempView(view)


PREVIOUS_PROPERTY = "rankboard.previous_location"
PREVIOUS_OWNED = "rankboard.previous_owned"
CURRENT_OWNED = "rankboard.current_owned"


def release(spark: SparkSession, path: str) -> None:
    """Free the storage of a superseded directory: overwrite it with an empty write."""
    release_path(spark, path)


def table_property(spark: SparkSession, table: str, key: str) -> str | None:
    rows = spark.sql(f"SHOW TBLPROPERTIES {table}").where(F.col("key") == key).collect()
    return rows[0]["value"] if rows else None


def table_version(spark: SparkSession, table: str) -> str:
    """What tells one state of a file table from another without reading it: its location and files."""
    spark.catalog.refreshTable(table)
    files = sorted(spark.table(table).inputFiles())
    return f"{table_location(spark, table)}#{len(files)}#{crc32(json.dumps(files).encode())}"


class ConcurrentRewrite(RuntimeError):
    """Another writer published the table between this writer's read and its publish."""


def publish_version(df: DataFrame, table: str, version_path: str, release_older: bool = True,
                    read_from: str | None = None) -> str:
    """Write ``df`` to ``version_path`` and repoint ``table`` there.

    ``read_from`` is the location that ``df`` was read from, where it depends on the table's
    contents: if the table no longer points there when the new version is ready, nothing is
    published and ``ConcurrentRewrite`` is raised (``rewrite`` retries).

    ``df`` may read ``table`` itself (upsert, increment): its files are not
    touched.  Publishing is the last step, so a failed write leaves the table
    on its previous version.  The version being replaced is remembered as the
    previous one; with ``release_older`` the one before it is released.
    """
    spark = df.sparkSession
    target_cols = spark.table(table).columns
    df.select(*target_cols).write.mode("overwrite").parquet(version_path)
    return point_to(spark, table, version_path, release_older, read_from)


def point_to(spark: SparkSession, table: str, version_path: str, release_older: bool = True,
             read_from: str | None = None) -> str:
    """The last step of a publish: repoint ``table`` at a version that has been written (see ``publish_version``)."""
    old = table_location(spark, table)
    if read_from is not None and _bare(old) != _bare(read_from):
        release(spark, version_path)
        raise ConcurrentRewrite(f"{table} was published at {old} while a rewrite of {read_from} was under way")
    old_owned = table_property(spark, table, CURRENT_OWNED) == "true"
    spark.sql(f"ALTER TABLE {table} SET LOCATION '{version_path}'")
    spark.sql(f"REFRESH TABLE {table}")
    if _bare(old) != _bare(version_path):
        older = table_property(spark, table, PREVIOUS_PROPERTY)
        older_owned = table_property(spark, table, PREVIOUS_OWNED) == "true"
        spark.sql(f"ALTER TABLE {table} SET TBLPROPERTIES ('{PREVIOUS_PROPERTY}' = '{old}', "
                  f"'{PREVIOUS_OWNED}' = '{str(old_owned).lower()}', '{CURRENT_OWNED}' = 'true')")
        if (release_older and older and older_owned
                and _bare(older) not in (_bare(old), _bare(version_path))):
            release(spark, older)
    return version_path


def new_version_path(spark: SparkSession, table: str) -> str:
    base = table_location(spark, table).rstrip("/")
    parent = base.rsplit("/", 1)[0]
    return f"{parent}/{table.replace('.', '_')}-v{uuid.uuid4().hex[:12]}"


def replace_contents(df: DataFrame, table: str, release_older: bool = True) -> str:
    """Full refresh (the reference's DELETE + batched INSERT) as one new version."""
    return publish_version(df, table, new_version_path(df.sparkSession, table), release_older)


def rewrite(spark: SparkSession, table: str, change: Callable[[DataFrame], DataFrame], attempts: int = 5) -> str:
    """Publish ``change(current contents)`` as a new version; no other writer's version is lost.

    The version that was read is compared with the current one right before publishing; if another
    writer came first, ``change`` is applied anew to what that writer left.  Retries run over in this
    driver; between drivers the catalog's ``SET LOCATION`` is the only guard left open, for the
    moment between comparison and publish (a catalog with row-level operations has none: ``native_merge``).
    """
    for attempt in range(attempts):
        spark.sql(f"REFRESH TABLE {table}")
        seen = table_location(spark, table)
        try:
            return publish_version(change(spark.table(table)), table, new_version_path(spark, table), read_from=seen)
        except ConcurrentRewrite:
            if attempt == attempts - 1:
                raise
    raise AssertionError("unreachable")


#: Table formats whose Spark connector has MERGE and UPDATE.
ROW_LEVEL_PROVIDERS = frozenset(["delta", "iceberg", "hudi"])


def has_row_level_operations(spark: SparkSession, table: str) -> bool:
    """Whether the table's format takes MERGE and UPDATE itself (atomic there, no version juggling)."""
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED {table}").where("col_name = 'Provider'").collect()
    return bool(rows) and rows[0]["data_type"].lower() in ROW_LEVEL_PROVIDERS


def native_merge(source: DataFrame, table: str, key: str, update_cols: list[str]) -> None:
    """The format's own MERGE of a source with one row per key: matched rows take ``update_cols``, others are inserted."""
    on = F.col(f"source.{key}") == F.col(f"{table}.{key}")
    value = {c: F.col(f"source.{c}") for c in update_cols}
    (source.alias("source").mergeInto(table, on)
           .whenMatched().update(value)
           .whenNotMatched().insert({key: F.col(f"source.{key}"), **value})
           .merge())


def native_refresh(df: DataFrame, table: str) -> None:
    """The format's own overwrite of all rows, one atomic commit."""
    df.select(*df.sparkSession.table(table).columns).writeTo(table).overwrite(F.lit(True))


def refresh(df: DataFrame, table: str) -> str:
    """Full refresh by what the table can do: its own atomic overwrite, or a new version."""
    spark = df.sparkSession
    if has_row_level_operations(spark, table):
        native_refresh(df, table)
        return table_location(spark, table)
    return replace_contents(df, table)


def native_increment(deltas: DataFrame, table: str, key: str, column: str, delta: str) -> None:
    """The format's own UPDATE from a source with one row per ``key``: matched rows get ``delta`` added to ``column``."""
    on = F.col(f"source.{key}") == F.col(f"{table}.{key}")
    value = (F.col(f"{table}.{column}") + F.col(f"source.{delta}")).cast(deltas.sparkSession.table(table).schema[column].dataType)
    deltas.alias("source").mergeInto(table, on).whenMatched().update({column: value}).merge()


def native_update(spark: SparkSession, table: str, column: str, by: int, key: str, value: str) -> None:
    """``UPDATE table SET column = column + by WHERE key = value``, for a format that has it."""
    spark.sql(f"UPDATE {table} SET {column} = {column} + :by WHERE {key} = :value", args={"by": by, "value": value})
