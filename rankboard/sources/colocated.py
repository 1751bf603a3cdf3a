"""Tables bucketed by a key and published by version, so that joins on the key move nothing.

Two tables with the same key and number of buckets are read bucket by bucket: a join or an aggregate on
the key needs no exchange on either side.  A version is written through a staging table (only
``saveAsTable`` writes buckets), whose files the table is then pointed at like any other version
(``tables.point_to``: one catalog operation, the previous version kept).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import tables as TB

KEY_PROPERTY, COUNT_PROPERTY = "rankboard.colocated.key", "rankboard.colocated.buckets"


def create(spark: SparkSession, table: str, ddl: str, key: str, buckets: int, location: str) -> None:
    """Idempotent; ``key`` and ``buckets`` stay what they are at creation."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({ddl}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) "
              f"INTO {buckets} BUCKETS LOCATION '{location}' "
              f"TBLPROPERTIES ('{KEY_PROPERTY}' = '{key}', '{COUNT_PROPERTY}' = '{buckets}')")


def _layout(spark: SparkSession, table: str) -> tuple[str, int]:
    return TB.table_property(spark, table, KEY_PROPERTY), int(TB.table_property(spark, table, COUNT_PROPERTY))


def publish(df: DataFrame, table: str, arranged: bool = False, read_from: str | None = None) -> str:
    """Publish ``df`` as the table's new version, in buckets.

    ``arranged``: the rows of a bucket lie in one task already (the result of a join or aggregate of tables
    with this layout), so they are written without another exchange.
    """
    spark = df.sparkSession
    key, buckets = _layout(spark, table)
    path = TB.new_version_path(spark, table)
    staging = f"{table}__{uuid.uuid4().hex[:10]}"
    rows = df.select(*spark.table(table).columns)
    rows = rows if arranged else rows.repartition(buckets, key)
    rows.write.bucketBy(buckets, key).sortBy(key).format("parquet").option("path", path).saveAsTable(staging)
    spark.sql(f"DROP TABLE {staging}")   # external: the files stay
    return TB.point_to(spark, table, path, read_from=read_from)


def rewrite(spark: SparkSession, table: str, change: Callable[[DataFrame], DataFrame], attempts: int = 5) -> str:
    """``tables.rewrite`` for a bucketed table: ``change`` is a join on the key, so its result is arranged."""
    for attempt in range(attempts):
        spark.sql(f"REFRESH TABLE {table}")
        seen = TB.table_location(spark, table)
        try:
            return publish(change(spark.table(table)), table, arranged=True, read_from=seen)
        except TB.ConcurrentRewrite:
            if attempt == attempts - 1:
                raise
    raise AssertionError("unreachable")
