"""Tables partitioned into buckets that are replaced as whole directories.

Every bucket's rows lie in a directory of one version, and the catalog's partition points at it.
``replace_buckets`` writes the new rows of some buckets into new directories, then repoints their
partitions, each by one catalog operation, and records the new versions (with the caller's own
properties, e.g. a batch id) last.  No file that a reader may be reading is touched, and nothing is
deleted before the new rows are in place: a driver lost at any moment leaves each bucket either old
or new, never missing, and the caller's properties unset, so the replacement is simply run again.

The directory that a bucket had before is kept until the bucket is replaced once more, as with
``tables.publish_version``.  A run that was cut short between repointing and recording leaves the
directories it wrote unreferenced once the repetition has published its own.
"""

from __future__ import annotations

import re
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import delete_path
from .tables import table_location, table_property

BUCKETS_PROPERTY = "rankboard.buckets"
_CURRENT, _PREVIOUS = "rankboard.current.", "rankboard.previous."
# Catalog operations that a publish keeps under way at once.
PUBLISHERS = 8


def create_bucket_table(spark: SparkSession, table: str, ddl: str, root: str, buckets: int) -> None:
    """``ddl`` are the columns without ``bucket``; the number of buckets stays what it is at creation."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({ddl}, bucket INT) USING parquet PARTITIONED BY (bucket) "
              f"LOCATION '{root}' TBLPROPERTIES ('{BUCKETS_PROPERTY}' = '{buckets}')")


def bucket_count(spark: SparkSession, table: str) -> int:
    return int(table_property(spark, table, BUCKETS_PROPERTY))


def set_properties(spark: SparkSession, table: str, properties: dict) -> None:
    if properties:
        pairs = ", ".join(f"'{k}' = '{v}'" for k, v in properties.items())
        spark.sql(f"ALTER TABLE {table} SET TBLPROPERTIES ({pairs})")


def in_buckets(df: DataFrame, buckets: list[int]) -> DataFrame:
    """The rows of some buckets: a partition filter."""
    return df.where(F.col("bucket").isin(list(buckets)))


def _properties(spark: SparkSession, table: str) -> dict[str, str]:
    return {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {table}").collect()}


def _repoint(spark: SparkSession, table: str, bucket: int, path: str) -> None:
    spark.sql(f"ALTER TABLE {table} PARTITION (bucket = {bucket}) SET LOCATION '{path}'")


def replace_buckets(contents: DataFrame, table: str, touched: list[int], label: str, properties: dict | None = None,
                    none_empty: bool = False) -> str | None:
    """Make ``contents`` (all rows of the ``touched`` buckets, with the column ``bucket``) what these buckets hold.

    ``contents`` may read ``table`` itself.  A touched bucket without rows becomes empty.  ``properties``
    are set on the table in the last step.  ``none_empty``: the caller knows that every touched bucket has rows
    and no other has, so the written directories need no listing.  Returns the new version's directory.
    """
    spark = contents.sparkSession
    properties = dict(properties or {})
    if not touched:
        set_properties(spark, table, properties)
        return None
    root = table_location(spark, table).rstrip("/")
    version = f"v{label}-{uuid.uuid4().hex[:8]}"
    schema = spark.table(table).schema
    contents.select(*schema.names).repartition("bucket").write.partitionBy("bucket").parquet(f"{root}/{version}")
    written = set(touched)
    if not none_empty:
        files = spark.read.schema(schema).parquet(f"{root}/{version}").inputFiles()
        written = {int(re.search(r"/bucket=(\d+)/", f)[1]) for f in files}
    if not written <= set(touched):
        raise ValueError(f"contents hold rows of buckets {sorted(written - set(touched))}, which are not to be replaced")

    place = lambda b: f"{root}/{version}/bucket={b}"
    known = {int(r["partition"].split("=")[1]) for r in spark.sql(f"SHOW PARTITIONS {table}").collect()}
    new = sorted(written - known)
    if new:   # one statement for all
        spark.sql(f"ALTER TABLE {table} ADD " + " ".join(f"PARTITION (bucket = {b}) LOCATION '{place(b)}'" for b in new))
    with ThreadPoolExecutor(PUBLISHERS) as pool:
        list(pool.map(lambda b: _repoint(spark, table, b, place(b)), sorted(written & known)))
    empty = sorted((set(touched) & known) - written)
    if empty:
        spark.sql(f"ALTER TABLE {table} DROP IF EXISTS " + ", ".join(f"PARTITION (bucket = {b})" for b in empty))
    spark.sql(f"REFRESH TABLE {table}")

    before = _properties(spark, table)
    for b in touched:
        properties[f"{_CURRENT}{b}"] = version
        if f"{_CURRENT}{b}" in before:
            properties[f"{_PREVIOUS}{b}"] = before[f"{_CURRENT}{b}"]
    set_properties(spark, table, properties)
    for b in touched:   # the one before the previous
        old = before.get(f"{_PREVIOUS}{b}")
        if old and old not in (version, before.get(f"{_CURRENT}{b}")):
            delete_path(spark, f"{root}/{old}/bucket={b}")
    return f"{root}/{version}"
