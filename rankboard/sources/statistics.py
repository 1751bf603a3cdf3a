"""Hot-key statistics that are stored with a table: a frequent-items sketch of one column.

The sketch (Spark's ``approx_top_k`` family) tracks ``TRACKED`` items, is one row of bounded size, and two of
them combine without the tables.  It is written beside the table and named in a table
property together with the table's version (location and files), so a sketch of another version
is never used.  An append combines it with the sketch of the appended rows; the table is not read again.
With it ``joins.left_join_skew_safe`` salts hot keys without counting them first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import hot_from_sketch, key_sketch
from ..session import shared_path
from .tables import insert, table_property, table_version

PROPERTY = "rankboard.hot."
# Items that a sketch tracks; a key with so small a share of the rows is never asked for.
TRACKED = 10_000


def sketch(df: DataFrame, key: str) -> DataFrame:
    """One row ``(s, total)``: the sketch of the column and its non-NULL rows."""
    return key_sketch(df.select(F.col(key).cast("string").alias(key)), key, TRACKED)


def combine(sketches: DataFrame) -> DataFrame:
    return sketches.agg(F.expr(f"approx_top_k_combine(s, {TRACKED})").alias("s"), F.sum("total").alias("total"))


def _store(one: DataFrame, table: str, key: str) -> None:
    spark = one.sparkSession
    path = shared_path(spark, "statistics", f"{table.replace('.', '_')}-{key}")
    one.coalesce(1).write.parquet(path)
    _stamp(spark, table, key, path)


def _stamp(spark: SparkSession, table: str, key: str, path: str) -> None:
    spark.sql(f"ALTER TABLE {table} SET TBLPROPERTIES ('{PROPERTY}{key}' = '{path}', "
              f"'{PROPERTY}{key}.version' = '{table_version(spark, table)}')")


def _fresh(spark: SparkSession, table: str, key: str) -> str | None:
    """Where the sketch of the table's present version is, if there is one."""
    path = table_property(spark, table, f"{PROPERTY}{key}")
    same = path and table_property(spark, table, f"{PROPERTY}{key}.version") == table_version(spark, table)
    return path if same else None


def record(spark: SparkSession, table: str, key: str) -> None:
    """Sketch the table as it is (one pass over one column)."""
    _store(sketch(spark.table(table), key), table, key)


def carry(spark: SparkSession, table: str, key: str, path: str | None) -> None:
    """After a rewrite that changed no ``key``: the sketch at ``path`` (``current`` before the rewrite) holds on."""
    if path:
        _stamp(spark, table, key, path)


def current(spark: SparkSession, table: str, key: str) -> str | None:
    return _fresh(spark, table, key)


def append(df: DataFrame, table: str, key: str, columns: list[str] | None = None) -> None:
    """``tables.insert`` that keeps the sketch current from the appended rows alone."""
    spark = df.sparkSession
    path = _fresh(spark, table, key)
    insert(df, table, columns)
    if path:
        _store(combine(spark.read.parquet(path).unionByName(sketch(df, key))), table, key)
    else:
        record(spark, table, key)


def hot_keys(spark: SparkSession, table: str, key: str, share: int) -> DataFrame | None:
    """``(_hk, _hs)`` as ``joins.hot_keys`` gives them, from the stored sketch; None without a current one that
    is fine enough (``joins.hot_from_sketch``)."""
    path = _fresh(spark, table, key)
    if path is None or 8 * share > TRACKED:
        return None
    return hot_from_sketch(spark.read.parquet(path), share)
