"""Helpers shared by the operators of this package."""

from __future__ import annotations

import threading
from contextlib import contextmanager
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, shared_path

_open = threading.local()
#: With it Spark deletes a query's shuffle files as the query ends, not when the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only ``doc_id`` and ``text`` (null text: empty), whatever else the table carries."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"),
                     F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


@contextmanager
def _shuffles_deleted(spark: SparkSession):
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def cut(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder (with ``by``, a folder for each of its values) and read it back.

    A lost executor then re-reads files instead of recomputing, and what was
    numbered or sampled before the cut stays as it was.  The shuffle files of the write go at its end.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = shared_path(spark, "llm", label)
    with _shuffles_deleted(spark):
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    stack = getattr(_open, "stack", None)
    if stack:
        stack[-1].append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder that this package has written under the shared folder."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def drop(*frames: DataFrame) -> None:
    """Delete what ``cut`` wrote for these frames, which nothing will read again."""
    for frame in frames:
        discard(frame.sparkSession, frame._cut_path)


def stored(operator):
    """The operator's result is computed and written when it is called, and everything that it cut on the
    way is deleted; what it returns reads that one folder."""

    @wraps(operator)
    def run(df: DataFrame, *args, **kwargs) -> DataFrame:
        stack = _open.__dict__.setdefault("stack", [])
        stack.append(made := [])
        try:
            out = operator(df, *args, **kwargs)
            held, stack[-1] = stack[-1], []   # the result is its caller's, as is any outer operator's
            result = cut(out, operator.__name__)
            made = held
        finally:
            left = stack.pop()
            if stack:
                stack[-1].extend(left)
            for path in made:
                discard(df.sparkSession, path)
        return result

    return run


def small(batches, rows: int = 500):
    """Arrow batches in slices, so that a task holds the Python objects of a few texts at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
