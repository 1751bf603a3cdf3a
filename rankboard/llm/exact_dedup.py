"""Exact deduplication with a heavy-hitter split.

1. Every text is reduced to its SHA-256 digest (one pass, JVM side) and the
   narrow ``(doc_id, digest)`` rows are cut to the shared folder.
2. Misra-Gries summaries of ``counters`` entries, one per partition, are summed.
   A digest with at least ``2 / (counters + 1)`` of all rows cannot be missing
   from the sum, and at most ``counters + 1`` digests pass the lower bound.
3. These candidates are counted exactly; the verified winners (at most
   ``(counters + 1) / 2``) are broadcast, so copies of a hot text are resolved
   map-side and never meet in one task.
4. The remaining digests are aggregated and joined by an ordinary shuffle; none
   of their groups holds more than ``2 / (counters + 1)`` of the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, id_text

COUNTERS = 2000


def _fold(counters: pd.Series, add: pd.Series, k: int) -> pd.Series:
    """One Misra-Gries step: add weighted counts, then subtract the (k+1)-th largest."""
    both = counters.add(add, fill_value=0)
    if len(both) > k:
        both = both - both.nlargest(k + 1).iloc[-1]
        both = both[both > 0]
    return both


def misra_gries(df: DataFrame, key: str, k: int = COUNTERS) -> DataFrame:
    """Summed per-partition summaries ``(key, est)``; ``est`` is a lower bound of the count
    that misses at most ``rows / (k + 1)``.  Null keys are not counted."""

    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = pd.Series(dtype="float64")
        for b in batches:
            held = _fold(held, b["_key"].value_counts().astype("float64"), k)
        yield pd.DataFrame({"_key": held.index.astype(object), "est": held.to_numpy().astype("int64")})

    parts = df.select(F.col(key).alias("_key")).where("_key IS NOT NULL").mapInPandas(
        summarise, "_key string, est long")
    return parts.groupBy("_key").agg(F.sum("est").alias("est")).withColumnRenamed("_key", key)


def heavy_hitters(df: DataFrame, key: str, k: int = COUNTERS) -> DataFrame:
    """Exactly counted keys holding at least ``2 / (k + 1)`` of the rows (and two rows):
    ``(key, n)``, at most ``(k + 1) / 2`` of them.  ``df`` is read three times: cut it first."""
    rows = df.count()
    least = rows / (k + 1)
    candidates = misra_gries(df, key, k).where((F.col("est") >= least) & (F.col("est") >= 1)).select(key)
    exact = (df.join(F.broadcast(candidates), key, "left_semi")   # at most k + 1 rows
               .groupBy(key).agg(F.count(F.lit(1)).alias("n")))
    return exact.where((F.col("n") >= 2 * least) & (F.col("n") >= 2))


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                normalise: Callable[[Column], Column] | None = None,
                counters: int = COUNTERS) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Of rows with equal (normalised) text the one with the largest id stays.  Null
    text counts as empty; a null id loses against any other; of rows that repeat
    both id and text exactly one is kept.  Other columns are ignored; an empty
    table gives an empty result.
    """
    docs = id_text(df, id_col, text_col)
    text = normalise(F.col("text")) if normalise else F.col("text")
    rows = cut(docs.select("doc_id", F.sha2(text.cast("binary"), 256).alias("text_sha256"),
                           F.monotonically_increasing_id().alias("_row")), "exact_digests")
    last = F.max(F.struct("doc_id", "_row")).alias("_last")
    n = F.count(F.lit(1)).alias("group_size")

    hot_keys = heavy_hitters(rows, "text_sha256", counters).select("text_sha256")
    hot = cut(rows.join(F.broadcast(hot_keys), "text_sha256", "left_semi")
                  .groupBy("text_sha256").agg(last, n), "exact_hot")
    out = ["doc_id", F.col("_last.doc_id").alias("keep_id"), "group_size",
           (F.col("_last._row") == F.col("_row")).alias("kept"), "text_sha256"]
    resolved = rows.join(F.broadcast(hot), "text_sha256").select(*out)
    rest = rows.join(F.broadcast(hot.select("text_sha256")), "text_sha256", "left_anti")
    groups = rest.groupBy("text_sha256").agg(last, n)
    return resolved.unionByName(rest.join(groups, "text_sha256").select(*out))


def keep_last(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` (all columns) that ``exact_dedup`` keeps; ids must be unique."""
    kept = exact_dedup(df, id_col, text_col).where("kept").select(F.col("doc_id").alias(id_col))
    return df.join(kept, id_col, "left_semi")
