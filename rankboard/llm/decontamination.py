"""Benchmark decontamination by greedy string tiling.

The benchmark is the query set: it is taken in blocks of bounded size, each block
broadcast and held against all documents, so documents are never shuffled.  Within
a block, Karp-Rabin fingerprints of ``min_match`` words are the seeds that a
document and an item must share.  For each such pair the shared seeds (verified
word by word) are run together into maximal matches; the longest match whose words
are unmarked on both sides is marked, whatever overlaps it is trimmed, and so on
until no match of ``min_match`` words is left.  An item counts as leaked if the
tiles cover at least ``threshold`` of its words, in whatever order they stand.
"""

from __future__ import annotations

import heapq
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, small

MIN_MATCH, THRESHOLD = 5, 0.5
#: Characters of benchmark text in a broadcast block.
BLOCK_CHARS = 8_000_000
_WORD = re.compile(r"[^\W_]+")
_BASE, _MOD = 1_000_003, (1 << 61) - 1


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


class Block:
    """A broadcast block of the benchmark: words as numbers, seeds to their places."""

    def __init__(self, items: list[tuple[int, list[str]]], min_match: int):
        self.words: dict[str, int] = {}
        self.items: list[tuple[int, list[int]]] = []
        self.seeds: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        for item_id, words in items:
            ids = [self.words.setdefault(w, len(self.words) + 1) for w in words]
            n = min(min_match, len(ids))
            self.items.append((item_id, ids))
            for at in range(len(ids) - n + 1 if n else 0):
                self.seeds[n][self.fingerprint(ids[at:at + n])].append((len(self.items) - 1, at))
        self.seeds = {n: dict(s) for n, s in self.seeds.items()}

    @staticmethod
    def fingerprint(ids: list[int]) -> int:
        h = 0
        for x in ids:
            h = (h * _BASE + x) % _MOD
        return h

    def hits(self, doc: list[int]) -> dict[int, list[tuple[int, int]]]:
        """Verified seed hits of a document (0: a word that the block lacks), by item."""
        out: dict[int, list[tuple[int, int]]] = defaultdict(list)
        known = np.flatnonzero(np.asarray(doc))
        if not len(known):
            return out
        for stretch in np.split(known, np.flatnonzero(np.diff(known) > 1) + 1):
            lo, hi = int(stretch[0]), int(stretch[-1]) + 1
            for n, seeds in self.seeds.items():
                if hi - lo < n:
                    continue
                top = pow(_BASE, n - 1, _MOD)
                h = self.fingerprint(doc[lo:lo + n])
                for at in range(lo, hi - n + 1):
                    for item, j in seeds.get(h, ()):
                        if doc[at:at + n] == self.items[item][1][j:j + n]:
                            out[item].append((at, j))
                    if at + n < hi:   # roll on
                        h = ((h - doc[at] * top) * _BASE + doc[at + n]) % _MOD
        return out

    def coverage(self, doc: list[int], min_match: int) -> Iterator[tuple[int, int, int]]:
        """``(item_id, covered words, words)`` for the items that share a seed."""
        for item, hits in self.hits(doc).items():
            item_id, ids = self.items[item]
            n = min(min_match, len(ids))
            yield item_id, sum(t[2] for t in greedy_tiles(hits, n)), len(ids)


def greedy_tiles(hits: list[tuple[int, int]], n: int) -> list[tuple[int, int, int]]:
    """Tiles ``(doc start, item start, length)`` from the seed hits of ``n`` words of one pair."""
    runs: list[list[int]] = []
    for d, i in sorted((i - j, i) for i, j in hits):      # along diagonals
        if runs and runs[-1][0] == d and i <= runs[-1][1] + runs[-1][2] - n + 1:
            runs[-1][2] = i + n - runs[-1][1]
        else:
            runs.append([d, i, n])
    heap = [(-length, i, i - d) for d, i, length in runs]
    heapq.heapify(heap)
    in_doc: set[int] = set()
    in_item: set[int] = set()
    out = []
    while heap:
        length, i, j = heapq.heappop(heap)
        length = -length
        free = [k for k in range(length) if i + k not in in_doc and j + k not in in_item]
        if len(free) == length:
            in_doc.update(range(i, i + length))
            in_item.update(range(j, j + length))
            out.append((i, j, length))
            continue
        start = prev = None
        for k in [*free, None]:                           # what is left of a trimmed match
            if start is not None and (k is None or k != prev + 1):
                if prev - start + 1 >= n:
                    heapq.heappush(heap, (-(prev - start + 1), i + start, j + start))
                start = None
            if start is None:
                start = k
            prev = k
    return out


def _scan(batches: Iterator[pa.RecordBatch], block: Block, min_match: int) -> Iterator[pa.RecordBatch]:
    number = block.words.get
    for b in small(batches):
        rows = []
        for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            doc = [number(w, 0) for w in words_of(text.as_py())]
            rows += [(doc_id, *found) for found in block.coverage(doc, min_match)]
        cols = list(zip(*rows, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols],
                                         names=["doc_id", "item_id", "covered", "n_words"])


def blocks(benchmark: DataFrame, min_match: int, id_col: str = "item_id", text_col: str = "text",
           block_chars: int = BLOCK_CHARS) -> Iterator[Block]:
    """The benchmark in blocks of about ``block_chars`` characters (one longer item is a block of its own)."""
    rows = benchmark.where(F.col(text_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"))
    held, size = [], 0
    for r in rows.toLocalIterator():
        if held and size + len(r.t) > block_chars:
            yield Block(held, min_match)
            held, size = [], 0
        held.append((r.i, words_of(r.t)))
        size += len(r.t)
    if held:
        yield Block(held, min_match)


def leaked_items(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, min_match: int = MIN_MATCH,
                 id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``doc_id, item_id, covered, n_words, coverage`` for each document and benchmark item of which
    the document holds at least ``threshold``.

    Null and wordless texts and items match nothing; items of fewer than ``min_match`` words match
    whole; repeated rows are reported each; other columns are ignored; an empty benchmark or table
    gives an empty result.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ddl = "doc_id long, item_id long, covered long, n_words long"
    out = spark.createDataFrame([], ddl)
    for block in blocks(benchmark, min_match, block_chars=block_chars):
        sent = spark.sparkContext.broadcast(block)   # bounded by block_chars
        out = out.unionByName(texts.mapInArrow(lambda it, sent=sent: _scan(it, sent.value, min_match), ddl))
    cov = F.col("covered") / F.col("n_words")
    return out.withColumn("coverage", cov).where(F.col("coverage") >= threshold)


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD,
                  min_match: int = MIN_MATCH) -> DataFrame:
    """The documents (all columns) that hold no leaked item.

    Each row is judged by its own text, also where its id is null or another row's.  An item of fewer than
    ``min_match`` words stands in clean documents as well; it counts only where its words are at least
    ``threshold`` of the document's.  Rows are told apart by a 64-bit hash of id and text.
    """
    row = F.xxhash64("doc_id", "text")
    found = leaked_items(docs.select(row.alias("doc_id"), "text"), benchmark, threshold, min_match)
    leaks = cut(found.groupBy("doc_id").agg(F.max("n_words").alias("longest")), "leaks")
    own = F.regexp_count(docs["text"], F.lit(r"[\p{L}\p{N}]+"))
    counts = (leaks["longest"] >= min_match) | (leaks["longest"] >= own * threshold)
    return docs.join(leaks, (F.xxhash64(docs["doc_id"], docs["text"]) == leaks["doc_id"]) & counts, "left_anti")
