"""Exact substring deduplication with a logarithmic family of suffix indexes.

Every byte that lies in a ``length``-byte string which also starts in a document
with a smaller id is to be removed.  Comparing all suffixes is not needed: of the
suffixes that start in a ``length``-byte string, the one whose first ``seed`` bytes hash
lowest represents it (its anchor), and equal strings have equal anchors.  So the
index holds anchor suffixes only, about one in 16.

* Blocks.  Documents are packed into blocks of some megabytes (compressed,
  bucketed by block, so that later passes join their replies without moving text).
* Suffix arrays.  Blocks come in batches.  The anchors of a batch, sorted by the
  fingerprint of their seed, are its suffix array, dealt over tasks by fingerprint
  range.  It is merge-scanned against itself and all levels of the index for seeds that
  another document has; then it becomes a level, and levels of equal size are merged
  geometrically, so a suffix is rewritten a logarithmic number of times.  Levels name the
  blocks a seed is in; the blocks of both sides get the shared seeds in reply.
* Extension.  Around each shared seed, the region that its strings cover is
  compared (64-bit fingerprint): where an earlier document has the whole region, all its
  strings are repeats.  Where regions of one seed differ, the single strings are
  compared, which settles the ends of matches.
* Every block then removes what the replies mark, and hashes the rest.

Whatever a seed, region or string occurs in, a block sends it once, so a passage in a
third of all documents is no task's burden.  Blocks send packed, sorted arrays.
"""

from __future__ import annotations

import hashlib
import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, shared_path
from .common import cut, discard, shuffle_partitions, stored

LENGTH, SEED, BATCHES = 50, 20, 4
#: Bytes of text in a block, and bytes that a task handles at once (a longer text goes alone).
BLOCK_BYTES, _CHUNK = 8_000_000, 1_000_000

#: Fingerprint ranges (a task's unit of sorting) for each shuffle partition.
RANGES = 4

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_TABLE = np.random.default_rng(5).integers(0, 2**63, 256, dtype=_U) * _U(2) + _U(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as compressed bytes; the first is sorted and kept as differences."""
    first = np.diff(arrays[0], prepend=arrays[0].dtype.type(0))
    planes = [(a.dtype.str, np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes())
              for a in (first, *arrays[1:])]
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(planes))


def _unpack(blob: bytes) -> list[np.ndarray]:
    out = []
    for kind, raw in pickle.loads(zstandard.ZstdDecompressor().decompress(blob)):
        size = np.dtype(kind).itemsize
        planes = np.frombuffer(raw, np.uint8) if raw else np.zeros(0, np.uint8)
        out.append(np.ascontiguousarray(planes.reshape(size, -1).T).reshape(-1).view(kind))
    out[0] = np.cumsum(out[0], dtype=out[0].dtype)
    return out


def _power(n: int) -> np.uint64:
    return _U(pow(_BASE, n, 2**64))


class Chunk:
    """Some texts end to end: their anchors, regions and strings."""

    def __init__(self, texts: list[bytes], live: np.ndarray, length: int, seed: int):
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        n = len(self.data)
        sizes = np.array([len(t) for t in texts])
        self.length = length
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        self.s = self.e = self.doc = np.zeros(0, np.int64)
        self.h = self.g = np.zeros(0, _U)
        self.back = self.sums = np.zeros(1, _U)
        if n < length:
            return
        x = _TABLE[self.data]
        powers = np.cumprod(np.concatenate([[_U(1)], np.full(n, _U(_BASE))]), dtype=_U)
        self.back = np.cumprod(np.concatenate([[_U(1)], np.full(n, _U(pow(_BASE, -1, 2**64)))]), dtype=_U)
        self.sums = np.concatenate([[_U(0)], np.cumsum(x * powers[:-1], dtype=_U)])
        v = _mix((self.sums[seed:] - self.sums[:-seed]) * self.back[:n - seed + 1])   # of the seed at each byte
        bits = _U(int(len(v)).bit_length())
        low = (v >> bits << bits) | np.arange(len(v), dtype=_U)   # the leftmost wins a tie
        width, have = length - seed + 1, 1
        while have < width:
            step = min(have, width - have)
            low = np.minimum(low[:-step], low[step:])
            have += step
        edge = np.zeros(n + 1, np.int32)
        fits = (sizes >= length) & live
        np.add.at(edge, self.starts[:-1][fits], 1)
        np.add.at(edge, (self.starts[1:] - length + 1)[fits], -1)
        p = np.flatnonzero(np.cumsum(edge)[:len(low)] > 0)   # where a string of one text starts
        if not len(p):
            return
        at = (low[p] & ((_U(1) << bits) - _U(1))).astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (p[1:] != p[:-1] + 1)]))
        self.s, self.e = p[new], p[np.append(new[1:], len(p)) - 1]   # first and last string of each anchor
        at = at[new]
        self.h = v[at]
        shape = ((at - self.s) << 16 | (self.e - self.s)).astype(_U)
        self.g = _mix(self._print(self.s, self.e + length) ^ _mix(shape + _U(1)))
        self.doc = np.searchsorted(self.starts, self.s, "right") - 1

    def _print(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (self.sums[b] - self.sums[a]) * self.back[a]

    def strings(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and fingerprints of all strings of the anchors ``some``."""
        count = self.e[some] - self.s[some] + 1
        p = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(self.s[some], count)
        return p, _mix(self._print(p, p + self.length) ^ _U(0x5851F42D4C957F2D))


def _blocks(batches: Iterator[pa.RecordBatch], batches_n: int, block_bytes: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, made = TaskContext.get().partitionId(), 0
    ids, texts, size = [], [], 0

    def row():
        lens = np.array([len(t) for t in texts], np.int64)
        blob = zstandard.ZstdCompressor(level=3).compress(b"".join(texts))
        block = part * 2**20 + made
        return pa.RecordBatch.from_arrays(
            [pa.array([block], pa.int64()), pa.array([(part + made) % batches_n], pa.int32()),
             pa.array([ids], pa.list_(pa.int64())), pa.array([lens.tolist()], pa.list_(pa.int64())),
             pa.array([blob], pa.binary())], names=["block", "batch", "ids", "lens", "texts"])

    for b in batches:
        for doc, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
            ids.append(doc)
            texts.append(text)
            size += len(text)
            if size >= block_bytes or len(ids) >= 50_000:
                yield row()
                ids, texts, size, made = [], [], 0, made + 1
    if ids:
        yield row()


def _chunks(ids, lens, blob: bytes, length: int, seed: int) -> Iterator[tuple[Chunk, list]]:
    """The chunks of a block with the ids of their texts."""
    raw = zstandard.ZstdDecompressor().decompress(blob, max_output_size=max(1, int(sum(lens))))
    at = i = 0
    while i < len(ids):
        j, texts, size = i, [], 0
        while j < len(ids) and (not texts or size + lens[j] <= _CHUNK):
            texts.append(raw[at:at + lens[j]])
            at, size, j = at + int(lens[j]), size + int(lens[j]), j + 1
        own = [None if d is None or d != d else int(d) for d in ids[i:j]]
        yield Chunk(texts, np.array([d is not None for d in own]), length, seed), own
        i = j


def _by_doc(own: list) -> np.ndarray:
    return np.array([0 if d is None else d for d in own], np.int64)


def _least(key: np.ndarray, doc: np.ndarray, *more: np.ndarray) -> list[np.ndarray]:
    """Sorted unique keys with the smallest document of each, whether another document has the key
    too, and what else stands in the smallest one's row."""
    order = np.lexsort((doc, key))
    key, doc = key[order], doc[order]
    first = np.array([a for a, _ in _runs(key)], np.int64)
    last = np.append(first[1:], len(key))[:len(first)] - 1
    return [key[first], doc[first], (doc[first] != doc[last]).astype(np.uint8), *(m[order][first] for m in more)]


def _find(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each key is there, and where."""
    if not len(sorted_keys):
        return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return sorted_keys[at] == keys, at


def _runs(key: np.ndarray) -> list[tuple[int, int]]:
    """Start and end of each run of equal values."""
    edges = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
    return list(zip(edges[:-1], edges[1:], strict=True)) if len(key) else []


def _deal(block: int, key: np.ndarray, shift: int, parts: int, *more: np.ndarray) -> Iterator[tuple]:
    """Rows ``(part, block, blob)`` of arrays sorted by ``key``, cut by key range."""
    bounds = np.array([-(-k * 2**(64 - shift) // parts) for k in range(parts)], _U)
    cuts = [*np.searchsorted(key, bounds).tolist(), len(key)]
    for k in range(parts):
        a, b = cuts[k], cuts[k + 1]
        if b > a:
            yield k, block, _pack(key[a:b], *(m[a:b] for m in more))


_SENT = "part int, block long, blob binary"
_REPLY = "block long, kind int, blob binary"


def _frame(rows: list[tuple], names: str) -> pd.DataFrame:
    cols = [x.split()[0] for x in names.split(", ")]
    return pd.DataFrame({c: list(v) for c, v in zip(cols, zip(*rows, strict=True) if rows else [()] * len(cols), strict=True)})


class _Job:
    """The parameters that every pass shares; its methods run in tasks."""

    def __init__(self, length: int, seed: int, bits: int, parts: int):
        self.length, self.seed, self.shift, self.parts = length, seed, 64 - bits, parts

    def chunks(self, row) -> Iterator[tuple[Chunk, list]]:
        return _chunks(row.ids, row.lens, row.texts, self.length, self.seed)

    # -- suffix arrays ------------------------------------------------------------------
    def suffixes(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The anchor suffixes of a block, each seed once, with a mark if two documents have it."""
        for b in batches:
            for row in b.itertuples():
                h, d = [], []
                for c, own in self.chunks(row):
                    h.append(c.h >> _U(self.shift))
                    d.append(_by_doc(own)[c.doc])
                h, _, several = _least(np.concatenate(h), np.concatenate(d))
                yield _frame(list(_deal(row.block, h, self.shift, self.parts, several)), _SENT)

    def scan(self, rows: pd.DataFrame, merge: frozenset[int]) -> pd.DataFrame:
        """Sort the new suffix array of a range, merge-scan it with the levels, merge equal-sized ones.
        Rows with a ``level`` below 0 are new blocks.  Gives replies and the new level."""
        new = rows[rows["level"] < 0]
        got = [_unpack(x) for x in new["blob"]]
        h = np.concatenate([g[0] for g in got]) if got else np.zeros(0, _U)
        own = np.concatenate([np.full(len(g[0]), b, np.int64) for g, b in zip(got, new["block"], strict=True)] or [np.zeros(0, np.int64)])
        several = np.concatenate([g[1] for g in got] or [np.zeros(0, np.uint8)])
        order = np.argsort(h, kind="stable")
        h, own, several = h[order], own[order], several[order]
        first = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.zeros(0, bool)
        run = np.cumsum(first) - 1
        seeds = h[first]
        shared = np.bincount(run, 1 + several.astype(np.int64) * 2, len(seeds)) > 1
        reply_h, reply_b, kept = [], [], [(h, own)]
        for level, blob in zip(rows["level"], rows["blob"], strict=True):
            if level < 0:
                continue
            lh, lb = _unpack(blob)
            there, at = _find(seeds, lh)      # one sweep over both sorted arrays
            shared[at[there]] = True
            reply_h.append(lh[there])
            reply_b.append(lb[there])
            if level in merge:
                kept.append((lh, lb))
        reply_h.append(h[shared[run]] if len(h) else h)
        reply_b.append(own[shared[run]] if len(h) else own)
        rh, rb = np.concatenate(reply_h), np.concatenate(reply_b)
        order = np.lexsort((rh, rb))
        rh, rb = rh[order], rb[order]
        out = [(int(rb[a]), 0, _pack(np.unique(rh[a:z]))) for a, z in _runs(rb)]
        mh, mb = (np.concatenate(x) for x in zip(*kept, strict=True))
        order = np.argsort(mh, kind="stable")
        out.append((int(rows["part"].iloc[0]), -1, _pack(mh[order], mb[order])))
        return _frame(out, _REPLY)

    def scanning(self, merge: frozenset[int]):
        return lambda rows: self.scan(rows, merge)

    # -- extension ------------------------------------------------------------------------
    def regions(self, blocks: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        """Of the shared seeds of a block: each different region with its smallest document."""
        out = []
        for row in blocks.itertuples():
            seeds = np.unique(np.concatenate([_unpack(x)[0] for x in replies["blob"]] or [np.zeros(0, _U)]))
            h, g, d = [], [], []
            for c, own in self.chunks(row):
                ch = c.h >> _U(self.shift)
                some = _find(seeds, ch)[0]
                h.append(ch[some])
                g.append(c.g[some])
                d.append(_by_doc(own)[c.doc[some]])
            g, d, many, h = _least(np.concatenate(g), np.concatenate(d), np.concatenate(h))
            order = np.argsort(h, kind="stable")
            out += _deal(row.block, h[order], self.shift, self.parts, g[order], d[order], many[order])
        return _frame(out, _SENT)

    def compare_regions(self, rows: pd.DataFrame) -> pd.DataFrame:
        """For each region of a block its smallest document anywhere, and whether its seed has other regions."""
        got = [_unpack(x) for x in rows["blob"]]
        h, g, d, many = (np.concatenate(x) for x in zip(*got, strict=True))
        order = np.lexsort((d, g, h))
        h, g, d, many = h[order], g[order], d[order], many[order]
        new_h = np.concatenate([[True], h[1:] != h[:-1]])
        new_g = new_h | np.concatenate([[True], g[1:] != g[:-1]])
        run_h, run_g = np.cumsum(new_h) - 1, np.cumsum(new_g) - 1
        several = np.bincount(run_h, new_g)[run_h] > 1
        alone = np.bincount(run_g, 1 + many.astype(np.int64))[run_g] == 1
        least = d[np.flatnonzero(new_g)][run_g]
        block = np.repeat(rows["block"].to_numpy(), [len(x[0]) for x in got])[order]
        return self._answer(block, 1, ~alone | several, g, least, several.astype(np.uint8))

    @staticmethod
    def _answer(block: np.ndarray, kind: int, keep: np.ndarray, key: np.ndarray, *more: np.ndarray) -> pd.DataFrame:
        order = np.flatnonzero(keep)
        order = order[np.lexsort((key[order], block[order]))]
        block, key, more = block[order], key[order], [m[order] for m in more]
        return _frame([(int(block[a]), kind, _pack(key[a:z], *(m[a:z] for m in more))) for a, z in _runs(block)], _REPLY)

    @staticmethod
    def _known(replies: pd.DataFrame, kind: int, columns: int) -> list[np.ndarray]:
        """The replies of a kind to a block, sorted by key."""
        got = [_unpack(x) for x in replies["blob"][replies["kind"] == kind]]
        if not got:
            return [np.zeros(0, _U)] + [np.zeros(0, np.int64)] * columns
        joined = [np.concatenate(x) for x in zip(*got, strict=True)]
        order = np.argsort(joined[0], kind="stable")
        return [x[order] for x in joined]

    def strings(self, blocks: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        """The single strings of regions that differ from others of their seed, sent by the smallest document."""
        out = []
        for row in blocks.itertuples():
            key, least, several = self._known(replies, 1, 2)
            w, d = [], []
            for c, own in self.chunks(row):
                there, at = _find(key, c.g)
                doc = _by_doc(own)[c.doc]
                there[there] = (several[at[there]] > 0) & (least[at[there]] == doc[there])
                some = np.flatnonzero(there)
                w.append(c.strings(some)[1])
                d.append(np.repeat(doc[some], c.e[some] - c.s[some] + 1))
            w, d, many = _least(np.concatenate(w), np.concatenate(d))
            out += _deal(row.block, w, 0, self.parts, d, many)
        return _frame(out, _SENT)

    def compare_strings(self, rows: pd.DataFrame) -> pd.DataFrame:
        got = [_unpack(x) for x in rows["blob"]]
        w, d, many = (np.concatenate(x) for x in zip(*got, strict=True))
        order = np.lexsort((d, w))
        w, d, many = w[order], d[order], many[order]
        first = np.concatenate([[True], w[1:] != w[:-1]])
        least = d[np.flatnonzero(first)][np.cumsum(first) - 1]
        block = np.repeat(rows["block"].to_numpy(), [len(x[0]) for x in got])[order]
        return self._answer(block, 2, (least < d) | (many > 0), w, least)

    # -- removal ------------------------------------------------------------------------
    def remove(self, blocks: pd.DataFrame, replies: pd.DataFrame, with_text: bool) -> pd.DataFrame:
        rows = []
        for row in blocks.itertuples():
            key, least, several = self._known(replies, 1, 2)
            wkey, wleast = self._known(replies, 2, 1)
            for c, own in self.chunks(row):
                doc = _by_doc(own)
                gone = np.zeros(len(c.data) + 1, np.int32)
                there, at = _find(key, c.g)
                late = there.copy()
                late[there] = least[at[there]] < doc[c.doc[there]]
                np.add.at(gone, c.s[late], 1)
                np.add.at(gone, c.e[late] + self.length, -1)
                some = there & ~late
                some[some] = several[at[some]] > 0
                some = np.flatnonzero(some)
                if len(some):
                    p, w = c.strings(some)
                    hit, wat = _find(wkey, w)
                    of = np.repeat(doc[c.doc[some]], c.e[some] - c.s[some] + 1)
                    hit[hit] = wleast[wat[hit]] < of[hit]
                    np.add.at(gone, p[hit], 1)
                    np.add.at(gone, p[hit] + self.length, -1)
                covered = np.cumsum(gone)[:-1] > 0
                begins = covered.copy()
                begins[1:] &= ~covered[:-1]
                heads = c.starts[:-1][np.diff(c.starts) > 0]
                begins[heads] = covered[heads]
                for k, d in enumerate(own):
                    a, z = c.starts[k], c.starts[k + 1]
                    left = c.data[a:z][~covered[a:z]].tobytes()
                    rows.append((d, int(z - a), int(z - a) - len(left), int(begins[a:z].sum()),
                                 hashlib.sha256(left).hexdigest(), left))
        out = _frame(rows, _RESULT + ", kept binary")
        out["doc_id"] = out["doc_id"].astype("Int64")
        return out if with_text else out.drop(columns="kept")


_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _cogroup(blocks: DataFrame, replies: DataFrame, task, ddl: str) -> DataFrame:
    return blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInPandas(lambda b, r: task(b, r), ddl)


@stored
def remove_repeats(df: DataFrame, length: int = LENGTH, batches: int = BATCHES, seed: int = SEED,
                   with_text: bool = False, id_col: str = "doc_id", text_col: str = "text",
                   block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per input row: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` and, on request,
    ``kept`` (the remaining bytes).

    Null text counts as empty; texts shorter than ``length`` lose nothing.  A row with a null id is
    neither searched nor removed from; rows that share an id do not count as earlier than one
    another.  Other columns are ignored; an empty table stays empty.
    """
    if not 0 < seed < length:
        raise ValueError("seed must be shorter than length")
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"),
                     F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    buckets = shuffle_partitions(spark)
    parts = buckets * RANGES
    name = f"llm_blocks_{uuid.uuid4().hex[:12]}"
    place = shared_path(spark, "tables", name, unique=False)
    (docs.mapInArrow(lambda it: _blocks(it, batches, block_bytes),
                     "block long, batch int, ids array<long>, lens array<long>, texts binary")
         .write.option("compression", "none").bucketBy(buckets, "block").sortBy("block")
         .saveAsTable(name, format="parquet", path=place))
    blocks = spark.table(name)
    size = blocks.select(F.sum(F.aggregate("lens", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    bits = min(64, 16 + int(size).bit_length())   # so that few different seeds share a fingerprint
    job = _Job(length, seed, bits, parts)

    replies: DataFrame | None = None
    levels: dict[int, DataFrame] = {}
    for number in range(batches):
        merge, level = [], 0
        while level in levels:                    # a level holds 2^level batches
            merge.append(level)
            level += 1
        rows = (blocks.where(F.col("batch") == number).mapInPandas(job.suffixes, _SENT)
                      .withColumn("level", F.lit(-1)))
        for k, held in levels.items():
            rows = rows.unionByName(held.select("part", F.lit(0).cast("long").alias("block"), "blob", F.lit(k).alias("level")))
        got = cut(rows.groupBy("part").applyInPandas(job.scanning(frozenset(merge)), _REPLY), "suffix_scan")
        for k in merge:
            del levels[k]
        levels[level] = got.where("kind = -1").select(F.col("block").cast("int").alias("part"), "blob")
        found = got.where("kind = 0")
        replies = found if replies is None else replies.unionByName(found)

    regions = _cogroup(blocks, replies, job.regions, _SENT)
    whole = cut(regions.groupBy("part").applyInPandas(lambda x: job.compare_regions(x), _REPLY), "suffix_regions")
    strings = _cogroup(blocks, whole, job.strings, _SENT)
    ends = cut(strings.groupBy("part").applyInPandas(lambda x: job.compare_strings(x), _REPLY), "suffix_strings")
    out = cut(_cogroup(blocks, whole.unionByName(ends), lambda b, r: job.remove(b, r, with_text),
                       _RESULT + (", kept binary" if with_text else "")), "suffix_removed")
    spark.sql(f"DROP TABLE {name}")   # an external table: its files go separately
    discard(spark, place)
    return out
