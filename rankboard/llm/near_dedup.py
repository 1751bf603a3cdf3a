"""Near-duplicate classes by DartMinHash.

A text is a weighted set: its five-word shingles with their counts.  Every unit of
an element's weight is a region of the weight axis into which hashed darts fall as
a Poisson process over rank: the gaps between their ranks come from the hash of
(shingle, unit, dart number), so all texts that hold the unit see the same darts.
A text of total weight W looks at darts of rank below t / W, about t = k ln k + 2k
darts, whatever W is; each dart hashes to one of k coordinates, and the earliest
dart of a coordinate is its signature value.  A coordinate left empty makes the
text look twice as far.  Two texts agree in a coordinate with probability equal to
their weighted Jaccard similarity.

Signatures are cut into bands.  Texts with equal words are one class from the
start, so only one of them is banded.  In each bucket two leaders (the text that shares
buckets with most others, and the first) are verified (exact weighted Jaccard) against
all members, never all against each other; the links are
joined into classes.  The texts of buckets that still hold several classes are then paired by the
rarest of their elements (``prefixes``, without loss), and such pairs of different classes verified one by
one.  So any two similar texts that share a bucket end up in one class.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, small, stored
from .components import connected_components
from .prefixes import prefix_pairs

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 24, 5
_WORD = re.compile(r"[^\W_]+")
#: Words that a task takes at once, and words whose hash it remembers.
_CHUNK, _CACHE = 500_000, 500_000

_U = np.uint64
_M1, _M2, _STEP = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB), _U(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser."""
    x = (x ^ (x >> _U(30))) * _M1
    x = (x ^ (x >> _U(27))) * _M2
    return x ^ (x >> _U(31))


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > _CACHE:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def _elements(words: list[np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit elements (shingle, occurrence) of texts given as word hashes: hashes and the text of each.
    A text of fewer than ``n`` words is one shingle; one without words has none."""
    sizes = np.array([len(w) for w in words])
    flat = np.concatenate(words) if len(words) else np.zeros(0, _U)
    pad = np.concatenate([flat, np.zeros(n, _U)])
    starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    count = np.where(sizes >= n, sizes - n + 1, np.minimum(sizes, 1))
    doc = np.repeat(np.arange(len(words)), count)
    at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + starts[doc]
    s = np.zeros(len(at), _U)
    room = sizes[doc] - (at - starts[doc])
    for j in range(n):
        s = _mix(s * _M2 + np.where(j < room, pad[at + j], _U(0)) + _U(j + 1))
    order = np.lexsort((s, doc))
    s, doc = s[order], doc[order]
    fresh = np.ones(len(s), bool)
    fresh[1:] = (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])
    first = np.maximum.accumulate(np.where(fresh, np.arange(len(s)), 0))
    return _mix(s + (np.arange(len(s)) - first).astype(_U) * _STEP), doc


def dart_minhash(element: np.ndarray, doc: np.ndarray, docs: int, k: int) -> np.ndarray:
    """Signatures (``docs`` x ``k``) of weighted sets given as unit elements, sorted by ``doc``.
    Sets without elements keep a row of zeros."""
    sig = np.zeros((docs, k), _U)
    weight = np.bincount(doc, minlength=docs)
    reach = (k * np.log(k) + 2 * k) / np.maximum(weight, 1)
    todo = weight > 0
    while todo.any():
        live = todo[doc]
        e, d = element[live], doc[live]
        rank, hit = np.zeros(len(e)), []
        number = 0
        while len(e):
            number += 1
            u = _mix(e + _U(number * int(_STEP) % 2**64))
            rank = rank - np.log(((u >> _U(11)).astype("float64") + 0.5) / 2.0**53)
            near = rank < reach[d]
            e, d, rank = e[near], d[near], rank[near]
            hit.append((d, u[near], rank))
        d, u, rank = (np.concatenate(x) for x in zip(*hit, strict=True))
        v = _mix(u ^ _STEP)
        cell = d * k + (v % _U(k)).astype("int64")
        late_first = np.argsort(-rank, kind="stable")
        got = np.zeros(docs * k, bool)
        got[cell] = True
        flat = sig.reshape(-1)
        flat[cell[late_first]] = v[late_first]   # the earliest dart is written last
        todo = todo & ~got.reshape(docs, k).all(1)
        reach[todo] *= 2
    return sig


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[np.ndarray]]]:
    """Ids and word hashes of texts, about ``_CHUNK`` words at a time."""
    seen = _Hashes()
    ids, words, total = [], [], 0
    for b in small(batches):
        for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            w = np.array([seen[x] for x in _WORD.findall((text.as_py() or "").lower())], _U)
            ids.append(doc)
            words.append(w)
            total += len(w)
            if total >= _CHUNK or len(ids) >= 5000:
                yield ids, words
                ids, words, total = [], [], 0
    if ids:
        yield ids, words


def _signed(batches, n: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    for ids, words in _texts(batches):
        element, doc = _elements(words, n)
        sig = dart_minhash(element, doc, len(ids), bands * rows).reshape(len(ids), bands, rows)
        band = np.broadcast_to(np.arange(bands, dtype=_U), (len(ids), bands)) + _U(1)
        for j in range(rows):
            band = _mix(band * _M2 + sig[:, :, j])
        none = np.array([len(w) == 0 for w in words])
        flat = pa.array(band.astype("int64").reshape(-1))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype="int32") * bands), flat)
        same = [xxhash.xxh3_128_hexdigest(w.tobytes()) for w in words]
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array([None if e else x for x, e in zip(same, none, strict=True)], pa.string()),
             lists], names=["doc_id", "same", "bands"])


def _element_rows(batches, n: int) -> Iterator[pa.RecordBatch]:
    for ids, words in _texts(batches):
        element, doc = _elements(words, n)
        ends = np.searchsorted(doc, np.arange(len(ids) + 1)).astype("int32")
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(element.astype("int64")))],
            names=["doc_id", "elements"])


@stored
def near_classes(df: DataFrame, similarity: float = SIMILARITY, words: int = WORDS, bands: int = BANDS,
                 rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, class_id, class_size, kept``.

    A class is a connected component of texts with weighted Jaccard similarity of at least
    ``similarity`` over word shingles; its id is its smallest ``doc_id``, the one that is kept.
    Null, empty and wordless texts resemble nothing: each is a class of its own.  Ids should be
    unique; rows that repeat an id count as one document.  A null id is left out of classes
    (``class_id`` null, kept).  Other columns are ignored; an empty table stays empty.
    """
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = cut(docs.mapInArrow(lambda it: _signed(it, words, bands, rows),
                                 "doc_id long, same string, bands array<long>"), "near_signed")
    copies = cut(signed.where("same IS NOT NULL AND doc_id IS NOT NULL")
                       .groupBy("same").agg(F.min("doc_id").alias("rep")), "near_copies")
    reps = copies.select(F.col("rep").alias("doc_id"))
    members = cut(signed.join(reps, "doc_id", "left_semi").where("same IS NOT NULL")
                        .select("doc_id", F.explode("bands").alias("bucket")), "near_buckets")
    shared = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = cut(members.join(cut(shared, "near_shared"), "bucket"), "near_members")
    # the text that shares buckets with most others is most likely what the others are copies of
    hubs = cut(members.groupBy("doc_id").agg(F.sum("n").alias("hub")), "near_hubs")

    held = cut(docs.join(members.select("doc_id").distinct(), "doc_id", "left_semi").mapInArrow(
        lambda it: _element_rows(it, words), "doc_id long, elements array<long>"), "near_elements")
    side = lambda c, e: held.select(F.col("doc_id").alias(c), F.col("elements").alias(e))
    both = F.size(F.array_intersect("ea", "eb"))
    similar = both / (F.size("ea") + F.size("eb") - both) >= similarity

    links = tried = classes = None
    for step in ("leaders", "pairs"):
        if step == "leaders":
            lead = (members.join(hubs, "doc_id").groupBy("bucket")
                           .agg(F.array_distinct(F.array(F.max(F.struct("hub", "doc_id"))["doc_id"], F.min("doc_id"))).alias("l"))
                           .select("bucket", F.explode("l").alias("l")))
            pairs = (members.join(cut(lead, "near_leaders"), "bucket").where("doc_id != l")
                            .select(F.least("doc_id", "l").alias("a"), F.greatest("doc_id", "l").alias("b")).distinct())
        else:   # only buckets that still hold several components
            if classes is None:
                m = members.withColumn("c", F.col("doc_id")).drop("n")
            else:
                m = members.drop("n").join(classes, "doc_id", "left").withColumn("c", F.coalesce("c", "doc_id"))
            several = (m.groupBy("bucket").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count(F.lit(1)).alias("n"))
                        .where("lo < hi AND n > 2").select("bucket"))
            still = cut(m.join(cut(several, "near_several"), "bucket").select("doc_id", "c").distinct(), "near_open")
            sets = held.join(still, "doc_id").select(F.col("doc_id").alias("node"), "c", "elements")
            pairs = prefix_pairs(sets, similarity, "near").join(tried, ["a", "b"], "left_anti")
        tried = cut(pairs, "near_pairs")
        if tried.isEmpty():
            break
        found = cut(tried.join(side("a", "ea"), "a").join(side("b", "eb"), "b").where(similar).select("a", "b"),
                    "near_links")
        links = found if links is None else links.unionByName(found)
        classes = cut(connected_components(links, "a", "b").select(F.col("node").alias("doc_id"), F.col("component").alias("c")),
                      "near_classes")
    top = copies if classes is None else copies.join(classes.withColumnRenamed("doc_id", "rep"), "rep", "left")
    top = cut(top.select("same", (F.col("rep") if classes is None else F.coalesce("c", "rep")).alias("class_id")), "near_top")
    rows_ = signed.select("doc_id", "same").join(top, "same", "left").select(
        "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))
    rows_ = cut(rows_, "near_rows")
    sizes = cut(rows_.groupBy("class_id").agg(F.count(F.lit(1)).alias("class_size")), "near_sizes")
    return (rows_.join(sizes, "class_id", "left")
                 .select("doc_id", "class_id", F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
                         F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)).alias("kept")))
