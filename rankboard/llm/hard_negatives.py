"""Hard negatives by length buckets and coordinate pruning (LEMP).

Index: rows of one label and nearly one length (the class is the length's logarithm) are a bucket, or
several where there are many.  A bucket is one row: its ids, its integer vectors and, for every
coordinate, its vectors in the order of that coordinate of their direction.  All rows are indexed.

Search: the anchors meet the index in blocks (a shelf of buckets, a group of anchors).  A bucket's
longest vector turns the score that a candidate needs into a cosine t.  A direction within acos(t) of the anchor's has
each coordinate f within cos(acos(a_f) +- acos(t)); of the anchor's focus coordinates, its largest, the
shortest such range is cut out of the sorted list, the others thin it out, and what is left is
verified by its exact integer product.  A bucket too short for t is skipped; where no range is shorter than
``FULL`` of the bucket, all of it is verified.  The score needed rises while buckets are searched.

First every anchor gets its positives (own label), then the negatives of all its positives in one pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, shuffle_partitions, stored

POSITIVES, NEGATIVES, LOW, HIGH, SCALE = 5, 10, 30, 90, 256
#: Rows of a bucket, of a shelf at least (few rows) and at most, and anchors of a group.
BUCKET, SHELF_LEAST, SHELF_MOST, ANCHORS = 1024, 4096, 65_536, 2048
#: Focus coordinates, and the share of a bucket from which pruning does not pay.
FOCUS, FULL = 4, 0.5
_EPS = 1e-9
_INDEX = "size int, label long, class int, piece long, n int, shortest double, longest double, ids binary, q binary, sorted binary"


def integer_vectors(df: DataFrame, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding",
                    label: str | None = None) -> DataFrame:
    """``vec_id, label, q, size, length2``: floor(scale * x) of all rows that take part, one for each id."""
    x = F.col(vector_col)
    finite = F.coalesce(F.forall(x, lambda v: F.abs(v.cast("double")) < float("inf")), F.lit(False))
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.expr(label or "label").cast("long").alias("label"),
                     F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("long")).alias("q"), finite.alias("fit"))
    rows = rows.where("fit AND vec_id IS NOT NULL AND label IS NOT NULL").groupBy("vec_id").agg(
        F.min(F.struct("label", "q")).alias("r")).select("vec_id", "r.*")
    return rows.select("*", F.size("q").alias("size"),
                       F.aggregate("q", F.lit(0).cast("long"), lambda s, v: s + v * v).alias("length2"))


def _bucket(pdf: pd.DataFrame) -> pd.DataFrame:
    """A bucket's row; of the sorted lists the order is kept, as two-byte places."""
    q = np.stack(pdf["q"]).astype(np.int64)
    length = np.sqrt(pdf["length2"].to_numpy().astype(np.float64))
    unit = q / np.maximum(length, 1)[:, None]
    first = pdf.iloc[0]
    return pd.DataFrame([(first["size"], first["label"], first["class"], first["piece"], len(pdf), length.min(), length.max(),
                          pdf["vec_id"].to_numpy().astype("<i8").tobytes(), _pack(q),
                          np.argsort(unit, axis=0, kind="stable").T.astype("<u4").tobytes())],
                        columns=["size", "label", "class", "piece", "n", "shortest", "longest", "ids", "q", "sorted"])


def _pack(q: np.ndarray) -> bytes:
    """Two, four or eight bytes a component, told by the length."""
    for kind in ("<i2", "<i4"):
        if not q.size or (np.iinfo(kind).min <= q.min() and q.max() <= np.iinfo(kind).max):
            return q.astype(kind).tobytes()
    return q.astype("<i8").tobytes()


def _unpack(data: bytes, n: int, size: int) -> np.ndarray:
    width = len(data) // max(1, n * size)
    return np.frombuffer(data, f"<i{width or 2}").reshape(n, size).astype(np.int64)


class Bucket:
    def __init__(self, row):
        self.label, self.n, self.shortest, self.longest = row.label, row.n, row.shortest, row.longest
        self.ids = np.frombuffer(row.ids, "<i8")
        self.q = _unpack(row.q, row.n, row.size)
        self.order = np.frombuffer(row.sorted, "<u4").reshape(row.size, row.n)
        self.unit = self.q / np.maximum(np.sqrt((self.q.astype(np.float64) ** 2).sum(1)), 1)[:, None]
        self.lists = np.take_along_axis(self.unit.T, self.order.astype(np.int64), 1)
        self.real = self.q.astype(np.float64)

    def scores(self, q: np.ndarray, length: float, rows=slice(None)) -> np.ndarray:
        """Exact products: doubles are while no partial sum can pass 2 ** 52, 64-bit integers always are."""
        if length * self.longest < 2**52:
            return (self.real[rows] @ q.astype(np.float64)).astype(np.int64)
        return self.q[rows] @ q

    def candidates(self, q: np.ndarray, length: float, need: float, stats: dict) -> np.ndarray | slice | None:
        """Rows that may score ``need``: None, all, or those in the feasible ranges of the focus coordinates."""
        if length == 0 or self.longest == 0:
            return slice(None) if need <= 0 else None
        # a positive need is easiest for the longest vector, a negative one for the shortest
        t = need / (length * (self.longest if need > 0 else max(self.shortest, 1)))
        if t > 1 + _EPS:
            return None
        wide = np.arccos(np.clip(t, -1, 1)) + _EPS
        focus = np.argsort(-np.abs(q), kind="stable")[:FOCUS]
        at = np.arccos(np.clip(q[focus] / length, -1, 1))
        low, high = np.cos(np.minimum(np.pi, at + wide)) - _EPS, np.cos(np.maximum(0, at - wide)) + _EPS
        ends = [(np.searchsorted(self.lists[f], a), np.searchsorted(self.lists[f], b, "right"))
                for f, a, b in zip(focus, low, high, strict=True)]
        size = [b - a for a, b in ends]
        k = int(np.argmin(size))
        if size[k] == 0:
            return None
        if size[k] > FULL * self.n:
            return slice(None)
        rows = self.order[focus[k], ends[k][0]:ends[k][1]].astype(np.int64)
        inside = ((self.unit[rows][:, focus] >= low) & (self.unit[rows][:, focus] <= high)).all(1)
        stats["pruned"] = stats.get("pruned", 0) + self.n - int(inside.sum())
        return rows[inside]


class Best:
    """The first ``k`` by score, then id, of what lies within [low, high]."""

    def __init__(self, k: int, low: int | None = None, high: int | None = None):
        self.k, self.low, self.high = k, low, high
        self.score, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def need(self) -> float:
        held = self.score[self.k - 1] if len(self.score) == self.k else -np.inf
        return max(held, -np.inf if self.low is None else self.low)

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        fit = score >= self.need
        if self.high is not None:
            fit &= score <= self.high
        score, ids = np.concatenate([self.score, score[fit]]), np.concatenate([self.ids, ids[fit]])
        first = np.lexsort((ids, -score))[:self.k]
        self.score, self.ids = score[first], ids[first]


def search(buckets: list[Bucket], q: np.ndarray, wanted: list[Best], stats: dict) -> None:
    """All that ``wanted`` asks for in the buckets, the longest vectors first."""
    length = float(np.sqrt((q.astype(np.float64) ** 2).sum()))
    for bucket in buckets:
        rows = bucket.candidates(q, length, min(w.need for w in wanted), stats)
        if rows is None:
            continue
        score, ids = bucket.scores(q, length, rows), bucket.ids[rows]
        for w in wanted:
            w.add(score, ids)


def _buckets(index: pd.DataFrame) -> dict[int, list[Bucket]]:
    by_size: dict[int, list[Bucket]] = {}
    for row in index.sort_values("longest", ascending=False).itertuples():
        by_size.setdefault(row.size, []).append(Bucket(row))
    return by_size


def _positives(index: pd.DataFrame, anchors: pd.DataFrame, k: int) -> Iterator[tuple]:
    by_size = _buckets(index)
    for a in anchors.itertuples():
        q = _unpack(a.q, 1, a.size)[0]
        best = Best(k + 1)   # the anchor itself may be among them
        search([b for b in by_size.get(a.size, ()) if b.label == a.label], q, [best], {})
        yield from ((a.vec_id, int(i), int(s)) for s, i in zip(best.score, best.ids, strict=True) if i != a.vec_id)


def _negatives(index: pd.DataFrame, anchors: pd.DataFrame, k: int, low: int, high: int) -> Iterator[tuple]:
    by_size = _buckets(index)
    for a in anchors.itertuples():
        q = _unpack(a.q, 1, a.size)[0]
        pairs = [(p["positive_id"], p["positive_score"]) for p in a.positives]
        wanted = [Best(k, -(-low * s // 100), high * s // 100) for _, s in pairs]
        live = [w for w in wanted if w.low <= w.high]
        if live:
            search([b for b in by_size.get(a.size, ()) if b.label != a.label], q, live, {})
        for (i, s), w in zip(pairs, wanted, strict=True):
            yield from ((a.vec_id, i, s, int(n), int(score)) for score, n in zip(w.score, w.ids, strict=True))


@stored
def hard_negatives(df: DataFrame, anchors: str = "vec_id % 100 = 0", label: str | None = None, positives: int = POSITIVES,
                   negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE,
                   id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    A score is the integer product of two rows' components, each floor(scale * x); higher scores come first,
    ties by smaller id.  The positives of an anchor (the condition ``anchors`` on ``vec_id``) are its first other
    rows of its label; for each of them the first rows of other labels with
    ``low`` % <= negative score / positive score <= ``high`` % are returned.  ``label`` is an expression (default: the column).

    Rows without id, label or vector, or with a null or non-finite component, take no part; of rows that
    repeat an id the one with the smallest label and components does.  Vectors of different lengths
    do not meet.  A pair without negatives, an anchor without positives, gives no row; an empty
    table an empty result.  Components whose squares leave 64 bits raise.  Other columns are ignored.
    """
    spark = df.sparkSession
    rows = cut(integer_vectors(df, scale, id_col, vector_col, label), "negatives_rows")
    kind = F.when(F.col("length2") > 0, F.floor(4 * F.log2(F.col("length2").cast("double")))).otherwise(-1).cast("int")
    rows = rows.withColumn("class", kind)
    bucket = ["size", "label", "class"]
    sizes = cut(rows.groupBy(*bucket).agg(F.count(F.lit(1)).alias("n")), "negatives_sizes")
    pieces = F.ceil(F.col("n") / BUCKET).cast("long")
    dealt = rows.join(sizes, bucket).withColumn("piece", F.pmod(F.xxhash64("vec_id"), pieces))
    index = cut(dealt.select("vec_id", "q", "length2", *bucket, "piece").groupBy(*bucket, "piece")
                     .applyInPandas(_bucket, _INDEX), "negatives_index")

    total = sizes.agg(F.sum("n")).first()[0] or 0
    shelves = max(1, min(shuffle_partitions(spark), -(-total // SHELF_LEAST)), -(-total // SHELF_MOST))
    asked = rows.where(anchors)
    groups = max(1, -(-asked.count() // ANCHORS))
    # buckets of one kind stand together, so that the first ones found spare the others
    shelf = F.pmod(F.xxhash64(*bucket, F.floor(F.col("piece") / 8)), F.lit(shelves)).cast("int")
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    stock = index.withColumn("shelf", shelf).withColumn("lot", numbers(groups)).groupBy("shelf", "lot")
    packed = asked.select("vec_id", "label", "size", F.col("q").alias("_q")).mapInPandas(
        lambda it: (b.assign(q=[_pack(np.asarray(x)) for x in b["_q"]]).drop(columns="_q") for b in it),
        "vec_id long, label long, size int, q binary")
    packed = cut(packed, "negatives_anchors").withColumn("lot", F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int"))

    def meet(these: DataFrame, task, schema: str) -> DataFrame:
        names = [x.split()[0] for x in schema.split(", ")]
        return stock.cogroup(these.withColumn("shelf", numbers(shelves)).groupBy("shelf", "lot")).applyInPandas(
            lambda left, right: pd.DataFrame(list(task(left, right)) if len(left) else [], columns=names), schema)

    first = lambda n, *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.col(f"{n}_score").desc(), f"{n}_id"))
    found = meet(packed, lambda i, a: _positives(i, a, positives), "anchor_id long, positive_id long, positive_score long")
    found = found.withColumn("at", first("positive", "anchor_id")).where(F.col("at") <= positives)
    found = cut(found.groupBy(F.col("anchor_id").alias("vec_id")).agg(
        F.collect_list(F.struct("positive_id", "positive_score")).alias("positives")), "negatives_positives")
    mined = meet(packed.join(found, "vec_id"), lambda i, a: _negatives(i, a, negatives, low, high),
                 "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    return (mined.withColumn("rank", first("negative", "anchor_id", "positive_id").cast("int")).where(F.col("rank") <= negatives)
                 .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
