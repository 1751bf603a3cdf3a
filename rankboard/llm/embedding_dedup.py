"""Near-duplicate embeddings by random-hyperplane sign hashing in several tables.

Equal vectors are one node with a weight from the start.  A table has ``bits`` random hyperplanes, and a
vector's bucket is the signs of its products with them: two vectors at an angle t agree in a plane with
probability 1 - t / pi.  The number of bits follows the number of different vectors (a bucket of unlike
vectors stays at about ``BUCKET_OF``), and the number of tables follows the bits, so that a pair at the
threshold shares a bucket with probability ``recall``, at every size.

All pairs of a bucket are verified by their exact cosine.  A bucket of many vectors is dealt into blocks by
hash, and every two blocks meet in a group of their own, so a task holds two blocks at most.  A group sends on
one row a vector: how many links it found (a pair counts in its first common table only) and the
vector that stands for what it is linked to.  So what leaves a group grows with its rows, not with its
pairs; distributed connected components join the groups.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, stored
from .components import connected_components

COSINE, RECALL, BLOCK, SEED = 0.95, 0.999, 1024, 20
#: Unlike vectors that may share a bucket, about.
BUCKET_OF = 32
_KEY = ["size", "table", "code", "low", "high"]


def tables_for(vectors: int, cosine: float, recall: float) -> tuple[int, int]:
    """``(bits, tables)`` for so many different vectors."""
    bits = min(28, max(8, math.ceil(math.log2(max(vectors, 1) / BUCKET_OF))))
    same = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - same))


def usable(vector: str):
    """Whether a vector can have a cosine: no null or non-finite component, and not all zero."""
    x = F.col(vector)
    finite = F.coalesce(F.forall(x, lambda v: F.abs(v.cast("double")) < float("inf")), F.lit(False))
    return finite & F.coalesce(F.exists(x, lambda v: v != 0), F.lit(False))


def _keys(batches) -> Iterator[pa.RecordBatch]:
    """Vectors as bytes with their 128-bit hash."""
    for b in batches:
        size = np.diff(b.column("v").offsets.to_numpy())
        flat = b.column("v").flatten().to_numpy(zero_copy_only=False)
        held = [x.tobytes() for x in np.split(flat, np.cumsum(size)[:-1])] if len(size) else []
        yield pa.RecordBatch.from_arrays(
            [b.column("vec_id"), pa.array([xxhash.xxh3_128_hexdigest(x) for x in held], pa.string()), pa.array(size, pa.int32()),
             pa.array(held, pa.binary())], names=["vec_id", "node", "size", "v"])


def _matrix(held: list[bytes], kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(held), kind).reshape(len(held), -1).astype(np.float64)


def _signed(batches, kind: str, bits: int, tables: int, seed: int) -> Iterator[pa.RecordBatch]:
    """The codes of every table."""
    planes: dict[int, np.ndarray] = {}
    weight = 1 << np.arange(bits)
    for b in batches:
        size, held = b.column("size").to_numpy(), b.column("v").to_pylist()
        codes = np.zeros((b.num_rows, tables), np.int32)
        for d in np.unique(size):
            if d not in planes:
                planes[d] = np.random.default_rng([seed, int(d)]).standard_normal((int(d), tables * bits))
            mine = np.flatnonzero(size == d)
            sign = _matrix([held[i] for i in mine], kind) @ planes[d] >= 0
            codes[mine] = sign.reshape(len(mine), tables, bits) @ weight
        offsets = pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * tables)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(offsets, pa.array(codes.reshape(-1)))],
                                         names=[*b.schema.names, "codes"])


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest row that each of ``n`` rows is linked to, by any number of links."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _group(g: dict, kind: str, cosine: float) -> pa.RecordBatch | None:
    """A bucket, or two blocks of one: links verified, a row for each linked vector."""
    v = _matrix(g["v"].to_pylist(), kind)
    v /= np.sqrt((v * v).sum(1))[:, None]
    side = g["side"].to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(side == 0)
    if g["low"][0].as_py() == g["high"][0].as_py():
        a, b = np.nonzero(np.triu(v @ v.T >= cosine, 1))
    else:
        other = np.flatnonzero(side == 1)
        a, b = np.nonzero(v[rows] @ v[other].T >= cosine)
        a, b = rows[a], other[b]
    t = g["table"][0].as_py()
    codes = g["codes"].flatten().to_numpy().reshape(len(v), -1)[:, :t]
    fresh = np.ones(len(a), bool)
    for j in range(t):
        fresh &= codes[a, j] != codes[b, j]
    a, b = a[fresh], b[fresh]
    if not len(a):
        return None
    w = g["w"].to_numpy()
    links = (np.bincount(a, w[b], len(v)) + np.bincount(b, w[a], len(v))).astype(np.int64)
    root = _roots(len(v), a, b)
    linked = np.flatnonzero(links)
    return pa.RecordBatch.from_arrays([g["node"].take(pa.array(linked)), pa.array(links[linked]), g["node"].take(pa.array(root[linked]))],
                                      names=["node", "links", "root"])


def _verified(batches, kind: str, cosine: float) -> Iterator[pa.RecordBatch]:
    """Groups, one after the other, of rows sorted by group; a task holds one group and a batch."""
    def close(parts: list) -> pa.RecordBatch | None:
        whole = pa.Table.from_batches(parts).combine_chunks()
        return _group({c: whole.column(c).chunk(0) for c in whole.column_names}, kind, cosine) if whole.num_rows > 1 else None

    held, key = [], None
    for b in batches:
        keys = np.stack([b.column(c).to_numpy() for c in _KEY], 1)
        ends = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
        for lo, hi in zip([0, *ends], [*ends, b.num_rows], strict=True):
            if hi == lo:
                continue
            if held and tuple(keys[lo]) != key:
                if (out := close(held)) is not None:
                    yield out
                held = []
            key = tuple(keys[lo])
            held.append(b.slice(lo, hi - lo))
    if held and (out := close(held)) is not None:
        yield out


@stored
def near_vectors(df: DataFrame, cosine: float = COSINE, recall: float = RECALL, block: int = BLOCK, seed: int = SEED,
                 id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector: ``vec_id, n_links, component_id, kept``.

    ``n_links`` counts the other rows with a cosine (in double precision) of at least ``cosine`` that were
    found; ``component_id`` is the smallest id reachable by links, itself included, and the row with that
    id is kept.  Pairs at the threshold are found with probability ``recall``, closer ones more surely; no
    pair below it is linked.

    Vectors that are null, zero or hold null or non-finite components link with nothing, and vectors of
    different lengths do not link.  Rows that repeat an id each count and link; a null id is no
    ``component_id`` (null if its component has no other id; then the row is kept).  Equal vectors are told by a 128-bit
    hash.  Other columns are ignored; an empty table stays empty.  The links of m different vectors that are all alike are
    m * m / 2 products, computed in blocks; none is left out.
    """
    spark = df.sparkSession
    element = df.schema[vector_col].dataType.elementType.simpleString()
    kind, element = ("<f4", "float") if element == "float" else ("<f8", "double")
    all_rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(f"array<{element}>").alias("v"))
    fit = usable("v")
    rows = cut(all_rows.where(fit).mapInArrow(_keys, "vec_id long, node string, size int, v binary"), "vectors_keys")
    copies = cut(rows.groupBy("node").agg(F.count(F.lit(1)).alias("w"), F.min("vec_id").alias("least"),
                                          F.first("size").alias("size"), F.first("v").alias("v")), "vectors_copies")
    bits, tables = tables_for(copies.count(), cosine, recall)
    signed = cut(copies.select("node", "w", "size", "v").mapInArrow(
        lambda it: _signed(it, kind, bits, tables, seed), "node string, w long, size int, v binary, codes array<int>"), "vectors_signed")

    codes = signed.select("node", "size", F.posexplode("codes").alias("table", "code"))
    bucket = ["size", "table", "code"]
    shared = cut(codes.groupBy(*bucket).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "vectors_shared")
    members = (signed.select("node", "w", "size", "v", "codes", F.posexplode("codes").alias("table", "code")).join(shared, bucket)
                     .withColumn("blocks", F.ceil(F.col("n") / block).cast("long"))
                     .withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks"))))
    dealt = members.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select(
        *bucket, F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"),
        (F.col("mine") > F.col("other")).cast("int").alias("side"), "node", "w", "v", "codes")
    groups = dealt.repartition(*_KEY).sortWithinPartitions(*_KEY)
    found = cut(groups.mapInArrow(lambda it: _verified(it, kind, cosine), "node string, links long, root string"), "vectors_found")

    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    components = connected_components(found.where("node != root"), "node", "root").withColumnRenamed("component", "root")
    whole = cut(copies.select("node", "w", "least").join(links, "node", "left").join(components, "node", "left")
                      .withColumn("root", F.coalesce("root", "node")), "vectors_nodes")
    least = cut(whole.groupBy("root").agg(F.min("least").alias("component_id")), "vectors_components")
    info = cut(whole.join(least, "root").select(
        "node", (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links"), "component_id"), "vectors_info")
    linked = rows.select("vec_id", "node").join(info, "node").select("vec_id", "n_links", "component_id")
    alone = all_rows.where(~fit).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    kept = F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull())
    return linked.unionByName(alone).withColumn("kept", kept)
