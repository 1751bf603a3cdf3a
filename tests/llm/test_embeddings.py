"""Hard negatives and near-duplicate embeddings against brute force."""

import math

import numpy as np
import pytest

from rankboard.llm import embedding_dedup, hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, node string, n string, w string, piece string, rank string"
EXTRA = ("x", "y", "z", "p", "r")


def _rows(seed=3, n=400, size=8):
    """Clusters of several widths, exact copies, other lengths, and every odd case."""
    rng = np.random.default_rng(seed)
    vectors = rng.standard_normal((n, size))
    vectors[:60] = vectors[0] + 0.05 * rng.standard_normal((60, size))      # all alike
    vectors[60:90] = vectors[60] + 0.4 * rng.standard_normal((30, size))    # around the threshold
    vectors[90:110] = vectors[90]                                           # copies
    vectors[110:140] *= rng.uniform(0.01, 40, (30, 1))
    out = [(i, [float(np.float32(x)) for x in v], int(rng.integers(0, 4)), *EXTRA) for i, v in enumerate(vectors)]
    odd = [None, [], [0.0] * size, [1.0, None] * (size // 2), [float("nan")] * size, [float("inf")] + [0.0] * (size - 1), [1.0] * 3, [1.0] * 3]
    out += [(n + i, v, 1, *EXTRA) for i, v in enumerate(odd)]
    out += [(n + 20, out[0][1], None, *EXTRA), (None, out[1][1], 2, *EXTRA), (None, out[200][1], 2, *EXTRA), out[5], out[6], out[220]]
    return out


def _finite(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def links_of(rows, cosine):
    fit = [i for i, r in enumerate(rows) if _finite(r[1]) and any(r[1])]
    near = {i: set() for i in range(len(rows))}
    for a in fit:
        for b in fit:
            if a != b and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1]), np.array(rows[b][1])
                if x @ y / math.sqrt((x @ x) * (y @ y)) >= cosine:
                    near[a].add(b)
    return near


def expected(rows, cosine):
    near, out = links_of(rows, cosine), []
    for i, r in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            new = near[todo.pop()] - seen
            seen |= new
            todo += new
        component = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((r[0], len(near[i]), component, component is None or r[0] == component))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [1024, 7])
def test_near_vectors_against_brute_force(spark, block):
    rows = _rows()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = embedding_dedup.near_vectors(df, recall=0.9999999, block=block)
    assert sorted((tuple(r) for r in got.collect()), key=str) == expected(rows, 0.95)


def test_recall_at_the_threshold(spark):
    rng = np.random.default_rng(8)
    base = rng.standard_normal((600, 32))
    base /= np.linalg.norm(base, axis=1)[:, None]
    side = rng.standard_normal((600, 32))
    side -= (side * base).sum(1)[:, None] * base
    side /= np.linalg.norm(side, axis=1)[:, None]
    close = 0.951 * base + math.sqrt(1 - 0.951**2) * side
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([base, close]))]
    got = embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert sum(r["n_links"] for r in got.collect()) >= 2 * 0.99 * 600


def test_tables_follow_the_recall():
    for vectors in (1, 10**4, 10**6, 10**9):
        bits, tables = embedding_dedup.tables_for(vectors, 0.95, 0.999)
        same = (1 - math.acos(0.95) / math.pi) ** bits
        assert 1 - (1 - same) ** tables >= 0.999


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert embedding_dedup.near_vectors(none).collect() == []
    assert hard_negatives.hard_negatives(none).collect() == []
    odd = spark.createDataFrame([(1, None, 1, *EXTRA), (2, [], None, *EXTRA)], SCHEMA)
    assert sorted(map(tuple, embedding_dedup.near_vectors(odd).collect())) == [(1, 0, 1, True), (2, 0, 2, True)]
    assert hard_negatives.hard_negatives(odd).collect() == []


def mined(rows, every, scale=256):
    one = {}
    for r in rows:
        if r[0] is not None and r[2] is not None and _finite(r[1]):
            q = [math.floor(scale * x) for x in r[1]]
            one[r[0]] = min(one.get(r[0], (r[2], q)), (r[2], q))
    out = []
    for anchor, (label, q) in one.items():
        if anchor % every:
            continue
        score = {i: sum(a * b for a, b in zip(q, p, strict=True)) for i, (_, p) in one.items() if i != anchor and len(p) == len(q)}
        order = sorted(score, key=lambda i: (-score[i], i))
        for positive in [i for i in order if one[i][0] == label][:5]:
            s = score[positive]
            fit = [i for i in order if one[i][0] != label and 30 * s <= 100 * score[i] <= 90 * s][:10]
            out += [(anchor, positive, k + 1, i, s, score[i]) for k, i in enumerate(fit)]
    return sorted(out)


@pytest.mark.parametrize("sizes", [None, (16, 64, 5)])
def test_hard_negatives_against_brute_force(spark, sizes, monkeypatch):
    if sizes:
        monkeypatch.setattr(hard_negatives, "BUCKET", sizes[0])
        monkeypatch.setattr(hard_negatives, "SHELF_MOST", sizes[1])
        monkeypatch.setattr(hard_negatives, "ANCHORS", sizes[2])
    rows = _rows(5)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = hard_negatives.hard_negatives(df, anchors="vec_id % 10 = 0")
    assert sorted(tuple(r) for r in got.collect()) == mined(rows, 10)


def test_products_beyond_double_precision(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.integers(-2**29, 2**29, 3)], int(i % 2)) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = hard_negatives.hard_negatives(df, anchors="vec_id % 7 = 0", scale=1)
    assert sorted(tuple(r) for r in got.collect()) == mined(rows, 7, 1)


def test_pruning_spares_rows_and_loses_none():
    import pandas as pd
    rng = np.random.default_rng(4)
    v = rng.standard_normal((500, 6))
    q = np.floor(256 * v / np.linalg.norm(v, axis=1)[:, None]).astype(np.int64)   # about one length, as in a bucket
    q[:40] = q[0] + rng.integers(-9, 9, (40, 6))
    rows = pd.DataFrame({"vec_id": np.arange(500), "q": list(q), "length2": (q * q).sum(1), "size": 6, "label": 1, "class": 1, "piece": 0})
    bucket = hard_negatives.Bucket(next(hard_negatives._bucket(rows).itertuples()))
    want = sorted(range(500), key=lambda i: (-(q @ q[0])[i], i))[:10]
    stats, best = {}, hard_negatives.Best(10, low=int(q[want[9]] @ q[0]))
    hard_negatives.search([bucket], q[0], [best], stats)
    assert best.ids.tolist() == want and stats["pruned"] > 400
    for need in (-10**6, 0, 10**4, int(q[0] @ q[0]) - 5000):
        rows_ = bucket.candidates(q[0], float(np.sqrt(q[0] @ q[0])), need, {})
        found = set() if rows_ is None else set(np.arange(500)[rows_].tolist())
        assert {int(i) for i in np.flatnonzero(q @ q[0] >= need)} <= found
