"""Exact, substring, line and near-duplicate operators against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankboard.llm import components, exact_dedup, line_dedup, near_dedup, suffix_dedup

from .odd import empty, odd, rows, words


class Union:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


# -- exact ---------------------------------------------------------------------------------

@pytest.mark.parametrize("counters", [2, 2000])
def test_exact_dedup_against_brute_force(spark, counters):
    got = exact_dedup.exact_dedup(odd(spark), counters=counters).collect()
    groups = defaultdict(list)
    for r in rows():
        groups[hashlib.sha256((r[1] or "").encode()).hexdigest()].append(r[0])
    assert len(got) == len(rows())
    for r in got:
        ids = groups[r.text_sha256]
        assert r.group_size == len(ids)
        assert r.keep_id == max((i for i in ids if i is not None), default=None)
        if r.kept:
            assert r.doc_id == r.keep_id
    assert Counter(r.text_sha256 for r in got if r.kept) == Counter(groups.keys())
    assert exact_dedup.exact_dedup(empty(spark)).count() == 0


def test_misra_gries_misses_no_heavy_key(spark):
    rng = random.Random(1)
    keys = ["hot"] * 400 + ["warm"] * 120 + [f"k{rng.randint(0, 300)}" for _ in range(680)]
    rng.shuffle(keys)
    df = spark.createDataFrame([(k,) for k in keys], "d string").repartition(5)
    count = Counter(keys)
    for k in (3, 10, 50):
        est = {r["d"]: r["est"] for r in exact_dedup.misra_gries(df, "d", k).collect()}
        assert all(e <= count[d] for d, e in est.items())
        assert all(count[d] - est.get(d, 0) <= len(keys) / (k + 1) for d in count)
        heavy = {r["d"]: r["n"] for r in exact_dedup.heavy_hitters(df, "d", k).collect()}
        assert heavy == {d: n for d, n in count.items() if n >= 2 * len(keys) / (k + 1) and n >= 2}


# -- substrings --------------------------------------------------------------------------------

def brute_repeats(docs, length):
    """(doc_id, text) -> removed flags; a string counts if it starts in a document with a smaller id."""
    first = {}
    for d, t in docs:
        if d is not None:
            b = (t or "").encode()
            for j in range(len(b) - length + 1):
                w = b[j:j + length]
                first[w] = min(first.get(w, d), d)
    out = {}
    for d, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for j in range(len(b) - length + 1):
            if d is not None and first[b[j:j + length]] < d:
                gone[j:j + length] = b"\1" * length
        left = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for j, g in enumerate(gone) if g and not (j and gone[j - 1]))
        out[d, t] = (len(b), sum(gone), spans, hashlib.sha256(left).hexdigest(), left)
    return out


@pytest.mark.parametrize("length,seed,batches,block", [(50, 20, 4, 900), (12, 5, 5, 400), (50, 20, 1, 10**7)])
def test_remove_repeats_against_brute_force(spark, length, seed, batches, block):
    df = odd(spark)
    want = Counter((k[0], *v[:4]) for k, v in ((r[:2], brute_repeats([x[:2] for x in rows()], length)[r[:2]]) for r in rows()))
    got = suffix_dedup.remove_repeats(df, length=length, seed=seed, batches=batches, block_bytes=block, with_text=True)
    got = got.collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want
    assert all(hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 for r in got)


def test_remove_repeats_of_empty_tables(spark):
    assert suffix_dedup.remove_repeats(empty(spark)).count() == 0
    nothing = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert {tuple(r)[:4] for r in suffix_dedup.remove_repeats(nothing).collect()} == {(1, 0, 0, 0), (2, 0, 0, 0)}


def test_index_levels_merge_geometrically():
    sizes, levels = [], {}
    for _ in range(11):   # as remove_repeats does
        level = 0
        while level in levels:
            del levels[level]
            level += 1
        levels[level] = 2 ** level
        sizes.append(sum(levels.values()))
    assert sizes == list(range(1, 12)) and len(levels) == bin(11).count("1")


# -- components ------------------------------------------------------------------------------

def test_components_against_union_find(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(60)]
    edges += [(200 + i, 201 + i) for i in range(40)] + [(500, 501 + i) for i in range(50)] + [(7, 7)]
    u = Union()
    for a, b in edges:
        if a != b:
            u.join(a, b)
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {n: u.find(n) for e in edges if e[0] != e[1] for n in e}
    assert components.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


# -- lines -----------------------------------------------------------------------------------

def shingles(line):
    if len(line) > 24 * (len(re.findall(r"\s+", line)) + 1):
        return frozenset(line[i:i + 8] for i in range(len(line) - 7))
    return frozenset(line[m.start():m.start() + 8] for m in re.finditer(r"(?<!\S)\S", line))


def brute_lines(docs):
    where = defaultdict(set)
    for d, t in docs:
        for j, line in enumerate((t or "").split("\n")):
            line = line.strip(" ").lower()
            if len(line) >= 30:
                where[line].add((2**63 - 1 if d is None else d, j, d, t))
    lines, u = list(where), Union()
    sets = [shingles(x) for x in lines]
    for a in range(len(lines)):
        u.find(a)
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                u.join(a, b)
    groups = defaultdict(set)
    for a, line in enumerate(lines):
        groups[u.find(a)] |= where[line]
    gone = defaultdict(set)
    for g in groups.values():
        first = min(x[:2] for x in g)
        for x in g:
            if x[:2] != first:
                gone[x[2:]].add(x[1])
    return gone


def line_docs():
    rng = random.Random(6)
    lines = [words(rng, rng.randint(8, 40)) for _ in range(60)]
    docs = []
    for i in range(50):
        own = [rng.choice(lines) if rng.random() < 0.5 else words(rng, rng.randint(1, 30)) for _ in range(rng.randint(1, 6))]
        for j, x in enumerate(own):
            w = x.split()
            if len(w) > 25 and rng.random() < 0.5:
                w[rng.randrange(len(w))] = "edited"
                own[j] = " ".join(w)
        docs.append((i, "\n".join(own)))
    return docs


def test_line_report_against_brute_force(spark):
    for docs, df in ((line_docs(), spark.createDataFrame(line_docs(), "doc_id long, text string").repartition(3)),
                     ([r[:2] for r in rows()], odd(spark))):
        gone = brute_lines(docs)
        want = Counter((d, len((t or "").split("\n")), tuple(sorted(gone[d, t]))) for d, t in docs)
        got = line_dedup.line_report(df)
        assert Counter((r.doc_id, r.n_lines, tuple(r.removed)) for r in got.collect()) == want
        assert not re.search("Python|Pandas|Arrow", got._jdf.queryExecution().toString())


def test_drop_repeated_lines(spark):
    line = "one line that is quite long enough to be compared with others in this corpus"
    df = spark.createDataFrame([(1, f"{line}\nfirst", 9), (2, f"\n{line}!\nsecond\n", 9), (3, None, 0)], "doc_id long, text string, kept int")
    got = {r.doc_id: (r.text, r.kept) for r in line_dedup.drop_repeated_lines(df).collect()}
    assert got == {1: (f"{line}\nfirst", 9), 2: ("\nsecond\n", 9), 3: (None, 0)}
    assert line_dedup.line_report(empty(spark)).count() == 0


# -- near duplicates --------------------------------------------------------------------------

def weighted(text, n=5):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return Counter(tuple(w[i:i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else Counter([tuple(w)] if w else [])


def brute_classes(docs, similarity=0.8):
    sets, u = {d: weighted(t) for d, t in docs}, Union()
    for a in sets:
        u.find(a)
        for b in sets:
            if b < a and sets[a] and sets[b]:
                both = sum((sets[a] & sets[b]).values())
                if both >= similarity * (sum(sets[a].values()) + sum(sets[b].values()) - both):
                    u.join(a, b)
    return {d: u.find(d) for d in sets}


def test_near_classes_against_brute_force(spark):
    rng = random.Random(8)
    base = [words(rng, 80).split() for _ in range(20)]
    docs = []
    for i in range(90):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 1, 1, 2, 8])):
            w[rng.randrange(len(w))] = f"e{i}"
        docs.append((i, " ".join(w)))
    got = near_dedup.near_classes(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()
    want = brute_classes(docs)
    assert {r.doc_id: r.class_id for r in got} == want
    assert {r.class_id: r.class_size for r in got} == Counter(want.values())
    assert all(r.kept == (r.doc_id == r.class_id) for r in got)


def test_near_classes_of_odd_rows(spark):
    got = near_dedup.near_classes(odd(spark)).collect()
    want = brute_classes([r[:2] for r in rows() if r[0] is not None])
    assert len(got) == len(rows())
    assert {(r.doc_id, r.class_id) for r in got} == {*want.items(), (None, None)} | {
        (r.doc_id, r.class_id) for r in got if r.doc_id is None}
    assert near_dedup.near_classes(empty(spark)).count() == 0


def test_dart_minhash_estimates_weighted_jaccard():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 5, 400), rng.integers(0, 5, 400)
    b[:300] = a[:300]
    unit = lambda c: np.concatenate([near_dedup._mix(np.uint64(i * 1000 + 7) + np.arange(n, dtype=np.uint64)) for i, n in enumerate(c)])
    x, y = unit(a), unit(b)
    sig = near_dedup.dart_minhash(np.concatenate([x, y]), np.repeat([0, 1], [len(x), len(y)]), 2, 4000)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert (sig != 0).all() and abs((sig[0] == sig[1]).mean() - want) < 0.03


def test_near_dedup_hot_group_is_one_class(spark):
    text = words(random.Random(1), 60).split()
    docs = [(i, " ".join([*text[:i % 60], f"e{i}", *text[i % 60 + 1:]])) for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = near_dedup.near_classes(df).agg(F.count_distinct("class_id")).first()[0]
    assert got == len(set(brute_classes(docs).values()))
