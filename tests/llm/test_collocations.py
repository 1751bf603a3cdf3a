"""Counting quotient filters, and phrase collocations against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from rankboard.llm import collocations
from rankboard.llm.quotient import Filter, Permutation

from .odd import empty, odd, rows


@pytest.mark.parametrize("bits", [1, 2, 5, 8, 13, 34, 63, 64])
def test_filters_lose_nothing(bits):
    rng = np.random.default_rng(bits)
    keys = rng.integers(0, 2**bits - 1, size=700, dtype=np.uint64, endpoint=True)
    keys = np.concatenate([keys, np.repeat(keys[:2], 600)])
    permutation = Permutation(bits)
    permuted = permutation.forward(keys)
    assert (permutation.backward(permuted) == keys).all()
    f = Filter.count(bits, permuted)
    back = Filter.from_bytes(f.to_bytes())
    want = Counter(keys.tolist())
    assert dict(zip(permutation.backward(back.keys).tolist(), back.counts.tolist(), strict=True)) == want
    both = Filter.merge([f, back])
    assert dict(zip(permutation.backward(both.keys).tolist(), both.counts.tolist(), strict=True)) == {k: 2 * c for k, c in want.items()}
    for part_bits in {0, 1, min(7, bits), bits}:
        got = {}
        for part, at, piece in f.cut(part_bits):
            piece = Filter.from_bytes(piece.to_bytes())
            high = part << (bits - part_bits) if part_bits else 0
            got |= {int(k) | high: int(c) for k, c in zip(piece.keys, piece.counts, strict=True)}
            assert int(f.keys[at]) == int(piece.keys[0]) | high
        assert got == dict(zip(f.keys.tolist(), f.counts.tolist(), strict=True))


def test_a_filter_takes_few_bytes_a_key():
    keys = Permutation(34).forward(np.arange(400_000, dtype=np.uint64) * np.uint64(13))
    assert len(Filter.count(34, keys).to_bytes()) < 3.5 * 400_000


def brute(texts, longest, least, best, explained):
    n, f = Counter(), Counter()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for text, lang in texts:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(lower)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            f.update((lang, *words[i:i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    often = {p: c for p, c in f.items() if c >= least}
    hidden = set()
    for p, c in often.items():
        lang, words = p[0], p[1:]
        for k in range(2, len(words)):
            for i in range(len(words) - k + 1):
                if 100 * c >= explained * often[(lang, *words[i:i + k])]:
                    hidden.add((lang, *words[i:i + k]))
    out = []
    for p, a in often.items():
        lang, words = p[0], p[1:]
        if len(words) < 2 or p in hidden:
            continue
        cuts = [(1000 * a * n[lang] // (f[(lang, *words[:k])] * f[(lang, *words[k:])]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        out.append((lang, " ".join(words), a, f[(lang, *words[:k])], f[(lang, *words[k:])], n[lang], score))
    ranked = []
    for lang in {x[0] for x in out}:
        mine = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))[:best]
        ranked += [(lang, i + 1, *x[1:]) for i, x in enumerate(mine)]
    return sorted(ranked)


def _texts(seed, n=60):
    rng = random.Random(seed)
    names = ["New  York\tCity", "of the", "as well as", "Élan vital", "x x x x x x x"]
    out = []
    for _ in range(n):
        words = [rng.choice("a b c d e the of in on".split()) if rng.random() < 0.7 else rng.choice(names) for _ in range(rng.randint(0, 90))]
        out.append((" ".join(w + rng.choice(["", "", "", ".", ",", "\n", "!?"]) for w in words), rng.choice(["en", "fr", None, "und"])))
    return out


@pytest.mark.parametrize("longest,least,best,explained,chunk,keys", [
    (5, 3, 2000, 100, 1_000_000, 1_000_000), (5, 3, 7, 100, 50, 10), (3, 2, 2000, 60, 300, 100), (2, 5, 2000, 100, 100, 50)])
def test_collocations_against_brute_force(spark, longest, least, best, explained, chunk, keys):
    texts = _texts(longest + least)
    df = spark.createDataFrame(texts, "text string, lang string").repartition(4)
    got = collocations.collocations(df, longest, least, best, explained, chunk, keys)
    assert sorted(tuple(r) for r in got.collect()) == brute(texts, longest, least, best, explained)


def test_odd_rows(spark):
    texts = [(r[1], r[2]) for r in rows()]
    got = collocations.collocations(odd(spark), least=2)
    assert sorted(tuple(r) for r in got.collect()) == brute(texts, 5, 2, 2000, 100)
    none = collocations.collocations(empty(spark), least=2)
    assert none.collect() == [] and none.schema == got.schema
    blank = spark.createDataFrame([(" ..\n", "en"), (None, None)], "text string, lang string")
    assert collocations.collocations(blank, least=1).collect() == []
    single = spark.createDataFrame([("one", "en")] * 3, "text string, lang string")
    assert collocations.collocations(single, least=1).collect() == []


def test_products_may_pass_64_bits(spark):
    totals = spark.createDataFrame([("en", 10**14)], "lang string, n long")
    known = spark.createDataFrame([("en", ["a", "b"], 3 * 10**13 + 1, [4 * 10**13], [5 * 10**13 + 7])],
                                  "lang string, words array<string>, a long, heads array<long>, tails array<long>")
    row = collocations._ranked(known, totals, 10).first()
    assert row["score"] == 1000 * (3 * 10**13 + 1) * 10**14 // (4 * 10**13 * (5 * 10**13 + 7))
