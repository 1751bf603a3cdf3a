"""Pairs by prefixes lose no similar pair of different components."""

import os
import random
from collections import Counter
from urllib.parse import urlparse

from pyspark.sql import functions as F

from rankboard.llm import prefixes
from rankboard.llm.prefixes import prefix_pairs


def test_every_similar_pair_of_different_components_is_met(spark):
    rng = random.Random(6)
    sets = []
    for family in range(12):   # sets that share a core and differ in a few elements of their own or of others
        core = rng.sample(range(400), rng.choice([4, 5, 10, 15, 40]))
        for _ in range(8):
            s = set(core) - set(rng.sample(core, rng.randint(0, len(core) // 5)))
            s |= {rng.choice([rng.randrange(400), rng.randrange(10**6)]) for _ in range(rng.randint(0, 2))}
            sets.append((len(sets), rng.choice([family, 100 + len(sets)]), sorted(s)))
    sets += [(500, 500, []), (501, 501, [])]
    df = spark.createDataFrame(sets, "node long, c long, elements array<long>").repartition(4)
    like = lambda a, b: bool(a | b) and len(a & b) >= 0.8 * len(a | b)
    want = {(a, b) for a, ca, x in sets for b, cb, y in sets if a < b and ca != cb and like(set(x), set(y))}
    pairs = [tuple(r) for r in prefix_pairs(df, 0.8, "test").collect()]
    comp = {n: c for n, c, _ in sets}
    assert want and want <= set(pairs) and len(pairs) == len(set(pairs))
    assert all(a < b and comp[a] != comp[b] for a, b in pairs)


def test_common_elements_alone_make_no_pair(spark):
    """Many sets that share most of their elements, each with rare ones of its own, are never paired."""
    sets = [(i, i, [*range(70), *range(1000 * i + 1000, 1000 * i + 1030)]) for i in range(60)]
    df = spark.createDataFrame(sets, "node long, c long, elements array<long>")
    assert prefix_pairs(df, 0.8, "test").isEmpty()
    assert prefix_pairs(df.limit(0), 0.8, "test").isEmpty()


def test_sets_that_differ_in_many_elements_make_no_pair(spark):
    """Sets of one family that share rare elements with many others, none of them similar."""
    rng = random.Random(9)
    sets = [(i, i, [*range(70), *rng.sample(range(1000, 1600), 30)]) for i in range(80)]
    df = spark.createDataFrame(sets, "node long, c long, elements array<long>").withColumn(
        "elements", F.transform("elements", lambda x: F.xxhash64(x)))
    assert prefix_pairs(df, 0.8, "test").isEmpty()


def test_an_element_of_many_sets_is_joined_in_few_rows(spark, monkeypatch):
    """What is joined to an element's frequency grows with the different elements, not with their holders."""
    sets = [(i, i, [*range(20), 1000 + i]) for i in range(1500)]
    df = spark.createDataFrame(sets, "node long, c long, elements array<long>").repartition(4)
    rows, real = {}, prefixes.cut

    def cut(df, label, by=None):
        out = real(df, label, by)
        rows[label] = out.count()
        return out

    monkeypatch.setattr(prefixes, "cut", cut)
    prefix_pairs(df, 0.8, "test").count()
    assert rows["test_shared"] <= 20 * prefixes._PARTS


def test_slices_give_the_same_pairs_and_go_one_by_one(spark, monkeypatch):
    """Elements in slices give the pairs that all at once give; what a slice writes is deleted before the next."""
    rng, sets = random.Random(7), []
    for family in range(10):
        core = rng.sample(range(400), 30)
        for _ in range(6):
            s = set(core) - set(rng.sample(core, rng.randint(0, 4))) | {rng.randrange(10**6)}
            sets.append((len(sets), family if rng.random() < 0.3 else 100 + len(sets), sorted(s)))
    df = spark.createDataFrame(sets, "node long, c long, elements array<long>").repartition(4)
    whole = sorted(tuple(r) for r in prefix_pairs(df, 0.8, "test").collect())
    made, most, real = [], Counter(), prefixes.cut

    def cut(df, label, by=None):
        out = real(df, label, by)
        made.append((label, urlparse(out.inputFiles()[0]).path))
        held = Counter(x for x, path in made if os.path.exists(path))
        most.update({x: n - most[x] for x, n in held.items() if n > most[x]})
        return out

    monkeypatch.setattr(prefixes, "cut", cut)
    monkeypatch.setattr(prefixes, "_FEW", 100)
    assert whole and sorted(tuple(r) for r in prefix_pairs(df, 0.8, "test").collect()) == whole
    assert Counter(x for x, _ in made)["test_holders"] == prefixes._SLICES
    assert most["test_holders"] == most["test_shared"] == most["test_met"] == 1
    assert not any(os.path.exists(path) for _, path in made)
