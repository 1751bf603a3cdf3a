"""Candidate pairs of similar sets by prefixes, without loss.

Put the elements of all sets in one order, rarest first.  Two sets of Jaccard similarity of at least
``t`` share an element among the first n - ceil(t n) + 1 of each (n: the set's size).  A set whose
rare elements are its own thus meets nothing, however many sets its frequent ones are in.  What
follows their first common element bounds how many they share, so a pair that first agrees too late is left out.

Each set also has ``_WORDS`` words of parities: an element turns one bit over, so two sets differ in as many elements
at least as in bits.  A pair that differs in too many bits is left out before it is made.

An element's holders travel as lists (in ``_PARTS`` parts), so what is joined to its frequency is not a row a holder.
Where the sets have many elements, these go by in ``_SLICES`` slices of their values, one after the other: what is
shuffled for a slice is deleted before the next, so the disk holds a share of it at a time.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop, stored

_PARTS, _WORDS = 64, 16
#: Slices of more than ``_FEW`` elements.
_SLICES, _FEW = 4, 1_000_000


@stored
def prefix_pairs(sets: DataFrame, similarity: float, label: str) -> DataFrame:
    """``(a, b)``, a < b: nodes of different components whose sets may reach ``similarity``.

    ``sets`` has one row per ``node``: its component ``c`` and ``elements``, an array without repeats.  Every pair of
    different components that reaches ``similarity`` is among the result; empty sets are in no pair."""
    held = cut(sets.select("node", "c", F.size("elements").alias("n"), "elements"), f"{label}_elements")
    slices = _SLICES if (held.agg(F.sum("n")).first()[0] or 0) > _FEW else 1
    word, bit = F.shiftrightunsigned("e", 6).bitwiseAND(F.lit(_WORDS - 1)), F.expr("shiftleft(1L, cast(e & 63 as int))")
    bits = [F.bit_xor(F.when(word == i, bit).otherwise(F.lit(0).cast("long"))).alias(f"w{i}") for i in range(_WORDS)]
    about = cut(held.select("node", "c", "n", F.explode("elements").alias("e")).groupBy("node", "c", "n").agg(*bits), f"{label}_parities")
    of = lambda j: lambda e: F.pmod(e, F.lit(slices)) == j
    orders = []
    for j in range(slices):
        some = held.select("node", F.explode(F.filter("elements", of(j)) if slices > 1 else "elements").alias("e"))
        holders = cut(some.groupBy("e", F.pmod("node", F.lit(_PARTS)).alias("part")).agg(F.collect_list("node").alias("nodes")),
                      f"{label}_holders")
        several = cut(holders.groupBy("e").agg(F.sum(F.size("nodes")).alias("f")).where("f > 1"), f"{label}_frequencies")
        shared = cut(holders.join(several, "e"), f"{label}_shared")
        drop(holders, several)
        # one row per set again: no more than the set itself
        orders.append(cut(shared.repartition("e", "part").select("f", "e", F.explode("nodes").alias("node")).groupBy("node")
                                .agg(F.collect_list(F.struct("f", "e")).alias("o")), f"{label}_ordered"))
        drop(shared)
    drop(held)
    ordered = reduce(DataFrame.unionByName, orders).groupBy("node").agg(F.sort_array(F.flatten(F.collect_list("o"))).alias("o"))
    words = F.array(*[f"w{i}" for i in range(_WORDS)]).alias("w")
    length = F.col("n") - F.ceil(F.col("n") * F.lit(similarity) - F.lit(1e-9)) + 1
    alone = F.col("n") - F.size("o")   # elements that no other set holds come first
    some = F.slice("o", F.lit(1), F.greatest(length - alone, F.lit(0)).cast("int"))
    firsts = cut(ordered.join(about, "node").select("node", "c", "n", words, alone.alias("alone"), F.posexplode(some).alias("at", "x"))
                        .select("node", "c", F.col("x.e").alias("e"), "n", "w", (F.col("alone") + F.col("at")).alias("at")),
                 f"{label}_prefixes")
    drop(*orders)
    pairs = []
    for j in range(slices):
        some = firsts.where(of(j)(F.col("e")))
        between = cut(some.groupBy("e").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("e"),
                      f"{label}_between")
        met = cut(some.join(between, "e"), f"{label}_met")
        pairs.append(cut(_met_pairs(met, similarity), f"{label}_slice_pairs") if slices > 1 else _met_pairs(met, similarity))
        if slices > 1:
            drop(between, met)
    return reduce(DataFrame.unionByName, pairs).distinct()


def _met_pairs(met: DataFrame, similarity: float) -> DataFrame:
    """The pairs of sets that share one of their first elements and may be similar by sizes, places and parities."""
    x, y = (met.select("e", F.col("node").alias(k), F.col("c").alias(f"c{k}"), F.col("n").alias(f"n{k}"),
                       F.col("w").alias(f"w{k}"), (F.col("n") - F.col("at")).alias(f"left{k}")) for k in "ab")
    sized = F.least("na", "nb") >= F.greatest("na", "nb") * F.lit(similarity) - F.lit(1e-9)
    # at the first common element all others still lie ahead; similar sets share t / (1 + t) of both sizes
    enough = F.least("lefta", "leftb") >= (F.col("na") + F.col("nb")) * F.lit(similarity / (1 + similarity)) - F.lit(1e-9)
    differ = sum((F.bit_count(F.col("wa")[i].bitwiseXOR(F.col("wb")[i])) for i in range(1, _WORDS)),
                 F.bit_count(F.col("wa")[0].bitwiseXOR(F.col("wb")[0])))
    near = differ <= (F.col("na") + F.col("nb")) * F.lit((1 - similarity) / (1 + similarity)) + F.lit(1e-9)
    return x.join(y, "e").where((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & sized & enough & near).select("a", "b").distinct()
