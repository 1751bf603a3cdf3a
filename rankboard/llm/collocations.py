"""Phrase collocations, counted in counting quotient filters (``quotient``).

1. Texts are cut into pieces and words, and written once as chunks of about ``chunk`` words: the chunk's
   own vocabulary with its counts, and the words as numbers into it.  A chunk is what a task holds.
2. The chunks' vocabularies are summed in ranges of the words' hashes.  Only words that occur ``least`` times get
   an id: a phrase is never more frequent than one of its words.  The ids travel back to the chunks that hold the words.
3. Phrases grow by a word at a time.  A phrase of k + 1 words is packed as the ids of its first k and of
   its last k words, which are both known to be frequent; every chunk counts its packed phrases in a
   quotient filter and sends the filter's ranges, in bytes, to the ranges' tasks.  There the sorted
   filters are merged; the frequent keys get ids, and each chunk is told which of its keys they are.
   The inverse permutation gives the two ids of a phrase back, so nothing is hashed away.
4. The frequent phrases are joined with their first and last parts, level by level: every cut of a phrase
   has the counts of both sides.  A phrase that a longer one explains is seen by the phrases of one word
   more (what holds for a longer phrase holds for those between).

What a task holds is a chunk, or a range of about a million keys or words; words and keys travel packed, a row for
each chunk and range.  No table of words or phrases is
broadcast or sent to the driver; hot words and phrases count once a chunk.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, shuffle_partitions, small, stored
from .quotient import Filter, Permutation

LONGEST, LEAST, BEST, EXPLAINED = 5, 100, 2000, 100
#: Words of a chunk, and keys of a range.
CHUNK, RANGE = 1_000_000, 1_000_000
UNKNOWN = "und"
#: A-Z become a-z, a tab becomes a space, and what ends a piece becomes a newline.
_TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + b"\n" * 9)
_RANGES = "part int, shard long, n long, held binary"


class _Numbers(dict):
    """Words of one language and their numbers in the chunk; 0 is the end of a piece."""

    def __init__(self, words: list, lang: str):
        super().__init__({b"\n": 0})
        self.words, self.lang = words, lang

    def __missing__(self, word: bytes) -> int:
        self.words.append((self.lang, word))
        self[word] = number = len(self.words)
        return number


def _chunks(batches: Iterator[pa.RecordBatch], chunk: int) -> Iterator[pa.RecordBatch]:
    words: list[tuple[str, bytes]] = []
    numbers: dict[str, _Numbers] = {}
    held, made, task = [], 0, TaskContext.get().partitionId()
    size = 0

    def close() -> pa.RecordBatch:
        sequence = np.concatenate(held)
        counts = np.bincount(sequence, minlength=len(words) + 1)[1:]
        vocabulary = pa.StructArray.from_arrays(
            [pa.array([x[0] for x in words], pa.string()), pa.array([x[1] for x in words], pa.binary()),
             pa.array(counts, pa.int64())], names=["lang", "word", "c"])
        return pa.RecordBatch.from_arrays(
            [pa.array([task << 32 | made], pa.int64()), pa.array([len(sequence)], pa.int64()),
             pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), vocabulary),
             pa.array([zlib.compress(sequence.astype("<u4").tobytes(), 1)], pa.binary())],
            names=["shard", "n", "words", "sequence"])

    for b in small(batches):
        for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            table = numbers.get(lang)
            if table is None:
                table = numbers[lang] = _Numbers(words, lang)
            found = filter(None, text.as_py().translate(_TABLE).replace(b"\n", b" \n ").split(b" "))
            sequence = np.fromiter(map(table.__getitem__, found), np.uint32)
            if sequence.any():
                held += [sequence, np.zeros(1, np.uint32)]
                size += len(sequence)
            if size >= chunk:
                yield close()
                words, numbers, held, size, made = [], {}, [], 0, made + 1
    if size:
        yield close()


def _state(shard: int, at: np.ndarray, ids: np.ndarray) -> dict | None:
    """Where in a chunk which frequent phrase starts; those without a neighbour cannot grow and go."""
    near = np.diff(at) == 1
    keep = np.concatenate([[False], near]) | np.concatenate([near, [False]]) if len(at) else np.zeros(0, bool)
    at, ids = at[keep], ids[keep]
    if not len(at):
        return None
    gaps = np.diff(at, prepend=0).astype("<u4")
    return {"shard": shard, "n": len(at), "at": zlib.compress(gaps.tobytes(), 1),
            "ids": zlib.compress(ids.astype("<u8").tobytes(), 1)}


_STATE = "shard long, n long, at binary, ids binary"


def _states(rows) -> Iterator[pa.RecordBatch]:
    for row in rows:
        if row is not None:
            yield pa.RecordBatch.from_pylist([row], pa.schema(
                [("shard", pa.int64()), ("n", pa.int64()), ("at", pa.binary()), ("ids", pa.binary())]))


_WORDS = "part int, lang string, shard long, n long, words binary, counts binary, numbers binary"


def _vocabularies(batches, part_bits: int) -> Iterator[pa.RecordBatch]:
    """Each chunk's words of a language and of a range of hashes, one after the other (no word holds a newline)."""
    for b in batches:
        for shard, words in zip(b.column("shard").to_pylist(), b.column("words"), strict=True):
            lang, word, c = words.values.flatten()
            lang, c = lang.dictionary_encode(), c.to_numpy()
            word = np.array(word.to_pylist(), object)
            part = np.array([xxhash.xxh32_intdigest(w) for w in word], np.int64) >> (32 - part_bits)
            code = lang.indices.to_numpy()
            order = np.lexsort((code, part))
            key = part[order] << 32 | code[order]
            ends = np.flatnonzero(np.diff(key)) + 1
            rows = [(int(part[at[0]]), lang.dictionary[int(code[at[0]])].as_py(), shard, len(at), b"\n".join(word[at]),
                     c[at].astype("<i8").tobytes(), (at + 1).astype("<u4").tobytes()) for at in np.split(order, ends)]
            cols = list(zip(*rows, strict=True))
            types = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, types, strict=True)],
                                             names=[x.split()[0] for x in _WORDS.split(", ")])


def _words_merger(least: int):
    """A range of all vocabularies: each language's total (``counts``) and frequent words (``shard`` null), and for each chunk
    which of its words these are.  ``n`` is the number of places taken in the range so far."""
    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        out, places, part = [], 0, int(pdf["part"].iloc[0])
        for lang, rows in pdf.groupby("lang", sort=False):
            word = np.array([w for held in rows["words"] for w in held.split(b"\n")], object)
            code, names = pd.factorize(word)
            counts = np.zeros(len(names), np.int64)
            np.add.at(counts, code, np.frombuffer(b"".join(rows["counts"]), "<i8"))
            often = counts >= least
            place = np.where(often, places + np.cumsum(often) - 1, -1)
            total = np.array([counts.sum(), places], "<i8").tobytes()
            places += int(often.sum())
            out.append((part, lang, None, places, b"\n".join(names[often]), total + counts[often].astype("<i8").tobytes(), None))
            mine, at = place[code], 0
            for shard, n, numbers in zip(rows["shard"], rows["n"], rows["numbers"], strict=True):
                live = np.flatnonzero(mine[at:at + n] >= 0)
                if len(live):
                    out.append((part, lang, shard, len(live), None, mine[at + live].astype("<u4").tobytes(),
                                np.frombuffer(numbers, "<u4")[live].tobytes()))
                at += n
        return pd.DataFrame(out, columns=[x.split()[0] for x in _WORDS.split(", ")]).astype({"shard": "Int64"})
    return merge


def _frequent_words(batches, place_bits: int) -> Iterator[pa.RecordBatch]:
    """``id, lang, word, a, n``: the frequent words, and for every language and range a row without id with its total."""
    names = ["id", "lang", "word", "a", "n"]
    types = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.int64()]
    for b in batches:
        for part, lang, words, counts in zip(*(b.column(c).to_pylist() for c in ("part", "lang", "words", "counts")), strict=True):
            total, first, *counts = np.frombuffer(counts, "<i8").tolist()
            ids = [None, *(part << place_bits | first + i for i in range(len(counts)))]
            cols = [ids, [lang] * len(ids), [None, *(words.split(b"\n") if counts else ())], [None, *counts], [total, *[None] * len(counts)]]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, types, strict=True)], names=names)


def _first(batches, place_bits: int) -> Iterator[pa.RecordBatch]:
    """Chunks with the ids of their frequent words."""
    def rows():
        for b in batches:
            for shard, sequence, found in zip(*(b.column(c).to_pylist() for c in ("shard", "sequence", "found")), strict=True):
                sequence = np.frombuffer(zlib.decompress(sequence), "<u4")
                table = np.zeros(int(sequence.max()) + 1, np.uint64)
                for reply in found:
                    place = np.frombuffer(reply["counts"], "<u4").astype(np.uint64)
                    table[np.frombuffer(reply["numbers"], "<u4")] = (
                        (np.uint64(reply["part"]) << np.uint64(place_bits)) | place) + np.uint64(1)
                got = table[sequence]
                at = np.flatnonzero(got)
                yield _state(shard, at, got[at] - np.uint64(1))
    yield from _states(rows())


def _grown(at: bytes, ids: bytes, id_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and permuted keys of the phrases of one word more: neighbours' ids packed together."""
    at = np.cumsum(np.frombuffer(zlib.decompress(at), "<u4").astype(np.int64))
    ids = np.frombuffer(zlib.decompress(ids), "<u8")
    near = np.flatnonzero(np.diff(at) == 1)
    packed = (ids[near] << np.uint64(id_bits)) | ids[near + 1]
    return at[near], Permutation(2 * id_bits).forward(packed)


def _requests(batches, id_bits: int, part_bits: int) -> Iterator[pa.RecordBatch]:
    """Each chunk's quotient filter, in ranges."""
    for b in batches:
        for shard, at, ids in zip(*(b.column(c).to_pylist() for c in ("shard", "at", "ids")), strict=True):
            _, keys = _grown(at, ids, id_bits)
            counted = Filter.count(2 * id_bits, keys)
            cuts = [(part, len(f), f.to_bytes()) for part, _, f in counted.cut(part_bits)]
            if cuts:
                parts, sizes, held = zip(*cuts, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(parts, pa.int32()), pa.array([shard] * len(parts), pa.int64()), pa.array(sizes, pa.int64()),
                     pa.array(held, pa.binary())], names=["part", "shard", "n", "held"])


def _merger(least: int, reply: bool):
    return lambda pdf: _merged(pdf, least, reply)


def _merged(pdf: pd.DataFrame, least: int, reply: bool) -> pd.DataFrame:
    """A range of all chunks: the frequent keys (``shard`` null), and for each chunk which of its keys these are."""
    filters = [Filter.from_bytes(x) for x in pdf["held"]]
    every = Filter.merge(filters)
    often = every.counts >= np.uint64(least)
    frequent = Filter(every.bits, every.keys[often], every.counts[often])
    part = int(pdf["part"].iloc[0])
    out = [(part, None, len(frequent), frequent.to_bytes())] if len(frequent) else []
    for shard, f in zip(pdf["shard"], filters, strict=True) if out and reply else ():
        place = np.minimum(np.searchsorted(frequent.keys, f.keys), len(frequent) - 1)
        mine = np.flatnonzero(frequent.keys[place] == f.keys)
        if len(mine):
            out.append((part, shard, len(mine), mine.astype("<u4").tobytes() + place[mine].astype("<u4").tobytes()))
    return pd.DataFrame(out, columns=["part", "shard", "n", "held"]).astype({"shard": "Int64"})


def _next(batches, id_bits: int, part_bits: int, place_bits: int) -> Iterator[pa.RecordBatch]:
    """Chunks with the ids of their frequent phrases of one word more."""
    def rows():
        for b in batches:
            for shard, at, ids, found in zip(*(b.column(c).to_pylist() for c in ("shard", "at", "ids", "found")), strict=True):
                starts, keys = _grown(at, ids, id_bits)
                counted, back = np.unique(keys, return_inverse=True)
                first = {part: lo for part, lo, _ in Filter(2 * id_bits, counted, counted).cut(part_bits)}
                new = np.zeros(len(counted), np.uint64)
                for reply in found:
                    mine, place = np.frombuffer(reply["held"], "<u4").reshape(2, -1).astype(np.uint64)
                    new[mine.astype(np.int64) + first[reply["part"]]] = (
                        (np.uint64(reply["part"]) << np.uint64(place_bits)) | place) + np.uint64(1)
                got = new[back]
                live = np.flatnonzero(got)
                yield _state(shard, starts[live], got[live] - np.uint64(1))
    yield from _states(rows())


def _unpacked(batches, key_bits: int, part_bits: int, place_bits: int) -> Iterator[pa.RecordBatch]:
    """``id, pre, suf, a`` of frequent phrases: the permutation undone, the key taken apart."""
    half = np.uint64(key_bits // 2)
    for b in batches:
        for part, held in zip(b.column("part").to_pylist(), b.column("held").to_pylist(), strict=True):
            f = Filter.from_bytes(held)
            packed = Permutation(key_bits).backward(f.keys | np.uint64(part << (key_bits - part_bits) if part_bits else 0))
            ids = (np.uint64(part) << np.uint64(place_bits)) | np.arange(len(f), dtype=np.uint64)
            cols = [ids, packed >> half, packed & np.uint64(2 ** int(half) - 1), f.counts]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], names=["id", "pre", "suf", "a"])


def _bits(largest: int | None) -> int:
    return max(1, int(largest or 0).bit_length())


@stored
def collocations(df: DataFrame, longest: int = LONGEST, least: int = LEAST, best: int = BEST, explained: int = EXPLAINED,
                 chunk: int = CHUNK, keys: int = RANGE, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Each language's first ``best`` phrases: ``lang, rank, phrase, a, l, r, n, score``.

    A-Z are lower-cased, texts are split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and those into words
    ``[^\\x20\\x09]+``.  Candidates are phrases of 2 to ``longest`` words that occur ``least`` times (``a``;
    overlaps count).  Cut after k words, a candidate has ``floor(1000 * a * n / (l * r))``, l and r being the
    counts of its parts and n all words of the language; the lowest cut counts, of equal ones the smallest
    k.  A candidate inside a longer one with at least ``explained`` percent of its count goes.  Order:
    score, a (both descending), phrase (bytes of UTF-8).  All numbers are exact.

    Null text is empty, a null language is ``und``, and rows that repeat count again.  Other columns are
    ignored; a table without words gives an empty result.  A text longer than a chunk is one chunk.
    More frequent phrases of one length than 2 ** 32, about, have no 64-bit key and raise.
    """
    spark = df.sparkSession
    docs = df.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"),
                     F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    chunks = cut(docs.mapInArrow(lambda it: _chunks(it, chunk),
                                 "shard long, n long, words array<struct<lang: string, word: binary, c: long>>, sequence binary"),
                 "colloc_chunks")
    part_bits = (max(shuffle_partitions(spark), (chunks.agg(F.sum(F.size("words"))).first()[0] or 0) // keys) - 1).bit_length()
    part_bits = min(part_bits, 31)
    merged = cut(chunks.select("shard", "words").mapInArrow(lambda it, p=part_bits: _vocabularies(it, p), _WORDS)
                       .groupBy("part").applyInPandas(_words_merger(least), _WORDS), "colloc_words")
    summed = merged.where("shard IS NULL")
    place_bits = _bits(summed.agg(F.max("n") - 1).first()[0])
    numbered = cut(summed.select("part", "lang", "words", "counts").mapInArrow(
        lambda it, b=place_bits: _frequent_words(it, b), "id long, lang string, word binary, a long, n long"), "colloc_numbered")
    totals = cut(numbered.where("id IS NULL").groupBy("lang").agg(F.sum("n").alias("n")), "colloc_totals")
    known = numbered.where("id IS NOT NULL").select(
        "id", "lang", F.array(F.col("word").cast("string")).alias("words"), "a",
        F.array().cast("array<long>").alias("heads"), F.array().cast("array<long>").alias("tails"))
    replies = merged.where("shard IS NOT NULL").groupBy("shard").agg(
        F.collect_list(F.struct("part", "counts", "numbers")).alias("found"))
    state = cut(chunks.select("shard", "sequence").join(replies, "shard").mapInArrow(
        lambda it, b=place_bits: _first(it, b), _STATE), "colloc_state")
    id_bits = part_bits + place_bits

    levels: list[DataFrame] = []
    for length in range(2, longest + 1):
        places = state.agg(F.sum("n")).first()[0]
        if not places:
            break
        key_bits = 2 * id_bits
        if key_bits > 64:
            raise OverflowError(f"the frequent phrases of {length - 1} words need ids of {id_bits} bits: raise least")
        part_bits = min(key_bits, (max(shuffle_partitions(spark), places // keys) - 1).bit_length())
        last = length == longest
        ranges = state.mapInArrow(lambda it, i=id_bits, p=part_bits: _requests(it, i, p), _RANGES)
        merged = cut(ranges.groupBy("part").applyInPandas(_merger(least, not last), _RANGES), "colloc_ranges")
        frequent = merged.where("shard IS NULL")
        place_bits = _bits(frequent.agg(F.max("n") - 1).first()[0])
        level = frequent.select("part", "held").mapInArrow(
            lambda it, k=key_bits, p=part_bits, b=place_bits: _unpacked(it, k, p, b), "id long, pre long, suf long, a long")
        side = lambda c: known.select(F.col("id").alias(c), *(F.col(x).alias(f"{c}_{x}") for x in known.columns if x != "id"))
        known = cut(level.join(side("pre"), "pre").join(side("suf"), "suf").select(
            "id", F.col("pre_lang").alias("lang"), "a", "pre", "suf",
            F.concat("pre_words", F.slice("suf_words", -1, 1)).alias("words"),
            F.concat("pre_heads", F.array("pre_a")).alias("heads"),      # counts of the first 1, 2, ... words
            F.concat("suf_tails", F.array("suf_a")).alias("tails")), "colloc_level")   # of the last 1, 2, ... words
        levels.append(known)
        if not last:
            replies = merged.where("shard IS NOT NULL").groupBy("shard").agg(
                F.collect_list(F.struct("part", "held")).alias("found"))
            state = cut(state.join(replies, "shard").mapInArrow(
                lambda it, i=id_bits, p=part_bits, b=place_bits: _next(it, i, p, b), _STATE), "colloc_state")
            id_bits = part_bits + place_bits

    out = None
    for level, longer in zip(levels, [*levels[1:], None][:len(levels)], strict=True):
        rest = level
        if longer is not None:
            inside = (longer.select(F.col("pre").alias("id"), "a").unionByName(longer.select(F.col("suf").alias("id"), "a"))
                            .groupBy("id").agg(F.max("a").alias("_longer")))
            rest = level.join(cut(inside, "colloc_inside"), "id", "left").where(
                F.col("_longer").isNull() | (100 * F.col("_longer") < explained * F.col("a")))
        rest = rest.select("lang", "words", "a", "heads", "tails")
        out = rest if out is None else out.unionByName(rest)
    if out is None:
        return spark.createDataFrame([], "lang string, rank long, phrase string, a long, l long, r long, n long, score long")
    return _ranked(out, totals, best)


def _ranked(candidates: DataFrame, totals: DataFrame, best: int) -> DataFrame:
    scored = candidates.join(totals, "lang")
    scored = scored.withColumn("_c", F.expr("""
        array_min(transform(sequence(1, size(words) - 1), k -> named_struct(
            'score', (1000BD * cast(a AS decimal(19, 0)) * cast(n AS decimal(15, 0)))
                     div (cast(heads[k - 1] AS decimal(19, 0)) * cast(tails[size(words) - k - 1] AS decimal(19, 0))),
            'k', k, 'l', heads[k - 1], 'r', tails[size(words) - k - 1])))"""))
    rows = scored.select("lang", F.array_join("words", " ").alias("phrase"), "a", F.col("_c.l").alias("l"),
                         F.col("_c.r").alias("r"), "n", F.col("_c.score").cast("long").alias("score"))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    # the first of every lot, then the first of these: no task sorts all phrases of a language
    lots = rows.withColumn("_lot", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    first = lots.withColumn("_at", F.row_number().over(Window.partitionBy("lang", "_lot").orderBy(*order))).where(
        F.col("_at") <= best)
    return (first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
                 .where(F.col("rank") <= best).select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))
