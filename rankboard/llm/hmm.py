"""Hidden Markov language model.

Tokens are the words of a text (A-Z lower-cased) and one end.  A word is emitted in
two steps: a latent state emits a word class, the class emits the word.  Every word
that training texts hold ``often`` times or more (of the ``lookup`` most frequent ones)
and the end are classes of one word, so the states' emissions grow with the counted
vocabulary; every other word belongs to one of ``rare`` classes by the hash of its last
two characters, and is drawn from it with probability (c + 0.5) / (n + 0.5 (v + 1)),
c, n and v being the training counts of the word, of the class's words, and of its
distinct words (one share is left for an unseen word).

The states are trained by Baum-Welch over all training texts: every task runs the scaled
forward and backward recursions and emits expected counts, which Spark sums per parameter.
A pass goes over the texts in ``slices`` (by a hash of the row), each stored in a folder of
its own, and re-estimates after every slice from counts that forget older slices step by
step, so the model moves many times in a pass; every text is read in every pass.  The
scaled forward recursion then gives the exact likelihood of each text.

Word counts are a distributed aggregate that stays in Spark.  Only words above the count
that a histogram of counts names travel to the tasks, at most ``lookup`` (a fixed bound);
the counts of the other words of each text come by a shuffled join.
"""

from __future__ import annotations

import pickle
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, id_text, small, stored

STATES, ITERATIONS, SLICES, OFTEN, RARE, LOOKUP = 6, 3, 8, 20, 64, 100_000
#: The share of a new slice's counts in the counts so far is (step + 1) to the power of minus this.
_FORGET = 0.6
#: Probability, at the start of training, of staying in a state: states then part by what texts and passages have in common.
_STAY = 0.9
#: Tokens that a task takes through the recursions at once (a longer text goes alone).
_CHUNK = 300_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def held_out(column: str = "doc_id"):
    """The fold that is never learned from."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % 5 == 1


def _rare_class(word: str, classes: int, rare: int) -> int:
    return classes + 1 + zlib.crc32(word[-2:].encode()) % rare


def word_counts(texts: DataFrame) -> DataFrame:
    """``(word, c)`` over the lower-cased column ``text``."""
    words = texts.select(F.explode(F.split("text", "[\\x20\\x09-\\x0D]+")).alias("word")).where("word != ''")
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("c"))


def frequent_words(counts: DataFrame, lookup: int) -> list[tuple[str, int]]:
    """The words of the highest counts, at most ``lookup``, by count and then word.

    A histogram over 16 ranges of counts per power of two names the lowest range that still fits; of the
    table only the words from there on leave Spark."""
    level = F.floor(F.log2("c") * 16)
    sizes = counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect()   # at most 16 * 63 rows
    least, held = None, 0
    for r in sorted(sizes, key=lambda r: -r["level"]):
        held += r["n"]
        if held > lookup:
            break
        least = r["level"]
    if least is None:
        return []
    return sorted(((r["word"], r["c"]) for r in counts.where(level >= least).collect()), key=lambda x: (-x[1], x[0]))


class Vocabulary:
    """What the tasks know of the words: bounded by ``lookup``."""

    def __init__(self, top: list[tuple[str, int]], texts: int, total: int, distinct: int, rare: list[tuple[int, int]],
                 classes: int):
        self.classes, self.texts = classes, texts
        self.n = total + texts
        self.v = distinct + (texts > 0)
        self.counts = np.array([c for _, c in top], np.int64)
        self.known = {w.encode(): i for i, (w, _) in enumerate(top)}
        self.base = np.log10(self.n + 0.5 * (self.v + 1))
        self.rare_log = np.array([np.log10(n + 0.5 * (v + 1)) for n, v in rare])
        self.end = classes
        self.kind = np.array([i if i < classes else _rare_class(w, classes, len(rare)) for i, (w, _) in enumerate(top)], np.int64)
        unigram = np.zeros(classes + 1 + len(rare))
        unigram[:min(classes, len(top))] = self.counts[:classes]
        unigram[self.end] = texts
        unigram[classes + 1:] = [n for n, _ in rare]
        self.unigram = (unigram + 0.5) / (unigram + 0.5).sum()
        #: Sequences hold classes in as few bytes as they need.
        self.width = "<u2" if len(unigram) < 2**16 else "<u4"

    def __getstate__(self):
        """Compressed: executors write a broadcast to their disks, perhaps once for every task."""
        return zlib.compress(pickle.dumps((self.__dict__ | {"known": None}, b" ".join(self.known))), 9)

    def __setstate__(self, packed: bytes):
        state, words = pickle.loads(zlib.decompress(packed))
        self.__dict__.update(state)
        self.known = {w: i for i, w in enumerate(words.split(b" "))} if words else {}


def _sequences(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary) -> Iterator[pa.RecordBatch]:
    """The classes of each text's tokens, its sums over the words that the vocabulary holds, and its other words."""
    find, classes, rare = vocabulary.known.get, vocabulary.classes, len(vocabulary.rare_log)
    # the last place is every word that is not held: it adds nothing to the sums
    kind = np.append(vocabulary.kind, 0)
    logs = np.append(np.log10(vocabulary.counts + 0.5), 0.0)
    end_log = np.log10(vocabulary.texts + 0.5)
    for b in small(batches):
        words = [t.as_py().lower().split() for t in b.column(3)]   # of bytes: only A-Z, and the white space of the contract
        sizes = np.array([len(w) for w in words], np.int64)
        doc = np.repeat(np.arange(len(words)), sizes)
        at = np.fromiter((i for w in words for i in map(find, w, repeat(-1))), np.int64, len(doc))
        cls = kind[at]
        other = np.flatnonzero(at < 0)
        loose = [Counter() for _ in words]
        first = np.cumsum(sizes) - sizes
        for i in other.tolist():
            d = doc[i]
            w = words[d][i - first[d]].decode()
            loose[d][w] += 1
            cls[i] = _rare_class(w, classes, rare)
        log, drawn = logs[at], cls > classes
        share = np.where(drawn, log - vocabulary.rare_log[np.where(drawn, cls - classes - 1, 0)], 0.0)
        total = lambda x: np.bincount(doc, x, len(words))
        known = sizes - np.bincount(doc[other], minlength=len(words)) + (vocabulary.texts > 0)
        seqs = [np.append(c, vocabulary.end).astype(vocabulary.width).tobytes() for c in np.split(cls, first[1:])] if words else []
        cols = [(seqs, pa.binary()), (sizes + 1, pa.int64()), (known, pa.int64()), (end_log + total(log), pa.float64()),
                (total(share), pa.float64()),
                ([[{"word": w, "n": n} for w, n in x.items()] for x in loose],
                 pa.list_(pa.struct([("word", pa.string()), ("n", pa.int64())])))]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *[pa.array(x, t) for x, t in cols]],
                                         names=["_row", "doc_id", "held_out", "seq", "n_tokens", "sure", "logs", "within",
                                                "loose"])


_SEQ = ("_row long, doc_id long, held_out boolean, seq binary, n_tokens long, sure long, logs double, within double, "
        "loose array<struct<word:string,n:long>>")


class Packed:
    """Sequences side by side, longest first: all tokens of time 0, then of time 1, and so on."""

    def __init__(self, seqs: list[np.ndarray]):
        lengths = np.array([len(s) for s in seqs])
        self.live = len(seqs) - np.searchsorted(lengths[::-1], np.arange(lengths[0]), "right")
        self.at = np.concatenate([[0], np.cumsum(self.live)])
        self.obs = np.empty(self.at[-1], np.int64)
        for i, s in enumerate(seqs):
            self.obs[self.at[:len(s)] + i] = s


def forward(p: Packed, pi: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scaled forward variables and the scale of every token (``b``: classes x states)."""
    alpha = b[p.obs]
    scale = np.empty(len(p.obs))
    for t, n in enumerate(p.live):
        now = alpha[p.at[t]:p.at[t] + n]
        now *= alpha[p.at[t - 1]:p.at[t - 1] + n] @ a if t else pi
        s = now.sum(1)
        now /= s[:, None]
        scale[p.at[t]:p.at[t] + n] = s
    return alpha, scale


def expected_counts(p: Packed, pi: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Baum-Welch: expected starts, transitions and emissions (classes x states)."""
    alpha, scale = forward(p, pi, a, b)
    emit = b[p.obs]
    beta = np.ones_like(alpha)
    ahead = np.zeros_like(alpha)
    for t in range(len(p.live) - 2, -1, -1):
        n, here, there = p.live[t + 1], p.at[t], p.at[t + 1]
        step = emit[there:there + n] * beta[there:there + n] / scale[there:there + n, None]
        ahead[here:here + n] = step
        beta[here:here + n] = step @ a.T
    gamma = alpha * beta
    out = np.stack([np.bincount(p.obs, gamma[:, s], len(b)) for s in range(len(a))], 1)
    return gamma[:p.live[0]].sum(0), a * (alpha.T @ ahead), out


def _packs(batches: Iterator[pa.RecordBatch], width: str) -> Iterator[tuple[list, Packed, int]]:
    """Row ids and packed sequences, those of like length together, and how many there are."""
    def flush(held):
        held.sort(key=lambda x: -len(x[1]))
        part, size = [], 0
        for x in held:
            if part and size + len(x[1]) > _CHUNK:
                yield [r for r, _ in part], Packed([s for _, s in part]), len(part)
                part, size = [], 0
            part.append(x)
            size += len(x[1])
        if part:
            yield [r for r, _ in part], Packed([s for _, s in part]), len(part)

    held, size = [], 0
    for b in batches:
        for row, seq in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            held.append((row, np.frombuffer(seq, width)))
            size += len(held[-1][1])
        if size > 8 * _CHUNK:
            yield from flush(held)
            held, size = [], 0
    yield from flush(held)


def _count_task(batches, width, pi, a, b) -> Iterator[pa.RecordBatch]:
    """Expected counts, a row for each class, one for the starts and one for each state's moves."""
    total = np.zeros((len(b) + 1 + len(a), len(a)))
    for _, p, _ in _packs(batches, width):
        starts, moves, out = expected_counts(p, pi, a, b)
        total += np.concatenate([out, starts[None], moves])
    at = np.flatnonzero(total.any(1))
    yield pa.RecordBatch.from_arrays([pa.array(at.astype("int32")), *[pa.array(x) for x in total[at].T]],
                                     names=["i", *[f"s{j}" for j in range(len(a))]])


def _score_task(batches, width, pi, a, b) -> Iterator[pa.RecordBatch]:
    for rows, p, n in _packs(batches, width):
        _, scale = forward(p, pi, a, b)
        logs = np.log10(scale)
        who = np.arange(len(p.obs)) - np.repeat(p.at[:-1], p.live)
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(np.bincount(who, logs, n))],
                                         names=["_row", "ll"])


def baum_welch(seqs: DataFrame, unigram: np.ndarray, width: str = "<u2", states: int = STATES, iterations: int = ITERATIONS,
               slices: int = SLICES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Train on the column ``seq`` in ``iterations`` passes, each over all slices of the column ``slice`` (0 to
    ``slices`` - 1); expected counts are summed by Spark, one row per class.

    A slice's counts stand for the whole (times ``slices``) and are mixed into the counts so far.  Emissions keep
    half a count spread by the class frequencies, so none is impossible."""
    rng = np.random.default_rng(11)
    pi = np.full(states, 1 / states)
    a = rng.random((states, states)) + 0.5
    a = _STAY * np.eye(states) + (1 - _STAY) * a / a.sum(1, keepdims=True)
    b = unigram[:, None] * (rng.exponential(1, (len(unigram), states)) + 0.02)
    b /= b.sum(0)
    names = [f"s{j}" for j in range(states)]
    so_far, step = np.zeros((len(b) + 1 + states, states)), 0
    for at in [at for _ in range(iterations) for at in range(slices)]:
        rows = seqs.where(F.col("slice") == at).select(F.lit(0).cast("long").alias("r"), "seq")
        got = (rows.mapInArrow(lambda it, m=(width, pi, a, b): _count_task(it, *m), ", ".join(["i int", *[f"{n} double" for n in names]]))
                   .groupBy("i").agg(*[F.sum(n).alias(n) for n in names]).toPandas())   # one row per class
        if got.empty:   # no text has this slice
            continue
        new = np.zeros_like(so_far)
        new[got["i"].to_numpy()] = got[names].to_numpy()
        step += 1
        so_far += (slices * new - so_far) * step ** -_FORGET
        n_b, n_pi, n_a = np.split(so_far, [len(b), len(b) + 1])
        pi = (n_pi[0] + 0.5) / (n_pi + 0.5).sum()
        a = n_a + 0.5
        a /= a.sum(1, keepdims=True)
        b = n_b + 0.5 * unigram[:, None]
        b /= b.sum(0)
    return pi, a, b


@stored
def score_texts(df: DataFrame, states: int = STATES, iterations: int = ITERATIONS, classes: int | None = None,
                rare: int = RARE, lookup: int = LOOKUP, often: int = OFTEN, slices: int = SLICES, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    Learns from the rows outside the held-out fold.  ``classes``, if given, is the most classes of one word.
    Null and empty texts hold only the end; with no row to learn from every count is 0; repeated rows count and
    are scored each; other columns are ignored; an empty table stays empty.
    """
    docs = id_text(df, id_col, text_col)
    docs = docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", held_out().alias("held_out"), "text")
    counts = cut(word_counts(docs.where("NOT held_out").select(F.translate("text", _UPPER, _LOWER).alias("text"))), "hmm_counts")
    texts = docs.where("NOT held_out").count()
    top = frequent_words(counts, lookup)
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    own = sum(c >= often for _, c in top) if classes is None else min(classes, len(top))
    frequent = df.sparkSession.createDataFrame([(w,) for w, _ in top[:own]], "word string")
    by_class = (counts.join(F.broadcast(frequent), "word", "left_anti")     # at most ``lookup`` rows
                      .groupBy((F.crc32(F.expr("right(word, 2)").cast("binary")) % rare).alias("k"))
                      .agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect())
    shares = {r["k"]: (r["n"], r["v"]) for r in by_class}
    vocabulary = Vocabulary(top, texts, total, distinct, [shares.get(k, (0, 0)) for k in range(rare)], own)
    sent, width = df.sparkSession.sparkContext.broadcast(vocabulary), vocabulary.width
    made = docs.select("_row", "doc_id", "held_out", F.col("text").cast("binary").alias("text")).mapInArrow(
        lambda it: _sequences(it, sent.value), _SEQ)
    # a slice is a folder; what is not learned from has one too
    part = F.when(F.col("held_out"), -1).otherwise(F.pmod(F.xxhash64("_row"), F.lit(slices)).cast("int"))
    seqs = cut(made.withColumn("slice", part), "hmm_sequences", by="slice")
    model = baum_welch(seqs, vocabulary.unigram, width, states, iterations, slices)
    ll = seqs.select("_row", "seq").mapInArrow(lambda it: _score_task(it, width, *model), "_row long, ll double")
    loose = seqs.select("_row", F.inline("loose"))
    c = F.coalesce("c", F.lit(0))
    rest = (loose.join(counts, "word", "left").groupBy("_row")
                 .agg(F.sum(F.col("n") * F.log10(c + F.lit(0.5))).alias("more"),
                      F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("known")))
    more = F.coalesce("more", F.lit(0.0))
    return (seqs.drop("seq", "loose", "slice").join(ll, "_row").join(rest, "_row", "left")
                .select("doc_id", "held_out", "n_tokens",
                        (F.col("sure") + F.coalesce("known", F.lit(0))).cast("long").alias("n_known"),
                        F.lit(vocabulary.n).cast("long").alias("train_tokens"),
                        (F.col("logs") + more - F.col("n_tokens") * F.lit(float(vocabulary.base))).alias("base_score"),
                        (F.col("ll") + F.col("within") + more).alias("score")))
