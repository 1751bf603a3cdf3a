"""Language ID and the hidden Markov model."""

import itertools
import math
import pickle
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from rankboard.llm import hmm, language

from .odd import empty, odd, rows

SF = "/root/testdata/sf0.001"


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in language.identify_languages(docs).collect()}
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    out = [d for d in truth if zlib.crc32(str(d).encode()) % 4 == 2]
    assert {d for d, r in got.items() if r.held_out} == set(out)
    assert np.mean([got[d].lang_pred == truth[d] for d in out]) > 0.9
    assert all(0 <= r.score <= 1 for r in got.values())


def test_texts_are_scored_in_little_memory(monkeypatch):
    """A batch of 8 MB takes little more than itself, and the scores do not depend on how much is scored at once."""
    rng = np.random.default_rng(1)
    texts = ["".join(map(chr, rng.integers(97, 123, int(k)))) for k in rng.integers(0, 4000, 4000)]
    model = {"langs": ["de", "en", "fr"], "families": ["germanic", "romance"], "pairs": [("de", "en")],
             "w": rng.normal(size=(3, language.BUCKETS + 1))}
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array([bool(t) for t in texts])], names=["_t", "_letter"])
    run = lambda: pa.Table.from_batches(list(language._predict(iter([batch]), model, language.BUCKETS)))
    tracemalloc.start()
    try:
        got, peak = run(), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 40e6
    monkeypatch.setattr(language, "_SCORED", 1 << 40)
    assert run().equals(got)


def test_language_of_odd_rows(spark):
    got = language.identify_languages(odd(spark))
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"] and got.count() == len(rows())
    by = {r.doc_id: r for r in got.collect()}
    for d, text, *_ in rows():
        letter = bool(text) and any(c.isalpha() for c in text)
        if d is not None:
            assert (by[d].lang_pred == "und") == (not letter) and by[d].held_out == (zlib.crc32(str(d).encode()) % 4 == 2)
    assert language.identify_languages(empty(spark)).count() == 0
    unlabelled = spark.createDataFrame([(1, "words here", None)], "doc_id long, text string, lang string")
    assert language.identify_languages(unlabelled).first().lang_pred == "und"
    one = spark.createDataFrame([(i, "only english", "en") for i in range(9)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in language.identify_languages(one).collect()} == {"en"}


def test_language_prediction_reads_only_the_text(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.train(docs.where(~language.held_out()))
    a = language.predict(docs, model, ["doc_id"])
    b = language.predict(docs.selectExpr("doc_id", "text", "'xx' AS lang", "'yy' AS source"), model, ["doc_id"])
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def tokens(text):
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return [*re.findall("[^\x20\x09-\x0D]+", (text or "").translate(table)), None]


def test_base_score_against_brute_force(spark):
    docs = [r[:2] for r in rows()]
    for lookup, classes in ((200_000, 2000), (20, 10)):   # all words looked up; most of them joined
        got = hmm.score_texts(odd(spark), lookup=lookup, classes=classes, iterations=1).collect()
        out = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1
        count = Counter(w for d, t in docs if not out(d) for w in tokens(t))
        n, v = sum(count.values()), len(count)
        want = Counter()
        for d, t in docs:
            w = tokens(t)
            score = sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
            want[d, out(d), len(w), sum(count[x] > 0 for x in w), n, round(score, 6)] += 1
        assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
        assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert hmm.score_texts(empty(spark)).count() == 0


def test_forward_equals_the_sum_over_paths():
    rng = np.random.default_rng(1)
    s, c = 3, 5
    pi, a, b = rng.random(s), rng.random((s, s)), rng.random((c, s))
    pi, a, b = pi / pi.sum(), a / a.sum(1, keepdims=True), b / b.sum(0)
    seqs = sorted([rng.integers(0, c, n).astype("<u2") for n in (6, 5, 5, 2, 1)], key=lambda x: -len(x))
    p = hmm.Packed(seqs)
    _, scale = hmm.forward(p, pi, a, b)
    who = np.arange(len(p.obs)) - np.repeat(p.at[:-1], p.live)
    got = np.exp(np.bincount(who, np.log(scale)))
    for x, q in zip(seqs, got, strict=True):
        want = sum(pi[z[0]] * b[x[0], z[0]] * math.prod(a[z[t - 1], z[t]] * b[x[t], z[t]] for t in range(1, len(x)))
                   for z in itertools.product(range(s), repeat=len(x)))
        assert abs(q - want) < 1e-12
    starts, moves, emits = hmm.expected_counts(p, pi, a, b)
    assert abs(starts.sum() - 5) < 1e-9 and abs(moves.sum() - 14) < 1e-9 and abs(emits.sum() - 19) < 1e-9


def test_baum_welch_learns_an_order(spark):
    """Words that alternate: the model beats the unigram base on held-out texts."""
    docs = [(i, " ".join(f"{'ab'[j % 2]}{(i * 7 + j) % 5}" for j in range(40))) for i in range(150)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = hmm.score_texts(df, states=3, iterations=15).where("held_out").collect()
    assert sum(r.score for r in got) > sum(r.base_score for r in got) + 5 * len(got)


def test_frequent_words_stop_at_the_lookup(spark):
    counts = [(f"w{i}", 1 + 1000 // (i + 1)) for i in range(300)]
    df = spark.createDataFrame(counts, "word string, c long").repartition(3)
    for lookup in (0, 1, 20, 120, 300):
        got = hmm.frequent_words(df, lookup)
        want = sorted(counts, key=lambda x: (-x[1], x[0]))
        assert got == want[:len(got)] and len(got) <= lookup
        assert lookup < 20 or len(got) > lookup // 3


def test_held_out_texts_score_well_above_the_base(spark):
    """Production parameters over whole tables: 0.15 a token or more over the unigram base."""
    got = hmm.score_texts(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").collect()
    assert sum(r.score - r.base_score for r in got) / sum(r.n_tokens for r in got) >= 0.15


def test_word_probabilities_sum_to_one():
    top = [("a", 9), ("b", 4), ("c", 3), ("d", 1)]
    v = hmm.Vocabulary(top, 6, 17, 4, [(3, 1), (1, 1)], 2)
    # a class of one word gives it all; rare classes share (c + 0.5) / (n + 0.5 (v + 1)) and leave one share
    for (n, k), log in zip([(3, 1), (1, 1)], v.rare_log, strict=True):
        assert abs(sum((c + 0.5) for c in [n]) / 10**log + 0.5 / 10**log - 1) < 1e-12 and k == 1
    assert abs(v.unigram.sum() - 1) < 1e-12
    again = pickle.loads(pickle.dumps(v))
    assert again.known == v.known and (again.counts == v.counts).all() and (again.unigram == v.unigram).all() and again.n == v.n
