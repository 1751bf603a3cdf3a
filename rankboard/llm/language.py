"""Language identification by hierarchical discrimination.

Texts become hashed byte n-gram frequencies (2 to 4 bytes of the lower-cased
text, everything but letters folded into one blank).  A first layer of linear
support vector machines (one against the rest) names the language family; within
the family, one-versus-one support vector machines vote among the languages
learned there.  Because the classifiers are linear in n-gram frequencies, a text is
scored by summing one weight per byte position, whatever its length.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small

# Families of common language codes; any other code is a family of its own.
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no", "is", "af", "lb", "yi"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca", "gl", "oc"],
    "slavic": ["ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl", "mk", "bs"],
    "uralic": ["fi", "et", "hu"],
    "turkic": ["tr", "az", "kk", "uz", "ky", "tt"],
    "indic": ["hi", "bn", "ur", "mr", "ne", "pa", "gu", "si"],
    "semitic": ["ar", "he", "mt", "am"],
    "sinitic": ["zh", "yue"],
}

#: Buckets of the n-gram hash, and the labelled texts that classifiers are fitted on, per language ...
BUCKETS = 1 << 12
SAMPLE_PER_LANGUAGE = 600
#: ... and of all languages together (a row is 4 x BUCKETS bytes on the driver).
SAMPLE = 2400
_ORDERS = (2, 3, 4)
#: Bytes of text taken from a batch at once, and those of them that are scored at once (each takes some 60 bytes meanwhile).
_CHUNK, _SCORED = 4_000_000, 250_000

_FOLD = np.arange(256, dtype=np.uint64)
_FOLD[:128] = 32
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def family_of(lang: str) -> str:
    return next((f for f, langs in FAMILIES.items() if lang in langs), lang)


def _chunks(b: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, slice]]:
    """The bytes of a string array, some millions at a time: bytes, starts, rows."""
    b = b.cast(pa.large_binary())
    offsets = np.frombuffer(b.buffers()[1], np.int64, len(b) + 1, 8 * b.offset)
    data = np.frombuffer(b.buffers()[2], np.uint8) if b.buffers()[2] else np.zeros(0, np.uint8)
    at = 0
    while at < len(b):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + _CHUNK, "right")) - 1)
        yield data[offsets[at]:offsets[to]], offsets[at:to + 1] - offsets[at], slice(at, to)
        at = to


def _grams(data: np.ndarray, buckets: int) -> list[np.ndarray]:
    """The bucket of the n-gram that starts at each byte, one array per order."""
    x = np.append(_FOLD[data], np.full(max(_ORDERS), 32, np.uint64))
    shift = np.uint64(64 - buckets.bit_length() + 1)
    out, code = [], x[:len(data)].copy()
    for n in range(2, max(_ORDERS) + 1):
        code = (code << np.uint64(8)) | x[n - 1:n - 1 + len(data)]
        if n in _ORDERS:
            out.append((((code + np.uint64(n << 40)) * _MIX) >> shift).astype(np.int32))
    return out


def _features(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    for b in small(batches, 200):
        vectors = []
        for data, starts, _ in _chunks(b.column(1)):
            grams = _grams(data, buckets)
            for s, e in zip(starts[:-1], starts[1:], strict=True):
                v = sum(np.bincount(g[s:e], minlength=buckets) for g in grams).astype("<f4")
                vectors.append((v / max(1, v.sum())).tobytes())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(vectors, pa.binary())], names=["lang", "x"])


def _svm(x: np.ndarray, y: np.ndarray, epochs: int = 12, c: float = 10.0) -> np.ndarray:
    """Weights of an L2-regularised linear support vector machine (squared hinge loss) by dual
    coordinate descent; ``y`` is +1 or -1."""
    w, alpha = np.zeros(x.shape[1]), np.zeros(len(x))
    diag = np.einsum("ij,ij->i", x, x) + 0.5 / c
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        for i in rng.permutation(len(x)):
            new = max(0.0, alpha[i] - (y[i] * (x[i] @ w) - 1 + 0.5 / c * alpha[i]) / diag[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return w


def train(labelled: DataFrame, buckets: int = BUCKETS, per_language: int = SAMPLE_PER_LANGUAGE) -> dict:
    """Fit on ``lang, text, doc_id``: about ``per_language`` rows of each language (fewer if there are more
    than ``SAMPLE / per_language`` languages), those with the smallest hash of the id.  Returns a picklable model; with no labelled row it knows no language."""
    rows = labelled.where("lang IS NOT NULL AND text IS NOT NULL").select(
        "lang", "text", F.xxhash64("doc_id").alias("_h"))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row per language
    per_language = min(per_language, max(2, SAMPLE // max(1, len(counts))))
    total = 1 << 64
    keep = F.lit(False)
    for lang, n in counts.items():  # a hash threshold that keeps about per_language rows
        top = -(1 << 63) + min(total - 1, int(total * per_language / max(n, 1)))
        keep |= (F.col("lang") == lang) & (F.col("_h") <= top)
    sample = rows.where(keep).select("lang", F.lower("text"))
    got = sample.mapInArrow(lambda it: _features(it, buckets), "lang string, x binary").toPandas()
    langs = sorted(counts)
    if got.empty:
        return {"langs": [], "families": [], "pairs": [], "w": np.zeros((0, buckets + 1))}
    lang = got["lang"].to_numpy()
    x = np.ones((len(got), buckets + 1), "float32")   # the last column is the bias
    for i, v in enumerate(got.pop("x")):
        x[i, :-1] = np.frombuffer(v, "<f4")
    scale = 1 / np.sqrt(x[:, :-1].mean(0) + 1e-6)
    x[:, :-1] *= scale
    family = np.array([family_of(v) for v in lang])
    families = sorted({family_of(v) for v in langs})
    weights = [_svm(x, np.where(family == f, 1.0, -1.0)) for f in families] if len(families) > 1 else []
    pairs = [(a, b) for a, b in combinations(langs, 2) if family_of(a) == family_of(b)]
    for a, b in pairs:
        some = (lang == a) | (lang == b)
        weights.append(_svm(x[some] if not some.all() else x, np.where(lang[some] == a, 1.0, -1.0)))
    w = np.vstack(weights) if weights else np.zeros((0, buckets + 1))
    w[:, :-1] *= scale
    return {"langs": langs, "families": families, "pairs": pairs, "w": w}


def _decide(model: dict, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Languages and scores from the margins of all classifiers (rows: texts)."""
    n, langs = len(margin), model["langs"]
    if not langs:
        return np.full(n, "und", object), np.zeros(n)
    fams, pairs = model["families"], model["pairs"]
    k = len(fams) if len(fams) > 1 else 0
    sure = 1 / (1 + np.exp(-2 * np.clip(margin, -15, 15)))
    fam = margin[:, :k].argmax(1) if k else np.zeros(n, int)
    score = sure[np.arange(n), fam] if k else np.ones(n)
    members = [[i for i, v in enumerate(langs) if family_of(v) == f] for f in fams]
    votes, strength = np.zeros((n, len(langs))), np.zeros((n, len(langs)))
    for j, (a, b) in enumerate(pairs, k):
        for v, p in ((a, sure[:, j]), (b, 1 - sure[:, j])):
            votes[:, langs.index(v)] += p > 0.5
            strength[:, langs.index(v)] += p
    out = np.empty(n, object)
    for f, own in enumerate(members):
        rows = fam == f
        best = np.array(own)[(votes[np.ix_(rows, own)] + 1e-3 * strength[np.ix_(rows, own)]).argmax(1)]
        out[rows] = np.array(langs, object)[best]
        if len(own) > 1:
            score[rows] = np.minimum(score[rows], strength[np.flatnonzero(rows), best] / (len(own) - 1))
    return out, score


def _predict(batches: Iterator[pa.RecordBatch], model: dict, buckets: int) -> Iterator[pa.RecordBatch]:
    table, bias = np.ascontiguousarray(model["w"][:, :-1].astype("float32")), model["w"][:, -1]
    for b in batches:
        margin = np.zeros((b.num_rows, len(table)))
        for data, starts, rows in _chunks(b.column(0)):
            n, first = np.diff(starts), 0
            while first < len(n):
                to = max(first + 1, int(np.searchsorted(starts, starts[first] + _SCORED, "right")) - 1)
                low, high, full = starts[first], starts[to], n[first:to] > 0
                # n-grams may reach into what follows
                grams = [g[:high - low] for g in _grams(data[low:high + max(_ORDERS) - 1], buckets)]
                for j, w in enumerate(table):
                    if full.any():
                        at = sum(w[g] for g in grams)
                        margin[rows, j][first:to][full] = np.add.reduceat(at, starts[first:to][full] - low, dtype="float64")
                first = to
            margin[rows] /= np.maximum(1, n * len(_ORDERS))[:, None]
        lang, score = _decide(model, margin + bias)
        lang = np.where(b.column(1).to_numpy(zero_copy_only=False), lang, "und")
        score = np.where(lang == "und", 0.0, score)
        rest = list(range(2, b.num_columns))
        yield pa.RecordBatch.from_arrays(
            [b.column(i) for i in rest] + [pa.array(lang.tolist(), pa.string()), pa.array(score, pa.float64())],
            names=[b.schema.names[i] for i in rest] + ["lang_pred", "score"])


def predict(docs: DataFrame, model: dict, carry: list[str], text_col: str = "text",
            buckets: int = BUCKETS) -> DataFrame:
    """``carry`` columns plus ``lang_pred, score`` for every row; ``und`` and 0 if the text is null
    or has no letter.  Only the text decides."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.lower(text).alias("_t"), text.rlike(r"\p{L}").alias("_letter"), *carry)
    ddl = ", ".join(f"`{n}` {t}" for n, t in docs.select(*carry).dtypes)
    return rows.mapInArrow(lambda it: _predict(it, model, buckets), f"{ddl}, lang_pred string, score double")


def held_out(column: str = "doc_id"):
    """The fold that is never learned from."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def identify_languages(docs: DataFrame, carry: list[str] | None = None, buckets: int = BUCKETS,
                       per_language: int = SAMPLE_PER_LANGUAGE) -> DataFrame:
    """Learn from the rows outside the held-out fold, predict all: ``doc_id, held_out, lang_pred, score``
    (or ``carry`` columns instead of the first two).

    Null or letterless text gives ``und`` and 0, as does a table without any labelled row.
    Repeated rows get equal predictions; other columns are not read; empty tables stay empty.
    """
    model = train(docs.where(~held_out()), buckets, per_language)
    if carry is None:
        docs = docs.select("doc_id", "text", held_out().alias("held_out"))
        carry = ["doc_id", "held_out"]
    return predict(docs, model, carry, buckets=buckets)
