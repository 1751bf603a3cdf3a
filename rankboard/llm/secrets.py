"""Secret scan with multipart credential linking.

A pass over every whole text finds parts with their code-point spans: the base
kinds ``assign``, ``access`` and ``hex``, which are secrets on their own, and weak
parts, which are not: ``weak_id`` (a client, account or user id that is assigned),
``weak_secret`` (a short assigned secret, or an unassigned 40-character key) and
``weak_endpoint`` (a URL or host).  Parts of one scope (a paragraph) are then
interval-joined: a part meets the parts that overlap it or are at most ``reach`` code
points away, from the end of the one to the start of the other.  For that, running windows
per document and scope hold the greatest end before a part and the smallest start after it,
so a part is never paired with each of its partners.  A weak part is reported only if its
complement co-occurs:

* ``weak_secret``: an identifier (``access``, ``weak_id``) is in reach;
* ``weak_id``: a secret (``assign``, ``hex``, ``weak_secret``) is in reach;
* ``weak_endpoint``: both an identifier and a secret are in reach.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, id_text, small

REACH = 300
BASE = ["assign", "access", "hex"]
KINDS = [*BASE, "weak_id", "weak_secret", "weak_endpoint"]

_A = re.ASCII
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                     _A | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+", _A)
_HEX = re.compile(r"[0-9a-f]+", _A)
_WEAK_ID = re.compile(r"""\b(?:access_?key_?id|client_?id|account_?id|user(?:name)?|login)["']?\x20*[:=]\x20*["']?"""
                      r"""([A-Za-z0-9+/_.@-]{3,})""", _A | re.IGNORECASE)
_WEAK_KEY = re.compile(r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=_-])", _A)
_ENDPOINT = re.compile(r"""\b(?:[a-z][a-z0-9+.-]{1,20}://[^\s"'<>]+|(?:host|endpoint|server)["']?\x20*[:=]\x20*["']?"""
                       r"""[A-Za-z0-9_.:-]{4,})""", _A | re.IGNORECASE)
_BLANK_LINE = re.compile(r"\n[ \t\r]*\n")
_WEAK_MIN, _ASSIGN_MIN, _ACCESS_MIN, _HEX_MIN = 6, 12, 18, 16


def parts(text: str) -> list[tuple[int, int, int, int]]:
    """``(kind, start, end, scope)`` of a text; base kinds first match leftmost, without overlap,
    then too short ones are dropped.  Weak parts never overlap a base part or one of their own kind."""
    found = [(4 if len(m[2]) < _ASSIGN_MIN else 0, m.start(), m.end(), len(m[2])) for m in _ASSIGN.finditer(text)]
    base = [x[:3] for x in found if x[0] == 0]
    base += [(1, m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= _ACCESS_MIN]
    base += [(2, m.start(), m.end()) for m in _HEX.finditer(text) if m.end() - m.start() >= _HEX_MIN]
    weak = [x[:3] for x in found if x[0] == 4 and x[3] >= _WEAK_MIN]
    weak += [(3, m.start(), m.end()) for m in _WEAK_ID.finditer(text)]
    weak += [(4, m.start(), m.end()) for m in _WEAK_KEY.finditer(text)
             if re.search("[a-z]", m[0]) and re.search("[A-Z]", m[0]) and re.search("[0-9]", m[0])]
    weak += [(5, m.start(), m.end()) for m in _ENDPOINT.finditer(text)]
    taken, free, ends = sorted((s, e) for _, s, e in base), [], {}
    bounds, at = [], 0
    for s, e in taken:                       # the union of the base spans
        if bounds and s <= bounds[-1][1]:
            bounds[-1][1] = max(bounds[-1][1], e)
        else:
            bounds.append([s, e])
    for kind, s, e in sorted(weak, key=lambda x: (x[1], -x[2])):
        while at < len(bounds) and bounds[at][1] <= s:
            at += 1
        if s >= ends.get(kind, 0) and not (at < len(bounds) and bounds[at][0] < e):
            free.append((kind, s, e))
            ends[kind] = e
    out, scope, breaks = [], 0, _BLANK_LINE.finditer(text)
    nxt = next(breaks, None)
    for kind, s, e in sorted(base + free, key=lambda x: (x[1], x[0])):
        while nxt and nxt.end() <= s:
            scope, nxt = scope + 1, next(breaks, None)
        out.append((kind, s, e, scope))
    return out


_TYPE = "array<struct<kind:int,start:int,end:int,scope:int>>"
_ARROW = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("scope", pa.int32())]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in small(batches):
        rows = [[dict(zip(("kind", "start", "end", "scope"), p, strict=True)) for p in parts(t)]
                for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(rows, _ARROW)],
                                         names=["doc_id", "_row", "parts"])


def _joined(spans):
    return F.array_join(F.transform(spans, lambda p: F.concat_ws(
        ":", F.element_at(F.array(*map(F.lit, KINDS)), p["kind"] + 1), p["start"], p["end"])), ",")


def _of_kind(kind: int):
    return lambda p: p["kind"] == kind


def scan_secrets(df: DataFrame, reach: int = REACH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked``.

    ``spans`` holds the base spans and the linked weak ones as ``kind:start:end`` by start, then
    kind; ``base_sha256`` is the digest of the base ones alone.  Null text counts as empty (no
    spans); repeated rows are scanned each on its own; other columns are ignored.
    """
    docs = id_text(df, id_col, text_col).withColumn("_row", F.monotonically_increasing_id())
    found = cut(docs.mapInArrow(_scan, f"doc_id long, _row long, parts {_TYPE}"), "secret_parts")
    is_weak = lambda p: p["kind"] >= len(BASE)
    # only scopes with a weak part and another part can link
    loose = (found.where(F.exists("parts", is_weak) & (F.size("parts") > 1))
                  .select("_row", F.inline("parts")))
    scope, running = Window.partitionBy("_row", "scope"), (Window.unboundedPreceding, Window.currentRow)
    before, after = scope.orderBy("start").rangeBetween(*running), scope.orderBy(F.desc("start")).rangeBetween(*running)

    def has(*kinds):
        of = F.col("kind").isin(*kinds)
        ended, starts = F.max(F.when(of, F.col("end"))).over(before), F.min(F.when(of, F.col("start"))).over(after)
        near = F.coalesce(F.col("start") - ended <= reach, F.lit(False))
        return near | F.coalesce(starts - F.col("end") <= reach, F.lit(False))

    identifier, secret = has(1, 3), has(0, 2, 4)
    linked = (loose.select("_row", "kind", "start", "end", identifier.alias("i"), secret.alias("s"))
              .where(F.when(F.col("kind") == 3, F.col("s")).when(F.col("kind") == 4, F.col("i"))
                      .when(F.col("kind") == 5, F.col("i") & F.col("s")).otherwise(F.lit(False)))
              .groupBy("_row").agg(F.collect_list(F.struct("start", "kind", "end")).alias("weak")))
    base = F.filter("parts", lambda p: ~is_weak(p))
    weak = F.coalesce("weak", F.array().cast("array<struct<start:int,kind:int,end:int>>"))
    flat = F.transform(base, lambda p: F.struct(p["start"], p["kind"], p["end"]))
    return (found.join(linked, "_row", "left")
            .select("doc_id",
                    *[F.size(F.filter(base, _of_kind(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(BASE)],
                    F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"),
                    _joined(F.array_sort(F.concat(flat, weak))).alias("spans"),
                    F.size(weak).cast("long").alias("n_linked")))
