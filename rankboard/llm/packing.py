"""Bulk-synchronous best-fit packing of tokenised documents into fixed-length sequences.

Documents are tokenised and cut into pieces of at most ``capacity`` ids.  The
pieces are range-sorted by length (a distributed sort with a lineage cut), so a
piece is known by its length and its rank within that length.  Lengths and gaps
are integers up to ``capacity``: the sorted list of documents is at most
``capacity`` runs of equal length, the sorted list of gaps a list of runs of
sequences with equal gaps.  Each superstep takes the longest unplaced run and
sweeps the gap runs for its successors (the smallest gap that still fits),
matches rank ranges of pieces to ranges of sequences (which resolves all
conflicts by rank), updates the gaps, and repeats.  A superstep handles runs, not
rows, so its state does not grow with the number of documents; the rows are
placed afterwards, each by binary search of its rank in the matched ranges.  The
result equals sequential best-fit decreasing.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.rank import global_row_number
from .common import cut, id_text, small

CAPACITY = 2048
#: Words or pieces of words of a generation of a cache; a Python worker holds two generations.
CACHE_WORDS = 250_000

_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()),
                     ("length", pa.int64()), ("ids_crc32", pa.int64())])


#: Characters of texts that are split into pieces at once.
GROUP = 2_000_000

# The split pattern of the tokenizer, for texts of these characters only (their lower
# case and normal form need no context, and each is one byte in Latin-1).
_SAFE = re.compile(r"[!-~À-ÖØ-öø-ÿ \n]*")
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")
_LETTER, _DIGIT, _OTHER = 1, 2, 3
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[[32, 10]] = 0
_KIND[48:58] = _DIGIT
_KIND[[*range(97, 123), *range(0xDF, 0xF7), *range(0xF8, 0x100)]] = _LETTER


def _piece_starts(data: np.ndarray) -> np.ndarray:
    """Whether a piece starts at each byte (lower-case Latin-1); the same pieces that ``_PIECE`` finds.

    Every byte but blanks is in a piece, and a piece ends where the next one or a blank follows."""
    kind = _KIND[data]
    starts = np.empty(len(data), bool)
    starts[:1] = True
    np.not_equal(kind[1:], kind[:-1], out=starts[1:])
    starts |= kind == _DIGIT
    starts &= kind != 0
    marks = np.flatnonzero(starts & (data == 39))   # only an apostrophe that starts a piece can shorten a word
    if len(marks):
        x, y = (np.append(data, [0, 0])[marks + k] for k in (1, 2))
        one = np.isin(x, list(b"stmd"))
        two = ((x == 114) | (x == 118)) & (y == 101) | (x == 108) & (y == 108)
        starts[marks[one | two] + 1] = False
        after = np.concatenate([marks[one] + 2, marks[two] + 3])
        after = after[after < len(data)]
        starts[after[kind[after] == _LETTER]] = True
    return starts


class _Cache:
    """What ``make`` gives for a key.  When a generation is full it becomes the older one, from which keys that
    are met again move on, so the frequent ones stay."""

    def __init__(self, make):
        self.make, self.young, self.old = make, {}, {}

    def __call__(self, key):
        made = self.young.get(key) or self.old.get(key) or self.make(key)
        if len(self.young) >= CACHE_WORDS:
            self.young, self.old = {}, self.young
        self.young[key] = made
        return made


class WordEncoder:
    """Ids of texts by piece: no piece that the tokenizer merges spans a blank or a line end, so each is
    encoded once and remembered.  Texts of plain letters are split into pieces many at a time, and their different pieces
    go to the merge table directly; in any other text (and one that may hold a special token) a word of plain
    letters does so, and any other word takes the tokenizer's whole way."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.direct = bool(self.tokenizer.pre_tokenizer) and _is_word_bpe(path)
        self.bytes_of = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.words, self.pieces = _Cache(self._word), _Cache(self._piece)

    def _piece(self, piece: bytes) -> bytes:
        shown = piece.decode("ascii") if piece.isascii() else self.bytes_of(piece.decode("latin-1"))[0][0]
        return np.array([t.id for t in self.tokenizer.model.tokenize(shown)], "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        if self._plain(word):
            return b"".join([self.pieces(p.encode("latin-1")) for p in _PIECE.findall(word.lower())])
        return np.asarray(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def _plain(self, text: str) -> bool:
        return self.direct and "<|" not in text and bool(_SAFE.fullmatch(text))

    def _group(self, texts: list[str]) -> list[bytes]:
        data = np.frombuffer("\n".join(texts).lower().encode("latin-1"), np.uint8)
        starts = _piece_starts(data)
        shown = data[_KIND[data] != 0]
        at = np.flatnonzero(starts[_KIND[data] != 0]).astype("int32")
        n, offsets = len(at), np.append(at, np.int32(len(shown)))
        pieces = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(shown)]).dictionary_encode()
        known, make = self.pieces.young.get, self.pieces
        ids = pa.array([known(p) or make(p) for p in pieces.dictionary.to_numpy(zero_copy_only=False)], pa.large_binary()).take(pieces.indices)
        # where each text's pieces begin among all
        begins = np.cumsum([0] + [len(t) + 1 for t in texts])
        of = np.frombuffer(ids.buffers()[1], np.int64, n + 1)[np.searchsorted(np.flatnonzero(starts), begins)].tolist() if n else [0] * len(begins)
        held = memoryview(ids.buffers()[2] or b"")
        return [bytes(held[a:b]) for a, b in zip(of[:-1], of[1:], strict=True)]

    def many(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text, in order."""
        group, size = [], 0
        for text in texts:
            plain = self._plain(text)
            if group and (not plain or size + len(text) > GROUP):
                yield from self._group(group)
                group, size = [], 0
            if plain:
                group.append(text)
                size += len(text) + 1
            else:
                known, make = self.words.young.get, self.words
                yield b"".join([known(w) or make(w) for w in text.replace("\n", " ").split(" ") if w])
        if group:
            yield from self._group(group)

    def __call__(self, text: str) -> bytes:
        return next(self.many([text]))


def _is_word_bpe(path: str) -> bool:
    """Whether the file has the normaliser and the split that ``_PIECE`` stands for."""
    import json

    with open(path, encoding="utf-8") as f:
        d = json.load(f)
    kinds = [x["type"] for x in (d["normalizer"] or {}).get("normalizers", [])]
    splits = (d["pre_tokenizer"] or {}).get("pretokenizers", [])
    return (kinds == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in splits] == ["Split", "ByteLevel"]
            and splits[0]["pattern"].get("Regex") == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


_encoders: dict[str, WordEncoder] = {}   # kept while a Python worker lives


def _piece_task(tokenizer_path: str, capacity: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _PIECES.append(pa.field("ids", pa.binary())) if with_ids else _PIECES
        encode = _encoders.setdefault(tokenizer_path, None) or WordEncoder(tokenizer_path)
        _encoders[tokenizer_path] = encode
        end = np.zeros(1, "<u4").tobytes()
        for b in small(batches):
            rows: list[tuple] = []
            for doc, ids in zip(b.column(0).to_pylist(), encode.many(b.column(1).to_pylist()), strict=True):
                ids += end
                n = len(ids) // 4
                for k, at in enumerate(range(0, n, capacity)):
                    part = ids[4 * at:4 * (at + capacity)]
                    rows.append((doc, k, at, len(part) // 4, zlib.crc32(part)) + ((part,) if with_ids else ()))
            cols = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)],
                                             schema=schema)
    return run


def token_pieces(df: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, with_ids: bool = False,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of at most ``capacity`` ids: ``doc_id, piece, start, length, ids_crc32`` and, on
    request, ``ids`` (little-endian unsigned 32-bit).  Each document ends with id 0."""
    ddl = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return id_text(df, id_col, text_col).mapInArrow(_piece_task(tokenizer_path, capacity, with_ids), ddl)


def best_fit_runs(lengths: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Match runs of equal lengths to runs of equal gaps, longest first.

    ``lengths``: pieces of each length.  Returns rows ``(first_rank, sequence, offset)``,
    by ``first_rank`` over all pieces sorted by falling length: the piece of rank
    ``first_rank + i`` goes to ``sequence + i`` at ``offset``; and the number of sequences.
    """
    gaps: list[int] = []                        # the gap sizes that occur, sorted
    runs: dict[int, list[tuple[int, int]]] = {}  # gap -> (first sequence, how many)
    out: list[tuple[int, int, int]] = []
    sequences = rank = 0

    def give(gap: int, first: int, n: int) -> None:
        if n and gap:
            if gap not in runs:
                bisect.insort(gaps, gap)
                runs[gap] = []
            runs[gap].append((first, n))

    for size in sorted(lengths, reverse=True):
        left = lengths[size]
        while left:
            at = bisect.bisect_left(gaps, size)  # the successor: the smallest gap that fits
            if at < len(gaps):
                gap = gaps[at]
                first, n = runs[gap].pop()
                if not runs[gap]:
                    del runs[gap], gaps[at]
            else:
                gap, first, n = capacity, sequences, -(-left // (capacity // size))
                sequences += n
            each = gap // size                   # best fit fills a sequence before the next
            full = min(n, left // each)
            for k in range(each if full else 0):
                out.append((rank, first, capacity - gap + k * size))
                rank += full
            left -= full * each
            give(gap - each * size, first, full)
            if full < n:
                some = min(left, each)
                for k in range(some):            # the last, partly filled one
                    out.append((rank, first + full, capacity - gap + k * size))
                    rank += 1
                left -= some
                give(gap - some * size, first + full, min(1, n - full))
                give(gap, first + full + 1, n - full - 1)
    return np.asarray(out, dtype="int64").reshape(-1, 3), sequences


def best_fit_pack(pieces: DataFrame, capacity: int = CAPACITY, num_partitions: int | None = None) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows ``doc_id, piece, length, ...`` (length 1 to
    ``capacity``).  Offsets are gapless from 0 in every sequence.  An empty table stays empty."""
    pieces = cut(pieces, "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # <= capacity rows
    if any(not 1 <= n <= capacity for n in counts):
        raise ValueError(f"piece lengths must be 1 to {capacity}")
    plan, _ = best_fit_runs(counts, capacity)
    order = [F.col("length").desc(), F.col("doc_id").asc_nulls_first(), F.col("piece").asc()]
    ranked = global_row_number(pieces, order, "_rank", num_partitions)
    starts, first, offset = np.ascontiguousarray(plan.T)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rank = b.column(b.schema.get_field_index("_rank")).to_numpy() - 1
            at = np.searchsorted(starts, rank, "right") - 1
            keep = [i for i, n in enumerate(b.schema.names) if n != "_rank"]
            yield pa.RecordBatch.from_arrays(
                [b.column(i) for i in keep] + [pa.array(first[at] + rank - starts[at]), pa.array(offset[at])],
                names=[b.schema.names[i] for i in keep] + ["sequence_id", "offset"])

    fields = ", ".join(f"`{n}` {t}" for n, t in pieces.dtypes)
    return ranked.mapInArrow(place, f"{fields}, sequence_id long, offset long")


def pack_documents(df: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, with_ids: bool = False,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise, cut and pack.  Null and empty texts are one piece holding only id 0; repeated
    rows and null ids are packed like any others; other columns are ignored."""
    return best_fit_pack(token_pieces(df, tokenizer_path, capacity, with_ids, id_col, text_col), capacity)
