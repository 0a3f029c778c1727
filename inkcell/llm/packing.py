"""Harmonic packing of tokenised documents into fixed-length sequences.

A document is cut into pieces whose lengths are reciprocal-capacity classes: whole sequences first, then
the largest ``capacity // k`` that fits, and so on; what is left below ``tail`` tokens is a class of its own
length. Class c (pieces of exactly c tokens) fills sequences with a fixed count of ``capacity // c`` pieces.
Workers number the pieces of each class on their own; only the counts per worker and class meet, in a
prefix sum, so no token and no piece list is gathered. The fewer than k pieces that a class has left at the
end (a number that depends on the capacity only, not on the input) share the last sequences by first fit.

Null text: the end token only. Empty tables: no rows. Equal documents are packed each on its own. Other
columns of the input are ignored. A null id is kept as null.
"""

from __future__ import annotations

import re
import string
import zlib
from array import array
from collections.abc import Iterator
from unicodedata import is_normalized

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

CAPACITY = 4096
TAIL = 64
END_ID = 2
#: Entries of a worker's cache of encoded words.
CACHE_WORDS = 400_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, worker int, nth long"


def cuts(n: int, capacity: int = CAPACITY, tail: int = TAIL) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n tokens."""
    out = [(s, capacity) for s in range(0, n - capacity + 1, capacity)]
    at = len(out) * capacity
    while at < n:
        left = n - at
        size = left if left <= tail else capacity // -(-capacity // left)
        out.append((at, size))
        at += size
    return out


def _byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself where printable in Latin-1,
    else the next free code point from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b if b in plain else next(free)) for b in range(256)]


STAND_IN = _byte_letters()
#: A word that is one run of letters and perhaps one of marks after it: two pre-tokens.
SIMPLE = re.compile(r"([^\W\d_]+)([^\w\s]*)")
#: Marks of ASCII.
MARKS = string.punctuation.replace("_", "")


class _Ids(dict):
    """Ids of words; those of a word that isn't there are worked out once."""

    def __init__(self, coder: WordEncoder) -> None:
        self.coder = coder

    def __missing__(self, w: str) -> bytes:
        coder = self.coder
        ids = coder.old.get(w)
        if ids is None and (ids := coder.word(w)) is None:
            ids = array("I", coder.whole.encode(w, add_special_tokens=False).ids).tobytes()
        self[w] = ids
        return ids


class WordEncoder:
    """Token ids of texts for a vocabulary whose pre-tokens never cross white space.

    Ids of a word are cached as little-endian 32-bit bytes, and so are those of the letters and marks that
    simple words consist of; only other words take the whole path of normaliser and pre-tokeniser. A cache
    has two generations, of which the older is dropped when the younger is full.
    """

    def __init__(self, path: str, limit: int = CACHE_WORDS) -> None:
        from tokenizers import Tokenizer

        self.whole, self.limit = Tokenizer.from_file(path), limit // 2
        self.model = self.whole.model
        self.young = _Ids(self)
        self.old: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {"": b""}

    def part(self, pre: str) -> bytes:
        ids = self.parts.get(pre)
        if ids is None:
            if len(self.parts) > self.limit:
                self.parts = {"": b""}
            plain = pre.isascii() and pre.isprintable()  # control characters have stand-ins too
            letters = pre if plain else "".join([STAND_IN[b] for b in pre.encode()])
            ids = self.parts[pre] = array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()
        return ids

    def word(self, w: str) -> bytes | None:
        """Ids of a simple word; None for any other."""
        low = w.lower()
        if w.isascii():
            letters = low.rstrip(MARKS)
            if letters.isalpha():
                return self.part(letters) if len(letters) == len(low) else self.part(letters) + self.part(low[len(letters) :])
        m = SIMPLE.fullmatch(low)
        if m and (w.isascii() or m[1].isalpha() and "\u03a3" not in w and is_normalized("NFC", w) and is_normalized("NFC", low)):
            return self.part(m[1]) + self.part(m[2])
        return None

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.young) > self.limit:
            self.old, self.young = self.young, _Ids(self)
        get = self.young.__getitem__
        return [b"".join(map(get, t.split())) for t in texts]

    def encode_odd(self, text: str) -> bytes:
        """For texts with separators that Python, but not the vocabulary's rule, takes as white space."""
        return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()


_ENCODERS: dict[tuple[str, int], WordEncoder] = {}
_ODD = ("\x1c", "\x1d", "\x1e", "\x1f")


def encode_texts(texts: list[str], path: str, cache: int = CACHE_WORDS) -> list[bytes]:
    if (path, cache) not in _ENCODERS:
        _ENCODERS[path, cache] = WordEncoder(path, cache)
    coder = _ENCODERS[path, cache]
    out = coder.encode(texts)
    for i, t in enumerate(texts):
        if any(c in t for c in _ODD):
            out[i] = coder.encode_odd(t)
    return out


def _groups(batch: pa.RecordBatch, limit: int = 1 << 20) -> Iterator[tuple[list, list[str]]]:
    ids, texts, size = [], [], 0
    for i, t in zip(batch.column(0), batch.column(1), strict=True):
        s = t.as_py() or ""
        ids.append(i.as_py())
        texts.append(s)
        size += len(s)
        if size >= limit:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, cache: int = CACHE_WORDS) -> DataFrame:
    """One row per piece: PIECES; ``nth`` counts a worker's pieces of that length. ``cache``: words that a worker
    keeps encoded, about 200 bytes each."""
    end = array("I", [end_id]).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = TaskContext.get().partitionId()
        seen: dict[int, int] = {}
        for batch in batches:
            for ids, texts in _groups(batch):
                rows: list[tuple] = []
                for doc, body in zip(ids, encode_texts(texts, path, cache), strict=True):
                    body += end
                    n, view = len(body) // 4, memoryview(body)
                    for start, length in cuts(n, capacity):
                        nth = seen.get(length, 0)
                        seen[length] = nth + 1
                        rows.append((doc, start, length, zlib.crc32(view[4 * start : 4 * (start + length)]), n, worker, nth))
                cols = list(zip(*rows, strict=True))
                kinds = [pa.int64()] * 5 + [pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "worker", "nth"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECES)


def fill_plan(totals: dict[int, int], capacity: int = CAPACITY) -> list[tuple]:
    """Where the pieces of each class go: (length, first sequence, pieces in full sequences, runs).

    A run (from, to, sequence, offset) places left-over pieces [from, to) of the class end to end.
    """
    out, base = [], 0
    bins: list[list[int]] = []  # of left-overs: tokens in it
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    for length in sorted(totals, reverse=True):
        k = capacity // length
        full, left = divmod(totals[length], k)
        out.append([length, base, full * k])
        base += full
        at, runs[length] = full * k, []
        for i, used in enumerate(bins):
            if not left:
                break
            if fits := min(left, (capacity - used[0]) // length):
                runs[length].append((at, at + fits, i, used[0]))
                used[0] += fits * length
                at, left = at + fits, left - fits
        if left:
            runs[length].append((at, at + left, len(bins), 0))
            bins.append([left * length])
    return [(length, first, full, [(a, b, base + i, o) for a, b, i, o in runs[length]]) for length, first, full in out]


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, cache: int = CACHE_WORDS) -> DataFrame:
    """Pieces with their sequence: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    cut = materialize(pieces(docs, tokenizer_path, capacity, end_id, cache), "packing")
    counts = cut.groupBy("length", "worker").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("worker").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("length", "worker", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    # as many rows as there are classes: at most capacity / tail + tail
    totals = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = spark.createDataFrame(fill_plan(totals, capacity), "length long, base long, whole long, runs array<struct<lo:long,hi:long,seq:long,off:long>>")
    placed = cut.join(firsts, ["length", "worker"]).join(F.broadcast(plan), "length")
    g = F.col("first") + F.col("nth")
    k = F.expr(f"{capacity} div length")
    placed = placed.withColumn("g", g).withColumn("run", F.expr("get(filter(runs, r -> g >= r.lo and g < r.hi), 0)"))
    inside = F.col("g") < F.col("whole")
    return placed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        F.when(inside, F.col("base") + F.expr(f"g div ({capacity} div length)")).otherwise(F.col("run.seq")).alias("sequence_id"),
        F.when(inside, (F.col("g") % k) * F.col("length")).otherwise(F.col("run.off") + (F.col("g") - F.col("run.lo")) * F.col("length")).alias("offset"),
    )


def sequences(docs: DataFrame, packed: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """The packed token ids: sequence_id, ids array<int>. A sequence holds at most ``capacity`` ids, so a
    group never outgrows a task. Needs unique, non-null doc_ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = array("I", [end_id]).tobytes()
        for batch in batches:
            rows = batch.to_pylist()
            for r, body in zip(rows, encode_texts([r["text"] or "" for r in rows], tokenizer_path), strict=True):
                ids = array("I", body + end)
                parts = r["parts"]
                yield pa.RecordBatch.from_pydict({"sequence_id": [p["sequence_id"] for p in parts], "offset": [p["offset"] for p in parts], "ids": [list(ids[p["start"] : p["start"] + p["length"]]) for p in parts]}, schema=pa.schema([("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.list_(pa.int32()))]))

    parts = packed.groupBy("doc_id").agg(F.collect_list(F.struct("sequence_id", "offset", "start", "length")).alias("parts"))
    cut = docs.select("doc_id", "text").join(parts, "doc_id").mapInArrow(run, "sequence_id long, offset long, ids array<int>")
    return cut.groupBy("sequence_id").agg(F.expr("flatten(transform(array_sort(collect_list(struct(offset, ids))), x -> x.ids))").alias("ids"))
