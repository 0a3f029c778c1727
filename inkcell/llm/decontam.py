"""Benchmark decontamination by winnowed word fingerprints.

Both sides keep the least k-gram hash of every window of ``ngram`` words; any ``ngram`` words that a document
shares with a benchmark item hold that same least hash, so the join of the fingerprints misses no shared
span. Around each joined fingerprint the windows are compared word for word and hits are extended to all
words of the windows found. Items shorter than ``ngram`` words are one window of their own length.

The benchmark is handled in blocks of at most about ``block_bytes`` of text, as a worker holds about 32 bytes
for each of them; one block is in memory at a time, and a larger benchmark takes more passes, each of which
writes what it found. Null texts and texts without words have no
hits. Null item ids are ignored. Repeated items count once by id. Repeated documents get a row each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, U64, free_name, gram_hashes, materialize, prefix_hash, sliding_min, span_hash, text_slices, words

NGRAM = 10
GRAM = 5
BLOCK_BYTES = 4 << 20

#: Bytes of a word once A-Z are lower-cased: digits, a-z and all of non-ASCII.
KEEP = np.zeros(256, bool)
KEEP[48:58] = KEEP[65:91] = KEEP[97:123] = KEEP[128:] = True

HITS = "row long, doc_id long, n_words long, spans array<struct<lo:long,hi:long>>, items array<string>"


def _lowered(data: np.ndarray) -> bytes:
    return LOWER[data].tobytes()


class Index:
    """Windows of one block of items: bytes of the words joined by a blank -> item ids; and fingerprints."""

    def __init__(self, items: list[tuple[str, str]], ngram: int, gram: int) -> None:
        self.ngram, self.gram = ngram, gram
        self.windows: dict[int, dict[bytes, tuple[str, ...]]] = {}
        prints: set[int] = set()
        short: dict[int, set[int]] = {}
        for item, text in items:
            data = np.frombuffer(text.encode(), np.uint8)
            low = LOWER[data]
            starts, ends, _ = words(data, np.array([0, len(data)]), KEEP)
            n = len(starts)
            if not n:
                continue
            m = min(n, ngram)
            raw = low.tobytes()
            each = [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            found = self.windows.setdefault(m, {})
            for i in range(n - m + 1):
                w = b" ".join(each[i : i + m])
                if item not in (have := found.get(w, ())):
                    found[w] = (*have, item)
            h = span_hash(prefix_hash(low), starts, ends)
            if m == ngram:
                prints.update(sliding_min(gram_hashes(h, gram), ngram - gram + 1).tolist())
            else:
                short.setdefault(m, set()).update(gram_hashes(h, m).tolist())
        self.prints = np.array(sorted(prints), U64)
        self.short = {m: np.array(sorted(s), U64) for m, s in short.items()}


def _member(sorted_keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_keys):
        return np.zeros(len(x), bool)
    at = np.searchsorted(sorted_keys, x)
    at[at == len(sorted_keys)] = 0
    return sorted_keys[at] == x


def find(data: np.ndarray, offsets: np.ndarray, index: Index) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[list[str]]]:
    """Of each text: number of words, merged spans of hit words, ids of items with occurring windows."""
    low = LOWER[data]
    starts, ends, first = words(data, offsets, KEEP)
    n = len(offsets) - 1
    spans: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    items: list[set[str]] = [set() for _ in range(n)]
    if not len(starts):
        return np.zeros(n, np.int64), spans, [[] for _ in range(n)]
    h = span_hash(prefix_hash(low), starts, ends)
    candidates: list[tuple[int, np.ndarray]] = []
    if len(index.prints):
        grams = gram_hashes(h, index.gram)
        reach = index.ngram - index.gram
        least = sliding_min(grams, reach + 1)  # window at word i has its least hash in least[i]
        if len(least):
            candidates.append((index.ngram, np.flatnonzero(_member(index.prints, least))))
    for m, keys in index.short.items():
        candidates.append((m, np.flatnonzero(_member(keys, gram_hashes(h, m)))))
    raw = low.tobytes()
    for m, at in candidates:
        if not len(at):
            continue
        doc = np.searchsorted(first, at, side="right") - 1
        ok = at + m <= first[doc + 1]
        windows = index.windows[m]
        for i, d in zip(at[ok].tolist(), doc[ok].tolist(), strict=True):
            key = b" ".join(raw[starts[j] : ends[j]] for j in range(i, i + m))
            if found := windows.get(key):
                items[d].update(found)
                lo = i - int(first[d])
                spans[d].append((lo, lo + m))
    for s in spans:
        if len(s) > 1:
            s.sort()
            merged = [s[0]]
            for lo, hi in s[1:]:
                if lo <= merged[-1][1]:
                    merged[-1] = (merged[-1][0], max(hi, merged[-1][1]))
                else:
                    merged.append((lo, hi))
            s[:] = merged
    return np.diff(first), spans, [sorted(x) for x in items]


SPANS = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))


def keep_clean(docs: DataFrame, benchmark: DataFrame, ngram: int = NGRAM, gram: int = GRAM, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs``, all columns as they are, in which no window of an item occurs."""
    spark = docs.sparkSession
    n = count_blocks(benchmark, block_bytes)
    if n == 1:
        index = spark.sparkContext.broadcast(Index(block(benchmark, 0, 1), ngram, gram))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, data, offsets in text_slices(batch):
                    clean = pa.array([not s for s in find(data, offsets, index.value)[1]])
                    yield part.filter(clean)

        return docs.mapInArrow(run, docs.schema)
    # rows alike in id and text are hit alike
    row = F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    base = docs.select(row.alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    hit = _passes(base, benchmark, n, ngram, gram).select("row").distinct()
    name = free_name(docs, "row")
    kept = docs.withColumn(name, row).join(hit.withColumnRenamed("row", name), name, "left_anti")
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def _passes(base: DataFrame, benchmark: DataFrame, n: int, ngram: int, gram: int) -> DataFrame:
    """HITS of the rows that each block hits, written block by block."""
    every = _pass(base, benchmark, 0, n, ngram, gram)
    for b in range(1, n):
        every = every.unionByName(_pass(base, benchmark, b, n, ngram, gram))
    return every


def _pass(base: DataFrame, benchmark: DataFrame, b: int, n: int, ngram: int, gram: int) -> DataFrame:
    index = base.sparkSession.sparkContext.broadcast(Index(block(benchmark, b, n), ngram, gram))
    found = materialize(_scan(base, index).where(F.size("spans") > 0), "decontam-hits")
    index.destroy()
    return found


def _scan(docs: DataFrame, index, schema: str = HITS) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in text_slices(batch):
                n, spans, items = find(data, offsets, index.value)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array([[{"lo": a, "hi": b} for a, b in s] for s in spans], SPANS), pa.array(items, pa.list_(pa.string()))], names=["row", "doc_id", "n_words", "spans", "items"])

    return docs.mapInArrow(run, schema)


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text")).where("item is not null and text is not null")


def count_blocks(benchmark: DataFrame, block_bytes: int) -> int:
    total = _items(benchmark).agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    return max(1, -(-total // block_bytes))


def block(benchmark: DataFrame, b: int, n: int) -> list[tuple[str, str]]:
    """(item, text) of one block: about a share of 1 / n of all."""
    items = _items(benchmark)
    part = items if n == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == b)
    return [(r["item"], r["text"]) for r in part.collect()]


def hits(docs: DataFrame, benchmark: DataFrame, ngram: int = NGRAM, gram: int = GRAM, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, spans of hit words [lo, hi), items: one row per document."""
    spark = docs.sparkSession
    base = docs.select(F.lit(0).cast("long").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n = count_blocks(benchmark, block_bytes)
    first = spark.sparkContext.broadcast(Index(block(benchmark, 0, n), ngram, gram))
    if n == 1:
        return _scan(base, first).drop("row")
    base = materialize(base.withColumn("row", F.monotonically_increasing_id()), "decontam")
    every = materialize(_scan(base, first), "decontam-first")
    first.destroy()
    for b in range(1, n):
        every = every.unionByName(_pass(base, benchmark, b, n, ngram, gram))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                spans = sorted((s["lo"], s["hi"]) for s in r["spans"])
                merged: list[list[int]] = []
                for lo, hi in spans:
                    if merged and lo <= merged[-1][1]:
                        merged[-1][1] = max(hi, merged[-1][1])
                    else:
                        merged.append([lo, hi])
                out.append([{"lo": a, "hi": b} for a, b in merged])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(out, SPANS), batch.column(4)], names=["row", "doc_id", "n_words", "spans", "items"])

    rows = every.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return rows.mapInArrow(merge, HITS).drop("row")


def digest(found: DataFrame) -> DataFrame:
    n_hit = F.expr("aggregate(spans, 0L, (s, x) -> s + x.hi - x.lo)")
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")).cast("binary"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )
