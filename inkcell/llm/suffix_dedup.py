"""Repeated substrings of a corpus by suffix order: bytes whose longest previous factor reaches a length.

A byte is a copy if it is covered by a string of ``length`` bytes that starts anywhere else too (mode
``all``), or anywhere earlier in (document, position) order (mode ``later``): where the longest factor found
elsewhere, or before, is that long. Strings are judged on the input.

Every window of ``length`` bytes is put in the charge of its anchor, the ``gram``-byte string of least hash
in it (the leftmost of equals), so equal windows have equal anchors at the same place in them. The windows in
charge of one anchor occurrence make a stretch of text.

1. Equal stretches are folded to the first, by two independent 64-bit hashes, of the anchor and of the whole
   stretch; all others are copies.
2. Distinct stretches under one anchor, as at the ends of a shared passage, are cut from their documents.
   Windows with up to half of their free bytes left of the anchor meet by the bytes right of it that all of
   them hold, the others by those left of it, so only stretches that share most of a window meet.
3. There the suffixes that begin at the anchors are sorted, and the reversed prefixes that end there, with the
   lengths of the common prefixes of neighbours. A window with l bytes left of its anchor belongs to a class
   of each order, between places where fewer than l, or ``length`` - l, bytes are common; equal pairs of
   classes are equal bytes. In a class in the order of places, the entry before a window is its previous
   occurrence, the one behind it its next.

The spans found move to their documents, once. Null text is empty. Rows are told apart by id and text: rows
with a null id take part like others and are the last in order, repeated ids with unlike texts are documents
of their own, and rows alike in both are cut alike (mode ``later`` counts them as one). Empty tables give
none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BASE, BYTE_CODES, U64, free_name, materialize, mix, parallelism, text_slices, word_hash

LENGTH = 200
GRAM = 32
#: Bytes of text whose stretches a task folds together, and of stretches that are sorted at a time.
FOLD_BYTES = 16 << 20
SORT_BYTES = 4 << 20


def gram_codes(data: np.ndarray, gram: int) -> np.ndarray:
    """Hash of every ``gram`` consecutive bytes, by doubling."""
    x, have = BYTE_CODES[data], 1
    while have < gram:
        step = min(have, gram - have)
        x = x[: len(x) - step] * U64(pow(BASE, step, 2**64)) + x[step:] if step == have else x[: len(x) - step] * U64(BASE) + mix(x[step:])
        have += step
    return mix(x)


def stretches(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, first window, one past the last, anchor, its hash) of every stretch; windows and anchors count
    from the beginning of the slice, windows never cross texts."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none, np.zeros(0, U64)
    code = gram_codes(data, gram)
    width = length - gram + 1
    bits = U64(max(1, int(n).bit_length()))
    packed = (code >> bits << bits) | np.arange(len(code), dtype=U64)
    have, least = 1, packed
    while have < width:
        step = min(have, width - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    anchor = (least & ((U64(1) << bits) - U64(1))).astype(np.int64)
    size = np.diff(offsets)
    text = np.repeat(np.arange(len(size)), size)
    w = len(anchor)
    inside = text[:w] == text[length - 1 : length - 1 + w]
    change = np.empty(w, bool)
    change[0] = True
    change[1:] = (anchor[1:] != anchor[:-1]) | (inside[1:] != inside[:-1]) | (text[1:w] != text[: w - 1])
    lo = np.flatnonzero(change)
    hi = np.concatenate([lo[1:], [w]])
    ok = inside[lo]
    lo, hi = lo[ok], hi[ok]
    return text[lo], lo, hi, anchor[lo], code[anchor[lo]]


def _common(rows: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Of sorted rows of bytes, how many are common with the row before; -1 where a group begins."""
    out = np.full(len(rows), -1)
    unlike = rows[1:] != rows[:-1]
    out[1:] = np.where(unlike.any(1), unlike.argmax(1), rows.shape[1])
    out[1:][group[1:] != group[:-1]] = -1
    return out


def _suffix_order(rows: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows of bytes within their groups, and the common prefixes of neighbours."""
    keyed = np.concatenate([group.astype(">u4").view(np.uint8).reshape(-1, 4), rows], axis=1)
    order = np.argsort(np.ascontiguousarray(keyed).view(f"S{keyed.shape[1]}")[:, 0], kind="stable")
    return order, _common(rows[order], group[order])


def occurrences(group: np.ndarray, left: np.ndarray, right: np.ndarray, low: np.ndarray, high: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether window l (columns) of each row has an equal one in an earlier, and in a later, row of its group.

    A row's window l is the first l bytes of ``left`` (reversed) and ``length`` - l of ``right``; it has those
    from ``low`` to ``high``. Rows are in the order of places.
    """
    m = len(group)
    earlier, later = (np.zeros((m, int(high.max(initial=0)) + 1), bool) for _ in range(2))
    order_r, common_r = _suffix_order(right, group)
    order_l, common_l = _suffix_order(left, group)
    class_r, class_l = np.empty(m, np.int64), np.empty(m, np.int64)
    for at in range(int(low.min(initial=0)), earlier.shape[1]):
        some = np.flatnonzero((low <= at) & (at <= high))
        if len(some) < 2:
            continue
        class_r[order_r] = np.cumsum(common_r < length - at)
        class_l[order_l] = np.cumsum(common_l < at)
        key = class_r[some] * (m + 1) + class_l[some]
        order = np.argsort(key, kind="stable")  # equal windows in the order of places
        same = key[order][1:] == key[order][:-1]
        earlier[some[order[1:][same]], at] = True
        later[some[order[:-1][same]], at] = True
    return earlier, later


#: An entry of a block: anchor, stretch hash, document and its text's hash, first window, bytes from there to the
#: anchor, number of windows, occurrences folded.
ENTRY = np.dtype([("anchor", "<u8"), ("stretch", "<u8"), ("doc", "<i8"), ("tie", "<i4"), ("lo", "<i4"), ("at", "<u2"), ("n", "<u2"), ("many", "<i4")])
SPANS = "doc long, tie int, los array<int>, his array<int>"
SCAN = f"kind int, {SPANS}, bucket int, block binary"
INTS = pa.list_(pa.int32())
TYPES = {"kind": pa.int32(), "doc": pa.int64(), "tie": pa.int32(), "los": INTS, "his": INTS, "bucket": pa.int32(), "block": pa.binary()}


def _rows(kind: int, n: int, **have) -> pa.RecordBatch:
    cols = {"kind": pa.array(np.full(n, kind), pa.int32())} | {c: pa.array(have[c], t) if c in have else pa.nulls(n, t) for c, t in TYPES.items() if c != "kind"}
    return pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))


def _first_of(e: np.ndarray, every: bool) -> tuple[np.ndarray, np.ndarray]:
    """The first entry of every stretch, in the order of anchors and with all its occurrences, and the entries
    that are copies."""
    e = e[np.lexsort((e["lo"], e["tie"], e["doc"], e["stretch"], e["anchor"]))]
    new = np.ones(len(e), bool)
    new[1:] = (e["anchor"][1:] != e["anchor"][:-1]) | (e["stretch"][1:] != e["stretch"][:-1])
    group = np.cumsum(new) - 1
    many = np.bincount(group, e["many"]).astype(np.int32)
    first = e[new]
    if every:
        copies = many[group] > 1
    else:  # a row alike in id and text is the same document
        f = first[group]
        copies = (e["lo"] != f["lo"]) | (e["tie"] != f["tie"]) | (e["doc"] != f["doc"])
    first["many"] = many
    return first, e[copies]


def _cover(docs: np.ndarray, ties: np.ndarray, los: np.ndarray, his: np.ndarray, buckets: int = 1) -> pa.RecordBatch:
    """Spans of each document, merged where they touch; any bucket will do."""
    order = np.lexsort((los, ties, docs))
    docs, ties, los, his = docs[order], ties[order], los[order], his[order]
    out: list[list] = [[], [], [], []]
    last = None
    for d, t, lo, hi in zip(docs.tolist(), ties.tolist(), los.tolist(), his.tolist(), strict=True):
        if (d, t) != last:
            last = d, t
            for c, x in zip(out, (d, t, [lo], [hi]), strict=True):
                c.append(x)
        elif lo <= out[3][-1][-1]:
            out[3][-1][-1] = max(hi, out[3][-1][-1])
        else:
            out[2][-1].append(lo)
            out[3][-1].append(hi)
    return _rows(0, len(out[0]), doc=out[0], tie=out[1], los=out[2], his=out[3], bucket=np.array(out[1], np.int64) % buckets)


def _covered(c: np.ndarray, length: int, buckets: int = 1) -> pa.RecordBatch:
    lo = c["lo"].astype(np.int64)
    return _cover(c["doc"], c["tie"], lo, lo + c["n"] + (length - 1), buckets)


def _cuts(x: np.ndarray) -> list[int]:
    """Where runs of equal entries begin, and the end."""
    return [0, *(np.flatnonzero(x[1:] != x[:-1]) + 1).tolist(), len(x)]


def _scan(text: DataFrame, length: int, gram: int, every: bool, buckets: int) -> DataFrame:
    """kind 0: spans of a document that this task alone shows to be copies; kind 1: entries by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal size
            if held:
                e, c = _first_of(np.concatenate(held), every)
                if len(c):
                    yield _covered(c, length, buckets)
                bucket = (e["anchor"] % U64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                e, bucket = e[order], bucket[order]
                cut = _cuts(bucket)
                yield _rows(1, len(cut) - 1, bucket=bucket[cut[:-1]].astype(np.int32), block=[e[a:b].tobytes() for a, b in zip(cut, cut[1:], strict=False)])
            held.clear()
            size = 0

        for batch in batches:
            for part, data, offsets in text_slices(batch):
                doc, lo, hi, anchor, code = stretches(data, offsets, length, gram)
                if len(doc):
                    e = np.empty(len(doc), ENTRY)
                    e["anchor"], e["stretch"] = code, word_hash(data, lo, hi + length - 1)
                    e["doc"], e["tie"] = part.column(0).to_numpy()[doc], part.column(1).to_numpy()[doc]
                    e["lo"], e["at"], e["n"], e["many"] = lo - offsets[doc], anchor - lo, hi - lo, 1
                    held.append(e)
                size += len(data)
                if size >= FOLD_BYTES:
                    yield from flush()
        yield from flush()

    return text.mapInArrow(run, SCAN)


def _settle(scan: DataFrame, length: int, every: bool, partitions: int) -> DataFrame:
    """kind 0: spans settled by whole stretches, here or before; kind 1: per document, entries whose bytes are
    needed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            done = pa.compute.equal(batch.column(0), 0)
            if (rest := batch.filter(done)).num_rows:
                yield rest
            kept = batch.filter(pa.compute.invert(done))
            for b, x in zip(kept.column(5).to_pylist(), kept.column(6).to_pylist(), strict=True):
                held.setdefault(b, []).append(np.frombuffer(x, ENTRY))
        for b in list(held):
            e, c = _first_of(np.concatenate(held.pop(b)), every)
            if len(c):
                yield _covered(c, length)
            # anchors with more than one stretch
            which = np.cumsum(np.concatenate([[True], e["anchor"][1:] != e["anchor"][:-1]])) - 1
            e = e[np.bincount(which)[which] > 1]
            if len(e):
                e = e[np.lexsort((e["lo"], e["tie"], e["doc"]))]
                cut = _cuts(e[["doc", "tie"]])
                for at in range(0, len(cut) - 1, 4096):
                    part = list(zip(cut[at : at + 4096], cut[at + 1 : at + 4097], strict=False))
                    first = e[[a for a, _ in part]]
                    yield _rows(1, len(part), doc=first["doc"], tie=first["tie"], block=[e[a:b].tobytes() for a, b in part])

    return scan.repartition(partitions, "bucket").mapInArrow(run, SCAN)


CUT = "meet long, doc long, tie int, lo int, low int, high int, known boolean, prefix binary, suffix binary"


def _cut_out(needed: DataFrame, length: int, gram: int) -> DataFrame:
    """CUT: of each stretch asked for, the half of its windows that meets by what is right of the anchor, and
    the half that meets by what is left of it; ``lo``: place of the anchor, ``low``, ``high``: bytes of the
    windows before it."""
    half = (length - gram) // 2
    names = [x.split()[0] for x in CUT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                body = batch.column(2)[i].as_py()
                e = np.concatenate([np.frombuffer(x, ENTRY) for x in batch.column(3)[i].as_py()])
                data = np.frombuffer(body, np.uint8)
                at = e["lo"].astype(np.int64) + e["at"]
                high = e["at"].astype(np.int64)
                low = high - e["n"] + 1
                for right in (True, False):
                    on = low <= half if right else high > half
                    if not on.any():
                        continue
                    f, a = e[on], at[on]
                    h = np.minimum(high[on], half) if right else high[on]
                    w = low[on] if right else np.maximum(low[on], half + 1)
                    meet = word_hash(data, a, a + (length - half)) if right else word_hash(data, a - (half + 1), a)
                    meet = mix(meet ^ f["anchor"] ^ U64(right)).view(np.int64)
                    prefix = [body[x - y : x] for x, y in zip(a.tolist(), h.tolist(), strict=True)]
                    suffix = [body[x : x + length - y] for x, y in zip(a.tolist(), w.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(meet), pa.array(f["doc"]), pa.array(f["tie"]), pa.array(a, pa.int32()), pa.array(w, pa.int32()), pa.array(h, pa.int32()), pa.array(f["many"] > 1), pa.array(prefix, pa.binary()), pa.array(suffix, pa.binary())], names=names)

    return needed.mapInArrow(run, CUT)


def _matrix(parts: list[bytes], reverse: bool) -> np.ndarray:
    """Rows of bytes (reversed if asked), padded with zeros."""
    size = np.array([len(x) for x in parts])
    out = np.zeros((len(parts), max(1, int(size.max(initial=0)))), np.uint8)
    flat = np.frombuffer(b"".join(parts), np.uint8)
    row = np.repeat(np.arange(len(parts)), size)
    col = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    out[row, np.repeat(size, size) - 1 - col if reverse else col] = flat
    return out


def _resolve(cut: DataFrame, length: int, every: bool, partitions: int) -> DataFrame:
    """Spans of copies among the stretches that meet, by suffix order."""

    def solve(rows: dict[str, list]) -> pa.RecordBatch:
        meet, doc, tie, lo = (np.array(rows[c], np.int64) for c in ("meet", "doc", "tie", "lo"))
        order = np.lexsort((lo, tie, doc, meet))
        same = np.zeros(len(order), bool)  # the same stretch of rows alike in id and text
        same[1:] = (meet[order][1:] == meet[order][:-1]) & (doc[order][1:] == doc[order][:-1]) & (tie[order][1:] == tie[order][:-1]) & (lo[order][1:] == lo[order][:-1])
        order = order[~same]
        group = np.cumsum(np.concatenate([[True], meet[order][1:] != meet[order][:-1]])) - 1
        shared = np.bincount(group)[group] > 1
        order, group = order[shared], group[shared]
        if not len(order):
            return _rows(0, 0)
        doc, tie, lo = doc[order], tie[order], lo[order]
        low, high, known = (np.array(rows[c])[order] for c in ("low", "high", "known"))
        pick = order.tolist()
        earlier, later = occurrences(group, _matrix([rows["prefix"][i] for i in pick], True), _matrix([rows["suffix"][i] for i in pick], False), low, high, length)
        copy = (earlier | later) & ~known[:, None] if every else earlier
        # runs of windows make spans
        edge = np.diff(np.pad(copy, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        row, first = np.nonzero(edge == 1)
        _, past = np.nonzero(edge == -1)
        return _cover(doc[row], tie[row], lo[row] - (past - 1), lo[row] - first + length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[str, list] = {}
        size, last = 0, None
        for batch in batches:
            cols = {n: c.to_pylist() for n, c in zip(batch.schema.names, batch.columns, strict=True)}
            began = 0
            for i, m in enumerate(cols["meet"]):
                if m != last and size >= SORT_BYTES:  # between two groups
                    for n, c in cols.items():
                        rows.setdefault(n, []).extend(c[began:i])
                    yield solve(rows)
                    rows, size, began = {}, 0, i
                last = m
                size += len(cols["prefix"][i]) + len(cols["suffix"][i])
            for n, c in cols.items():
                rows.setdefault(n, []).extend(c[began:])
        if rows and rows["meet"]:
            yield solve(rows)

    return cut.repartition(partitions, "meet").sortWithinPartitions("meet").mapInArrow(run, SCAN)


def _key() -> tuple[Column, Column]:
    """What tells rows apart: the id (of a null one, a number above usual ids that the text gives), and a hash of
    the text."""
    text = F.col("text").cast("string")
    given = F.shiftrightunsigned(F.xxhash64(text), 3) + F.lit(1 << 62)
    return F.coalesce(F.col("doc_id").cast("long"), given), F.hash(text)


def _bodies(docs: DataFrame) -> DataFrame:
    doc, tie = _key()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), doc.alias("doc"), tie.alias("tie"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("body"))


def copied_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, mode: str = "all") -> DataFrame:
    """SPANS: byte spans of copies, one row for each document that has any; they may touch or overlap."""
    every = mode == "all"
    n = parallelism(docs.sparkSession, docs)
    body = _bodies(docs).drop("doc_id")
    doc, tie = _key()
    text = docs.select(doc.alias("doc"), tie.alias("tie"), F.col("text").cast("string").alias("text"))
    settled = materialize(_settle(_scan(text, length, gram, every, n), length, every, n), "suffix-settled")
    asked = settled.where("kind = 1").groupBy("doc", "tie").agg(F.collect_list("block").alias("blocks"))
    needed = body.join(asked, ["doc", "tie"]).select("doc", "tie", "body", "blocks")
    found = _resolve(_cut_out(needed, length, gram), length, every, n)
    names = ["doc", "tie", "los", "his"]
    spans = settled.where("kind = 0").select(*names).unionByName(found.select(*names))
    return spans.groupBy("doc", "tie").agg(F.flatten(F.collect_list("los")).alias("los"), F.flatten(F.collect_list("his")).alias("his"))


def copies(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, mode: str = "all") -> DataFrame:
    """doc_id, body (binary), los, his (null: none) for every row. Both uses of the bodies here share one
    shuffle of them."""
    return _bodies(docs).join(copied_spans(docs, length, gram, mode), ["doc", "tie"], "left").select("doc_id", "body", "los", "his")


def _merged(los: list[int] | None, his: list[int] | None) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for lo, hi in sorted(zip(los or (), his or (), strict=True)):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(hi, out[-1][1])
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for body, los, his in zip(batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                data = memoryview(body.as_buffer())
                spans = _merged(los, his)
                sha, at = hashlib.sha256(), 0
                for lo, hi in spans:
                    sha.update(data[at:lo])
                    at = hi
                sha.update(data[at:])
                for c, x in zip(out, (len(data), sum(b - a for a, b in spans), len(spans), sha.hexdigest()), strict=True):
                    c.append(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return found.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_later(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``docs`` with later copies cut out of ``text`` (whole characters only) and ``n_chars``, if there, of
    what is left. All rows stay."""
    found = copied_spans(docs, length, gram, "later")
    at, schema = docs.columns.index("text"), docs.schema
    count = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def whole(data: bytes, lo: int, hi: int) -> tuple[int, int]:
        while lo < hi and data[lo] & 0xC0 == 0x80:
            lo += 1
        while hi > lo and hi < len(data) and data[hi] & 0xC0 == 0x80:
            hi -= 1
        return lo, hi

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for i, (los, his) in enumerate(zip(batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True)):
                if los:
                    data = texts[i].encode()
                    kept, last = [], 0
                    for lo, hi in (whole(data, *s) for s in _merged(los, his)):
                        kept.append(data[last:lo])
                        last = hi
                    texts[i] = b"".join([*kept, data[last:]]).decode()
            cols = list(batch.columns[:-2])
            cols[at] = pa.array(texts, pa.string())
            if count is not None:
                cols[count] = pa.array([None if t is None else len(t) for t in texts], pa.int64()).cast(cols[count].type)
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    names = [F.col(f"`{c}`") for c in docs.columns]
    own = {c: free_name(docs, c) for c in ("doc", "tie", "los", "his")}
    found = found.select(*(F.col(c).alias(n) for c, n in own.items()))
    doc, tie = _key()
    keyed = docs.withColumns({own["doc"]: doc, own["tie"]: tie})
    joined = keyed.join(found, [own["doc"], own["tie"]], "left").select(*names, own["los"], own["his"])
    return joined.mapInArrow(run, schema)
