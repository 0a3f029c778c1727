"""Language identification by prediction by partial matching over bytes.

Each language has a context tree over plain bytes, of variable order up to ``order`` bytes, with every node that
training saw. Counts are gathered over all training texts and then frozen. A byte's probability is its share in the longest context that has seen it,
after an escape (method C: distinct bytes / (occurrences + distinct bytes)) from each longer one that knows the
context but not the byte, down to a uniform order -1. A text's code length in a language is the sum over its
bytes; the least one names the language. A text begins in a context of zero bytes.

Statistics are frozen, so a node's code length with all its escapes is worked out once per worker; a byte is
then found at its longest known context, by hash. Workers hold the depths that have at most ``nodes`` nodes over
all languages. If deeper ones have more, they stay in a table, and the code lengths of the strings that training
saw most often, ``nodes`` at most, are worked out over it and sent to the workers; the other strings of a text
meet the deeper nodes in a shuffle, on the context that both end in. Code lengths are whole numbers of 2 ** -22
bits, so either way gives the same sums.

A null text or a text without a letter is ``und`` with score 0, as is any text if nothing was learned. Empty
tables give empty results. Rows with null text or language teach nothing. Ties go to the first language by
name.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, crc32_column, discard, give_back, materialize, mix, text_slices

ORDER = 4
#: Nodes of a depth over all languages that the driver and the workers hold; a depth with more stays in a table.
NODES = 1 << 19
#: Distinct strings that a counting task holds before it hands them on.
HELD = 1 << 20
#: Bytes that are scored at a time.
SCORED = 1 << 18
#: Rows of nodes and strings that meet at a time.
JOINED = 1 << 17
#: Units of code length in a bit.
BIT = 1 << 22
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = True


def strings(data: np.ndarray, offsets: np.ndarray, order: int) -> np.ndarray:
    """Of every byte, it and the ``order`` bytes before it in its text as a number, the byte itself lowest."""
    padded = np.concatenate([np.zeros(8, np.uint8), data])
    out = np.ndarray(len(data), np.dtype(">u8"), padded, offset=1, strides=(1,)).astype(U64) & U64((1 << 8 * (order + 1)) - 1)
    starts, ends = offsets[:-1], offsets[1:]
    for d in range(order):
        at = (starts + d)[starts + d < ends]
        out[at] &= U64((1 << 8 * (d + 1)) - 1)
    return out


def count_strings(docs: DataFrame, order: int) -> DataFrame:
    """(label, string, n) over all rows of ``docs`` (label, text); summed in each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for label, (g, n) in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([label] * len(g), pa.string()), pa.array(g.astype(np.int64)), pa.array(n)], names=["label", "string", "n"])
            held.clear()

        for batch in batches:
            for part, data, offsets in text_slices(batch):
                if not len(data):
                    continue
                all_ = strings(data, offsets, order)
                labels = np.array(part.column(0).to_pylist(), object)
                for label in sorted(set(labels)):
                    mine = labels == label
                    g, n = np.unique(all_ if mine.all() else all_[np.repeat(mine, np.diff(offsets))], return_counts=True)
                    if label in held:
                        both = np.concatenate([held[label][0], g])
                        order_ = np.argsort(both, kind="stable")
                        both, n = both[order_], np.concatenate([held[label][1], n])[order_]
                        first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])) if len(both) else np.zeros(0, np.int64)
                        g, n = both[first], np.add.reduceat(n, first) if len(first) else n
                    held[label] = g, n
                if sum(len(g) for g, _ in held.values()) > HELD:
                    yield from out()
        yield from out()

    known = docs.where("label is not null and text is not null").select("label", "text")
    return known.mapInArrow(run, "label string, string long, n long").groupBy("label", "string").agg(F.sum("n").alias("n"))


class Finder:
    """Places of numbers by open hashing."""

    def __init__(self, keys: np.ndarray) -> None:
        self.bits = max(4, int(2 * len(keys) + 1).bit_length())
        self.keys = np.full(1 << self.bits, ~U64(0))
        self.at = np.full(1 << self.bits, -1, np.int32)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.at[slot] < 0
            self.keys[slot[free]], self.at[slot[free]] = keys[left[free]], left[free]  # of several the last stays
            lost = self.at[slot] != left
            left, slot = left[lost], (slot[lost] + 1) & ((1 << self.bits) - 1)

    def _slot(self, x: np.ndarray) -> np.ndarray:
        return (mix(x) >> U64(64 - self.bits)).astype(np.int64)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Place of each number among the keys, or -1."""
        slot = self._slot(x)
        out = self.at[slot]
        left = np.flatnonzero((out >= 0) & (self.keys[slot] != x))
        slot = slot[left]
        while len(left):
            slot = (slot + 1) & ((1 << self.bits) - 1)
            found = self.at[slot]
            out[left] = found
            more = (found >= 0) & (self.keys[slot] != x[left])
            left, slot = left[more], slot[more]
        return out


def units(p: np.ndarray) -> np.ndarray:
    """Code lengths of probabilities."""
    return np.rint(-np.log2(p) * BIT).astype(np.int32)


class Tables:
    """Code lengths of all nodes and escapes of all contexts, by depth, for every language. ``trees`` are of the
    depths that follow those of ``under``."""

    def __init__(self, trees: list[list[tuple[np.ndarray, np.ndarray]]], labels: int, under: Tables | None = None) -> None:
        self.labels = labels
        self.nodes: list[tuple[Finder, np.ndarray]] = [*under.nodes] if under else []
        self.contexts: list[tuple[Finder, np.ndarray]] = [*under.contexts] if under else []
        for depth, tree in enumerate(trees, len(self.nodes)):
            every = np.unique(np.concatenate([g for g, _ in tree]))
            above = np.unique(every >> U64(8))
            escape = np.zeros((labels, len(above) + 1), np.int32)  # the last: a context that is not known
            bits = self.lengths(every & U64((1 << 8 * depth) - 1), depth - 1).T.copy()
            for k, (g, n) in enumerate(tree):
                context = np.searchsorted(above, g >> U64(8))
                total = np.bincount(context, n, len(above))
                kinds = np.bincount(context, minlength=len(above))
                whole = np.maximum(total + kinds, 1)
                escape[k, :-1] = np.where(kinds > 0, units(np.maximum(kinds, 1) / whole), 0)
                bits[k] += escape[k][np.searchsorted(above, every >> U64(8))]
                bits[k, np.searchsorted(every, g)] = units(n / whole[context])
            self.nodes.append((Finder(every), bits))
            self.contexts.append((Finder(above), escape))

    def lengths(self, g: np.ndarray, depth: int) -> np.ndarray:
        """(strings, languages): length of the last byte of each string behind the ``depth`` bytes before it."""
        out = np.zeros((len(g), self.labels), np.int32)
        left = np.arange(len(g))
        for d in range(depth, -1, -1):
            find, bits = self.nodes[d]
            now = g[left] & U64((1 << 8 * (d + 1)) - 1)
            at = find(now)
            hit = at >= 0
            out[left[hit]] += bits.T[at[hit]]
            left, now = left[~hit], now[~hit]
            if not len(left):
                return out
            find, escape = self.contexts[d]
            out[left] += escape.T[find(now >> U64(8))]
        out[left] += 8 * BIT
        return out


#: What a worker made last of what it was sent: one entry.
_MADE: dict[str, Tables | Finder] = {}


def made(key: str, make: Callable[[], Tables | Finder]) -> Tables | Finder:
    if key not in _MADE:
        _MADE.clear()
        _MADE[key] = make()
    return _MADE[key]


def sums(offsets: np.ndarray, labels: int, lengths: Callable[[int, int], np.ndarray]) -> np.ndarray:
    """(texts, languages): the rows of ``lengths(first, end)``, one a byte, added up over every text."""
    total = np.zeros((len(offsets) - 1, labels), np.int64)
    for at in range(0, int(offsets[-1]), SCORED):
        part = lengths(at, min(at + SCORED, int(offsets[-1])))
        first = int(np.searchsorted(offsets, at, "right")) - 1
        last = int(np.searchsorted(offsets, at + len(part), "left"))
        cut = np.maximum(offsets[first:last] - at, 0)
        full = np.flatnonzero(np.minimum(offsets[first + 1 : last + 1] - at, len(part)) > cut)
        total[first + full] += np.add.reduceat(part, cut[full], axis=0, dtype=np.int64)
    return total


class Model:
    """Frozen counts of the nodes of the first depths, and the table of all nodes if there are deeper ones
    (``rest``; workers don't get it). The tables are made once in each worker."""

    def __init__(self, labels: list[str], trees: list[list[tuple[np.ndarray, np.ndarray]]], order: int, nodes: int = NODES, rest: DataFrame | None = None) -> None:
        self.key, self.labels, self.trees, self.order, self.nodes, self.rest = uuid.uuid4().hex, labels, trees, order, nodes, rest

    def __getstate__(self) -> dict:
        return {**self.__dict__, "rest": None}

    def tables(self) -> Tables:
        return made(self.key, lambda: Tables(self.trees, len(self.labels)))

    def bits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code length in bits of every text in every language: (texts, languages). For models without a rest."""
        if len(self.trees) <= self.order:
            raise ValueError("deeper nodes are in a table: use identify")
        tables, all_ = self.tables(), strings(data, offsets, self.order)
        return sums(offsets, len(self.labels), lambda at, to: tables.lengths(all_[at:to], self.order)) / BIT


def plant(depths: range, labels: int, depth: np.ndarray, label: np.ndarray, g: np.ndarray, n: np.ndarray) -> list[list[tuple[np.ndarray, np.ndarray]]]:
    """Of each depth and language the strings in order and their counts."""
    trees = []
    for d in depths:
        tree = []
        for k in range(labels):
            some = (depth == d) & (label == k)
            by = np.argsort(g[some], kind="stable")
            tree.append((g[some][by].astype(U64), n[some][by].astype(np.float64)))
        trees.append(tree)
    return trees


def coded(names: pa.ChunkedArray, labels: list[str]) -> np.ndarray:
    """Places of names among the labels; -1 for null."""
    return pc.fill_null(pc.index_in(names, value_set=pa.array(labels, names.type)), -1).to_numpy()


def train(docs: DataFrame, order: int = ORDER, nodes: int = NODES) -> Model:
    """Learn from (label, text). All nodes count. Depths of at most ``nodes`` nodes over the languages (the first
    in any case) are brought to the driver, the others stay in a table."""
    counted = count_strings(docs, order)
    deep = counted.select("label", "n", F.explode(F.array(*(F.struct(F.lit(d).alias("depth"), F.col("string").bitwiseAND(F.lit((1 << 8 * (d + 1)) - 1)).alias("string")) for d in range(order + 1)))).alias("x"))
    every = materialize(deep.groupBy("label", "x.depth", "x.string").agg(F.sum("n").alias("n")), "ppm-nodes")
    found = every.groupBy("label", "depth").count().collect()
    labels = sorted({r["label"] for r in found})
    if not labels:
        discard(every)
        return Model([], [], order)
    # a deeper depth never has fewer nodes
    whole = max(1, sum(sum(r["count"] for r in found if r["depth"] == d) <= nodes for d in range(order + 1)))
    kept = every.where(F.col("depth") < whole).select("label", "depth", "string", "n").toArrow()
    trees = plant(range(whole), len(labels), kept.column(1).to_numpy(), coded(kept.column(0), labels), kept.column(2).to_numpy(), kept.column(3).to_numpy())
    if whole > order:
        discard(every)
        return Model(labels, trees, order, nodes)
    return Model(labels, trees, order, nodes, every)


def rows_of(values: np.ndarray) -> pa.ListArray:
    """A list for each row of a matrix."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]), pa.array(values.ravel()))


def matrix(lists: pa.ChunkedArray | pa.ListArray, width: int) -> np.ndarray:
    return pc.list_flatten(lists).to_numpy().reshape(-1, width)


def meet(asked: DataFrame, model: Model) -> DataFrame:
    """(id, bits) for ``asked`` (id, string, n): code lengths of the strings, n times each, added up by id as far as
    a task reads them together. Nodes that are not in memory and the strings that can reach them end, before
    their last byte, in the same bytes, as many as there are depths in memory."""
    shared = asked.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, held, rows = shared.value, [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows < JOINED or batch.column(0)[-1] == held[0].column(0)[0]:
                continue
            table = pa.Table.from_batches(held)
            key = table.column(0).to_numpy()
            cut = int(np.searchsorted(key, key[-1]))  # the last key may go on
            yield from answer(m, table.slice(0, cut))
            held, rows = table.slice(cut).to_batches(), table.num_rows - cut
        if rows:
            yield from answer(m, pa.Table.from_batches(held))
        give_back()

    def key(string: str):
        return F.shiftright(string, 8).bitwiseAND(F.lit((1 << 8 * len(model.trees)) - 1)).alias("key")

    nodes = model.rest.where(F.col("depth") >= len(model.trees)).select(key("string"), F.lit(None).cast("long").alias("id"), "label", "depth", "string", "n")
    wanted = asked.select(key("string"), "id", F.lit(None).cast("string").alias("label"), F.lit(None).cast("int").alias("depth"), "string", "n")
    return nodes.unionByName(wanted).repartition("key").sortWithinPartitions("key").mapInArrow(run, "id long, bits array<long>")


def answer(m: Model, table: pa.Table) -> Iterator[pa.RecordBatch]:
    """(id, bits) of the rows with an id, by the nodes of the others."""
    ask = pc.is_valid(table.column("id")).to_numpy()
    if not ask.any():
        return
    g, n, depth = table.column("string").to_numpy(), table.column("n").to_numpy(), pc.fill_null(table.column("depth"), -1).to_numpy()
    trees = plant(range(len(m.trees), m.order + 1), len(m.labels), depth, coded(table.column("label"), m.labels), g, n)
    g, at = np.unique(g[ask].astype(U64), return_inverse=True)
    lengths = Tables(trees, len(m.labels), m.tables()).lengths(g, m.order)
    who = pc.drop_null(table.column("id")).to_numpy()
    by = np.argsort(who, kind="stable")
    who = who[by]
    first = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]]))
    total = np.add.reduceat(lengths[at[by]] * n[ask][by].astype(np.int64)[:, None], first, axis=0)
    yield pa.RecordBatch.from_arrays([pa.array(who[first]), rows_of(total)], names=["id", "bits"])


def frequent(model: Model) -> tuple[np.ndarray, np.ndarray]:
    """The longest strings that training saw most often, ``nodes`` at most, and their code lengths."""
    seen = model.rest.where(F.col("depth") == model.order).groupBy("string").agg(F.sum("n").alias("n")).withColumn("size", F.floor(F.log2("n") * 16).cast("int"))
    total, bar = 0, 1 << 20
    for r in sorted(seen.groupBy("size").count().collect(), key=lambda r: -r["size"]):  # at most 1,024 sizes
        total += r["count"]
        if total > model.nodes:
            break
        bar = r["size"]
    got = meet(seen.where(F.col("size") >= bar).select(F.col("string").alias("id"), "string", F.lit(1).cast("long").alias("n")), model).toArrow()
    return got.column(0).to_numpy().astype(U64), matrix(got.column(1), len(model.labels)).astype(np.int32)


def lettered(part: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text has a letter."""
    total = np.concatenate([[0], np.cumsum(LETTER[data])])
    out = total[offsets[1:]] > total[offsets[:-1]]
    for i in np.flatnonzero(~out & (np.diff(offsets) > 0)):
        out[i] = any(map(str.isalpha, part.column(1)[int(i)].as_py()))
    return out


def verdict(labels: list[str], ids: pa.Array, bits: np.ndarray, letter: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
    """Of texts with a letter the language of the least code length, its posterior and its bits a byte."""
    n = len(ids)
    pred, score, rate = np.full(n, "und", object), np.zeros(n), np.zeros(n)
    if letter.any():
        best = bits.argmin(1)
        gap = np.minimum((bits - bits.min(1, keepdims=True)) * np.log(2), 700)
        pred[letter] = np.array(labels, object)[best[letter]]
        score[letter] = (1 / np.exp(-gap).sum(1))[letter]
        rate[letter] = bits[np.arange(n), best][letter] / size[letter]
    return pa.RecordBatch.from_arrays([ids, pa.array(pred, pa.string()), pa.array(score), pa.array(rate)], names=["doc_id", "lang_pred", "score", "bits_per_byte"])


SCORES = "doc_id long, lang_pred string, score double, bits_per_byte double"


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score (posterior under equal priors), bits_per_byte of the best language. For a model with
    a rest, what needs that table is done when this returns."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if model.rest is not None:
        return identify_by_table(docs, model)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part, data, offsets in text_slices(batch):
                letter = lettered(part, data, offsets) & bool(m.labels)
                yield verdict(m.labels, part.column(0), m.bits(data, offsets) if letter.any() else np.zeros((len(letter), 1)), letter, np.diff(offsets))

    return docs.mapInArrow(run, SCORES)


def identify_by_table(docs: DataFrame, model: Model) -> DataFrame:
    """``identify`` for a model with a rest: frequent strings by their code lengths in memory, others in a shuffle."""
    spark, labels, order, key = docs.sparkSession, model.labels, model.order, uuid.uuid4().hex
    shared = spark.sparkContext.broadcast(frequent(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, bits = shared.value
        find, uid = made(key, lambda: Finder(keys)), TaskContext.get().partitionId() << 33
        for batch in batches:
            for part, data, offsets in text_slices(batch):
                all_, rare, n = strings(data, offsets, order), [], part.num_rows

                def lengths(first: int, end: int) -> np.ndarray:
                    at = find(all_[first:end])
                    lost = np.flatnonzero(at < 0)
                    rare.append(first + lost)
                    if not len(lost):
                        return bits[at]
                    out = np.zeros((len(at), len(labels)), np.int32)
                    out[at >= 0] = bits[at[at >= 0]]
                    return out

                total = sums(offsets, len(labels), lengths)
                mine = pa.array(np.arange(uid, uid + n))
                yield pa.RecordBatch.from_arrays([mine, part.column(0), pa.array(np.diff(offsets)), pa.array(lettered(part, data, offsets)), rows_of(total), *[pa.nulls(n, pa.int64())] * 2], names=names)
                rare = np.concatenate([np.zeros(0, np.int64), *rare])
                if len(rare):
                    text, g = np.searchsorted(offsets, rare, "right") - 1, all_[rare]
                    by = np.lexsort((g, text))
                    text, g = text[by], g[by]
                    first = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (g[1:] != g[:-1])]))
                    k = len(first)
                    yield pa.RecordBatch.from_arrays([pa.array(uid + text[first]), *(pa.nulls(k, t) for t in (pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int64()))), pa.array(g[first].astype(np.int64)), pa.array(np.diff(first, append=len(g)))], names=names)
                uid += n

    names = ["uid", "doc_id", "size", "letter", "bits", "string", "n"]
    scored = materialize(docs.mapInArrow(run, "uid long, doc_id long, size long, letter boolean, bits array<long>, string long, n long"), "ppm-scored")
    met = meet(scored.where("string is not null").select(F.col("uid").alias("id"), "string", "n"), model)
    more = materialize(met.groupBy(F.col("id").alias("uid")).agg(F.array(*(F.sum(F.col("bits")[k]) for k in range(len(labels)))).alias("more")), "ppm-rare")
    both = scored.where("string is null").join(more, "uid", "left")

    def end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield verdict(labels, batch.column(0), matrix(batch.column(3), len(labels)) / BIT, batch.column(2).to_numpy(zero_copy_only=False), batch.column(1).to_numpy())

    whole = F.when(F.col("more").isNull(), F.col("bits")).otherwise(F.zip_with("bits", "more", lambda a, b: a + b))
    return both.select("doc_id", "size", "letter", whole.alias("bits")).mapInArrow(end, SCORES)


def fold(name: str, of: int, out: int):
    """True for the rows held out: crc32(id as text) mod ``of`` is ``out``."""
    return F.coalesce(F.pmod(crc32_column(name), F.lit(of)) == out, F.lit(False))


def predict(docs: DataFrame, of: int = 4, out: int = 2, order: int = ORDER) -> DataFrame:
    held = fold("doc_id", of, out)
    model = train(docs.where(~held).select(F.col("lang").cast("string").alias("label"), F.col("text").cast("string").alias("text")), order)
    said = identify(docs, model)
    if model.rest is not None:
        discard(model.rest)
    return said.select("doc_id", held.alias("held_out"), "lang_pred", "score", "bits_per_byte")
