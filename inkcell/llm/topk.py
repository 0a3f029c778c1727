"""Exact top-k inner products of integer vectors.

Candidates are sorted by length, longest first, dealt out by range and packed in chunks; queries are packed in
blocks of like lengths. A query's k-th best score so far, first among the longest vectors of all, is a bar that
only rises. By Cauchy-Schwarz a chunk can be passed over by a whole block when the product of their greatest
lengths is below its least bar, so such pairs are never joined. In a pair, both sides are rotated by the
singular vectors of a bounded sample, the product over the leading coordinates is taken, and the product of the
lengths of what remains bounds the rest. Survivors are scored in whole numbers: in floats where every sum is
below 2 ** 53, else in 64-bit integers, and where these could overflow in Python's. Float bounds are widened by
their rounding error, so no candidate that could score is passed over. A task hands on k rows a query, which
meet by query. Blocks and chunks meet by a join on the bound alone: Spark broadcasts the smaller side if its
size allows, else it reads both sides a partition at a time. The plan doesn't grow with the queries.

Vectors that are null, empty, or hold null or non-finite components take no part, nor do rows with a null
id. Vectors of unlike lengths are compared as if padded with zeros. Ties go to the smaller id; repeated ids
are candidates of their own, except that a query never meets its own id, and a repeated query id has the
candidates of all its rows. A component or score beyond 64 bits is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, parallelism

SCALE = 256
#: Rows of the sample that the rotation is fitted on, queries of a block, candidates of a chunk, and blocks that
#: a task keeps open.
FIT_ROWS = 4096
BLOCK = 4096
CHUNK = 2048
OPEN = 16

OUT = "query_id long, vec_id long, score long"
PACKED = "pack long, reach double, bar double, ids binary, vectors binary, bars binary, bytes int"


def scaled(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, v array<long>, norm: floor(scale * x) of every usable vector."""
    x = F.col("embedding")
    fit = F.col("vec_id").isNotNull() & x.isNotNull() & (F.size(x) > 0)
    whole = F.expr("forall(embedding, x -> x is not null and not isnan(x) and abs(double(x)) < double('Infinity'))")
    v = F.expr(f"transform(embedding, x -> bigint(floor(double(x) * {scale})))")
    out = vectors.where(fit & whole).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    return out.withColumn("norm", F.expr("sqrt(aggregate(v, 0D, (s, x) -> s + double(x) * double(x)))"))


def matrix(lists, width: int) -> np.ndarray:
    out = np.zeros((len(lists), width), np.int64)
    for i, x in enumerate(lists):
        out[i, : len(x)] = x
    return out


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best of one query: highest score, then smallest id."""
    return np.lexsort((ids, -scores))[:k]


class Side:
    """Whole vectors, their lengths, and their rotation: ``lead`` leading coordinates and the length of the rest."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, rotation: np.ndarray) -> None:
        self.ids, self.whole, self.lead = ids, vectors, max(1, len(rotation) // 4)
        self.plain = vectors.astype(np.float64)
        self.norm = np.sqrt((self.plain * self.plain).sum(1))
        self.turned = self.plain @ rotation
        self.rest = np.sqrt((self.turned[:, self.lead :] ** 2).sum(1))


def scores(q: Side, v: Side, rows: np.ndarray, cols: np.ndarray | None = None) -> np.ndarray:
    """Exact products of query rows with candidate columns (pairs), or with all candidates."""
    most = float(q.norm.max(initial=0) * v.norm.max(initial=0))
    if most < 2.0**52:  # every partial sum is a whole number that floats hold
        s = q.plain[rows] @ v.plain.T if cols is None else np.einsum("ij,ij->i", q.plain[rows], v.plain[cols])
        return np.rint(s).astype(np.int64)
    kind = np.int64 if most < 2.0**62 else object
    a, b = q.whole[rows].astype(kind), v.whole.astype(kind)
    return (a @ b.T if cols is None else (a * b[cols]).sum(1)).astype(np.int64)


class Block:
    """Queries with their bars and the best candidates known so far."""

    def __init__(self, queries: Side, bars: np.ndarray, k: int) -> None:
        self.q, self.bars, self.k = queries, bars.copy(), k
        self.top_i = [np.zeros(0, np.int64) for _ in bars]
        self.top_s = [np.zeros(0, np.int64) for _ in bars]

    def meet(self, v: Side) -> None:
        q, lead, bars, k = self.q, self.q.lead, self.bars, self.k
        longest = float(v.norm.max(initial=0))
        # rounding of sums of products of these sizes, with room to spare
        slack = 1e-9 * (1 + q.norm * longest)
        active = np.flatnonzero(q.norm * longest + slack >= bars)
        for at in range(0, len(active), 512):
            a = active[at : at + 512]
            bound = q.turned[a, :lead] @ v.turned[:, :lead].T + np.outer(q.rest[a], v.rest) + slack[a, None]
            keep = bound >= bars[a, None]
            rows, cols = np.nonzero(keep)
            if not len(rows):
                continue
            s = scores(q, v, a)[rows, cols] if len(rows) > keep.size // 8 else scores(q, v, a[rows], cols)
            ok = (v.ids[cols] != q.ids[a[rows]]) & (s >= (bars - slack)[a[rows]])
            rows, cols, s = rows[ok], cols[ok], s[ok]
            for r, lo, hi in zip(*_runs(rows), strict=True):
                i = a[r]
                both_i, both_s = np.concatenate([self.top_i[i], v.ids[cols[lo:hi]]]), np.concatenate([self.top_s[i], s[lo:hi]])
                order = best(both_s, both_i, k)
                self.top_i[i], self.top_s[i] = both_i[order], both_s[order]
                if len(order) == k:
                    bars[i] = max(bars[i], float(self.top_s[i][-1]))

    def rows(self) -> pa.RecordBatch:
        size = [len(x) for x in self.top_i]
        none = np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(self.q.ids, size), pa.int64()), pa.array(np.concatenate([*self.top_i, none]), pa.int64()), pa.array(np.concatenate([*self.top_s, none]), pa.int64())], names=["query_id", "vec_id", "score"])


def _runs(x: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    if not len(x):
        return [], [], []
    cut = np.concatenate([[0], np.flatnonzero(np.diff(x)) + 1, [len(x)]])
    return x[cut[:-1]].tolist(), cut[:-1].tolist(), cut[1:].tolist()


def _packed(ids: np.ndarray, vectors: np.ndarray, bars: np.ndarray) -> pa.RecordBatch:
    """One row of PACKED; its number is free, but of no other pack."""
    norm = np.sqrt((vectors.astype(np.float64) ** 2).sum(1))
    small = np.abs(vectors.astype(np.float64)).max(initial=0) < 2.0**31
    data = vectors.astype("<i4" if small else "<i8").tobytes()
    kinds = [pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.binary(), pa.binary(), pa.int32()]
    one = [int(np.random.SeedSequence().generate_state(1, np.uint64)[0] >> 1), float(norm.max()), float(bars.min()), ids.astype("<i8").tobytes(), data, bars.astype("<f8").tobytes(), 4 if small else 8]
    return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(one, kinds, strict=True)], names=[x.split()[0] for x in PACKED.split(", ")])


def _unpacked(ids: bytes, vectors: bytes, size: int) -> tuple[np.ndarray, np.ndarray]:
    n = len(ids) // 8
    return np.frombuffer(ids, "<i8"), np.frombuffer(vectors, f"<i{size}").reshape(n, -1).astype(np.int64)


def _chunks(rows: DataFrame, width: int, size: int) -> DataFrame:
    """PACKED candidates, in the order of the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                ids, v = (batch.column(c).slice(at, size) for c in (0, 1))
                yield _packed(ids.to_numpy(zero_copy_only=False), matrix(v.to_pylist(), width), np.zeros(1))

    return rows.select("vec_id", "v").mapInArrow(run, PACKED)


def _blocks(chunks: DataFrame, every: int, head: Side, rotation, k: int, size: int) -> DataFrame:
    """PACKED queries with their bars among the head."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        top, turn = shared.value

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                ids, v = (np.concatenate(x) for x in zip(*held, strict=True))
                held.clear()
                for at in range(0, len(ids), size):
                    q = Side(ids[at : at + size], v[at : at + size], turn)
                    bars = np.full(len(q.ids), -np.inf)
                    for a in range(0, len(q.ids), 512):
                        s = scores(q, top, np.arange(a, min(a + 512, len(q.ids)))).astype(np.float64)
                        s[top.ids[None, :] == q.ids[a : a + 512, None]] = -np.inf
                        if s.shape[1] >= k:
                            bars[a : a + 512] = np.partition(s, -k, axis=1)[:, -k]
                    yield _packed(q.ids, q.whole, bars)

        for batch in batches:
            for i in range(batch.num_rows):
                ids, v = _unpacked(*(batch.column(c)[i].as_py() for c in (0, 1, 2)))
                some = ids % every == 0
                if some.any():
                    held.append((ids[some], v[some]))
                if sum(len(x) for x, _ in held) >= size:
                    yield from flush()
        yield from flush()

    shared = chunks.sparkSession.sparkContext.broadcast((head, rotation))
    return chunks.select("ids", "vectors", "bytes").mapInArrow(run, PACKED)


def _search(pairs: DataFrame, rotation, k: int) -> DataFrame:
    """OUT: the best candidates of every query in each task's pairs of a block and a chunk."""
    shared = pairs.sparkSession.sparkContext.broadcast(rotation)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = shared.value
        blocks: dict[int, Block] = {}
        sides: dict[int, Side] = {}  # the last chunk only
        for batch in batches:
            for i in range(batch.num_rows):
                r = {n: batch.column(j)[i] for j, n in enumerate(batch.schema.names)}
                b, c = r["block"].as_py(), r["pack"].as_py()
                if c not in sides:
                    sides.clear()
                    sides[c] = Side(*_unpacked(*(r[x].as_py() for x in ("ids", "vectors", "bytes"))), turn)
                if b not in blocks:
                    if len(blocks) >= OPEN:
                        yield blocks.pop(next(iter(blocks))).rows()
                    blocks[b] = Block(Side(*_unpacked(*(r[x].as_py() for x in ("q_ids", "q_vectors", "q_bytes"))), turn), np.frombuffer(r["q_bars"].as_py(), "<f8"), k)
                blocks[b].meet(sides[c])
        for b in blocks.values():
            yield b.rows()

    return pairs.mapInArrow(run, OUT)


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = SCALE, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows of each row whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    usable = scaled(vectors, scale)
    about = usable.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    n, width = about["n"], about["width"] or 1
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    sorted_rows = usable.repartitionByRange(parallelism(spark), F.col("norm").desc(), F.col("vec_id")).sortWithinPartitions(F.col("norm").desc(), "vec_id")
    chunks = materialize(_chunks(sorted_rows, width, chunk), "topk-chunks")
    # bounded samples: about FIT_ROWS rows, chosen by a hash; the chunk of the longest vectors
    share = int(min(1.0, FIT_ROWS / n) * (1 << 30))
    fit = matrix([r["v"] for r in usable.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < share + 1).select("v").limit(2 * FIT_ROWS).collect()], width).astype(np.float64)
    rotation = np.linalg.svd(fit.T @ fit)[0] if len(fit) else np.eye(width)
    top = chunks.orderBy(F.col("reach").desc()).limit(1).first()
    head = Side(*_unpacked(top["ids"], top["vectors"], top["bytes"]), rotation)
    queries = materialize(_blocks(chunks, every, head, rotation, k, block), "topk-blocks")
    asked = queries.select(F.col("pack").alias("block"), F.col("reach").alias("q_reach"), "bar", *(F.col(c).alias(f"q_{c}") for c in ("ids", "vectors", "bars", "bytes")))
    may = F.col("reach") * F.col("q_reach") * (1 + 1e-9) + 1e-9 >= F.col("bar")
    pairs = chunks.drop("bar", "bars").join(asked, may).select("pack", "ids", "vectors", "bytes", "block", "q_ids", "q_vectors", "q_bars", "q_bytes")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = _search(pairs, rotation, k).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
