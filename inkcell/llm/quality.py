"""Quality classifier: a generalised additive model with pairwise interactions.

Every feature is cut into bins at quantiles. Boosting goes round the features in turn, each time fitting a
shallow tree on that feature's bins to the current residuals and adding it, damped, to the feature's lookup
table; afterwards the pairs of features that explain most of what is left get two-dimensional tables the
same way. A score is the logistic function of the sum of one table entry a feature and a pair, so scoring
is additions over bin numbers.

Features are counted from the bytes of whole texts; a null text counts as empty, and scores as the empty
text does. About ``sample`` labelled rows at most teach (chosen by a hash of their id); labels with a null
id or mark are ignored, repeated ones count once. Without labels of both kinds every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import langid
from .common import U64, materialize, prefix_hash, span_hash, text_slices, words

SAMPLE = 30_000
BINS = 32
PAIR_BINS = 8
ROUNDS = 60
PAIRS = 8
RATE = 0.2

CLASSES = np.full(256, 5, np.int64)  # 0 space, 1 lower, 2 upper, 3 digit, 4 sentence marks, 5 symbols, 6 high bytes, 7 newline
CLASSES[:33] = 0
CLASSES[10] = 7
CLASSES[97:123] = 1
CLASSES[65:91] = 2
CLASSES[48:58] = 3
CLASSES[[ord(c) for c in ".,;:!?'\"-()"]] = 4
CLASSES[128:] = 6
NOT_BLANK = np.ones(256, bool)
NOT_BLANK[:33] = False
NOT_BREAK = np.ones(256, bool)
NOT_BREAK[10] = False

NAMES = ["size", "space", "lower", "upper", "digit", "marks", "symbols", "high", "lines", "words", "word_size", "long_words", "one_char_words", "distinct", "top_word", "twice", "repeat_pairs", "same_lines", "line_words", "ends_symbol", "byte_kinds"]


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, NAMES) as float32."""
    n = len(offsets) - 1
    out = np.zeros((n, len(NAMES)), np.float32)
    size = np.diff(offsets)
    some = np.maximum(size, 1)
    out[:, 0] = np.log1p(size)
    if not len(data):
        return out
    kind = CLASSES[data]
    doc = np.repeat(np.arange(n), size)
    counts = np.bincount(doc * 8 + kind, minlength=8 * n).reshape(n, 8)
    out[:, 1:8] = counts[:, :7] / some[:, None]
    out[:, 8] = counts[:, 7] / some
    starts, ends, first = words(data, offsets, NOT_BLANK)
    prefix = prefix_hash(data)
    h = span_hash(prefix, starts, ends)
    nw = np.diff(first)
    many = np.maximum(nw, 1)
    length = ends - starts
    owner = np.repeat(np.arange(n), nw)
    per = lambda x: np.bincount(owner, weights=x, minlength=n)
    out[:, 9] = np.log1p(nw)
    out[:, 10] = per(length) / many
    out[:, 11] = per(length > 12) / many
    out[:, 12] = per(length == 1) / many
    out[:, 19] = per(CLASSES[data[ends - 1]] == 5) / many if len(ends) else 0
    ls, le, lfirst = words(data, offsets, NOT_BREAK)
    lh = span_hash(prefix, ls, le)
    for i in range(n):
        w = h[first[i] : first[i + 1]]
        if len(w):
            _, c = np.unique(w, return_counts=True)
            out[i, 13] = len(c) / len(w)
            out[i, 14] = c.max() / len(w)
            out[i, 15] = (w[1:] == w[:-1]).mean() if len(w) > 1 else 0
            pair = w[:-1] * U64(3) + w[1:]
            out[i, 16] = 1 - len(np.unique(pair)) / len(pair) if len(pair) else 0
        lines = lh[lfirst[i] : lfirst[i + 1]]
        if len(lines):
            out[i, 17] = 1 - len(np.unique(lines)) / len(lines)
            out[i, 18] = len(w) / len(lines)
    kinds = np.bincount(doc * 256 + data, minlength=256 * n).reshape(n, 256) if n * 256 <= 64 * (len(data) + 4096) else None
    out[:, 20] = (kinds > 0).sum(1) if kinds is not None else [len(np.unique(data[offsets[i] : offsets[i + 1]])) for i in range(n)]
    return out


def _leafs(g: np.ndarray, h: np.ndarray, depth: int, least: float) -> np.ndarray:
    """Values of a shallow tree over ordered bins with gradient and curvature sums."""
    out = np.full(len(g), g.sum() / (h.sum() + 1.0))
    if depth and len(g) > 1:
        cg, ch = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        rg, rh = g.sum() - cg, h.sum() - ch
        gain = np.where((ch >= least) & (rh >= least), cg**2 / (ch + 1) + rg**2 / (rh + 1), -np.inf)
        at = int(gain.argmax())
        if gain[at] > g.sum() ** 2 / (h.sum() + 1) + 1e-9:
            out[: at + 1] = _leafs(g[: at + 1], h[: at + 1], depth - 1, least)
            out[at + 1 :] = _leafs(g[at + 1 :], h[at + 1 :], depth - 1, least)
    return out


def _quarters(g: np.ndarray, h: np.ndarray, least: float) -> tuple[np.ndarray, float]:
    """The best tree of one cut on each of two features: its values and its gain."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    best, where = 0.0, None
    tg, th = cg[-1, -1], ch[-1, -1]
    for i in range(len(g) - 1):
        a_g, a_h = cg[i, :-1], ch[i, :-1]
        parts = [(a_g, a_h), (cg[i, -1] - a_g, ch[i, -1] - a_h), (cg[-1, :-1] - a_g, ch[-1, :-1] - a_h), (tg - cg[i, -1] - cg[-1, :-1] + a_g, th - ch[i, -1] - ch[-1, :-1] + a_h)]
        gain = sum(x**2 / (np.maximum(y, 0) + 1) for x, y in parts)
        j = int(gain.argmax())
        if gain[j] > best:
            best, where = float(gain[j]), (i + 1, j + 1, [x[j] / (max(y[j], 0) + 1) for x, y in parts])
    out = np.zeros_like(g)
    if where:
        i, j, v = where
        out[:i, :j], out[:i, j:], out[i:, :j], out[i:, j:] = v
    return out, best - tg**2 / (th + 1)


class Additive:
    """Tables over bins: one a feature and one for each chosen pair."""

    def __init__(self, width: int) -> None:
        self.edges = [np.zeros(0, np.float32)] * width
        self.tables = [np.zeros(1)] * width
        self.pairs: list[tuple[int, int, np.ndarray]] = []
        self.coarse = [np.zeros(1, np.int64)] * width
        self.base = 0.0

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], 1)

    def raw(self, b: np.ndarray) -> np.ndarray:
        out = np.full(len(b), self.base)
        for j, t in enumerate(self.tables):
            out += t[b[:, j]]
        for i, j, t in self.pairs:
            out += t[self.coarse[i][b[:, i]], self.coarse[j][b[:, j]]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(self.bins(x)), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, pairs: int = PAIRS, rate: float = RATE) -> Additive:
    m = Additive(x.shape[1])
    if not len(y) or y.min() == y.max():
        return m
    for j in range(x.shape[1]):
        m.edges[j] = np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1]).astype(np.float32))
        m.tables[j] = np.zeros(len(m.edges[j]) + 1)
        m.coarse[j] = np.arange(len(m.tables[j])) * PAIR_BINS // max(len(m.tables[j]), PAIR_BINS)
    b = m.bins(x)
    m.base = float(np.log(y.mean() / (1 - y.mean())))
    f, least = np.full(len(y), m.base), 5.0

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-f))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(rounds):
        for j in range(x.shape[1]):
            g, h = slopes()
            k = len(m.tables[j])
            step = rate * _leafs(np.bincount(b[:, j], g, k), np.bincount(b[:, j], h, k), 2, least / 20)
            m.tables[j] += step
            f += step[b[:, j]]
    g, h = slopes()
    c = [m.coarse[j][b[:, j]] for j in range(x.shape[1])]
    width = [int(m.coarse[j].max()) + 1 for j in range(x.shape[1])]

    def grid(i: int, j: int) -> tuple[np.ndarray, float]:
        at, k = c[i] * width[j] + c[j], width[i] * width[j]
        return _quarters(np.bincount(at, g, k).reshape(width[i], -1), np.bincount(at, h, k).reshape(width[i], -1), least)

    gains = sorted(((grid(i, j)[1], i, j) for i in range(x.shape[1]) for j in range(i) if width[i] > 1 and width[j] > 1), reverse=True)[:pairs]
    m.pairs = [(i, j, np.zeros((width[i], width[j]))) for _, i, j in gains]
    for _ in range(rounds // 2):
        for i, j, t in m.pairs:
            g, h = slopes()
            step = rate * grid(i, j)[0]
            t += step
            f += step[c[i], c[j]]
    return m


def featurized(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in text_slices(batch):
                x = features(data, offsets)
                lists = pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.reshape(-1)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, x array<float>")


def predict(docs: DataFrame, labels: DataFrame, of: int = 3, out: int = 1, threshold: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    from .toxicity import sample_labels

    spark = docs.sparkSession
    known = materialize(featurized(docs), "quality")
    # about `sample` ids at most: the broadcast and what is collected are bounded by that parameter
    chosen = F.broadcast(sample_labels(labels, "quality", langid.fold("doc_id", of, out), sample))
    rows = known.join(chosen, "doc_id").groupBy("doc_id").agg(F.min("x").alias("x"), F.max("label").alias("label")).toPandas().sort_values("doc_id")
    x = np.stack(rows["x"].to_list()).astype(np.float32) if len(rows) else np.zeros((0, len(NAMES)), np.float32)
    shared = spark.sparkContext.broadcast(fit(x, (rows["label"].to_numpy() > 0).astype(np.float64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            if batch.num_rows:
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(m.score(x), pa.float64())], names=["doc_id", "score"])

    scored = known.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", langid.fold("doc_id", of, out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
