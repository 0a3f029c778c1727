"""Jaccard join of documents by blocked sparse products of document x n-gram incidence.

Documents with equal shingle sets are one node. Two different sets of similarity t or more differ in at most
(100 - t) / (100 + t) of their summed sizes, so if each is cut by hash into more parts than that, some part
is the same in both: sets that share no part can't link. Parts are cut by size class (a pair spans at most
two), and their 48-bit keys are shuffled, packed in blocks. The sets that share a part are candidates:

- Up to ``FEW`` sets under one key are paired. A pair is turned down, without its n-grams, where the sizes or
  the parity sketches prove it too unlike: each set keeps the parity of its n-grams in 2 to 4 bits an n-gram,
  and two sketches differ in no more bits than the sets do in n-grams.
- More sets under one key, a large group of near copies, are tied to the least of them, each task first
  folding those it has itself, so a hot key arrives as a few rows a task.

The components of pairs and ties are the blocks of the product. In a block the incidence matrix over the
n-grams that occur twice is multiplied with its transpose in strips of columns; a pair is discarded as soon
as what it has and what it can still get stay below the overlap that its sizes ask for. A component of more
than ``block`` nodes, or of too many n-grams, is cut into parts by hash, so no task holds a whole component: a
few parts all meet each other; of more, one part meets each other part, which links most of a group of near
copies, and then only nodes outside the largest class so far meet all the rest. Links found become the final
components.

A null text, or one without words, has an empty set: it is linked with nothing, n_shingles 0. Fewer words
than a shingle make the whole sequence one. Repeated documents link like any others, and so do rows with a
null id; the null id is kept, and a component of such rows alone has a null id. Rows are told apart by a hash
of id and text. Equality of sets is that of a 63-bit digest of the sorted shingle hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, U64, discard, free_name, gram_hashes, materialize, mix, parallelism, text_slices, word_hash, words
from .components import components

KEEP = np.ones(256, bool)
KEEP[9:14] = KEEP[32] = False
#: Nodes and n-grams of a block of the product.
BLOCK = 1024
BLOCK_GRAMS = 4 << 20
STRIP = 4096
#: Parts of a component that all meet each other.
PAIRED = 8
#: Rows of nodes that are broadcast at most, to find their texts without a shuffle of all texts.
BROADCAST_ROWS = 200_000
#: Sets under one key that are paired; more are tied to one of them.
FEW = 4
#: Bytes of text whose n-grams, and whose part keys, a task folds together.
FOLD_BYTES = 16 << 20
KEY_FOLD_BYTES = 6 << 20
#: Buckets of part keys for each partition of a shuffle, as they are sorted in memory.
DEAL = 2
#: N-grams on the list of frequent ones at most, sets of one fold that must hold one, and levels: n-grams of
#: level l are in FREQUENT_FROM * 8 ** (l - 1) sets or more.
FREQUENT = 1 << 20
FREQUENT_FROM = 3
LEVELS = 6


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts end to end, and n+1 offsets."""
    low = LOWER[data]
    starts, ends, first = words(data, offsets, KEEP)
    n = len(offsets) - 1
    if not len(starts):
        return np.zeros(0, U64), np.zeros(n + 1, np.int64)
    h = word_hash(low, starts, ends)
    grams = gram_hashes(h, k)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(grams[a : b - k + 1]))
        elif b > a:
            out.append(mix(gram_hashes(h[a:b], b - a) + U64(b - a)))
        else:
            out.append(np.zeros(0, U64))
    return np.concatenate(out), np.concatenate([[0], np.cumsum([len(x) for x in out])])


class Parts:
    """Size classes and their numbers of parts for links at ``percent``."""

    def __init__(self, percent: int) -> None:
        self.percent, self.bounds, size = percent, [1], 1
        while size < 1 << 40:  # the next class begins where no set of this one's least size can still link
            size = max(size + 1, size * 100 // percent + 1)
            self.bounds.append(size)
        self.lows = np.array(self.bounds)
        tops = self.lows[1:] - 1
        self.differ = np.array([(100 - percent) * 2 * int(x) // (100 + percent) for x in tops])
        spare, least = [], []
        # the least sets of a class's pairs are of the class before
        for low, d in zip([1, *self.lows[:-2].tolist()], self.differ.tolist(), strict=True):
            empty, weak = self._spare(low, d, False), self._spare(low, d, True)
            few = bool(d) and weak <= 1 + d // 2
            spare.append(weak if few else empty)
            least.append(2 if few else 1)
        self.spare, self.least = np.array(spare), np.array(least)
        self.count = self.differ + 1 + self.spare

    @staticmethod
    def _spare(low: int, d: int, single: bool) -> int:
        """Parts beyond d + 1, so that seldom more than these are empty (or hold a single n-gram)."""
        extra = 1
        for _ in range(8 if d else 0):
            m = d + 1 + extra
            short = m * np.exp(-low / m) * (1 + (low / m if single else 0))
            extra = 1 + int(np.ceil(short + 3 * np.sqrt(short)))
        return extra if d else 0

    def keys(self, grams: np.ndarray, offs: np.ndarray, which: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(part keys, index of their text) of the texts ``which``. ``frequent``: sorted hashes, and levels.

        A part is weak if it is empty or, in classes of sets large enough for it, holds a single n-gram. At
        each level pairs agree on at least spare + 1 parts of what is left. If one of them has no more weak
        parts than spare, they agree on a part that isn't weak; if both have more, both go on to the next
        level, where less is left out; at the last nothing is, and such sets show weak parts too.
        """
        known, levels = frequent
        level = np.zeros(len(grams), np.int8)
        if len(known) and len(grams):
            at = np.searchsorted(known, grams)
            at[at == len(known)] = 0
            level = np.where(known[at] == grams, levels[at], 0).astype(np.int8)
        keys, owners = [], []
        for up in (0, 1):
            left = which
            for step in range(LEVELS + 1):
                last = step == LEVELS
                key, owner, left = self._cut(grams, offs, left, up, step, None if last else level <= step, last)
                keys.append(key)
                owners.append(owner)
                if not len(left):
                    break
        return np.concatenate(keys), np.concatenate(owners)

    def _cut(self, grams: np.ndarray, offs: np.ndarray, which: np.ndarray, up: int, step: int, keep: np.ndarray | None, holes_too: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Part keys in the texts' own size class or the next one, their texts, and the texts with more weak
        parts than spare."""
        size = np.diff(offs)
        use = which[size[which] > 0]
        c = np.searchsorted(self.lows, size[use], side="right") - 1 + up
        ok = self.differ[c] > 0
        use, c = use[ok], c[ok]
        if not len(use):
            return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        m = self.count[c]
        first = np.concatenate([[0], np.cumsum(m)])
        n = size[use]
        at = np.repeat(offs[use] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        base, many = np.repeat(first[:-1], n), np.repeat(m, n)
        if keep is not None:
            at, base, many = at[keep[at]], base[keep[at]], many[keep[at]]
        g = grams[at]
        spread = mix(g ^ U64(0x5851F42D4C957F2D)) >> U64(32)
        slot = base + (spread * many.astype(U64) >> U64(32)).astype(np.int64)
        value = mix(g + U64(0x14057B7EF767814F))
        lo = np.bincount(slot, (value & U64(0xFFFFFFFF)).astype(np.float64), first[-1]).astype(U64)
        hi = np.bincount(slot, (value >> U64(32)).astype(np.float64), first[-1]).astype(U64)
        some = np.bincount(slot, minlength=first[-1]) >= np.repeat(self.least[c], m)
        bare = np.add.reduceat(~some, first[:-1]) > self.spare[c]
        show = some | np.repeat(bare, m) if holes_too else some
        part = np.arange(first[-1]) - np.repeat(first[:-1], m)
        key = mix((hi << U64(32)) + lo + mix((np.repeat(c, m) * 1_000_003 + part).astype(U64) * U64(LEVELS + 1) + U64(step)))
        return key[show], np.repeat(use, m)[show], use[bare]


def sketches(grams: np.ndarray, offs: np.ndarray) -> list[bytes]:
    """Parities of the n-grams of each set by hash, 2 to 4 bits an n-gram, 64 at least, a power of two."""
    size = np.diff(offs)
    bits = 1 << np.ceil(np.log2(np.maximum(2 * size, 64))).astype(np.int64)
    first = np.concatenate([[0], np.cumsum(bits)])
    at = np.repeat(first[:-1], size) + (mix(grams ^ U64(0x2545F4914F6CDD1D)) & np.repeat(bits - 1, size).astype(U64)).astype(np.int64)
    packed = np.packbits((np.bincount(at, minlength=int(first[-1])) & 1).astype(np.uint8), bitorder="little").tobytes()
    return [packed[a // 8 : b // 8] for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]


def may_link(n: int, x: bytes, m: int, y: bytes, percent: int) -> bool:
    """False only if sets of n and m n-grams with these sketches can't be similar by ``percent``."""
    if 100 * min(n, m) < percent * max(n, m):
        return False
    a, b = np.frombuffer(x, U64), np.frombuffer(y, U64)
    if len(a) < len(b):
        a, b = b, a
    if len(a) > len(b):
        a = np.bitwise_xor.reduce(a.reshape(-1, len(b)), axis=0)
    return int(np.bitwise_count(a ^ b).sum()) * (100 + percent) <= (100 - percent) * (n + m)


OWN = "kind int, doc_id long, row long, n long, node long, sketch binary, gram long"


def _plain(docs: DataFrame) -> DataFrame:
    """doc_id, row (a hash of id and text), text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")).alias("row"), F.col("text").cast("string").alias("text"))


def _survey(docs: DataFrame, k: int) -> DataFrame:
    """kind 0: doc_id, row, n, node of every document; kind 1: node, n, row, sketch of every set a fold meets;
    kind 2: an n-gram that several sets of a fold hold, and how many (n)."""
    kinds = {"doc_id": pa.int64(), "row": pa.int64(), "n": pa.int64(), "node": pa.int64(), "sketch": pa.binary(), "gram": pa.int64()}

    def rows(kind: int, count: int, **have) -> pa.RecordBatch:
        cols = [pa.array(have[c], t) if c in have else pa.nulls(count, t) for c, t in kinds.items()]
        return pa.RecordBatch.from_arrays([pa.array(np.full(count, kind), pa.int32()), *cols], names=["kind", *kinds])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        seen: set[int] = set()
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal size
            if held:
                g, c = np.unique(np.concatenate(held), return_counts=True)
                g, c = g[c >= FREQUENT_FROM], c[c >= FREQUENT_FROM]
                yield rows(2, len(g), gram=g.astype(np.int64), n=c.astype(np.int64))
            held.clear()
            seen.clear()
            size = 0

        for batch in batches:
            for part, data, offsets in text_slices(batch):
                grams, offs = shingle_sets(data, offsets, k)
                node, n, row = set_digests(grams, offs), np.diff(offs), part.column(1)
                yield rows(0, len(n), doc_id=part.column(0), row=row, n=n, node=node)
                new = [i for i, x in enumerate(node.tolist()) if n[i] and x not in seen and not seen.add(x)]
                if new:
                    drawn = sketches(grams, offs)
                    yield rows(1, len(new), row=row.take(pa.array(new)), n=n[new], node=node[new], sketch=[drawn[i] for i in new])
                    held.extend(grams[offs[i] : offs[i + 1]] for i in new)
                size += len(data)
                if size >= FOLD_BYTES:
                    yield from flush()
        yield from flush()

    return docs.mapInArrow(run, OWN)


def frequent_grams(survey: DataFrame, most: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of n-grams that many different sets hold, and their levels: counted in each task over
    what it folds, those of several sets summed, and of these the most frequent, ``most`` at most, a fixed
    bound. Any list will do for right results."""
    counted = materialize(survey.where("kind = 2").groupBy("gram").agg(F.sum("n").alias("n")), "frequent")
    least, total = 1 << 62, 0
    for r in sorted(counted.groupBy("n").count().collect(), reverse=True):  # a row for each frequency
        if total + r["count"] > most:
            break
        least, total = r["n"], total + r["count"]
    top = counted.where(F.col("n") >= least).toPandas()
    discard(counted)
    grams, n = top["gram"].to_numpy(np.int64).astype(U64), top["n"].to_numpy(np.float64)
    order = np.argsort(grams)
    levels = 1 + np.floor(np.log(np.maximum(n[order], FREQUENT_FROM) / FREQUENT_FROM) / np.log(8) + 1e-9)
    return grams[order], np.minimum(levels, LEVELS).astype(np.int8)


def set_digests(grams: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """A positive 63-bit node for each set."""
    p = np.concatenate([np.zeros(1, U64), np.cumsum(mix(grams), dtype=U64)])
    q = np.concatenate([np.zeros(1, U64), np.cumsum(mix(grams ^ U64(0xDEADBEEFCAFEF00D)), dtype=U64)])
    a, b = p[offs[1:]] - p[offs[:-1]], q[offs[1:]] - q[offs[:-1]]
    return (mix(a ^ mix(b + np.diff(offs).astype(U64))) >> U64(1)).astype(np.int64)


KEYS = "bucket int, many boolean, keys binary, nodes binary, counts binary, a long, b long"
#: Bytes of a key that are shuffled, besides those its bucket tells.
KEY_BYTES = 6


def _same(keys: np.ndarray) -> np.ndarray:
    """Index of the run of equal keys that each entry of a sorted array is in."""
    return np.cumsum(np.concatenate([[True], keys[1:] != keys[:-1]])) - 1


def _part_keys(docs: DataFrame, k: int, percent: int, buckets: int, frequent) -> DataFrame:
    """A bucket's part keys by node (``many``: the node stands for others of its fold too), and the ties
    (a, b) of those others."""

    def packed(bucket: np.ndarray, keys: np.ndarray, nodes: np.ndarray, many: bool) -> pa.RecordBatch:
        order = np.lexsort((nodes, bucket))
        bucket, nodes = bucket[order], nodes[order]
        low = np.ascontiguousarray((keys[order] >> U64(64 - 8 * KEY_BYTES)).astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES]
        some, cut = np.unique(bucket, return_index=True)
        ends = [*cut[1:].tolist(), len(bucket)]
        sets = [np.unique(nodes[x:y], return_counts=True) for x, y in zip(cut.tolist(), ends, strict=True)]
        cols = [pa.array(some, pa.int32()), pa.array([many] * len(some), pa.bool_()), pa.array([low[x:y].tobytes() for x, y in zip(cut.tolist(), ends, strict=True)], pa.binary()), pa.array([x.tobytes() for x, _ in sets], pa.binary()), pa.array([c.astype(np.uint32).tobytes() for _, c in sets], pa.binary())]
        return pa.RecordBatch.from_arrays([*cols, pa.nulls(len(some), pa.int64()), pa.nulls(len(some), pa.int64())], names=NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = Parts(percent)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        seen: set[int] = set()
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal size
            keys, nodes = (np.concatenate(x) for x in zip(*held, strict=True)) if held else (np.zeros(0, U64), np.zeros(0, np.int64))
            if len(keys):
                order = np.lexsort((nodes, keys))
                keys, nodes = keys[order], nodes[order]
                group = _same(keys)
                many = np.bincount(group)[group] > FEW
                first = np.concatenate([[True], group[1:] != group[:-1]])
                hub = nodes[np.flatnonzero(first)][group]
                ties = np.unique(np.stack([nodes, hub], 1)[many & ~first], axis=0)
                if len(ties):
                    n, none = len(ties), pa.nulls(len(ties), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(ties[:, 0] % buckets, pa.int32()), pa.nulls(n, pa.bool_()), none, none, none, pa.array(ties[:, 0]), pa.array(ties[:, 1])], names=NAMES)
                bucket = (keys % U64(buckets)).astype(np.int64)
                for flag, which in ((False, ~many), (True, many & first)):
                    if which.any():
                        yield packed(bucket[which], keys[which], nodes[which], flag)
            held.clear()
            seen.clear()
            size = 0

        for batch in batches:
            for _, data, offsets in text_slices(batch):
                grams, offs = shingle_sets(data, offsets, k)
                node, n = set_digests(grams, offs), np.diff(offs)
                which = [i for i, x in enumerate(node.tolist()) if n[i] and x not in seen and not seen.add(x)]
                keys, owners = parts.keys(grams, offs, np.array(which, np.int64), frequent.value)
                held.append((keys, node[owners]))
                size += len(data)
                if size >= KEY_FOLD_BYTES:
                    yield from flush()
        yield from flush()

    return docs.select("text").mapInArrow(run, KEYS)


NAMES = [x.split()[0] for x in KEYS.split(", ")]


def _candidates(keyed: DataFrame, partitions: int) -> DataFrame:
    """(a, b, tied): pairs of nodes that share a part; tied: one of a group too large to be paired."""

    def meet(entries: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        keys, nodes, flag = (np.concatenate(x) for x in zip(*entries, strict=True))
        order = np.lexsort((~flag, nodes, keys))
        keys, nodes, flag = keys[order], nodes[order], flag[order]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1])
        keys, nodes, flag = keys[new], nodes[new], flag[new]
        group = _same(keys)
        many = (np.bincount(group) > FEW)[group] | (np.bincount(group, flag) > 0)[group]
        first = np.concatenate([[True], group[1:] != group[:-1]])
        hub = nodes[np.flatnonzero(first)][group]
        pairs = [np.stack([nodes[d:], nodes[:-d]], 1)[(group[d:] == group[:-d]) & ~many[d:]] for d in range(1, min(FEW, len(nodes)))]
        none = np.zeros((0, 2), np.int64)
        return np.unique(np.concatenate([none, *pairs]), axis=0), np.unique(np.stack([nodes, hub], 1)[many & ~first], axis=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        names = ["a", "b", "tied"]
        for batch in batches:
            tied = np.asarray(batch.column(0).is_valid()) & np.asarray(batch.column(5).is_valid())
            for i in np.flatnonzero(~tied).tolist():
                bucket, many, low, x, c = (batch.column(j)[i].as_py() for j in range(5))
                keys = np.zeros((len(low) // KEY_BYTES, 8), np.uint8)
                keys[:, :KEY_BYTES] = np.frombuffer(low, np.uint8).reshape(-1, KEY_BYTES)
                nodes = np.repeat(np.frombuffer(x, np.int64), np.frombuffer(c, np.uint32))
                held.setdefault(bucket, []).append((keys.view("<u8")[:, 0], nodes, np.full(len(nodes), many)))
            rest = batch.select(["a", "b"]).filter(pa.array(tied))
            if rest.num_rows:
                yield pa.RecordBatch.from_arrays([*rest.columns, pa.array([True] * rest.num_rows)], names=names)
        for b in list(held):
            for found, flag in zip(meet(held.pop(b)), (False, True), strict=True):
                if len(found):
                    yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1]), pa.array(np.full(len(found), flag))], names=names)

    return keyed.repartition(partitions, "bucket").mapInArrow(run, "a long, b long, tied boolean")


def _plausible(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that sizes and sketches don't turn down."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [may_link(*r, percent) for r in zip(*(batch.column(j).to_pylist() for j in range(2, 6)), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    of = lambda c, n: nodes.select(F.col("node").alias(c), F.col("n").alias(f"n{n}"), F.col("sketch").alias(f"s{n}"))
    size = F.least("n1", "n2") * 100 >= F.greatest("n1", "n2") * percent
    met = pairs.join(of("a", 1), "a").join(of("b", 2), "b").where(size).select("a", "b", "n1", "s1", "n2", "s2")
    return met.mapInArrow(run, "a long, b long")


def product_links(sets: list[np.ndarray], sides: np.ndarray, percent: int) -> np.ndarray:
    """Boolean link matrix of a block: overlap counts by a product of the incidence matrix with its
    transpose, in strips of columns. ``sides``: pairs of one and the same positive side are left out.
    Pairs are discarded as soon as the n-grams to come can't bring them to the overlap they need, and sets
    without a pair left take no part in further strips."""
    m = len(sets)
    size = np.array([len(s) for s in sets])
    need = -(-percent * (size[:, None] + size[None, :]) // (100 + percent))
    alive = np.minimum(size[:, None], size[None, :]) >= need
    if len(sides):
        alive &= (sides[:, None] != sides[None, :]) | (sides[:, None] == 0)
    np.fill_diagonal(alive, False)
    flat, row = np.concatenate(sets), np.repeat(np.arange(m), size)
    order = np.argsort(flat, kind="stable")
    flat, row = flat[order], row[order]
    new = np.concatenate([[True], flat[1:] != flat[:-1]])
    col = np.cumsum(new) - 1
    twice = np.bincount(col) > 1  # n-grams of one document alone overlap with nothing
    at = np.cumsum(twice) - 1
    keep = twice[col]
    row, col = row[keep], at[col[keep]]
    overlap = np.zeros((m, m), np.int64)
    to_come = np.bincount(row, minlength=m)
    cut = np.searchsorted(col, np.arange(0, int(twice.sum()) + STRIP, STRIP))
    for s in range(len(cut) - 1):
        alive &= overlap + np.minimum(to_come[:, None], to_come[None, :]) >= need
        r, c = row[cut[s] : cut[s + 1]], col[cut[s] : cut[s + 1]] - s * STRIP
        to_come -= np.bincount(r, minlength=m)
        some = alive.any(1)[r]
        r, c = r[some], c[some]
        if not len(r):
            continue
        own, r = np.unique(r, return_inverse=True)
        x = np.zeros((len(own), int(c.max()) + 1), np.float32)
        x[r, c] = 1
        overlap[np.ix_(own, own)] += (x @ x.T).astype(np.int64)
    return alive & (overlap >= need)


def _forest(link: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of a link matrix."""
    left, out = np.ones(len(link), bool), []
    for i in range(len(link)):
        if not left[i]:
            continue
        left[i] = False
        todo = [i]
        while todo:
            x = todo.pop()
            near = np.flatnonzero(link[x] & left)
            left[near] = False
            out += [(x, int(y)) for y in near]
            todo += near.tolist()
    return out


#: Where a node stands in its component; the blocks that follow from it, many in a large one, are written out only
#: once its n-grams are at hand.
SPOT = "struct<root:long,grid:int,mine:int,few:int,turn:int,minor:boolean>"


def _links(members: DataFrame, places: Column, k: int, percent: int, partitions: int) -> DataFrame:
    """(a, b): a spanning forest of the links of each block. ``members``: text, node, spot; ``places``: of a spot,
    the blocks it takes part in."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for piece, data, offsets in text_slices(batch):
                grams, offs = shingle_sets(data, offsets, k)
                right = [i for i, x in enumerate(piece.column(1).to_pylist()) if x not in seen and not seen.add(x)]  # repeated rows once
                packed = pa.array([grams[offs[i] : offs[i + 1]].tobytes() for i in right], pa.binary())
                yield pa.RecordBatch.from_arrays([piece.column(2).take(pa.array(right, pa.int64())), piece.column(1).take(pa.array(right, pa.int64())), packed], names=["spot", "node", "grams"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rows = None, {}

        def solve() -> pa.RecordBatch:
            nodes = sorted(rows)
            got: list[tuple[int, int]] = []
            if len(nodes) > 1:
                link = product_links([rows[x][1] for x in nodes], np.array([rows[x][0] for x in nodes]), percent)
                got = [(nodes[i], nodes[j]) for i, j in _forest(link)]
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in got], pa.int64()), pa.array([y for _, y in got], pa.int64())], names=["a", "b"])

        for batch in batches:
            for p, side, node, g in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if p != part:
                    if rows:
                        yield solve()
                    part, rows = p, {}
                rows[node] = (side, np.frombuffer(g, U64))
        if rows:
            yield solve()

    made = members.select("text", "node", "spot").mapInArrow(sets, f"spot {SPOT}, node long, grams binary")
    dealt = made.select("spot.*", "node", "grams").select(F.explode(places).alias("p"), "node", "grams").select("p.part", "p.side", "node", "grams")
    return dealt.repartition(partitions, "part").sortWithinPartitions("part").mapInArrow(run, "a long, b long")


def _linked(docs: DataFrame, k: int, percent: int, block: int, grams: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, row, n, node) of every document, and (node, root) of the nodes that link with others."""
    spark = docs.sparkSession
    n = parallelism(spark, docs)
    text = _plain(docs)
    survey = materialize(_survey(text, k), "survey")
    own = survey.where("kind = 0").select("doc_id", "row", "n", "node")
    nodes = survey.where("kind = 1").groupBy("node").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.min("row").alias("row"))
    frequent = spark.sparkContext.broadcast(frequent_grams(survey))
    found = materialize(_candidates(_part_keys(text, k, percent, DEAL * n, frequent), DEAL * n), "candidates")
    likely = _plausible(found.where("not tied").select("a", "b").distinct(), nodes, percent)
    blocks = components(likely.union(found.where("tied").select("a", "b")))
    discard(found)
    sized = blocks.join(nodes.select("node", "n", "row"), "node")
    sizes = sized.groupBy("root").agg(F.count("*").alias("size"), F.sum("n").alias("grams"))
    spot = sized.join(sizes, "root").withColumn("grid", _parts(F.col("size"), F.col("grams"), block, grams)).withColumn("mine", F.pmod(F.xxhash64("node"), F.col("grid")).cast("int"))
    spot = materialize(spot.select("root", "node", "n", "row", "grid", "mine"), "blocks")
    # each node's text is taken from one of its rows; the places are the blocks it is needed in. Up to PAIRED parts all meet;
    # of more, part 0 meets each other part. Pairs inside a part count once
    pairs = F.expr("transform(sequence(0, grid - 1), j -> struct(concat_ws('/', root, least(mine, j), greatest(mine, j)) as part, if(j = mine, 0, if(mine < j, 1, 2)) as side))")
    meets = F.expr("transform(sequence(1, grid - 1), j -> struct(concat_ws('/', root, j) as part, if(j = 1, 0, 1) as side))")
    own_block = F.expr("array(struct(concat_ws('/', root, mine) as part, 0 as side))")
    first = F.when(F.col("grid") == 1, own_block).when(F.col("grid") <= PAIRED, pairs).when(F.col("mine") == 0, meets).otherwise(own_block)
    links = materialize(_links(_texts(text, spot), first, k, percent, n), "links")
    big = spot.where(F.col("grid") > PAIRED)
    if not big.limit(1).count():
        return own, components(links)
    # what isn't in a large component's largest class by now meets all the rest of it
    known = components(links).withColumnRenamed("root", "class")
    classed = materialize(big.join(known, "node", "left").withColumn("class", F.coalesce("class", "node")), "classes")
    largest = classed.groupBy("root", "class").agg(F.count("*").alias("many")).groupBy("root").agg(F.max(F.struct("many", "class"))["class"].alias("largest"))
    classed = classed.join(largest, "root").withColumn("minor", F.col("class") != F.col("largest"))
    minors = classed.where("minor").groupBy("root").agg(F.count("*").alias("size"), F.sum("n").alias("grams"))
    minors = minors.select("root", _parts(F.col("size"), F.col("grams"), block, grams).alias("few"))
    rest = classed.join(minors, "root").withColumn("turn", F.pmod(F.xxhash64("node", F.lit(7)), F.col("few")).cast("int"))
    among = F.expr("transform(sequence(0, few - 1), j -> struct(concat_ws('/', root, 'minor', least(turn, j), greatest(turn, j)) as part, if(j = turn, 0, if(turn < j, 1, 2)) as side))")
    across = F.expr("transform(sequence(0, grid - 1), j -> struct(concat_ws('/', root, 'rest', turn, j) as part, 1 as side))")
    back = F.expr("transform(sequence(0, few - 1), i -> struct(concat_ws('/', root, 'rest', i, mine) as part, 2 as side))")
    second = F.when(F.col("minor"), F.concat(among, across)).otherwise(back)
    return own, components(links.union(_links(_texts(text, materialize(rest, "rest")), second, k, percent, n)))


def _parts(size: Column, grams: Column, block: int, most: int) -> Column:
    """Parts, of half a block each, that so many nodes with so many n-grams in all are cut into."""
    cut = F.ceil(F.greatest(size / (block // 2), grams / (most // 2)))
    return F.when((size <= block) & (grams <= most), 1).otherwise(F.greatest(F.lit(2), F.least(size, cut))).cast("int")


def _texts(text: DataFrame, placed: DataFrame) -> DataFrame:
    """text, node, spot. ``placed``: a written table, so that counting it is cheap."""
    have = dict(x.split(":") for x in SPOT[len("struct<") : -1].split(","))
    spot = F.struct(*(F.col(c).cast(t).alias(c) if c in placed.columns else F.lit(None).cast(t).alias(c) for c, t in have.items()))
    needed = placed.select("row", "node", spot.alias("spot"))
    return text.select("row", "text").join(F.broadcast(needed) if needed.count() <= BROADCAST_ROWS else needed.hint("merge"), "row")


def _grouped(own: DataFrame, roots: DataFrame) -> DataFrame:
    """doc_id, row, n, and first: of the row's component, whether its least id is null, that id, its row."""
    lead = own.where("n > 0").groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("least"))
    merged = lead.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    final = merged.join(merged.groupBy("root").agg(F.min("least").alias("first")), "root").select("node", "first")
    return own.join(final, "node", "left").select("doc_id", "row", "n", F.when(F.col("n") > 0, F.col("first")).alias("first"))


def join(docs: DataFrame, k: int = 3, percent: int = 90, block: int = BLOCK, grams: int = BLOCK_GRAMS) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs`` (doc_id, text)."""
    out = _grouped(*_linked(docs, k, percent, block, grams))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("component_id"))


def keep_first(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component, the one with the least id (a null id is the largest), all columns as they
    are. Rows without words stay. Rows alike in id and text stay or go together."""
    out = _grouped(*_linked(docs, k, percent, BLOCK, BLOCK_GRAMS))
    name = free_name(docs, "row")
    gone = out.where("n > 0 and row <> first.row").select(F.col("row").alias(name)).distinct()
    keyed = docs.withColumn(name, F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    return keyed.join(gone, name, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
