"""Toxicity scoring after noisy-channel deobfuscation.

Words are restored before they are judged: a word with look-alike characters, separators between its
letters or repeated letters spans a lattice of readings (each character as itself, as a letter it imitates,
as nothing if it separates or if it can be read as the letter before it), and Viterbi decoding under a byte trigram model of the whole corpus
finds the cheapest. A token of any length is decoded, after repeats of a letter and runs of separators are
cut to three. Letters spaced out one by one are joined first: every stretch of at most 16 characters, every
stretch of whole repeats that has no more of them than the lexicon's longest word has letters (a longer one
can't be read as a word of it), and all of them. In learning, where there is no lexicon, stretches have at
most 16 repeats; a longer word that stands between other spaced-out words teaches by its beginnings only.
The lexicon is learned from labelled documents only: words, and beginnings of words, that occur in toxic
documents significantly more than chance, and not only beside other such words, each with its smoothed
precision. A score is the noisy-or of the restored words' precisions.

Null and empty texts, and any text if nothing was learned, score as texts without toxic words. Repeated
labels of a document count once; labels with a null id or a null mark are ignored. About ``sample``
labelled rows at most (chosen by a hash of their id) teach; corpus counts cover all documents.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import charmodel
from .common import discard, free_name, materialize, text_slices, words
from .langid import fold

SAMPLE = 20_000
THRESHOLD = 0.3
#: Log 10 of the chance below which a word's share of toxic documents isn't chance: for words with toxic
#: documents of their own, and for words that always stand beside such, as different documents have them.
SIGNIFICANCE = -5.0
BESIDE = -12.0
#: Documents that a shorter beginning's share counts as; the least share that says anything.
LEAN = 4.0
LEAST_SHARE = 0.25
#: Entries of a worker's caches: weights of tokens, readings of tokens, and code lengths.
CACHE_WORDS = 150_000
CACHE_READINGS = 50_000
CACHE_COSTS = 50_000
#: Characters of a joined stretch that may begin and end within repeats; least bound of one that may not.
STRETCH = 16

# Characters and the letters they imitate.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "€": "e", "£": "l", "¡": "i", "(": "c", "<": "c", "¥": "y", "§": "s",
}
SEPARATORS = set(".-_*~'`^:,;/\\·•#%&=")
EDGES = ".,;:!?\"'()[]{}<>«»„“”‘’…#%&*$=+~`^_-/\\|"
TRIPLE = re.compile(r"(.)\1\1")
RUN = re.compile(r"(.)\1+")


def _classes() -> dict[int, str | None]:
    """Letters and look-alikes that one character may stand for fall in one class; separators in none."""
    root = {c: c for c in "abcdefghijklmnopqrstuvwxyz"}
    for letters in LOOKALIKES.values():
        a, *more = (root[x] for x in letters)
        root = {c: a if r in more else r for c, r in root.items()}
    table: dict[int, str | None] = {ord(c): r for c, r in root.items()}
    table |= {ord(c): root[letters[0]] for c, letters in LOOKALIKES.items()}
    return table | {ord(c): None for c in SEPARATORS}


CLASSES = _classes()
NONE: frozenset = frozenset()
#: Letters that a character may stand for, and the symbol of each in the byte model.
LETTERS = {ch: frozenset(ch) for ch in "abcdefghijklmnopqrstuvwxyz"} | {ch: frozenset(x) for ch, x in LOOKALIKES.items()}
SYMBOL = {ch: int(charmodel.FOLD[ord(ch)]) for ch in "abcdefghijklmnopqrstuvwxyz"}


def skeleton(word: str) -> str:
    """Equal for all readings of a word's lattice: classes of look-alikes, without separators and repeats."""
    return RUN.sub(r"\1", word.translate(CLASSES))


def collapse(word: str) -> str:
    """At most three of a letter's repeats (whatever separators are between) and three separators running;
    has the word's skeleton."""
    out: list[str] = []
    last, times, marks = "", 0, 0
    for ch in word:
        if ch in SEPARATORS:
            marks += 1
            if marks <= 3:
                out.append(ch)
            continue
        times = times + 1 if ch == last else 1
        last = ch
        if times <= 3:
            marks = 0
            out.append(ch)
    return "".join(out)


class Lattice:
    """Viterbi decoding of a word under the byte trigram model."""

    def __init__(self, model: charmodel.Model) -> None:
        self.bits = model.tables()[0] if model.labels else None
        self.costs: dict[tuple[tuple[int, int], str], tuple[tuple[int, int], float]] = {}

    def cost(self, state: tuple[int, int], text: str) -> tuple[tuple[int, int], float]:
        key = state, text
        if key not in self.costs:
            if len(self.costs) > CACHE_COSTS:
                self.costs.clear()
            self.costs[key] = self._cost(state, text)
        return self.costs[key]

    def _cost(self, state: tuple[int, int], text: str) -> tuple[tuple[int, int], float]:
        a, b = state
        total, s = 0.0, charmodel.SYMBOLS
        for x in text.encode():
            c = int(charmodel.FOLD[x])
            total += float(self.bits[(a * s + b) * s + c])
            a, b = b, c
        return (a, b), total

    def restore(self, word: str, doubles: bool = True) -> str:
        """The cheapest reading; the word itself if there is no model. ``doubles``: whether a letter twice
        running may be a repeat too, not only a longer run."""
        if self.bits is None:
            return word
        # a path's text is a chain of (what is before, last part), so that long words take linear time
        paths: dict[tuple, tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        one = two = frozenset()  # letters that the last character but separators, and both of the last two, may be
        for i, ch in enumerate(word):
            nxt: dict[tuple, tuple[float, tuple | None]] = {}
            readings = [(ch, 0.0)]
            if ch in LOOKALIKES:
                readings = [(x, 1.0) for x in LOOKALIKES[ch]] + [(ch, 6.0)]
            elif ch in SEPARATORS:
                readings = [("", 1.0), (ch, 6.0)]
            letters = LETTERS.get(ch, NONE)
            thrice = bool(two & letters) or i > 1 and ch == word[i - 1] == word[i - 2]
            drop = 0.5 if thrice else 3.0
            # a repeat of the raw character may go in any path, one of a reading where that letter is the last
            again = (thrice or doubles) and i > 0 and ch == word[i - 1]
            ends = {SYMBOL[x] for x in one & letters} if thrice or doubles else NONE
            for state, (bits, chain) in paths.items():
                for read, channel in readings:
                    to, more = self.cost(state, read) if read else (state, 0.0)
                    found = bits + more + channel
                    if to not in nxt or found < nxt[to][0]:
                        nxt[to] = (found, (chain, read) if read else chain)
                if (again or state[1] in ends) and (state not in nxt or bits + drop < nxt[state][0]):
                    nxt[state] = (bits + drop, chain)
            if ch not in SEPARATORS:
                one, two = letters, one & letters
            paths = nxt
        ends = [(bits + self.cost(state, " ")[1], chain) for state, (bits, chain) in paths.items()]
        least = min(bits for bits, _ in ends)
        return min(unchained(chain) for bits, chain in ends if bits == least)

    def readings(self, token: str, decode: bool | None = None) -> list[str]:
        """What a white-space token may stand for, plainest first; lower case.

        ``decode``: whether to search the lattice; None: where the token has more than letters, or one three
        times running.
        """
        core, whole = token.strip(EDGES), token.strip(".,;:?\"'")
        out = [core] if core else []
        if decode is None:
            decode = bool(TRIPLE.search(core)) if whole.isalpha() else any(map(str.isalpha, whole))
        if decode:
            out += [self.restore(x, doubles) for x in dict.fromkeys(map(collapse, (core, whole))) for doubles in (False, True)]
        return list(dict.fromkeys(out))


def unchained(chain: tuple | None) -> str:
    parts: list[str] = []
    while chain is not None:
        chain, part = chain
        parts.append(part)
    return "".join(reversed(parts))


def features(word: str) -> list[str]:
    """The word and its beginnings (marked by a caret), longest first."""
    return [word] + [f"^{word[:n]}" for n in (7, 6, 5, 4) if len(word) > n]


# what str.split takes as a blank: bytes of ASCII, and longer encodings as (first bytes, whether a byte may be the last)
BLANK = np.array([chr(c).isspace() and c < 128 for c in range(256)])
WIDE = [chr(c).encode() for c in range(128, 0x3001) if chr(c).isspace()]
WIDE_LAST = {head: np.array([head + bytes([c]) in WIDE for c in range(256)]) for head in sorted({x[:-1] for x in WIDE})}


def wide_blanks(data: np.ndarray) -> np.ndarray:
    """Where the encodings of blanks outside ASCII begin."""
    out = [np.zeros(0, np.int64)]
    for head, last in WIDE_LAST.items():
        at = np.flatnonzero(data[: len(data) - len(head)] == head[0])
        for i in range(1, len(head)):
            at = at[data[at + i] == head[i]]
        out.append(at[last[data[at + len(head)]]])
    return np.concatenate(out)


def spaced_out(data: np.ndarray, offsets: np.ndarray) -> list[bool]:
    """Of each text, whether three tokens running may be single characters (up to four bytes of one); true of
    any with a blank outside ASCII."""
    starts, ends, first = words(data, offsets, ~BLANK)
    one = np.zeros(len(starts) + 2, np.int8)
    one[: len(starts)] = (ends - starts == 1) | (ends - starts <= 4) & (data[starts] >= 128) if len(starts) else 0
    three = np.concatenate([[0], np.cumsum(one[:-2] & one[1:-1] & one[2:])])
    wide = np.bincount(np.searchsorted(offsets, wide_blanks(data), "right") - 1, minlength=len(offsets) - 1)
    return ((three[first[1:]] > three[first[:-1]]) | (wide > 0)).tolist()


def joins(run: str, longest: int) -> Iterator[str]:
    """What characters spaced out one by one may spell: their stretches of 3 to 16, those of up to ``longest``
    whole repeats, and all of them."""
    run = collapse(run)
    yield run
    for a in range(len(run) - 2):
        for b in range(a + 3, min(len(run), a + STRETCH) + 1):
            yield run[a:b]
    # a stretch of separators counts with the repeats before it
    starts = [i for i, ch in enumerate(run) if i == 0 or ch != run[i - 1] and ch not in SEPARATORS] + [len(run)]
    for i, a in enumerate(starts[:-1]):
        for b in starts[i + 1 : i + 1 + longest]:
            if b - a > STRETCH:
                yield run[a:b]


def tokens(text: str, spaced: bool = True, longest: int = STRETCH) -> set[str]:
    """Lower-case white-space tokens, and joins of letters spaced out one by one (if there may be any)."""
    split = text.lower().split()
    out = set(split)
    if not spaced:
        return out
    run: list[str] = []
    ones = [i for i, w in enumerate(split) if len(w) == 1]
    for i, at in enumerate(ones):
        run.append(split[at])
        if i + 1 == len(ones) or ones[i + 1] != at + 1:
            if len(run) >= 3:
                out.update(joins("".join(run), longest))
            run = []
    return out


def sample_labels(labels: DataFrame, mark: str, held, sample: int) -> DataFrame:
    """(doc_id, label) of about ``sample`` labelled rows outside the held-out fold: all if there are no more,
    else those whose hash of the id falls under a share."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(mark).isNotNull() & ~held)
    rows = rows.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(mark).cast("int").alias("label"))
    n = rows.count()
    return rows if n <= sample else rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(sample / n * (1 << 30)))


def word_features(docs: DataFrame, lattice_model) -> DataFrame:
    """(label, features): what each labelled document holds, distinct."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(lattice_model.value)
        cache: dict[str, tuple[str, ...]] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 16):
                part = batch.slice(at, 16)
                rows: list[list[str]] = []
                for text in part.column(1):
                    have: set[str] = set()
                    for t in tokens(text.as_py() or ""):
                        if t not in cache:
                            if len(cache) > CACHE_READINGS:
                                cache.clear()
                            cache[t] = tuple(lattice.readings(t))
                        for r in cache[t]:
                            have.update(features(r))
                    rows.append(list(have))
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int32()), pa.array(rows, pa.list_(pa.string()))], names=["label", "features"])

    return docs.select("label", "text").mapInArrow(run, "label int, features array<string>")


def tail(k: int, n: int, p: float) -> float:
    """Log 10 of the chance of at least k of n at rate p (its largest term and a geometric bound)."""
    if k <= n * p:
        return 0.0
    term = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
    ratio = (n - k) * p / ((k + 1) * (1 - p))
    return min(0.0, (term - math.log1p(-min(ratio, 0.999))) / math.log(10))


def own_evidence(counts: dict[str, tuple[int, int]], holders: list[tuple[int, list[str]]], base: float) -> set[str]:
    """Features that are significant by toxic documents of their own: the most significant one is taken, the
    toxic documents that hold it (``holders``: a signature, which copies share, and the features of each)
    count for no other, and so on. What only stands beside toxic words, as in copies of a toxic document, is
    left out, unless documents of many signatures have it and clean ones don't."""
    where: dict[str, set[int]] = {}
    kinds: dict[str, set[int]] = {}
    for i, (signature, have) in enumerate(holders):
        for f in have:
            where.setdefault(f, set()).add(i)
            kinds.setdefault(f, set()).add(signature)

    def beside(f: str) -> bool:
        k = len(kinds.get(f, ()))
        return tail(k, k + counts[f][1] - counts[f][0], base) <= BESIDE

    def rank(f: str) -> tuple[float, str]:
        k = len(where.get(f, ()))
        return tail(k, k + counts[f][1] - counts[f][0], base), f

    heap = [rank(f) for f in counts]
    heapq.heapify(heap)
    own = {f for f in counts if beside(f)}
    while heap and heap[0][0] <= SIGNIFICANCE:
        was, f = heapq.heappop(heap)
        now = rank(f)
        if now[0] > was:  # some of its documents are explained since
            heapq.heappush(heap, now)
            continue
        own.add(f)
        for i in list(where[f]):
            for g in holders[i][1]:
                where[g].discard(i)
    return own


def related(f: str, own: set[str]) -> bool:
    """Whether the word or beginning is, begins or goes on one of ``own``."""
    stem = f.lstrip("^")
    return any(stem.startswith(g.lstrip("^")) if g[0] == "^" else f == g or f[0] == "^" and g.startswith(stem) for g in own)


def learn(docs: DataFrame, labels: DataFrame, held, model: charmodel.Model, sample: int = SAMPLE) -> dict[str, float]:
    """Feature -> -log(1 - precision) of the features with toxic documents of their own. What reaches the
    driver is bounded by ``sample``: the labels, and of the toxic documents the significant features."""
    spark = docs.sparkSession
    # about `sample` ids at most, so the broadcast is bounded by that parameter
    chosen = F.broadcast(sample_labels(labels, "toxic", held, sample))
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = materialize(word_features(text.join(chosen, "doc_id"), spark.sparkContext.broadcast(model)), "toxicity-words")
    every = {r["label"]: r["count"] for r in found.groupBy("label").count().collect()}
    all_toxic, all_clean = every.get(1, 0), every.get(0, 0)
    if not all_toxic or not all_clean:
        discard(found)
        return {}
    base = all_toxic / (all_toxic + all_clean)
    counted = found.select("label", F.explode("features").alias("feature")).groupBy("feature").agg(F.sum("label").alias("toxic"), F.count("*").alias("n"))
    rows = counted.where("toxic >= 3 and toxic > n - toxic").toArrow()
    counts = {f: (k, n) for f, k, n in zip(*(c.to_pylist() for c in rows.columns), strict=True) if f and tail(k, n, base) <= SIGNIFICANCE}
    known = spark.sparkContext.broadcast(frozenset(counts))

    def held_by(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            have = [(sign, y) for sign, x in zip(*(c.to_pylist() for c in batch.columns), strict=True) if (y := [f for f in x if f in known.value])]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in have], pa.int64()), pa.array([y for _, y in have], pa.list_(pa.string()))], names=["signature", "features"])

    signature = F.array_min(F.transform("features", lambda f: F.xxhash64(f))).alias("signature")
    rows = found.where("label = 1").select(signature, "features").mapInArrow(held_by, "signature long, features array<string>").toArrow()
    holders = list(zip(*(c.to_pylist() for c in rows.columns), strict=True))
    own = own_evidence(counts, holders, base)
    if not own:
        discard(found)
        return {}
    sure = {f for f in counts if related(f, own)}
    # every word that shares a beginning with one of these, so that each gets its own share
    heads = spark.createDataFrame([(h,) for h in sorted({x.lstrip("^")[:4] for x in sure})], "head string")
    near = counted.withColumn("head", F.expr("substring(ltrim('^', feature), 1, 4)")).join(F.broadcast(heads), "head").select("feature", "toxic", "n").toArrow()
    discard(found)
    return weights({f: (k, n) for f, k, n in zip(*(c.to_pylist() for c in near.columns), strict=True)}, sure, base)


def weights(counts: dict[str, tuple[int, int]], sure: set[str], base: float) -> dict[str, float]:
    """-log(1 - share) of every word or beginning, where a significant one is at work; each share leans on
    that of the next shorter beginning, the shortest on the base rate."""
    out: dict[str, float] = {}
    share: dict[str, float] = {}
    backed: dict[str, bool] = {}
    for f in sorted(counts, key=lambda x: (x[0] != "^", len(x))):
        word = f.lstrip("^")
        longer = [f"^{word[:n]}" for n in (7, 6, 5, 4) if n < len(word) and f"^{word[:n]}" in share]
        prior = share[longer[0]] if longer else base
        k, n = counts[f]
        share[f] = (k + LEAN * prior) / (n + LEAN)
        backed[f] = f in sure or bool(longer) and backed[longer[0]]
        out[f] = -math.log(1 - share[f]) if backed[f] and share[f] >= LEAST_SHARE else 0.0
    return out


class Scorer:
    """Scores of texts; a word's weight is cached.

    A lattice can only hold a lexicon entry that has its skeleton, so others aren't decoded.
    """

    def __init__(self, lexicon: dict[str, float], lattice: Lattice) -> None:
        self.lexicon, self.lattice = lexicon, lattice
        self.cache: dict[str, float] = {}
        self.skeletons = {skeleton(x) for x, w in lexicon.items() if w and x[0] != "^"}
        self.beginnings = {skeleton(x[1:]) for x, w in lexicon.items() if w and x[0] == "^"}
        self.lengths = sorted({len(x) for x in self.beginnings})
        # a stretch with more repeats than this can't be read as an entry, as each is one letter at least
        self.longest = max([STRETCH, *(len(x) for x, w in lexicon.items() if w)])

    def known(self, word: str) -> float:
        """The weight of the word, or else of its longest known beginning."""
        get = self.lexicon.get
        for f in features(word):
            if (w := get(f)) is not None:
                return w
        return 0.0

    def weight(self, token: str) -> float:
        core = token.strip(EDGES)
        best = self.known(core) if core else 0.0
        if best or (core == token and not RUN.search(core) and core.isalpha()):
            return best
        for body in (core, token.strip(".,;:?\"'")):
            s = skeleton(body)
            if s in self.skeletons or any(s[:n] in self.beginnings for n in self.lengths):
                return max([best, *map(self.known, self.lattice.readings(token, decode=True))])
        return best

    def score(self, text: str, spaced: bool = True) -> float:
        cache, have = self.cache, tokens(text, spaced, self.longest)
        if len(cache) > CACHE_WORDS:
            cache.clear()
        for t in have.difference(cache):
            cache[t] = self.weight(t)
        return 1 - math.exp(-0.01 - sum(map(cache.__getitem__, have)))


def scored(docs: DataFrame, labels: DataFrame, of: int = 4, out: int = 2, sample: int = SAMPLE, name: str = "toxicity") -> DataFrame:
    """The rows of ``docs`` with a column ``name``, which they must not have yet."""
    spark = docs.sparkSession
    corpus = docs.select(F.lit("all").alias("label"), F.col("text").cast("string").alias("text"))
    model = charmodel.train(corpus)
    lexicon = learn(docs, labels, fold("doc_id", of, out), model, sample)
    shared = spark.sparkContext.broadcast((lexicon, model))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, model = shared.value
        scorer = Scorer(lexicon, Lattice(model))
        for batch in batches:
            for part, data, offsets in text_slices(batch):
                texts = part.column(at).to_pylist()
                scores = pa.array([scorer.score(t or "", s) for t, s in zip(texts, spaced_out(data, offsets), strict=True)], pa.float64())
                yield pa.RecordBatch.from_arrays([*part.columns, scores], names=[*part.schema.names, name])

    from pyspark.sql.types import DoubleType, StructField, StructType

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def predict(docs: DataFrame, labels: DataFrame, of: int = 4, out: int = 2, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    got = scored(plain, labels, of, out, sample)
    return got.select("doc_id", fold("doc_id", of, out).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= threshold).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, of: int = 4, out: int = 2, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """The rows that score below the threshold, as they are, whatever columns they have."""
    name = free_name(docs, "toxicity")
    return scored(docs, labels, of, out, sample, name).where(F.col(name) < threshold).drop(name)
