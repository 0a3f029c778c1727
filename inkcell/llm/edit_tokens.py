"""Token counts that follow edits.

A document's pre-tokens (of a byte-level vocabulary) are the leaves of a segment tree of token counts. An
edit replaces a span of characters; only the pre-tokens it touches, and their neighbours until the cuts
agree again, are cut and encoded anew, and the sums above them are updated, so the cost follows the edit, not
the document. Counts of pre-tokens are cached in the worker.

A null text is empty. Edits of a document are applied in order of ``seq``, each on the result of the one
before; positions beyond the end are moved to the end. Documents without edits keep their count. Edits
with a null id, and of documents that are not there, have no effect. Rows of repeated ids are edited alike.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: the public pre-token pattern of the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CUT = regex.compile(PATTERN)
CACHE_WORDS = 300_000
#: Pre-tokens of a leaf of the tree.
LEAF = 64
OUT = "doc_id long, n_tokens long, n_tokens_after long, n_edits long, n_recut long, n_chars_after long"


class Counter:
    """Tokens of a pre-token, cached."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        self.model = whole.model
        self.cache: dict[str, int] = {}
        from .packing import STAND_IN

        self.letters = STAND_IN

    def missing(self, parts: set[str]) -> None:
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        for p in parts.difference(self.cache):
            self.cache[p] = len(self.model.tokenize("".join([self.letters[b] for b in p.encode()])))

    def counts(self, parts: list[str]) -> list[int]:
        self.missing(set(parts))
        return list(map(self.cache.__getitem__, parts))


class Document:
    """Pre-tokens in blocks, with a segment tree over the blocks' (characters, tokens)."""

    def __init__(self, text: str, counter: Counter) -> None:
        self.counter = counter
        parts = CUT.findall(text)
        counts = counter.counts(parts)
        self.blocks = [(parts[i : i + LEAF], counts[i : i + LEAF]) for i in range(0, len(parts), LEAF)]
        self.recut = 0
        self.build()

    def build(self) -> None:
        size = 1
        while size < max(1, len(self.blocks)):
            size *= 2
        self.size = size
        self.tokens = [0] * (2 * size)
        self.chars = [0] * (2 * size)
        for i, (parts, counts) in enumerate(self.blocks):
            self.tokens[size + i], self.chars[size + i] = sum(counts), sum(map(len, parts))
        for i in range(size - 1, 0, -1):
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]

    def set(self, i: int) -> None:
        parts, counts = self.blocks[i]
        at = self.size + i
        self.tokens[at], self.chars[at] = sum(counts), sum(map(len, parts))
        while at > 1:
            at //= 2
            self.tokens[at] = self.tokens[2 * at] + self.tokens[2 * at + 1]
            self.chars[at] = self.chars[2 * at] + self.chars[2 * at + 1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    @property
    def n_chars(self) -> int:
        return self.chars[1]

    def block_at(self, pos: int) -> tuple[int, int]:
        """The block that holds character ``pos`` (the last for the end) and where it begins."""
        at, start = 1, 0
        while at < self.size:
            at *= 2
            if pos - start >= self.chars[at]:
                start += self.chars[at]
                at += 1
        i = at - self.size
        if i >= len(self.blocks):
            i = len(self.blocks) - 1
            start = self.n_chars - self.chars[self.size + i]
        return i, start

    def edit(self, lo: int, hi: int, new: str) -> None:
        """Replace characters [lo, hi) by ``new``.

        Cutting restarts one pre-token before the one that the edit touches (a blank or an ending can still
        join it) and stops at the first old boundary behind the edit that is followed by what was cut there
        before; one more pre-token has to agree, since white space looks ahead.
        """
        lo = min(max(lo, 0), self.n_chars)
        hi = min(max(hi, lo), self.n_chars)
        if not self.blocks:
            self.__init__(new, self.counter)
            self.recut = len(self.blocks) and sum(len(p) for p, _ in self.blocks)
            return
        first, start = self.block_at(lo)
        if first:
            first -= 1
            start -= self.chars[self.size + first]
        last, end = self.block_at(hi)
        end += self.chars[self.size + last]
        while True:
            # a block behind the edit gives room for the cuts to meet again
            stop = min(len(self.blocks), last + 2)
            old = [p for b, _ in self.blocks[first:stop] for p in b]
            text = "".join(old)
            edges, at = [], start
            for p in old:
                edges.append(at)
                at += len(p)
            cur = text[: lo - start] + new + text[hi - start :]
            shift = len(new) - (hi - lo)
            known = {e + shift - start for e in edges if e >= hi}
            k = max(0, bisect_right(edges, lo) - 3)
            kept, pos = old[:k], edges[k] - start
            fresh: list[str] = []
            met, agreed = None, 0
            whole = stop == len(self.blocks)
            while pos < len(cur):
                m = CUT.match(cur, pos)
                if not whole and m.end() + 2 >= len(cur):
                    break  # the cut could look beyond what is loaded
                fresh.append(m[0])
                pos = m.end()
                agreed = agreed + 1 if pos in known else 0
                if agreed == 2:
                    met = pos
                    break
            if met is None and pos < len(cur):
                last += 1
                continue
            tail: list[str] = []
            if met is not None:
                tail = old[edges.index(met - shift + start) :]
            self.recut += len(fresh)
            parts = kept + fresh + tail
            counts = self.counter.counts(parts)
            room = stop - first
            if room <= len(parts) <= 4 * LEAF * room:
                cuts = [len(parts) * i // room for i in range(room + 1)]
                self.blocks[first:stop] = [(parts[a:b], counts[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
                for i in range(first, stop):
                    self.set(i)
            else:  # so much more or less text that the leaves change in number
                self.blocks[first:stop] = [(parts[i : i + LEAF], counts[i : i + LEAF]) for i in range(0, len(parts), LEAF)]
                self.build()
            return


def edit_counts(docs: DataFrame, edits: DataFrame, tokenizer_path: str) -> DataFrame:
    """OUT for every document. ``edits``: doc_id, seq, lo, hi, new. A document's edits come together by id
    before they meet its text, which moves once."""
    per = edits.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("seq", "lo", "hi", "new"))).alias("edits"))
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _apply(text.join(per, "doc_id", "left"), tokenizer_path)


def _apply(rows: DataFrame, tokenizer_path: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(tokenizer_path)
        for batch in batches:
            out: list[list] = [[] for _ in OUT.split(", ")]
            for i in range(batch.num_rows):
                text = batch.column(1)[i].as_py() or ""
                edits = batch.column(2)[i].as_py() or []
                doc = Document(text, counter)
                before = doc.n_tokens
                for e in edits:
                    doc.edit(e["lo"], e["hi"], e["new"] or "")
                for c, x in zip(out, (batch.column(0)[i].as_py(), before, doc.n_tokens, len(edits), doc.recut, doc.n_chars), strict=True):
                    c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=[x.split()[0] for x in OUT.split(", ")])

    return rows.select("doc_id", "text", "edits").mapInArrow(run, OUT)


def self_edits(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Counts before and after three edits that follow from the document alone: a replacement a third of the
    way in, an insertion at two thirds, and a deletion at the start."""
    n = "char_length(coalesce(text, ''))"
    made = F.expr(f"""array(
        named_struct('lo', bigint({n} div 3), 'hi', bigint({n} div 3 + 12), 'new', 'rewritten, twice'),
        named_struct('lo', bigint({n} * 2 div 3), 'hi', bigint({n} * 2 div 3), 'new', concat(' [', coalesce(string(doc_id), ''), '] ')),
        named_struct('lo', 0L, 'hi', 5L, 'new', ''))""")
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _apply(text.withColumn("edits", made), tokenizer_path)
