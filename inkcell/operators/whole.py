"""The chain from spans to paginated text for documents that lie whole in a row: one Arrow function, no shuffle.

Same results as ``plans.pipeline.convert``, whose operators take spans as rows and so move and sort a row for each
word. Spans of several documents are arrays here; what is done for each block is plain Python. A document is in
the memory of its worker (about 400 bytes a span), so what is longer than ``MOST_CHARS`` goes by the operators.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ..functions import tags, text
from ..functions.decode import wrap_row
from ..functions.encode import encode_text
from ..functions.tables import SEPARATOR_ROW
from .layout import CELLS_PER_LINE, INDENT, LINES_PER_PAGE
from .physical import fold
from .semantics import FLUSH

#: Characters of the longest text taken here, and bytes of texts taken at a time.
MOST_CHARS, SLICE_BYTES = 4 << 20, 1 << 20

#: White space as Java has it under (?U); Python's has four controls more.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
WHITES, ODD = re.compile(f"[{WHITE}]+"), re.compile("[\x1c-\x1f]")
RULE = re.compile(r"[━─_\-=*]+")
MARK = re.compile(tags.BLOCK_START, re.ASCII)
PASSAGE, EXAMPLE = re.compile(tags.PASSAGE, re.ASCII), re.compile(tags.EXAMPLE, re.ASCII)
#: A dot of Java's stops at more line ends.
ENDING = re.compile(tags.ENDING.replace(".", "[^\n\r\x85\u2028\u2029]"), re.ASCII)
#: These begin at the text's or a line's begin; with a line end put before the text, at a line end.
QUESTION, CHOICE, FOOTNOTE = (re.compile(x.replace(r"(?:^|\n)", r"\n", 1), re.ASCII) for x in (tags.QUESTION, tags.CHOICE, tags.FOOTNOTE))
TITLE, PERIOD = re.compile(text.TITLE, re.ASCII), re.compile(text.PERIOD, re.ASCII)
INDENTS = dict.fromkeys(("Choice", "Question", "PassageGroup", "Paragraph", "Passage", "Prompt", "ExampleBox"), INDENT)


class Spans(NamedTuple):
    """Spans of several documents. ``doc`` is the document's place among them; ``extraction_index`` has no equals in
    a document."""

    doc: np.ndarray
    page_number: np.ndarray
    text: list[str]
    x0: np.ndarray
    y0: np.ndarray
    x1: np.ndarray
    y1: np.ndarray
    font_size: np.ndarray
    extraction_index: np.ndarray


def _median(group: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """Of each group's values; NaN where there are none."""
    v = value[np.lexsort((value, group))]
    many = np.bincount(group, minlength=n)
    start, has = np.cumsum(many) - many, many > 0
    out = np.full(n, np.nan)
    out[has] = (v[(start + (many - 1) // 2)[has]] + v[(start + many // 2)[has]]) / 2
    return out


def _most(group: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    out = np.full(n, -np.inf)
    np.maximum.at(out, group, value)
    return out


def _least(group: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    return -_most(group, -value, n)


def _separator(x: str) -> bool:
    x = x.strip(WHITE)
    return len(x) >= 8 and ("━" in x or "─" in x or (RULE.fullmatch(x) is not None and len(set(x)) <= 2))


def _profile(s: Spans, page: np.ndarray, doc_of: np.ndarray, docs: int, width: float, height: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``physical.infer_profile``: column_cut_x, header_bottom_y, footer_top_y of each document."""
    pages, size = len(doc_of), np.fromiter(map(len, s.text), np.int64, len(s.text))
    rules = [i for i in np.flatnonzero((size >= 8) & (s.y0 < 250)).tolist() if _separator(s.text[i])]
    sep = _median(page[rules], s.y1[rules], pages)
    known = ~np.isnan(sep)
    sep = _median(doc_of[known], sep[known], docs)
    low = s.y0 >= height * 0.90
    foot = _least(s.doc[low], s.y0[low], docs)
    head = np.where(np.isnan(sep), height * 0.06, sep)
    foot = np.maximum(np.where(np.isinf(foot), height * 0.96, foot) - 4.0, head + 50.0)

    body = (s.y0 >= head[s.doc]) & (s.y0 < foot[s.doc]) & (size > 0)
    for i in np.flatnonzero(np.fromiter(map(str.isspace, s.text), bool, len(s.text))).tolist():
        body[i] &= s.text[i].strip(WHITE) != ""
    p, x0, x1, half = page[body], s.x0[body], s.x1[body], width * 0.5
    m = (x0 + x1) / 2
    left = m < half
    n, nl = np.bincount(p, minlength=pages), np.bincount(p[left], minlength=pages)
    ok = (n >= 4) & (nl >= 2) & (n - nl >= 2)
    cut = np.full(pages, half)
    unclear = ok & ~(_least(p[~left], x0[~left], pages) > _most(p[left], x1[left], pages))
    mine = unclear[p]
    q, c = p[mine], m[mine]
    order = np.lexsort((c, q))
    q, c = q[order], c[order]
    gap, at = c[1:] - c[:-1], (c[:-1] + c[1:]) / 2
    fits = (q[1:] == q[:-1]) & (gap > 0) & (at >= width * 0.35) & (at <= width * 0.65)
    q, gap, at = q[:-1][fits], gap[fits], at[fits]
    order = np.lexsort((-at, gap, q))
    cut[q[order]] = at[order]  # the last of a page stays: the widest, of equals the leftmost
    mine = ok[p]
    p, x0, x1, m = p[mine], x0[mine], x1[mine], m[mine]
    left = m < cut[p]
    l, r = _most(p[left], x1[left], pages), _least(p[~left], x0[~left], pages)
    has = np.isfinite(l) & np.isfinite(r)
    l, r = _median(doc_of[has], l[has], docs), _median(doc_of[has], r[has], docs)
    return np.where(r - l >= max(12.0, width * 0.015), (l + r) / 2, width * 0.96), head, foot


def _column(x0: np.ndarray, x1: np.ndarray, y0: np.ndarray, cut: np.ndarray, head: np.ndarray, foot: np.ndarray, width: float) -> np.ndarray:
    """``physical.assign_columns`` with a profile."""
    inner = np.where(x1 - x0 > width * 0.5, -1, np.where((x0 + x1) / 2 < cut, 0, 1))
    return np.where(y0 < head, -2, np.where(y0 >= foot, 2, inner))


def _starts(group: np.ndarray) -> np.ndarray:
    """Where groups that lie together begin."""
    return np.flatnonzero(np.r_[True, group[1:] != group[:-1]])


def _nth(group: np.ndarray) -> np.ndarray:
    """The place of each row in its group, from 0."""
    at = _starts(group)
    return np.arange(len(group)) - np.repeat(at, np.diff(np.r_[at, len(group)]))


def _line_text(raw: str, odd: bool) -> str:
    if odd:
        return WHITES.sub(" ", raw).strip(WHITE) or raw
    return " ".join(raw.split()) or raw


def blocks(s: Spans, docs: int, width: float, height: float) -> Iterator[tuple[int, str, str]]:
    """Document, text and tag (or '') of each block in reading order, as ``pipeline.structure`` finds them."""
    if not len(s.doc):
        return
    keys, page = np.unique((s.doc.astype(np.int64) << 32) | s.page_number, return_inverse=True)
    doc_of, number = (keys >> 32).astype(np.int64), keys & 0xFFFFFFFF
    cut, head, foot = _profile(s, page, doc_of, docs, width, height)

    # lines
    col = _column(s.x0, s.x1, s.y0, cut[s.doc], head[s.doc], foot[s.doc], width)
    sized = s.font_size > 0
    with np.errstate(invalid="ignore"):
        mean = np.bincount(page[sized], s.font_size[sized], len(keys)) / np.bincount(page[sized], minlength=len(keys))
    near = np.maximum(2.0, np.where(np.isnan(mean), 3.0, mean * 0.45))
    side = page * 5 + col + 2
    order = np.lexsort((s.extraction_index, s.x0, s.y0, side))
    side, x0, y0, x1, y1 = side[order], s.x0[order], s.y0[order], s.x1[order], s.y1[order]
    mids, lefts, rights = ((y0 + y1) / 2).tolist(), x0.tolist(), x1.tolist()
    at = _starts(side)
    numbers: list[int] = []
    for a, b, tol in zip(at.tolist(), [*at[1:].tolist(), len(side)], near[side[at] // 5].tolist(), strict=True):
        numbers += fold(mids[a:b], lefts[a:b], rights[a:b], tol)
    fresh = np.diff(np.array(numbers), prepend=-1) != 0
    fresh[at] = True
    start = np.flatnonzero(fresh)
    along = np.lexsort((s.extraction_index[order], x0, np.cumsum(fresh)))
    words, odd = [s.text[i] for i in order[along].tolist()], ODD.search("".join(s.text)) is not None
    texts = [_line_text("".join(words[a:b]), odd) for a, b in zip(start.tolist(), [*start[1:].tolist(), len(words)], strict=True)]
    side = side[start]
    x0, y0, x1, y1 = np.minimum.reduceat(x0, start), np.minimum.reduceat(y0, start), np.maximum.reduceat(x1, start), np.maximum.reduceat(y1, start)

    # blocks
    page, high = side // 5, np.maximum(1.0, y1 - y0)
    first, many = _starts(page), np.bincount(page, minlength=len(keys))
    median = np.zeros(len(keys))
    median[page[first]] = high[np.lexsort((high, page))][first + many[page[first]] // 2]
    order = np.lexsort((x0, y0, side))
    side, x0, y0, x1, y1, texts = side[order], x0[order], y0[order], x1[order], y1[order], [texts[i] for i in order.tolist()]
    page = side // 5
    mark = np.fromiter((MARK.match(x) is not None for x in texts), bool, len(texts))
    gap, outdent, tall = np.r_[0.0, y0[1:] - y1[:-1]], np.r_[False, x0[1:] + 8 < x0[:-1]], median[page]
    edge = np.isin(side % 5, (0, 4))
    fresh = mark | np.where(edge, gap > tall * 0.35, (gap > tall * 0.85) | (outdent & (gap > tall * 0.5)))
    fresh[_starts(side)] = True
    start = np.flatnonzero(fresh)
    made = ["\n".join(texts[a:b]) for a, b in zip(start.tolist(), [*start[1:].tolist(), len(texts)], strict=True)]
    page, x0, y0, x1 = page[start], np.minimum.reduceat(x0, start), np.minimum.reduceat(y0, start), np.maximum.reduceat(x1, start)

    # reading order; ids, which end in the order of construction, decide between equals as strings
    nth, doc = _nth(page), doc_of[page]
    rank = np.empty(nth.max() + 1, np.int64)
    rank[np.argsort([str(i) for i in range(len(rank))])] = np.arange(len(rank))
    col = _column(x0, x1, y0, cut[doc], head[doc], foot[doc], width)
    order = np.lexsort((rank[nth], x0, y0, np.minimum(col, 1), page))  # a foot ties with the right column
    for i, d, c in zip(order.tolist(), doc[order].tolist(), col[order].tolist(), strict=True):
        yield d, made[i], "Header" if c == -2 else "Footer" if c == 2 else _tag(made[i])


def _tag(x: str) -> str:
    """The tag of ``tags.block_candidates`` that is first by priority."""
    if ("끝났" in x or "거두" in x or "수고하셨" in x) and ENDING.search(x):
        return "EndNotice"
    if PASSAGE.search(x):
        return "PassageGroup"
    lined = "\n" + x
    if (m := QUESTION.search(lined)) and 1 <= int(m[1] or m[2]) <= 45:
        return "Question"
    if CHOICE.search(lined):
        return "Choice"
    if "보" in x and EXAMPLE.search(x):
        return "ExampleBox"
    return "Footnote" if FOOTNOTE.search(lined) else ""


def tree(found: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Node type and text in tree order, from text and tag of a document's blocks (``semantics.assign``, ``tree``)."""
    rows: list[tuple[int, tuple, str, str]] = []  # epoch, path (None: where the group is closed), type, text
    ends: list[int] = [0]
    group, asked, nth, pos = False, 0, 0, 0
    for x, tag in found:
        if not x.strip(WHITE):
            continue
        pos += 1
        if tag == "PassageGroup" or tag in FLUSH:
            ends.append(pos)
            group, asked, nth = tag == "PassageGroup", 0, 0
        ends[-1] = pos
        above: tuple = (None,) if group else ()
        if tag == "PassageGroup":
            path: tuple = (None,)
        elif tag in FLUSH:
            path = (pos,)
        elif tag == "Question":
            path, asked, nth = (*above, pos), pos, 0
        elif tag == "Footnote":
            path = (*above, pos)
        elif tag == "Choice":
            path, tag = ((*above, asked, pos), tag) if asked else ((pos,), "Unknown")
        else:
            path = (*above, asked, pos) if asked else (*above, pos)
            if not tag:
                nth += 1
                tag = ("Prompt" if nth == 1 else "Paragraph") if asked else "Passage" if group else "Unknown"
        rows.append((len(ends) - 1, path, tag, x))
    placed = sorted((tuple(ends[epoch] + 0.5 if at is None else at for at in path), i) for i, (epoch, path, _, _) in enumerate(rows))
    return [rows[i][2:] for _, i in placed]


def skip_header(x: str) -> bool:
    """``text.skip_header``."""
    s = x.strip(WHITE)
    subject = "학년도" not in s and "교시" not in s and "국어" in s and len(s) < 24
    return not s or re.fullmatch("[0-9]{1,3}", s) is not None or re.fullmatch(rf"[{WHITE}━─=_\-]+", s) is not None or (subject and (re.search(f"[0-9][{WHITE}]*고[0-9]", s) is not None or s.startswith("국어")))


def header_lines(x: str) -> list[tuple[str, str]]:
    """``text.header_lines``: (align, ink) of each line of a running head."""
    if skip_header(x):
        return []
    s = WHITES.sub(" ", x).strip(WHITE).replace("교시국어", "교시 국어").replace("국어영역", "국어 영역")
    s = re.sub(r"고\s+([0-9])", r"고\1", s, flags=re.ASCII)
    s = re.sub(r"제\s*([0-9]+)\s*교시", r"제\1교시", s, flags=re.ASCII)
    if m := TITLE.search(s):
        return [("left", m[1]), ("left", m[2])]
    if m := PERIOD.search(s):
        return [("center", f"제{m[1]}교시"), ("center", "국어 영역")]
    rest = re.sub(r"\s+[0-9]{1,3}\s*$", "", s, flags=re.ASCII).strip(WHITE)
    return [("left", rest)] if rest and not skip_header(rest) else []


def _pad(align: str, cells: str, width: int = 32) -> str:
    body = cells.strip(WHITE)
    lead = (width - len(body)) // 2 if align == "center" else 2
    return body[:width] if len(body) >= width else " " * lead + body if body else ""


def pages(nodes: list[tuple[str, str]], lines_per_page: int = LINES_PER_PAGE, width: int = CELLS_PER_LINE) -> str | None:
    """The paginated text of a document's nodes (``layout.sequences``, ``rows``, ``paginate``); None if they give nothing."""
    rows, before = [""], ""
    for kind, x in nodes:
        if kind == "Header":
            heads = header_lines(x)
            if not heads:
                continue
            coded = encode_text("\n".join(ink for _, ink in heads)).split("\n")
            body = "\n".join(_pad(align, c) for (align, _), c in zip(heads, coded, strict=True)).split("\n")
        elif kind == "Footer" and re.fullmatch("[0-9]+", x.strip(WHITE)):
            continue
        else:
            body = wrap_row(encode_text(x), width, INDENTS.get(kind, 0))
        if (before == "Header" and kind in ("Header", "PassageGroup")) or (before in ("Passage", "ExampleBox") and kind == "Question"):
            rows.append("")
        elif kind == "ExampleBox":
            rows.append(SEPARATOR_ROW)
        rows += [r[:width] for r in body]
        if kind == "PassageGroup":
            rows.append(SEPARATOR_ROW)
        before = kind
    if not before:
        return None
    n, out = lines_per_page, []
    for at in range(0, len(rows), n):
        page = rows[at : at + n]
        out.append("\n".join(["", *page][:n] if at and page[0] else page))
    return "\x0c".join(out)


def texts(s: Spans, docs: int, width: float, height: float) -> list[str | None]:
    """The paginated text of each of the documents."""
    found: list[list[tuple[str, str]]] = [[] for _ in range(docs)]
    for d, x, tag in blocks(s, docs, width, height):
        found[d].append((x, tag))
    return [pages(tree(x)) for x in found]


def convert(docs: DataFrame, spans: Callable[[list[str | None]], Spans], width: float, height: float) -> DataFrame:
    """doc_id, text from documents (doc_id, text), each in one row; ``spans`` gives those of some texts. Documents
    that give nothing have no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + SLICE_BYTES, side="right")))
                part = batch.slice(at, to - at)
                made = pa.array(texts(spans(part.column(1).to_pylist()), part.num_rows, width, height), pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), made], ["doc_id", "text"]).filter(made.is_valid())
                at = to

    kept = docs.where("doc_id is not null").select("doc_id", "text")
    return kept.mapInArrow(run, kept.schema)
