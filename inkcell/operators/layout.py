"""Encoded nodes to rows and pages."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from ..functions import encode, text
from ..functions.decode import wrap
from ..functions.tables import SEPARATOR_ROW

CELLS_PER_LINE, LINES_PER_PAGE, INDENT = 32, 26, 2


def sequences(nodes: DataFrame) -> DataFrame:
    """doc_id, seq_no, node_id, node_type, ascii, preformatted: encoded text of all nodes in tree order.

    Heads are split, encoded and padded line by line; heads that are skipped, feet with a page number only
    and nodes without text give nothing.
    """
    raw = F.coalesce("text", F.lit(""))
    heads = text.header_lines(raw)  # their inks are encoded as one text: a line each
    coded = F.split(encode.text(F.array_join(F.transform(heads, lambda h: h["ink"]), "\n")), "\n", -1)
    head = F.array_join(F.zip_with(heads, coded, lambda h, c: text.pad_header(h["align"], c)), "\n")
    is_head = F.col("node_type") == "Header"
    page_no = (F.col("node_type") == "Footer") & text.strip(raw).rlike("^[0-9]+$")
    rows = nodes.where((F.col("node_type") != "ExamDocument") & (raw != "") & ~page_no)
    rows = rows.withColumn("ascii", F.when(is_head, head).otherwise(encode.text(raw))).withColumn("preformatted", is_head)
    rows = rows.where(~is_head | (F.size(text.header_lines(raw)) > 0))
    order = Window.partitionBy("doc_id").orderBy("dfs_order")
    return rows.select("doc_id", (F.row_number().over(order) - 1).alias("seq_no"), "node_id", "node_type", "ascii", "preformatted")


def indent(node_type: Column, choice: int = INDENT, paragraph: int = INDENT) -> Column:
    return F.when(node_type.isin("Choice", "Question", "PassageGroup"), choice).when(node_type.isin("Paragraph", "Passage", "Prompt", "ExampleBox"), paragraph).otherwise(0)


def insertions(seqs: DataFrame) -> DataFrame:
    """Adds ``before``: the row, if any, that goes before a sequence ('' or a separator; null: none)."""
    prev = F.lag("node_type").over(Window.partitionBy("doc_id").orderBy("seq_no"))
    now = F.col("node_type")
    blank = (prev == "Header") & now.isin("Header", "PassageGroup") | prev.isin("Passage", "ExampleBox") & (now == "Question")
    return seqs.withColumn("before", F.when(F.coalesce(blank, F.lit(False)), "").when(now == "ExampleBox", SEPARATOR_ROW))


def rows(seqs: DataFrame, width: int = CELLS_PER_LINE) -> DataFrame:
    """doc_id, row_no, node_id, ascii_text: a blank row, then each sequence's rows with what goes around."""
    made = insertions(seqs)
    body = F.when(F.col("preformatted"), F.split("ascii", "\n", -1)).otherwise(wrap(F.col("ascii"), F.lit(width), indent(F.col("node_type"))))
    cut = F.transform(body, lambda r: F.substring(r, 1, width))
    row = lambda x, node: F.struct(node.alias("node_id"), x.alias("ascii_text"))
    nobody = F.lit(None).cast("string")
    parts = F.concat(
        F.when(F.col("before").isNotNull(), F.array(row(F.col("before"), nobody))).otherwise(F.array().cast("array<struct<node_id:string,ascii_text:string>>")),
        F.transform(cut, lambda r: row(r, F.col("node_id"))),
        F.when(F.col("node_type") == "PassageGroup", F.array(row(F.lit(SEPARATOR_ROW), nobody))).otherwise(F.array().cast("array<struct<node_id:string,ascii_text:string>>")),
    )
    flat = made.select("doc_id", "seq_no", F.posexplode(parts).alias("part_no", "r")).select("doc_id", "seq_no", "part_no", "r.*")
    first = made.select("doc_id").distinct().select("doc_id", F.lit(-1).alias("seq_no"), F.lit(0).alias("part_no"), nobody.alias("node_id"), F.lit("").alias("ascii_text"))
    every = flat.unionByName(first)
    return every.select("doc_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("seq_no", "part_no")) - 1).alias("row_no"), "node_id", "ascii_text")


def paginate(rows: DataFrame, lines_per_page: int = LINES_PER_PAGE, compat_truncate: bool = True) -> DataFrame:
    """doc_id, page_index, line_index, node_id, ascii_text.

    A later page begins with a blank row. ``compat_truncate``: the blank pushes the last row off a full page
    (what the established output has); otherwise pages hold one row less where they begin with text, so
    nothing is lost. Row numbers, from 0 without gaps, decide the page: in the first case by themselves, in the
    second with one bit a row, from which the pages' first rows follow.
    """
    n = max(1, lines_per_page)
    if compat_truncate:
        page = F.floor(F.col("row_no") / n).cast("int")
        at = F.col("row_no") % n
        first = F.first("ascii_text").over(Window.partitionBy("doc_id", page).orderBy("row_no"))
        shift = ((page > 0) & (first != "")).cast("int")
        laid = rows.select("doc_id", page.alias("page_index"), (at + shift).cast("int").alias("line_index"), "node_id", "ascii_text", shift.alias("shift"))
        lines = laid.where(F.col("line_index") < n)
        blanks = lines.where((F.col("shift") == 1) & (F.col("line_index") == 1)).select("doc_id", "page_index", F.lit(0).alias("line_index"), F.lit(None).cast("string").alias("node_id"), F.lit("").alias("ascii_text")) if n > 1 else laid.where((F.col("shift") == 1) & (F.col("line_index") == 1)).select("doc_id", "page_index", F.lit(0).alias("line_index"), F.lit(None).cast("string").alias("node_id"), F.lit("").alias("ascii_text"))
        return lines.drop("shift").unionByName(blanks)
    dealt = rows.repartition("doc_id")
    blank = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_no", (F.col("ascii_text") == "").cast("int").cast("string").alias("blank")))), lambda x: x["blank"]), "")
    starts = dealt.groupBy("doc_id").agg(blank.alias("blank")).select("doc_id", F.posexplode(_page_starts(F.col("blank"), F.lit(n))).alias("page_index", "row_no"))
    order = Window.partitionBy("doc_id").orderBy("row_no", F.col("start").desc()).rowsBetween(Window.unboundedPreceding, 0)
    both = dealt.select("doc_id", "row_no", F.lit(False).alias("start"), F.lit(None).cast("int").alias("page_index"), "node_id", "ascii_text").unionByName(
        starts.select("doc_id", F.col("row_no").cast("long").alias("row_no"), F.lit(True).alias("start"), "page_index", F.lit(None).cast("string").alias("node_id"), F.lit(None).cast("string").alias("ascii_text")))
    page = F.last(F.when(F.col("start"), F.struct("page_index", "row_no")), ignorenulls=True).over(order)
    laid = both.withColumn("page", page).where(~F.col("start"))
    first = F.first("ascii_text").over(Window.partitionBy("doc_id", "page.page_index").orderBy("row_no"))
    shift = ((F.col("page.page_index") > 0) & (first != "") & F.lit(n > 1)).cast("int")
    at = (F.col("row_no") - F.col("page.row_no")).cast("int")
    laid = laid.select("doc_id", F.col("page.page_index").alias("page_index"), (at + shift).alias("line_index"), "node_id", "ascii_text", (at == 0).alias("top"), shift.alias("shift"))
    nobody = F.lit(None).cast("string")
    parts = F.when(F.col("top") & (F.col("shift") == 1), F.array(F.struct(F.lit(0).alias("line_index"), nobody.alias("node_id"), F.lit("").alias("ascii_text")), F.struct("line_index", "node_id", "ascii_text"))).otherwise(F.array(F.struct("line_index", "node_id", "ascii_text")))
    return laid.select("doc_id", "page_index", F.explode(parts).alias("r")).select("doc_id", "page_index", "r.*")


def _starts(blank: pd.Series, n: pd.Series) -> pd.Series:
    """The rows that pages begin with: a later page holds a row less if it begins with text."""

    def one(flags: str, n: int) -> list[int]:
        out, at = [], 0
        while at < len(flags):
            out.append(at)
            at += n - (len(out) > 1 and n > 1 and flags[at] == "0")
        return out

    return pd.Series([one(x, int(y)) for x, y in zip(blank, n, strict=True)])


_page_starts = F.pandas_udf(_starts, ArrayType(IntegerType()))


def plain(seqs: DataFrame, lines_per_page: int = LINES_PER_PAGE - 2) -> DataFrame:
    """The stand-in layout: one row a source line, no wrapping, the margins taken off the page."""
    flat = seqs.select("doc_id", "seq_no", "node_id", F.posexplode(F.split("ascii", "\n", -1)).alias("part_no", "ascii_text"))
    no = F.row_number().over(Window.partitionBy("doc_id").orderBy("seq_no", "part_no")) - 1
    return flat.select("doc_id", F.floor(no / lines_per_page).cast("int").alias("page_index"), (no % lines_per_page).alias("line_index"), "node_id", "ascii_text")
