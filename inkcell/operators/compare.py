"""Cell by cell and segment by segment comparison of generated with reference braille."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tags
from ..functions.decode import similarity
from ..functions.text import clip, norm_ink, norm_line, strip

POSITION = ["doc_id", "page_index", "line_index"]


def equal_cells(a: Column, b: Column) -> Column:
    """Positions at which two normalised lines have the same cell; 1 if both are empty."""
    same = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.coalesce((x == y) & (x != "") & (y != ""), F.lit(False)).cast("int"))
    return F.when((a == "") & (b == ""), 1).otherwise(F.aggregate(same, F.lit(0), lambda s, x: s + x))


def total_cells(a: Column, b: Column) -> Column:
    return F.greatest(F.length(a), F.length(b), F.when((a == "") & (b == ""), 1).otherwise(0))


def compare_lines(generated: DataFrame, reference: DataFrame, page_limit: int | None = None) -> DataFrame:
    """One row a position on either side: generated, reference, matched, cell_equal, cell_total. A line that is
    missing counts as empty, so a blank line matches it. ``page_limit`` reaches both scans."""
    if page_limit:
        generated, reference = (x.where(F.col("page_index") < page_limit) for x in (generated, reference))
    g = generated.select(*POSITION, F.col("raw_ascii").alias("g"))
    r = reference.select(*POSITION, F.col("raw_ascii").alias("r"))
    both = g.join(r, POSITION, "full_outer")
    gn, rn = norm_line(F.coalesce("g", F.lit(""))), norm_line(F.coalesce("r", F.lit("")))
    both = both.withColumns({"gn": gn, "rn": rn})
    a, b = F.col("gn"), F.col("rn")
    return both.select(
        *POSITION, F.coalesce("g", F.lit("")).alias("generated"), F.coalesce("r", F.lit("")).alias("reference"), F.col("g").isNotNull().alias("in_generated"), F.col("r").isNotNull().alias("in_reference"),
        (a == b).alias("matched"), equal_cells(a, b).cast("long").alias("cell_equal"), total_cells(a, b).cast("long").alias("cell_total"),
    )


def summary(compared: DataFrame) -> DataFrame:
    """Totals and ratios of each document."""
    n = lambda c: F.sum(c.cast("long"))
    out = compared.groupBy("doc_id").agg(
        n(F.col("in_generated")).alias("generated_lines"), n(F.col("in_reference")).alias("reference_lines"), n(F.col("matched")).alias("matched_lines"),
        F.sum("cell_equal").alias("cell_equal"), F.sum("cell_total").alias("cell_total"),
    )
    return out.withColumns({
        "line_match_ratio": F.col("matched_lines") / F.greatest("generated_lines", "reference_lines", F.lit(1)),
        "cell_match_ratio": F.when(F.col("cell_total") == 0, 1.0).otherwise(F.col("cell_equal") / F.col("cell_total")),
    })


def first_diffs(compared: DataFrame, most: int = 200) -> DataFrame:
    """The first differences of each document; totals don't depend on this."""
    order = Window.partitionBy("doc_id").orderBy("page_index", "line_index")
    diffs = compared.where(~F.col("matched")).withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most)
    ratio = F.when(F.col("cell_total") == 0, (F.col("generated") == F.col("reference")).cast("double")).otherwise(F.col("cell_equal") / F.col("cell_total"))
    return diffs.withColumn("match_ratio", ratio)


def report(compared: DataFrame, most: int = 12) -> DataFrame:
    """doc_id, report: the summary as text, with the first differences."""
    s = summary(compared)
    order = F.array_sort(F.collect_list(F.struct("nth", F.format_string("  p%d L%d (%.0f%%)\n    gen: %s\n    ref: %s", F.col("page_index") + 1, F.col("line_index") + 1, F.bround(F.col("match_ratio") * 100), F.col("generated"), F.col("reference")).alias("t"))))
    diffs = first_diffs(compared, most).groupBy("doc_id").agg(F.array_join(F.transform(order, lambda x: x["t"]), "\n").alias("diffs"))
    head = F.format_string("lines %d/%d, matched %d (%.1f%%)\ncells %d/%d (%.1f%%)", "generated_lines", "reference_lines", "matched_lines", F.bround(F.col("line_match_ratio") * 100, 1), "cell_equal", "cell_total", F.bround(F.col("cell_match_ratio") * 100, 1))
    return s.join(diffs, "doc_id", "left").select("doc_id", F.concat_ws("\n", head, "diffs").alias("report"))


def line_views(lines: DataFrame, ink: str = "ink") -> DataFrame:
    """Adds ``kind`` to decoded lines."""
    return lines.withColumn("kind", tags.line_kind(F.col("raw_ascii"), F.col(ink)))


def segments(views: DataFrame) -> DataFrame:
    """doc_id, seg_no, key, kind, ink_text, ascii_text: runs of lines from one anchor to the next.

    ``views``: doc_id, global_index, raw_ascii, ink, kind. What comes before the first anchor is a preamble
    (guidance if it looks like it, gone if it has no ink); runs of blanks and separators alone are gone.
    """
    anchor = F.col("kind").isin("passage_group", "question")
    order = Window.partitionBy("doc_id").orderBy("global_index").rowsBetween(Window.unboundedPreceding, 0)
    rows = views.withColumn("seg_no", F.sum(anchor.cast("int")).over(order))
    key = F.when(F.col("kind") == "passage_group", tags.passage_key(F.col("raw_ascii"), F.col("ink"))).when(F.col("kind") == "question", tags.question_key(F.col("raw_ascii"), F.col("ink")))
    text = lambda c, ok=None: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("global_index", c) if ok is None else F.when(ok, F.struct("global_index", c)))), lambda x: x[c]), "\n")
    seg = rows.withColumn("k", key).groupBy("doc_id", "seg_no").agg(
        F.max("k").alias("key"), F.max(F.when(anchor, F.col("kind"))).alias("kind"), F.max((~F.col("kind").isin("blank", "separator")).cast("int")).alias("useful"),
        text("ink", strip(F.col("ink")) != "").alias("ink_text"), text("raw_ascii").alias("ascii_text"),
    )
    bare = strip(F.col("ink_text")) == ""
    found = F.col("ink_text").rlike(tags.PASSAGE_INK) | F.col("ink_text").rlike(tags.QUESTION_INK) | F.col("ascii_text").rlike(tags.PASSAGE_CELLS) | F.col("ascii_text").rlike(tags.QUESTION_CELLS)
    guidance = F.col("ink_text").rlike(tags.GUIDANCE) | ~found
    seg = seg.where(F.col("kind").isNotNull() | ((F.col("useful") == 1) & ~bare))
    return seg.select(
        "doc_id", "seg_no", F.coalesce("key", F.when(guidance, "guidance:preamble").otherwise("preamble")).alias("key"),
        F.coalesce("kind", F.when(guidance, "guidance").otherwise("preamble")).alias("kind"), "ink_text", "ascii_text",
    )


def last_of_key(segs: DataFrame) -> DataFrame:
    """Of segments with the same key, the last."""
    order = Window.partitionBy("doc_id", "key").orderBy(F.col("seg_no").desc())
    return segs.withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth")


def compare_segments(generated: DataFrame, reference: DataFrame, threshold: float = 0.72) -> DataFrame:
    """doc_id, classification, key, score, generated_ink, reference_ink: every anchored segment of either
    side, and the reference's guidance."""
    anchored = lambda x, name: last_of_key(x.where(F.col("kind").isin("passage_group", "question"))).select("doc_id", "key", F.col("ink_text").alias(name))
    both = anchored(generated, "generated_ink").join(anchored(reference, "reference_ink"), ["doc_id", "key"], "full_outer")
    g, r = F.col("generated_ink"), F.col("reference_ink")
    score = F.when(g.isNotNull() & r.isNotNull(), similarity(norm_ink(g), norm_ink(r))).otherwise(0.0)
    kind = F.when(r.isNull(), "missing_in_reference").when(g.isNull(), "missing_in_generated").when(F.col("score") >= threshold, "aligned_ok").otherwise("content_mismatch")
    rows = both.withColumn("score", score).withColumn("classification", kind)
    rows = rows.select("doc_id", "classification", "key", "score", F.coalesce(g, F.lit("")).alias("generated_ink"), F.coalesce(r, F.lit("")).alias("reference_ink"))
    expected = reference.where("kind = 'guidance'").select("doc_id", F.lit("expected_guidance").alias("classification"), "key", F.lit(0.0).alias("score"), F.lit("").alias("generated_ink"), F.col("ink_text").alias("reference_ink"))
    return rows.unionByName(expected)


def segment_summary(diffs: DataFrame) -> DataFrame:
    """Counts by class of each document, with aligned = aligned_ok + content_mismatch."""
    n = lambda *names: F.count_if(F.col("classification").isin(*names))
    return diffs.groupBy("doc_id").agg(
        n("aligned_ok", "content_mismatch").alias("aligned"), *(n(x).alias(x) for x in ("aligned_ok", "content_mismatch", "expected_guidance", "missing_in_generated", "missing_in_reference")),
    )


def ordered_diffs(diffs: DataFrame) -> DataFrame:
    """Mismatches by score, all else by key."""
    return diffs.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id", "classification").orderBy(F.when(F.col("classification") == "content_mismatch", F.col("score")).otherwise(0.0), tags.key_rank(F.col("key")))))


# Headings and details of the report.
HEADS = {
    "content_mismatch": "> 오류 후보", "expected_guidance": "> 예상 차이 (참고에만 있는 안내·메타 등)",
    "missing_in_generated": "> 생성본에 없는 시험 구간 (참고에만 있음)", "missing_in_reference": "> 참고본에 없는 생성 구간",
}
MISMATCH, GUIDANCE_ONLY = "정렬된 구간 내용 불일치", "참고본 안내·머리말 등으로 보임"


def content_report(diffs: DataFrame, generated: DataFrame, reference: DataFrame, most: int = 8, width: int = 72) -> DataFrame:
    """doc_id, report: counts of segments and classes, and the first ``most`` of each class, clipped. Mismatches
    come by score, all else by key. ``diffs``: of ``compare_segments`` over the two sides' segments."""
    clip_ = lambda c: clip(c, width)
    head = F.concat(F.lit("  ["), "key", F.lit("] "))
    line = (
        F.when(F.col("classification") == "content_mismatch", F.concat(head, F.lit("유사도 "), F.format_string("%.0f%%", F.bround(F.col("score") * 100)), F.lit(f" — {MISMATCH}\n    gen: "), clip_(F.col("generated_ink")), F.lit("\n    ref: "), clip_(F.col("reference_ink"))))
        .when(F.col("classification") == "expected_guidance", F.concat(head, F.lit(f"{GUIDANCE_ONLY}\n    ref: "), clip_(F.col("reference_ink"))))
        .when(F.col("classification") == "missing_in_generated", F.concat(head, clip_(F.col("reference_ink"))))
        .otherwise(F.concat(head, clip_(F.col("generated_ink"))))
    )
    rows = ordered_diffs(diffs).where(F.col("classification").isin(*HEADS)).withColumn("line", line)
    per = rows.groupBy("doc_id", "classification").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.when(F.col("rank") <= most, F.struct("rank", "line")))).alias("items"))
    more = F.when((F.col("n") > most) & F.col("classification").isin("content_mismatch", "expected_guidance"), F.concat(F.lit("\n  … 외 "), (F.col("n") - most).cast("string"), F.lit("건"))).otherwise("")
    title = F.create_map(*(F.lit(x) for kv in HEADS.items() for x in kv))
    place = F.array_position(F.lit(list(HEADS)), F.col("classification"))
    part = F.concat(F.lit("\n\n"), title[F.col("classification")], F.lit("\n"), F.array_join(F.transform("items", lambda x: x["line"]), "\n"), more)
    parts = per.withColumn("part", F.struct(place.alias("place"), part.alias("text"))).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("part")), lambda x: x["text"]), "").alias("parts"))
    sizes = generated.groupBy("doc_id").agg(F.count("*").alias("g")).join(reference.groupBy("doc_id").agg(F.count("*").alias("r")), "doc_id", "full_outer")
    all_ = sizes.join(segment_summary(diffs), "doc_id", "left").join(parts, "doc_id", "left").na.fill(0)
    top = F.format_string("=== 시험 내용 비교 (안내문 허용) ===\n구간 생성 %d / 참고 %d\n정렬됨 %d · 내용 일치 %d\n오류 후보(내용 불일치) %d\n예상 차이(안내·레이아웃 등) %d\n생성에 없음 %d · 참고에 없음 %d", "g", "r", "aligned", "aligned_ok", "content_mismatch", "expected_guidance", "missing_in_generated", "missing_in_reference")
    return all_.select("doc_id", F.concat(top, F.coalesce("parts", F.lit(""))).alias("report"))
