"""Tags and notes of lines and blocks: applying, exporting, accepting, editing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

VERSION = 1


def apply(lines: DataFrame, annotations: DataFrame) -> DataFrame:
    """``lines`` with tags and notes replaced where an annotation (doc_id, nth, global_index, tags, notes) names
    the line; the last one wins, and replaces notes even by null. Others are ignored."""
    order = Window.partitionBy("doc_id", "global_index").orderBy(F.col("nth").desc())
    last = annotations.withColumn("k", F.row_number().over(order)).where("k = 1")
    last = last.select("doc_id", "global_index", F.coalesce("tags", F.array().cast("array<string>")).alias("new_tags"), F.col("notes").alias("new_notes"), F.lit(True).alias("hit"))
    rows = lines.join(last, ["doc_id", "global_index"], "left")
    return rows.withColumn("tags", F.coalesce("new_tags", "tags")).withColumn("notes", F.when(F.col("hit"), F.col("new_notes")).otherwise(F.col("notes"))).drop("new_tags", "new_notes", "hit")


def applied_count(lines: DataFrame, annotations: DataFrame) -> DataFrame:
    """doc_id, applied: annotations that name a line, each counted."""
    return annotations.join(lines.select("doc_id", "global_index"), ["doc_id", "global_index"]).groupBy("doc_id").agg(F.count("*").alias("applied"))


def export(lines: DataFrame) -> DataFrame:
    """The lines that have tags or notes."""
    return lines.where((F.size("tags") > 0) | (F.coalesce("notes", F.lit("")) != "")).select("doc_id", "global_index", "page_index", "line_index", "tags", "notes")


def export_json(lines: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, json: one annotation record a document. ``docs``: doc_id, source_path."""
    line = F.struct("global_index", "page_index", "line_index", "tags", "notes")
    kept = F.filter(F.array_sort(F.collect_list(line)), lambda x: (F.size(x["tags"]) > 0) | (F.coalesce(x["notes"], F.lit("")) != ""))
    per = lines.groupBy("doc_id").agg(F.count("*").alias("line_count"), F.count_distinct("page_index").alias("page_count"), kept.alias("lines"))
    return per.join(docs, "doc_id").select("doc_id", F.to_json(F.struct(F.lit(VERSION).alias("version"), "source_path", "line_count", "page_count", "lines"), {"ignoreNullFields": "false"}).alias("json"))


def accept_candidates(rows: DataFrame, where=None) -> DataFrame:
    """Candidates become tags where there are none (and ``where`` holds)."""
    ok = F.size("tags") == 0
    return rows.withColumn("tags", F.when(ok if where is None else ok & where, F.col("candidate_tags")).otherwise(F.col("tags")))


def parse_tags(x):
    """Tags of a comma-separated list: trimmed, without empty ones."""
    return F.filter(F.transform(F.split(x, ","), F.trim), lambda t: t != "")
