"""JSON records of page structure and annotations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPAN = "struct<id:string,text:string,bbox:array<double>,font:string,font_size:double,is_bold:boolean,page_number:int,extraction_index:int>"
LINE = "struct<id:string,text:string,bbox:array<double>,span_ids:array<string>,page_number:int,reading_order:int>"
BLOCK = "struct<id:string,text:string,bbox:array<double>,line_ids:array<string>,page_number:int,reading_order:int,candidate_tags:array<string>,tags:array<string>,notes:string>"
STRUCTURE = f"source_path string, page_count int, metadata string, pages array<struct<page_number:int,width:double,height:double,spans:array<{SPAN}>,lines:array<{LINE}>,blocks:array<{BLOCK}>>>"
ANNOTATIONS = "version int, source_path string, line_count int, page_count int, lines array<struct<global_index:int,page_index:int,line_index:int,tags:array<string>,notes:string>>"


def structure_path(path: str) -> str:
    return f"{path}.structure.json"


def annotation_path(path: str) -> str:
    return f"{path}.annotations.json"


def read_structure(spark: SparkSession, path: str) -> DataFrame:
    """One row a file, with doc_id; a field of the wrong type fails the read."""
    return spark.read.schema(STRUCTURE).option("mode", "FAILFAST").json(path, multiLine=True).withColumn("doc_id", F.input_file_name())


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, nth, global_index, tags, notes."""
    files = spark.read.schema(ANNOTATIONS).option("mode", "FAILFAST").json(path, multiLine=True)
    flat = files.select(F.col("source_path").alias("doc_id"), F.posexplode("lines").alias("nth", "a"))
    return flat.select("doc_id", "nth", "a.global_index", "a.tags", "a.notes")


def part(structures: DataFrame, name: str) -> DataFrame:
    """Spans, lines or blocks of structures, flat, the box as four columns."""
    rows = structures.select("doc_id", F.explode("pages").alias("p")).select("doc_id", F.explode(f"p.{name}").alias("r")).select("doc_id", "r.*")
    box = F.col("bbox")
    return rows.withColumns({c: box[i] for i, c in enumerate(("x0", "y0", "x1", "y1"))}).drop("bbox")


def page(structures: DataFrame, doc_id, page_number: int):
    """One page's record; KeyError if there is none."""
    rows = structures.where(F.col("doc_id") == doc_id).select(F.explode("pages").alias("p")).where(F.col("p.page_number") == page_number)
    row = rows.first()
    if row is None:
        raise KeyError(page_number)
    return row["p"]


def to_json(pages: DataFrame) -> DataFrame:
    """doc_id, json from doc_id, source_path, page_count, metadata, pages."""
    return pages.select("doc_id", F.to_json(F.struct("source_path", "page_count", "metadata", "pages")).alias("json"))
