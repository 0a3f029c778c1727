"""Spans of PDF files, where PyMuPDF is installed; the rest of the engine starts from the table."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

SPANS = "doc_id string, page_number int, page_width double, page_height double, id string, text string, x0 double, y0 double, x1 double, y1 double, font string, font_size double, is_bold boolean, extraction_index int"


def is_bold(flags: int, font: str, names: bool = True) -> bool:
    """Flag 16, or (``names``) a bold font's name; profiles are inferred from the flag alone."""
    return bool(flags & 16) or names and any(w in font.lower() for w in ("bold", "black", "heavy"))


def render_pages(spark: SparkSession, path: str, zoom: float = 2.0) -> DataFrame:
    """doc_id, page_number, png: every page as a picture."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import fitz

        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                with fitz.open(stream=bytes(content), filetype="pdf") as doc:
                    for number, page in enumerate(doc, 1):
                        yield pd.DataFrame({"doc_id": [name], "page_number": [number], "png": [page.get_pixmap(matrix=fitz.Matrix(zoom, zoom)).tobytes("png")]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "doc_id string, page_number int, png binary")


def read_spans(spark: SparkSession, path: str, page_numbers: list[int] | None = None, bold_names: bool = True) -> DataFrame:
    """Text spans of every page (or the 1-based pages asked for; an empty list means all)."""
    wanted = set(page_numbers or ())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import fitz

        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                with fitz.open(stream=bytes(content), filetype="pdf") as doc:
                    for number, page in enumerate(doc, 1):
                        if wanted and number not in wanted:
                            continue
                        texts = [s for b in page.get_text("dict", flags=fitz.TEXT_PRESERVE_WHITESPACE)["blocks"] if b.get("type") == 0 for x in b["lines"] for s in x["spans"] if s["text"]]
                        yield pd.DataFrame([(name, number, page.rect.width, page.rect.height, f"p{number}-s{i}", s["text"], *map(float, s["bbox"]), s["font"], float(s["size"]), is_bold(s["flags"], s["font"], bold_names), i) for i, s in enumerate(texts)], columns=[c.split()[0] for c in SPANS.split(", ")])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, SPANS)
