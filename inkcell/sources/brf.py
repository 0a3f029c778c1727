"""Braille text files: bytes to documents and lines, and back to files."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import cells, tags
from ..functions.decode import decode
from ..operators import lines as L


def _fallback(x: pd.Series) -> pd.Series:
    def one(b: bytes | None) -> str | None:
        if b is None:
            return None
        try:
            return bytes(b).decode("cp949")
        except UnicodeDecodeError:
            return bytes(b).decode("latin-1")

    return x.map(one)


fallback = F.pandas_udf(_fallback, StringType())


def decode_bytes(content: Column) -> Column:
    """UTF-8 (a byte order mark stays), else code page 949, else Latin-1."""
    ok = F.is_valid_utf8(content.cast("string"))
    return F.when(ok, content.cast("string")).otherwise(fallback(F.when(~ok, content)))


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (the path), text of every file under ``path``."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.col("path").alias("doc_id"), decode_bytes(F.col("content")).alias("text"))


def line(lines: DataFrame, doc_id, global_index: int):
    """One line's row; IndexError if there is none."""
    row = lines.where((F.col("doc_id") == doc_id) & (F.col("global_index") == global_index)).first()
    if row is None:
        raise IndexError(global_index)
    return row


def annotated(docs: DataFrame, annotations: DataFrame) -> DataFrame:
    """``parsed`` lines of documents with their annotations (doc_id, nth, global_index, tags, notes) applied."""
    from ..operators.annotations import apply

    return apply(parsed(docs), annotations)


def parsed(docs: DataFrame) -> DataFrame:
    """Lines with unicode_braille, reverse_text, candidate_tags, empty tags and null notes; what isn't used
    is never computed."""
    rows = L.parse(docs).withColumn("unicode_braille", cells.to_unicode(cells.normalize(F.col("raw_ascii")))).withColumn("reverse_text", decode(F.col("raw_ascii")))
    return rows.withColumns({"candidate_tags": tags.line_candidates(F.col("raw_ascii"), F.col("reverse_text")), "tags": F.array().cast("array<string>"), "notes": F.lit(None).cast("string")})


def write(texts: DataFrame, path: str) -> None:
    """One file part a partition, a document a row: doc_id and text as JSON lines, since a Spark writer has
    no file a row. ``export_files`` gives single files."""
    texts.select("doc_id", "text").write.mode("errorifexists").json(path)


def export_files(texts: DataFrame, path: str, suffix: str = ".brf") -> DataFrame:
    """doc_id, uri: one file a document under ``path`` (any file system that Arrow opens), written whole under
    another name and then renamed. Names are percent-encoded ids, so each has its own and gives its id back;
    null and repeated ids are refused."""
    from urllib.parse import quote

    import pyarrow as pa

    if bad := texts.groupBy("doc_id").count().where("count > 1 or doc_id is null").first():
        raise ValueError(f"no file of its own for doc_id {bad['doc_id']}")

    def run(batches):
        from pyarrow import fs
        from pyspark import TaskContext

        store, root = fs.FileSystem.from_uri(path)
        store.create_dir(root, recursive=True)
        for batch in batches:
            uris = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                name = f"{root}/{quote(str(doc), safe='')}{suffix}"
                own = f"{name}.{TaskContext.get().taskAttemptId()}"
                with store.open_output_stream(own, compression=None) as f:
                    f.write((text or "").encode())
                store.move(own, name)
                uris.append(name)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(uris, pa.string())], names=["doc_id", "uri"])

    kind = dict(texts.dtypes)["doc_id"]
    return texts.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, uri string")
