import json

import pytest
from pyspark.sql import functions as F

from inkcell.functions import decode
from inkcell.sources import brf, pdf, records
from inkcell.streaming import drop


def test_brf_files(spark, tmp_path):
    (tmp_path / "a.brf").write_bytes("#a 가\n\x0cb\n".encode())
    (tmp_path / "b.brf").write_bytes("가나".encode("cp949"))
    (tmp_path / "c.brf").write_bytes(b"\xef\xbb\xbfx")
    got = {r.doc_id[-5]: r.text for r in brf.read(spark, str(tmp_path)).collect()}
    assert got == {"a": "#a 가\n\x0cb\n", "b": "가나", "c": "﻿x"}
    rows = brf.parsed(brf.read(spark, str(tmp_path))).where(F.col("doc_id").endswith("a.brf")).orderBy("global_index").collect()
    assert [r.page_index for r in rows] == [0, 1] and rows[1].reverse_text == "ㅂ" or rows[1].unicode_braille == "⠃"


def test_export(spark, tmp_path):
    rows = spark.createDataFrame([("d1", "abc\n"), ("d2", None)], "doc_id string, text string")
    uris = sorted(r.uri for r in brf.export_files(rows, f"file://{tmp_path}/out").collect())
    assert [open(u).read() for u in uris] == ["abc\n", ""]
    rows = spark.createDataFrame([("a/b", "1"), ("a_b", "2"), ("..", "3")], "doc_id string, text string")
    found = {r.doc_id: r.uri for r in brf.export_files(rows, f"file://{tmp_path}/more").collect()}
    assert len(set(found.values())) == 3 and {d: open(u).read() for d, u in found.items()} == {"a/b": "1", "a_b": "2", "..": "3"}
    for bad in ([("a", "1"), ("a", "2")], [(None, "1")]):
        with pytest.raises(ValueError):
            brf.export_files(spark.createDataFrame(bad, "doc_id string, text string"), f"file://{tmp_path}/bad")


def test_lookups(spark):
    docs = spark.createDataFrame([("d", "#a4 `u\n\x0c`mas")], "doc_id string, text string")
    assert brf.line(brf.parsed(docs), "d", 1).reverse_text == "국어"
    with pytest.raises(IndexError):
        brf.line(brf.parsed(docs), "d", 2)
    notes = spark.createDataFrame([("d", 0, 1, ["A"], "n"), ("d", 1, 9, ["B"], None)], "doc_id string, nth int, global_index int, tags array<string>, notes string")
    got = [(r.tags, r.notes) for r in brf.annotated(docs, notes).orderBy("global_index").collect()]
    assert got == [([], None), (["A"], "n")]
    one = spark.sql("select 'd' as doc_id, array(named_struct('page_number', 2, 'width', 1D)) as pages")
    assert records.page(one, "d", 2).width == 1.0
    with pytest.raises(KeyError):
        records.page(one, "d", 1)


def test_bold():
    assert pdf.is_bold(16, "x") and pdf.is_bold(0, "SomeBold") and not pdf.is_bold(0, "SomeBold", names=False)


def test_records(spark, tmp_path):
    path = tmp_path / "x.pdf.structure.json"
    span = {"id": "p1-s0", "text": "t", "bbox": [1.0, 2.0, 3.0, 4.0], "font": "f", "font_size": 9.0, "is_bold": False, "page_number": 1, "extraction_index": 0}
    path.write_text(json.dumps({"source_path": "x.pdf", "page_count": 1, "metadata": {"layout_profile": {"a": 1}}, "pages": [{"page_number": 1, "width": 10.0, "height": 20.0, "spans": [span], "lines": [], "blocks": []}]}))
    row = records.part(records.read_structure(spark, str(path)), "spans").first()
    assert (row.id, row.x0, row.y1) == ("p1-s0", 1.0, 4.0)
    note = tmp_path / "n.annotations.json"
    note.write_text(json.dumps({"version": 1, "source_path": "x.brf", "line_count": 1, "page_count": 1, "lines": [{"global_index": 3, "page_index": 0, "line_index": 3, "tags": ["A"], "notes": None}]}))
    assert records.read_annotations(spark, str(note)).select("doc_id", "nth", "global_index").collect() == [("x.brf", 0, 3)]
    assert records.structure_path("a.pdf") == "a.pdf.structure.json"


def test_sql_functions(spark):
    decode.register(spark)
    assert spark.sql("select decode_braille('`u') as x").first().x == "고"


def test_streaming(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.brf").write_text("#a\n#b\n")
    q = drop.lines(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("arrived").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    assert [r.reverse_text for r in spark.sql("select * from arrived order by global_index").collect()] == ["1", "2"]
