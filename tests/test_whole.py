"""The chain over documents that lie whole in a row, against the chain over spans as rows."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkcell import catalog
from inkcell.functions import text
from inkcell.operators import whole
from inkcell.plans import pipeline
from inkcell.plans import views as V

ODD = [
    None, "", " ", "\n", "\n\n a", "a  b\tc\r\nd", " 　 \x1c x\x1fy  ", "\t", "\x0c\n\x85  ", "1. " + "word " * 400, ("=" * 9 + " ") * 30 + "z " * 900, "[1~3] a\n2. b\n① c ② d\n<보 기> e\n* f\n시험이 끝났\n45. g\n46. h\n3) i",
    "━" * 8 + "\n" + "가나다 12 ABC, (d) " * 300, "x" * 700, ("long" * 30 + " s ") * 60, "[ 4 - 7 ]\n" * 60, "문제지 거두 문제지 거두", "---===---- " * 200, "\n".join(["5. q", "b", "c", "1) x", "<보기>", "y", "6. z"] * 30), "😀 " * 200,
]
TEXTS = ["2026 학년도 6월 고2 전국연합학력평가 문제지 3", "제 1 교시국어영역", "국어 고2", "12", "머리 글 7", "=" * 12, "----====", "━━━━━━━━", "[1~3] 다음", "1. 물음", "50. 물음", "① 가", "ㄱ. 나", "<보 기>", "* 주", "시험이 끝났", " ", "　", "ab Cd", "가 나", "3", "[ 4 - 5 ]"]


@pytest.fixture
def odd(spark, tmp_path):
    rows = [(i, x) for i, x in enumerate(ODD)] + [(None, "no id")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def got(df):
    rows = df.collect()
    out = {r["doc_id"]: r["text"] for r in rows}
    assert len(out) == len(rows)
    return out


def test_convert_spans_equals_chain_of_rows(spark, sf, odd, monkeypatch):
    for d in (sf, odd):
        fast = got(catalog.QUERIES["convert_spans"](spark, d))
        with monkeypatch.context() as m:
            m.setattr(whole, "MOST_CHARS", 300)  # some go one way, some the other
            assert got(catalog.QUERIES["convert_spans"](spark, d)) == fast
            m.setattr(whole, "MOST_CHARS", -1)
            assert got(catalog.QUERIES["convert_spans"](spark, d)) == fast
        assert fast


def test_convert_spans_writes_its_result_only(spark, sf):
    catalog.materialize(spark.range(1), "first")
    where = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(os.listdir(where))
    out = catalog.QUERIES["convert_spans"](spark, sf)
    assert [x.split("-")[0] for x in set(os.listdir(where)) - before] == ["converted"] and out.count()


def test_whole_function_moves_nothing(spark, sf):
    plan = whole.convert(V.table(spark, sf, "documents"), V.span_arrays, 595.0, 842.0)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Exchange" not in plan


def test_span_arrays_equal_spans(spark, odd):
    s = V.span_arrays(ODD)
    arrays = sorted(zip(s.doc.tolist(), s.page_number.tolist(), s.text, s.x0.tolist(), s.y0.tolist(), s.x1.tolist(), s.y1.tolist(), s.font_size.tolist(), s.extraction_index.tolist(), strict=True))
    rows = V.spans(spark, odd).where("doc_id is not null").drop("id").collect()
    assert arrays == sorted(tuple(r) for r in rows)


def test_any_spans_equal_chain_of_rows(spark):
    rng, rows, docs = random.Random(5), [], 60
    for d in range(docs):
        for p in range(1, rng.randint(1, 5) + 1):
            for i in range(rng.randint(1, 40)):
                x, y = rng.choice([40, 60, 200, 300, 330, 400]) + rng.random() * rng.choice([0, 30]), rng.choice([20, 45, 60, 70, 100, 104, 110, 124, 150, 400, 760, 790, 830]) + rng.choice([0, 0, 1.5, 4])
                rows.append((d, p, f"s{p}-{i}", rng.choice(TEXTS), float(x), float(y), float(x + rng.choice([10, 80, 200, 310])), float(y + rng.choice([8, 11, 14])), rng.choice([0.0, 9.0, 11.0]), p * 1000 + i))
    spans = spark.createDataFrame(rows, "doc_id long, page_number int, id string, text string, x0 double, y0 double, x1 double, y1 double, font_size double, extraction_index int")
    sizes = spans.select("doc_id").distinct().select("doc_id", F.lit(595.0).alias("page_width"), F.lit(842.0).alias("page_height"))
    want = got(pipeline.convert(spans, sizes).text)
    d, p, _, t, *rest = zip(*rows, strict=True)
    made = whole.texts(whole.Spans(np.array(d), np.array(p), list(t), *map(np.array, rest)), docs, 595.0, 842.0)
    assert {i: x for i, x in enumerate(made) if x is not None} == want


def test_header_lines_equal_columns(spark):
    xs = TEXTS + ["제1교시 국어 영역 4", "고 2 국어  영역 12", "국어영역 3고2", "", "　= =", "머리 12 34\n", "제 12\n교시국어영역", "\x1c"]
    rows = spark.createDataFrame(list(enumerate(xs)), "n int, x string").select("n", text.header_lines(F.col("x")).alias("h")).orderBy("n").collect()
    assert [[tuple(y) for y in r["h"]] for r in rows] == [whole.header_lines(x) for x in xs]
