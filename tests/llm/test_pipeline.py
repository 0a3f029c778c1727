"""The pipeline's stages on planted rows, and the SQL of the queries."""

import glob
import os

import duckdb
import pytest

import corpus_pipeline
from inkcell.llm import queries
from inkcell.llm.queries import table


def test_stages(spark, sf):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "n-gram Jaccard join", "suffix-array dedup", "benchmark decontamination", "packing"]
    docs = table(spark, sf, "documents")
    item = table(spark, sf, "benchmark").first().text
    first = docs.orderBy("doc_id").first()
    words = [f"unikat{i}" for i in range(300)]
    passage = " ".join(f"passage{i}" for i in range(70))
    own = lambda c: " ".join(f"{c}{i}" for i in range(80))
    near = list(words)
    near[150] = "changed"
    planted = {90001: " ".join(words), 90002: " ".join(near), 90003: f"alpha beta {item} gamma", 90004: f"erste {passage} {own('x')}", 90005: f"other {passage} {own('y')}", 90006: first.text}
    extra = spark.createDataFrame([(i, t, "en", "planted", len(t)) for i, t in planted.items()], docs.schema)
    rows = docs.unionByName(extra)
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, rows, sf).cache()
        assert out.columns == docs.columns
        ids = {r.doc_id for r in out.select("doc_id").collect()}
        if i == 1:
            assert {90001, 90004, 90005} <= ids and not {90002, 90006} & ids
        if i == 2:
            text = {r.doc_id: r.text for r in out.where("doc_id in (90004, 90005)").collect()}
            assert passage in text[90004] and "passage30" not in text[90005] and text[90005].startswith("other")
        if i == 3:
            assert 90003 not in ids and 90004 in ids
        rows = out
    assert corpus_pipeline.STAGES[-1][1](spark, rows, sf).count() >= rows.count()


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, sf, name):
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    ran = con.execute(queries.SQL[name])
    columns = [x[0] for x in ran.description]
    want = sorted(map(repr, ran.fetchall()))
    got = queries.QUERIES[name](spark, sf).toArrow()
    assert sorted(map(repr, zip(*(got[c].to_pylist() for c in columns), strict=True))) == want
