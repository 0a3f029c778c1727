"""Texts longer than any slice, and the pipeline on empty tables, nulls, repeated rows and clashing columns."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from inkcell.llm import common, decontam, langid, ngram_join, packing, suffix_dedup, toxicity
from inkcell.llm.queries import word_vocabulary

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def long_texts():
    rng = random.Random(1)
    vocabulary = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(5000)]
    words = [rng.choice(vocabulary) for _ in range(450_000)]
    near = list(words)
    near[200_000] = "UNLIKE"
    item = "one two three four five six seven eight nine ten eleven"
    texts = [" ".join(words), " ".join(near), f"{' '.join(rng.choice(vocabulary) for _ in range(450_000))} {item} end", "short"]
    assert min(len(t) for t in texts[:3]) > common.SLICE_BYTES
    return texts, item


def test_long_texts(spark, long_texts):
    texts, item = long_texts
    docs = spark.createDataFrame([(i, t, "en", None, len(t)) for i, t in enumerate(texts)], DOCS).repartition(2)
    got = {r.doc_id: r for r in ngram_join.join(docs).collect()}
    assert [got[i].component_id for i in range(4)] == [0, 0, 2, 3]
    assert got[2].n_shingles == len({tuple(w) for w in zip(*(texts[2].split()[k:] for k in range(3)), strict=False)})
    bench = spark.createDataFrame([(5, item)], "item_id long, text string")
    hit = {r.doc_id: r for r in decontam.hits(docs, bench).collect()}
    n = len(texts[2].split())
    assert hit[2].n_words == n and [tuple(s) for s in hit[2].spans] == [(n - 12, n - 1)] and not hit[0].spans
    cut = {r.doc_id: r for r in suffix_dedup.digest(suffix_dedup.copies(docs)).collect()}
    at = texts[1].index("UNLIKE")
    # of each copy, what no window without the unlike word covers is left
    left = [t[at : at + len(t) - len(texts[0]) + len(texts[0].split()[200_000])] for t in texts[:1]]
    assert cut[1].n_bytes - cut[1].n_removed == len("UNLIKE") and cut[1].kept_sha256 == hashlib.sha256(b"UNLIKE").hexdigest()
    assert cut[0].n_spans in (1, 2) and cut[0].n_bytes - cut[0].n_removed == len(left[0]) and cut[2].n_removed == 0
    said = {r.doc_id: r.lang_pred for r in langid.identify(docs, langid.train(docs.select(F.col("lang").alias("label"), "text"))).collect()}
    assert set(said.values()) == {"en"}
    pieces = packing.pack(docs, word_vocabulary()).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("all")).collect()
    assert all(r.n == r["all"] for r in pieces) and len(pieces) == 4
    assert toxicity.keep_clean(docs, spark.createDataFrame([], "doc_id long, toxic int")).count() == 4


def test_prefix_free_slices(long_texts):
    import pyarrow as pa

    texts = ["", long_texts[0][0], None, "é", "x" * 10]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
    got = b"".join(data.tobytes() for _, data, _ in common.text_slices(batch, limit=1000))
    assert got == "".join(t or "" for t in texts).encode()
    assert sum(len(o) - 1 for _, _, o in common.text_slices(batch, limit=1000)) == len(texts)
    assert all(np.diff(o).min() >= 0 for _, _, o in common.text_slices(batch))


def run(spark, sf, docs):
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs.columns, stage(spark, docs, sf)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == before
            docs = common.materialize(docs, "test-stage")
    return docs


def test_pipeline_of_nothing(spark, sf):
    assert run(spark, sf, spark.createDataFrame([], DOCS)).count() == 0


def test_pipeline_of_awkward_rows(spark, sf):
    long = " ".join(f"word{i}" for i in range(400))
    rows = [(1, None), (2, ""), (3, " \n"), (None, long), (None, None), (5, long), (5, long), (6, "own text"), (6, "another text"), (None, "own"), (7, "x" * 30_000), (8, "\x00\x7f a")]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS)
    for name in ("toxicity", "row", "doc", "TIE", "los", "his", "node", "label", "spans", "length"):
        docs = docs.withColumn(name, F.lit(name))
    out = run(spark, sf, docs).collect()
    # the null row's copy of document 5 goes, rows alike in id and text stay together, empty texts stay
    per = {}
    for r in out:
        per.setdefault(r.doc_id, []).append(r)
    assert set(per) == {1, 2, 3, 5, 6, 7, 8, None}
    assert sum(r.start == 0 for r in per[6]) == 2 and sum(r.start == 0 for r in per[None]) == 2 and sum(r.start == 0 for r in per[5]) == 2
    assert all(r.length > 0 for r in out)
