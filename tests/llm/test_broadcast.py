"""That what is broadcast to find texts doesn't grow with a component."""

from pyspark.sql.types import ArrayType

from inkcell.llm import ngram_join


def test_large_component_sends_no_places(spark, monkeypatch):
    """Sets that share runs of repeated words come out as one component of many parts, in which few link."""
    monkeypatch.setattr(ngram_join, "PAIRED", 1)
    rows = [(i, " ".join([f"w{i}"] * 3 + ["same"] * 30 + [f"v{i % 12}"] * 30 + [f"x{i // 2}"] * 9)) for i in range(90)]
    docs = spark.createDataFrame([*rows, (200, rows[5][1].upper())], "doc_id long, text string")
    sent, find = [], ngram_join._texts

    def texts(text, placed):
        out = find(text, placed)
        flat = lambda t: [t.elementType] if isinstance(t, ArrayType) else [x.dataType for x in getattr(t, "fields", [])]
        kinds = [f.dataType for f in out.schema]
        sent.append(any(isinstance(t, ArrayType) or any(isinstance(x, ArrayType) for x in flat(t)) for t in kinds))
        return out

    monkeypatch.setattr(ngram_join, "_texts", texts)
    got = {r.doc_id: r.component_id for r in ngram_join.join(docs, k=3, percent=60, block=8).collect()}
    assert sent and not any(sent)
    grams = {r.doc_id: {tuple(r.text.lower().split()[i : i + 3]) for i in range(len(r.text.split()) - 2)} for r in docs.collect()}
    root = {i: i for i in grams}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in grams:
        for b in grams:
            if a < b and 100 * len(grams[a] & grams[b]) >= 60 * len(grams[a] | grams[b]):
                root[max(top(a), top(b))] = min(top(a), top(b))
    assert got == {i: top(i) for i in grams}
