"""Each operator against brute force, a round trip or held-out accuracy, and on awkward rows."""

import collections
import hashlib
import random
import re
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkcell.llm import charmodel, common, decontam, edit_tokens, langid, ngram_join, packing, quality, suffix_dedup, topk, toxicity, warc
from inkcell.llm.common import shared_dir
from inkcell.llm.components import components
from inkcell.llm.queries import table, word_vocabulary

DOCS = "doc_id long, text string, lang string, source string, n_chars long, length int, spans string, node string"
LABELS = "doc_id long, quality int, toxic int"


def docs_of(spark, texts, ids=None, lang="en"):
    """Documents with columns whose names operators use themselves."""
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, lang, None, None if t is None else len(t), 1, "x", "y") for i, t in zip(ids, texts, strict=True)], DOCS)


@pytest.fixture(scope="module")
def real(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "text").collect()
    return [(r.doc_id, r.text) for r in rows]


AWKWARD = [None, "", " ", "a", "a b", "!!!", "\x1c\x1f", "가나다 라마", "x" * 5000, "same text here, more than ten words of it in all, indeed", "same text here, more than ten words of it in all, indeed", "é" * 300, "é" * 300]


# ---- 1 packing


def ids_of(text):
    from tokenizers import Tokenizer

    return [*Tokenizer.from_file(word_vocabulary()).encode(text or "", add_special_tokens=False).ids, 2]


def check_packing(rows, texts):
    whole = collections.defaultdict(list)
    fill = collections.defaultdict(list)
    for r in rows:
        ids = ids_of(texts[r.doc_id])
        part = ids[r.start : r.start + r.length]
        assert r.doc_tokens == len(ids) and zlib.crc32(struct.pack(f"<{len(part)}I", *part)) == r.ids_crc32
        whole[r.doc_id].append((r.start, r.length))
        fill[r.sequence_id].append((r.offset, r.length))
    for d, parts in whole.items():
        at = 0
        for s, n in sorted(parts):
            assert s == at and n > 0
            at += n
        assert at == len(ids_of(texts[d]))
    for parts in fill.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= packing.CAPACITY
    assert set(whole) == set(texts)
    return fill


def test_packing(spark, real):
    texts = dict(real[:80])
    fill = check_packing(packing.pack(docs_of(spark, list(texts.values()), list(texts)), word_vocabulary()).collect(), texts)
    used = sum(n for p in fill.values() for _, n in p)
    assert used > 0.9 * packing.CAPACITY * (len(fill) - 1)


def test_packing_edges(spark):
    check_packing(packing.pack(docs_of(spark, AWKWARD), word_vocabulary()).collect(), dict(enumerate(AWKWARD)))
    assert packing.pack(docs_of(spark, []), word_vocabulary()).count() == 0
    assert packing.pack(docs_of(spark, ["a"], [None]), word_vocabulary()).first().doc_id is None
    for n in (1, 63, 64, 65, 100, 4095, 4096, 4097, 9999):
        parts = packing.cuts(n)
        assert sum(x for _, x in parts) == n and all(x <= 4096 for _, x in parts)


def test_encoder_agrees(real):
    odd = ["Straße ΟΔΟΣ İstanbul naïve's it's \"q\" <|endoftext|> a<|startoftext|>b 12½² x² _a_b don't ①②", "é ́abc", "a\x1cb", "​x y"]
    texts = [t for _, t in real[:40]] + odd + [t or "" for t in AWKWARD]
    want = [struct.pack(f"<{len(i)}I", *i) for i in ([*ids_of(t)[:-1]] for t in texts)]
    assert packing.encode_texts(texts, word_vocabulary()) == want
    small = packing.WordEncoder(word_vocabulary(), limit=20)  # caches that overflow change nothing
    assert [small.encode([t])[0] for t in texts[:40]] == want[:40]


def test_encoder_agrees_on_any_text():
    from tokenizers import Tokenizer

    rng = random.Random(11)
    signs = [chr(c) for c in range(128)] * 2 + list("  aeiourstn.,'-") * 6 + list("éßΣσςÅİıфж가中①½\u0301\u00a0\u200b\u2028🙂")
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 14))) for _ in range(10_000)]
    texts += [a + chr(c) + b for c in [*range(32), 127] for a in ("", "a", "hello", "a ") for b in ("", "b", " b")]
    want = [struct.pack(f"<{len(e.ids)}I", *e.ids) for e in Tokenizer.from_file(word_vocabulary()).encode_batch(texts, add_special_tokens=False)]
    got = packing.encode_texts(texts, word_vocabulary())
    assert [t for t, x, y in zip(texts, got, want, strict=True) if x != y] == []


def test_sequences(spark, real):
    d = docs_of(spark, [t for _, t in real[:20]])
    packed = packing.pack(d, word_vocabulary()).cache()
    got = {r.sequence_id: r.ids for r in packing.sequences(d, packed, word_vocabulary()).collect()}
    want = collections.defaultdict(list)
    for r in sorted(packed.collect(), key=lambda r: (r.sequence_id, r.offset)):
        want[r.sequence_id] += ids_of(real[r.doc_id][1])[r.start : r.start + r.length]
    assert got == want


# ---- 2 decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_hits(texts, items):
    cut = lambda t: WORD.findall((t or "").translate(LOW))
    windows = collections.defaultdict(set)
    for item, t in items:
        w = cut(t)
        m = min(len(w), 10)
        for i in range(len(w) - m + 1) if w else ():
            windows[tuple(w[i : i + m])].add(item)
    sizes = {len(k) for k in windows}
    out = []
    for t in texts:
        w, hit, found = cut(t), set(), set()
        for m in sizes:
            for i in range(len(w) - m + 1):
                if items_ := windows.get(tuple(w[i : i + m])):
                    hit |= set(range(i, i + m))
                    found |= items_
        out.append((len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("block", [decontam.BLOCK_BYTES, 60])
def test_decontamination(spark, block):
    items = [(10, "one two three four five six seven eight nine ten eleven twelve"), (9, "Short Item"), (2, None), (3, "..."), (4, "ä ö ü"), (5, "two three four five six seven eight nine ten eleven")]
    texts = [*AWKWARD, "x one Two three four five six seven eight nine ten, eleven y", "short item short", "SHORT-ITEM Ä ä ö ü", "one two three four five six seven eight nine", "ä ö ü" * 40]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = decontam.digest(decontam.hits(docs_of(spark, texts), bench, block_bytes=block)).orderBy("doc_id").collect()
    assert [(r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in rows] == brute_hits(texts, [(str(i), t) for i, t in items])
    clean = {r.doc_id for r in decontam.keep_clean(docs_of(spark, texts), bench, block_bytes=block).collect()}
    assert clean == {r.doc_id for r in rows if not r.contaminated}


def test_decontamination_empty(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.digest(decontam.hits(docs_of(spark, ["a b"]), none)).first().n_hit == 0
    assert decontam.hits(docs_of(spark, []), none).count() == 0


# ---- 3 quality


def test_quality_held_out(spark, sf):
    big = sf.replace("0.001", "0.01")
    got = quality.predict(table(spark, big, "documents"), table(spark, big, "labels")).join(table(spark, big, "labels"), "doc_id").where("held_out")
    r = got.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int")).alias("accuracy")).first()
    assert r.accuracy >= 0.97


def test_quality_edges(spark):
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(12)] + [(None, 1, 1), (3, None, 0)], LABELS)
    rows = quality.predict(docs_of(spark, AWKWARD), labels).collect()
    assert len(rows) == len(AWKWARD) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    none = spark.createDataFrame([], LABELS)
    assert {r.score for r in quality.predict(docs_of(spark, AWKWARD), none).collect()} == {0.5}
    assert quality.predict(docs_of(spark, []), labels).count() == 0


def test_additive_model_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 3)).astype(np.float32)
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = quality.fit(x, y, pairs=2)
    assert ((m.score(x) > 0.5) == (y > 0)).mean() > 0.9 and (1, 0) in {(i, j) for i, j, _ in m.pairs}


# ---- 4 WARC


@pytest.mark.parametrize("most", [warc.BROADCAST_ROWS, 0])
def test_warc_round_trip(spark, monkeypatch, most):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", most)
    pages = [(1, "http://a/\r\nX: y", "<p>one</p>"), (2, None, "<p>one</p>"), (3, "u", None), (4, "u", ""), (None, "u", "<p>one</p>"), (None, "v", "alone"), (7, "w", "ü" * 200_000), (9, "w", "<p>one</p>")]
    df = spark.createDataFrame([(*p, 0) for p in pages], "page_id long, url string, html string, key int")
    got = {(r.page_id, r.payload_bytes): r for r in warc.round_trip(df).collect()}
    assert len(got) == len(pages)
    for page, _, html in pages:
        body = (html or "").encode()
        r = got[page, len(body)]
        assert r.payload_digest == warc.digest(body)
        same = [p for p, _, h in pages if (h or "") == (html or "") and p is not None]
        last = max(same, default=None)
        assert (r.record_type, r.refers_to) == (("revisit", last) if last is not None and page != last else ("response", None))
    few = {r.page_id: r.record_type for r in warc.round_trip(df.where("page_id < 3"), least=100).collect()}
    assert few == {1: "response", 2: "response"}
    assert warc.round_trip(df.where("false")).count() == 0


def test_warc_dictionary_frame(spark, sf):
    uri = warc.write(table(spark, sf, "pages"), f"{shared_dir(spark)}/warc-test")[0]
    fs, path = warc._fs(uri)
    with fs.open_input_stream(path, compression=None) as f:
        magic, size = struct.unpack("<II", f.read(8))
        assert magic == warc.MAGIC and 0 < size <= warc.DICTIONARY_BYTES
        f.read(size)
        assert f.read(4) == warc.ZSTD_MAGIC
    first, _ = next(warc.records(uri))
    assert first["warc-type"] == "warcinfo"


# ---- 5 suffix dedup


def brute_copies(docs, length, later):
    first, count = {}, collections.Counter()
    bodies = [(i, (t or "").encode()) for i, t in docs]
    for i, b in sorted(bodies):
        for p in range(len(b) - length + 1):
            count[b[p : p + length]] += 1
            first.setdefault(b[p : p + length], (i, p))
    out = {}
    for i, b in bodies:
        c = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if first[w] != (i, p) if later else count[w] > 1:
                c[p : p + length] = True
        runs = int((np.diff(np.concatenate([[0], c.astype(int)])) == 1).sum())
        out[i] = (len(b), int(c.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~c].tobytes()).hexdigest())
    return out


@pytest.mark.parametrize("mode", ["all", "later"])
@pytest.mark.parametrize("length,gram", [(20, 8), (50, 32)])
def test_copies(spark, mode, length, gram):
    rng = random.Random(length)
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.randint(1, 6)))
    passages = [" ".join(word() for _ in range(40)) for _ in range(3)]
    docs = [(i, " ".join([word(), rng.choice(passages), word(), rng.choice(passages)[rng.randint(0, 60) :], word()])) for i in range(40)]
    docs += [(50, "ab" * 100), (51, "ab" * 30), (52, "z" * 500), (53, None), (54, ""), (55, passages[0]), (56, passages[0])]
    d = docs_of(spark, [t for _, t in docs], [i for i, _ in docs]).repartition(5)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.digest(suffix_dedup.copies(d, length, gram, mode)).collect()}
    assert got == brute_copies(docs, length, mode == "later")


def test_remove_later_keeps_rows(spark):
    d = docs_of(spark, ["é" * 150 + "x", "y" + "é" * 150, None, "z"], [1, 2, 3, None])
    got = {r.doc_id: (r.text, r.n_chars) for r in suffix_dedup.remove_later(d, 40, 16).collect()}
    assert got[1][0].startswith("é") and got[2][0] == "y" and got[2][1] == 1 and got[3][0] is None and got[None][0] == "z"
    assert suffix_dedup.remove_later(docs_of(spark, [])).count() == 0


def longest_previous_factors(data):
    """LPF array of a text, from its suffix array by previous and next smaller positions."""
    sa = sorted(range(len(data)), key=lambda i: data[i:])
    out, stack = [0] * len(data), []

    def common(i, j):
        k = 0
        while i + k < len(data) and j + k < len(data) and data[i + k] == data[j + k]:
            k += 1
        return k

    for at in (*sa, -1):
        while stack and at < stack[-1]:
            i = stack.pop()
            out[i] = max([common(i, x) for x in (stack[-1] if stack else None, at) if x is not None and x >= 0], default=0)
        stack.append(at)
    return out


def test_later_copies_are_long_previous_factors(spark):
    rng = random.Random(8)
    length, text = 24, ""
    while len(text) < 3000:
        at = rng.randrange(max(1, len(text)))
        text += rng.choice(["".join(rng.choice("ab ") for _ in range(30)), text[at : at + rng.randint(1, 80)]])
    want = np.zeros(len(text), bool)
    for i, n in enumerate(longest_previous_factors(text.encode())):
        if n >= length:
            want[i : i + length] = True
    r = suffix_dedup.copies(docs_of(spark, [text]), length, 8, "later").first()
    got = np.zeros(len(text), bool)
    for lo, hi in zip(r.los, r.his, strict=True):
        got[lo:hi] = True
    assert (got == want).all() and want.any() and not want.all()


def test_copies_of_rows_alike(spark):
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    a, b, c, d = text(600), text(900), text(500), text(300)
    rows = [(1, a), (1, b), (2, a), (None, c), (None, "x" + c), (None, d), (5, d), (5, d), (7, "own " * 3)]
    df = docs_of(spark, [t for _, t in rows], [i for i, _ in rows]).repartition(4)
    got = {}
    for r in suffix_dedup.digest(suffix_dedup.copies(df)).collect():
        got.setdefault((r.doc_id, r.n_bytes), []).append(r.n_removed)
    assert got == {(1, 600): [600], (1, 900): [0], (2, 600): [600], (None, 500): [500], (None, 501): [500], (None, 300): [300], (5, 300): [300] * 2, (7, 12): [0]}
    left = collections.Counter((r.doc_id, len(r.text)) for r in suffix_dedup.remove_later(df).collect())
    first = {(1, 600): 1, (1, 900): 1, (2, 0): 1, (5, 300): 2, (7, 12): 1, (None, 0): 1}  # rows alike in id and text are cut alike
    assert {k: n for k, n in left.items() if k in first} == first and sorted(n for (i, n) in left if i is None) in ([0, 1, 500], [0, 0, 501])


def test_copies_under_one_anchor(spark, monkeypatch):
    """Hundreds of variants of a passage, blocks and folds of a few rows, clashing columns."""
    monkeypatch.setattr(suffix_dedup, "SORT_BYTES", 3000)
    monkeypatch.setattr(suffix_dedup, "FOLD_BYTES", 5000)
    rng = random.Random(6)
    base = "".join(rng.choice("abcdefghij ") for _ in range(260))
    docs = []
    for i in range(150):
        t = list(base)
        for _ in range(rng.choice([0, 1, 1, 2])):
            t[rng.randrange(len(t))] = rng.choice("XYZ")
        docs.append((i, "".join(t)))
    d = docs_of(spark, [t for _, t in docs], [i for i, _ in docs]).repartition(5)
    for mode in ("all", "later"):
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.digest(suffix_dedup.copies(d, 60, 16, mode)).collect()}
        assert got == brute_copies(docs, 60, mode == "later")
    clash = d.withColumn("doc", F.lit(1)).withColumn("TIE", F.lit(2)).withColumn("los", F.lit(3))
    assert suffix_dedup.remove_later(clash, 60, 16).columns == clash.columns


# ---- 6 top-k


@pytest.mark.parametrize("block,chunk", [(4096, 2048), (3, 7)])
def test_top_k(spark, block, chunk, monkeypatch):
    monkeypatch.setattr(topk, "OPEN", 2)
    rng = np.random.default_rng(3)
    v = (rng.standard_normal((700, 9)) * rng.random((700, 1)) ** 3).astype(np.float32)
    v[5] = v[6] = v[7]
    rows = [(i, x.tolist(), 1.0, [0]) for i, x in enumerate(v)] + [(900, None, 1.0, [0]), (950, [float("nan")] * 9, 1.0, [0]), (1000, [], 1.0, [0]), (None, v[0].tolist(), 1.0, [0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, norm double, v array<int>")
    got = collections.defaultdict(list)
    for r in topk.top_k(df, block=block, chunk=chunk).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    q = np.floor(256 * v.astype(np.float64)).astype(np.int64)
    want = {i: sorted(((j, int(q[i] @ q[j])) for j in range(700) if j != i), key=lambda x: (-x[1], x[0]))[:5] for i in range(0, 700, 50)}
    assert dict(got) == want


@pytest.mark.parametrize("size", [3e4, 2e5, 2e6])
def test_top_k_is_exact_beyond_floats(spark, size):
    rng = np.random.default_rng(int(size))
    v = (rng.standard_normal((120, 8)) * size).round(3)
    v[60:] = v[:60] + rng.integers(-1, 2, (60, 8)) / 256  # scores that differ in their last digits
    got = collections.defaultdict(list)
    for r in topk.top_k(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    q = [[int(y) for y in x] for x in np.floor(256 * v)]
    want = {i: sorted(((j, sum(a * b for a, b in zip(q[i], q[j], strict=True))) for j in range(120) if j != i), key=lambda x: (-x[1], x[0]))[:5] for i in (0, 50, 100)}
    assert dict(got) == want


def test_top_k_few(spark):
    schema = "vec_id long, embedding array<float>"
    assert topk.top_k(spark.createDataFrame([], schema)).count() == 0
    few = topk.top_k(spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0]), (2, [0.5, -1.0])], schema)).orderBy("rank").collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in few] == [(0, 1, 1, 65536), (0, 2, 2, 256 * 128 - 512 * 256)]


# ---- 7 language identification


def test_language_held_out(spark, sf):
    got = langid.predict(table(spark, sf, "documents")).join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] >= 0.97


def test_language_edges(spark):
    rows = langid.predict(docs_of(spark, AWKWARD)).orderBy("doc_id").collect()
    assert [r.lang_pred for r in rows[:3]] == ["und"] * 3 and rows[5].lang_pred == "und" and rows[5].score == 0
    assert {r.lang_pred for r in langid.predict(docs_of(spark, ["abc", None], lang=None)).collect()} == {"und"}
    assert langid.predict(docs_of(spark, [])).count() == 0


def brute_bits(trees, text, order):
    """Code length of a text by walking a language's tree byte by byte. ``trees``: context -> byte -> count."""
    bits = 0.0
    padded = bytes(order) + text
    for i in range(order, len(padded)):
        p = 1.0
        for d in range(order, -1, -1):
            seen = trees.get(padded[i - d : i])
            if seen is None:
                continue
            whole = sum(seen.values()) + len(seen)
            if padded[i] in seen:
                p *= seen[padded[i]] / whole
                break
            p *= len(seen) / whole
        else:
            p /= 256
        bits -= np.log2(p)
    return bits


@pytest.mark.parametrize("order", [1, 3, 4])
def test_code_lengths_are_exact(spark, monkeypatch, order):
    monkeypatch.setattr(langid, "HELD", 50)
    monkeypatch.setattr(langid, "SCORED", 7)
    texts = [("xx", "abab aba cab"), ("yy", "über dem Öl"), ("xx", "cab!"), ("yy", ""), (None, "q"), ("xx", None)]
    model = langid.train(spark.createDataFrame(texts, "label string, text string").repartition(3), order)
    assert model.labels == ["xx", "yy"]
    asked = ["abab", "", "zebra", "dem Öl ab", "c", "\x00\x00a", "über über"]
    raw = [t.encode() for t in asked]
    offsets = np.cumsum([0, *map(len, raw)])
    got = model.bits(np.frombuffer(b"".join(raw), np.uint8), offsets)
    for k, label in enumerate(model.labels):
        trees = collections.defaultdict(collections.Counter)
        for mine, text in texts:
            if mine == label and text:
                padded = bytes(order) + text.encode()
                for i in range(order, len(padded)):
                    for d in range(order + 1):
                        trees[padded[i - d : i]][padded[i]] += 1
        assert np.allclose(got[:, k], [brute_bits(dict(trees), t, order) for t in raw], rtol=1e-5)


def test_nodes_are_bounded(spark):
    rng = random.Random(0)
    texts = [(x, "".join(rng.choice("abcdefgh") for _ in range(3000))) for x in ("xx", "yy", "zz")]
    model = langid.train(spark.createDataFrame(texts, "label string, text string"), 3, 900)
    assert all(len(g) <= 300 for tree in model.trees for g, _ in tree) and len(model.trees[1][0][0]) == 64 + 1
    assert langid.train(spark.createDataFrame([], "label string, text string")).labels == []


@pytest.mark.parametrize("nodes", [1, 250, 900])
def test_rare_nodes_count(spark, monkeypatch, nodes):
    monkeypatch.setattr(langid, "JOINED", 40)
    order, rng = 3, random.Random(0)
    texts = [(x, " ".join("".join(rng.choice(y) for _ in range(rng.randint(2, 7))) for _ in range(60))) for x, y in (("xx", "aabcdeé"), ("yy", "abdefgß"), ("zz", "aacfgh")) for _ in range(3)]
    asked = [t[:90] for _, t in texts] + [*AWKWARD, "abba feed", "zzz", "\x00\x00a", texts[0][1], texts[0][1]]
    docs = spark.createDataFrame([(min(i, len(asked) - 2), t) for i, t in enumerate(asked)], "doc_id long, text string").repartition(3)  # the last repeats an id
    taught = spark.createDataFrame(texts, "label string, text string")
    model = langid.train(taught, order, nodes)
    assert model.rest is not None
    got = sorted(langid.identify(docs, model).collect())
    assert got == sorted(langid.identify(docs, langid.train(taught, order)).collect()) and len(got) == len(asked)
    grown = {label: collections.defaultdict(collections.Counter) for label, _ in texts}
    for label, text in texts:
        padded = bytes(order) + text.encode()
        for i in range(order, len(padded)):
            for d in range(order + 1):
                grown[label][padded[i - d : i]][padded[i]] += 1
    for r in got:
        text = (asked[r.doc_id] or "").encode()
        if r.lang_pred != "und":
            bits = {label: brute_bits(dict(tree), text, order) for label, tree in grown.items()}
            assert np.isclose(r.bits_per_byte, bits[r.lang_pred] / len(text), rtol=1e-5) and bits[r.lang_pred] <= min(bits.values()) + 1e-3


def test_character_model_is_exact():
    text = "abab aba cab"
    data, offsets = np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)])
    at, n = np.unique(charmodel.gram_index(data, offsets), return_counts=True)
    bits = charmodel.code_lengths(at, n)
    probabilities = 2.0 ** -bits.reshape(-1, charmodel.SYMBOLS).astype(np.float64)
    assert (probabilities.sum(1) <= 1 + 1e-5).all() and (probabilities > 0).all()  # escapes are shared with what is seen
    sym = charmodel.FOLD[data].tolist()
    grams = collections.Counter(zip([0, 0, *sym], [0, *sym], sym, strict=False))
    total = sum(c for (a, b, _), c in grams.items() if (a, b) == (0, 0))
    kinds = sum(1 for (a, b, _) in grams if (a, b) == (0, 0))
    assert np.isclose(2.0 ** -bits[charmodel.gram_index(data, offsets)[0]], grams[0, 0, sym[0]] / (total + kinds))


# ---- 8 edit-aware counts


def gpt_tokens(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    model.encode_special_tokens = True
    return len(model.encode(text, add_special_tokens=False).ids)


def test_edits_against_whole_counts(real):
    import public_tokenizers

    counter = edit_tokens.Counter(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(5)
    for text in [t for _, t in real[:25]] + ["", "  a  b \n\n  c'll don't", "    "]:
        doc, now = edit_tokens.Document(text, counter), text
        for _ in range(10):
            lo = rng.randint(0, len(now))
            hi = min(len(now), lo + rng.choice([0, 1, 5, 40, 3000]))
            new = rng.choice(["", "x", " ", "  \n", "'ll", "hello world ", real[rng.randrange(25)][1][:3000], " 12é"])
            doc.edit(lo, hi, new)
            now = now[:lo] + new + now[hi:]
            assert (doc.n_tokens, doc.n_chars) == (gpt_tokens(now), len(now))


def test_edit_counts(spark):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    edits = spark.createDataFrame([(0, 1, 3, 4, "zz"), (0, 0, 0, 1, ""), (None, 0, 0, 0, "q"), (77, 0, 0, 0, "q"), (1, 0, 90, 99, None)], "doc_id long, seq int, lo long, hi long, new string")
    rows = {r.doc_id: r for r in edit_tokens.edit_counts(docs_of(spark, ["hello you", None, "plain"]), edits, path).collect()}
    assert rows[0].n_tokens_after == gpt_tokens("ellzz you") and rows[0].n_edits == 2
    assert (rows[1].n_tokens, rows[1].n_tokens_after) == (0, 0) and rows[2].n_edits == 0
    texts = dict(enumerate(AWKWARD))
    for r in edit_tokens.self_edits(docs_of(spark, AWKWARD), path).collect():
        t = texts[r.doc_id] or ""
        n = len(t)
        t2 = t[: n // 3] + "rewritten, twice" + t[min(n, n // 3 + 12) :]
        at = min(n * 2 // 3, len(t2))
        t3 = t2[:at] + f" [{r.doc_id}] " + t2[at:]
        assert (r.n_tokens, r.n_tokens_after) == (gpt_tokens(t), gpt_tokens(t3[5:]))


# ---- 9 n-gram Jaccard join


def brute_join(docs, k, percent):
    sets = {}
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if b < a and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("k,percent,block,few", [(3, 90, 1024, 200_000), (3, 90, 4, 0), (5, 80, 16, 200_000)])
def test_ngram_join(spark, monkeypatch, k, percent, block, few):
    monkeypatch.setattr(ngram_join, "BROADCAST_ROWS", few)
    rng = random.Random(k)
    base = [[f"w{rng.randrange(400)}" for _ in range(rng.randint(20, 160))] for _ in range(8)]
    docs = []
    for i in range(120):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            w[rng.randrange(len(w))] = f"v{rng.randrange(50)}"
        docs.append((i, " ".join(w)))
    docs += [(200 + i, t) for i, t in enumerate(AWKWARD)]
    d = docs_of(spark, [t for _, t in docs], [i for i, _ in docs]).repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(d, k, percent, block).collect()}
    assert got == brute_join(docs, k, percent)
    kept = {r.doc_id for r in ngram_join.keep_first(d, k, percent).collect()}
    assert kept == {i for i, (_, c) in got.items() if i == c}


def test_ngram_join_hot_group(spark, monkeypatch):
    """A group of near copies whose members share their parts, blocks bounded by n-grams, folds of a few rows."""
    monkeypatch.setattr(ngram_join, "FOLD_BYTES", 4000)
    monkeypatch.setattr(ngram_join, "KEY_FOLD_BYTES", 4000)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    docs = []
    for i in range(90):
        w = list(base)
        for _ in range(rng.choice([1, 2, 3, 5])):
            w[rng.randrange(len(w))] = f"v{rng.randrange(500)}"
        docs.append((i, " ".join(w)))
    d = docs_of(spark, [t for _, t in docs], [i for i, _ in docs]).repartition(3)
    for grams in (ngram_join.BLOCK_GRAMS, 1000):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(d, 5, 80, grams=grams).collect()}
        assert got == brute_join(docs, 5, 80)


def test_ngram_join_edges(spark):
    assert ngram_join.join(docs_of(spark, [])).count() == 0
    rows = ngram_join.join(docs_of(spark, ["a b c d"] * 3, [5, 5, None])).collect()
    assert len(rows) == 3 and {r.component_id for r in rows} == {5}
    w = [f"w{i}" for i in range(200)]
    near = " ".join([*w[:100], "other", *w[101:]])
    rows = ngram_join.join(docs_of(spark, [" ".join(w), near, "a b", "a b", None], [1, None, None, None, 7])).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in rows) == [(0, 0), (0, 0), (0, 1), (1, 1), (7, 7)]
    kept = ngram_join.keep_first(docs_of(spark, ["a b", "c d", None, "a b", "c d"], [4, None, None, None, 9])).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in kept) == [(0, ""), (4, "a b"), (9, "c d")]
    clash = docs_of(spark, ["a b", "a b"]).withColumn("row", F.lit(1)).withColumn("ROW_", F.lit(2))
    assert ngram_join.keep_first(clash).collect()[0].asDict()["ROW_"] == 2 and ngram_join.keep_first(clash).columns == clash.columns


def test_words_of_thue_and_morse_stay_apart(spark):
    a = "".join("ab"[i.bit_count() % 2] for i in range(4096))
    b = a.translate(str.maketrans("ab", "ba"))
    assert {r.component_id for r in ngram_join.join(docs_of(spark, [a, b])).collect()} == {0, 1}


def test_word_hash():
    data = np.frombuffer(b"abcdefgh12345678x abcdefgh12345678x abcdefgh12345678y", np.uint8)
    h = common.word_hash(data, np.array([0, 18, 36, 0, 8, 5, 5]), np.array([17, 35, 53, 8, 16, 5, 6]))
    assert h[0] == h[1] and len(set(h.tolist())) == 6


def test_sketches_turn_down_no_link():
    rng = np.random.default_rng(4)
    for n in (1, 5, 40, 300, 3000):
        for changed in (0, 1, n // 20, n // 9, n // 2):
            a = rng.integers(0, 1 << 63, n).astype(np.uint64)
            b = a.copy()
            b[:changed] = rng.integers(0, 1 << 63, changed)
            b = b[rng.integers(0, 3) * n // 30 :]
            a, b = np.unique(a), np.unique(b)
            x, y = ngram_join.sketches(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
            both = len(np.intersect1d(a, b))
            for percent in (80, 90):
                if 100 * both >= percent * (len(a) + len(b) - both):
                    assert ngram_join.may_link(len(a), x, len(b), y, percent)
            if n >= 300 and changed == n // 2:
                assert not ngram_join.may_link(len(a), x, len(b), y, 80)


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(500, 560)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


# ---- 10 toxicity


def test_toxicity_held_out(spark, sf):
    big = sf.replace("0.001", "0.1")
    labels = table(spark, big, "labels")
    got = toxicity.predict(table(spark, big, "documents"), labels).join(labels, "doc_id").where("held_out")
    r = got.agg(F.sum(F.expr("int(predicted = 1 and toxic = 1)")).alias("hit"), F.sum("toxic").alias("all"), F.sum("predicted").alias("said")).first()
    assert r.hit / r.all >= 0.9 and r.hit / r.said >= 0.7


def test_deobfuscation(spark, sf):
    big = sf.replace("0.001", "0.1")
    docs = table(spark, big, "documents")
    model = charmodel.train(docs.select(F.lit("all").alias("label"), "text"))
    lexicon = {w: 3.0 for w in ("idiot", "loser", "trash", "stupid", "worthless", "^patheti")}
    score = toxicity.Scorer(lexicon, toxicity.Lattice(model)).score
    for bad in ("l0ser", "1d10t", "i.d.i.o.t", "LOOOOSER!", "tr@sh", "stuupid,", "wor7hless", "path3tic", "you i d i o t there", "(loser)", "$tup1d"):
        assert score(f"the {bad} of it") > 0.9, bad
    for good in ("los er", "idea of it", "4 5 7", "+1 (449) 555-7462", "a b c d e f", "10.5 x", ""):
        assert score(good) < 0.1, good


def test_toxicity_edges(spark):
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(12)] + [(None, 1, 1), (3, 0, None)], LABELS)
    rows = toxicity.predict(docs_of(spark, AWKWARD), labels).collect()
    assert len(rows) == len(AWKWARD) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert toxicity.predict(docs_of(spark, ["idiot"]), spark.createDataFrame([], LABELS)).first().predicted == 0
    assert toxicity.predict(docs_of(spark, []), labels).count() == 0
    assert toxicity.keep_clean(docs_of(spark, AWKWARD), labels).columns == docs_of(spark, []).columns
