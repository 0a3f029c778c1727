"""Obfuscated words of any length."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkcell.llm import charmodel, toxicity
from inkcell.llm.queries import table

LEXICON = {w: 3.0 for w in ("idiot", "loser", "trash", "stupid", "worthless", "incomprehensibilities", "^patheti")}


@pytest.fixture(scope="module")
def lattice(spark, sf):
    docs = table(spark, sf.replace("0.001", "0.1"), "documents")
    return toxicity.Lattice(charmodel.train(docs.select(F.lit("all").alias("label"), "text")))


def test_no_token_is_too_long(lattice):
    score = toxicity.Scorer(LEXICON, lattice).score
    spaced = " ".join("".join(c * 5 for c in "idiot"))
    for bad in ("l" + "o" * 40 + "ser", "l" + "." * 30 + "o" + "-_" * 20 + "ser", "stup" + "1" * 60 + "d", spaced, f"you {spaced} there", " ".join("incomprehensibilities"), "a b " + " ".join("incomprehensibilities") + " c d"):
        assert score(f"the {bad} of it") > 0.9, bad
    for good in ("x" * 5000, " ".join("abc" * 300), "=" * 90, "ab1-" * 200):
        assert score(good) < 0.1, good[:20]


def test_learning_decodes_long_tokens(lattice):
    assert "loser" in lattice.readings("l" + "o" * 40 + "ser")
    assert "incomprehensibilities" in toxicity.tokens("you " + " ".join("incomprehensibilities") + " there")


def test_long_words_take_linear_time(lattice):
    assert len(lattice.restore("ab1-" * 20_000)) >= 40_000


def test_shortcut_takes_every_blank():
    blanks = [chr(c) for c in range(0x110000) if chr(c).isspace()]
    texts = ["", "no such thing", *(b.join("idiot") for b in blanks), "a\x01b\x01c", "\x01 a b", "café à", "no more", "", "a b"]
    data = "".join(texts).encode()
    offsets = np.cumsum([0, *(len(x.encode()) for x in texts)])
    said = toxicity.spaced_out(np.frombuffer(data, np.uint8), offsets)
    assert said == [False, False, *(True for _ in blanks), False, True, False, False, False, False]
    assert toxicity.spaced_out(np.zeros(0, np.uint8), np.zeros(2, np.int64)) == [False]


def test_repeats_of_a_reading(lattice):
    score = toxicity.Scorer(LEXICON, lattice).score
    for bad in ("l00ser", "lo0ser", "l0oser", "loo0ser", "l.o.0.s.e.r", "1di1o0t", "sttup1id", "tra@$sh", " ".join("l0oser")):
        assert score(f"the {bad} of it") > 0.9, bad


def readings(lattice, word, doubles):
    """All (text, cost) of a word's lattice, by the rules as they are stated."""
    letters = lambda ch: set(toxicity.LOOKALIKES.get(ch, ch if ch in "abcdefghijklmnopqrstuvwxyz" else ""))
    paths = {("", 0.0)}
    for i, ch in enumerate(word):
        before = [letters(c) for c in word[:i] if c not in toxicity.SEPARATORS][-2:]
        raw = word[max(0, i - 2) : i]
        thrice = len(before) == 2 and bool(before[0] & before[1] & letters(ch)) or raw == ch * 2
        drop = 0.5 if thrice else 3.0 if doubles else None
        if ch in toxicity.LOOKALIKES:
            step = [(x, 1.0) for x in toxicity.LOOKALIKES[ch]] + [(ch, 6.0)]
        else:
            step = [("", 1.0), (ch, 6.0)] if ch in toxicity.SEPARATORS else [(ch, 0.0)]
        out = {(text + read, cost + c) for text, cost in paths for read, c in step}
        if drop is not None:
            for text, cost in paths:
                may = before and text and text[-1] in before[-1] & letters(ch)
                if may or raw[-1:] == ch:
                    out.add((text, cost + drop))
        paths = out
    return [(text, cost + lattice.cost((0, 0), text + " ")[1]) for text, cost in paths]


def test_viterbi_against_all_readings(lattice):
    rng = __import__("random").Random(2)
    words = ["l00ser", "lo0ser", "1d10t", "a.a", "$$", "@a4", "..", "o", "l.l1i"]
    words += ["".join(rng.choice("aoils0145@$.-e") for _ in range(rng.randint(1, 7))) for _ in range(150)]
    for word in words:
        for doubles in (False, True):
            found = readings(lattice, word, doubles)
            least = min(cost for _, cost in found)
            assert lattice.restore(word, doubles) in {t for t, cost in found if cost <= least + 1e-6}, word


def test_columns_of_any_name(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(4)], "doc_id long, toxic int")
    docs = spark.createDataFrame([(1, "a", 7, 8)], "doc_id long, text string, Toxicity int, toxicity_ int")
    kept = toxicity.keep_clean(docs, labels)
    assert kept.columns == docs.columns and kept.first().asDict()["toxicity_"] == 8


def test_words_beside_toxic_words_teach_nothing():
    counts = {"bad": (40, 40), "vile": (40, 40), "copied": (9, 10), "rare": (4, 4)}
    holders = [(i, ["bad", "vile"]) for i in range(20)] + [(i, ["bad", "vile"]) for i in range(20, 31)] + [(7, ["bad", "vile", "copied", "rare"])] * 9
    own = toxicity.own_evidence(counts, holders, 0.1)
    assert own == {"bad", "vile"}
    assert toxicity.related("^ba", own) and toxicity.related("badly", {"^bad"}) and not toxicity.related("copied", own) and not toxicity.related("badly", own)
    assert "new" in toxicity.own_evidence({"new": (6, 6)} | counts, [*holders, *((90 + i, ["new"]) for i in range(6))], 0.1)
