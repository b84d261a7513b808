"""Every rule of the valence model by examples and, on all documents, by plain loops."""

import math
import random
import string

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tidewater.functions import valence as V


def brute(text, lexicon, boosters, negations):
    words = []
    for w in (text or "").encode().split():
        w = w.decode()
        bare = w.strip(string.punctuation)
        words.append(w if len(bare) <= 2 else bare)
    low = [w.lower() for w in words]
    upper = [w.isupper() for w in words]
    mixed = any(upper) and not all(upper)
    out = []
    for i, w in enumerate(low):
        if w in boosters or (w == "kind" and low[i + 1 : i + 2] == ["of"]) or w not in lexicon:
            out.append(0.0)
            continue
        v = lexicon[w]
        if w == "no" and i + 1 < len(low) and low[i + 1] in lexicon:
            v = 0.0
        if (i > 0 and low[i - 1] == "no") or (i > 1 and low[i - 2] == "no") or (i > 2 and low[i - 3] == "no" and low[i - 1] in ("or", "nor")):
            v = lexicon[w] * V.NEGATION
        if upper[i] and mixed:
            v += V.CAPITALS if v > 0 else -V.CAPITALS
        for k, damping in ((1, 1.0), (2, 0.95), (3, 0.9)):
            if i < k or low[i - k] in lexicon:
                continue
            b = low[i - k]
            if b in boosters:
                s = boosters[b] * (-1 if v < 0 else 1)
                if upper[i - k] and mixed:
                    s += V.CAPITALS if v > 0 else -V.CAPITALS
                v += s * damping
            between = low[i - k + 1 : i]
            if b == "never" and k > 1 and {"so", "this"} & set(between):
                v *= 1.25
            elif b == "without" and k > 1 and "doubt" in between:
                pass
            elif b in negations or "n't" in b:
                v *= V.NEGATION
        if i > 0 and low[i - 1] == "least" and "least" not in lexicon and not (i > 1 and low[i - 2] in ("at", "very")):
            v *= V.NEGATION
        out.append(v)
    if "but" in low:
        b = low.index("but")
        out = [x * 0.5 if i < b else x * 1.5 if i > b else x for i, x in enumerate(out)]
    if not out:
        return 0.0, 0.0, 0.0, 0.0
    marks, asked = min(4, text.count("!")) * 0.292, text.count("?")
    more = marks + (0.96 if asked > 3 else asked * 0.18 if asked > 1 else 0)
    total = sum(out)
    total += more if total > 0 else -more if total < 0 else 0
    pos, neg, neu = sum(x + 1 for x in out if x > 0), sum(x - 1 for x in out if x < 0), out.count(0)
    pos, neg = (pos + more if pos > -neg else pos), (neg - more if pos < -neg else neg)
    whole = pos - neg + neu
    return total / math.sqrt(total * total + 15), pos / whole, -neg / whole, neu / whole


def check(spark, rows, lexicon, boosters=None, negations=None):
    known = spark.createDataFrame(list(lexicon.items()), "word string, valence double")
    df = rows if not isinstance(rows, list) else spark.createDataFrame(list(enumerate(rows)), "k long, text string").withColumn("word", F.lit("clash"))
    got = V.scored(df, "k", "text", known, boosters, negations).collect()
    for r in got:
        want = brute(r["text"], lexicon, V.BOOSTERS if boosters is None else boosters, V.NEGATIONS if negations is None else negations)
        assert (r["compound"], r["pos"], r["neg"], r["neu"]) == pytest.approx(want, abs=1e-9), r["text"][:200]
    return {r["text"]: r["compound"] for r in got}


def test_rules_by_example(spark):
    lexicon = {"good": 1.9, "great": 3.1, "bad": -2.5, "no": -1.2, "kind": 2.4, "problems": -1.7, "love": 3.2}
    rows = [
        "good", "GOOD day", "GOOD DAY", "very good", "VERY good", "really very good", "so really very good", "barely good", "very bad", "not good", "isn't very good", "never so good", "never this very good", "without doubt good", "without a doubt good",
        "no problems", "no great or good", "kind of good", "kind man", "least good", "at least good", "good but bad", "bad, but GREAT!", "good!!!!!", "bad!", "good?", "good??", "good????", ":)", "", None, "   ", "nothing here", "no", "no good", "love (love) 'love'", "at very good",
    ]
    got = check(spark, rows, lexicon)
    assert got["very good"] > got["good"] > got["barely good"] > 0 > got["not good"] and got["GOOD day"] > got["good"] == got["GOOD DAY"]
    assert got["good!!!!!"] > got["good"] and got["no problems"] > 0 > got["least good"] and got["bad, but GREAT!"] > 0
    assert round(got["good"], 4) == 0.4404 and round(got["great"] if "great" in got else brute("great", lexicon, V.BOOSTERS, V.NEGATIONS)[0], 4) == 0.6249  # as the model's authors print them


def test_random_texts(spark):
    rng = random.Random(3)
    words = ["good", "bad", "no", "not", "never", "so", "this", "without", "doubt", "very", "VERY", "GOOD", "kind", "of", "least", "at", "but", "or", "nor", "can't", "x", "ok!", "hm?", "a"]
    rows = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 14))) for _ in range(800)]
    check(spark, rows, {"good": 1.9, "bad": -2.5, "no": -1.2, "kind": 2.4})


def test_all_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumnRenamed("doc_id", "k")
    check(spark, docs, {"the": 1.5, "der": -2.0, "la": 0.7, "that": -1.1, "in": 0.4}, {"and": 0.293, "und": -0.293, "et": 0.293}, ["of", "die", "le"])


def test_only_words_of_the_lexicon_cost(spark, monkeypatch):
    """A lexicon that travels is neither joined nor exploded; one beyond the limit gives the same, whatever the size of pieces."""
    texts = ["very good day, but no GOOD night!", "bad", None, "", "  ", "never so\x0bgood\tor\x1cbad (good)", "x" * 50 + " good??", "ÄRGER good", "don't\u00a0good kind of good"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts * 7)] + [(None, "good")], "k long, text string")
    lexicon = {"good": 1.9, "bad": -2.5, "no": -1.2, "kind": 2.4}
    known = spark.createDataFrame([*lexicon.items(), (None, 1.0), ("day", None)], "word string, valence double")
    small = V.scored(rows, "k", "text", known)
    plan = small._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan
    monkeypatch.setattr(V, "PIECE", 64)
    pieces = sorted(map(tuple, V.scored(rows, "k", "text", known).collect()), key=str)
    monkeypatch.setattr(V, "LEXICON", 1)
    large = V.scored(rows, "k", "text", known)
    assert "Join" in large._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, small.collect()), key=str) == pieces == sorted(map(tuple, large.collect()), key=str)
    check(spark, rows.where("k is not null").drop("word"), lexicon)
