"""The language predicate on rows held out, and odd rows; coherence by pairs."""

import itertools

import numpy as np
from pyspark.sql import functions as F

from tests.conftest import SF
from tidewater.operators import language as L
from tidewater.operators import text_stats as TS


def test_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF.replace('sf0.001', 'sf0.01')}/documents.parquet").where("length(text) > 100")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    found = L.predict(docs.where(held), "doc_id", "text", L.profiles(docs.where(~held), "lang", "text")).withColumnRenamed("lang", "guess")
    right = found.join(docs, "doc_id").agg(F.avg((F.col("guess") == F.col("lang")).cast("double")), F.count("*")).first()
    assert right[0] > 0.97 and right[1] == docs.where(held).count(), right


def test_odd_texts(spark):
    docs = spark.createDataFrame([(1, "the cat and the hat", "en"), (2, "le chat et la tête", "fr"), (3, None, "en"), (4, "12 !?", "en"), (5, "", None), (6, "the hat", None), (7, "Привет", None), (None, "et le chat", None), (8, "the " * 50_000, None)], "id long, text string, gram string")
    known = L.profiles(docs, "gram", "text").cache()
    assert {r["lang"] for r in known.collect()} == {"en", "fr"}
    got = {r["id"]: r for r in L.predict(docs, "id", "text", known).collect()}
    assert {k: v["lang"] for k, v in got.items()} == {1: "en", 2: "fr", 6: "en", 7: "en", None: "fr", 8: "en"}
    assert got[7]["distance"] == L.TOP + 1  # no trigram known: ties go by name
    assert L.in_languages(docs, "id", "text", known, ("fr",)).select("id").collect() == [(2,)]
    assert L.predict(docs.where("false"), "id", "text", known).count() == 0


def test_vector_coherence(spark):
    rng = np.random.default_rng(4)
    rows = [(list(rng.choice(list("abcdef"), rng.integers(0, 5))), None if i % 9 == 0 else rng.normal(size=3).tolist()) for i in range(60)]
    docs = spark.createDataFrame([([str(w) for w in ws], v) for ws, v in rows], "ws array<string>, v array<double>")
    words = {"x": "abc", "y": "def", "one": "a", "none": "zq"}
    topics = spark.createDataFrame([(t, w) for t, ws in words.items() for w in ws], "topic string, word string")
    mean = {w: np.mean([v for ws, v in rows if v is not None and w in ws], axis=0) for w in "abcdef"}
    cos = lambda a, b: a @ b / np.linalg.norm(a) / np.linalg.norm(b)
    got = {r["topic"]: r for r in TS.vector_coherence(docs, topics, "ws", "v").collect()}
    for t in ("x", "y"):
        want = np.mean([cos(mean[a], mean[b]) for a, b in itertools.combinations(words[t], 2)])
        assert abs(got[t]["coherence"] - want) < 1e-9 and got[t]["n_words"] == 3
    assert (got["one"]["n_words"], got["one"]["coherence"]) == (1, 0.0) and (got["none"]["n_words"], got["none"]["coherence"]) == (0, 0.0)


def test_trigrams_do_not_become_rows(spark):
    """As many rows as texts leave the look-up, however long these are."""
    docs = spark.createDataFrame([(1, "the cat " * 400, "en"), (2, "le chat " * 400, "fr")], "id long, text string, lang string")
    known = L.profiles(docs, "lang", "text").cache()
    df = L.distances(docs, "id", "text", known)
    assert {(r["id"], r["lang"]) for r in df.collect()} == {(i, x) for i in (1, 2) for x in ("en", "fr")}
    assert "gram" not in df._jdf.queryExecution().optimizedPlan().toString()
