"""Term statistics of texts: TF-IDF, topic shares, coherence, cached scoring of rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.sources.scratch import materialize

TOKEN = r"[\p{L}\p{N}_]{2,}"


def tf_idf(docs: DataFrame, key: str, text: str, min_df: int = 1, max_df: float = 1.0, vocabulary: int = 10_000) -> DataFrame:
    """(key, term, weight): term counts times ln((1+n)/(1+df)) + 1, each document scaled to length 1.

    The vocabulary are the most frequent terms within the document-frequency bounds.
    """
    terms = docs.select(key, F.explode(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), 0)).alias("term"))
    tf = terms.groupBy(key, "term").agg(F.count("*").alias("tf"))
    tf = materialize(tf, "term-counts")  # read for the vocabulary and for the weights
    n = docs.agg(F.count("*").alias("n"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total")).crossJoin(F.broadcast(n))
    df = df.where((F.col("df") >= min_df) & (F.col("df") <= max_df * F.col("n"))).orderBy(F.desc("total"), "term").limit(vocabulary)
    idf = df.select("term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    raw = tf.join(idf, "term").select(key, "term", (F.col("tf") * F.col("idf")).alias("w"))
    length = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("len"))
    return raw.join(length, key).select(key, "term", (F.col("w") / F.col("len")).alias("weight"))


def top_terms(weights: DataFrame, docs: DataFrame, top: int) -> DataFrame:
    """Terms by mean weight over all documents."""
    n = docs.agg(F.count("*").alias("n"))
    total = weights.groupBy("term").agg(F.sum("weight").alias("w")).crossJoin(F.broadcast(n))
    return total.select("term", F.round(F.col("w") / F.col("n"), 6).alias("score")).orderBy(F.desc("score"), "term").limit(top)


def slice_shares(assigned: DataFrame, slices: list[str], topic: str) -> DataFrame:
    """n and share of every topic in every slice."""
    counts = assigned.groupBy(*slices, topic).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*slices)))


def slice_summary(shares: DataFrame, slices: list[str], topic: str) -> DataFrame:
    """Documents, topics, the largest topic and its share, of every slice."""
    top = F.max(F.struct("n", F.negative(topic).alias("t")))
    return shares.groupBy(*slices).agg(F.sum("n").alias("n_documents"), F.count("*").alias("n_topics"), F.negative(top["t"]).alias("top_topic"), F.max("share").alias("top_share"))


def cosine_coherence(pairs: DataFrame, topic: str) -> DataFrame:
    """topic and coherence: mean cosine of the words' NPMI vectors to their sum, from (topic, a, b, npmi).

    pairs holds every pair of a topic's words once, a few dozen a topic; a word's own value is 1.
    """
    both = pairs.select(topic, "a", "b", "npmi").union(pairs.select(topic, F.col("b").alias("a"), F.col("a").alias("b"), "npmi"))
    own = both.select(topic, "a").distinct().select(topic, "a", F.col("a").alias("b"), F.lit(1.0).alias("npmi"))
    cells = both.union(own)
    total = cells.groupBy(topic, "b").agg(F.sum("npmi").alias("sum"))
    length = total.groupBy(topic).agg(F.sqrt(F.sum(F.col("sum") * F.col("sum"))).alias("total_length"))
    words = cells.join(total, [topic, "b"]).groupBy(topic, "a").agg(F.sum(F.col("npmi") * F.col("sum")).alias("dot"), F.sqrt(F.sum(F.col("npmi") * F.col("npmi"))).alias("length"))
    return words.join(length, topic).groupBy(topic).agg(F.avg(F.try_divide(F.col("dot"), F.col("length") * F.col("total_length"))).alias("coherence"))


def npmi(docs: DataFrame, key: str, words: str, pairs: DataFrame) -> DataFrame:
    """pairs (a, b) with the normalised pointwise mutual information of words in documents.

    Only the words of the pairs are kept, and only the pairs asked for are counted.
    """
    wanted = pairs.select(F.col("a").alias("w")).union(pairs.select(F.col("b").alias("w"))).distinct()
    held = docs.select(key, F.explode(F.array_distinct(words)).alias("w")).join(wanted, "w", "left_semi")
    n = docs.agg(F.count("*").alias("n"))
    single = held.groupBy("w").agg(F.count("*").alias("c"))
    a, b = held.withColumnRenamed("w", "a"), held.withColumnRenamed("w", "b")
    both = a.join(pairs, "a").join(b, [key, "b"]).groupBy("a", "b").agg(F.count("*").alias("nab"))
    out = pairs.join(both, ["a", "b"], "left").join(single.withColumnsRenamed({"w": "a", "c": "na"}), "a").join(single.withColumnsRenamed({"w": "b", "c": "nb"}), "b").crossJoin(F.broadcast(n))
    p = F.col("nab") / F.col("n")
    pmi = F.log(p * F.col("n") * F.col("n") / (F.col("na") * F.col("nb")))
    return out.select("a", "b", F.when(F.col("nab").isNull(), -1.0).when(F.col("nab") == F.col("n"), 1.0).otherwise(pmi / -F.log(p)).alias("npmi"))


def classify(df: DataFrame, scorer: Callable[[pd.DataFrame], pd.DataFrame], schema: str, batch: int = 1000) -> DataFrame:
    """Rows through a pluggable scorer, in batches; the scorer gets and gives pandas frames."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch):
                yield scorer(frame.iloc[at : at + batch])

    return df.mapInPandas(run, schema)


def valence(words: Column, lexicon: dict[str, float], alpha: float = 15.0) -> Column:
    """Compound score of a word list under a valence lexicon: sum over sqrt(sum^2 + alpha).

    The default rule-based stand-in for valence models; the lexicon is the caller's.
    """
    table = F.create_map(*[F.lit(x) for pair in lexicon.items() for x in pair])
    total = F.aggregate(words, F.lit(0.0), lambda s, w: s + F.coalesce(F.element_at(table, F.lower(w)), F.lit(0.0)))
    return total / F.sqrt(total * total + alpha)


def vector_coherence(docs: DataFrame, topics: DataFrame, words: str, vector: str) -> DataFrame:
    """(topic, n_words, coherence): mean cosine over a topic's pairs of words between the words' mean vectors.

    docs has a word list and a vector a row, topics (topic, word) a few dozen words a topic. A word's vector is
    the mean of the vectors of documents that hold it: one aggregate that combines sums by word and place.
    For unit vectors u of n words the sum over pairs is (|sum u|^2 - n) / 2, so no pair is formed. Words
    that no document holds take no part; topics of fewer than two words have coherence 0.
    """
    wanted = topics.select(F.col("word").alias("w")).distinct()
    held = docs.where(F.col(vector).isNotNull()).select(F.explode(F.array_distinct(words)).alias("w"), F.col(vector).alias("v")).join(wanted, "w", "left_semi")
    means = held.select("w", F.posexplode("v").alias("i", "x")).groupBy("w", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    length = means.groupBy("w").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("length")).where("length > 0")
    units = topics.select("topic", F.col("word").alias("w")).distinct().join(means, "w").join(length, "w").select("topic", "w", "i", (F.col("x") / F.col("length")).alias("u"))
    n = units.groupBy("topic").agg(F.count_distinct("w").alias("n_words"))
    total = units.groupBy("topic", "i").agg(F.sum("u").alias("s")).groupBy("topic").agg(F.sum(F.col("s") * F.col("s")).alias("ss"))
    out = topics.select("topic").distinct().join(n, "topic", "left").join(total, "topic", "left")
    mean = (F.col("ss") - F.col("n_words")) / (F.col("n_words") * (F.col("n_words") - 1))
    return out.select("topic", F.coalesce("n_words", F.lit(0).cast("long")).alias("n_words"), F.when(F.col("n_words") > 1, mean).otherwise(0.0).alias("coherence"))
