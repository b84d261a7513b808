"""A language predicate without a trained service: ranks of character trigrams.

A language's profile are its most frequent trigrams of padded words, in order. A text is as far from a
language as the mean rank there of all its trigrams (one past the last for those that it lacks). Words, not
trigrams, are counted: a profile's words combine before they are cut, and a text's different words are looked up
once a batch, so that one small row a text is shuffled. Profiles have ``TOP`` rows a language and are broadcast.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOP = 300


#: Texts whose words a task looks up at once, and words that it remembers.
ROWS_AT_A_TIME, REMEMBERED = 256, 1 << 18


def words(text: Column) -> Column:
    """The lower-cased words (runs of letters)."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}]+"), "")


def trigrams(word: Column) -> Column:
    """Trigrams of a word, padded by a space on both sides."""
    return F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.substring(F.concat(F.lit(" "), word, F.lit(" ")), i, F.lit(3)))


def profiles(df: DataFrame, lang: str, text: str, top: int = TOP) -> DataFrame:
    """(lang, gram, rank) of the most frequent trigrams of each language, ties in order; from rows with both."""
    met = df.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.explode(words(F.col(text))).alias("word"))
    met = met.groupBy("lang", "word").agg(F.count("*").alias("n"))
    counts = met.select("lang", "n", F.explode(trigrams(F.col("word"))).alias("gram")).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("lang", "gram", "rank")


def distances(df: DataFrame, key: str, text: str, known: DataFrame, top: int = TOP) -> DataFrame:
    """(key, lang, distance) from 1 to top + 1 for every key with a trigram; texts of one key count together."""
    rows = known.select("lang", "gram", "rank").collect()  # TOP rows a language
    langs = sorted({r["lang"] for r in rows})
    ranks: dict[str, list[tuple[int, int]]] = {}
    for r in rows:
        ranks.setdefault(r["gram"], []).append((langs.index(r["lang"]), r["rank"]))
    shared = df.sparkSession.sparkContext.broadcast(ranks)
    sums = [f"s{i}" for i in range(len(langs))]

    def look_up(batches):
        ranks, memo = shared.value, {}

        def of(word: str) -> list[int]:
            if word not in memo:
                if len(memo) >= REMEMBERED:
                    memo.clear()
                padded, total = f" {word} ", [len(word), *[len(word) * (top + 1)] * len(langs)]
                for i in range(len(word)):
                    for at, rank in ranks.get(padded[i : i + 3], ()):
                        total[at + 1] += rank - top - 1
                memo[word] = total
            return memo[word]

        for b in batches:
            for at in range(0, b.num_rows, ROWS_AT_A_TIME):
                part = b.slice(at, ROWS_AT_A_TIME)
                size = part.column(1).value_lengths().to_numpy()
                found = part.column(1).flatten().dictionary_encode()
                each = np.array([of(w) for w in found.dictionary.to_pylist()], np.int64).reshape(-1, len(langs) + 1)
                codes, row = found.indices.to_numpy(), np.repeat(np.arange(len(size)), size)
                some = pa.array(np.flatnonzero(size))
                totals = [pa.array(np.bincount(row, c[codes], len(size)).astype(np.int64)).take(some) for c in each.T]
                yield pa.RecordBatch.from_arrays([part.column(0).take(some), *totals], names=["__key", "n", *sums])

    schema = T.StructType([T.StructField("__key", df.schema[key].dataType), *[T.StructField(c, T.LongType()) for c in ("n", *sums)]])
    met = df.where(F.col(text).isNotNull()).select(F.col(key).alias("__key"), words(F.col(text)).alias("words")).mapInArrow(look_up, schema)
    met = met.groupBy("__key").agg(*[F.sum(c).alias(c) for c in ("n", *sums)])
    none = F.array().cast("array<struct<lang:string,distance:double>>")
    each = F.explode(F.array(*[F.struct(F.lit(x).alias("lang"), (F.col(f"s{i}") / F.col("n")).alias("distance")) for i, x in enumerate(langs)]) if langs else none)
    return met.select(F.col("__key").alias(key), each.alias("d")).select(key, "d.lang", "d.distance")


def predict(df: DataFrame, key: str, text: str, known: DataFrame, top: int = TOP) -> DataFrame:
    """(key, lang, distance): the nearest language, ties by name; keys without a letter have none and are left out."""
    found = distances(df, key, text, known, top).groupBy(key).agg(F.min(F.struct("distance", "lang")).alias("d"))
    return found.select(key, "d.lang", "d.distance")


def in_languages(df: DataFrame, key: str, text: str, known: DataFrame, languages: tuple[str, ...]) -> DataFrame:
    """Rows whose text reads as one of the languages, whatever their labels say."""
    return df.join(predict(df, key, text, known).where(F.col("lang").isin(*languages)).select(key), key, "left_semi")
