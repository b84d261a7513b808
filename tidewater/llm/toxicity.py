"""Toxicity by compression distance.

Two zstandard dictionaries are made, one of what toxic texts say and ordinary ones do not, one the
other way round. A window of text that compresses better with the toxic dictionary speaks for a
toxic text. Labels mark whole documents of which a few words are toxic, so windows are single words
of the lower-cased text (the README has figures of wider ones, which drown them); padding lets the
compressor find matches up to a window's end. A document's features are drawn from the gains of all
its windows, and a logistic calibration on training documents turns them into a score whose best
threshold on those documents is put at THRESHOLD.

Training uses at most about TRAIN_DOCUMENTS labelled documents of each label, chosen by a hash of
doc_id, each whole. A word counts once for each different word before it, so that copies of a text
count once. A doc_id with labels of both kinds counts as toxic; labels other than 0 and 1 and null
ids take no part. Without labels of both kinds every score is 0. Null and empty texts have no
windows, and the score that no evidence gives. Rows that repeat a doc_id are scored row by row,
long texts whole, and an empty table gives no rows.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import zstandard as Z
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.holdout import held_out

THRESHOLD = 0.3
TRAIN_DOCUMENTS = 6000
DICTIONARY_BYTES, LEVEL, MIN_GAIN = 4096, 7, 3
#: Words from which a dictionary is trained, at most: those with the most contexts.
MAX_WORDS, MIN_CONTEXTS = 4000, 4
CACHED_WINDOWS = 200_000
_PAD = b"\0" * 12
_FEATURES = 5


def train_dictionary(words: list[tuple[str, int]], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary of the words, those with more contexts weighing more."""
    samples = [f" {w}".encode() for w, n in words for _ in range(min(n, 20))]
    order = np.random.Generator(np.random.PCG64(5)).permutation(len(samples))
    samples = [b"".join(samples[i] for i in order[at : at + 4]) for at in range(0, len(order), 4)]
    raw = b"".join(samples)
    if len(raw) > 4 * size:
        raw = Z.train_dictionary(size, samples, steps=4, threads=1, level=12, k=16, d=6).as_bytes()[512:]
    return raw[-size:] or _PAD


@cache
def _compressor(raw: bytes) -> Z.ZstdCompressor:
    own = Z.ZstdCompressionDict(raw, dict_type=Z.DICT_TYPE_RAWCONTENT)
    how = Z.ZstdCompressionParameters.from_level(LEVEL, dict_size=len(raw), source_size=64, min_match=3, write_content_size=False, write_checksum=False, write_dict_id=False, format=Z.FORMAT_ZSTD1_MAGICLESS)
    own.precompute_compress(compression_params=how)
    return Z.ZstdCompressor(dict_data=own, compression_params=how)


_gains: dict[tuple[bytes, bytes], dict[bytes, int]] = {}


def features(text: str | None, toxic: bytes, ordinary: bytes) -> tuple[float, ...]:
    """What the gains of the document's windows say: total, rate, largest, and rates of clear gains."""
    known = _gains.setdefault((toxic, ordinary), {})
    if len(known) > CACHED_WINDOWS:
        known.clear()
    words = (text or "").lower().encode("utf-8", "replace").split()
    gains, get = [], known.get
    for w in words:
        g = get(w)
        if g is None:
            window = b" " + w + _PAD
            g = known[w] = len(_compressor(ordinary).compress(window)) - len(_compressor(toxic).compress(window))
        if g >= MIN_GAIN:
            gains.append(g)
    n, total = len(words) + 20, sum(gains)
    clear = sum(g > MIN_GAIN for g in gains)
    return float(np.log1p(total)), total / n, float(max(gains, default=0)), clear / n, float(np.log1p(clear))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weights of standardised features, folded back; the last is the constant."""
    mean, sd = x.mean(axis=0), x.std(axis=0) + 1e-9
    a = np.hstack([(x - mean) / sd, np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p) + 1e-6)[:, None]) + ridge * len(x) * np.eye(len(w)), a.T @ (p - y) + ridge * len(x) * w)
        w -= step
        if abs(step).max() < 1e-8:
            break
    return np.append(w[:-1] / sd, w[-1] - (w[:-1] * mean / sd).sum())


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", bound: int = TRAIN_DOCUMENTS) -> dict:
    """Dictionaries, weights and the log-odds at which the score is THRESHOLD."""
    known = labels.select(F.col(key).cast("long").alias("k"), F.col(label).cast("int").alias("y")).where("k is not null and y in (0, 1)").where(~held_out(F.col("k"))).groupBy("k").agg(F.max("y").alias("y"))
    n = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return {}
    share = F.when(F.col("y") == 1, bound / n[1]).otherwise(bound / n[0])
    known = known.where(F.pmod(F.xxhash64("k"), F.lit(1 << 30)) / float(1 << 30) < share)
    # known has about 2 * bound rows at most, so it goes to the documents, not they to it
    sample = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).join(F.broadcast(known), "k").dropDuplicates(["t", "y"])
    sample = sample.persist()
    words = F.split(F.lower("t"), r"[ \t-\r]+")
    pairs = sample.select("y", words.alias("w")).select("y", F.explode(F.arrays_zip(F.concat(F.array(F.lit("")), "w").alias("before"), F.col("w").alias("word"))).alias("p"))
    pairs = pairs.select("y", "p.before", "p.word").where("word <> ''").distinct()
    by_word = pairs.groupBy("word").agg(F.count(F.when(F.col("y") == 1, 1)).alias("a"), F.count(F.when(F.col("y") == 0, 1)).alias("b")).where(f"a >= {MIN_CONTEXTS} or b >= {MIN_CONTEXTS}").persist()
    all_a, all_b = by_word.agg(F.sum("a"), F.sum("b")).first()
    if not all_a or not all_b:
        return {}

    def typical(mine: str, other: str, n_mine: int, n_other: int, times: float) -> list[tuple[str, int]]:
        much = F.col(mine) / n_mine > times * (F.col(other) + 0.5) / n_other
        rows = by_word.where(f"{mine} >= {MIN_CONTEXTS}").where(much).orderBy(F.desc(mine), "word").limit(MAX_WORDS).collect()
        return [(r["word"], r[mine]) for r in rows]

    toxic = train_dictionary(typical("a", "b", all_a, all_b, 20))
    ordinary = train_dictionary(typical("b", "a", all_b, all_a, 2))

    def measure(batches):
        for b in batches:
            x = np.array([features(t, toxic, ordinary) for t in b.column(0).to_pylist()]).reshape(-1, _FEATURES)
            yield pa.RecordBatch.from_arrays([b.column(1), *(pa.array(c) for c in x.T)], ["y", *(f"f{i}" for i in range(_FEATURES))])

    got = sample.select("t", "y").mapInArrow(measure, "y int, " + ", ".join(f"f{i} double" for i in range(_FEATURES))).toPandas().to_numpy(float)
    for df in (sample, by_word):
        df.unpersist()
    x, y = got[:, 1:], got[:, 0]
    if len(set(y)) < 2:
        return {}
    # classes are sampled at unlike rates: weights balance them to their shares of the labels
    w = fit_logistic(x, y)
    z = x @ w[:-1] + w[-1]
    order = np.argsort(-z)
    ratio = (n[0] / max(1, (y == 0).sum())) / (n[1] / max(1, (y == 1).sum()))
    hits, wrong = np.cumsum(y[order]), np.cumsum(1 - y[order]) * ratio
    f1 = 2 * hits / (hits + wrong + y.sum())
    ends = np.flatnonzero(np.append(z[order][1:] != z[order][:-1], True))
    best = ends[np.argmax(f1[ends])]
    upper, lower = z[order][best], z[order][best + 1] if best + 1 < len(z) else z[order][best] - 1
    return {"toxic": toxic, "ordinary": ordinary, "weights": w, "cut": (upper + lower) / 2}


def score_documents(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """docs with __score added."""
    at = docs.columns.index(text)
    schema = docs.withColumn("__score", F.lit(0.0)).schema

    def score(batches):
        for b in batches:
            if model:
                x = np.array([features(t.as_py(), model["toxic"], model["ordinary"]) for t in b.column(at)]).reshape(-1, _FEATURES)
                z = x @ model["weights"][:-1] + model["weights"][-1] - model["cut"] + np.log(THRESHOLD / (1 - THRESHOLD))
                p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            else:
                p = np.zeros(b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p)], [*b.schema.names, "__score"])

    return docs.mapInArrow(score, schema)


def toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, and predicted (score >= THRESHOLD) of every document."""
    scored = score_documents(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")), train(docs, labels, key, text))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= THRESHOLD).cast("int").alias("predicted"))
