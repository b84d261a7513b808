"""Language identification of mixed text: script ranges, word scores, Viterbi over words.

A language has, learned from labelled documents, log-probabilities of hashed character
n-grams of its words, and the scripts that its letters use. A word's scripts narrow the
candidates; the others get no more than FORBIDDEN. Viterbi over the words, with a penalty
for every switch, labels spans of one language; a document's language is the one with most
letters in its spans, and the score is its share of the letters, scaled by how sure the
word scores are. All documents of a batch step through their words together.

Learning reads at most about TRAIN_DOCUMENTS documents of each language, chosen by a hash
of doc_id, each whole.
At most MAX_LANGUAGES languages are learned, those with the most rows (ties by name), so that a
column of free text as ``lang`` stays bounded. Texts that are null or have no letter are ``und``
with score 0, as is every text without any labelled document. Rows that repeat a doc_id are
labelled row by row, ties between languages go to the first by name, and an empty table gives
no rows. Long texts are labelled whole.
"""

from __future__ import annotations

import re
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm import common as C
from tidewater.llm.holdout import held_out

U64 = C.U64
TRAIN_DOCUMENTS, MAX_LANGUAGES = 1500, 200
#: Scripts by ranges of code points (fixed values of the Unicode standard).
SCRIPTS = {
    "latin": ((0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0x24F), (0x1E00, 0x1EFF)),
    "greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)),
    "cyrillic": ((0x400, 0x52F),),
    "armenian": ((0x531, 0x587),),
    "hebrew": ((0x5D0, 0x5EA),),
    "arabic": ((0x620, 0x6FF), (0x750, 0x77F)),
    "devanagari": ((0x900, 0x97F),),
    "bengali": ((0x980, 0x9FF),),
    "thai": ((0xE01, 0xE4E),),
    "georgian": ((0x10A0, 0x10FF),),
    "hangul": ((0x1100, 0x11FF), (0xAC00, 0xD7AF)),
    "kana": ((0x3041, 0x30FF),),
    "han": ((0x3400, 0x4DBF), (0x4E00, 0x9FFF)),
}
BUCKET_BITS, MAX_N = 16, 4
FORBIDDEN, SWITCH_PENALTY = -12.0, 9.0
#: Words whose scores a task keeps.
CACHED_WORDS = 500_000
#: Documents of over eight times as many words are labelled in segments of this many.
SEGMENT = 256
#: Bytes that the lanes of a long document may take; beyond, its words are stepped through one by one.
LANE_BYTES = 64 << 20
_LETTER_WORD = re.compile(r"[^\W\d_]+")  # and numbers that are not digits, like fractions
_table = np.full(0x10000, len(SCRIPTS), np.uint8)
for _k, _ranges in enumerate(SCRIPTS.values()):
    for _a, _b in _ranges:
        _table[_a : _b + 1] = _k


def words_at(text: str) -> list[tuple[int, int]]:
    """Start and end of every run of letters."""
    found = []
    for m in _LETTER_WORD.finditer(text):
        if m.group().isalpha():
            found.append(m.span())
        else:
            at = m.start()
            for letters, run in groupby(m.group(), str.isalpha):
                n = len(list(run))
                if letters:
                    found.append((at, at + n))
                at += n
    return found


def words_of(text: str) -> list[str]:
    """The runs of letters of a text, in lower case, one for one with words_at."""
    low = text.lower()
    if len(low) == len(text):  # character for character
        words = _LETTER_WORD.findall(low)
        if not words or low.isascii() or "".join(words).isalpha():
            return words
    words = _LETTER_WORD.findall(text)
    words = ["".join(run) for w in words for letters, run in groupby(w, str.isalpha) if letters]
    return " ".join(words).lower().split(" ") if words else []


def scripts_of(words: list[str]) -> np.ndarray:
    """Which scripts the letters of every word belong to (words, scripts + 1); the last: none known."""
    codes = np.frombuffer("".join(words).encode("utf-32-le", "replace"), "<u4").astype(np.int64)
    script = np.where(codes < len(_table), _table[np.minimum(codes, len(_table) - 1)], len(SCRIPTS))
    out = np.zeros((len(words), len(SCRIPTS) + 1), bool)
    out[np.repeat(np.arange(len(words)), [len(w) for w in words]), script] = True
    out[:, -1] &= ~out[:, :-1].any(axis=1)  # marks among known letters say nothing
    return out


def ngram_buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the 1- to MAX_N-byte n-grams of every word (with edges), and offsets by word."""
    raw = [b"\x02" + w.encode("utf-8", "replace") + b"\x03" for w in words]
    data = np.frombuffer(b"".join(raw), np.uint8).astype(U64)
    size = np.array([len(r) for r in raw])
    end = np.repeat(np.cumsum(size), size)
    place = np.arange(len(data))
    h = np.zeros(len(data), dtype=U64)
    grams, owner = [], []
    word = np.repeat(np.arange(len(words)), size)
    for n in range(1, MAX_N + 1):
        shifted = np.zeros(len(data), dtype=U64)
        shifted[: len(data) - n + 1] = data[n - 1 :]
        h = h * U64(257) + shifted + U64(1)
        ok = place + n <= end
        grams.append((C.mix64(h[ok] + U64(n * 0x9E3779B97F4A7C15 % 2**64)) >> U64(64 - BUCKET_BITS)).astype(np.int64))
        owner.append(word[ok])
    g, o = np.concatenate(grams), np.concatenate(owner)
    order = np.argsort(o, kind="stable")
    return g[order], np.concatenate([[0], np.cumsum(np.bincount(o, minlength=len(words)))])


def learn(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", bound: int = TRAIN_DOCUMENTS) -> dict:
    """Languages, n-gram log-probabilities by language, and which scripts each may have."""
    known = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"), F.col(lang).alias("l")).where("l is not null and t is not null").where(~held_out(F.col("k")))
    n = {r["l"]: r["n"] for r in known.groupBy("l").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "l").limit(MAX_LANGUAGES).collect()}
    langs = sorted(n)
    if not langs:
        return {"langs": []}
    share = F.element_at(F.create_map(*[F.lit(x) for k in langs for x in (k, bound / n[k])]), F.col("l"))
    place = F.element_at(F.create_map(*[F.lit(x) for i, k in enumerate(langs) for x in (k, i)]), F.col("l"))
    sample = known.where(F.col("l").isin(langs)).where(F.pmod(F.xxhash64("k"), F.lit(1 << 30)) / float(1 << 30) < share).select("t", place.alias("l"))

    def count(batches):
        grams = np.zeros((len(langs), 1 << BUCKET_BITS), np.int64)
        scripts = np.zeros((len(langs), len(SCRIPTS) + 1), np.int64)
        for b in batches:
            for t, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = words_of(t)
                if words:
                    g, _ = ngram_buckets(words)
                    grams[k] += np.bincount(g, minlength=1 << BUCKET_BITS)
                    scripts[k] += scripts_of(words).sum(axis=0)
        for k in range(len(langs)):
            used = np.flatnonzero(grams[k])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), k)), pa.array(used), pa.array(grams[k][used])], ["l", "g", "n"])
            used = np.flatnonzero(scripts[k])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), k)), pa.array(used + (1 << BUCKET_BITS)), pa.array(scripts[k][used])], ["l", "g", "n"])

    # 2**BUCKET_BITS + len(SCRIPTS) + 1 rows a language at most
    got = sample.mapInArrow(count, "l long, g long, n long").groupBy("l", "g").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((len(langs), (1 << BUCKET_BITS) + len(SCRIPTS) + 1))
    counts[got["l"].to_numpy(), got["g"].to_numpy()] = got["n"].to_numpy()
    grams, scripts = counts[:, : 1 << BUCKET_BITS], counts[:, 1 << BUCKET_BITS :]
    logp = np.log((grams + 0.5) / (grams.sum(axis=1, keepdims=True) + 0.5 * grams.shape[1]))
    may = scripts >= 0.001 * np.maximum(1, scripts.sum(axis=1, keepdims=True))
    may[:, may.sum(axis=0) == 0] = True  # a script that no language uses narrows nothing
    return {"langs": langs, "logp": (logp - logp.mean(axis=0)).T.astype(np.float32).copy(), "may": may.T.copy()}


def word_scores(words: list[str], model: dict) -> np.ndarray:
    """Score of every word by language: mean n-gram evidence times a damped length."""
    g, off = ngram_buckets(words)
    n = np.diff(off)
    total = np.add.reduceat(model["logp"][g], off[:-1], axis=0)
    score = total / np.sqrt(n)[:, None] / 2
    barred = scripts_of(words).astype(np.float32) @ (~model["may"]).astype(np.float32) > 0  # by any letter
    return np.where(barred & ~barred.all(axis=1, keepdims=True), np.minimum(score, 0) + FORBIDDEN, score).astype(np.float32)


def _forward(score: np.ndarray, best: np.ndarray, penalty: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Final scores by last state, and for every word whence a switch comes and who stays."""
    n, n_words, n_langs = score.shape
    came = np.zeros((n_words, n), np.int16)
    stay = np.zeros((n_words, n, n_langs), bool)
    rows = np.arange(n)
    for t in range(1, n_words):
        top = best.argmax(axis=1)
        jump = best[rows, top] - penalty
        came[t] = top
        stay[t] = best >= jump[:, None]
        best = np.maximum(best, jump[:, None]) + score[:, t]
    return best, came, stay


def _backward(state: np.ndarray, came: np.ndarray, stay: np.ndarray) -> np.ndarray:
    path = np.zeros((len(state), len(came)), np.int16)
    rows = np.arange(len(state))
    for t in range(len(came) - 1, 0, -1):
        path[:, t] = state
        state = np.where(stay[t][rows, state], state, came[t])
    path[:, 0] = state
    return path


def viterbi(score: np.ndarray, penalty: float = SWITCH_PENALTY) -> np.ndarray:
    """Best states (documents, words) for scores (documents, words, languages); zeros pad."""
    best, came, stay = _forward(score, score[:, 0].copy(), penalty)
    return _backward(best.argmax(axis=1), came, stay)


def viterbi_long(score: np.ndarray, penalty: float = SWITCH_PENALTY, width: int = SEGMENT) -> np.ndarray:
    """Best states of one long document (words, languages): its segments step together, each from
    every state that may come before it, and are then chained from first to last. With so many
    languages that this would take over LANE_BYTES, the words are stepped through in turn."""
    n, n_langs = score.shape
    if n * n_langs * (5 * n_langs + 1) > LANE_BYTES:
        return viterbi(score[None], penalty)[0]
    n_seg = -(-n // width)
    padded = np.zeros((n_seg * width, n_langs), score.dtype)
    padded[:n] = score
    seg = np.repeat(padded.reshape(n_seg, width, n_langs), n_langs, axis=0)
    enter = np.where(np.eye(n_langs, dtype=bool), 0, -penalty).astype(score.dtype)
    begin = np.tile(enter, (n_seg, 1)) + seg[:, 0]
    begin[:n_langs] = seg[:n_langs, 0]  # nothing comes before the first
    best, came, stay = _forward(seg, begin, penalty)
    best = best.reshape(n_seg, n_langs, n_langs).astype(np.float64)
    total, whence = best[0, 0], []
    for k in range(1, n_seg):
        both = total[:, None] + best[k]
        whence.append(both.argmax(axis=0))
        total = both.max(axis=0)
    state = np.zeros(n_seg, np.int64)
    lane = np.zeros(n_seg, np.int64)
    state[-1] = total.argmax()
    for k in range(n_seg - 1, 0, -1):
        lane[k] = state[k - 1] = whence[k - 1][state[k]]
    pick = np.arange(n_seg) * n_langs + lane
    return _backward(state, came[:, pick], stay[:, pick]).reshape(-1)[:n]


class Labeller:
    """Labels texts with a model; keeps the scores of frequent words."""

    def __init__(self, model: dict):
        self.model, self.known, self.rows = model, {}, np.zeros((1024, len(model["langs"])), np.float32)
        self.sizes = np.zeros(1024, np.int32)

    def ids(self, words: list[str]) -> np.ndarray:
        known = self.known
        new = [w for w in dict.fromkeys(words) if w not in known]
        if new:
            if len(known) + len(new) > CACHED_WORDS:
                known.clear()
                new = list(dict.fromkeys(words))
            at = len(known)
            while at + len(new) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
                self.sizes = np.concatenate([self.sizes, np.zeros_like(self.sizes)])
            self.sizes[at : at + len(new)] = [len(w) for w in new]
            for a in range(0, len(new), 50_000):
                self.rows[at + a : at + a + len(new[a : a + 50_000])] = word_scores(new[a : a + 50_000], self.model)
            known.update(zip(new, range(at, at + len(new)), strict=True))
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    def label(self, texts: list[str | None]) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
        """Language, score and spans (first word, end word, language) of every text; words as in words_at."""
        out = [("und", 0.0, [])] * len(texts)
        held, n = [], 0
        for i, t in enumerate(texts):
            words = words_of(t) if t else []
            if words and self.model["langs"]:
                held.append((i, words))
                n += len(words)
            if n > 400_000 or i + 1 == len(texts):
                held.sort(key=lambda x: len(x[1]))
                a = 0
                while a < len(held):  # texts of like length step together
                    e = a
                    while e < len(held) and len(held[e][1]) <= 1.3 * len(held[a][1]) + 8 and (e - a + 1) * len(held[e][1]) <= 200_000 or e == a:
                        e += 1
                    for (k, _), got in zip(held[a:e], self._batch([w for _, w in held[a:e]]), strict=True):
                        out[k] = got
                    a = e
                held, n = [], 0
        return out

    def _batch(self, docs: list[list[str]]):
        langs = self.model["langs"]
        width = max(map(len, docs))
        score = np.zeros((len(docs), width, len(langs)), np.float32)
        letters = np.zeros((len(docs), width), np.int32)
        flat = list(chain.from_iterable(docs))
        ids = self.ids(flat)
        there = np.arange(width) < np.array([len(w) for w in docs])[:, None]
        score[there] = self.rows[ids]
        letters[there] = self.sizes[ids]
        path = viterbi(score) if width <= 8 * SEGMENT else np.stack([np.pad(viterbi_long(score[k, : len(w)]), (0, width - len(w))) for k, w in enumerate(docs)])
        for k, words in enumerate(docs):
            states = path[k, : len(words)]
            per = np.bincount(states, weights=letters[k, : len(words)], minlength=len(langs))
            top = int(per.argmax())
            total = score[k, : len(words)].sum(axis=0)
            odds = np.exp(np.clip(total - total.max(), -30, 0) / np.sqrt(len(words)))
            cuts = np.flatnonzero(np.diff(states)) + 1
            spans = [(int(x), int(y), langs[states[x]]) for x, y in zip([0, *cuts], [*cuts, len(words)], strict=True)]
            yield langs[top], float(per[top] / per.sum() * (odds[top] / odds.sum())), spans


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score, and spans: array of (start, end, lang) in code points, each
    from the first letter of its first word to the last of its last."""
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, key, text, lang))
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def place(t, spans):
        if not spans:
            return []
        if len(spans) == 1:  # from the first letter to the last
            a, e = 0, len(t)
            while not t[a].isalpha():
                a += 1
            while not t[e - 1].isalpha():
                e -= 1
            return [{"start": a, "end": e, "lang": spans[0][2]}]
        at = words_at(t)
        return [{"start": at[x][0], "end": at[y - 1][1], "lang": name} for x, y, name in spans]

    def label(batches):
        labeller = Labeller(model.value)
        for b in batches:
            for a in range(0, b.num_rows, 2000):
                part = b.slice(a, 2000)
                texts = part.column(1).to_pylist()
                got = labeller.label(texts)
                spans = [place(t, g[2]) for t, g in zip(texts, got, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array(spans, kind)], ["doc_id", "lang_pred", "score", "spans"])

    found = docs.select(F.col(key).cast("long").alias("doc_id"), text).mapInArrow(label, "doc_id long, lang_pred string, score double, spans array<struct<start:int,end:int,lang:string>>")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "spans")
