"""Hashing kernels against plain Python."""

import random
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewater.llm import common as C


def all_words(texts, limit=C.SLICE_BYTES, gap=C._SPACE):
    out = [[] for _ in texts]
    for first, _, data, offsets in C.text_slices(pa.array(texts, pa.string()), limit):
        h, rows = C.words_of(data, offsets, gap)
        for x, r in zip(h.tolist(), rows.tolist(), strict=True):
            out[first + r].append(x)
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aBc é\n\t\x0b漢-", max_size=40)), max_size=12))
def test_words_are_the_runs_of_other_bytes(texts):
    got = all_words(texts, limit=16)
    seen = {}
    for t, hs in zip(texts, got, strict=True):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        assert len(words) == len(hs)
        for w, h in zip(words, hs, strict=True):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_long_row_is_cut_at_white_space():
    t = " ".join(f"w{i % 977}" for i in range(900_000))  # over twice the slice
    h = all_words([t, "w1 w2"])
    assert len(h[0]) == 900_000 and h[1] == [h[0][1], h[0][2]]


def test_slices_of_chunks_and_views():
    a = pa.chunked_array([pa.array(["a b", None, ""]), pa.array(["c", "d e f"]).slice(1)])
    rows = []
    for first, end, _, offsets in C.text_slices(a, 2):
        rows += list(range(first, end))
        assert len(offsets) == end - first + 1
    assert rows == [0, 1, 2, 3]


def test_shingles_and_distinct():
    random.seed(0)
    docs = [[random.randrange(5) for _ in range(n)] for n in (0, 1, 3, 4, 9, 40)]
    words = np.array([w for d in docs for w in d], dtype=np.uint64)
    rows = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    h, of = C.shingles(words, rows, len(docs), 4)
    h, off = C.distinct_per_row(h, of, len(docs))
    for k, d in enumerate(docs):
        want = {tuple(d[i : i + 4]) for i in range(len(d) - 3)} if len(d) >= 4 else ({tuple(d)} if d else set())
        assert off[k + 1] - off[k] == len(want)


def test_bits(spark):
    keys = spark.range(0, 3000, 3).toDF("k")
    bits = C.take_bits(spark, keys, "k", 18)
    assert C.has_bit(bits, np.arange(0, 3000, 3).astype(np.uint64), 18).all()
    assert C.has_bit(bits, np.arange(10_000, 12_000).astype(np.uint64), 18).mean() < 0.05
    assert not C.has_bit(C.take_bits(spark, keys.where("k < 0"), "k", 14), np.arange(100).astype(np.uint64), 14).any()
