"""Rule-based valence of texts: negation, boosters, capitals, "but" and punctuation, over a given lexicon.

The rules are those of a widely used public sentiment model. A batch of texts becomes one flat array of word
numbers; what is known of a word is looked up once a batch, and the rules run in numpy over the places of the
lexicon's words alone, since no other word has a valence. The lexicon is a table of any size: one of
``LEXICON`` rows at most travels with the tasks, a larger one is joined so that each row carries only the entries
of its own words. Idioms are not known, and of "but" the first counts, for the words before and after it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How much a booster adds, a word in capitals adds, and what a negation multiplies by.
BOOST, CAPITALS, NEGATION = 0.293, 0.733, -0.74
#: Words that strengthen and words that weaken what follows.
STRONGER = """absolutely amazingly awfully completely considerable considerably decidedly deeply effing enormous enormously entirely especially exceptional exceptionally extreme extremely fabulously flipping flippin frackin fracking fricking frickin frigging friggin fully fuckin fucking fuggin fugging greatly hella highly hugely incredible incredibly intensely major majorly more most particularly purely quite really remarkably so substantially thoroughly total totally tremendous tremendously uber unbelievably unusually utter utterly very""".split()
WEAKER = """almost barely hardly kinda less little marginal marginally occasional occasionally partly scarce scarcely slight slightly somewhat sorta""".split()
BOOSTERS = dict.fromkeys(STRONGER, BOOST) | dict.fromkeys(WEAKER, -BOOST)
#: Words that negate, besides all with n't.
NEGATIONS = """aint arent cannot cant couldnt darent didnt doesnt dont hadnt hasnt havent isnt mightnt mustnt neither neednt never none nope nor not nothing nowhere oughtnt shant shouldnt uhuh wasnt werent without wont wouldnt rarely seldom despite""".split()
#: ASCII punctuation, which is stripped from words of over two letters.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Fixed value: a sum of valences s becomes s / sqrt(s * s + ALPHA).
ALPHA = 15.0
#: Largest lexicon that travels with the tasks, and the text bytes that a task works on at once (a longer text is one piece).
LEXICON, PIECE = 100_000, 2 << 20
#: Words that rules name, numbered from 1.
NAMED = {w: i for i, w in enumerate("no kind of or nor never so this without doubt least at very but".split(), 1)}
SHARES = ("compound", "pos", "neg", "neu")


def tokens(text: Column) -> Column:
    """Words between white space, without punctuation around them unless two characters or fewer would remain."""
    bare = lambda w: F.btrim(w, F.lit(PUNCTUATION))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.when(F.length(bare(w)) <= 2, w).otherwise(bare(w)))


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts as ``tokens`` tells them apart, in a row, and where each text's words begin (and the last ends)."""
    split = pc.ascii_split_whitespace(texts)
    flat, ends = split.flatten(), split.offsets.to_numpy()
    there = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    starts = np.concatenate([[0], np.cumsum(there)])[ends - ends[0]]
    flat = flat.filter(pa.array(there))
    bare = pc.ascii_trim(flat, PUNCTUATION)
    return pc.if_else(pc.less_equal(pc.utf8_length(bare), 2), flat, bare), starts


class Rules:
    """The rules over a batch of texts; the lexicon comes with the object, with the texts, or both."""

    def __init__(self, lexicon: dict[str, float], boosters: dict[str, float], negations: list[str]) -> None:
        self.lexicon, self.boosters, self.negations = lexicon, boosters, set(negations)

    def __call__(self, texts: pa.Array, entries: dict[str, float] | None = None) -> dict[str, np.ndarray]:
        texts = pc.fill_null(texts, "")
        words, starts = words_of(texts)
        coded = words.dictionary_encode()
        code, distinct = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        lexicon = self.lexicon if entries is None else entries
        low = [w.lower() for w in distinct]
        lex = np.array([lexicon.get(w, 0.0) for w in low], float)
        listed = np.array([w in lexicon for w in low], bool)
        boost = np.array([self.boosters.get(w, 0.0) for w in low], float)
        boosts = np.array([w in self.boosters for w in low], bool)
        neg = np.array([w in self.negations or "n't" in w for w in low], bool)
        up = np.array([w != v and w.upper() == w for w, v in zip(distinct, low, strict=True)], bool)
        name = np.array([NAMED.get(w, 0) for w in low], np.int8)

        n, many = np.diff(starts), np.bincount
        text_of = np.repeat(np.arange(len(n)), n)
        loud = np.concatenate([[0], np.cumsum(up[code])])
        loud = loud[starts[1:]] - loud[starts[:-1]]
        mixed = (loud > 0) & (loud < n)
        buts = np.flatnonzero(name[code] == NAMED["but"])
        but = np.full(len(n), -1)
        but[text_of[buts][::-1]] = buts[::-1]  # the first of each text is written last

        hits = np.flatnonzero(listed[code])
        at_text = text_of[hits]
        first, end, some = starts[at_text], starts[at_text + 1], mixed[at_text]

        def around(k: int) -> tuple[np.ndarray, np.ndarray]:
            """The word k places on from every hit, and whether it is there."""
            there = (hits + k >= first) & (hits + k < end)
            return code[np.where(there, hits + k, hits)], there

        def named(k: int, *which: str) -> np.ndarray:
            w, there = around(k)
            return there & np.isin(name[w], [NAMED[x] for x in which])

        here, (after, follows) = code[hits], around(1)
        silent = boosts[here] | (named(0, "kind") & named(1, "of"))
        after_no = named(-1, "no") | named(-2, "no") | (named(-3, "no") & named(-1, "or", "nor"))
        v = np.where(after_no, lex[here] * NEGATION, np.where(named(0, "no") & follows & listed[after], 0.0, lex[here]))
        v = v + np.where(up[here] & some, np.where(v > 0, CAPITALS, -CAPITALS), 0.0)
        for k, damping in ((1, 1.0), (2, 0.95), (3, 0.9)):
            w, there = around(-k)
            step = boost[w] * np.where(v < 0, -1.0, 1.0) + np.where(up[w] & some, np.where(v > 0, CAPITALS, -CAPITALS), 0.0)
            changed = v + np.where(boosts[w], step * damping, 0.0)
            turned = np.where(neg[w], changed * NEGATION, changed)
            if k > 1:
                between = range(-k + 1, 0)
                turned = np.where(named(-k, "without") & np.any([named(j, "doubt") for j in between], axis=0), changed, turned)
                turned = np.where(named(-k, "never") & np.any([named(j, "so", "this") for j in between], axis=0), changed * 1.25, turned)
            v = np.where(there & ~listed[w], turned, v)
        least = named(-1, "least") & ~listed[around(-1)[0]] & ~named(-2, "at", "very")
        v = np.where(least, v * NEGATION, v)
        turn = but[at_text]
        v = np.where((turn < 0) | (hits == turn), v, np.where(hits < turn, v * 0.5, v * 1.5))
        v[silent] = 0.0

        def total(keep: np.ndarray, shift: float = 0.0) -> np.ndarray:
            return many(at_text[keep], v[keep] + shift, len(n))

        count = lambda c: pc.count_substring(texts, c).to_numpy()
        marks, asked = np.minimum(count("!"), 4) * 0.292, count("?")
        more = marks + np.where(asked > 3, 0.96, np.where(asked > 1, asked * 0.18, 0.0))
        whole, pos, neg_ = total(v != 0), total(v > 0, 1.0), total(v < 0, -1.0)
        whole = whole + np.sign(whole) * more
        neu = n - many(at_text[v != 0], minlength=len(n))
        pos, neg_ = np.where(pos > -neg_, pos + more, pos), np.where(pos < -neg_, neg_ - more, neg_)
        all_ = np.where(n > 0, pos - neg_ + neu, 1.0)
        out = {"compound": whole / np.sqrt(whole * whole + ALPHA), "pos": pos / all_, "neg": -neg_ / all_, "neu": neu / all_}
        return {k: np.where(n > 0, c, 0.0) for k, c in out.items()}


def _pieces(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Runs of rows with about PIECE bytes of text."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(size):
        before = size[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(size, before + PIECE, "right")))
        yield at, end
        at = end


def _shares(rules: Rules, joined: bool):
    """An Arrow function of texts, and of each text's own entries of the lexicon if it is joined."""

    def run(texts: pa.Array, entries: pa.Array | None = None) -> pa.Array:
        done = []
        for a, e in _pieces(texts):
            own = None
            if joined:
                flat = entries.slice(a, e - a).flatten()
                own = dict(zip(flat.field("word").to_pylist(), flat.field("valence").to_pylist(), strict=True))
            done.append(rules(texts.slice(a, e - a), own))
        return pa.StructArray.from_arrays([pa.array(np.concatenate([d[c] for d in done]) if done else [], pa.float64()) for c in SHARES], names=list(SHARES))

    type_ = ", ".join(f"{c} double" for c in SHARES)
    if joined:

        @F.arrow_udf(type_)
        def shares(texts: pa.Array, entries: pa.Array) -> pa.Array:
            return run(texts, entries)
    else:

        @F.arrow_udf(type_)
        def shares(texts: pa.Array) -> pa.Array:
            return run(texts)

    return shares


def scored(df: DataFrame, key: str, text: str, lexicon: DataFrame, boosters: dict[str, float] | None = None, negations: list[str] | None = None) -> DataFrame:
    """df with compound, pos, neg and neu under a lexicon table (word, valence) of any size; key tells rows apart."""
    boosters, negations = BOOSTERS if boosters is None else boosters, NEGATIONS if negations is None else negations
    lexicon = lexicon.dropDuplicates(["word"]).where("word is not null and valence is not null").select("word", F.col("valence").cast("double").alias("valence"))
    known = lexicon.limit(LEXICON + 1).collect()
    if len(known) <= LEXICON:
        rows, given = df, (text,)
        shares = _shares(Rules({r["word"]: r["valence"] for r in known}, boosters, negations), False)
    else:
        words = df.select(F.col(key).alias("__key"), F.explode(F.array_distinct(F.transform(tokens(F.col(text)), F.lower))).alias("word"))
        met = words.join(lexicon, "word").distinct().groupBy("__key").agg(F.collect_list(F.struct("word", "valence")).alias("__lexicon"))
        rows, given = df.join(met, F.col(key).eqNullSafe(F.col("__key")), "left").drop("__key"), (text, "__lexicon")
        rows = rows.withColumn("__lexicon", F.coalesce("__lexicon", F.array().cast("array<struct<word:string,valence:double>>")))
        shares = _shares(Rules({}, boosters, negations), True)
    rows = rows.withColumn("__shares", shares(*given))
    return rows.withColumns({c: F.col(f"__shares.{c}") for c in SHARES}).drop("__shares", "__lexicon")
