"""How the sources of a language differ in what words they use: mergeable radix tries of term counts.

Each task counts the terms of its documents into byte tries, one a language, whose leaves carry a
counter for each source. Tries are handed on leaf by leaf in byte order and merged by prefix range:
a range partitioning of (language, term) brings equal leaves of all tasks together, sums them, and keeps
the terms that stand in at least ``MIN_DOCUMENTS`` documents of the language. One traversal of each range
in UTF-8 order then adds up the divergence of every pair of sources and holds each group's ten best
candidates; since terms come in order, the earlier of two equal values is the one to keep. What the
ranges give is summed, ranked, and cut to ``TOP`` candidates.

Scale. Tries are handed on and emptied at ``TRIE_COUNTERS`` counters, so memory does not grow with the
vocabulary; a language that holds most of the rows has its terms in many ranges. Pairs are added up in
arrays for about ``SOURCES`` sources at a time: a range goes once to each pair of blocks of a language's
sources (one pair, unless there are more), with the totals of those sources as the row that comes first
in it. Nothing is broadcast or collected. Arithmetic is exact in 64-bit integers for up to 10**14 counted
words a group.

Defined cases. Null text, lang and source are ''. A group without terms has count 0 for every kept term;
a language without kept terms gives pairs of value 0 and no candidates; a language of one source gives
no pairs; an empty table gives no rows. A row counts as one document, whether rows or doc_ids repeat or
not. Long texts are counted whole, a slice at a time; the distinct terms of one text are held together.
Further columns, of whatever names, are not read.
"""

from __future__ import annotations

import gc
import re
from collections import Counter
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm import common as C

MIN_DOCUMENTS, TOP, SMOOTH, SCALE = 10, 10, 2, 1_000_000_000
#: Counters that a task's tries hold before they are handed on, and counts before they go into the tries.
TRIE_COUNTERS, COUNTS = 1_000_000, 400_000
#: Sources of a language whose pairs are added up together, and terms taken at a time.
SOURCES, TERMS = 512, 1024
_TERM = re.compile(rb"[a-z\x80-\xff]+").findall
_TEXT_SLICE = 1 << 20


class Node:
    __slots__ = ("label", "children", "leaf")

    def __init__(self, label: bytes, leaf: list | None) -> None:
        self.label, self.leaf = label, leaf
        self.children: dict[int, Node] | None = None


class RadixTrie:
    """Byte strings with a leaf each: documents, and occurrences by source."""

    def __init__(self) -> None:
        self.root = Node(b"", None)
        self.size = 0

    def add(self, term: bytes, docs: int, counts: dict[int, int]) -> None:
        """Adds to the term's leaf; counts become its own if it is new."""
        node, at, end = self.root, 0, len(term)
        while at < end:
            children = node.children
            if children is None:
                children = node.children = {}
            child = children.get(term[at])
            if child is None:
                children[term[at]] = Node(term[at:], [docs, counts])
                self.size += len(counts)
                return
            label = child.label
            if not term.startswith(label, at):
                k, most = 1, min(len(label), end - at)
                while k < most and label[k] == term[at + k]:
                    k += 1
                upper = Node(label[:k], None)
                upper.children = {label[k]: child}
                child.label = label[k:]
                children[term[at]] = child = upper
                label = upper.label
            node, at = child, at + len(label)
        if node.leaf is None:
            node.leaf = [docs, counts]
            self.size += len(counts)
            return
        own = node.leaf[1]
        node.leaf[0] += docs
        self.size -= len(own)
        for source, n in counts.items():
            own[source] = own.get(source, 0) + n
        self.size += len(own)

    def merge(self, other: RadixTrie) -> None:
        for term, (docs, counts) in other.leaves():
            self.add(term, docs, dict(counts))

    def leaves(self):
        """(term, [documents, counts by source]) in byte order."""
        stack = [(self.root, b"")]
        while stack:
            node, before = stack.pop()
            term = before + node.label
            if node.leaf is not None:
                yield term, node.leaf
            below = node.children
            if below:
                stack += [(below[k], term) for k in (sorted(below, reverse=True) if len(below) > 1 else below)]


def terms_of(text: bytes) -> list[bytes]:
    """Terms in order: runs of letters A-Z, made small, and of all beyond ASCII."""
    return _TERM(text.lower())


class Counts:
    """Term counts of one task: counters by group, then tries by language."""

    def __init__(self) -> None:
        self.names: dict[str, int] = {}
        self.groups: dict[tuple[str, int], Counter] = {}
        self.docs: dict[str, Counter] = {}
        self.seen: set[tuple[str, int]] = set()
        self.tries: dict[str, RadixTrie] = {}

    def document(self, lang: str, source: str, text: bytes) -> None:
        group = (lang, self.names.setdefault(source, len(self.names)))
        if group not in self.groups:
            self.seen.add(group)
            self.groups[group] = Counter()
        n, docs = self.groups[group], self.docs.setdefault(lang, Counter())
        if len(text) <= _TEXT_SLICE:
            found = terms_of(text)
            n.update(found)
            docs.update(set(found))
            return
        own, at = Counter(), 0
        while at < len(text):
            end = min(len(text), at + _TEXT_SLICE)
            while end < len(text) and (text[end] >= 0x80 or bytes((text[end],)).isalpha()):
                end += 1
            own.update(terms_of(text[at:end]))
            at = end
        n.update(own)
        docs.update(own.keys())

    def into_tries(self) -> None:
        """What was counted goes into the tries, each term of a language once, whatever the number of its sources."""
        together: dict[str, dict[bytes, dict[int, int]]] = {}
        for (lang, source), n in self.groups.items():
            terms = together.setdefault(lang, {})
            for term, k in n.items():
                if term in terms:
                    terms[term][source] = k
                else:
                    terms[term] = {source: k}
        self.groups.clear()
        for lang, terms in together.items():
            trie, docs = self.tries.setdefault(lang, RadixTrie()), self.docs[lang]
            for term, counts in terms.items():
                trie.add(term, docs[term], counts)
        self.docs.clear()

    def waiting(self) -> int:
        return sum(map(len, self.groups.values()))

    def held(self) -> int:
        return sum(t.size for t in self.tries.values())

    def hand_on(self, rows: int = 50_000):
        """The leaves in byte order as record batches; then the tries are empty."""
        for lang in sorted(self.tries):
            found = self.tries[lang].leaves()
            while part := list(islice(found, rows)):
                yield self.batch(lang, part)
        self.tries.clear()

    def marks(self):
        """A leaf without a term for every group, since groups without terms count too."""
        for lang, source in sorted(self.seen):
            yield self.batch(lang, [(b"", [0, {source: 0}])])

    def batch(self, lang: str, leaves: list[tuple[bytes, list]]) -> pa.RecordBatch:
        counts = [own for _, (_, own) in leaves]
        sources = np.fromiter(chain.from_iterable(counts), np.int32)
        n = np.fromiter(chain.from_iterable(own.values() for own in counts), np.int64)
        ends = np.cumsum([0, *map(len, counts)], dtype=np.int32)
        pairs = pa.StructArray.from_arrays([pa.array(list(self.names), pa.string()).take(pa.array(sources)), pa.array(n)], ["source", "n"])
        langs = pa.array([lang], pa.string()).take(pa.array(np.zeros(len(leaves), np.int32)))
        return pa.RecordBatch.from_arrays([langs, pa.array([t for t, _ in leaves], pa.binary()), pa.array([d for _, (d, _) in leaves], pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pairs)], names=["lang", "term", "docs", "counts"])


_LEAF = "lang string, term binary, docs bigint, counts array<struct<source: string, n: bigint>>"


def count_terms(docs: DataFrame) -> DataFrame:
    """Leaves of the tasks' tries: lang, term, documents and counts by source; leaves of term '' name the groups."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = docs.select(blank("lang"), blank("source"), blank("text"))

    def counted(batches):
        counts, waiting = Counts(), 0
        for b in batches:
            for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                text = text.as_buffer().to_pybytes()
                counts.document(lang, source, text)
                waiting += len(text)
                if waiting > 4 * COUNTS:  # bytes: there are at least as many as counts
                    waiting = 0
                    if counts.waiting() > COUNTS:
                        counts.into_tries()
                        if counts.held() > TRIE_COUNTERS:
                            yield from counts.hand_on()
        counts.into_tries()
        yield from counts.hand_on()
        yield from counts.marks()

    def run(batches):
        gc.disable()  # nodes are many and never in a cycle; looking for cycles would take a third of the time
        try:
            yield from counted(batches)
        finally:
            gc.enable()

    return rows.mapInArrow(run, _LEAF)


def merged(leaves: DataFrame) -> DataFrame:
    """Kept terms: lang, term, the language's total, counts by source, and the number of the range.

    The range partitioning by (lang, term) serves the windows and sums too: there is one shuffle. Leaves
    of rare terms go before the others are taken apart.
    """
    ranged = leaves.where("term <> X''").repartitionByRange("lang", "term")
    docs = F.sum("docs").over(Window.partitionBy("lang", "term"))
    common = ranged.withColumn("docs", docs).where(F.col("docs") >= MIN_DOCUMENTS)
    by_source = common.select("lang", "term", F.inline("counts")).groupBy("lang", "term", "source").agg(F.sum("n").alias("n"))
    whole = by_source.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("counts"))
    return whole.withColumn("range", F.spark_partition_id())


def shares(n: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """1 + floor(SCALE * (n + SMOOTH) / total), exactly: the scale is divided in two steps, so that nothing overflows."""
    a = (n + SMOOTH) * 31_250
    return 1 + a // total * 32_000 + a % total * 32_000 // total


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


class Traversal:
    """One range of one language and pair of source blocks: its terms in UTF-8 order, added up as they come.

    ``sources`` and ``n`` are those of both blocks, the first ``split`` of the first block (all, where a
    block meets itself); ``words`` and ``kept`` are the language's, ``there`` counts the range's kept terms.
    """

    def __init__(self, lang: str, alone: bool, sources: list[str], n: list[int], split: int, words: int, kept: int, there: int) -> None:
        self.lang, self.alone, self.names = lang, alone, sources
        self.at = {s: k for k, s in enumerate(sources)}
        self.rows = np.arange(split)
        self.columns = self.rows if alone else np.arange(split, len(sources))
        self.all, self.whole = np.array(n, np.int64) + SMOOTH * kept, words + SMOOTH * kept
        self.unseen = there
        self.pairs = np.zeros((len(self.rows), len(self.columns)), np.int64)
        self.best: list[list[tuple[int, bytes]]] = [[] for _ in self.rows]

    def leaves(self, terms: list[bytes], totals: np.ndarray, ends: np.ndarray, sources: np.ndarray, n: np.ndarray) -> None:
        """Terms in order; those of place i have the sources (by number) and counts from ends[i] to ends[i + 1]."""
        for a in range(0, len(terms), TERMS):
            part = slice(ends[a], ends[min(a + TERMS, len(terms))])
            of = np.repeat(np.arange(len(terms[a : a + TERMS])), np.diff(ends[a : a + TERMS + 1]))
            self.add_up(terms[a : a + TERMS], totals[a : a + TERMS], of, sources[part], n[part])

    def add_up(self, terms: list[bytes], totals: np.ndarray, of: np.ndarray, sources: np.ndarray, n: np.ndarray) -> None:
        counts = np.zeros((len(terms), len(self.names)), np.int64)
        counts[of, sources] = n
        p = shares(counts, self.all)
        right = p[:, self.columns]
        for i, g in enumerate(self.rows):
            self.pairs[i] += divergence(p[:, g : g + 1], right).sum(axis=0)
        if self.alone:
            q = shares(totals, self.whole)
            for i, g in enumerate(self.rows):
                ok = np.flatnonzero((counts[:, g] > 0) & (p[:, g] > q))
                f = divergence(p[ok, g], q[ok])
                top = np.argsort(-f, kind="stable")[:TOP]  # terms are in order, so equal values stay so
                self.best[i] = sorted(self.best[i] + [(-int(f[k]), terms[ok[k]]) for k in top])[:TOP]
        self.unseen -= len(terms)

    def results(self):
        """(lang, source, part, item, value): each pair both ways, and candidates."""
        if self.unseen:  # kept terms of this range that no source of these blocks has
            none = shares(np.zeros(len(self.names), np.int64), self.all)
            self.pairs += self.unseen * divergence(none[self.rows, None], none[None, self.columns])
        for i, g in enumerate(self.rows):
            for j, h in enumerate(self.columns):
                if g != h:
                    value = int(self.pairs[i, j])
                    yield self.lang, self.names[g], "pair", self.names[h].encode(), value
                    if not self.alone:
                        yield self.lang, self.names[h], "pair", self.names[g].encode(), value
            for value, term in self.best[i]:
                yield self.lang, self.names[g], "term", term, -value


_RESULT = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.binary()), ("value", pa.int64())])


def _batches(found, size: int = 50_000):
    rows = []
    for r in found:
        rows.append(r)
        if len(rows) == size:
            yield _batch(rows)
            rows = []
    if rows:
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _RESULT, strict=True)], schema=_RESULT)


def _leaves_of(now: Traversal, terms: pa.Array, totals: np.ndarray, ends: np.ndarray, names: list[str], codes: np.ndarray, n: np.ndarray, a: int, e: int) -> None:
    """Gives rows a to e of a batch to the traversal."""
    if a < e:
        number = np.array([now.at.get(x, -1) for x in names])
        part = slice(ends[a], ends[e])
        now.leaves(terms.slice(a, e - a).to_pylist(), totals[a:e], ends[a : e + 1] - ends[a], number[codes[part]], n[part])


def traversed(kept: DataFrame, groups: DataFrame, block: int = SOURCES) -> DataFrame:
    """What each range gives: lang, source, part, item and value, to be summed for pairs and ranked for terms.

    ``groups`` has every (lang, source) with its words n, and the language's words and kept terms.
    """
    langs = groups.groupBy("lang").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"), F.max("words").alias("words"), F.max("kept").alias("kept"))
    of = lambda source: F.pmod(F.xxhash64(source), F.col("blocks")).cast("int")
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    # of each source, every pair of blocks with its own; of each term, every pair of blocks
    own = groups.select("lang", "source", "n").join(langs, "lang").withColumn("own", of(F.col("source")))
    own = own.withColumn("b", F.explode(every)).select("lang", "words", "kept", F.least("b", "own").alias("i"), F.greatest("b", "own").alias("j"), F.struct((F.col("own") != F.least("b", "own")).alias("second"), "source", "n").alias("s"))
    both = own.groupBy("lang", "i", "j", "words", "kept").agg(F.sort_array(F.collect_list("s")).alias("s"))
    there = langs.select("lang").join(kept.groupBy("lang", "range").agg(F.count("*").alias("there")), "lang", "left").na.fill({"range": -1, "there": 0})
    pair = lambda x: F.struct(x["source"].alias("source"), x["n"].alias("n"))
    heads = both.join(there, "lang").select("lang", "i", "j", "range", F.lit(None).cast("binary").alias("term"), F.col("words").alias("total"), F.transform("s", pair).alias("counts"), "kept", "there", F.size(F.filter("s", lambda x: ~x["second"])).alias("split"))
    cases = F.flatten(F.transform(every, lambda i: F.transform(F.filter(every, lambda j: j >= i), lambda j: F.struct(i.alias("i"), j.alias("j")))))
    leaves = kept.join(langs.select("lang", "blocks"), "lang").withColumn("b", F.explode(cases))
    mine = F.when(F.col("blocks") == 1, F.col("counts")).otherwise(F.filter("counts", lambda x: of(x["source"]).isin(F.col("b.i"), F.col("b.j"))))
    zero = F.lit(0).cast("long")
    leaves = leaves.select("lang", "b.i", "b.j", "range", "term", "total", mine.alias("counts"), zero.alias("kept"), zero.alias("there"), F.lit(0).alias("split")).where("size(counts) > 0")
    keys = ["lang", "i", "j", "range"]
    stream = heads.union(leaves).repartition(*keys).sortWithinPartitions(*keys, "term")

    def run(batches):
        now = None
        for b in batches:
            terms, counts = b.column(4), b.column(6)
            flat = counts.flatten()
            ends = np.concatenate([[0], np.cumsum(counts.value_lengths().to_numpy(zero_copy_only=False))])
            named, n = flat.field(0).dictionary_encode(), flat.field(1).to_numpy()
            names, codes = named.dictionary.to_pylist(), named.indices.to_numpy()
            totals = b.column(5).to_numpy()
            heads = [*np.flatnonzero(terms.is_null().to_numpy(zero_copy_only=False)), len(terms)]
            if now is not None and heads[0]:
                _leaves_of(now, terms, totals, ends, names, codes, n, 0, heads[0])
            for at, end in zip(heads[:-1], heads[1:], strict=True):
                if now is not None:
                    yield from _batches(now.results())
                lang, i, j, _, _, words, own, kept_terms, there, split = (b.column(c)[int(at)].as_py() for c in range(10))
                now = Traversal(lang, i == j, [c["source"] for c in own], [c["n"] for c in own], split, words, kept_terms, there)
                _leaves_of(now, terms, totals, ends, names, codes, n, at + 1, end)
        if now is not None:
            yield from _batches(now.results())

    return stream.mapInArrow(run, "lang string, source string, part string, item binary, value bigint")


def audit(docs: DataFrame, block: int = SOURCES) -> DataFrame:
    """lang, source, part, item, value and rank of every pair of sources and of each source's own terms."""
    leaves = C.materialize(count_terms(docs), "leaves")
    kept = C.materialize(merged(leaves), "terms")
    by_group = kept.select("lang", F.inline("counts")).groupBy("lang", "source").agg(F.sum("n").alias("n"))
    by_lang = kept.groupBy("lang").agg(F.sum("total").alias("words"), F.count("*").alias("kept"))
    marks = leaves.where("term = X''").select("lang", F.inline("counts")).select("lang", "source").distinct()
    groups = marks.join(by_group, ["lang", "source"], "left").join(by_lang, "lang", "left")
    groups = C.materialize(groups.na.fill(0, ["n", "words", "kept"]), "groups")
    found = C.materialize(traversed(kept, groups, block), "divergence")
    pairs = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order))
    out = ranked(pairs).union(ranked(found.where("part = 'term'")).where(F.col("rank") <= TOP))
    return out.select("lang", "source", "part", F.col("item").cast("string").alias("item"), "value", "rank")
