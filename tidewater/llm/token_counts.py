"""Edit-aware token counts.

A document's text is cut into leaves of LEAF_CHARS characters or somewhat more, only at places
where the tokenizer's pre-token pattern cuts whatever stands around: before white space, and where
letters, digits and marks meet (see ``_SAFE``), so that texts without spaces are cut as well. So a
document's count is the sum of its leaves' counts. A segment tree over the leaves keeps sums of
characters and tokens. Edits find their leaves by descending the tree; only the leaves they touch,
with those whose boundary context they touch, are encoded again, and the sums above them are
updated. A leaf that grows too long is cut again. The edited text and tree are returned, so that
further edits can follow. A run of letters (or digits, or marks) alone is one pre-token, which no
cut may part: such a run is one leaf, however long.

Null texts count as empty and have 0 tokens; with edits they become the inserted text, without
they stay null. Edits are (start, end, replacement) in code points of the text before any of them;
those that overlap or lie outside the text raise a ValueError. Rows are handled one by one, so
that repeated rows and null ids need no care, and empty tables stay empty.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm import packing, pii

LEAF_CHARS = 256
_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏЀ-ҁぁ-ゖァ-ヺ一-鿿가-힣"
_MARKS = r"!-&(-/:-@\[-`{-~、。「」！，：；？"  # no apostrophe, which may begin a contraction
#: Places between two pre-tokens, by the characters on both sides alone.
_SAFE = re.compile(f"(?<=[{_LETTERS}0-9'{_MARKS}])(?=[ \t\n\r])|(?<=[{_LETTERS}])(?=[0-9'{_MARKS}])|(?<=[0-9])(?=[{_LETTERS}'{_MARKS}])|(?<=[{_MARKS}])(?=[{_LETTERS}0-9])")
#: The one string that the tokenizer takes whole; no leaf ends within it.
_WHOLE = "<|endoftext|>"
CONTEXT = len(_WHOLE)


def leaf_starts(text: str, size: int = LEAF_CHARS) -> list[int]:
    starts, at = [0], size
    while m := _SAFE.search(text, at):
        at = m.start()
        if text.find(_WHOLE, max(0, at - CONTEXT + 1), at + CONTEXT - 1) >= 0:  # around this place
            at += 1
        else:
            starts.append(at)
            at += size
    return starts


def checked(edits: list[tuple[int, int, str]], n: int) -> list[tuple[int, int, str]]:
    """The edits in order."""
    edits = sorted(edits, key=lambda e: e[:2])
    at = 0
    for start, end, _ in edits:
        if not at <= start <= end <= n:
            raise ValueError("edits overlap or lie outside the text")
        at = end
    return edits


class TokenTree:
    """Segment tree of characters and tokens: node 1 is the root, leaves fill the second half."""

    def __init__(self, chars: np.ndarray, tokens: np.ndarray):
        self.chars, self.tokens = chars, tokens
        self.size = len(chars) // 2

    @classmethod
    def of(cls, text: str, count) -> TokenTree:
        starts = leaf_starts(text)
        return cls.over([(e - a, count(text[a:e]) if e > a else 0) for a, e in zip(starts, [*starts[1:], len(text)], strict=True)])

    @classmethod
    def over(cls, leaves: list[tuple[int, int]]) -> TokenTree:
        """The tree of leaves (characters, tokens)."""
        size = 1 << (len(leaves) - 1).bit_length()
        sums = np.zeros((2, 2 * size), np.int32)
        sums[:, size : size + len(leaves)] = np.array(leaves).T
        level = size
        while level > 1:
            sums[:, level // 2 : level] = sums[:, level : 2 * level].reshape(2, -1, 2).sum(axis=2)
            level //= 2
        return cls(*sums)

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds character at (the last one, if beyond), and its start."""
        k, start = 1, 0
        at = max(0, min(at, int(self.chars[1]) - 1))
        while k < self.size:
            k *= 2
            if at - start >= self.chars[k]:
                start += int(self.chars[k])
                k += 1
        return k - self.size, start

    def put(self, leaf: int, chars: int, tokens: int) -> None:
        k = self.size + leaf
        dc, dt = chars - self.chars[k], tokens - self.tokens[k]
        while k:
            self.chars[k] += dc
            self.tokens[k] += dt
            k //= 2

    def edit(self, text: str, edits: list[tuple[int, int, str]], count) -> tuple[str, int]:
        """Apply edits to the tree; the new text, and the characters that were encoded again."""
        parts: list[list] = []  # first leaf, its start, last leaf, its end, edits
        for start, end, new in checked(edits, len(text)):
            (i, a), (j, b) = self.find(start - CONTEXT), self.find(end + CONTEXT)
            e = b + int(self.chars[self.size + j])
            if parts and i <= parts[-1][2]:
                parts[-1][2:4] = max(j, parts[-1][2]), max(e, parts[-1][3])
                parts[-1][4].append((start, end, new))
            else:
                parts.append([i, a, j, e, [(start, end, new)]])
        out, at, again, grown = [], 0, 0, {}
        for i, a, j, e, own in parts:
            piece, p = [], a
            for start, end, new in own:
                piece += [text[p:start], new]
                p = end
            new_text = "".join(piece) + text[p:e]
            again += len(new_text)
            starts = leaf_starts(new_text) if len(new_text) > 8 * LEAF_CHARS else [0]
            leaves = [(y - x, count(new_text[x:y]) if y > x else 0) for x, y in zip(starts, [*starts[1:], len(new_text)], strict=True)]
            for k, leaf in zip(range(i, j + 1), [*leaves, *[(0, 0)] * (j - i)], strict=False):
                self.put(k, *leaf)
            if len(leaves) > j - i + 1:
                grown[j] = leaves[j - i + 1 :]
            out += [text[at:a], new_text]
            at = e
        if grown:
            leaves = [x for k in range(self.size) for x in [(int(self.chars[self.size + k]), int(self.tokens[self.size + k])), *grown.get(k, [])]]
            new = TokenTree.over([x for x in leaves if x[0]] or [(0, 0)])
            self.chars, self.tokens, self.size = new.chars, new.tokens, new.size
        return "".join(out) + text[at:], again


def build_index(docs: DataFrame, text: str = "text", json_path: str | None = None, ranks_path: str | None = None) -> DataFrame:
    """docs with __chars and __tokens, the trees of every text."""
    known = packing.default_paths()
    paths = json_path or known[0], ranks_path or known[1]
    at = docs.columns.index(text)

    def count(t):
        return len(packing.token_ids(t, *paths))

    def index(batches):
        for b in batches:
            trees = [TokenTree.of(t.as_py() or "", count) for t in b.column(at)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([t.chars for t in trees], pa.list_(pa.int32())), pa.array([t.tokens for t in trees], pa.list_(pa.int32()))], [*b.schema.names, "__chars", "__tokens"])

    schema = docs.withColumns({"__chars": F.lit(None).cast("array<int>"), "__tokens": F.lit(None).cast("array<int>")}).schema
    return docs.mapInArrow(index, schema)


def redactions(docs: DataFrame, text: str = "text", replacement: str = "[REDACTED]") -> DataFrame:
    """docs with __edits: every span of personal data found by pattern, to be replaced."""
    at = docs.columns.index(text)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("new", pa.string())]))

    def find(batches):
        for b in batches:
            edits = []
            for t in b.column(at):
                own, end = [], 0
                for a, e in sorted((a, e) for _, a, e in pii.base_spans(t.as_py() or "")):
                    if a >= end:
                        own.append({"start": a, "end": e, "new": replacement})
                        end = e
                edits.append(own)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(edits, kind)], [*b.schema.names, "__edits"])

    schema = docs.withColumn("__edits", F.lit(None).cast("array<struct<start:int,end:int,new:string>>")).schema
    return docs.mapInArrow(find, schema)


def apply_edits(indexed: DataFrame, text: str = "text", json_path: str | None = None, ranks_path: str | None = None) -> DataFrame:
    """indexed after its __edits, which go: text and trees as they then are, with __tokens_before,
    __n_edits, __chars_before and __chars_reencoded. The result takes new __edits."""
    known = packing.default_paths()
    paths = json_path or known[0], ranks_path or known[1]
    places = [indexed.columns.index(c) for c in (text, "__chars", "__tokens", "__edits")]
    figures = ("__tokens_before", "__n_edits", "__chars_before", "__chars_reencoded")
    kept = [c for c in indexed.columns if c != "__edits" and c not in figures]

    def count(t):
        return len(packing.token_ids(t, *paths))

    def edit(batches):
        for b in batches:
            rows = []
            for t, chars, tokens, edits in zip(*(b.column(i) for i in places), strict=True):
                t, own = t.as_py(), edits.as_py() or []
                tree = TokenTree(*(np.array(x.values.to_numpy(zero_copy_only=False)) for x in (chars, tokens)))
                before = int(tree.tokens[1]), len(own), int(tree.chars[1])
                again = 0
                if own:
                    t, again = tree.edit(t or "", [(e["start"], e["end"], e["new"] or "") for e in own], count)
                rows.append((t, tree.chars, tree.tokens, *before, again))
            made = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 7, [pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), *[pa.int64()] * 4], strict=True)]
            own = dict(zip((text, "__chars", "__tokens"), made, strict=False))
            yield pa.RecordBatch.from_arrays([own.get(c, b.column(b.schema.get_field_index(c))) for c in kept] + made[3:], [*kept, *figures])

    schema = indexed.select(kept).withColumns({c: F.lit(None).cast("long") for c in figures}).schema
    return indexed.mapInArrow(edit, schema)


def counts(edited: DataFrame, key: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, n_edits, n_tokens_edited, n_chars, n_chars_reencoded of edited rows."""
    return edited.select(F.col(key).cast("long").alias("doc_id"), F.col("__tokens_before").alias("n_tokens"), F.col("__n_edits").alias("n_edits"), F.get("__tokens", F.lit(1)).cast("long").alias("n_tokens_edited"), F.col("__chars_before").alias("n_chars"), F.col("__chars_reencoded").alias("n_chars_reencoded"))
