"""Quality rules as a ledger of bits.

One pass reads each text and takes its measurements; every rule is a predicate over measurements,
evaluated once into one bit of ``failed``. What follows works on the ledger alone, without the texts:
versioned policies are masks of rules (``apply_policies``), what each rule of a policy costs comes from
one count by mask (``ablations``), groups are profiled by bitwise aggregates (``profile``), and rules
whose limits change are evaluated anew from the stored measurements (``reevaluated``).

Words are ``[^\\x20\\x09-\\x0D]+``; null and empty texts have none, so all their measurements are 0 and
only the rule of few words fails. Texts are read whole; a row's text takes about 150 bytes of memory a
word while it is measured. Rows are measured one by one, whether they repeat or not, and null keys stay;
an empty table gives an empty ledger. Of the input only the key, the text and columns asked for are
read, so that other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_marks", "n_letters", "n_capitals")


@dataclass(frozen=True)
class Rule:
    """A text fails if the SQL condition over measurements holds."""

    name: str
    bit: int
    fails: str


#: Bits are never given to another rule; a rule whose meaning changes gets a new bit.
RULES = (
    Rule("few_words", 0, "n_words < 50"),
    Rule("repeated_words", 1, "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", 2, "100 * n_symbols > 20 * n_words"),
    Rule("marks", 3, "100 * n_marks > 50 * n_words"),
    Rule("capitals", 4, "n_letters >= 100 and 100 * n_capitals > 50 * n_letters"),
    Rule("repeated_lines", 5, "100 * n_dup_lines > 50 * n_lines"),
    Rule("short_words", 6, "word_chars < 2 * n_words"),
    Rule("long_words", 7, "word_chars > 25 * n_words"),
)
BASE = ("few_words", "repeated_words")


@dataclass(frozen=True)
class Policy:
    """A text is kept if it fails at most ``allowed`` of the named rules."""

    version: str
    rules: tuple[str, ...]
    allowed: int = 0

    def mask(self, rules: Iterable[Rule] = RULES) -> int:
        bits = {r.name: r.bit for r in rules}
        return sum(1 << bits[name] for name in set(self.rules))


POLICIES = (
    Policy("base", BASE),
    Policy("v1", (*BASE, "symbols", "marks")),
    Policy("v2", tuple(r.name for r in RULES)),
)
CURRENT = POLICIES[-1]

_SPACES, _SYMBOLS, _MARKS = b" \t\n\v\f\r", b"#*$%&|<>", b"!?"
_CAPITALS = bytes(range(65, 91))
_LETTERS = _CAPITALS + bytes(range(97, 123))
_INNER = bytes(range(0x80, 0xC0))  # bytes of a code point after its first


def _count(text: bytes, chars: bytes) -> int:
    return len(text) - len(text.translate(None, chars))


def repeated_words(words: list[bytes]) -> int:
    """How many words lie in a window of three that stands twice or more in the list."""
    if len(words) < 4:
        return 0
    number: dict[bytes, int] = {}
    w = np.fromiter((number.setdefault(x, len(number)) for x in words), np.int64, len(words))
    pair = np.unique(w[:-1] * len(number) + w[1:], return_inverse=True)[1]  # numbers below len(words), so products fit
    _, at, n = np.unique(pair[:-1] * len(number) + w[2:], return_inverse=True, return_counts=True)
    again = n[at] > 1
    covered = np.zeros(len(w), bool)
    for k in range(3):
        covered[k : len(w) - 2 + k] |= again
    return int(covered.sum())


def measure(text: bytes) -> tuple[int, ...]:
    """The MEASURES of a text in UTF-8."""
    words = text.split()  # of bytes: at exactly the spaces meant
    lines = [x for x in text.split(b"\n") if x.strip()]
    return (len(words), len(text) - _count(text, _INNER) - _count(text, _SPACES), _count(text, _SYMBOLS), len(lines) - len(set(lines)), repeated_words(words), len(lines), _count(text, _MARKS), _count(text, _LETTERS), _count(text, _CAPITALS))


def measured(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The kept columns and the measurements of every row."""
    rows = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text).cast("string").alias("t"))
    schema = ", ".join([*(f"k{i} {rows.schema[f'k{i}'].dataType.simpleString()}" for i in range(len(keep))), *(f"{m} bigint" for m in MEASURES)])

    def run(batches):
        for b in batches:
            found = np.array([measure(s.as_buffer().to_pybytes()) if s.is_valid else (0,) * len(MEASURES) for s in b.column(len(keep))], np.int64).reshape(-1, len(MEASURES))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *(pa.array(np.ascontiguousarray(found[:, i])) for i in range(len(MEASURES)))], names=[*b.schema.names[: len(keep)], *MEASURES])

    return rows.mapInArrow(run, schema).withColumnsRenamed({f"k{i}": c for i, c in enumerate(keep)})


def failures(rules: Iterable[Rule] = RULES) -> Column:
    """The bits of the rules that the measurements fail."""
    bits = F.lit(0).cast("long")
    for r in rules:
        bits = bits.bitwiseOR(F.when(F.expr(r.fails), F.lit(1 << r.bit).cast("long")).otherwise(F.lit(0).cast("long")))
    return bits


def build_ledger(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", rules: Iterable[Rule] = RULES) -> DataFrame:
    """The kept columns, the measurements and ``failed``, a bit for each rule that the row fails."""
    return measured(docs, keep, text).withColumn("failed", failures(rules))


def reevaluated(ledger: DataFrame, rules: Iterable[Rule]) -> DataFrame:
    """The ledger with the bits of these rules evaluated anew from its measurements; other bits stay."""
    rules = tuple(rules)
    others = ~sum(1 << r.bit for r in rules)
    return ledger.withColumn("failed", F.col("failed").bitwiseAND(F.lit(others).cast("long")).bitwiseOR(failures(rules)))


def passes(policy: Policy, rules: Iterable[Rule] = RULES, failed: Column | None = None) -> Column:
    failed = F.col("failed") if failed is None else failed
    return F.bit_count(failed.bitwiseAND(F.lit(policy.mask(rules)).cast("long"))) <= policy.allowed


def apply_policies(ledger: DataFrame, policies: Iterable[Policy] = POLICIES, rules: Iterable[Rule] = RULES) -> DataFrame:
    """The ledger with ``kept_<version>`` for every policy."""
    return ledger.withColumns({f"kept_{p.version}": passes(p, rules) for p in policies})


def ablations(ledger: DataFrame, policies: Iterable[Policy] = POLICIES, rules: Iterable[Rule] = RULES) -> DataFrame:
    """For every rule of every policy: rows kept, rows kept without the rule, and rows that fail it.

    The ledger is counted once by ``failed``; there are no more masks than 2 to the number of rules, and
    all else is arithmetic on their counts.
    """
    bit = {r.name: 1 << r.bit for r in rules}
    cases = F.array(*[F.struct(F.lit(p.version).alias("version"), F.lit(name).alias("rule"), F.lit(p.mask(rules)).cast("long").alias("mask"), F.lit(bit[name]).cast("long").alias("bit"), F.lit(p.allowed).alias("allowed")) for p in policies for name in p.rules])
    masks = ledger.groupBy("failed").agg(F.count("*").alias("n"))
    each = masks.select("failed", "n", F.inline(cases))
    total = lambda condition: F.coalesce(F.sum(F.when(F.expr(condition), F.col("n"))), F.lit(0)).cast("long")
    return each.groupBy("version", "rule").agg(
        total("bit_count(failed & mask) <= allowed").alias("n_kept"),
        total("bit_count(failed & mask & ~bit) <= allowed").alias("n_kept_without"),
        total("failed & bit <> 0").alias("n_failed"),
    )


def profile(ledger: DataFrame, by: list[str], rules: Iterable[Rule] = RULES) -> DataFrame:
    """By group: rows, the rules that any row fails, those that all rows fail, and failures by rule."""
    counts = [F.count(F.when(F.col("failed").bitwiseAND(F.lit(1 << r.bit).cast("long")) != 0, 1)).alias(f"n_{r.name}") for r in rules]
    return ledger.groupBy(*by).agg(F.count("*").alias("n"), F.bit_or("failed").alias("any_failed"), F.bit_and("failed").alias("all_failed"), *counts)


def verdicts(ledger: DataFrame, policy: Policy = CURRENT) -> DataFrame:
    """The base measurements, whether the base rules fail, and whether the row is kept."""
    base = POLICIES[0]
    out = ledger.withColumn("base_failed", ~passes(base)).withColumn("kept", ~F.col("base_failed") & passes(policy))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed")
