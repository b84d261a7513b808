"""Text predicates and normal forms."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spellings of nothing (fixed values).
NULL_WORDS = ("null", "none", "nan")
#: Whole texts that are spam (fixed values).
URL_SHORTENERS = ("bit.ly", "tinyurl.com", "goo.gl", "t.co", "ow.ly", "is.gd", "buff.ly", "adf.ly", "t.me", "s.shopee.com")
SPAM_WORDS = (
    "click", "purchase", "order", "subscribe", "bonus", "offer", "sale", "discount", "cheap", "promo",
    "guarantee", "risk-free", "money-back", "refund", "prize", "cash", "reward", "gift", "voucher", "coupon",
    "best price", "act now", "don't miss", "apply now", "join now", "register", "membership", "click here",
)
MAX_HASHTAGS = 3
#: Moderation labels that hide a post (fixed values).
HIDDEN_LABELS = ("porn", "furry", "sexual", "nudity", "gore", "graphic-media")
_WHITE = r"[\s\p{Z}\x{1c}-\x{1f}\x{85}]"
_INVISIBLE = r"[\s\p{Z}\x{1c}-\x{1f}\x{85}\x{200b}\x{200c}\x{200d}\x{feff}\x{2800}]"
_LETTERS_OF_NOTHING = "".join(sorted(set("".join(NULL_WORDS))))
#: Characters whose compatible form is one of these letters (wide, bold, circled, raised ones), by Unicode's tables.
_COMPATIBLE = {chr(c): k for c in range(128, sys.maxunicode + 1) if (k := unicodedata.normalize("NFKC", chr(c)).lower()) in _LETTERS_OF_NOTHING and len(k) == 1}


def is_blank(c: Column) -> Column:
    """Null, only white space or invisible characters, or a spelling of nothing in compatible letters."""
    bare = F.lower(F.regexp_replace(F.translate(c, "".join(_COMPATIBLE), "".join(_COMPATIBLE.values())), rf"^{_WHITE}+|{_WHITE}+$", ""))
    return c.isNull() | (F.regexp_replace(c, f"{_INVISIBLE}+", "") == "") | bare.isin(*NULL_WORDS)


def is_valid(c: Column, least: int = 5) -> Column:
    """Text of at least five characters that does not spell nothing."""
    return c.isNotNull() & (F.length(F.trim(c)) >= least) & ~F.lower(F.trim(c)).isin(*NULL_WORDS)


def is_spam(c: Column) -> Column:
    """The whole text is a shortener or a spam word, or it has three hashtags."""
    return c.isin(*URL_SHORTENERS, *SPAM_WORDS) | (F.regexp_count(c, F.lit("#")) >= MAX_HASHTAGS)


def is_nsfw(text: Column, label: Column) -> Column:
    return F.coalesce(text.isin(*HIDDEN_LABELS), F.lit(False)) | F.coalesce(label.isin(*HIDDEN_LABELS), F.lit(False))


def holds_nsfw(text: Column, labels: Column, separator: str = ",") -> Column:
    """A label of the list is hidden, or the text has such a word somewhere."""
    words = F.array(*[F.lit(x) for x in HIDDEN_LABELS])
    return F.arrays_overlap(F.split(labels, separator), words) | F.exists(words, lambda w: F.contains(text, w))


def canonical(c: Column) -> Column:
    """Lower case with single spaces."""
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def document_id(c: Column) -> Column:
    return F.sha2(canonical(c), 256)


def hashtags(c: Column, exclude: tuple[str, ...] = (), canonical_forms: dict[str, str] | None = None) -> Column:
    """Words after '#' of the lower-cased text, as often as they come. Excluded strings are cut out of
    the text and variants replaced in it first, in the order given, wherever they stand."""
    c = F.lower(c)
    for gone in exclude:
        c = F.replace(c, F.lit(gone), F.lit(""))
    for variant, form in (canonical_forms or {}).items():
        c = F.replace(c, F.lit(variant), F.lit(form))
    return F.regexp_extract_all(c, F.lit(r"#([\p{L}\p{N}_]+)"), 1)


def normal_entity(c: Column, aliases: dict[str, str] | None = None) -> Column:
    bare = F.regexp_replace(F.lower(F.trim(c)), r"^[\p{Punct}]+|[\p{Punct}]+$", "")
    if not aliases:
        return bare
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair]), bare), bare)


def one_line(c: Column) -> Column:
    return F.trim(F.replace(c, F.lit("\n"), F.lit(" ")))


def topic_words(c: Column, stop_words: tuple[str, ...] = (), least: int = 3) -> Column:
    """Words without URLs, marks, stop words and words that are too short."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(c), r"https?://\S+|www\.\S+", " "), r"[^\p{L}\p{N}_\s]", " ")
    words = F.filter(F.split(F.trim(bare), r"\s+"), lambda w: F.length(w) >= least)
    return F.filter(words, lambda w: ~w.isin(*stop_words)) if stop_words else words


def last_part(c: Column, separator: str = "/") -> Column:
    return F.element_at(F.split(c, separator), -1)


def did_of(uri: Column) -> Column:
    """Author of a record's address at://<did>/<collection>/<key>."""
    return F.regexp_extract(uri, r"^at://([^/]+)/", 1)


def safe_name(c: Column) -> Column:
    return F.regexp_replace(c, r"[^A-Za-z0-9_-]+", "_")


def valence_label(compound: Column) -> Column:
    return F.when(compound >= 0.05, "positive").when(compound <= -0.05, "negative").otherwise("neutral")
