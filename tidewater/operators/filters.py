"""Filter chains and predicates built from parameters."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions import text as T


def preprocess(posts: DataFrame, bots: DataFrame | None = None, nsfw_authors: DataFrame | None = None, author: str = "author_did", body: str = "text", label: str = "labels", lang: str = "langs", languages: tuple[str, ...] = ("en", "eng_Latn")) -> DataFrame:
    """Valid posts in the languages, with flags, passed_filters, and filtered_by_func.

    The last flag that applies names the filter. Bots are named but do not fail the filters.
    Hate speech is never found. Author lists are one row an author.
    """
    df = posts.where(T.is_valid(F.col(body)) & F.col(lang).isin(*languages))

    def listed(df: DataFrame, other: DataFrame | None, alias: str) -> DataFrame:
        if other is None:
            return df.withColumn(alias, F.lit(False))
        return df.join(other.select(author).distinct().withColumn(alias, F.lit(True)), author, "left").withColumn(alias, F.coalesce(alias, F.lit(False)))

    df = listed(listed(df, bots, "author_is_bot"), nsfw_authors, "author_is_nsfw")
    df = df.withColumns({"is_nsfw": T.is_nsfw(F.col(body), F.col(label)), "is_spam": T.is_spam(F.col(body)), "is_hate": F.lit(False)})
    failed = F.col("is_nsfw") | F.col("author_is_nsfw") | F.col("is_spam") | F.col("is_hate")
    name = F.coalesce(*[F.when(F.col(c), n) for c, n in (("is_hate", "has_hate_speech"), ("is_spam", "has_spam"), ("author_is_nsfw", "author_is_nsfw"), ("is_nsfw", "is_nsfw"), ("author_is_bot", "author_is_bot"))])
    return df.withColumn("passed_filters", ~failed).withColumn("filtered_by_func", name)


def outcome_counts(filtered: DataFrame) -> DataFrame:
    flags = ("author_is_bot", "is_nsfw", "author_is_nsfw", "is_spam", "is_hate", "passed_filters")
    return filtered.agg(F.count("*").alias("n"), *[F.count_if(c).alias(f"n_{c}") for c in flags])


def dynamic(df: DataFrame, predicates: list[Column], limit: int | None = None, order: list[Column] | None = None) -> DataFrame:
    """All predicates hold; the first rows in the order, if there is a limit."""
    df = df.where(reduce(and_, predicates, F.lit(True)))
    return df.orderBy(*(order or [])).limit(limit) if limit is not None else df


def any_keyword(c: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(F.lower(c), F.lit(w.lower())) for w in words], F.lit(False)) if words else F.lit(True)


def tri_state(c: Column, wanted: bool | None, threshold: float = 0.5) -> Column:
    """At least the threshold, below it, or anything."""
    return F.lit(True) if wanted is None else (c >= threshold) if wanted else (c < threshold)


def any_of(c: Column, values: list[str]) -> Column:
    """The array c holds one of the values; anything for none."""
    return F.coalesce(F.arrays_overlap(c, F.array(*[F.lit(v) for v in values])), F.lit(False)) if values else F.lit(True)


def one_of(c: Column, values: list[str]) -> Column:
    return F.coalesce(c.isin(*values), F.lit(False)) if values else F.lit(True)


#: What a choice asks of a flag (fixed values).
CHOICES = {"Toxic": True, "Not Toxic": False, "Uncertain": None, "Yes": True, "No": False}


def flag_is(c: Column, choice: str | None) -> Column:
    """The flag is as chosen: true, false, or unknown; anything for no choice."""
    return F.lit(True) if not choice else c.eqNullSafe(F.lit(CHOICES[choice]))


def chosen(filters: dict[str, dict], columns: dict[str, Column]) -> tuple[list[Column], int]:
    """Predicates of a nested set of filters, and how many rows it wants at most.

    columns: text, hashtags (array), date (string), user, valence, toxic and political (booleans), slant.
    """
    get = lambda group, name: filters.get(group, {}).get(name)
    out = [any_keyword(columns["text"], get("Content", "keywords") or []), any_of(columns["hashtags"], get("Content", "hashtags") or []), one_of(columns["user"], get("User", "handles") or [])]
    if days := get("Temporal", "date_range"):
        ends = [d.strip() for d in days.split("to")]
        out.append(columns["date"].between(ends[0], ends[-1]))
    for group, name in (("Sentiment", "valence"), ("Political", "slant")):
        if wanted := get(group, name):
            out.append(F.coalesce(columns[name] == wanted, F.lit(False)))
    out += [flag_is(columns["toxic"], get("Sentiment", "toxicity")), flag_is(columns["political"], get("Political", "political"))]
    most = get("General", "max_results")
    return out, 1000 if most is None else most


#: Names of conditions as shown (fixed values).
CONDITION_NAMES = {"reverse_chronological": "Reverse Chronological", "representative_diversification": "Diversified Extremity", "engagement": "Engagement-Based"}


def recode_conditions(c: Column, names: dict[str, str] = CONDITION_NAMES) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), c), c)


def with_study_time(df: DataFrame, day: str, cutoff: str) -> DataFrame:
    """df with study_day (days since the first), day_centered (since the middle), is_post and period."""
    ends = df.agg(F.min(day).alias("__a"), F.max(day).alias("__e"))
    d = df.crossJoin(F.broadcast(ends)).withColumn("study_day", F.datediff(day, "__a"))
    after = F.col(day) > F.lit(cutoff).cast("date")
    return d.withColumns({"day_centered": F.col("study_day") - F.datediff("__e", "__a") / 2, "is_post": after.cast("int"), "period": F.when(after, "Post").otherwise("Pre")}).drop("__a", "__e")


def in_study(day: Column, start: str, end: str, exclude: tuple[str, ...] = ()) -> Column:
    inside = day.between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    return inside & ~day.isin([F.lit(x).cast("date") for x in exclude]) if exclude else inside
