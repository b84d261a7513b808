"""Timestamps as the pipeline writes them: strings at rest, parsed where they are computed with.

The session time zone should be UTC.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PIPELINE_FORMAT = "yyyy-MM-dd-HH:mm:ss"
ISO_FORMAT = "yyyy-MM-dd'T'HH:mm:ss"
#: Accepted spellings, tried in this order (fixed values).
ACCEPTED_FORMATS = (
    ISO_FORMAT,
    PIPELINE_FORMAT,
    "yyyy-MM-dd'T'HH:mm:ss.[SSSSSSSSS][SSSSSSSS][SSSSSSS][SSSSSS][SSSSS][SSSS][SSS][SS][S]'Z'",
    "yyyy-MM-dd'T'HH:mm:ss'Z'",
    "yyyy-MM-dd'T'HH:mm:ss.[SSSSSSSSS][SSSSSSSS][SSSSSSS][SSSSSS][SSSSS][SSSS][SSS][SS][S]XXX",
    "yyyy-MM-dd'T'HH:mm:ssXXX",
    "yyyy-MM-dd'T'HH:mm:ss.[SSSSSSSSS][SSSSSSSS][SSSSSSS][SSSSSS][SSSSS][SSSS][SSS][SS][S]",
)
DEFAULT_PARTITION_DATE = "2016-01-01"
FIRST_PLAUSIBLE_YEAR = 2024


def parse(c: Column, formats: tuple[str, ...] = ACCEPTED_FORMATS) -> Column:
    """The first spelling that fits; null if none does."""
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in formats])


def to_pipeline(c: Column) -> Column:
    return F.date_format(parse(fix_midnight(c)), PIPELINE_FORMAT)


def to_pipeline_checked(c: Column) -> Column:
    """As ``to_pipeline``, but a spelling that is not null and fits no format fails the job."""
    wrong = F.raise_error(F.concat(F.lit("not a timestamp: "), c)).cast("string")
    return F.when(c.isNotNull(), F.coalesce(to_pipeline(c), wrong))


def first_19(c: Column) -> Column:
    """Date and time to the second, of spellings that begin with them."""
    return F.substring(c, 1, 19)


def cutoff(now: Column, amount: int, period: str = "days") -> Column:
    """The pipeline timestamp so many days or hours ago."""
    if amount <= 0 or period not in ("days", "hours"):
        raise ValueError("a cutoff needs a positive number of days or hours")
    return F.date_format(now - F.make_interval(**{period: F.lit(amount)}), PIPELINE_FORMAT)


def to_iso(c: Column) -> Column:
    return F.date_format(F.try_to_timestamp(c, F.lit(PIPELINE_FORMAT)), ISO_FORMAT)


def fix_midnight(c: Column) -> Column:
    """T24: becomes T00: of the same day."""
    return F.regexp_replace(c, "T24:", "T00:")


def truncate(c: Column) -> Column:
    """Up to the first of '.', '+' and 'Z'."""
    return F.regexp_extract(c, "^[^.+Z]*", 0)


def partition_date(c: Column, formats: tuple[str, ...] = ACCEPTED_FORMATS) -> Column:
    """Date of a timestamp string; unparsable or implausibly early ones go to the default date."""
    t = parse(truncate(c), formats)
    return F.when(F.year(t) >= FIRST_PLAUSIBLE_YEAR, F.date_format(t, "yyyy-MM-dd")).otherwise(F.lit(DEFAULT_PARTITION_DATE))


def lookback(now: Column, days: int, fmt: str = PIPELINE_FORMAT) -> Column:
    if days <= 0:
        raise ValueError("days must be positive")
    return F.date_format(now - F.make_interval(days=F.lit(days)), fmt)


def lookback_range(day: Column, days: int, earliest: Column) -> tuple[Column, Column]:
    """First and last date of a lookback window, no earlier than earliest."""
    return F.greatest(F.date_sub(day, days), earliest), day


def week_number(day: Column, start: Column, end: Column) -> Column:
    """1 from the first study day on; null outside the study."""
    return F.when(day.between(start, end), (F.floor(F.datediff(day, start) / 7) + 1).cast("int"))


def first_threshold(day: Column, thresholds: Column) -> Column:
    """Number of the first threshold not before day; null past the last one."""
    before = F.size(F.filter(thresholds, lambda t: t < day))
    return F.when(before < F.size(thresholds), before + 1)


def dynamic_thresholds(survey_days: Column, period_ends: Column, period_starts: Column) -> Column:
    """For each period the latest survey day in it, or its end."""
    latest = lambda a, e: F.array_max(F.filter(survey_days, lambda s: (s >= a) & (s <= e)))
    return F.zip_with(period_starts, period_ends, lambda a, e: F.coalesce(latest(a, e), e))


def partition_key(c: Column) -> Column:
    """year=/month=/day=/hour=/minute= folder of a pipeline timestamp."""
    t = F.try_to_timestamp(c, F.lit(PIPELINE_FORMAT))
    return F.date_format(t, "'year='yyyy'/month='MM'/day='dd'/hour='HH'/minute='mm")


def month_bucket(c: Column) -> Column:
    """Month, with everything before 2024 as 2023-12 and null as Unknown."""
    return F.when(c.isNull(), "Unknown").when(F.year(c) < 2024, "2023-12").otherwise(F.date_format(c, "yyyy-MM"))


def before_after(c: Column, cutoff: str, inclusive: bool = True) -> Column:
    """``pre`` up to the cutoff date (or before it), ``post`` later."""
    return F.when((c <= F.lit(cutoff)) if inclusive else (c < F.lit(cutoff)), "pre").otherwise("post")
