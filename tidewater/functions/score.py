"""Scores of posts for ranking; every one takes and gives columns, with now injected."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class FeedConfig:
    """Weights and limits of scoring and feed assembly (fixed default values)."""

    lookback_days: int = 1
    max_freshness: float = 3.0
    exponential_base: float = 1.0
    exponential_lambda: float = 0.95
    toxicity_coefficient: float = 0.965
    constructiveness_coefficient: float = 1.02
    superposter_coefficient: float = 0.95
    default_similarity: float = 0.8
    similarity_likes: float = 100.0
    max_feed_length: int = 100
    max_per_author: int = 5
    max_old_share: float = 0.6
    max_in_network_share: float = 0.5
    jitter: int = 2

    @property
    def lookback_hours(self) -> int:
        return 24 * self.lookback_days

    @property
    def decay(self) -> float:
        return self.max_freshness / self.lookback_hours


def age_hours(now: Column, posted: Column, config: FeedConfig = FeedConfig()) -> Column:
    hours = (F.unix_timestamp(now) - F.unix_timestamp(posted)) / 3600
    return F.least(F.round(hours, 2), F.lit(float(config.lookback_hours)))


def linear_freshness(age: Column, config: FeedConfig = FeedConfig()) -> Column:
    return F.greatest(F.lit(0.0), config.max_freshness - age * config.decay)


def exponential_freshness(age: Column, config: FeedConfig = FeedConfig()) -> Column:
    return config.max_freshness * F.pow(F.lit(config.exponential_base * (1 - config.decay) * config.exponential_lambda), age)


def likeability(likes: Column, similarity: Column, config: FeedConfig = FeedConfig()) -> Column:
    """Log of likes; of what the similarity stands for; of what the default similarity stands for."""
    return F.log1p(F.coalesce(likes.cast("double"), similarity * config.similarity_likes, F.lit(config.default_similarity * config.similarity_likes)))


def treatment_multiplier(toxic: Column, constructive: Column, reasoning: Column, labelled: Column, superposter: Column, config: FeedConfig = FeedConfig()) -> Column:
    con = F.coalesce(constructive, reasoning)
    total = toxic + con
    weighed = (toxic * config.toxicity_coefficient + con * config.constructiveness_coefficient) / F.nullif(total, F.lit(0.0))
    content = F.when(labelled & (total > 0), weighed).otherwise(1.0)
    return content * F.when(superposter, config.superposter_coefficient).otherwise(1.0)


def scores(likeable: Column, fresh: Column, multiplier: Column) -> tuple[Column, Column]:
    """Engagement and treatment scores."""
    base = likeable + fresh
    return base.alias("engagement_score"), (base * multiplier).alias("treatment_score")
