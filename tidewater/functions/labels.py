"""Content labels and the aggregates over them, for all labels in one pass."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Labels that are probabilities (fixed values).
PROBABILITY_LABELS = (
    "prob_toxic", "prob_constructive", "prob_severe_toxic", "prob_identity_attack", "prob_insult", "prob_profanity",
    "prob_threat", "prob_affinity", "prob_compassion", "prob_curiosity", "prob_nuance", "prob_personal_story",
    "prob_reasoning", "prob_respect", "prob_alienation", "prob_fearmongering", "prob_generalization",
    "prob_moral_outrage", "prob_scapegoating", "prob_sexually_explicit", "prob_flirtation", "prob_spam",
    "prob_intergroup", "prob_moral", "prob_emotion", "prob_other",
)
SCORE_LABELS = ("valence_clf_score",)
BOOLEAN_LABELS = (
    "is_valence_positive", "is_valence_negative", "is_valence_neutral", "is_sociopolitical", "is_not_sociopolitical",
    "is_political_left", "is_political_right", "is_political_moderate", "is_political_unclear",
)
LABELS = {k: "probability" for k in PROBABILITY_LABELS} | {k: "score" for k in SCORE_LABELS} | {k: "boolean" for k in BOOLEAN_LABELS}
THRESHOLD = 0.5


def average(c: Column, digits: int = 3) -> Column:
    """Mean of what is there, rounded."""
    return F.round(F.avg(c.cast("double")), digits)


def proportion(c: Column, kind: str = "probability", threshold: float = THRESHOLD, digits: int = 3) -> Column:
    """Share of values at or above the threshold (or true) among those there; null for scores."""
    if kind == "score":
        return F.lit(None).cast("double")
    hit = (c >= threshold) if kind == "probability" else c
    return F.round(F.avg(F.when(c.isNotNull(), hit.cast("double"))), digits)


def all_metrics(prefix: str = "feed", labels: dict[str, str] = LABELS) -> list[Column]:
    """Two aggregates for every label, named {prefix}_average_x and {prefix}_proportion_x."""
    out = []
    for name, kind in labels.items():
        short = name.removeprefix("prob_")
        out += [average(F.col(name)).alias(f"{prefix}_average_{short}"), proportion(F.col(name), kind).alias(f"{prefix}_proportion_{short}")]
    return out


def one_hot(c: Column, values: dict[str, str]) -> list[Column]:
    """One boolean for every value: {column name: value}."""
    return [(c == v).alias(k) for k, v in values.items()]


def multi_label(probabilities: dict[str, Column], threshold: float = THRESHOLD, other: str = "other") -> list[Column]:
    """0/1 labels by probability over the threshold; ``other`` also where there is none else.

    ``other`` may have a probability of its own among them.
    """
    flags = {k: (p > threshold).cast("int") for k, p in probabilities.items()}
    total = sum(flags.values(), F.lit(0))
    last = F.when(total == 0, 1).otherwise(flags.pop(other, F.lit(0)))
    return [*[f.alias(f"label_{k}") for k, f in flags.items()], last.alias(f"label_{other}")]


def valid_binary(c: Column) -> Column:
    return c.isin(0, 1)


#: Names of engaged records in metric names (fixed values).
ENGAGED = {"like": "liked_posts", "post": "posted_posts", "repost": "reposted_posts", "reply": "replied_posts"}


def engagement_metrics(record_type: str | Column, labels: dict[str, str] = LABELS, kinds: dict[str, str] = ENGAGED) -> list[Column]:
    """Two aggregates for every label and record type, in one pass: no pivot, one row a group."""
    kind = F.col(record_type) if isinstance(record_type, str) else record_type
    out = []
    for value, name in kinds.items():
        for label, what in labels.items():
            c, short = F.when(kind == value, F.col(label)), label.removeprefix("prob_")
            out += [average(c).alias(f"engagement_average_{name}_{short}"), proportion(c, what).alias(f"engagement_proportion_{name}_{short}")]
    return out


def metric_columns(columns: list[str], metric: str, name: str) -> list[str]:
    """Columns of a metric type that end in exactly this label (moral does not match moral_outrage)."""
    longer = [k.removeprefix("prob_") for k in LABELS if k.removeprefix("prob_") != name and k.removeprefix("prob_").endswith(f"_{name}")]
    return [c for c in columns if f"_{metric}_" in f"_{c}" and c.endswith(f"_{name}") and not any(c.endswith(f"_{x}") for x in longer)]
