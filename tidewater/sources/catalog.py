"""The datasets: schema, key, time column; and views over them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.functions.labels import PROBABILITY_LABELS

PERSPECTIVE = PROBABILITY_LABELS[:22]


def _strings(*names: str) -> str:
    return ", ".join(f"{n} string" for n in names)


@dataclass(frozen=True)
class Dataset:
    """A logical table kept as Parquet in {tier}/{partition_date} folders."""

    name: str
    ddl: str
    key: str | None = None
    ts: str | None = None
    deduplicate: bool = True
    subsets: tuple[str, ...] = field(default=())

    @property
    def columns(self) -> T.StructType:
        return T.StructType.fromDDL(self.ddl)

    @property
    def with_partition(self) -> T.StructType:
        return self.columns if "partition_date" in self.columns.names else T.StructType([*self.columns, T.StructField("partition_date", T.StringType())])


_RAW_POST = _strings("uri", "cid", "author", "py_type", "created_at", "text", "embed", "entities", "facets", "labels", "langs", "tags", "record_type", "synctimestamp")
_RAW_LINK = _strings("uri", "cid", "author", "py_type", "created_at", "subject", "record_type", "synctimestamp")
_LABEL = _strings("uri", "text", "preprocessing_timestamp", "reason", "label_timestamp", "source") + ", was_successfully_labeled boolean"

DATASETS = {
    d.name: d
    for d in (
        *[Dataset(n, (_RAW_POST + (", reply string" if n == "reply" else "")), "uri", "synctimestamp") for n in ("post", "reply")],
        *[Dataset(n, (_RAW_LINK), "uri", "synctimestamp") for n in ("like", "repost", "follow", "block")],
        Dataset(
            "preprocessed_posts",
            (_strings("uri", "cid", "indexed_at", "author_did", "author_handle", "author_avatar", "author_display_name", "created_at", "text", "embed", "entities", "facets", "labels", "langs", "reply_parent", "reply_root", "tags", "synctimestamp", "url", "source") + ", like_count bigint, reply_count bigint, repost_count bigint, passed_filters boolean, " + _strings("filtered_at", "filtered_by_func", "preprocessing_timestamp", "partition_date")),
            "uri",
            "preprocessing_timestamp",
            subsets=("firehose", "most_liked"),
        ),
        Dataset("ml_inference_perspective_api", (_LABEL + ", " + ", ".join(f"{p} double" for p in PERSPECTIVE)), "uri", "preprocessing_timestamp", subsets=("firehose", "most_liked")),
        Dataset("ml_inference_sociopolitical", (_LABEL + ", is_sociopolitical boolean, political_ideology_label string, llm_model_name string"), "uri", "preprocessing_timestamp"),
        Dataset("ml_inference_ime", (_LABEL + ", " + ", ".join(f"prob_{k} double, label_{k} bigint" for k in ("emotion", "intergroup", "moral", "other"))), "uri", "preprocessing_timestamp"),
        Dataset("ml_inference_valence_classifier", (_LABEL + ", valence_label string, compound double"), "uri", "preprocessing_timestamp"),
        Dataset("ml_inference_intergroup", (_LABEL + ", label bigint"), "uri", "preprocessing_timestamp"),
        Dataset("generated_feeds", _strings("feed_id", "user", "bluesky_handle", "bluesky_user_did", "condition", "feed_statistics", "feed", "feed_generation_timestamp"), "feed_id", "feed_generation_timestamp", False),
        Dataset("user_session_logs", _strings("user_did", "cursor", "feed", "timestamp") + ", limit bigint, feed_length bigint", None, "timestamp", False),
        Dataset("scraped_user_social_network", _strings("follow_handle", "follow_url", "follow_did", "follower_handle", "follower_url", "follower_did", "insert_timestamp", "relationship_to_study_user"), None, "insert_timestamp"),
        Dataset("post_scores", _strings("uri", "text", "source", "scored_timestamp") + ", engagement_score double, treatment_score double", "uri", "scored_timestamp"),
        Dataset("daily_superposters", _strings("insert_date_timestamp", "insert_date", "superposters", "method") + ", top_n_percent double, threshold bigint", None, "insert_date_timestamp", False),
        Dataset("author_to_average_toxicity_outrage", _strings("author_did", "preprocessing_timestamp") + ", total_labeled_posts bigint, average_toxicity double, average_outrage double", "author_did", "preprocessing_timestamp"),
        Dataset("aggregated_study_user_activities", _strings("author_did", "author_handle", "data_type", "data", "activity_timestamp", "insert_timestamp"), None, "activity_timestamp", False),
        Dataset("fetch_posts_used_in_feeds", _strings("uri", "insert_timestamp"), "uri", "insert_timestamp"),
    )
}
#: Columns that compaction leaves behind (fixed values).
ARTEFACTS = ("row_num", "startTimestamp")


def coerce(df: DataFrame, columns: T.StructType, strict: bool = True) -> DataFrame:
    """Exactly these columns: cast (an error on a bad value, or null if not strict), typed nulls where missing."""
    def one(f: T.StructField):
        if f.name not in df.columns:
            return F.lit(None).cast(f.dataType).alias(f.name)
        c = F.col(f"`{f.name}`")
        return (c.cast(f.dataType) if strict else c.try_cast(f.dataType)).alias(f.name)

    return df.select(*[one(f) for f in columns])


def without_artefacts(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    return df.drop(*[c for c in ARTEFACTS if c not in keep])


def register_views(spark: SparkSession, tables: dict[str, tuple[DataFrame, list[str] | None]]) -> None:
    """A temporary view for every table, with the declared columns only."""
    for name, (df, columns) in tables.items():
        (df.select(*columns) if columns else df).createOrReplaceTempView(name)


def query(spark: SparkSession, sql: str, **args: object) -> DataFrame:
    """Read-only SQL with named parameters; values never become part of the text."""
    if not sql.lstrip().lower().startswith(("select", "with", "values", "show", "describe", "explain")):
        raise ValueError("only queries are allowed")
    return spark.sql(sql, args=args)


def quoted(identifier: str) -> str:
    return "`" + identifier.replace("`", "``") + "`"
