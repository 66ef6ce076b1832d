"""Alert events: built from scores, checked on arrival, in batch and in streams."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from faultline import schema as S
from faultline.functions.text import trimmed

_FIELDS = S.ALERT_SCHEMA.names


def alert_eligible(level: Column) -> Column:
    return F.coalesce(F.lower(F.trim(level)).isin(S.ALERT_LEVELS), F.lit(False))


def alert_events(scores: DataFrame) -> DataFrame:
    """High and critical scores as (key, JSON value) messages. Works on streams too."""
    event = {
        **{name: F.col(name) for name in _FIELDS if name in scores.columns},
        "event_type": F.lit(S.ALERT_EVENT_TYPE),
        "risk_level": F.lower(F.trim("risk_level")),
        "top_risk_factors": F.coalesce("top_risk_factors", F.lit("")),
    }
    fields = F.struct(*[event[name].alias(name) for name in _FIELDS])
    return scores.where(alert_eligible(F.col("risk_level"))).select(
        F.col("incident_id").alias("key"), F.to_json(fields).alias("value")
    )


# Name and SQL type of each field as it must appear in the text.
_OPTIONAL = "top_risk_factors"


def parsed_events(messages: DataFrame) -> DataFrame:
    """Parse messages and state why each one is refused (null when valid).

    Unknown fields, absent fields, wrong kinds of values and values out of
    range are all refused.
    """
    value = F.col("value").cast("string")
    kinds = {
        name: "DOUBLE" if name == "breach_probability" else "STRING" for name in _FIELDS
    } | {"risk_score": "BIGINT"}
    text_schema = ", ".join(f"{name} {kind}" for name, kind in kinds.items())
    event = F.from_json(value, f"{text_schema}, broken STRING", {
        "mode": "PERMISSIVE",
        "columnNameOfCorruptRecord": "broken",
    })
    parsed = messages.select(value.alias("value"), event.alias("e"), F.json_object_keys(value).alias("keys"))
    e = F.col("e")
    extra = F.size(F.array_except("keys", F.array(*[F.lit(n) for n in _FIELDS]))) > 0
    scored_at = F.to_timestamp(e["scored_at"].try_cast("timestamp"))
    required = [n for n in _FIELDS if n not in {_OPTIONAL, "event_type"}]
    absent = F.lit(False)
    for name in required:
        absent = absent | e[name].isNull()
    reason = (
        F.when(F.col("keys").isNull() | e.isNull() | e["broken"].isNotNull(), F.lit("not_json"))
        .when(extra, F.lit("unknown_field"))
        .when(absent, F.lit("missing_field"))
        .when(F.coalesce(e["event_type"] != S.ALERT_EVENT_TYPE, F.lit(False)), F.lit("event_type"))
        .when(scored_at.isNull(), F.lit("scored_at"))
        .when(
            trimmed(e["incident_id"]).isNull()
            | trimmed(e["model_version"]).isNull()
            | trimmed(e["recommended_action"]).isNull(),
            F.lit("empty_text"),
        )
        .when(~e["breach_probability"].between(0, 1), F.lit("breach_probability"))
        .when(~e["risk_score"].between(0, 100), F.lit("risk_score"))
        .when(~e["risk_level"].isin(S.ALERT_LEVELS), F.lit("risk_level"))
    )
    fields = [
        (scored_at if name == "scored_at" else e[name]).alias(name) for name in _FIELDS
    ]
    return parsed.select("value", reason.alias("reject_reason"), *fields)


def accepted(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("reject_reason").isNull()).select(
        F.coalesce("event_type", F.lit(S.ALERT_EVENT_TYPE)).alias("event_type"), *_FIELDS[1:]
    )


def rejected(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("reject_reason").isNotNull()).select("value", "reject_reason")


def publish_stream(
    spark: SparkSession, scores_path: str, out_path: str, checkpoint: str
) -> StreamingQuery:
    """Turn every newly arrived score file into alert messages, once each."""
    scores = spark.readStream.schema(S.RISK_SCORE_SCHEMA).parquet(scores_path)
    return (
        alert_events(scores)
        .select("value")
        .writeStream.format("text")
        .option("checkpointLocation", checkpoint)
        .option("path", out_path)
        .trigger(availableNow=True)
        .start()
    )


def consume_stream(
    spark: SparkSession, messages_path: str, valid_path: str, dead_path: str, checkpoint: str
) -> StreamingQuery:
    """Split messages into valid events and dead letters; nothing is asked for again.

    Batch outputs are named by batch number, so a batch that runs twice after
    a failure replaces its own files. A batch is read and parsed once for both.
    """

    def split(batch: DataFrame, number: int) -> None:
        parsed = parsed_events(batch).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            accepted(parsed).write.mode("overwrite").parquet(f"{valid_path}/batch={number}")
            rejected(parsed).write.mode("overwrite").parquet(f"{dead_path}/batch={number}")
        finally:
            parsed.unpersist()

    messages = spark.readStream.text(messages_path)
    return (
        messages.writeStream.foreachBatch(split)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def score_stream(
    spark: SparkSession, features_path: str, schema, score, out_path: str, checkpoint: str
) -> StreamingQuery:
    """Score each newly arrived batch of features with ``score``."""

    def run(batch: DataFrame, number: int) -> None:
        score(batch).write.mode("overwrite").parquet(f"{out_path}/batch={number}")

    return (
        spark.readStream.schema(schema)
        .parquet(features_path)
        .writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
