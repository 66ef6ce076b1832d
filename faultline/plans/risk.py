"""Train the risk model, publish it, score the newest cohort and raise alerts."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from faultline.operators import history, model, quality
from faultline.session import materialise
from faultline.sources import sinks
from faultline.streaming import alerts


def train_and_publish(spark: SparkSession, root: str, protocol: model.Protocol) -> model.RiskModel:
    """Features and model under the version; the pointer is written last."""
    features = history.risk_features(spark.read.parquet(f"{root}/silver"))
    sinks.write_table(features, f"{root}/risk/features")
    fitted = model.train(spark.read.parquet(f"{root}/risk/features"), protocol)
    model.save(fitted, f"{root}/risk/models/{protocol.version}")
    pointer = spark.createDataFrame([(protocol.version,)], "current_version string")
    sinks.publish_version(pointer, f"{root}/risk/pointer", protocol.version, protocol.version)
    return fitted


def current_model(spark: SparkSession, root: str) -> model.RiskModel:
    version = sinks.read_current(spark, f"{root}/risk/pointer").first()["current_version"]
    return model.load(spark, f"{root}/risk/models/{version}")


def score_and_alert(
    spark: SparkSession, root: str, run_id: str, scored_at: Column | None = None
) -> int:
    """Score the newest cohort under its run, check what was stored, write the alerts."""
    silver = spark.read.parquet(f"{root}/silver")
    features = materialise(history.latest_features(silver))
    scores = model.score_latest(current_model(spark, root), features, scored_at)
    dated = scores.withColumn("reference_date", F.to_date("scored_at"))
    sinks.write_run(dated, f"{root}/risk/scores", "reference_date", run_id)
    stored = spark.read.parquet(f"{root}/risk/scores").where(F.col("run_id") == run_id)
    difference = quality.same_ids(scores, stored).first()
    if difference["only_left"] or difference["only_right"]:
        raise quality.ContractError("Stored scores differ from the scored cohort.")
    events = alerts.alert_events(stored)
    events.select("value").write.mode("overwrite").text(f"{root}/risk/alerts/run_id={run_id}")
    version = stored.select("model_version").first()
    if version:
        once = f"{run_id}-{uuid.uuid4().hex}"
        sinks.publish_version(stored.drop("model_version"), f"{root}/risk/serving", version[0], once)
    return stored.count()
