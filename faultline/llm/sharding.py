"""Shards by rendezvous hashing, by DataFrame functions only.

Each shard draws a number in (0, 1) from a hash of the record key and its own
name, and the key goes to the shard with the least ``-ln(draw) / weight``. A shard
more only takes keys that now draw best for it; no other key moves.

Rows are numbered within their shard without sorting a shard in one task: keys are
cut into ``buckets`` by hash, wholly equal rows are counted before the shuffle, and
a bucket's numbers start where those of the buckets before it end.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.session import materialise

#: Slots that one row of a repeated key gives at once.
RUN = 10_000
#: Hex digits of a hash that make a draw: 52 bits, exact in a double.
DIGITS = 13


def draw(key: Column, shard: str) -> Column:
    """A number in (0, 1) from the key and the name of a shard."""
    digest = F.md5(F.concat(key, F.lit("/"), F.lit(shard)))
    number = F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("double")
    return (number + 0.5) / F.lit(float(16**DIGITS))


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """Number of the shard of ``key``; shard i has the i-th weight. Ties: the lower shard."""
    costs = [
        F.struct((-F.log(draw(key, str(i))) / F.lit(float(w))).alias("cost"), F.lit(i).alias("shard"))
        for i, w in enumerate(weights)
    ]
    return F.array_min(F.array(*costs))["shard"]


def shard_rows(
    docs: DataFrame,
    weights: Sequence[float] = (1.0,) * 8,
    added: float = 1.0,
    buckets: int = 8192,
) -> DataFrame:
    """Place all rows of ``docs`` by their ``doc_id`` and number them in their shard.

    docs: needs ``doc_id`` and ``text``; other columns are ignored. weights: of the
    shards, positive. added: weight of one more shard. buckets: per shard; a bucket
    is one group of a window, so take rows / (10,000 shards) or more.

    Returns a row per row: ``doc_id``, ``size`` (UTF-8 bytes of the text, null: none,
    plus 1), ``text_crc32``, ``law`` (``key``: only the id and the shards decide),
    ``shard``, ``slot`` (gapless from 0 in the shard, equal rows side by side) and
    ``grown_shard`` (with the shard more). Null ids share one shard. An empty table
    gives no rows.
    """
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    grown = [*weights, added]
    text = F.coalesce("text", F.lit(""))
    placed = (
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text).cast("long") + 1).alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
        )
        .groupBy("doc_id", "size", "text_crc32")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            "*",
            rendezvous(key, weights).alias("shard"),
            rendezvous(key, grown).alias("grown_shard"),
            (
                F.conv(F.substring(F.md5(F.concat_ws("/", key, "size", "text_crc32")), 1, 8), 16, 10)
                .cast("long") % buckets
            ).alias("bucket"),
        )
    )
    placed = materialise(placed)
    # One row per shard and bucket: of a size that the parameters fix.
    totals = placed.groupBy("shard", "bucket").agg(F.sum("n").alias("total"))
    ordered = Window.partitionBy("shard").orderBy("bucket")
    before = totals.select(
        "shard", "bucket", (F.sum("total").over(ordered) - F.col("total")).alias("before")
    )
    within = Window.partitionBy("shard", "bucket").orderBy("doc_id", "size", "text_crc32")
    started = placed.join(F.broadcast(before), ["shard", "bucket"]).withColumn(
        "first", F.col("before") + F.sum("n").over(within) - F.col("n")
    )
    plain = started.where("n = 1").withColumn("slot", F.col("first"))
    # A row that is there many times: first the starts of runs, dealt out, then the runs.
    runs = started.where("n > 1").withColumn(
        "start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(RUN).cast("long")))
    )
    until = F.col("first") + F.least(F.col("start") + RUN, F.col("n")) - 1
    spread = runs.repartition("doc_id", "text_crc32", "start").withColumn(
        "slot", F.explode(F.sequence(F.col("first") + F.col("start"), until))
    )
    columns = [
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        "slot",
        "grown_shard",
    ]
    return plain.select(*columns).unionByName(spread.select(*columns))
