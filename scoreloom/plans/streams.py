"""The tables replayed as streams: every row is read, to the end, then the result."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.listening import DIM, build_reference
from ..sources.stores import LatestStore
from ..streaming import follow as S
from .cut import shared_folder

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def _source(spark: SparkSession, base: str) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet").parquet(base)


def _run(out: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream until its input ends, into a parquet sink in the shared folder
    (exactly once: a restart goes on from the checkpoint), and reads the result."""
    spark = out.sparkSession
    at = f"{shared_folder(spark)}/streams/{uuid.uuid4().hex}"
    out.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{at}/out")


def stream_windows(spark, base):
    """Events per type and hour, the hours that the watermark has closed."""
    return _run(S.windowed_counts(_source(spark, base))).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


def stream_gate(spark, base):
    """Silence per take, the floor kept as state between micro-batches."""
    S.use_rocksdb(spark)
    e = _source(spark, base).select(F.dayofmonth("ts").cast("long").alias("take"), F.col("event_id").alias("t"), (F.col("value") / 100).alias("energy"))
    return _run(S.gate_noise(e)).groupBy("take").agg(F.count("*").alias("frames"), F.count_if("silent").alias("silent"))


def stream_follow(spark, base):
    """The live cursor of every take, its state the follower's mass vector."""
    S.use_rocksdb(spark)
    ref = build_reference([(960.0 * k, 960.0 * (k + 1), 45 + (k * 7) % 24) for k in range(16)], [(3840.0 * b, 3840.0) for b in range(4)])
    slots = F.transform(F.sequence(F.lit(0), F.lit(DIM - 1)), lambda i: F.when((F.col("event_id") * 7 + i * 5) % 11 < 3, 1.0).otherwise(0.0))
    e = _source(spark, base).select(F.col("user_id").alias("take"), F.col("event_id").alias("t"), slots.alias("vec"), (F.col("event_type") == "error").alias("silent"))
    return _run(S.follow(e, ref)).groupBy("take").agg(F.count("*").alias("frames"), F.max("display").alias("furthest"), F.count_if(F.col("label") == "locked").alias("locked"))


def stream_latest(spark, base):
    """The latest event of each user, kept by an idempotent sink."""
    at = f"{shared_folder(spark)}/streams/{uuid.uuid4().hex}"
    sink = S.upsert_latest(f"{at}/store", ["user_id"], ["ts", "event_id"])
    e = _source(spark, base).select("user_id", "ts", "event_id", "event_type")
    e.writeStream.foreachBatch(sink).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return LatestStore(f"{at}/store", ["user_id"], ["ts", "event_id"]).read(spark).select("user_id", "event_id", "event_type")


QUERIES = {f.__name__: f for f in (stream_windows, stream_gate, stream_follow, stream_latest)}
SQL = {
    "stream_windows": "select date_trunc('hour', ts) as start, event_type, count(*) as n from events where date_trunc('hour', ts) + interval 1 hour <= (select max(ts) - interval 1 hour from events) group by 1, 2",
    "stream_latest": "select user_id, event_id, event_type from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1",
}
