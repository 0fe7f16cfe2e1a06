"""The reference domain's roles on the star-schema tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table

PIECES_SQL = """pieces as (select p_partkey as candidate_id, p_partkey as pos, p_name as title, p_brand as composer, p_type as era, p_retailprice as duration,
 case when p_partkey % 5 < 2 then cast(1 + p_size % 10 as varchar) end as grade, case when p_partkey % 7 <> 0 then cast(1 + (p_partkey * 7919) % 10 as varchar) else '' end as model_grade from part),
graded as (select *, case when coalesce(grade, '') <> '' then 'curator' when coalesce(model_grade, '') <> '' then 'model' else 'none' end as kind,
 coalesce(nullif(grade, ''), nullif(model_grade, '')) as resolved, try_cast(coalesce(nullif(grade, ''), nullif(model_grade, '')) as int) as g from pieces)"""


def pieces(spark: SparkSession, base: str) -> DataFrame:
    p = table(spark, base, "part", ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"])
    return p.select(
        F.col("p_partkey").alias("candidate_id"), F.col("p_partkey").alias("pos"), F.col("p_name").alias("title"), F.col("p_brand").alias("composer"),
        F.col("p_type").alias("era"), F.col("p_retailprice").alias("duration"),
        F.when(F.col("p_partkey") % 5 < 2, (1 + F.col("p_size") % 10).cast("string")).alias("grade"),
        F.when(F.col("p_partkey") % 7 != 0, (1 + (F.col("p_partkey") * 7919) % 10).cast("string")).otherwise("").alias("model_grade"),
    )


STATUS = {"click": "playing", "view": "not_seen", "purchase": "completed", "error": "too_hard", "signup": "not_for_me"}
_STATUS_SQL = "case event_type " + " ".join(f"when '{a}' then '{b}'" for a, b in STATUS.items()) + " end"
EVENTS_SQL = f"""log as (select event_id, user_id as profile_id, 1 + event_id % (select count(*) from part) as candidate_id, ts as updated_at, {_STATUS_SQL} as status, value, props from events)"""
LATEST_SQL = f"""{EVENTS_SQL},
statuses as (select candidate_id, arg_max(status, (updated_at, event_id)) as status from log group by 1)"""


def log(spark: SparkSession, base: str) -> DataFrame:
    """Status events of profiles on pieces."""
    e = table(spark, base, "events", ["event_id", "user_id", "ts", "event_type", "value", "props"])
    n = table(spark, base, "part", ["p_partkey"]).agg(F.count("*").alias("_n")).scalar()
    status = F.coalesce(*[F.when(F.col("event_type") == a, F.lit(b)) for a, b in STATUS.items()])
    return e.select(
        "event_id", F.col("user_id").alias("profile_id"), (1 + F.col("event_id") % n).alias("candidate_id"), F.col("ts").alias("updated_at"), status.alias("status"), "value", "props"
    )


def statuses(spark: SparkSession, base: str) -> DataFrame:
    """The latest status of each piece."""
    return log(spark, base).groupBy("candidate_id").agg(F.max_by("status", F.struct("updated_at", "event_id")).alias("status"))
