"""Problem 1: at most so many records per dominant contributor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ordering import rank_in_group
from ..plans.cut import cut
from ..sources.tables import table

SALTS, PART_ROWS = 16, 100_000  # parts of a contributor at least, and rows of one, about
LEAST, SHARE = 3, 200  # the cap: greatest(LEAST, records div SHARE)


def tidy(c: str) -> Column:
    """Lower case, runs of white space made one space, none outside."""
    return F.trim(F.regexp_replace(F.lower(c), "[ \\t\\n\\r\\u00a0]+", " "))


def latest(df: DataFrame) -> DataFrame:
    """Of each candidate_id the row with the latest graded_at (null comes first of
    all); ties fall to the larger quality_score, then contributor. Aggregated
    before the shuffle. Rows without candidate_id are left out."""
    body = [c for c in df.columns if c != "candidate_id"]
    score = F.coalesce(F.nanvl("quality_score", F.lit(None)), F.lit(float("-inf")))
    by = F.struct("graded_at", score, "source", "composer_normalized")
    return (
        df.where("candidate_id is not null")
        .groupBy("candidate_id").agg(F.max_by(F.struct(*body), by).alias("r"))
        .select("candidate_id", "r.*")
    )


def beyond_cap(df: DataFrame, salts: int | None = None, least: int = LEAST, share: int = SHARE) -> DataFrame:
    """(candidate_id) of the records beyond the cap of their contributor; see ``capped``.
    Carries keys only.

    Only contributors above the cap are ranked; they are fewer than ``share`` (each
    holds more than one part in ``share`` of all records), so their list may be
    broadcast. They are ranked in ``salts`` parts first (as many as keep a part of the
    largest below ``PART_ROWS``): what is beyond the cap in its part is beyond it in
    all. The survivors get their exact ranks from range partitions with offsets, so no
    contributor is gathered in one task.
    """
    keys = df.select("candidate_id", "source", "composer_normalized", "quality_score", "graded_at")
    worst = F.coalesce(-F.nanvl("quality_score", F.lit(None)), F.lit(float("inf")))
    rows = cut(latest(keys).select("candidate_id", F.coalesce(tidy("source"), F.lit("")).alias("c_source"), tidy("composer_normalized").alias("c_composer"), worst.alias("worst")))
    cap = max(least, rows.count() // share)
    named = rows.where("c_composer <> ''")
    large = cut(named.groupBy("c_source", "c_composer").agg(F.count("*").alias("size")).where(F.col("size") > cap))
    if salts is None:
        salts = max(SALTS, -(-(large.agg(F.max("size")).first()[0] or 0) // PART_ROWS))
    ranked = (
        named.join(F.broadcast(large.drop("size")), ["c_source", "c_composer"], "left_semi")
        .withColumn("salt", F.pmod(F.xxhash64("candidate_id"), F.lit(salts)))
        .withColumn("pre", F.row_number().over(Window.partitionBy("c_source", "c_composer", "salt").orderBy("worst", "candidate_id")))
    )
    ranked = cut(ranked)
    alive = ranked.where(F.col("pre") <= cap).select("candidate_id", "c_source", "c_composer", "worst")
    placed = rank_in_group(alive, ["c_source", "c_composer"], ["worst", "candidate_id"])
    return ranked.where(F.col("pre") > cap).select("candidate_id").unionByName(placed.where(F.col("rank") > cap).select("candidate_id"))


def capped(df: DataFrame, salts: int | None = None, least: int = LEAST, share: int = SHARE) -> DataFrame:
    """The latest row of each candidate_id with ``kept``: whether it is among the
    first cap records of its contributor, higher quality_score first, null and NaN
    last as equals, ties by smaller candidate_id. The contributor is (source,
    composer_normalized), tidied; with a null or blank composer nothing is capped.
    An empty table gives an empty one."""
    dropped = beyond_cap(df, salts, least, share).withColumn("_dropped", F.lit(True))
    return latest(df).join(dropped, "candidate_id", "left").withColumn("kept", F.col("_dropped").isNull()).drop("_dropped")


def _grades(spark, base):
    return table(spark, base, "dummy_advisor_grades", ["candidate_id", "source", "title", "composer_normalized", "quality_score", "graded_at"])


def p1_found(spark: SparkSession, base: str) -> DataFrame:
    return beyond_cap(_grades(spark, base))


def p1_capped(spark: SparkSession, base: str) -> DataFrame:
    """The table cut to the cap."""
    return capped(_grades(spark, base)).where("kept").select("candidate_id", "source", "title", "composer_normalized")


_LATEST_SQL = r"""
latest as (
  select candidate_id, source, title, composer_normalized, case when isnan(quality_score) then null else quality_score end as q,
    trim(regexp_replace(lower(source), '[ \t\n\r\x{00A0}]+', ' ', 'g'), ' ') as s,
    trim(regexp_replace(lower(composer_normalized), '[ \t\n\r\x{00A0}]+', ' ', 'g'), ' ') as c
  from dummy_advisor_grades where candidate_id is not null
  qualify row_number() over (partition by candidate_id order by graded_at desc nulls last, coalesce(case when isnan(quality_score) then null else quality_score end, '-infinity'::double) desc, source desc nulls last, composer_normalized desc nulls last) = 1
), ranked as (
  select *, row_number() over (partition by coalesce(s, ''), c order by q desc nulls last, candidate_id) as r, (select greatest(3, count(*) // 200) from latest) as cap from latest
)"""

SQL = {
    "p1_found": f"with {_LATEST_SQL} select candidate_id from ranked where coalesce(c, '') <> '' and r > cap",
    "p1_capped": f"with {_LATEST_SQL} select candidate_id, source, title, composer_normalized from ranked where coalesce(c, '') = '' or r <= cap",
}
