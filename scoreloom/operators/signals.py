"""Keyed user records: merges, upserts and event folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lww_merge(current: DataFrame, incoming: DataFrame, keys: Sequence[str], stamp: str, valid: Column | None = None) -> DataFrame:
    """Last writer wins: an incoming record replaces the current one of its key only if
    its stamp is strictly later; equal stamps keep what is there, so importing twice
    changes nothing. Invalid incoming records are skipped. One aggregate over the
    union, combined in each partition before the shuffle; no self-join."""
    if valid is not None:
        incoming = incoming.where(valid)
    body = [c for c in current.columns if c not in keys]
    every = current.withColumn("_p", F.lit(1)).unionByName(incoming.withColumn("_p", F.lit(0)), allowMissingColumns=True)
    best = F.max_by(F.struct(*body), F.struct(stamp, "_p", *[c for c in body if c != stamp]))
    return every.groupBy(*keys).agg(best.alias("r")).select(*keys, "r.*")


def merge_report(current: DataFrame, incoming: DataFrame, keys: Sequence[str], stamp: str, valid: Column) -> DataFrame:
    """One row: how many incoming records are new, newer, stale and invalid."""
    c = current.select(*keys, F.col(stamp).alias("_had"))
    j = incoming.withColumn("_ok", F.coalesce(valid, F.lit(False))).join(c, list(keys), "left")
    return j.agg(
        F.count_if(F.col("_ok") & F.col("_had").isNull()).alias("added"),
        F.count_if(F.col("_ok") & (F.col(stamp) > F.col("_had"))).alias("updated"),
        F.count_if(F.col("_ok") & (F.col(stamp) <= F.col("_had"))).alias("stale"),
        F.count_if(~F.col("_ok")).alias("skipped"),
    )


def union_merge(current: DataFrame, incoming: DataFrame, keys: Sequence[str], group: Sequence[str], order: Sequence[Column], keep: int) -> DataFrame:
    """Set union by key, the current record winning, then the first ``keep`` per group."""
    body = [c for c in current.columns if c not in keys]
    every = current.withColumn("_p", F.lit(1)).unionByName(incoming.withColumn("_p", F.lit(0)))
    one = every.groupBy(*keys).agg(F.max_by(F.struct(*body), F.struct("_p", *body)).alias("r")).select(*keys, "r.*")
    return one.withColumn("_rn", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("_rn") <= keep).drop("_rn")


def latest_state(log: DataFrame, keys: Sequence[str], value: str, order: Sequence[str], tombstones: Sequence = ()) -> DataFrame:
    """The last value per key of an event log; keys whose last event is a tombstone or
    null are gone."""
    s = log.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value)).where(F.col(value).isNotNull())
    return s.where(~F.col(value).isin(*tombstones)) if tombstones else s


def toggle_state(log: DataFrame, keys: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    """The state after every event set its value or, given the value that is set,
    cleared it. A run of equal events leaves the value if its length is odd; a run that
    ends cleared is followed by a set whatever comes, so only the last run matters."""
    w = Window.partitionBy(*keys).orderBy(*order)
    runs = log.withColumn("_new", (F.lag(value).over(w).eqNullSafe(F.col(value))).cast("int")).withColumn("_run", F.sum(1 - F.coalesce("_new", F.lit(0))).over(w))
    per = runs.groupBy(*keys, "_run").agg(F.count("*").alias("_n"), F.first(value).alias(value))
    return per.groupBy(*keys).agg(F.max_by(F.struct(value, "_n"), "_run").alias("r")).select(*keys, F.when(F.col("r._n") % 2 == 1, F.col(f"r.{value}")).alias(value))


def best_record(df: DataFrame, keys: Sequence[str], by: Sequence[str]) -> DataFrame:
    """The record of each key that is greatest by ``by``."""
    body = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*body), F.struct(*by)).alias("r")).select(*keys, "r.*")


def export_backup(records: DataFrame, profile: str, key: str, body: Sequence[str], version: int) -> DataFrame:
    """One JSON envelope per profile: version and a map from key to record, in key order."""
    entries = F.sort_array(F.collect_list(F.struct(F.col(key).cast("string").alias("k"), F.struct(*body).alias("v"))))
    return records.groupBy(profile).agg(F.to_json(F.struct(F.lit(version).alias("version"), F.map_from_entries(entries).alias("records"))).alias("backup"))


def import_backup(backups: DataFrame, profile: str, record_schema: str, versions: Sequence[int], valid: Column) -> DataFrame:
    """The records of envelopes of known versions, a row each; malformed records are
    dropped, the rest of their envelope stays; unreadable envelopes give nothing."""
    parsed = backups.withColumn("_b", F.from_json("backup", "version int, records map<string, string>")).where(F.col("_b.version").isin(*versions))
    rows = parsed.select(profile, F.explode("_b.records").alias("key", "json"))
    return rows.withColumn("r", F.from_json("json", record_schema)).select(profile, "key", "r.*").where(valid)


def append_capped(kept: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[Column], cap: int) -> DataFrame:
    """The records of each key after new ones are added and all but the first ``cap`` in
    ``order`` are dropped. Two steps, so that a key with many new records is cut down in
    parts before its parts meet."""
    every = kept.unionByName(new.select(*kept.columns))
    part = Window.partitionBy(*keys, "_salt").orderBy(*order)
    few = every.withColumn("_salt", F.pmod(F.xxhash64(*kept.columns), F.lit(32))).withColumn("_r", F.row_number().over(part)).where(F.col("_r") <= cap)
    return few.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_r") <= cap).select(*kept.columns)


def without_profile(profile, *tables: DataFrame) -> list[DataFrame]:
    """Tables (profile_id, ...) without the records of one profile; records of no profile
    stay."""
    return [t.where(~F.col("profile_id").eqNullSafe(F.lit(profile))) for t in tables]
