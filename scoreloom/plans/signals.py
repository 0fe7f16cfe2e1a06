"""Merges, folds and backups of user records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import signals as S
from . import roles

STATES = ("playing", "not_seen", "completed", "too_hard", "not_for_me")


def _halves(spark, base):
    """Two stores of the same records: the events of even and of odd ids."""
    log = roles.log(spark, base).select("profile_id", "candidate_id", "status", "updated_at", "event_id")
    pick = lambda d: d.groupBy("profile_id", "candidate_id").agg(F.max_by(F.struct("status", "updated_at", "event_id"), F.struct("updated_at", "event_id")).alias("r")).select("profile_id", "candidate_id", "r.*")
    return pick(log.where("event_id % 2 = 0")), pick(log.where("event_id % 2 = 1"))


_HALF = """h as (select profile_id, candidate_id, event_id % 2 as side, arg_max({'s': status, 'u': updated_at, 'e': event_id}, (updated_at, event_id)) as r from log group by 1, 2, 3)"""


def lww_merge(spark, base):
    a, b = _halves(spark, base)
    return S.lww_merge(a, b, ["profile_id", "candidate_id"], "updated_at", F.col("status") != "not_seen").select("profile_id", "candidate_id", "status", "event_id")


def merge_report(spark, base):
    a, b = _halves(spark, base)
    return S.merge_report(a, b, ["profile_id", "candidate_id"], "updated_at", F.col("status") != "not_seen")


def union_merge_top10(spark, base):
    """Takes of two stores united by their time, the ten latest per profile."""
    log = roles.log(spark, base).select("profile_id", F.col("updated_at").alias("recorded_at"), "event_id", "value")
    a, b = log.where("event_id % 3 < 2"), log.where("event_id % 3 > 0")
    m = S.union_merge(a, b, ["profile_id", "recorded_at", "event_id"], ["profile_id"], [F.desc("recorded_at"), F.desc("event_id")], 10)
    return m.select("profile_id", "event_id", F.round("value", 6).alias("value"))


def latest_status(spark, base):
    """What each profile last said of each piece; 'not seen' deletes."""
    return S.latest_state(roles.log(spark, base), ["profile_id", "candidate_id"], "status", ["updated_at", "event_id"], ("not_seen",))


def toggle_fold(spark, base):
    """Each event sets its status, or clears it if it is set already."""
    return S.toggle_state(roles.log(spark, base), ["profile_id"], "status", ["updated_at", "event_id"])


def best_take(spark, base):
    t = roles.log(spark, base).select("profile_id", F.col("status").alias("kind"), "value", "event_id")
    return S.best_record(t, ["profile_id", "kind"], ["value", "event_id"]).select("profile_id", "kind", "event_id", F.round("value", 6).alias("value"))


def backup_roundtrip(spark, base):
    """Exported to one envelope per profile and read back, bad records dropped."""
    a, _ = _halves(spark, base)
    out = S.export_backup(a, "profile_id", "candidate_id", ["status", "event_id"], 4)
    back = S.import_backup(out, "profile_id", "status string, event_id long", (1, 2, 3, 4), F.col("status").isin(*STATES[:4]))
    return back.select("profile_id", F.col("key").cast("long").alias("candidate_id"), "status", "event_id")


def backup_json(spark, base):
    a, _ = _halves(spark, base)
    return S.export_backup(a, "profile_id", "candidate_id", ["status", "event_id"], 4)


def props_records(spark, base):
    """Values out of the events' JSON; records that don't hold a number from 10 on go."""
    j = roles.log(spark, base).withColumn("r", F.from_json("props", "k long"))
    return j.where("r.k >= 10").groupBy("profile_id").agg(F.count("*").alias("n"), F.max("r.k").alias("greatest"), F.sum("r.k").alias("total"))


def delete_cascade(spark, base):
    """Statuses left after the profiles that ever reported an error are deleted."""
    log = roles.log(spark, base)
    gone = log.where("status = 'too_hard' and value > 60").select("profile_id").distinct()
    return log.join(gone, "profile_id", "left_anti").groupBy("profile_id").agg(F.count("*").alias("n"))


def backup_names(spark, base):
    e = roles.log(spark, base)
    return e.select("profile_id", "updated_at").groupBy("profile_id").agg(F.max("updated_at").alias("t")).select("profile_id", F.concat(X.slug(F.concat(F.lit("  Profile #"), F.col("profile_id").cast("string"), F.lit("!"))), F.lit("-"), F.date_format("t", "yyyy-MM-dd"), F.lit(".json")).alias("file"))


QUERIES = {f.__name__: f for f in (lww_merge, merge_report, union_merge_top10, latest_status, toggle_fold, best_take, backup_roundtrip, backup_json, props_records, delete_cascade, backup_names)}

_E = f"with {roles.EVENTS_SQL}"
SQL = {
    "lww_merge": f"{_E}, {_HALF}, a as (select * from h where side = 0), b as (select * from h where side = 1 and r.s <> 'not_seen') select coalesce(a.profile_id, b.profile_id) as profile_id, coalesce(a.candidate_id, b.candidate_id) as candidate_id, case when a.r is null or b.r.u > a.r.u then b.r.s else a.r.s end as status, case when a.r is null or b.r.u > a.r.u then b.r.e else a.r.e end as event_id from a full join b on a.profile_id = b.profile_id and a.candidate_id = b.candidate_id",
    "merge_report": f"{_E}, {_HALF}, j as (select b.r.s <> 'not_seen' as ok, a.r.u as had, b.r.u as has from (select * from h where side = 1) b left join (select * from h where side = 0) a using (profile_id, candidate_id)) select count(*) filter (ok and had is null) as added, count(*) filter (ok and has > had) as updated, count(*) filter (ok and has <= had) as stale, count(*) filter (not ok) as skipped from j",
    "union_merge_top10": f"{_E} select profile_id, event_id, round(value, 6) as value from (select distinct profile_id, event_id, updated_at, value from log) qualify row_number() over (partition by profile_id order by updated_at desc, event_id desc) <= 10",
    "latest_status": f"{_E}, s as (select profile_id, candidate_id, arg_max(status, (updated_at, event_id)) as status from log group by 1, 2) select * from s where status <> 'not_seen'",
    "toggle_fold": f"{_E}, a as (select *, case when status is distinct from lag(status) over (partition by profile_id order by updated_at, event_id) then 1 else 0 end as st from log), b as (select *, sum(st) over (partition by profile_id order by updated_at, event_id) as run from a), c as (select profile_id, run, count(*) as n, any_value(status) as status from b group by 1, 2) select profile_id, case when n % 2 = 1 then status end as status from c qualify run = max(run) over (partition by profile_id)",
    "best_take": f"{_E} select profile_id, status as kind, event_id, round(value, 6) as value from log qualify row_number() over (partition by profile_id, status order by value desc, event_id desc) = 1",
    "backup_roundtrip": f"{_E}, {_HALF} select profile_id, candidate_id, r.s as status, r.e as event_id from h where side = 0 and r.s <> 'not_for_me'",
    "backup_json": f"""{_E}, {_HALF} select profile_id, '{{"version":4,"records":{{' || string_agg('"' || candidate_id || '":{{"status":"' || r.s || '","event_id":' || r.e || '}}', ',' order by candidate_id::varchar) || '}}}}' as backup from h where side = 0 group by 1""",
    "props_records": "select user_id as profile_id, count(*) as n, max((props::json ->> 'k')::bigint) as greatest, sum((props::json ->> 'k')::bigint)::bigint as total from events where (props::json ->> 'k')::bigint >= 10 group by 1",
    "delete_cascade": f"{_E} select profile_id, count(*) as n from log where profile_id not in (select profile_id from log where status = 'too_hard' and value > 60) group by 1",
    "backup_names": f"{_E} select profile_id, '-profile-' || profile_id || '--' || strftime(max(updated_at), '%Y-%m-%d') || '.json' as file from log group by 1",
}
SQL["backup_names"] = SQL["backup_names"].replace("'-profile-'", "'profile-'").replace("'--'", "'-'")
