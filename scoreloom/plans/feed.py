"""Discovery queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.exprs import format_duration
from ..operators import feed as op
from . import roles


def resolve_grade(spark, base):
    return op.with_grade(roles.pieces(spark, base)).select("candidate_id", "kind", "resolved", "g")


def apply_filters_all(spark, base):
    p = roles.pieces(spark, base)
    f = op.apply_filters(p, query=" a", composer="brand#1", max_duration=950.0, kind="model", low=3, high=8)
    return f.select("candidate_id", "title", "composer", "g")


def apply_filters_era(spark, base):
    p = roles.pieces(spark, base)
    era = p.agg(F.min("era").alias("e"))
    return op.apply_filters(p, kind="curator", low=5).join(F.broadcast(era), F.col("era") == F.col("e")).select("candidate_id", "era", "g")


def build_feed(spark, base):
    return op.build_feed(roles.pieces(spark, base), roles.statuses(spark, base), 5)


def feed_split(spark, base):
    f = build_feed(spark, base)
    return f.groupBy(F.when(F.col("g") == 5, "at level").otherwise("stretch").alias("part")).agg(F.count("*").alias("n"), F.min("place").alias("first_place"))


def list_composers(spark, base):
    return op.facet(roles.pieces(spark, base), "composer")


def browse_page(spark, base):
    """The first page of a hundred, by composer then title, in the order of a language."""
    return roles.pieces(spark, base).select("candidate_id", "composer", "title", format_duration("duration").alias("length")).orderBy(F.collate("composer", "UNICODE"), F.collate("title", "UNICODE"), "candidate_id").limit(100)


def onboard_examples(spark, base):
    """Two examples per grade: curated ones where there are any, else all."""
    g = op.with_grade(roles.pieces(spark, base)).where("g between 1 and 10")
    pool = g.withColumn("any_curated", F.max((F.col("kind") == "curator").cast("int")).over(Window.partitionBy("g"))).where("any_curated = 0 or kind = 'curator'")
    return op.top_per_group(pool, ["g"], [F.col("pos")], 2).select("g", "candidate_id", "kind")


def library_counts(spark, base):
    """Pieces per profile and status, all statuses present."""
    s = roles.log(spark, base).groupBy("profile_id", "candidate_id").agg(F.max_by("status", F.struct("updated_at", "event_id")).alias("status"))
    kinds = sorted(roles.STATUS.values())
    return s.groupBy("profile_id").pivot("status", kinds).count().na.fill(0, kinds)


def library_rows(spark, base):
    """What a profile has seen, latest first, with the piece it is of."""
    s = roles.log(spark, base).groupBy("profile_id", "candidate_id").agg(F.max_by(F.struct("status", "updated_at"), F.struct("updated_at", "event_id")).alias("s"))
    seen = s.select("profile_id", "candidate_id", "s.*").where("status <> 'not_seen'")
    return op.top_per_group(seen.join(roles.pieces(spark, base), "candidate_id"), ["profile_id"], [F.desc("updated_at"), F.col("candidate_id")], 5).select("profile_id", "candidate_id", "status", "title")


def too_hard_groups(spark, base):
    j = roles.pieces(spark, base).join(roles.statuses(spark, base), "candidate_id", "left")
    return j.groupBy("composer").agg(F.count_if(F.col("status") == "too_hard").alias("n_hard"), F.count("*").alias("n"))


QUERIES = {
    "resolve_grade": resolve_grade, "apply_filters": apply_filters_all, "apply_filters_era": apply_filters_era, "build_feed": build_feed, "feed_split": feed_split,
    "list_composers": list_composers, "browse_page": browse_page, "onboard_examples": onboard_examples, "library_counts": library_counts, "library_rows": library_rows,
    "too_hard_groups": too_hard_groups,
}

_FEED = f"""with {roles.PIECES_SQL}, {roles.LATEST_SQL},
al as (select p.*, s.status from graded p left join statuses s using (candidate_id)),
downs as (select composer, count(*) as downs from al where status = 'too_hard' group by 1),
m as (select * from al where coalesce(status, '') not in ('too_hard', 'not_for_me') and g in (5, 6)),
r as (select *, row_number() over (partition by composer order by case when status = 'completed' then 1 else 0 end, title, pos) as turn from m),
gr as (select m.composer, count(*) as size, min(pos) as seen, coalesce(any_value(downs), 0) as downs from m left join downs using (composer) group by 1),
f as (select r.*, row_number() over (order by turn, case when downs >= 2 then 1 else 0 end, size desc, seen) as place from r join gr using (composer)
 where turn <= greatest(3, ceil(30.0 / greatest((select count(*) from gr), 1)))),
feed as (select place, candidate_id, title, composer, g from f where place <= 30)"""

_PER = f"with {roles.PIECES_SQL}, {roles.EVENTS_SQL}, s as (select profile_id, candidate_id, arg_max(status, (updated_at, event_id)) as status, max(updated_at) as updated_at from log group by 1, 2)"

SQL = {
    "resolve_grade": f"with {roles.PIECES_SQL} select candidate_id, kind, resolved, g from graded",
    "apply_filters": f"with {roles.PIECES_SQL} select candidate_id, title, composer, g from graded where contains(lower(title || ' ' || composer), 'a') and contains(lower(composer), 'brand#1') and duration <= 950 and kind = 'model' and g between 3 and 8",
    "apply_filters_era": f"with {roles.PIECES_SQL} select candidate_id, era, g from graded where era = (select min(era) from pieces) and kind = 'curator' and g >= 5",
    "build_feed": f"{_FEED} select * from feed",
    "feed_split": f"{_FEED} select case when g = 5 then 'at level' else 'stretch' end as part, count(*) as n, min(place) as first_place from feed group by 1",
    "list_composers": f"with {roles.PIECES_SQL} select coalesce(composer, '?') as composer, count(*) as n from pieces group by 1",
    "browse_page": f"with {roles.PIECES_SQL} select candidate_id, composer, title, case when duration > 0 then printf('%d:%02d', floor(duration + 0.5)::bigint // 60, floor(duration + 0.5)::bigint % 60) else '—' end as length from pieces order by composer, title, candidate_id limit 100",
    "onboard_examples": f"with {roles.PIECES_SQL}, q as (select *, max(case when kind = 'curator' then 1 else 0 end) over (partition by g) as c from graded where g between 1 and 10) select g, candidate_id, kind from q where c = 0 or kind = 'curator' qualify row_number() over (partition by g order by pos) <= 2",
    "library_counts": _PER + " select profile_id, " + ", ".join(f"count(*) filter (status = '{k}') as {k}" for k in sorted(roles.STATUS.values())) + " from s group by 1",
    "library_rows": _PER + " select profile_id, candidate_id, status, title from s join pieces using (candidate_id) where status <> 'not_seen' qualify row_number() over (partition by profile_id order by updated_at desc, candidate_id) <= 5",
    "too_hard_groups": f"with {roles.PIECES_SQL}, {roles.LATEST_SQL} select composer, count(*) filter (status = 'too_hard') as n_hard, count(*) as n from pieces left join statuses using (candidate_id) group by 1",
}
