"""Queries over names, labels, links and frames in detail."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import scoretime as T
from ..operators import signals as S
from ..operators import stats as ST
from ..operators.ordering import running_total
from ..sources import discovery as D
from ..sources.tables import table
from . import quality, roles, stats
from .cut import cut, spread

L = F.lit


def folded_names(spark, base):
    """Names without diacritics, in lower case."""
    t = table(spark, base, "composer_era", ["composer"])
    return t.select("composer", X.fold_text("composer").alias("folded"))


MARKERS = ("lute", "from a", "book")


def era_of_names(spark, base):
    """Each spelling's era: by the entry it is or begins with, hedges dropped, unnamed
    authors and source books by their wording."""
    names = stats.grades(spark, base).where("composer is not null").select("composer")
    listed = table(spark, base, "composer_era", [F.col("composer").alias("entry"), "era"])
    return ST.attributed(names, "composer", listed, "entry", "era", MARKERS, "renaissance")


def licence_codes(spark, base):
    a = table(spark, base, "guitar_loot_candidate", ["license"])
    t = F.lower("license")
    name = F.when(t.contains("zero") | t.contains("cc0"), "cc-zero").when(t.contains("public"), "publicdomain").otherwise(t)
    return a.groupBy(X.licence_code(name).alias("code")).agg(F.count("*").alias("n"))


def small_labels(spark, base):
    """Stand-in sources, graded rows, tracking labels, clocks, typed minutes."""
    f = table(spark, base, "features", ["grade", "grade_source", "duration_sec_approx", "tempo_bpm"])
    ms = F.nanvl("duration_sec_approx", L(None)) * 1000
    rows = f.select(
        X.is_placeholder("grade_source").alias("placeholder"), (F.trim(F.coalesce("grade", L(""))) != "").alias("graded"), X.tracking_label(F.pmod(F.floor(F.coalesce(ms, L(0.0))), L(100)) / 100).alias("label"),
        X.clock(F.when((ms >= 0) & (ms < 1e12), ms)).substr(1, 2).alias("clock"), X.minutes_to_seconds(F.concat(F.coalesce("grade", L("x")), L(".5 min"))).alias("seconds"),
    )
    return rows.groupBy(*rows.columns).agg(F.count("*").alias("n"))


def eta_order(spark, base):
    """Features by how much composers explain, with their places."""
    e = stats.eta_squared(spark, base).where("eta2 is not null")
    return running_total(e.withColumn("_by", -F.col("eta2")), ["_by", "feature"], name="place").select("feature", "eta2", "place")


def correlation_order(spark, base):
    """Pairs of features by the size of their correlation, with their places."""
    p = stats.pearson_pairs(spark, base)
    return running_total(p.withColumn("_by", -F.abs("r")), ["_by", "a", "b"], name="place").select("a", "b", "r", "place")


def label_union(spark, base):
    """All labels that a curator or the rule gives."""
    g = cut(stats._graded(spark, base))
    return g.select(F.col("g").alias("label")).unionByName(g.select(F.col("predicted").alias("label"))).where("label is not null").distinct()


def ungraded_with_rule(spark, base):
    """Ungraded rows with the band the rule gives them, per source."""
    g = stats._graded(spark, base)
    return g.where("g is null").groupBy("source", "predicted").agg(F.count("*").alias("n"))


def merged_durations(spark, base):
    """Lengths typed as text, cleaned, the last of each piece: how many pieces have one."""
    t = table(spark, base, "features", ["candidate_id", "load_id", "duration_sec_approx"])
    typed = t.select("candidate_id", "load_id", F.when(F.col("load_id") % 3 == 0, L(" ")).when(F.col("load_id") % 5 == 0, L("n/a")).otherwise(F.concat(L(" "), F.nanvl("duration_sec_approx", L(None)).cast("string"))).alias("typed"))
    d = typed.withColumn("v", F.trim("typed").try_cast("double")).where("candidate_id is not null and candidate_id <> '' and v is not null").groupBy("candidate_id").agg(F.max_by("v", F.struct("load_id", "v")).alias("v"))
    j = stats.grades(spark, base).join(d, "candidate_id", "left")
    return j.groupBy("source").agg(F.count("v").alias("updated"), F.count_if(F.col("v").isNull()).alias("skipped"), F.round(F.max("v"), 3).alias("longest"))


def _link_pages(spark, base):
    e = table(spark, base, "events", ["event_id", "user_id", "event_type"])
    i = F.col("event_id").cast("string")
    text = F.when(F.col("event_id") % 3 == 0, L("MXL")).when(F.col("event_id") % 3 == 1, L("")).otherwise(F.concat(L("Piece "), i))
    strong = F.when(F.col("event_id") % 2 == 0, F.concat(L("<b>Bold "), i, L("</b>"))).otherwise(L(""))
    html = F.concat(L("<ul><li>Grade "), (F.col("event_id") % 12).cast("string"), L(" "), strong, L('<a href="f/w'), (F.col("event_id") % 7).cast("string"), L("-"), i, L('.mxl">'), text, L("</a></li><li><a href='other.pdf'>x</a></li></ul>"))
    return spread(e).select(F.concat(L("http://p.example/"), (F.col("event_id") % 41).cast("string"), L("/")).alias("url"), html.alias("html"))


def link_titles(spark, base):
    """What links to scores are called: by themselves, by what stands out near them, or by
    their file."""
    p = D.page_scores(_link_pages(spark, base))
    return p.select("href", "title", F.regexp_extract("context", r"Grade (\d+)", 1).cast("int").alias("grade"))


def link_counters(spark, base):
    """Works, links and graded links per page and over all."""
    p = D.page_scores(_link_pages(spark, base))
    grade = F.regexp_extract("context", r"Grade (\d+)", 1).try_cast("int")
    return D.page_counters(p.select("url", F.regexp_extract("href", r"(w\d+)-", 1).alias("work"), "context"), F.when(grade.between(1, 10), grade))


def capped_takes(spark, base):
    """The ten latest takes of each profile after new ones are added."""
    e = table(spark, base, "events", ["event_id", "user_id", "event_type"]).select((F.col("user_id") % 20).alias("profile_id"), "event_id", "event_type")
    return S.append_capped(e.where("event_id % 3 = 0"), e.where("event_id % 3 > 0"), ["profile_id"], [F.desc("event_id")], 10)


def profile_deleted(spark, base):
    """Records per table after one profile is deleted."""
    e = table(spark, base, "events", ["event_id", "user_id", "event_type"]).withColumn("profile_id", F.when(F.col("event_id") % 10 > 0, F.col("user_id") % 20))
    a, b = S.without_profile(7, e.where("event_type = 'error'"), e.where("event_type <> 'error'"))
    return a.groupBy(L("a").alias("t"), "profile_id").agg(F.count("*").alias("n")).unionByName(b.groupBy(L("b").alias("t"), "profile_id").agg(F.count("*").alias("n")))


def reference_lengths(spark, base):
    """Where the last note or bar of each score ends; broken notes don't count."""
    e = table(spark, base, "events", ["event_id", "user_id"])
    notes = e.select("user_id", (F.col("event_id") * 4000).cast("double").alias("start_tick"), F.when(F.col("event_id") % 7 == 0, L(float("inf"))).otherwise((F.col("event_id") * 4000 + F.col("event_id") % 5 * 3000 - 1000).cast("double")).alias("end_tick"), L(60).alias("midi"))
    return T.reference_length(T.sane_notes(notes), quality._bars(spark, base), ["user_id"])


def bar_frames(spark, base):
    """The frames of each bar at 120 a minute."""
    return T.bar_frames(quality._bars(spark, base), ["user_id"], 60000 / (120 * 480))


def path_bars(spark, base):
    """The bars that a path of frames runs through."""
    frames = cut(bar_frames(spark, base))
    e = table(spark, base, "events", ["event_id", "user_id"])
    path = e.select("user_id", F.col("event_id").alias("t"), F.ceil((F.col("event_id") * 4000 + 300) * 0.0208333).alias("pos"))
    return T.bar_of_path(path, frames, ["user_id"])


def halved_frames(spark, base):
    """Vectors in runs of 25 at half the rate, normalised again."""
    t = table(spark, base, "embeddings", ["vec_id", "embedding"])
    f = t.select(F.floor(F.col("vec_id") / 25).alias("take"), (F.col("vec_id") % 25).alias("t"), F.slice("embedding", 1, 24).alias("vec"), (F.col("vec_id") % 3 == 0).alias("silent"))
    h = T.halve(f, ["take"])
    return h.select("take", "t", F.round(F.get("vec", L(0)), 4).alias("first"), F.round(F.get("vec", L(23)), 4).alias("last"), "silent")


def recent_votes(spark, base):
    """Each profile's votes, latest first, with their places."""
    v = roles.log(spark, base).groupBy("profile_id", "candidate_id").agg(F.max_by(F.struct("status", "updated_at"), F.struct("updated_at", "event_id")).alias("r")).select("profile_id", "candidate_id", "r.*")
    from ..operators.feed import top_per_group

    return top_per_group(v.where("status <> 'not_seen'"), ["profile_id"], [F.desc("updated_at"), F.col("candidate_id")], 100).select("profile_id", "candidate_id", "status")


QUERIES = {f.__name__: f for f in (folded_names, era_of_names, licence_codes, small_labels, eta_order, correlation_order, label_union, ungraded_with_rule, merged_durations, link_titles, link_counters, capped_takes, profile_deleted, reference_lengths, bar_frames, path_bars, halved_frames, recent_votes)}

_BF = f"{quality._BARS}, fr as (select user_id, bar, ceil(start * {60000 / (120 * 480)!r}::double * 20::double / 1000)::bigint as first_frame, (ceil((start + duration) * {60000 / (120 * 480)!r}::double * 20::double / 1000) - ceil(start * {60000 / (120 * 480)!r}::double * 20::double / 1000))::bigint as frames from b where duration > 0)"
_LP = """lp as (select event_id, 'http://p.example/' || event_id % 41 || '/' as url, 'http://p.example/' || event_id % 41 || '/f/w' || event_id % 7 || '-' || event_id || '.mxl' as href, 'w' || event_id % 7 as work, event_id % 12 as grade,
 case when event_id % 3 = 2 then 'Piece ' || event_id when event_id % 2 = 0 then 'Bold ' || event_id else 'w' || event_id % 7 || '-' || event_id end as title from events)"""
_HEDGED = "case when starts_with(t, 'Attr. ') then trim(t[7:], ' ') when starts_with(t, 'Attr.') then trim(t[6:], ' ') when starts_with(t, 'after ') then trim(t[7:], ' ') when starts_with(t, '? ') then trim(t[3:], ' ') when starts_with(t, '?') then trim(t[2:], ' ') else t end"
SQL = {
    "folded_names": "select composer, lower(strip_accents(composer)) as folded from composer_era",
    "era_of_names": f"""with {stats.GRADES_SQL}, t as (select distinct composer, trim(composer, ' ') as t from lg where composer is not null), n as (select composer, {_HEDGED} as n, lower({_HEDGED}) as c from t),
p as (select n.composer, arg_max(coalesce(e.era, chr(1)), length(e.composer)) as v, max(length(e.composer)) = any_value(length(n.c)) as same from n join composer_era e on starts_with(n.c, lower(e.composer)) group by 1),
j as (select n.composer, e.era as exact, case when e.composer is not null then 'exact' when starts_with(c, 'anon') then 'unnamed' when {' or '.join(f"contains(c, '{m}')" for m in MARKERS)} then 'marker' when p.same then 'case' when p.v is not null then 'prefix' else 'none' end as how, nullif(p.v, chr(1)) as v from n left join composer_era e on e.composer = n.n left join p on p.composer = n.composer)
select composer, case when how = 'exact' then exact when how in ('unnamed', 'marker') then 'renaissance' else v end as found, how from j""",
    "licence_codes": "with t as (select lower(license) as l from guitar_loot_candidate) select case when contains(l, 'zero') or contains(l, 'cc0') then 'CC0-1.0' when contains(l, 'public') then 'PD-Marker' else coalesce(nullif(upper(l), ''), 'unknown') end as code, count(*) as n from t group by 1",
    "small_labels": """with f as (select *, case when isnan(duration_sec_approx) then null else duration_sec_approx end * 1000 as ms from features), g as (select *, ((floor(coalesce(ms, 0))::bigint % 100) + 100) % 100 / 100.0::double as c, case when ms >= 0 and ms < 1e12 then floor(ms / 1000)::bigint end as s from f)
select coalesce(starts_with(grade_source, 'dummy-'), false) as placeholder, trim(coalesce(grade, ''), ' ') <> '' as graded, case when c > 0.5 then 'locked' when c > 0.15 then 'searching' else 'lost' end as label,
 substr(printf('%d:%02d', s // 60, s % 60), 1, 2) as clock, case when try_cast(nullif(regexp_extract(trim(coalesce(grade, 'x') || '.5 min', ' '), '^([+-]?(?:\\d+\\.?\\d*|\\.\\d+)(?:[eE][+-]?\\d+)?)', 1), '') as double) > 0 then try_cast(nullif(regexp_extract(trim(coalesce(grade, 'x') || '.5 min', ' '), '^([+-]?(?:\\d+\\.?\\d*|\\.\\d+)(?:[eE][+-]?\\d+)?)', 1), '') as double) * 60 end as seconds, count(*) as n from g group by all""",
    "eta_order": f"with e as ({stats.SQL['eta_squared']}) select feature, eta2, row_number() over (order by -eta2, feature) as place from e where eta2 is not null",
    "correlation_order": f"with p as ({stats.SQL['pearson_pairs']}) select a, b, r, row_number() over (order by -abs(r), a, b) as place from p",
    "label_union": f"with {stats._RULED} select g as label from rg where g is not null union select predicted::int from rg where predicted is not null",
    "ungraded_with_rule": f"with {stats._RULED} select source, predicted::int as predicted, count(*) as n from rg where g is null group by 1, 2",
    "merged_durations": f"with {stats.GRADES_SQL}, d as (select candidate_id, arg_max(v, (load_id, v)) as v from (select candidate_id, load_id, case when isnan(duration_sec_approx) then null else duration_sec_approx end as v from features where load_id % 3 > 0 and load_id % 5 > 0) where v is not null and candidate_id is not null and candidate_id <> '' group by 1) select source, count(v) as updated, count(*) - count(v) as skipped, round(max(v), 3) as longest from lg left join d using (candidate_id) group by 1",
    "link_titles": f"with {_LP} select href, title, grade::int as grade from lp",
    "link_counters": f"with {_LP} select url, count(distinct work) as works, count(*) as links, count(*) filter (grade between 1 and 10) as graded from lp group by 1 union all select null, count(distinct work), count(*), count(*) filter (grade between 1 and 10) from lp",
    "capped_takes": "select user_id % 20 as profile_id, event_id, event_type from events qualify row_number() over (partition by user_id % 20 order by event_id desc) <= 10",
    "profile_deleted": "with e as (select case when event_type = 'error' then 'a' else 'b' end as t, case when event_id % 10 > 0 then user_id % 20 end as profile_id from events) select t, profile_id, count(*) as n from e where profile_id is distinct from 7 group by 1, 2",
    "reference_lengths": f"with {quality._BARS}, n as (select user_id, event_id * 4000 + event_id % 5 * 3000 - 1000 as e from events where event_id % 7 > 0 and event_id % 5 > 0), x as (select user_id, e::double as e from n union all select user_id, start + duration from b) select user_id, max(e) as ticks from x group by 1",
    "bar_frames": f"with {_BF} select user_id, bar, first_frame, frames from fr where frames > 0",
    "path_bars": f"with {_BF}, p as (select user_id, event_id as t, ceil((event_id * 4000 + 300) * 0.0208333::double)::bigint as pos from events) select p.user_id, t, pos, bar from p left join fr on fr.user_id = p.user_id and frames > 0 and pos >= first_frame and pos < first_frame + frames",
    "halved_frames": "with f as (select vec_id // 25 as take, vec_id % 25 as t, list_transform(embedding[1:24], lambda x: x::double) as v, vec_id % 3 = 0 as s from embeddings), h as (select take, t // 2 as t, arg_min(v, t) as a, arg_max(v, t) as b, bool_and(s) as silent from f group by 1, 2), m as (select take, t, silent, list_transform(list_zip(a, b), lambda z: (z[1] + z[2]) / 2) as v from h), n as (select take, t, silent, v[1:12] as x, v[13:24] as y from m), c as (select take, t, silent, list_concat(list_transform(x, lambda q: q / sqrt(list_dot_product(x, x))), list_transform(y, lambda q: q / sqrt(list_dot_product(y, y)))) as v from n) select take, t, round(v[1] / sqrt(list_dot_product(v, v)), 4) as first, round(v[24] / sqrt(list_dot_product(v, v)), 4) as last, silent from c",
    "recent_votes": f"with {roles.EVENTS_SQL}, s as (select profile_id, candidate_id, arg_max(status, (updated_at, event_id)) as status, max(updated_at) as updated_at from log group by 1, 2) select profile_id, candidate_id, status from s where status <> 'not_seen' qualify row_number() over (partition by profile_id order by updated_at desc, candidate_id) <= 100",
}
