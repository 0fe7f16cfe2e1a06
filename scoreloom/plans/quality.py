"""Queries over finished manifests, profiles and score time."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profiles as P
from ..operators import quality as Q
from ..operators import scoretime as T
from ..operators import temporal
from ..sources.tables import table
from . import ingest, stats
from .cut import cut

L = F.lit


def _manifest(spark, base):
    """The advisor's pieces with the latest length of each."""
    d = stats.fx(spark, base, ["duration_sec_approx"]).where("duration_sec_approx is not null").groupBy("candidate_id").agg(F.max_by("duration_sec_approx", "load_id").alias("duration"))
    return stats.grades(spark, base).join(d, "candidate_id", "left").withColumnRenamed("dummy_grade", "grade")


_MANIFEST = f"{stats._fx_sql(['duration_sec_approx'])}, {stats.GRADES_SQL}, du as (select candidate_id, arg_max(duration_sec_approx, load_id) as duration from fx where duration_sec_approx is not null group by 1), mf as (select lg.* exclude (dummy_grade), dummy_grade as grade, duration from lg left join du using (candidate_id))"


def consensus_summary(spark, base):
    return Q.consensus_summary(stats.probe_consensus(spark, base))


def feed_counts(spark, base):
    return Q.feed_counts(_manifest(spark, base))


def feed_quality(spark, base):
    q = Q.feed_quality(cut(_manifest(spark, base)))
    return q.select(*[F.round(c, 6).alias(c) if c in ("least", "greatest") else F.col(c) for c in q.columns])


def sample_counts(spark, base):
    """The graded sample by era and by grade, in one pass."""
    g = stats.grades(spark, base)
    return g.groupingSets([["era"], ["dummy_grade"]], "era", "dummy_grade").agg(F.count("*").alias("n"), F.grouping_id().cast("int").alias("gid"))


def manifest_order(spark, base):
    """The pieces' places in the manifest, by id in byte order."""
    return Q.numbered(stats.grades(spark, base).select("candidate_id"), ["candidate_id"])


def reject_order(spark, base):
    """The rejected documents' places in the report, by code and id."""
    return Q.numbered(ingest.gate_chain(spark, base).where("code is not null").select("code", "doc_id"), ["code", "doc_id"])


def grade_order(spark, base):
    """Typed grades by their number, others last."""
    g = table(spark, base, "features", ["grade"]).where("grade is not null").groupBy("grade").agg(F.count("*").alias("n"))
    return Q.numbered(g.withColumn("rank", Q.grade_rank(F.col("grade"))), ["rank", "grade"]).select("grade", "n", "rank", "place")


def best_worst(spark, base):
    """The five pieces on which rule and curator agree best, and the five worst."""
    j = stats._graded(spark, base).where("g is not null and predicted is not null").select("candidate_id", "load_id", "g", "predicted")
    return Q.both_ends(j, F.abs(F.col("g") - F.col("predicted")), ["candidate_id", "load_id"])


def _syllabi(spark, base):
    t = stats.grades(spark, base).where("composer is not null")
    rows = F.array_sort(F.collect_list(F.struct("candidate_id", "dummy_grade")))
    return t.groupBy("source", "era").agg(F.array_sort(F.collect_set(F.when(F.pmod(F.col("dummy_grade"), L(3)) > 0, F.col("dummy_grade")))).alias("grades"), rows.alias("r")).select(F.concat_ws("/", "source", "era").alias("name"), "grades", F.transform("r", lambda x: F.struct(x["candidate_id"].alias("title"), x["dummy_grade"].alias("grade"))).alias("pieces"))


def syllabus_violations(spark, base):
    """Pieces whose grade their syllabus doesn't declare."""
    v = Q.undeclared_grades(_syllabi(spark, base))
    return v.groupBy("name", "grade").agg(F.count("*").alias("n"), F.min("place").alias("first_place"))


def piece_by_id(spark, base):
    """One piece looked up; the filter reaches the scan."""
    t = table(spark, base, "part", ["p_partkey", "p_name", "p_brand"])
    return t.where("p_partkey = 17").limit(1)


def shown_labels(spark, base):
    """How grades, levels and statuses are shown."""
    e = table(spark, base, "events", ["event_id", "user_id"])
    kind = F.element_at(F.array(L("none"), L("curator"), L("model")), (F.col("event_id") % 3 + 1).cast("int"))
    g = (F.col("user_id") % 11).cast("int")
    status = F.element_at(F.array(*[L(s) for s in (*Q.STATUS_LABELS, "other")]), (F.col("event_id") % 6 + 1).cast("int"))
    rows = e.select(Q.grade_badge(kind, F.when(g > 0, g), F.col("event_id") % 2 == 0).alias("badge"), Q.level_hint(g).alias("hint"), Q.status_chip(status).alias("chip"))
    return rows.groupBy("badge", "hint", "chip").agg(F.count("*").alias("n"))


def clef_check(spark, base):
    """Entries that hold a score, and how many of them have a clef for guitar."""
    e = table(spark, base, "events", ["event_id", "user_id"])
    clefs = F.when(F.col("event_id") % 7 > 0, F.array_compact(F.array(F.when(F.col("event_id") % 2 == 0, "F"), F.when(F.col("user_id") % 3 == 0, "G"), F.when(F.col("event_id") % 5 == 0, "TAB"))))
    entries = e.select((F.col("event_id") % 6 == 0).alias("container"), F.when(F.col("user_id") % 10 == 0, "container").alias("status"), clefs.alias("clefs"))
    return Q.without_containers(entries).groupBy(Q.clef_suits(F.col("clefs")).alias("suits")).agg(F.count("*").alias("n"))


# score time ---------------------------------------------------------------------

def _bars(spark, base):
    """A score a user: its events are bars in order, of lengths that follow from them."""
    e = table(spark, base, "events", ["event_id", "user_id"])
    num, den = F.col("event_id") % 4 + 2, F.when(F.col("event_id") % 3 == 0, 8).otherwise(4)
    length = F.when(F.col("event_id") % 9 == 0, 0).otherwise(num * 4 * 480 / den)
    return e.select("user_id", F.col("event_id").alias("bar"), (F.col("event_id") * 4000).cast("double").alias("start"), length.cast("double").alias("duration"), num.alias("numerator"), den.alias("denominator"))


def ticks_per_quarter(spark, base):
    return T.ticks_per_quarter(_bars(spark, base), ["user_id"])


def loop_ranges(spark, base):
    """From where to where some bars of each score sound, where they are a range of it."""
    s = T.bar_spans(_bars(spark, base), ["user_id"])
    first, last = (F.col("user_id") % 5).cast("int"), (F.col("user_id") % 7 + 1).cast("int")
    return s.withColumn("r", T.loop_range(F.col("starts"), F.col("durations"), first, last)).select("user_id", "r.start_tick", "r.end_tick")


def frame_ticks(spark, base):
    """The ticks of frames before, within and past each score."""
    s = T.bar_spans(_bars(spark, base), ["user_id"])
    frames = s.select("user_id", "starts", F.explode(F.array(*[L(k) for k in (-3, 0, 2, 100_000)])).alias("frame"))
    return frames.select("user_id", "frame", T.tick_at_frame(F.col("starts"), F.col("frame")).alias("tick"))


def score_notes(spark, base):
    """The sounding notes of scores: no rests, muted or ghost notes."""
    e = table(spark, base, "events", ["event_id", "user_id", "event_type"])
    note = lambda k: F.struct((40 + (F.col("event_id") + k) % 30).cast("int").alias("midi"), (F.col("event_id") % 5 == k).alias("dead"), F.when(F.col("event_id") % 6 > 0, F.col("event_id") % 6 == k).alias("ghost"))
    beats = e.select("user_id", (F.col("event_id") * 10).alias("start"), (F.col("event_id") % 4 * 5).alias("duration"), (F.col("event_type") == "error").alias("rest"), F.array(note(1), note(2)).alias("notes"))
    return T.sounding_notes(beats, ["user_id"]).groupBy("user_id").agg(F.count("*").alias("n"), F.sum("midi").alias("pitches"), F.min("start_tick").alias("first"), F.max("end_tick").alias("last"))


def score_tempi(spark, base):
    """Tempo segments of scores with automations within their bars."""
    e = table(spark, base, "events", ["event_id", "user_id"])
    scores = e.groupBy("user_id").agg((60 + F.col("user_id") % 40).alias("tempo"))
    autos = e.select("user_id", F.col("event_id").alias("bar"), (F.col("event_id") * 100).alias("start"), L(100).alias("duration"), (F.col("event_id") % 4 / 4).alias("ratio"), (50 + F.col("event_id") % 100).alias("bpm"), F.when(F.col("event_id") % 3 == 0, "tempo").otherwise("volume").alias("kind"))
    seg = temporal.tempo_segments(T.tempo_changes(scores, autos, ["user_id"]), ["user_id"], 480, 120.0)
    return seg.select("user_id", "start_tick", F.round("ms_per_tick", 6).alias("ms_per_tick"))


def pitch_bins(spark, base):
    """Two resolutions of spectrum; in the coarse one low pitches share their nearest bin."""
    return T.pitch_bins(spark, 48000.0, 16384).withColumn("size", L(16384)).unionByName(T.pitch_bins(spark, 44100.0, 2048).withColumn("size", L(2048)))


def spectrum_chroma(spark, base):
    """Pitch classes of spectra made from the vectors, silence and broken levels among them."""
    t = table(spark, base, "embeddings", ["vec_id", "embedding"])
    db = F.transform(F.slice("embedding", 1, 48), lambda x, i: F.when(i % 13 == 5, F.lit(float("nan"))).when(i % 11 == 3, F.lit(float("-inf"))).otherwise(x.cast("double") * 40 - 60))
    return T.spectrum_chroma(t.select("vec_id", db.alias("db")), "vec_id", "db", T.pitch_bins(spark, 4000.0, 96)).select("vec_id", "slot", F.round("weight", 6).alias("weight"))


# profiles -----------------------------------------------------------------------

def _ops(spark, base):
    e = table(spark, base, "events", ["event_id", "user_id", "value"])
    op = F.element_at(F.array(L("create"), L("update"), L("update"), L("delete"), L("update")), (F.col("event_id") % 5 + 1).cast("int"))
    op = F.when((op == "delete") & (F.col("user_id") % 3 > 0), "update").otherwise(op)
    name = F.when(F.col("event_id") % 7 == 0, L("  ")).when(F.col("event_id") % 4 == 0, F.concat(L(" n"), F.col("event_id").cast("string")))
    return e.select((F.col("user_id") % 400).alias("owner"), F.col("user_id").alias("id"), F.col("event_id").alias("seq"), op.alias("op"), name.alias("display_name"), F.floor("value").cast("int").alias("level"), (F.col("event_id") % 2 == 0).alias("sets_level"))


def profile_state(spark, base):
    return P.profile_state(_ops(spark, base))


def _profiles(spark, base):
    s = P.profile_state(_ops(spark, base)).withColumn("owner", F.col("id") % 400)
    u = table(spark, base, "events", ["user_id"]).select((F.col("user_id") % 400).alias("owner")).distinct()
    legacy = u.select("owner", F.when(F.col("owner") % 4 > 0, F.concat((F.col("owner") % 14).cast("string"), L("b"))).alias("legacy_level"))
    return P.seeded(s.select("owner", F.col("id").cast("string").alias("id"), "display_name", "level", "created"), legacy)


def active_profiles(spark, base):
    """Each owner's profile: the one pointed at, the first, or one seeded from before."""
    p = cut(_profiles(spark, base))
    pointers = p.groupBy("owner").agg(F.max("id").alias("m")).select("owner", F.when(F.col("owner") % 3 == 0, F.col("m")).when(F.col("owner") % 3 == 1, "gone").alias("active"))
    return P.active_profile(p, pointers)


def saved_levels(spark, base):
    """Levels after saves, of which those out of bounds change nothing."""
    e = table(spark, base, "events", ["event_id", "user_id", "value"])
    wanted = e.select((F.col("user_id") % 400).alias("owner"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 6 > 0, F.col("value") / 10).alias("level"))
    return P.saved_levels(active_profiles(spark, base).select("owner", "id", "level"), wanted)


def records_of_profile(spark, base):
    e = table(spark, base, "events", ["event_id", "user_id", "event_type"])
    return P.of_profile(e.select(F.col("user_id").alias("profile_id"), "event_id", "event_type"), 7)


def default_statuses(spark, base):
    p = table(spark, base, "part", [F.col("p_partkey").alias("candidate_id")])
    s = table(spark, base, "events", ["event_id", "user_id", "event_type"]).groupBy(F.col("user_id").alias("candidate_id")).agg(F.max_by("event_type", "event_id").alias("status"))
    return P.status_or_default(p, s).groupBy("status").agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (consensus_summary, feed_counts, feed_quality, sample_counts, manifest_order, reject_order, grade_order, best_worst, syllabus_violations, piece_by_id, shown_labels, clef_check, ticks_per_quarter, loop_ranges, frame_ticks, score_notes, score_tempi, pitch_bins, spectrum_chroma, profile_state, active_profiles, saved_levels, records_of_profile, default_statuses)
}

_BARS = "b as (select user_id, event_id as bar, event_id * 4000.0::double as start, event_id % 4 + 2 as num, case when event_id % 3 = 0 then 8 else 4 end as den, case when event_id % 9 = 0 then 0 else (event_id % 4 + 2) * 4 * 480 / case when event_id % 3 = 0 then 8 else 4 end end::double as duration from events)"


def _bins(rate, size):
    hz, n = rate / size, size // 2
    f = lambda d: f"440::double * pow(2::double, (m {d} - 69)::double / 12) / {hz!r}::double"
    return f"(select m as midi, case when m >= 64 then 12 else 0 end + m % 12 as slot, greatest(ceil({f('- 0.5')}), 0)::int as lo, least(ceil({f('+ 0.5')}), {n})::int as hi, least(greatest(floor({f('')} + 0.5), 0), {n - 1})::int as near from (select unnest(generate_series(40, 96))::int as m))"


_OPS = """o as (select user_id as id, event_id as seq, case when (['create', 'update', 'update', 'delete', 'update'])[event_id % 5 + 1] = 'delete' and user_id % 3 > 0 then 'update' else (['create', 'update', 'update', 'delete', 'update'])[event_id % 5 + 1] end as op,
 case when event_id % 7 = 0 then '  ' when event_id % 4 = 0 then ' n' || event_id end as raw, floor(value)::int as level, event_id % 2 = 0 as sets from events),
n as (select *, nullif(trim(coalesce(raw, '')), '') as name from o),
li as (select id, min(seq) filter (op = 'create' and name is not null) as born, min(seq) filter (op = 'delete') as gone from n group by 1),
va as (select n.*, born from n join li using (id) where born is not null and (gone is null or gone < born) and seq >= born and (op = 'create' and seq = born or op = 'update' and (raw is null or name is not null))),
ps as (select id, arg_max(name, seq) filter (name is not null) as display_name, nullif(arg_max(case when level between 1 and 10 then level else -1 end, seq) filter (op = 'create' or sets), -1) as level, min(born) as created from va group by 1)"""
_SEED = f"""{_OPS}, ow as (select distinct user_id % 400 as owner from events),
pr as (select id % 400 as owner, id::varchar as id, display_name, level, created from ps union all
 select owner, 'p_' || md5(owner::varchar)[1:12], 'You', case when owner % 4 > 0 and owner % 14 between 1 and 10 then owner % 14 end, 0 from ow where owner not in (select id % 400 from ps)),
pt as (select owner, case owner % 3 when 0 then max(id) when 1 then 'gone' end as active from pr group by 1),
ac as (select owner, id, display_name, level from pr join pt using (owner) qualify row_number() over (partition by owner order by case when id = active then 0 else 1 end, created, id) = 1)"""

SQL = {
    "consensus_summary": f"with j as ({stats.SQL['probe_consensus']}) select count(*) as probes, count(delta) as scored, count(*) - count(delta) as unscored, count(*) filter (abs(delta) <= 1) as within_one, count(*) filter (abs(delta) <= 2) as within_two, round(avg(abs(delta)), 6) as mean_abs_delta from j",
    "feed_counts": f"with {_MANIFEST}, c as (select 'composer' as kind, coalesce(composer, '?') as value, count(*) as n from mf group by 2 order by n desc, value limit 10) select 'grade' as kind, coalesce(grade::varchar, '(missing)') as value, count(*) as n from mf group by 2 union all select 'era', coalesce(era, '(missing)'), count(*) from mf group by 2 union all select * from c",
    "feed_quality": f"with {_MANIFEST}, d as (select list_sort(list(duration)) as v, count(*) as n from mf where duration is not null), q as (select " + ", ".join(f"round(v[j{k}] + (v[j{k} + 1] - v[j{k}]) * ({k} * (n + 1) / 4 - j{k}), 6) as q{k}" for k in (1, 2, 3)) + ", round(v[1], 6) as least, round(v[n], 6) as greatest from (select *, " + ", ".join(f"greatest(1, least(floor({k} * (n + 1) / 4), n - 1))::bigint as j{k}" for k in (1, 2, 3)) + " from d)) select count(*) as pieces, count(grade) as graded, count(*) filter (grade in (3, 4, 5, 6)) as central, count(*) filter (grade in (3, 4, 5, 6)) >= 20 as enough, count(distinct coalesce(composer, '?')) as composers, count(*) filter (era is null) as no_era, count(*) filter (duration is null) as no_duration, any_value(least) as least, any_value(q1) as q1, any_value(q2) as q2, any_value(q3) as q3, any_value(greatest) as greatest from mf, q",
    "sample_counts": f"with {stats.GRADES_SQL} select era, dummy_grade, count(*) as n, grouping(era, dummy_grade)::int as gid from lg group by grouping sets ((era), (dummy_grade))",
    "manifest_order": f"with {stats.GRADES_SQL} select candidate_id, row_number() over (order by candidate_id) as place from lg",
    "reject_order": f"with g as ({ingest.SQL['gate_chain']}) select code, doc_id, row_number() over (order by code, doc_id) as place from g where code is not null",
    "grade_order": "with g as (select grade, count(*) as n, case when regexp_full_match(grade, '[0-9]+') then coalesce(try_cast(grade as int), 99) else 99 end as rank from features where grade is not null group by 1) select grade, n, rank, row_number() over (order by rank, grade) as place from g",
    "best_worst": f"with {stats._RULED}, k as (select candidate_id, load_id, g, predicted::int as predicted, abs(g - predicted::int) as d from rg where g is not null and predicted is not null) select 'best' as \"end\", row_number() over (order by d, candidate_id, load_id) as place, candidate_id, load_id, g, predicted from k qualify place <= 5 union all select 'worst', row_number() over (order by d desc, candidate_id desc, load_id desc) as place, candidate_id, load_id, g, predicted from k qualify place <= 5",
    "syllabus_violations": f"with {stats.GRADES_SQL}, s as (select concat_ws('/', source, era) as name, source, era, dummy_grade as grade, row_number() over (partition by source, era order by candidate_id, dummy_grade nulls first) - 1 as place from lg where composer is not null), d as (select distinct source, era, grade from s where grade % 3 > 0) select name, s.grade, count(*) as n, min(place)::int as first_place from s where not exists (select 1 from d where d.source is not distinct from s.source and d.era is not distinct from s.era and d.grade = s.grade) group by 1, 2",
    "piece_by_id": "select p_partkey, p_name, p_brand from part where p_partkey = 17",
    "shown_labels": "with r as (select event_id % 3 as k, nullif(user_id % 11, 0) as g, user_id % 11 as l, event_id from events) select case when k = 0 or g is null then '—' when k = 1 then 'G' || g when event_id % 2 = 0 then 'G' || g || ' (placeholder)' else 'G' || g || ' (estimated)' end as badge, case when l <= 2 then 'very early' when l <= 4 then 'beginner' when l <= 6 then 'intermediate' when l <= 8 then 'advanced' else 'concert' end as hint, (['', 'playing', 'completed', 'too hard', 'skipped', ''])[event_id % 6 + 1] as chip, count(*) as n from r group by 1, 2, 3",
    "clef_check": "select event_id % 7 > 0 and user_id % 3 = 0 as suits, count(*) as n from events where event_id % 6 > 0 and user_id % 10 > 0 group by 1",
    "ticks_per_quarter": f"with {_BARS} select user_id, coalesce(arg_min(duration * den / (num * 4), bar) filter (duration > 0), 960)::double as tpq from b group by 1",
    "loop_ranges": f"with {_BARS}, s as (select user_id, list(start order by bar) as s, list(duration order by bar) as d, user_id % 5 as f, user_id % 7 + 1 as l from b group by 1) select user_id, case when f >= 1 and l >= f and l <= len(s) then s[f] end as start_tick, case when f >= 1 and l >= f and l <= len(s) then s[l] + d[l] end as end_tick from s",
    "frame_ticks": f"with {_BARS}, s as (select user_id, list(start order by bar) as s from b group by 1), f as (select user_id, s, unnest([-3, 0, 2, 100000]) as frame from s) select user_id, frame, s[greatest(0, least(frame, len(s) - 1)) + 1] as tick from f",
    "score_notes": "with e as (select *, unnest([1, 2]) as k from events where event_type <> 'error' and event_id % 4 > 0) select user_id, count(*) as n, sum(40 + (event_id + k) % 30)::bigint as pitches, min(event_id * 10) as first, max(event_id * 10 + event_id % 4 * 5) as last from e where event_id % 5 <> k and (event_id % 6 = 0 or event_id % 6 <> k) group by 1",
    "score_tempi": "with c as (select user_id, 0::double as tick, 60 + user_id % 40 as bpm, -1 as seq from events group by all union all select user_id, event_id * 100 + event_id % 4 / 4 * 100, 50 + event_id % 100, event_id from events where event_id % 3 = 0), t as (select user_id, tick, arg_max(bpm, seq) as bpm from c group by 1, 2) select user_id, tick as start_tick, round(60000::double / (bpm * 480), 6) as ms_per_tick from t",
    "pitch_bins": " union all ".join(f"select midi, slot, case when hi > lo then lo else near end as first, case when hi > lo then hi else near + 1 end as last, {size} as size from {_bins(rate, size)}" for rate, size in ((48000.0, 16384), (44100.0, 2048))),
    "spectrum_chroma": f"with p as (select slot, unnest(generate_series(case when hi > lo then lo else near end, case when hi > lo then hi - 1 else near end)) as bin from {_bins(4000.0, 96)}), e as (select vec_id, unnest(embedding[1:48])::double * 40 - 60 as d, unnest(generate_series(0, 47)) as bin from embeddings) select vec_id, slot, round(sum(pow(10::double, d / 20)), 6) as weight from e join p using (bin) where bin % 13 <> 5 and bin % 11 <> 3 and d > -85 group by 1, 2",
    "profile_state": f"with {_OPS} select * from ps",
    "active_profiles": f"with {_SEED} select * from ac",
    "saved_levels": f"with {_SEED}, w as (select user_id % 400 as owner, event_id as seq, case when event_id % 6 > 0 then value / 10 end as level from events), s as (select owner, arg_max(coalesce(floor(level + 0.5), -1), seq)::int as l from w where level is null or level between 1 and 10 group by 1) select ac.owner, ac.id, case when s.owner is null then ac.level else nullif(l, -1) end as level from ac left join s using (owner)",
    "records_of_profile": "select user_id as profile_id, event_id, event_type from events where user_id = 7",
    "default_statuses": "with s as (select user_id, arg_max(event_type, event_id) as status from events group by 1) select coalesce(status, 'not_seen') as status, count(*) as n from part left join s on user_id = p_partkey group by 1",
}
