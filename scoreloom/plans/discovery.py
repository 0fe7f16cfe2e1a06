"""Queries over pages, listings and files made from the tables: every event is one."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality as Q
from ..sources import discovery as D
from ..sources import reports as R
from ..sources import scores as S
from ..sources.tables import table
from .cut import spread

L = F.lit


def _events(spark, base):
    return table(spark, base, "events", ["event_id", "user_id", "event_type"])


def _pages(spark, base):
    """A work's page an event: one or two files, some of another kind, and a composer."""
    e = _events(spark, base)
    i, u = F.col("event_id").cast("string"), F.col("user_id").cast("string")
    file = lambda n, what: F.concat(L('<tr><td><a href="/wiki/Special:ReverseLookup/'), n, L('">#'), n, L("</a></td><td>"), what, L("</td></tr>"))
    kind = F.when(F.col("event_id") % 4 == 0, "PDF typeset").otherwise("MusicXML <b>file</b>")
    licence = F.when(F.col("event_id") % 3 == 0, "CC0").when(F.col("event_id") % 3 == 1, "Creative Commons BY").otherwise("no word of it")
    who = F.when(F.col("event_id") % 5 == 0, "").otherwise(F.concat(L('<h2><span id="Composer">Composer</span></h2><p>by</p><p><a href="/wiki/Category:U'), u, L('">U'), u, L("</a></p>")))
    html = F.concat(L("<html><body>"), who, L("<table>"), file(i, F.concat(kind, L(", "), licence)), F.when(F.col("event_id") % 2 == 0, file(F.concat(i, L("0")), L("MXL &amp; more<br>"))).otherwise(""), L("</table><a href='/wiki/Special:ReverseLookup/7'>x</a></body>"))
    title = F.concat(F.when(F.col("event_id") % 7 == 0, L("File:")).otherwise(""), "event_type", L(" "), i)
    return spread(e).select("event_id", title.alias("title"), F.when(F.col("event_id") % 11 > 0, html).alias("html"))


def page_files(spark, base):
    """The score files that pages list, with licence and composer."""
    c = D.page_candidates(_pages(spark, base))
    return c.select("work_id", F.col("file_id").cast("long").alias("file_id"), F.when(F.col("licence") == "unknown", "unknown").otherwise(F.substring("licence", 1, 3)).alias("licence"), "composer")


def listing_until_stale(spark, base):
    """A listing of ten rows a page that repeats itself, read until two pages say nothing new."""
    e = _events(spark, base)
    ids = F.when(F.floor(F.col("event_id") / 10) % 4 < 2, F.col("event_id") % 97).otherwise(F.col("event_id") % 17)
    return D.until_stale(e.select(F.floor(F.col("event_id") / 10).alias("page"), ids.alias("id")), "page", "id")


def score_paths(spark, base):
    e = _events(spark, base)
    name = F.concat("event_type", L("/"), F.col("event_id").cast("string"), F.element_at(F.array(L(".MusicXML"), L(".mxl"), L(".xml"), L(".mxl.txt")), (F.col("event_id") % 4 + 1).cast("int")))
    tree = e.select(F.concat(L("o/r"), F.col("user_id").cast("string")).alias("repo"), name.alias("path"), F.when(F.col("event_id") % 5 == 0, "tree").otherwise("blob").alias("type"))
    return D.score_paths(tree)


def repo_candidates(spark, base):
    """Two searches and a walk, their repositories looked up once each."""
    e = _events(spark, base)
    repo, path = F.concat(L("o/r"), (F.col("user_id") % 50).cast("string")), F.concat("event_type", L("/a "), (F.col("event_id") % 300).cast("string"), L(".mxl"))
    hits = [e.where(F.col("event_id") % 3 == k).select(repo.alias("repo"), path.alias("path")) for k in range(3)]
    meta = e.select((F.col("user_id") % 50).alias("k")).distinct().where("k <> 7").select(F.concat(L("o/r"), F.col("k").cast("string")).alias("repo"), F.when(F.col("k") % 2 == 0, "main").alias("default_branch"), (F.col("k") % 5 == 0).alias("fork"), L("CC0-1.0").alias("spdx"))
    return D.repo_candidates(hits, meta).select("candidate_id", "file_path", "license_spdx", "format_label")


def answer(url: str):
    """A server for tests: what it says follows from the number a url ends in."""
    n = int(url.rsplit("/", 1)[1])
    if n % 10 == 1:
        raise ConnectionError("no route")
    if n % 10 == 2:
        return 404, {}, b""
    if n % 10 == 3:
        return 503, {"Retry-After": "0"}, b""
    if n % 10 == 4:
        return 200, {}, b""
    if n % 10 == 5:
        return 200, {}, b"<html>"
    return 200, {}, b"PK\x03\x04 score" if n % 2 else b"<score-partwise/>"


def _fetched(spark, base):
    e = _events(spark, base)
    wanted = e.select(F.col("event_id").cast("string").alias("id"), F.concat(L("https://h"), (F.col("event_id") % 40).cast("string"), L(".example/"), F.col("event_id").cast("string")).alias("url"))
    return wanted, D.fetch_all(wanted, answer, sleep=lambda seconds: None)


def fetch_reasons(spark, base):
    """How fetches end, and after how many attempts."""
    _, got = _fetched(spark, base)
    return got.groupBy("reason", "format", "attempts").agg(F.count("*").alias("n"))


def fetch_stats(spark, base):
    """What was fetched now, was there before, and failed."""
    wanted, _ = _fetched(spark, base)
    done = wanted.where(F.col("id").cast("long") % 6 == 0).select("id")
    return D.outcomes(wanted, done, D.fetch_all(wanted.join(done, "id", "left_anti"), answer, sleep=lambda seconds: None))


def fetch_codes(spark, base):
    """Reject codes of fetches, with a detail of bounded length."""
    _, got = _fetched(spark, base)
    r = got.where("reason is not null").select(D.reject_code(F.col("reason")).alias("code"), F.substring(F.coalesce("detail", L("")), 1, 240).alias("detail"))
    return r.groupBy("code", "detail").agg(F.count("*").alias("n"))


def movement_containers(spark, base):
    """Files of up to three movements: a row each, and one for the file."""
    e = _events(spark, base)
    m = e.select(F.concat(L("m:"), F.col("event_id").cast("string")).alias("parent"), F.explode(F.when(F.col("event_id") % 4 == 0, F.array(L(0))).otherwise(F.sequence(L(1), (F.col("event_id") % 4).cast("int")))).alias("movement"), (F.col("user_id") % 3 > 0).alias("ok"))
    return D.with_containers(m)


def link_extensions(spark, base):
    """Links by page and suffix, the grades around them as a histogram of patterns."""
    e = _events(spark, base)
    rows = e.select((F.col("event_id") % 41).alias("page"), F.element_at(F.array(L("mxl"), L("pdf"), L("mid")), (F.col("user_id") % 3 + 1).cast("int")).alias("ext"))
    return rows.groupBy("page").pivot("ext", ["mid", "mxl", "pdf"]).count().na.fill(0, ["mid", "mxl", "pdf"])


def include_lines(spark, base):
    """Files that include one another, in folders."""
    e = _events(spark, base)
    folder = F.concat(L("/ly/"), (F.col("event_id") % 10).cast("string"), L("/"))
    body = F.concat(L("c d\n  \\include \"./n"), ((F.col("event_id") + 10) % 1000).cast("string"), L('.ly"\ne'))
    files = e.groupBy(F.concat(folder, L("n"), F.col("event_id").cast("string"), L(".ly")).alias("path")).agg(F.min(body).alias("text"))
    return D.inline_includes(files).select("path", F.length("text").alias("length"), (F.length(F.regexp_replace("text", "[^%]", ""))).alias("marks"))


def tab_rewrites(spark, base):
    """Headers cut out, tablature renamed or dropped."""
    e = _events(spark, base)
    text = F.concat(L('\\header { title = "a { b" }\n\\new TabStaff '), F.when(F.col("event_id") % 3 == 0, L('<< { c } << d >> >>')).when(F.col("event_id") % 3 == 1, L('= "t" { c { d } }')).otherwise(L("{ c")), L(" \\new TabVoice "), F.col("event_id").cast("string"))
    files = spread(e).select(F.col("event_id").cast("string").alias("id"), text.alias("text"))
    out = [S.rewrite(files, k).select("id", L(k).alias("kind"), F.length("text").alias("length"), F.col("text").contains("Tab").alias("tab")) for k in sorted(S.REWRITES)]
    return out[0].unionByName(out[1]).unionByName(out[2]).groupBy("kind", "tab", F.col("length") - F.length("id")).agg(F.count("*").alias("n")).toDF("kind", "tab", "length", "n")


def conversion_buckets(spark, base):
    """Files by how much of them was converted."""
    e = _events(spark, base)
    f = e.select(F.col("event_id").alias("path"), (F.col("event_id") % 4).alias("blocks"), F.least(F.col("user_id") % 5, F.greatest(F.col("event_id") % 4, L(1))).alias("clean"), F.when(F.col("event_id") % 9 == 0, "x").alias("error"))
    return Q.conversion_buckets(f)


def conversion_ratio(spark, base):
    """What share of a label's blocks, and of all, was converted."""
    e = _events(spark, base)
    f = e.select("event_type", (F.col("event_id") % 4 + 1).alias("blocks"), F.least(F.col("user_id") % 5, F.col("event_id") % 4 + 1).alias("clean"))
    return f.rollup("event_type").agg(F.sum("blocks").alias("blocks"), F.sum("clean").alias("clean"), F.round(100.0 * F.sum("clean") / F.greatest(F.sum("blocks"), L(1)), 4).alias("percent"))


def funnel_variants(spark, base):
    """Rows that pass a loose and a strict set of conditions, and their commonest composers."""
    t = table(spark, base, "features", ["composer_normalized", "measure_count", "midi_max", "barre_count"])
    loose = F.col("measure_count") > 0
    strict = loose & (F.col("midi_max") <= 76) & (F.col("barre_count") == 0)
    v = t.select("composer_normalized", F.explode(F.array_compact(F.array(F.when(loose, L("loose")), F.when(strict, L("strict"))))).alias("variant"))
    n = v.groupBy("variant", F.coalesce("composer_normalized", L("?")).alias("composer")).agg(F.count("*").alias("n"))
    from ..operators.feed import top_per_group

    return top_per_group(n, ["variant"], [F.desc("n"), F.col("composer")], 25).select("variant", "composer", "n")


def gathered_rows(spark, base):
    """The first fifty candidates in order that a condition lets through: the filter reaches
    the scan, and the limit keeps fifty rows a task."""
    t = table(spark, base, "guitar_loot_candidate", ["candidate_id", "format_label", "path"]).where("format_label is not null and candidate_id is not null")
    return t.distinct().orderBy("candidate_id", "format_label", F.col("path").asc_nulls_first()).limit(50)


def normalized_files(spark, base):
    t = table(spark, base, "documents", ["doc_id", "text"])
    return R.normalized_files(t.withColumn("id", F.concat(L("d/"), F.col("doc_id").cast("string"))), "id", "text").select("name", "sha256", "size")


def render_tally(spark, base):
    """Results by status, those that none has as 0."""
    e = _events(spark, base).select(F.element_at(F.array(L("ok"), L("error"), L("other")), (F.col("event_id") % 3 + 1).cast("int")).alias("status"))
    return R.tally(e, "status", ["ok", "error", "timeout"])


QUERIES = {f.__name__: f for f in (page_files, listing_until_stale, score_paths, repo_candidates, fetch_reasons, fetch_stats, fetch_codes, movement_containers, link_extensions, include_lines, tab_rewrites, conversion_buckets, conversion_ratio, funnel_variants, gathered_rows, normalized_files, render_tally)}

_ANSWER = "case event_id % 10 when 1 then 'network_error' when 2 then 'http_404' when 3 then 'http_503' when 4 then 'empty_body' when 5 then 'format_undetected' end"
SQL = {
    "page_files": """with e as (select *, replace(event_type || ' ' || event_id, ' ', '_') as work_id, case when event_id % 5 = 0 then '' else 'U' || user_id end as composer from events where event_id % 7 > 0 and event_id % 11 > 0),
f as (select work_id, event_id as file_id, case event_id % 3 when 0 then 'CC0' when 1 then 'Cre' else 'unknown' end as licence, composer from e
 union all select work_id, event_id * 10, 'unknown', composer from e where event_id % 2 = 0)
select work_id, file_id, licence, composer from f
 union all select work_id, 7, case event_id % 3 when 0 then 'CC0' when 1 then 'Cre' else 'unknown' end, composer from e""",
    "listing_until_stale": """with l as (select event_id // 10 as page, case when event_id // 10 % 4 < 2 then event_id % 97 else event_id % 17 end as id from events), f as (select id, min(page) as page from l group by 1),
p as (select page, (select count(*) from f where f.page = d.page) as n from (select distinct page from l) d), s as (select page, sum(n) over w = 0 and count(*) over w = 2 as stop from p window w as (order by page rows between 1 preceding and current row))
select page, id from f where page <= coalesce((select min(page) from s where stop), 1e18)""",
    "score_paths": "select 'o/r' || user_id as repo, event_type || '/' || event_id || (['.MusicXML', '.mxl'])[event_id % 4 + 1] as path from events where event_id % 5 > 0 and event_id % 4 < 2",
    "repo_candidates": """with h as (select distinct user_id % 50 as k, event_type || '/a ' || event_id % 300 || '.mxl' as path, event_type || '/a%20' || event_id % 300 || '.mxl' as quoted from events), m as (select *, case when k % 2 = 0 then 'main' else 'HEAD' end as ref from h where k = 7 or k % 5 > 0)
select 'gh:o/r' || k || '@' || ref || ':' || path as candidate_id, 'o/r' || k || '/' || ref || '/' || quoted as file_path, case when k = 7 then 'unknown' else 'CC0-1.0' end as license_spdx, 'mxl' as format_label from m""",
    "fetch_reasons": f"select {_ANSWER} as reason, case when event_id % 10 in (1, 2, 3, 4, 5) then null when event_id % 2 = 1 then 'mxl' else 'musicxml' end as format, case when event_id % 10 in (1, 3) then 4 else 1 end as attempts, count(*) as n from events group by all",
    "fetch_stats": "select 'cached' as outcome, count(*) as n from events where event_id % 6 = 0 union all select 'fetched', count(*) from events where event_id % 6 > 0 and event_id % 10 not in (1, 2, 3, 4, 5) union all select 'failed', count(*) from events where event_id % 6 > 0 and event_id % 10 in (1, 2, 3, 4, 5)",
    "fetch_codes": "select 'FETCH_FAILED' as code, case when event_id % 10 = 1 then 'ConnectionError: no route' else '' end as detail, count(*) as n from events where event_id % 10 in (1, 2, 3, 4, 5) group by all",
    "movement_containers": """with m as (select 'm:' || event_id as parent, event_id % 4 as k, user_id % 3 > 0 as ok from events), r as (select *, unnest(generate_series(1, k)) as movement from m where k > 0)
select parent || '#movement' || lpad(movement::varchar, 2, '0') as id, parent, case when ok then 'ok' else 'failed' end as status, null::bigint as movements, null::bigint as clean from r
 union all select parent, null, case when k > 0 then 'container' else 'failed' end, k::bigint, case when ok then k else 0 end::bigint from m""",
    "link_extensions": "select event_id % 41 as page, count(*) filter (user_id % 3 = 2) as mid, count(*) filter (user_id % 3 = 0) as mxl, count(*) filter (user_id % 3 = 1) as pdf from events group by 1",
    "include_lines": """with f as (select distinct event_id, '/ly/' || event_id % 10 || '/n' || event_id || '.ly' as path, 'n' || (event_id + 10) % 1000 || '.ly' as rel, (event_id + 10) % 1000 as other from events),
t as (select *, 'c d' || chr(10) || '  \\include "./' || rel || '"' || chr(10) || 'e' as text from f)
select a.path, length(a.text) + case when b.path is null then 0 else length('% inlined include ./' || a.rel || chr(10) || b.text || chr(10) || '% end inlined ./' || a.rel) - length('  \\include "./' || a.rel || '"') end as length, case when b.path is null then 0 else 2 end as marks
 from t a left join t b on b.path = '/ly/' || a.event_id % 10 || '/' || a.rel""",
    "tab_rewrites": """with t as (select event_id, '\\header { title = "a { b" }' as h, chr(10) || '\\new TabStaff ' as n, (['<< { c } << d >> >>', '= "t" { c { d } }', '{ c'])[event_id % 3 + 1] as b, ' \\new TabVoice ' || event_id as v from events),
r as (select event_id, 'header' as kind, n || b || v as text from t union all select event_id, 'rename', h || replace(n || b || v, 'Tab', '') from t union all select event_id, 'drop', h || case when event_id % 3 = 0 then chr(10) else n || b end || v from t)
select kind, contains(text, 'Tab') as tab, length(text) - length(event_id::varchar) as length, count(*) as n from r group by all""",
    "conversion_buckets": "with f as (select event_id % 4 as blocks, least(user_id % 5, greatest(event_id % 4, 1)) as clean, event_id % 9 = 0 as fatal from events), b as (select *, greatest(blocks, 1) as g, case when fatal then 'fatal' when clean >= greatest(blocks, 1) then 'all' when clean > 0 then 'some' else 'none' end as bucket from f) select bucket, count(*) as n, sum(case when fatal then 0 else g end)::bigint as blocks, sum(case when fatal then 0 else clean end)::bigint as clean from b group by 1",
    "conversion_ratio": "with f as (select event_type, event_id % 4 + 1 as blocks, least(user_id % 5, event_id % 4 + 1) as clean from events) select event_type, sum(blocks)::bigint as blocks, sum(clean)::bigint as clean, round(100.0 * sum(clean) / greatest(sum(blocks), 1), 4) as percent from f group by rollup (event_type)",
    "funnel_variants": "with t as (select coalesce(composer_normalized, '?') as composer, measure_count > 0 as loose, measure_count > 0 and midi_max <= 76 and barre_count = 0 as strict from features), v as (select 'loose' as variant, composer, count(*) as n from t where loose group by 2 union all select 'strict', composer, count(*) from t where strict group by 2) select variant, composer, n from v qualify row_number() over (partition by variant order by n desc, composer) <= 25",
    "gathered_rows": "select distinct candidate_id, format_label, path from guitar_loot_candidate where format_label is not null and candidate_id is not null order by candidate_id, format_label, path nulls first limit 50",
    "normalized_files": "select 'd_' || doc_id || '.musicxml' as name, sha256(text) as sha256, strlen(text)::int as size from documents where text is not null",
    "render_tally": "select count(*) filter (event_id % 3 = 0) as ok, count(*) filter (event_id % 3 = 1) as error, 0::bigint as timeout, count(*) as total from events",
}
