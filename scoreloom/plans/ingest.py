"""Ingest queries: candidates, gates, duplicates, checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import ingest as I
from ..sources.tables import table


def _candidates(spark, base):
    """Candidates of two sources and what the advisor graded, under one schema."""
    a = table(spark, base, "guitar_loot_candidate", ["candidate_id", "source", "file_url", "page_url", "license", "composer_hint", "title_hint", "grade"])
    b = table(spark, base, "mutopia_candidate", ["candidate_id", "source", "file_url", "page_url", "license", "composer"])
    c = table(spark, base, "dummy_advisor_grades", ["candidate_id", "source", "composer_normalized"]).withColumnRenamed("composer_normalized", "composer")
    return a, b, c


def load_candidates(spark, base):
    """The sources united, the first of each id kept."""
    a, b, c = _candidates(spark, base)
    u = I.first_wins([a, b, c], "candidate_id", ["file_url", "page_url", "license", "composer"])
    return u.select("candidate_id", "source", "file_url", "composer", "composer_hint", "grade")


def _documents(spark, base):
    return table(spark, base, "documents", ["doc_id", "text", "lang", "source", "n_chars", "doc_kind"])


def _gated(spark, base):
    d = _documents(spark, base).withColumn("sha", F.sha2(F.col("text").cast("binary"), 256))
    gates = [
        (F.coalesce(F.col("source").contains("notes"), F.lit(False)), "PATH_NOISE"), (F.col("text").isNull(), "FETCH_FAILED"), (F.trim("text") == "", "NO_NOTES"),
        (F.length("text") < 300, "FRAGMENT"), (F.col("lang").isNull(), "MISSING_COMPOSER"), (F.length("lang") > 2, "PLACEHOLDER_METADATA"),
    ]
    return I.gate(d, gates, "doc_id", "sha")


def gate_chain(spark, base):
    return _gated(spark, base).select("doc_id", "code", "winner")


def reject_counts(spark, base):
    return _gated(spark, base).groupBy(F.coalesce("code", F.lit("accepted")).alias("code")).agg(F.count("*").alias("n"))


def reject_by_source(spark, base):
    """Funnel per source: considered, accepted, and the commonest reason."""
    g = _gated(spark, base).groupBy("source", "code").agg(F.count("*").alias("n"))
    return g.groupBy("source").agg(F.sum("n").alias("considered"), F.sum(F.when(F.col("code").isNull(), F.col("n")).otherwise(0)).alias("accepted"), F.max_by("code", F.when(F.col("code").isNotNull(), F.struct("n", "code"))).alias("top_code"))


def duplicates_by_sha(spark, base):
    d = _documents(spark, base).where("text is not null").withColumn("sha", F.sha2(F.col("text").cast("binary"), 256))
    return d.groupBy("sha").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


def _digest(c):
    """A number that follows from a text."""
    return F.conv(F.substring(F.md5(c), 1, 6), 16, 10).cast("int")


def parent_fallback(spark, base):
    """Movements inherit their container's record."""
    g = table(spark, base, "mutopia_candidate", ["candidate_id", "license", "composer"]).groupBy("candidate_id").agg(F.max("license").alias("license"), F.max("composer").alias("composer"))
    kids = g.select(F.concat("candidate_id", F.when(_digest("candidate_id") % 3 == 0, F.lit("")).otherwise(F.lit("#movement01"))).alias("candidate_id"))
    return I.parent_fallback(kids, g, "candidate_id", ["license", "composer"])


def incremental_fetch(spark, base):
    """Candidates without a row in the features yet, per source."""
    a, _, _ = _candidates(spark, base)
    todo = I.incremental(a.select("candidate_id", F.lower(F.trim("source")).alias("source")).distinct(), table(spark, base, "features", ["candidate_id"]), "candidate_id")
    return todo.groupBy("source").agg(F.count("*").alias("n"))


def new_blobs(spark, base):
    """Texts not among the programme notes' yet, each once."""
    d = _documents(spark, base).where("text is not null")
    stored = I.content_keys(d.where("doc_kind = 'programme_note'").select(F.col("text").alias("content")), "content").select("sha256").distinct()
    return I.new_blobs(d.where("doc_kind = 'reject_report'").select(F.col("doc_id").alias("id"), F.col("text").alias("content")), stored).select("sha256", "id")


def precheck_flags(spark, base):
    """Checks that don't exclude one another, counted."""
    t = table(spark, base, "dummy_advisor_grades", ["candidate_id", "title", "composer_normalized", "dummy_grade"]).distinct()
    flags = X.flags(
        (X.suspicious_title("title").isNotNull(), "SUSPICIOUS_TITLE"), (X.looks_like_username("composer_normalized"), "COMPOSER_LIKE_USERNAME"),
        (F.length("title") > 60, "LONG_TITLE"), (F.col("dummy_grade") >= 9, "HARD"), (F.col("composer_normalized").isNull(), "NO_COMPOSER"),
    )
    return I.flag_counts(t.withColumn("flags", flags), "flags")


def capped_sections(spark, base):
    """The first entries of each kind of document, with how many more there are."""
    return I.capped_sections(_documents(spark, base).select("doc_id", "doc_kind"), "doc_kind", ["doc_id"], 3).select("doc_kind", "rn", "doc_id", "more")


def path_noise(spark, base):
    a = table(spark, base, "guitar_loot_candidate", ["candidate_id", "path", "page_url"]).distinct()
    p = F.concat_ws("/", "path", "page_url", F.when(_digest("candidate_id") % 50 == 0, F.lit("x/samples/y")))
    return a.withColumn("noise", I.path_noise(p)).groupBy("noise").agg(F.count("*").alias("n"))


def license_counts(spark, base):
    a = table(spark, base, "guitar_loot_candidate", ["license", "license_spdx"])
    code = F.coalesce(X.blank_null(F.upper("license_spdx")), F.lit("unknown"))
    return a.groupBy(code.alias("license_code")).agg(F.count("*").alias("n"), F.countDistinct("license").alias("n_texts"))


def sniff_formats(spark, base):
    """Formats told by the first bytes."""
    d = _documents(spark, base).where("text is not null").select("doc_id", "text")
    made = F.when(F.col("doc_id") % 4 == 0, F.concat(F.unhex(F.lit("504B0304")), F.col("text").cast("binary"))).when(F.col("doc_id") % 4 == 1, F.concat(F.lit("  <?xml version='1.0'?>").cast("binary"), F.col("text").cast("binary"))).otherwise(F.col("text").cast("binary"))
    return d.select((F.col("doc_id") % 4).alias("k"), I.sniff_format(made).alias("format")).groupBy("k", "format").agg(F.count("*").alias("n"))


NAMES = "load_candidates gate_chain reject_counts reject_by_source duplicates_by_sha parent_fallback incremental_fetch new_blobs precheck_flags capped_sections path_noise license_counts sniff_formats".split()
QUERIES = {n: globals()[n] for n in NAMES}

_G = """d as (select *, case when text is not null then sha256(text) end as sha, case when contains(source, 'notes') then 'PATH_NOISE' when text is null then 'FETCH_FAILED' when trim(text, ' ') = '' then 'NO_NOTES' when length(text) < 300 then 'FRAGMENT'
 when lang is null then 'MISSING_COMPOSER' when length(lang) > 2 then 'PLACEHOLDER_METADATA' end as code0 from documents),
g as (select *, case when code0 is null and row_number() over (partition by sha, code0 is null order by doc_id) > 1 then 'DUPLICATE' else code0 end as code, case when code0 is null and row_number() over (partition by sha, code0 is null order by doc_id) > 1 then first(doc_id) over (partition by sha, code0 is null order by doc_id) end as winner from d)"""
_MD = "('0x' || md5(candidate_id)[1:6])::int"
SQL = {
    "parent_fallback": f"select candidate_id || case when {_MD} % 3 = 0 then '' else '#movement01' end as candidate_id, max(license) as license, max(composer) as composer from mutopia_candidate where candidate_id is not null group by candidate_id",
    "path_noise": f"with a as (select distinct candidate_id, path, page_url, lower(concat_ws('/', path, page_url, case when {_MD} % 50 = 0 then 'x/samples/y' end)) as p from guitar_loot_candidate) select case " + " ".join(f"when contains(p, '{n}') then '{n}'" for n in X.PATH_NOISE) + " end as noise, count(*) as n from a group by 1",
    "gate_chain": f"with {_G} select doc_id, code, winner from g",
    "reject_counts": f"with {_G} select coalesce(code, 'accepted') as code, count(*) as n from g group by 1",
    "reject_by_source": f"with {_G}, c as (select source, code, count(*) as n from g group by 1, 2) select source, sum(n)::bigint as considered, coalesce(sum(n) filter (code is null), 0)::bigint as accepted, arg_max(code, (n, code)) filter (code is not null) as top_code from c group by 1",
    "duplicates_by_sha": "select sha256(text) as sha, count(*) as n, min(doc_id) as first_id from documents where text is not null group by 1 having count(*) > 1",
    "incremental_fetch": "select lower(trim(source, ' ')) as source, count(*) as n from (select distinct candidate_id, lower(trim(source, ' ')) as source from guitar_loot_candidate) where candidate_id not in (select candidate_id from features where candidate_id is not null) group by 1",
    "new_blobs": "with d as (select doc_id, doc_kind, sha256(text) as sha256 from documents where text is not null) select sha256, min(doc_id) as id from d where doc_kind = 'reject_report' and sha256 not in (select sha256 from d where doc_kind = 'programme_note') group by 1",
    "capped_sections": "with r as (select doc_kind, doc_id, row_number() over (partition by doc_kind order by doc_id) as rn, greatest(count(*) over (partition by doc_kind) - 3, 0) as more from documents) select doc_kind, rn, doc_id, more from r where rn <= 3",
    "license_counts": "select coalesce(nullif(upper(license_spdx), ''), 'unknown') as license_code, count(*) as n, count(distinct license) as n_texts from guitar_loot_candidate group by 1",
    "sniff_formats": "select doc_id % 4 as k, case doc_id % 4 when 0 then 'mxl' when 1 then 'musicxml' end as format, count(*) as n from documents where text is not null group by 1, 2",
    "precheck_flags": r"with t as (select distinct candidate_id, title, composer_normalized, dummy_grade from dummy_advisor_grades), s as (select *, trim(title, ' ' || chr(9) || chr(10)) as tt, trim(composer_normalized, ' ' || chr(9) || chr(10) || chr(160)) as cc from t), f as (select list_filter([case when tt <> '' and (regexp_matches(tt, '(?i)\b(demo|demo1|test|test1|example|sample|asdf|noname|scratch|placeholder|lorem)\b') or regexp_full_match(tt, '[0-9]{1,2}') or length(tt) <= 2) then 'SUSPICIOUS_TITLE' end, case when regexp_full_match(cc, '[a-z0-9][a-z0-9_\-]{1,15}') then 'COMPOSER_LIKE_USERNAME' end, case when length(title) > 60 then 'LONG_TITLE' end, case when dummy_grade >= 9 then 'HARD' end, case when composer_normalized is null then 'NO_COMPOSER' end], lambda x: x is not null) as flags from s) select flag, count(*) as n from (select unnest(case when len(flags) > 0 then flags else ['(clean)'] end) as flag from f) group by 1",
}
SQL["load_candidates"] = "with u as (select 0 as s, candidate_id, source, file_url, page_url, license, null as composer, composer_hint, title_hint, grade from guitar_loot_candidate union all select 1, candidate_id, source, file_url, page_url, license, composer, null, null, null from mutopia_candidate union all select 2, candidate_id, source, null, null, null, composer_normalized, null, null, null from dummy_advisor_grades where candidate_id is not null) select candidate_id, source, file_url, composer, composer_hint, grade from u qualify row_number() over (partition by candidate_id order by s, file_url nulls first, page_url nulls first, license nulls first, composer nulls first) = 1"
