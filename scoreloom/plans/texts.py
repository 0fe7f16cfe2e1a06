"""Text and array functions as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs as X
from ..sources.tables import table


def composer_normalise(spark, base):
    t = table(spark, base, "dummy_advisor_grades", [F.col("composer_normalized").alias("raw")]).where("raw is not null").distinct()
    return t.select("raw", X.normalize_composer("raw").alias("normal"))


def fold_text(spark, base):
    """Without diacritics: an ICU collation compares, no Python."""
    t = table(spark, base, "composer_era", ["composer"])
    a = t.select("composer", F.collate("composer", "UNICODE_CI_AI").alias("c"))
    return a.groupBy("c").agg(F.count("*").alias("n"), F.min(F.collate("composer", "UTF8_BINARY")).alias("composer")).select("composer", "n")


def slugs(spark, base):
    t = table(spark, base, "part", ["p_partkey", "p_name", "p_brand"])
    return t.select("p_partkey", X.slug(F.concat_ws(" & ", "p_name", "p_brand")).alias("slug"), X.safe_filename(F.concat_ws("/", "p_brand", F.concat_ws("@", "p_name", "p_partkey"))).alias("file"))


def format_durations(spark, base):
    t = table(spark, base, "features", ["candidate_id", "load_id", "duration_sec_approx"])
    return t.groupBy(X.format_duration(F.nanvl("duration_sec_approx", F.lit(None))).alias("length")).agg(F.count("*").alias("n"))


NEEDLES = ("license", "lizenz", "licencia", "rights", "grade")


def earliest_needles(spark, base):
    t = table(spark, base, "documents", ["doc_id", "text"]).where("text is not null")
    return t.select("doc_id", X.earliest_needle("text", NEEDLES, 20).alias("snippet")).where("snippet is not null")


GRADES = (r"grade\s+(\d+)", r"Stufe\s+(\d+)", r"grado\s+(\d+)", r"degr\p{L}\s+(\d+)")


def grade_detect(spark, base):
    t = table(spark, base, "documents", ["doc_id", "text"]).where("text is not null")
    return t.select(X.detect_number("text", GRADES).alias("g")).groupBy("g").agg(F.count("*").alias("n"))


def href_extract(spark, base):
    """Links of a kind out of text, each once per document."""
    t = table(spark, base, "documents", ["doc_id", "text"]).where("text is not null")
    links = F.expr(r"regexp_extract_all(text, 'https?://[a-zA-Z.]+/scores/([0-9]+)\\?view=pdf', 1)")
    return t.select("doc_id", F.explode(F.array_distinct(links)).alias("score"))


def url_parts(spark, base):
    t = table(spark, base, "guitar_loot_candidate", ["file_url"]).where("file_url is not null").distinct()
    return t.select("file_url", F.regexp_extract("file_url", r"^https?://([^/]+)", 1).alias("host"), F.regexp_extract("file_url", r"([^/]*)$", 1).alias("file"))


def shortened(spark, base):
    t = table(spark, base, "dummy_advisor_grades", ["title"]).where("title is not null").distinct()
    return t.select("title", X.shorten("title", 16).alias("short"))


def ids_by_scheme(spark, base):
    t = table(spark, base, "dummy_advisor_grades", ["candidate_id"]).distinct()
    short = F.when(F.col("candidate_id").startswith("gh:"), F.concat(F.substring_index("candidate_id", "@", 1), F.lit(":.../"), F.substring_index("candidate_id", "/", -1))).when(
        F.col("candidate_id").startswith("guitarloot:"), F.concat(F.lit("guitarloot:"), F.substring_index("candidate_id", "/", -1))
    ).otherwise(F.col("candidate_id"))
    return t.select("candidate_id", short.alias("short"))


def vector_normalise(spark, base):
    t = table(spark, base, "embeddings", ["vec_id", "embedding"])
    v = X.normalize_bands(F.slice("embedding", 1, 24), 12)
    return t.select("vec_id", F.round(F.get(v, F.lit(0)), 4).alias("first"), F.round(F.get(v, F.lit(23)), 4).alias("last"), F.round(X.norm(v), 4).alias("length"))


def cosine_distance(spark, base):
    """Each vector's distance to the one of its label with the least id."""
    t = table(spark, base, "embeddings", ["vec_id", "embedding", "label"])
    head = t.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("h"))
    return t.join(F.broadcast(head), "label").select("vec_id", F.round(X.cosine_distance("embedding", "h"), 4).alias("distance"))


def self_ambiguity(spark, base):
    """Share of sampled pairs, apart by half a bar at least, that look alike. The sample
    is a fixed stride of about sixty frames, so pairs stay bounded."""
    t = table(spark, base, "embeddings", ["vec_id", "embedding"])
    n = t.agg(F.struct(F.greatest(F.floor(F.count("*") / 60), F.lit(1)).alias("step"), F.min("vec_id").alias("lo")).alias("s")).scalar()
    s = t.withColumn("n", n).where((F.col("vec_id") - F.col("n.lo")) % F.col("n.step") == 0).select("vec_id", X.l2_normalize(F.slice("embedding", 1, 24)).alias("v"))
    a, b = s.select(F.col("vec_id").alias("i"), F.col("v").alias("x")), s.select(F.col("vec_id").alias("j"), F.col("v").alias("y"))
    p = a.join(F.broadcast(b), F.col("j") - F.col("i") >= 16)
    return p.agg(F.count("*").alias("pairs"), F.count_if(F.lit(1.0) - X.dot("x", "y") < 0.9).alias("alike"))


def decimate(spark, base):
    """Neighbouring frames averaged."""
    t = table(spark, base, "embeddings", ["vec_id", "embedding"])
    p = t.select(F.floor(F.col("vec_id") / 2).alias("frame"), F.posexplode(F.slice("embedding", 1, 4)).alias("k", "x"))
    return p.groupBy("frame", "k").agg(F.round(F.avg(F.col("x").cast("double")), 5).alias("x"))


PARTIALS = ((0, 1.0), (12, 1 / 2), (19, 1 / 3), (24, 1 / 4), (28, 1 / 5), (31, 1 / 6))


def chroma_histogram(spark, base):
    """Pitch-class weights in two registers from pitches and their first six partials."""
    f = table(spark, base, "features", ["load_id", "midi_max"]).where("midi_max between 30 and 100")
    parts = F.array(*[F.struct(F.lit(o).alias("o"), F.lit(w).alias("w")) for o, w in PARTIALS])
    e = f.select("load_id", "midi_max", F.explode(parts).alias("p")).select("load_id", (F.col("midi_max") + F.col("p.o")).alias("m"), F.col("p.w").alias("w"))
    return e.groupBy("load_id", (F.when(F.col("m") >= 64, 12).otherwise(0) + F.col("m") % 12).alias("slot")).agg(F.round(F.sum("w"), 4).alias("weight"))


def piece_urls(spark, base):
    """Where a piece's file is published: ids percent-encoded, spaces not as plus."""
    t = table(spark, base, "part", ["p_partkey", "p_name"])
    name = F.concat("p_name", F.lit("#movement"), F.col("p_partkey").cast("string"))
    return t.select("p_partkey", F.concat(F.lit("/musicxml/"), F.replace(F.url_encode(F.replace(name, F.lit("#"), F.lit("--"))), F.lit("+"), F.lit("%20"))).alias("url"))


def transpositions(spark, base):
    """Semitones out of a transpose element: chromatic plus twelve an octave."""
    e = table(spark, base, "events", ["event_id"])
    xml = F.concat(F.lit("<a><transpose>\n<chromatic>"), (F.col("event_id") % 5 - 2).cast("string"), F.lit("</chromatic>"), F.when(F.col("event_id") % 2 == 0, F.lit("<octave-change>-1</octave-change>")).otherwise(""), F.lit("</transpose></a>"))
    inner = F.regexp_extract(xml, r"(?s)<transpose>(.*?)</transpose>", 1)
    part = lambda tag: F.coalesce(F.regexp_extract(inner, rf"<{tag}>\s*(-?\d+)\s*</{tag}>", 1).try_cast("int"), F.lit(0))
    return e.groupBy((part("chromatic") + 12 * part("octave-change")).alias("semitones")).agg(F.count("*").alias("n"))


def levels(spark, base):
    """Typed levels: what they begin with, within bounds, and what they are strictly."""
    t = table(spark, base, "features", ["grade"]).groupBy("grade").agg(F.count("*").alias("n"))
    return t.select("grade", "n", X.leading_int("grade").alias("leading"), X.clamp_level(X.leading_int("grade")).alias("level"))


NAMES = "composer_normalise fold_text slugs format_durations earliest_needles grade_detect href_extract url_parts shortened ids_by_scheme vector_normalise cosine_distance self_ambiguity decimate chroma_histogram piece_urls transpositions levels".split()
QUERIES = {n: globals()[n] for n in NAMES}

_V = "list_transform(embedding[1:24], lambda x: x::double)"
SQL = {
    "piece_urls": "select p_partkey, '/musicxml/' || url_encode(p_name || '--movement' || p_partkey) as url from part",
    "transpositions": "select (event_id % 5 - 2 - case when event_id % 2 = 0 then 12 else 0 end)::int as semitones, count(*) as n from events group by 1",
    "levels": "with t as (select grade, count(*) as n from features group by 1) select grade, n, try_cast(nullif(regexp_extract(grade, '^\\s*([+-]?[0-9]+)', 1), '') as int) as leading, case when try_cast(nullif(regexp_extract(grade, '^\\s*([+-]?[0-9]+)', 1), '') as int) between 1 and 10 then try_cast(nullif(regexp_extract(grade, '^\\s*([+-]?[0-9]+)', 1), '') as int) end as level from t",
    "composer_normalise": r"with t as (select distinct composer_normalized as raw from dummy_advisor_grades where composer_normalized is not null), a as (select raw, regexp_replace(regexp_replace(regexp_replace(raw, '(?s)[\r\n].*$', ''), '\s*\([^)]*\)', '', 'g'), '\s*\([^)]*\)', '', 'g') as s from t), b as (select raw, regexp_replace(regexp_replace(s, '\s+(?:c\.?\s*)?\d{3,4}\s*[-–]\s*\d{3,4}\s*$', ''), '(?i)\s+(?:fl\.?|c\.?|d\.?)\s*\d{3,4}.*$', '') as s from a) select raw, regexp_replace(regexp_replace(regexp_replace(s, '\s+', ' ', 'g'), '^[ ,.;]+', ''), '[ ,.;]+$', '') as normal from b",
    "fold_text": "select min(composer) as composer, count(*) as n from composer_era group by lower(strip_accents(composer))",
    "slugs": "select p_partkey, regexp_replace(regexp_replace(regexp_replace(lower(p_name || ' & ' || p_brand), '[^a-z0-9]+', '-', 'g'), '^-', ''), '-$', '') as slug, translate(p_brand || '/' || p_name || '@' || p_partkey, '/:@', '___') as file from part",
    "format_durations": "with d as (select case when isnan(duration_sec_approx) then null else duration_sec_approx end as s from features) select case when s > 0 and s < 'infinity'::double then printf('%d:%02d', floor(s + 0.5)::bigint // 60, floor(s + 0.5)::bigint % 60) else '—' end as length, count(*) as n from d group by 1",
    "earliest_needles": "with t as (select doc_id, text, list_min(list_filter([" + ", ".join(f"nullif(instr(lower(text), '{n}'), 0)" for n in NEEDLES) + "], lambda x: x is not null)) as p from documents where text is not null) select doc_id, substring(text, p, 20) as snippet from t where p is not null",
    "grade_detect": "with t as (select " + ", ".join(f"try_cast(nullif(regexp_extract(text, '{p}', 1), '') as int) as g{i}" for i, p in enumerate(GRADES)) + " from documents where text is not null) select coalesce(" + ", ".join(f"case when g{i} between 1 and 10 then g{i} end" for i in range(len(GRADES))) + ") as g, count(*) as n from t group by 1",
    "href_extract": r"select doc_id, unnest(list_distinct(regexp_extract_all(text, 'https?://[a-zA-Z.]+/scores/([0-9]+)\?view=pdf', 1))) as score from documents where text is not null",
    "url_parts": r"select distinct file_url, regexp_extract(file_url, '^https?://([^/]+)', 1) as host, regexp_extract(file_url, '([^/]*)$', 1) as file from guitar_loot_candidate where file_url is not null",
    "shortened": r"with t as (select distinct title, regexp_replace(regexp_replace(regexp_replace(title, '\s+', ' ', 'g'), '^[\s\x{00A0}]+', ''), '[\s\x{00A0}]+$', '') as s from dummy_advisor_grades where title is not null) select title, case when length(s) > 16 then substring(s, 1, 15) || '…' else s end as short from t",
    "ids_by_scheme": "select distinct candidate_id, case when starts_with(candidate_id, 'gh:') then split_part(candidate_id, '@', 1) || ':.../' || split_part(candidate_id, '/', -1) when starts_with(candidate_id, 'guitarloot:') then 'guitarloot:' || split_part(candidate_id, '/', -1) else candidate_id end as short from dummy_advisor_grades",
    "vector_normalise": f"with a as (select vec_id, {_V} as v from embeddings), b as (select vec_id, v[1:12] as x, v[13:24] as y from a), c as (select vec_id, list_concat(list_transform(x, lambda q: q / sqrt(list_dot_product(x, x))), list_transform(y, lambda q: q / sqrt(list_dot_product(y, y)))) as z from b), d as (select vec_id, list_transform(z, lambda q: q / sqrt(list_dot_product(z, z))) as u from c) select vec_id, round(u[1], 4) as first, round(u[24], 4) as last, round(sqrt(list_dot_product(u, u)), 4) as length from d",
    "cosine_distance": "with e as (select vec_id, label, list_transform(embedding, lambda x: x::double) as v from embeddings), h as (select label, arg_min(v, vec_id) as h from e group by 1) select vec_id, round(1 - list_cosine_similarity(v, h), 4) as distance from e join h using (label)",
    "self_ambiguity": f"with n as (select greatest(count(*) // 60, 1) as step, min(vec_id) as lo from embeddings), s as (select vec_id, {_V} as v from embeddings, n where (vec_id - lo) % step = 0) select count(*) as pairs, count(*) filter (1 - list_cosine_similarity(a.v, b.v) < 0.9) as alike from s a join s b on b.vec_id - a.vec_id >= 16",
    "decimate": "with p as (select vec_id // 2 as frame, unnest([0, 1, 2, 3]) as k, unnest(embedding[1:4])::double as x from embeddings) select frame, k, round(avg(x), 5) as x from p group by 1, 2",
    "chroma_histogram": "with p as (select * from (values " + ", ".join(f"({o}, {w!r}::double)" for o, w in PARTIALS) + ") v(o, w)), e as (select load_id, midi_max + o as m, w from features, p where midi_max between 30 and 100) select load_id, case when m >= 64 then 12 else 0 end + m % 12 as slot, round(sum(w), 4) as weight from e group by 1, 2",
}
