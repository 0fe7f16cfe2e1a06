"""Statistics and grading queries over the feature table and the advisor's grades."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import grading as G
from ..operators import stats as S
from ..operators.ordering import placed_values, value_at
from ..sources.tables import table
from .cut import cut

NUMERIC = G.MODEL_FEATURES
FEW = ["midi_max", "midi_median", "notes_per_measure", "barre_count", "measure_count", "note_count"]
ERA = ("baroque", "classical", "modern", "renaissance", "romantic", "traditional", "unknown")


def fx(spark, base, columns=tuple(NUMERIC)):
    """One row per piece and load: NaN as null, repeated rows merged by their maxima."""
    t = table(spark, base, "features", ["candidate_id", "load_id", "source", "composer_normalized", "grade", *columns])
    clean = t.select("candidate_id", "load_id", F.lower(F.trim("source")).alias("source"), F.col("composer_normalized").alias("composer"), F.trim("grade").try_cast("int").alias("g"), *[F.nanvl(F.col(c).cast("double"), F.lit(None)).alias(c) for c in columns])
    return clean.groupBy("candidate_id", "load_id").agg(F.max("source").alias("source"), F.max("composer").alias("composer"), F.max("g").alias("g"), *[F.max(c).alias(c) for c in columns])


def _fx_sql(columns):
    nn = lambda c: f"max(case when isnan({c}::double) then null else {c}::double end) as {c}"
    return f"fx as (select candidate_id, load_id, max(lower(trim(source, ' '))) as source, max(composer_normalized) as composer, max(try_cast(trim(grade, ' ') as int)) as g, {', '.join(map(nn, columns))} from features group by 1, 2)"


def grades(spark, base):
    """The advisor's latest grade per piece."""
    t = table(spark, base, "dummy_advisor_grades", ["candidate_id", "source", "composer_normalized", "era", "dummy_grade", "graded_at"])
    by = F.struct("graded_at", "dummy_grade", "era", "composer_normalized")
    return t.groupBy("candidate_id").agg(F.max_by(F.struct(F.lower(F.trim("source")).alias("source"), F.col("composer_normalized").alias("composer"), F.lower("era").alias("era"), "dummy_grade"), by).alias("r")).select("candidate_id", "r.*")


GRADES_SQL = """lg as (select candidate_id, lower(trim(source, ' ')) as source, composer_normalized as composer, lower(era) as era, dummy_grade from dummy_advisor_grades
 qualify row_number() over (partition by candidate_id order by graded_at desc nulls last, dummy_grade desc nulls last, era desc nulls last, composer_normalized desc nulls last) = 1)"""


def grade_distribution(spark, base):
    g = grades(spark, base)
    return g.groupBy("dummy_grade").agg(F.count("*").alias("n"))


def top_composers(spark, base):
    c = S.counts(grades(spark, base), F.coalesce(X.blank_null("composer"), F.lit("(unknown)")), tie="candidate_id")
    return c.orderBy(F.desc("n"), "first_pos").limit(15).select("value", "n")


def source_counts(spark, base):
    """Pieces by source as the id's scheme gives it: repositories before the '@'."""
    k = F.when(F.col("candidate_id").startswith("gh:"), F.substring_index("candidate_id", "@", 1)).otherwise(F.substring_index("candidate_id", ":", 1))
    return S.counts(grades(spark, base), k, tie="candidate_id").orderBy(F.desc("n"), "first_pos").limit(20).select("value", "n")


def grade_sources(spark, base):
    """Grades and their sources counted in one pass by GROUPING SETS."""
    t = table(spark, base, "dummy_advisor_grades", ["dummy_grade", "dummy_grade_source"])
    return t.groupingSets([["dummy_grade"], ["dummy_grade_source"]], "dummy_grade", "dummy_grade_source").agg(F.count("*").alias("n"), F.grouping_id("dummy_grade", "dummy_grade_source").cast("int").alias("gid"))


def crosstab_composers(spark, base):
    """Composers by grade: the twenty largest rows, then all the others together."""
    x = S.crosstab(grades(spark, base), "composer", "dummy_grade", range(1, 11), "g")
    x = x.where("composer is not null")
    top = x.orderBy(F.desc("total"), "composer").limit(20)
    names = [c for c in x.columns if c != "composer"]
    rest = x.join(F.broadcast(top.select("composer")), "composer", "left_anti").agg(*[F.sum(c).alias(c) for c in names]).withColumn("composer", F.lit("(other)"))
    return top.unionByName(rest)


def crosstab_eras(spark, base):
    return S.crosstab(grades(spark, base), "era", "dummy_grade", range(1, 11), "g")


def grade_dispersion(spark, base):
    return S.dispersion(grades(spark, base), "composer", "dummy_grade")


def concentration(spark, base):
    return S.concentration(grades(spark, base).where("dummy_grade is not null"), "dummy_grade", "composer")


def eta_squared(spark, base):
    return S.eta_squared(fx(spark, base, FEW).where("composer is not null"), "composer", FEW)


def pearson_pairs(spark, base):
    return S.pearson(fx(spark, base, FEW), FEW, threshold=0.05)


def group_medians(spark, base):
    return S.group_medians(fx(spark, base, FEW).where("g is not null"), "g", FEW)


def source_medians(spark, base):
    """Medians per source, a column a source."""
    m = S.group_medians(fx(spark, base, FEW), "source", FEW)
    names = ["mutopia", "guitarloot", "github", "pdmx", "imslp"]
    return m.groupBy("feature").pivot("source", names).agg(F.first("median"))


def summary(spark, base):
    """n, least, quartiles by places n/4 and 3n/4, median, greatest and mean per column."""
    placed = placed_values(S.unpivot(fx(spark, base, FEW), [], FEW).where("x is not null"), ["feature"], "x")
    n, at = F.col("n"), lambda i: value_at(i, "x")
    return placed.groupBy("feature", "n").agg(
        F.round(F.min("x"), 6).alias("least"), F.round(at(F.floor(n / 4)), 6).alias("p25"),
        F.round((at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2, 6).alias("median"), F.round(at(F.floor(3 * n / 4)), 6).alias("p75"),
        F.round(F.max("x"), 6).alias("greatest"), F.round(F.sum(F.col("x") * F.col("k")) / F.sum("k"), 6).alias("mean"),
    )


def quantile_kinds(spark, base):
    """Five definitions of a quantile side by side, per composer of five rows or more."""
    f = fx(spark, base, ["measure_count"]).where("measure_count is not null and composer is not null")
    return quantiles_side_by_side(f, "composer", "measure_count")


def quantiles_side_by_side(rows, group, value, least=5):
    """Per ``group`` of ``least`` values or more: the interpolated median, the nearest
    rank of 0.9 with ties to even, the elements at n/4, 3n/4 and n/2, and the quartiles
    at places (n + 1)/4 and 3(n + 1)/4, interpolated. Read off sorted value counts."""
    n, at = F.col("n"), lambda i: value_at(i, value)

    def exclusive(q):
        pos = F.lit(q) * (n + 1)
        j = F.greatest(F.lit(1), F.least(F.floor(pos), n - 1))
        return at(j - 1) + (at(j) - at(j - 1)) * (pos - j)

    return placed_values(rows, [group], value).where(n >= least).groupBy(group, "n").agg(
        ((at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2).alias("median"), at(F.bround(F.lit(0.9) * (n - 1)).cast("long")).alias("p90"),
        at(F.floor(n / 4)).alias("q1"), at(F.floor(n * 3 / 4)).alias("q3"), at(F.floor(n / 2)).alias("upper_median"),
        F.round(exclusive(0.25), 6).alias("q1_exclusive"), F.round(exclusive(0.75), 6).alias("q3_exclusive"),
    )


def missing_counts(spark, base):
    t = table(spark, base, "features")
    return S.missing(t, t.columns)


def impute_standardize(spark, base):
    """Moments of the imputed and standardised design, per column."""
    cols = FEW
    d = S.standardize(S.impute_median(fx(spark, base, FEW).select(*cols), cols), cols)
    return S.unpivot(d, [], cols).groupBy("feature").agg(F.count("*").alias("n"), F.round(F.min("x"), 5).alias("least"), F.round(F.max("x"), 5).alias("greatest"), F.round(F.sum(F.abs("x")) / F.count("*"), 5).alias("mean_abs"))


def percentile_ranks(spark, base):
    p = S.percentile_ranks(fx(spark, base, ["midi_max", "measure_count"]), ["midi_max", "measure_count"])
    return p.select("feature", "x", F.round("pct", 6).alias("pct"))


def rule_grader(spark, base):
    f = fx(spark, base, list(G.RULE_FEATURES))
    return G.rule_grades(f, ["candidate_id", "load_id"])


def _graded(spark, base):
    f = fx(spark, base, list(G.RULE_FEATURES))
    r = G.rule_grades(f, ["candidate_id", "load_id"]).select("candidate_id", "load_id", F.col("predicted").cast("int").alias("predicted"))
    return f.select("candidate_id", "load_id", "g", "source").join(r, ["candidate_id", "load_id"])


def confusion_matrix(spark, base):
    return S.confusion(_graded(spark, base), "g", "predicted")


def agreement_rollup(spark, base):
    return S.agreement(_graded(spark, base), "g", "predicted")


def agreement_by_era(spark, base):
    """Per era: rows, exact hits and a map of what was predicted."""
    j = _graded(spark, base).join(grades(spark, base).select("candidate_id", "era"), "candidate_id").where("g is not null and era is not null")
    per = j.groupBy("era", "predicted").agg(F.count("*").alias("n"), F.count_if(F.col("g") == F.col("predicted")).alias("hit"))
    return per.groupBy("era").agg(F.sum("n").alias("n"), F.sum("hit").alias("n_exact"), F.array_join(F.sort_array(F.collect_list(F.format_string("%d:%d", "predicted", "n"))), ",").alias("predictions"))


def stratified_round_robin(spark, base):
    """Ungraded pieces by era, in turn from the rule's bands."""
    f = fx(spark, base, list(G.RULE_FEATURES))
    first = f.groupBy("candidate_id").agg(F.min("load_id").alias("load_id"))
    r = G.rule_grades(f, ["candidate_id", "load_id"]).join(first, ["candidate_id", "load_id"])
    j = r.join(grades(spark, base).select("candidate_id", "era"), "candidate_id").join(f.select("candidate_id", "load_id", "g"), ["candidate_id", "load_id"]).where("g is null")
    s = S.round_robin(j.withColumn("band", F.coalesce("predicted", F.lit("?"))), "era", "band", ["candidate_id"], {"classical": 18, "romantic": 7, "modern": 1, "baroque": 5, "renaissance": 3, "unknown": 16})
    return s.select("era", "place", "band", "candidate_id")


PROBES = [("study", "(?i)study|etude|etüde", "(?i)ferdinando|octavio", 5), ("waltz", "(?i)waltz|walzer|valse", "(?i)urbano|silvio", 4), ("none", "(?i)symphony", ".", 9), ("march", "(?i)marche?|marsch", "(?i)^(agn|pil)", 6)]


def probe_consensus(spark, base):
    """Patterns of title and composer against all pieces, held against a set grade."""
    t = table(spark, base, "dummy_advisor_grades", ["candidate_id", "source", "title", "composer_normalized", "dummy_grade"]).distinct()
    rows = t.select("candidate_id", F.lower(F.trim("source")).alias("source"), "title", F.col("composer_normalized").alias("composer"), F.col("dummy_grade").alias("g"))
    probes = spark.createDataFrame(PROBES, "probe string, title_re string, composer_re string, consensus int")
    return G.consensus(G.probe_matches(rows, F.broadcast(probes)))


def era_lookup(spark, base):
    """Composers with their era from the list; what the list lacks stays unmapped."""
    g = grades(spark, base)
    era = table(spark, base, "composer_era", ["composer", F.col("era").alias("listed_era")])
    return g.join(era, "composer", "left").groupBy(F.coalesce("listed_era", F.lit("unmapped")).alias("listed_era")).agg(F.count("*").alias("n"), F.countDistinct("composer").alias("n_composers"))


def unmapped_composers(spark, base):
    return grades(spark, base).where("composer is not null").join(table(spark, base, "composer_era", ["composer"]), "composer", "left_anti").select("composer").distinct()


def longest_prefix(spark, base):
    """Each spelling's longest listed name it begins with."""
    names = grades(spark, base).where("composer is not null").select("composer").distinct()
    listed = table(spark, base, "composer_era", [F.col("composer").alias("entry"), "era"])
    return S.longest_prefix(names, "composer", listed, "entry", ["era"])


def label_override(spark, base):
    """Curators' grades from the features, overlaid by the advisor's."""
    f = fx(spark, base, []).where("g is not null").groupBy("candidate_id").agg(F.max_by("g", "load_id").alias("g"))
    j = f.join(grades(spark, base).select("candidate_id", "dummy_grade"), "candidate_id", "full_outer")
    return j.select("candidate_id", F.coalesce("dummy_grade", "g").alias("label")).where("label is not null")


def write_back(spark, base):
    """Durations written back to the pieces: matched, updated and skipped."""
    d = fx(spark, base, ["duration_sec_approx"]).where("duration_sec_approx is not null").groupBy("candidate_id").agg(F.max_by("duration_sec_approx", "load_id").alias("d"))
    j = grades(spark, base).join(d, "candidate_id", "left")
    return j.groupBy("source").agg(F.count("*").alias("n"), F.count("d").alias("updated"), F.count_if(F.col("d").isNull()).alias("skipped"), F.round(F.max("d"), 3).alias("longest"))


def min_fret_table(spark, base):
    f = fx(spark, base, ["midi_min", "midi_max"])
    return f.select(F.col("midi_max").cast("int").alias("midi")).where("midi is not null").distinct().withColumn("fret", X.min_fret("midi"))


def score_model(spark, base):
    """Grades from stored coefficients, without a library: three classes, two features."""
    f = fx(spark, base, ["midi_max", "measure_count"]).where("midi_max is not null and measure_count is not null")
    s = G.score_logistic(f, ["midi_max", "measure_count"], [[-0.5, -0.3], [0.1, 0.2], [0.4, 0.1]], [0.2003, 0.5, -0.70001], [3, 5, 7], [75.0, 40.0], [6.0, 30.0])
    return s.select("candidate_id", "load_id", "predicted", F.round(F.get("probabilities", F.lit(0)), 6).alias("p3"), F.round(F.get("probabilities", F.lit(2)), 6).alias("p7"))


def _labelled(spark, base):
    f = fx(spark, base).groupBy("candidate_id").agg(*[F.max_by(c, "load_id").alias(c) for c in NUMERIC])
    d = G.design(f)
    return d.join(grades(spark, base).where("dummy_grade is not null").select("candidate_id", G.recode("dummy_grade").alias("label"), "composer"), "candidate_id")


def lr_train_score(spark, base):
    """A model fitted on all labelled pieces, its exact and within-one share on them."""
    d = _labelled(spark, base)
    return G.evaluate(d, d, NUMERIC).select("n", F.round("exact", 3).alias("exact"), F.round("within_one", 3).alias("within_one"))


def lr_cross_validated(spark, base):
    return G.cross_validate(_labelled(spark, base), NUMERIC, "candidate_id").select("folds", "n", F.round("exact", 3).alias("exact"), F.round("exact_std", 3).alias("exact_std"), F.round("within_one", 3).alias("within_one"))


def lr_composer_out(spark, base):
    """Fitted without the composer of most examples, tested on that composer."""
    d = cut(_labelled(spark, base))
    held = d.where("composer is not null").groupBy("composer").agg(F.count("*").alias("n")).where("n >= 10").orderBy(F.desc("n"), "composer").limit(1)
    test = d.join(F.broadcast(held.select("composer")), "composer", "left_semi")
    train = d.join(F.broadcast(held.select("composer")), "composer", "left_anti")
    return G.evaluate(train, test, NUMERIC).select("n", F.round("exact", 3).alias("exact"), F.round("within_one", 3).alias("within_one"))


NAMES = (
    "grade_distribution top_composers source_counts grade_sources crosstab_composers crosstab_eras grade_dispersion concentration eta_squared pearson_pairs group_medians source_medians summary quantile_kinds "
    "missing_counts impute_standardize percentile_ranks rule_grader confusion_matrix agreement_rollup agreement_by_era stratified_round_robin probe_consensus era_lookup unmapped_composers longest_prefix "
    "label_override write_back min_fret_table score_model lr_train_score lr_cross_validated lr_composer_out"
).split()
QUERIES = {n: globals()[n] for n in NAMES}


def _long(cols, keys=""):
    return "u as (" + " union all ".join(f"select {keys}'{c}' as feature, {c} as x from fx" for c in cols) + ")"


_RULE = list(G.RULE_FEATURES)
_BANDS = "case when composite is null then null " + " ".join(f"when composite >= {a} and composite < {b} then '{c}'" for a, b, c in G.BANDS) + f" else '{G.BANDS[-1][2]}' end"
_RULED = f"""{_fx_sql(_RULE)}, {_long(_RULE, 'candidate_id, load_id, ')},
pr as (select *, 100.0 * ((rank() over (partition by feature order by x) + (count(*) over (partition by feature, x) - 1) / 2.0) - 1) / greatest(count(*) over (partition by feature) - 1, 1) as pct from u where x is not null),
cp as (select candidate_id, load_id, round(list_sum(list(pct order by feature)) / count(*), 6) as composite from pr group by 1, 2),
rg as (select f.candidate_id, f.load_id, f.g, f.source, composite, {_BANDS} as predicted from fx f left join cp using (candidate_id, load_id))"""
_TAB = ", ".join(f"count(*) filter (dummy_grade = {i}) as g{i}" for i in range(1, 11))
_TABS = ", ".join(f"sum(g{i})::bigint as g{i}" for i in range(1, 11))

SQL = {
    "grade_distribution": f"with {GRADES_SQL} select dummy_grade, count(*) as n from lg group by 1",
    "top_composers": f"with {GRADES_SQL} select coalesce(nullif(composer, ''), '(unknown)') as value, count(*) as n from lg group by 1 order by n desc, min(candidate_id) limit 15",
    "source_counts": f"with {GRADES_SQL} select case when starts_with(candidate_id, 'gh:') then split_part(candidate_id, '@', 1) else split_part(candidate_id, ':', 1) end as value, count(*) as n from lg group by 1 order by n desc, min(candidate_id) limit 20",
    "grade_sources": "select dummy_grade, dummy_grade_source, count(*) as n, grouping(dummy_grade, dummy_grade_source)::int as gid from dummy_advisor_grades group by grouping sets ((dummy_grade), (dummy_grade_source))",
    "crosstab_composers": f"with {GRADES_SQL}, x as (select composer, {_TAB}, count(*) as total from lg where composer is not null group by 1), r as (select *, row_number() over (order by total desc, composer) as rn from x) select * exclude (rn) from r where rn <= 20 union all by name select '(other)' as composer, {_TABS}, sum(total)::bigint as total from r where rn > 20",
    "crosstab_eras": f"with {GRADES_SQL} select era, {_TAB}, count(*) as total from lg group by 1",
    "grade_dispersion": f"with {GRADES_SQL}, p as (select composer, count(distinct dummy_grade) as labels, count(*) as n from lg where composer is not null and dummy_grade is not null group by 1) select labels, count(*) as n_members, sum(n)::bigint as n_rows from p group by 1",
    "concentration": f"with {GRADES_SQL}, m as (select dummy_grade, composer, count(*) as n from lg where dummy_grade is not null and composer is not null group by 1, 2), r as (select *, row_number() over (partition by dummy_grade order by n desc, composer) as rn from m) select dummy_grade, sum(n)::bigint as n, count(*) as members, round(sum(n) filter (rn <= 1) / sum(n), 6) as top1, round(sum(n) filter (rn <= 3) / sum(n), 6) as top3, round(sum(n * n) / (sum(n) * sum(n)), 6) as hhi from r group by 1",
    "eta_squared": f"with {_fx_sql(FEW)}, k as (select composer from fx where composer is not null group by 1 having count(*) >= 5), f2 as (select fx.* from fx join k using (composer)), u as ({' union all '.join(f'select composer, {chr(39)}{c}{chr(39)} as feature, {c} as x from f2' for c in FEW)}), v as (select * from u where x is not null), m as (select feature, avg(x) as gm from v group by 1), g as (select feature, composer, count(*) as n, avg(x) as am, sum((x - gm) * (x - gm)) as q from v join m using (feature) group by 1, 2) select feature, sum(n)::bigint as n, count(*) as n_groups, round(case when sum(n) >= 30 and count(*) >= 2 and sum(q) > 0 then sum(n * (am - gm) * (am - gm)) / sum(q) end, 6) as eta2 from g join m using (feature) group by 1",
    "pearson_pairs": f"with {_fx_sql(FEW)} select a, b, n, round(r, 6) as r from (" + " union all ".join(f"select '{a}' as a, '{b}' as b, count(*) filter ({a} is not null and {b} is not null) as n, corr({a}, {b}) as r from fx" for i, a in enumerate(FEW) for b in FEW[i + 1 :]) + ") where n >= 30 and not isnan(r) and abs(r) >= 0.05",
    "group_medians": f"with {_fx_sql(FEW)}, {_long(FEW, 'g, ')} select g, feature, round(median(x), 6) as median from u where g is not null group by 1, 2",
    "source_medians": f"with {_fx_sql(FEW)}, {_long(FEW, 'source, ')} select feature, " + ", ".join(f"round(median(x) filter (source = '{s}'), 6) as {s}" for s in ("mutopia", "guitarloot", "github", "pdmx", "imslp")) + " from u group by 1",
    "summary": f"with {_fx_sql(FEW)}, {_long(FEW)}, l as (select feature, count(*) as n, list_sort(list(x)) as v, avg(x) as mean from u where x is not null group by 1) select feature, n, round(v[1], 6) as least, round(v[n // 4 + 1], 6) as p25, round((v[(n - 1) // 2 + 1] + v[n // 2 + 1]) / 2, 6) as median, round(v[3 * n // 4 + 1], 6) as p75, round(v[n], 6) as greatest, round(mean, 6) as mean from l",
    "quantile_kinds": f"with {_fx_sql(['measure_count'])}, l as (select composer, count(*) as n, list_sort(list(measure_count)) as v from fx where measure_count is not null and composer is not null group by 1 having count(*) >= 5) select composer, n, (v[(n - 1) // 2 + 1] + v[n // 2 + 1]) / 2 as median, v[round_even(0.9::double * (n - 1), 0)::int + 1] as p90, v[n // 4 + 1] as q1, v[n * 3 // 4 + 1] as q3, v[n // 2 + 1] as upper_median, round(v[greatest(1, least(floor(0.25 * (n + 1)), n - 1))::int] + (v[greatest(1, least(floor(0.25 * (n + 1)), n - 1))::int + 1] - v[greatest(1, least(floor(0.25 * (n + 1)), n - 1))::int]) * (0.25 * (n + 1) - greatest(1, least(floor(0.25 * (n + 1)), n - 1))), 6) as q1_exclusive, round(v[greatest(1, least(floor(0.75 * (n + 1)), n - 1))::int] + (v[greatest(1, least(floor(0.75 * (n + 1)), n - 1))::int + 1] - v[greatest(1, least(floor(0.75 * (n + 1)), n - 1))::int]) * (0.75 * (n + 1) - greatest(1, least(floor(0.75 * (n + 1)), n - 1))), 6) as q3_exclusive from l",
    "impute_standardize": f"with {_fx_sql(FEW)}, i as (select " + ", ".join(f"coalesce({c}, (select median({c}) from fx), 0) as {c}" for c in FEW) + " from fx), z as (select " + ", ".join(f"({c} - avg({c}) over ()) / case when stddev_pop({c}) over () > 0 then stddev_pop({c}) over () else 1 end as {c}" for c in FEW) + " from i), u as (" + " union all ".join(f"select '{c}' as feature, {c} as x from z" for c in FEW) + ") select feature, count(*) as n, round(min(x), 5) as least, round(max(x), 5) as greatest, round(sum(abs(x)) / count(*), 5) as mean_abs from u group by 1",
    "percentile_ranks": f"with {_fx_sql(['midi_max', 'measure_count'])}, {_long(['midi_max', 'measure_count'])} select distinct feature, x, round(100.0 * ((rank() over (partition by feature order by x) + (count(*) over (partition by feature, x) - 1) / 2.0) - 1) / greatest(count(*) over (partition by feature) - 1, 1), 6) as pct from u where x is not null",
    "rule_grader": f"with {_RULED} select candidate_id, load_id, composite, predicted from rg",
    "confusion_matrix": f"with {_RULED} select g, predicted::int as predicted, count(*) as n from rg where g is not null and predicted is not null group by 1, 2",
    "agreement_rollup": f"with {_RULED}, k as (select g, predicted::int as p from rg where g is not null and predicted is not null) select g, count(*) as n, round(avg((g = p)::int), 6) as exact, round(avg((abs(g - p) <= 1)::int), 6) as within_one from k group by rollup (g)",
    "agreement_by_era": f"with {_RULED}, {GRADES_SQL}, j as (select era, predicted::int as predicted, count(*) as n, count(*) filter (g = predicted::int) as hit from rg join lg using (candidate_id) where g is not null and era is not null group by 1, 2) select era, sum(n)::bigint as n, sum(hit)::bigint as n_exact, coalesce(string_agg(case when predicted is null then 'null:' || n else predicted || ':' || n end, ',' order by case when predicted is null then 'null:' || n else predicted || ':' || n end), '') as predictions from j group by 1",
    "stratified_round_robin": f"with {_RULED}, {GRADES_SQL}, f1 as (select candidate_id, min(load_id) as load_id from fx group by 1), j as (select candidate_id, era, coalesce(predicted, '?') as band from rg join f1 using (candidate_id, load_id) join lg using (candidate_id) where rg.g is null), t as (select * from (values ('classical', 18), ('romantic', 7), ('modern', 1), ('baroque', 5), ('renaissance', 3), ('unknown', 16)) v(era, target)), a as (select j.*, target, row_number() over (partition by era, band order by candidate_id) as turn from j join t using (era)), b as (select *, row_number() over (partition by era order by turn, band) as place from a) select era, place, band, candidate_id from b where place <= target",
    "probe_consensus": "with r as (select distinct candidate_id, source as s0, title, composer_normalized as composer, dummy_grade as g from dummy_advisor_grades), p as (select * from (values " + ", ".join(f"('{a}', '{b}', '{c}', {d})" for a, b, c, d in PROBES) + ") v(probe, title_re, composer_re, consensus)), j as (select p.*, r.candidate_id, r.g, lower(trim(r.s0, ' ')) as source from p left join r on regexp_matches(title, title_re) and regexp_matches(composer, composer_re)), a as (select probe, consensus, count(candidate_id) as n_match, list_sort(coalesce(list(g) filter (g is not null), [])) as gs, coalesce(array_to_string(list_sort(list(distinct source) filter (source is not null)), '+'), '') as sources from j group by 1, 2) select probe, consensus, n_match, gs[len(gs) // 2 + 1] as median, gs[1] as least, gs[len(gs)] as greatest, sources, gs[len(gs) // 2 + 1] - consensus as delta, case when n_match = 0 then 'no match' when len(gs) = 0 then 'no grade' when abs(gs[len(gs) // 2 + 1] - consensus) <= 1 then 'good' when abs(gs[len(gs) // 2 + 1] - consensus) <= 2 then 'fair' else 'off' end as verdict from a",
    "era_lookup": f"with {GRADES_SQL} select coalesce(e.era, 'unmapped') as listed_era, count(*) as n, count(distinct lg.composer) as n_composers from lg left join composer_era e on lg.composer = e.composer group by 1",
    "unmapped_composers": f"with {GRADES_SQL} select distinct composer from lg where composer is not null and composer not in (select composer from composer_era)",
    "longest_prefix": f"with {GRADES_SQL}, n as (select distinct composer from lg where composer is not null) select n.composer, arg_max(e.composer, length(e.composer)) as entry, arg_max(coalesce(e.era, chr(1)), length(e.composer)) as era from n join composer_era e on starts_with(n.composer, e.composer) group by 1",
    "label_override": f"with {_fx_sql(['midi_max'])}, {GRADES_SQL}, f as (select candidate_id, arg_max(g, load_id) as g from fx where g is not null group by 1) select candidate_id, coalesce(dummy_grade, g) as label from f full join lg using (candidate_id) where coalesce(dummy_grade, g) is not null",
    "write_back": f"with {_fx_sql(['duration_sec_approx'])}, {GRADES_SQL}, d as (select candidate_id, arg_max(duration_sec_approx, load_id) as d from fx where duration_sec_approx is not null group by 1) select source, count(*) as n, count(d) as updated, count(*) - count(d) as skipped, round(max(d), 3) as longest from lg left join d using (candidate_id) group by 1",
    "min_fret_table": f"with {_fx_sql(['midi_min', 'midi_max'])}, m as (select distinct midi_max::int as midi from fx where midi_max is not null) select midi, (select min(midi - s) from (values (40), (45), (50), (55), (59), (64)) v(s) where midi - s between 0 and 24) as fret from m",
    "score_model": f"with {_fx_sql(['midi_max', 'measure_count'])}, z as (select *, (midi_max - 75) / 6 as a, (measure_count - 40) / 30 as b from fx where midi_max is not null and measure_count is not null), l as (select *, -0.5 * a - 0.3 * b + 0.2003 as l3, 0.1 * a + 0.2 * b + 0.5 as l5, 0.4 * a + 0.1 * b - 0.70001 as l7 from z) select candidate_id, load_id, case when l3 >= l5 and l3 >= l7 then 3 when l5 >= l7 then 5 else 7 end as predicted, round(exp(l3) / (exp(l3) + exp(l5) + exp(l7)), 6) as p3, round(exp(l7) / (exp(l3) + exp(l5) + exp(l7)), 6) as p7 from l",
}


def _missing_sql():
    text = ["candidate_id", "source", "title", "composer_normalized", "grade", "grade_source", "key_fifths", "time_sig"]
    doubles = ["midi_median", "tempo_bpm", "notes_per_measure", "polyphonic_measure_ratio", "duration_sec_approx"]
    ints = [c for c in "load_id extracted_at midi_min midi_max midi_range key_changes meter_changes smallest_division dotted_count tied_count tuplet_count accidentals_outside_key max_chord_stack voice_count_max ornament_mordent ornament_trill ornament_turn grace_count harmonic_count barre_count position_shift_proxy pitch_min_fret_max pitch_min_fret_p90 pitch_position_shifts measure_count note_count".split()]
    parts = [f"select '{c}' as column_name, count(*) filter (coalesce({c}, '') = '') as missing, count(*) as n from features" for c in text]
    parts += [f"select '{c}', count(*) filter ({c} is null or isnan({c})), count(*) from features" for c in doubles]
    parts += [f"select '{c}', count(*) filter ({c} is null), count(*) from features" for c in ints]
    return f"select column_name, missing, round(missing / n, 6) as share from ({' union all '.join(parts)})"


SQL["missing_counts"] = _missing_sql()
SQL["longest_prefix"] = SQL["longest_prefix"].replace("arg_max(coalesce(e.era, chr(1)), length(e.composer)) as era", "nullif(arg_max(coalesce(e.era, chr(1)), length(e.composer)), chr(1)) as era")
