"""Corpus statistics."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.cut import cut
from .ordering import placed_values, value_at


def counts(df: DataFrame, key: Column | str, name: str = "n", tie: str | None = None) -> DataFrame:
    """Group counts; with ``tie`` also where each group first appears (its least ``tie``),
    by which equal counts are ordered."""
    k = F.col(key) if isinstance(key, str) else key
    return df.groupBy(k.alias("value")).agg(F.count("*").alias(name), *([F.min(tie).alias("first_pos")] if tie else []))


def crosstab(df: DataFrame, row: str, column: str, values: Sequence, prefix: str = "c_") -> DataFrame:
    """Counts of ``column``'s given values per ``row``, and all rows as ``total``; one
    aggregate, no second scan for the column values."""
    return df.groupBy(row).agg(*[F.count_if(F.col(column) == v).alias(f"{prefix}{v}") for v in values], F.count("*").alias("total"))


def concentration(df: DataFrame, group: str, member: str) -> DataFrame:
    """Per group: rows, distinct members, the shares of the largest and of the three
    largest members, and the Herfindahl index (sum of squared shares). Two levels of
    partial aggregates; the ranking sees one row a member. Null members are left out."""
    m = df.where(F.col(member).isNotNull()).groupBy(group, member).agg(F.count("*").alias("n"))
    r = m.withColumn("rn", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), member)))
    total = F.sum("n")
    return r.groupBy(group).agg(
        total.alias("n"), F.count("*").alias("members"),
        F.round(F.sum(F.when(F.col("rn") <= 1, F.col("n"))) / total, 6).alias("top1"),
        F.round(F.sum(F.when(F.col("rn") <= 3, F.col("n"))) / total, 6).alias("top3"),
        F.round(F.sum(F.col("n") * F.col("n")) / (total * total), 6).alias("hhi"),
    )


def dispersion(df: DataFrame, member: str, label: str) -> DataFrame:
    """How many members have how many distinct labels, and how many rows they hold."""
    per = df.where(F.col(member).isNotNull() & F.col(label).isNotNull()).groupBy(member).agg(F.countDistinct(label).alias("labels"), F.count("*").alias("n"))
    return per.groupBy("labels").agg(F.count("*").alias("n_members"), F.sum("n").alias("n_rows"))


def eta_squared(df: DataFrame, group: str, values: Sequence[str], least_group: int = 5, least: int = 30) -> DataFrame:
    """Share of each column's variance that lies between groups of ``least_group`` rows
    or more. Null with fewer than ``least`` values, one group or no variance. Values
    are centred on a first mean before they are squared, so nothing cancels."""
    big = df.groupBy(group).agg(F.count("*").alias("_n")).where(F.col("_n") >= least_group).select(group)
    kept = df.join(big, group, "left_semi")
    long = kept.select(group, F.explode(F.array(*[F.struct(F.lit(v).alias("feature"), F.nanvl(F.col(v).cast("double"), F.lit(None)).alias("x")) for v in values])).alias("u")).select(group, "u.*").where("x is not null")
    long = cut(long.groupBy(group, "feature", "x").agg(F.count("*").alias("k")))
    centre = long.groupBy("feature").agg((F.sum(F.col("x") * F.col("k")) / F.sum("k")).alias("centre"))
    c = long.join(F.broadcast(centre), "feature").withColumn("d", F.col("x") - F.col("centre"))
    g = c.groupBy("feature", group).agg(F.sum("k").alias("n"), F.sum(F.col("d") * F.col("k")).alias("s"), F.sum(F.col("d") * F.col("d") * F.col("k")).alias("q"))
    total = F.sum("q") - F.sum("s") * F.sum("s") / F.sum("n")
    between = F.sum(F.col("s") * F.col("s") / F.col("n")) - F.sum("s") * F.sum("s") / F.sum("n")
    return g.groupBy("feature").agg(F.sum("n").alias("n"), F.count("*").alias("n_groups"), between.alias("b"), total.alias("t")).select(
        "feature", "n", "n_groups", F.round(F.when((F.col("n") >= least) & (F.col("n_groups") >= 2) & (F.col("t") > 0), F.col("b") / F.col("t")), 6).alias("eta2")
    )


def pearson(df: DataFrame, columns: Sequence[str], least: int = 30, threshold: float = 0.0) -> DataFrame:
    """Correlation of every pair of columns over the rows that have both, from one pass
    over the table. Null and NaN are missing; constants and pairs of fewer than
    ``least`` rows have none."""
    clean = df.select(*[F.nanvl(F.col(c).cast("double"), F.lit(None)).alias(c) for c in columns])
    parts = []
    for a, b in combinations(columns, 2):
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        x, y = F.when(both, F.col(a)), F.when(both, F.col(b))
        parts.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.count_if(both).alias("n"), F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)).alias("r")))
    return (
        clean.agg(F.array(*parts).alias("p")).select(F.explode("p").alias("p")).select("p.*")
        .where((F.col("n") >= least) & F.col("r").isNotNull() & (F.abs("r") >= threshold)).withColumn("r", F.round("r", 6))
    )


def unpivot(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(keys..., feature, x), NaN as null, nulls kept."""
    return df.select(*keys, F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.nanvl(F.col(c).cast("double"), F.lit(None)).alias("x")) for c in columns])).alias("u")).select(*keys, "u.*")


def medians(long: DataFrame, group: Sequence[str], value: str = "x") -> DataFrame:
    """(group..., median): the interpolated median of each group, null for one without
    values. From value counts in sorted ranges: no group is gathered in one task."""
    n = F.col("n")
    middle = (value_at(F.floor((n - 1) / 2), value) + value_at(F.floor(n / 2), value)) / 2
    return placed_values(long, group, value).groupBy(*group, "n").agg(middle.alias("median")).drop("n")


def group_medians(df: DataFrame, group: str, columns: Sequence[str]) -> DataFrame:
    """(group, feature, median): the interpolated median of each column per group."""
    return medians(unpivot(df, [group], columns), [group, "feature"]).withColumn("median", F.round("median", 6))


def missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Null, NaN or empty cells per column, and their share."""
    def gone(c):
        kind = df.schema[c].dataType.simpleString()
        t = F.col(c).isNull()
        return t | (F.col(c) == "") if kind == "string" else t | F.isnan(c) if kind in ("double", "float") else t

    one = df.agg(F.count("*").alias("n"), F.array(*[F.struct(F.lit(c).alias("column_name"), F.count_if(gone(c)).alias("missing")) for c in columns]).alias("a"))
    return one.select("n", F.explode("a").alias("x")).select("x.column_name", "x.missing", F.round(F.col("x.missing") / F.col("n"), 6).alias("share"))


def impute_median(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing numbers replaced by the column's median over all rows; a column without
    numbers becomes 0."""
    clean = df.withColumns({c: F.nanvl(F.col(c).cast("double"), F.lit(None)) for c in columns})
    med = medians(unpivot(df, [], columns), ["feature"]).agg(F.map_from_entries(F.collect_list(F.struct("feature", "median")))).scalar()  # one row a column
    return clean.withColumn("_m", med).select(*[F.coalesce(F.col(c), F.col("_m")[c], F.lit(0.0)).alias(c) if c in columns else F.col(c) for c in df.columns])


def standardize(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(x - mean) / population deviation, a deviation of 0 counting as 1."""
    s = df.agg(F.struct(*[F.struct(F.avg(c).alias("a"), F.stddev_pop(c).alias("s")).alias(c) for c in columns]).alias("m")).scalar()
    scaled = lambda c: (F.col(c) - F.col("_m")[c]["a"]) / F.when(F.col("_m")[c]["s"] > 0, F.col("_m")[c]["s"]).otherwise(1.0)
    return df.withColumn("_m", s).select(*[scaled(c).alias(c) if c in columns else F.col(c) for c in df.columns])


def percentile_ranks(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, x, pct): for each value of each column its percentile rank, ties
    sharing their average: 100 (average rank - 1) / max(n - 1, 1). Ranked are the value
    counts, range-sorted with offsets, so no column is gathered in one task."""
    placed = placed_values(unpivot(df, [], columns).where("x is not null"), ["feature"], "x")
    average = F.col("upto") - (F.col("k") - 1) / 2
    return placed.select("feature", "x", (F.lit(100.0) * (average - 1) / F.greatest(F.col("n") - 1, F.lit(1))).alias("pct"))


def confusion(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    return df.where(F.col(actual).isNotNull() & F.col(predicted).isNotNull()).groupBy(actual, predicted).agg(F.count("*").alias("n"))


def agreement(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Exact and within-one agreement per actual value, and over all (null), by ROLLUP."""
    ok = df.where(F.col(actual).isNotNull() & F.col(predicted).isNotNull())
    hit = (F.col(actual) == F.col(predicted)).cast("double")
    near = (F.abs(F.col(actual) - F.col(predicted)) <= 1).cast("double")
    return ok.withColumn("hit", hit).withColumn("near", near).rollup(actual).agg(F.count("*").alias("n"), F.round(F.avg("hit"), 6).alias("exact"), F.round(F.avg("near"), 6).alias("within_one"))


def round_robin(df: DataFrame, stratum: str, sub: str, order: Sequence[str], targets: dict) -> DataFrame:
    """A stratified sample: per stratum its target number of rows, taken in turn from
    its sub-strata in order. Adds ``place``."""
    inner = Window.partitionBy(stratum, sub).orderBy(*order)
    outer = Window.partitionBy(stratum).orderBy("_turn", sub)
    target = F.coalesce(*[F.when(F.col(stratum) == k, F.lit(v)) for k, v in targets.items()], F.lit(0))
    most = max(targets.values(), default=0)
    # no stratum needs more than its target from one sub-stratum
    few = df.where(target > 0).withColumn("_turn", F.row_number().over(inner)).where(F.col("_turn") <= most)
    return few.withColumn("place", F.row_number().over(outer)).where(F.col("place") <= target).drop("_turn")


def longest_prefix(names: DataFrame, name: str, listed: DataFrame, entry: str, body: Sequence[str]) -> DataFrame:
    """(name, entry, body...): the longest listed entry that each name begins with. A
    name asks for those of its prefixes whose length occurs in the list, by equi-join;
    null and empty entries are no prefix. Of equal entries the one with the least body."""
    lengths = listed.where(F.col(entry) != "").agg(F.sort_array(F.collect_set(F.length(entry)))).scalar()  # distinct lengths only
    asked = names.withColumn("_l", lengths).withColumn("_k", F.explode(F.transform(F.filter("_l", lambda n: n <= F.length(name)), lambda n: F.substring(F.col(name), F.lit(1), n))))
    j = asked.join(listed.select(F.col(entry).alias("_k"), F.col(entry), *body), "_k")
    return j.groupBy(name).agg(F.min_by(F.struct(entry, *body), F.struct(-F.length(entry), *body)).alias("r")).select(name, "r.*")


# ---------------------------------------------------------------- fixed values
HEDGES = ("Attr. ", "Attr.", "after ", "? ", "?")  # before a name, of which the first that fits goes
UNNAMED = "anon"
# ---------------------------------------------------------------- end of fixed values


def attributed(names: DataFrame, name: str, listed: DataFrame, entry: str, value: str, markers: Sequence[str] = (), marked: str | None = None, hedges: Sequence[str] = HEDGES) -> DataFrame:
    """(name, found, how) of distinct names: what a list (entry, value) says of each, after
    one hedge before it is dropped. In this order: the entry itself ('exact'); names that
    begin like an unnamed author or hold a marker get ``marked`` ('unnamed', 'marker'); the
    entry in another case ('case'); the longest entry it begins with in any case
    ('prefix'); else null and 'none'. All by equi-joins on the list."""
    bare = F.trim(F.col(name))
    for h in reversed(hedges):
        bare = F.when(F.trim(F.col(name)).startswith(h), F.trim(F.substring(F.trim(F.col(name)), F.lit(len(h) + 1), F.lit(1 << 30)))).otherwise(bare)
    n = names.select(name).distinct().withColumn("_n", bare).withColumn("_c", F.lower("_n"))
    exact = listed.where(F.col(entry) != "").groupBy(F.col(entry).alias("_n")).agg(F.min(value).alias("_exact"), F.lit(True).alias("_is"))
    folded = listed.where(F.col(entry) != "").groupBy(F.lower(entry).alias("_c")).agg(F.min(value).alias("_v"))
    prefix = longest_prefix(n.select("_c").distinct(), "_c", folded.withColumnRenamed("_c", "_e"), "_e", ["_v"])
    j = n.join(exact, "_n", "left").join(prefix, "_c", "left")
    unnamed = F.col("_c").startswith(UNNAMED)
    has = F.lit(False)
    for m in markers:
        has = has | F.col("_c").contains(m)
    how = F.when(F.col("_is"), "exact").when(unnamed, "unnamed").when(has, "marker").when(F.col("_e") == F.col("_c"), "case").when(F.col("_e").isNotNull(), "prefix").otherwise("none")
    found = F.when(how == "exact", F.col("_exact")).when(how.isin("unnamed", "marker"), F.lit(marked)).otherwise(F.col("_v"))
    return j.select(name, found.alias("found"), how.alias("how"))
