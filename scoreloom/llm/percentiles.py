"""Problem 5: percentiles per group of very large numeric columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordering import running_total
from ..plans.cut import cut
from ..sources.tables import table

POINTS = (0.01, 0.05, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)
METRICS = ("notes_per_measure", "duration_sec_approx")


def grade_number(c: str) -> Column:
    """A grade as typed (" 05", "5 ") as a number from 1 to 10, else null."""
    g = F.expr(f"try_cast(regexp_extract({c}, '^\\\\s*0*([1-9][0-9]?)\\\\s*$', 1) as int)")
    return F.when(g.between(1, 10), g)


def value_counts(df: DataFrame, group: Sequence[str], metrics: Sequence[str], relative_error: float = 0.0) -> DataFrame:
    """(group..., metric, value, n): how often each value occurs. Null and NaN are no
    values. Tables of several days or loads combine by ``merge_counts``.

    With ``relative_error`` e > 0 positive and negative values are kept as the
    middle of their cell on a geometric grid, so any percentile is off by at most
    the share e of itself and there are few distinct values; with 0 all is exact.
    """
    long = df.select(*group, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("x"))
    long = long.select(*group, "x.metric", "x.value").where("value is not null and not isnan(value)")
    if relative_error > 0:
        grow = (1 + relative_error) / (1 - relative_error)
        cell = F.ceil(F.log(F.abs("value")) / F.log(F.lit(grow)))
        mid = F.signum("value") * 2 * F.pow(F.lit(grow), cell) / (F.lit(grow) + 1)
        long = long.withColumn("value", F.when(F.col("value") == 0, 0.0).when(F.abs("value") == float("inf"), F.col("value")).otherwise(mid))
    long = long.withColumn("value", F.when(F.col("value") == 0, 0.0).otherwise(F.col("value")))  # -0.0 is 0.0
    return long.groupBy(*group, "metric", "value").agg(F.count("*").alias("n"))


def merge_counts(tables: Sequence[DataFrame], group: Sequence[str]) -> DataFrame:
    """The counts of several tables as those of one, over the columns ``group``."""
    every = reduce(DataFrame.unionByName, tables)
    return every.groupBy(*group, "metric", "value").agg(F.sum("n").alias("n"))


def percentiles(counts: DataFrame, group: Sequence[str], points: Sequence[float] = POINTS) -> DataFrame:
    """(group..., metric, p, value, n_values): the first value whose cumulative
    frequency reaches the rank ceil(p n), at least 1. Groups without values have no
    rows; null is a group of its own.

    The counts are range-sorted by group and value; running sums within partitions
    plus the sums of the partitions before give cumulative frequencies, however
    large a group is.
    """
    keys = [*group, "metric"]
    run = cut(running_total(counts.where("n > 0"), [*keys, "value"], F.col("n"), "upto"))
    ends = run.groupBy(*keys).agg(F.max("upto").alias("_end"), F.sum("n").alias("n_values"))
    on = reduce(lambda a, b: a & b, [F.col(f"r.{k}").eqNullSafe(F.col(f"e.{k}")) for k in keys])
    placed = (
        run.alias("r").join(ends.alias("e"), on)
        .select(*[f"r.{k}" for k in keys], "value", "n", "n_values", (F.col("upto") - F.col("_end") + F.col("n_values")).alias("upto"))
    )
    ps = F.array(*[F.lit(float(p)) for p in points])
    hits = F.filter(ps, lambda p: (F.greatest(F.ceil(p * F.col("n_values")), F.lit(1)) <= F.col("upto")) & (F.greatest(F.ceil(p * F.col("n_values")), F.lit(1)) > F.col("upto") - F.col("n")))
    return placed.select(*keys, F.explode(hits).alias("p"), "value", "n_values")


def _features(spark, base):
    return table(spark, base, "features", ["load_id", "grade", *METRICS]).withColumn("grade", grade_number("grade"))


def p5_percentiles(spark: SparkSession, base: str) -> DataFrame:
    """Per load and grade, and with load_id null per grade over all loads, the latter
    from the loads' count tables combined."""
    by_load = cut(value_counts(_features(spark, base).where("load_id is not null"), ["load_id", "grade"], METRICS))
    every = merge_counts([by_load], ["grade"]).withColumn("load_id", F.lit(None).cast("int"))
    return percentiles(by_load.unionByName(every), ["load_id", "grade"])


def p5_overall(spark: SparkSession, base: str) -> DataFrame:
    """Per grade over all rows, without the way by loads."""
    return percentiles(value_counts(_features(spark, base), ["grade"], METRICS), ["grade"])


def p5_bounded(spark: SparkSession, base: str) -> DataFrame:
    """As p5_percentiles, within one percent, from far fewer distinct values."""
    return percentiles(value_counts(_features(spark, base), ["grade"], METRICS, 0.01), ["grade"])


_LONG = r"""
f as (select load_id, case when regexp_full_match(grade, '\s*0*([1-9][0-9]?)\s*') and cast(regexp_extract(grade, '0*([1-9][0-9]?)', 1) as int) between 1 and 10
        then cast(regexp_extract(grade, '0*([1-9][0-9]?)', 1) as int) end as grade, notes_per_measure, duration_sec_approx from features),
long as (select load_id, grade, 'notes_per_measure' as metric, notes_per_measure as value from f union all select load_id, grade, 'duration_sec_approx', duration_sec_approx from f),
ok as (select * from long where value is not null and not isnan(value))"""

def _sql(load: str, where: str) -> str:
    g = f"{load}grade, metric"
    return f"""select {g}, p, value, n_values from (select {g}, value, row_number() over (partition by {g} order by value) as rn, count(*) over (partition by {g}) as n_values from ok {where}),
(select unnest([{', '.join(map(str, POINTS))}]::double[]) as p) where rn = greatest(ceil(p * n_values), 1)"""


SQL = {
    "p5_percentiles": f"with {_LONG} select * from ({_sql('load_id, ', 'where load_id is not null')}) union all by name select null::int as load_id, * from ({_sql('', '')})",
    "p5_overall": f"with {_LONG} {_sql('', '')}",
}
