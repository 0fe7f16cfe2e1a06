"""Discovery: optional filters, facets, and a diverse round-robin list."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import leading_int, resolve_grade


def with_grade(pieces: DataFrame) -> DataFrame:
    """Adds ``kind``, ``resolved`` and ``g``: whose grade counts, and as a number."""
    r = resolve_grade("grade", "model_grade")
    return pieces.withColumn("_r", r).select("*", F.col("_r.kind").alias("kind"), F.col("_r.grade").alias("resolved"), leading_int("_r.grade").alias("g")).drop("_r")


def apply_filters(pieces: DataFrame, query: str = "", composer: str = "", era: str = "all", max_duration: float | None = None, kind: str = "all", low: int | None = None, high: int | None = None) -> DataFrame:
    """The pieces that pass all given filters. What is missing in a piece never
    matches a filter on it. All predicates are conjuncts, so Catalyst pushes them down."""
    tests: list[Column] = []
    if query.strip():
        tests.append(F.lower(F.concat_ws(" ", "title", "composer")).contains(query.strip().lower()))
    if composer.strip():
        tests.append(F.lower("composer").contains(composer.strip().lower()))
    if era != "all":
        tests.append(F.col("era") == era)
    if max_duration is not None:
        tests.append(F.col("duration") <= max_duration)
    out = with_grade(pieces)
    if kind != "all":
        tests.append(F.col("kind") == kind)
    if low is not None:
        tests.append(F.col("g") >= low)
    if high is not None:
        tests.append(F.col("g") <= high)
    return out.where(reduce(lambda a, b: a & b, tests)) if tests else out


def build_feed(pieces: DataFrame, statuses: DataFrame, level: int, cap: int = 30, per_group: int = 3, hidden=("too_hard", "not_for_me"), sink: str = "completed", down: str = "too_hard", down_from: int = 2) -> DataFrame:
    """A list of at most ``cap`` pieces of ``level`` and the level above, taken in turn
    from groups (composers), so that no large group fills it.

    Hidden pieces are left out, ``sink`` pieces come last in their group, groups with
    ``down_from`` or more ``down`` pieces come last, else larger groups first; ties by
    first appearance (``pos``). A group gives at most max(per_group, ceil(cap / groups))
    pieces. Columns: place, candidate_id, title, composer, g.

    Ranks within groups and of groups are windows over partial keys; only rows that
    can still be among the first ``cap`` reach the final sort.
    """
    all_ = with_grade(pieces).join(statuses.select("candidate_id", "status"), "candidate_id", "left").withColumn("group", F.coalesce("composer", F.lit("?")))
    downs = all_.where(F.col("status") == down).groupBy("group").agg(F.count("*").alias("downs"))
    match = all_.where(~F.coalesce(F.col("status").isin(*hidden), F.lit(False)) & F.col("g").isin(level, level + 1))
    turn = Window.partitionBy("group").orderBy(F.coalesce((F.col("status") == sink).cast("int"), F.lit(0)), "title", "pos")
    ranked = match.withColumn("turn", F.row_number().over(turn)).where(F.col("turn") <= cap)
    groups = match.groupBy("group").agg(F.count("*").alias("size"), F.min("pos").alias("seen")).join(downs, "group", "left")
    order = F.struct((F.coalesce("downs", F.lit(0)) >= down_from).cast("int").alias("d"), (-F.col("size")).alias("s"), F.col("seen").alias("p"))
    n = groups.agg(F.count("*").alias("n")).scalar()
    limited = ranked.join(groups.withColumn("rank", order), "group").where(F.col("turn") <= F.greatest(F.lit(per_group), F.ceil(F.lit(cap) / F.greatest(n, F.lit(1)))))
    first = limited.orderBy("turn", "rank").limit(cap)
    return first.withColumn("place", F.row_number().over(Window.orderBy("turn", "rank"))).select("place", "candidate_id", "title", F.col("group").alias("composer"), "g")  # cap rows


def facet(pieces: DataFrame, column: str, name: str = "n") -> DataFrame:
    """How often each value occurs, missing ones under '?'."""
    return pieces.groupBy(F.coalesce(F.col(column), F.lit("?")).alias(column)).agg(F.count("*").alias(name))


def top_per_group(df: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group; Spark's group-limit cuts rows before the shuffle."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("_rn") <= n).drop("_rn")
