"""Ordered data: as-of and interval joins, islands, tempo maps, take analysis."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.cut import size_checked
from .ordering import null_safe, ranged


def asof_join(left: DataFrame, right: DataFrame, by: Sequence[str], on: str, body: Sequence[str]) -> DataFrame:
    """Each left row with the last right row of the same ``by`` whose ``on`` is not later.
    Both sides are put in one order, which is cut into ranges, and the last right row is
    carried forward within a range and from range to range: never a product of both
    sides, and a key may hold any share of the rows. Right rows of equal ``on`` are told
    apart by ``body``; left rows without one get nulls; null ``on`` matches nothing."""
    r = right.where(F.col(on).isNotNull()).groupBy(*by, on).agg(F.max(F.struct(*body)).alias("_r"))
    ours = left.select(*by, on, F.struct(*left.columns).alias("_l"))
    both = ours.unionByName(r.select(*by, on, "_r"), allowMissingColumns=True).withColumn("_side", F.col("_l").isNotNull().cast("int"))
    placed = ranged(both, [*by, on, "_side"])
    inside = Window.partitionBy("_p", *by).orderBy(F.col(on).asc_nulls_first(), "_side").rowsBetween(Window.unboundedPreceding, 0)
    # the last right row of each key in each range it lies in, and of the ranges before
    ends = placed.groupBy("_p", *by).agg(F.max_by("_r", F.when(F.col("_r").isNotNull(), F.col(on))).alias("_e"))
    before = ends.withColumn("_b", F.last("_e", ignorenulls=True).over(Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)))
    known = placed.withColumn("_in", F.last("_r", ignorenulls=True).over(inside)).where("_side = 1").alias("l")
    carried = known.join(size_checked(before.where("_b is not null").select("_p", *by, "_b"), 500_000).alias("r"), null_safe(["_p", *by]), "left").select("_l", F.coalesce("_in", "_b").alias("_r"))
    return carried.select("_l.*", *[F.when(F.col(f"_l.{on}").isNotNull(), F.col(f"_r.{c}")).alias(c) for c in body])


def asof_small(left: DataFrame, right: DataFrame, on: str, body: Sequence[str], starts: Sequence) -> DataFrame:
    """As-of join with a short list of breakpoints: the place is found by counting the
    ``starts`` (in order) not later, then an equi-join on it. No window, no shuffle of
    the left side."""
    place = sum((F.when(F.col(on) >= F.lit(s), 1).otherwise(0) for s in starts), F.lit(0))
    return left.withColumn("_i", place).join(F.broadcast(right.withColumnRenamed("place", "_i").select("_i", *body)), "_i", "left").drop("_i")


def interval_join(points: DataFrame, spans: DataFrame, at: str, start: str, end: str, width: float) -> DataFrame:
    """Pairs of points and spans with start <= at < end. Time is cut into cells of
    ``width``; a span is copied to the cells it touches, and both meet by an equi-join
    on the cell. Choose a width near the usual span length. Empty spans match nothing."""
    cell = lambda c: F.floor(F.col(c) / width).cast("long")
    spread = spans.where(F.col(end) > F.col(start)).withColumn("_cell", F.explode(F.sequence(cell(start), F.ceil(F.col(end) / width).cast("long") - 1)))
    return points.withColumn("_cell", cell(at)).join(spread, "_cell").where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("_cell")


def islands(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, name: str = "island") -> DataFrame:
    """Adds the number of the run of equal values a row belongs to; a null value ends a
    run and belongs to none."""
    w = Window.partitionBy(*by).orderBy(*order)
    starts = F.when(F.col(value).isNotNull() & ~F.lag(value).over(w).eqNullSafe(F.col(value)), 1).otherwise(0)
    return df.withColumn("_s", starts).withColumn(name, F.when(F.col(value).isNotNull(), F.sum("_s").over(w))).drop("_s")


def tempo_segments(changes: DataFrame, by: Sequence[str], ticks_per_quarter: int, fallback: float) -> DataFrame:
    """Segments (start_tick, start_ms, ms_per_tick) from tempo changes (tick, bpm).
    Changes without a finite tick from 0 on or a positive tempo are dropped; of several
    at one tick the one of the highest ``seq`` counts; before the first the fallback holds."""
    ok = changes.where("tick >= 0 and bpm > 0 and not isnan(bpm) and bpm < double('infinity') and tick < double('infinity')")
    last = ok.groupBy(*by, "tick").agg(F.max_by("bpm", "seq").alias("bpm"))
    head = last.groupBy(*by).agg(F.min("tick").alias("t")).where("t > 0").select(*by, F.lit(0.0).alias("tick"), F.lit(float(fallback)).alias("bpm"))
    w = Window.partitionBy(*by).orderBy("tick")
    seg = last.withColumn("tick", F.col("tick").cast("double")).unionByName(head).withColumn("rate", F.lit(60000.0) / (F.col("bpm") * ticks_per_quarter))
    seg = seg.withColumn("len", (F.lead("tick").over(w) - F.col("tick")) * F.col("rate"))
    return seg.withColumn("start_ms", F.coalesce(F.sum("len").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).select(*by, F.col("tick").alias("start_tick"), "start_ms", F.col("rate").alias("ms_per_tick"))


def tick_to_ms(tick: Column, start_tick: Column, start_ms: Column, rate: Column) -> Column:
    """Time of a tick from its segment, ticks below 0 counting as 0."""
    return start_ms + (F.greatest(tick, F.lit(0)) - start_tick) * rate


def analyze_takes(path: DataFrame, take: str = "take", hold_from: int = 8, jump: int = 20) -> DataFrame:
    """Per take and bar what an aligned performance shows. ``path`` has (take, t, pos,
    bar, silent, cost): for every frame the reference frame it is matched to and that
    frame's bar, null outside all bars.

    attempts: entries into the bar; last_attempt: frames of the last one; frames in
    all; hold: longest stand on one reference frame from ``hold_from`` repeats; restarts
    from and to the bar: returns by ``jump`` frames or more at a change of bar; silent
    frames; mean cost. One sort per take serves all windows."""
    w = Window.partitionBy(take).orderBy("t")
    p = path.withColumns({"pb": F.lag("bar").over(w), "pp": F.lag("pos").over(w)})
    enter = F.col("bar").isNotNull() & ~F.col("pb").eqNullSafe(F.col("bar"))
    stay = F.col("bar").isNotNull() & F.col("pos").eqNullSafe(F.col("pp"))
    back = enter & F.col("pb").isNotNull() & (F.col("pp") - F.col("pos") >= jump)
    p = p.withColumns({"enter": enter, "still": stay, "back": back})
    p = p.withColumns({"island": F.sum(F.col("enter").cast("int")).over(w), "stand": F.sum((~F.coalesce(F.col("still"), F.lit(False))).cast("int")).over(w)})
    runs = p.where("bar is not null and still").groupBy(take, "bar", "stand").agg(F.count("*").alias("n"))
    holds = runs.where(F.col("n") >= hold_from).groupBy(take, "bar").agg(F.max("n").alias("hold"))
    per = p.where("bar is not null").groupBy(take, "bar", "island").agg(F.count("*").alias("n"), F.count_if("silent").alias("silent"), F.sum("cost").alias("cost"), F.count_if("back").alias("to_bar"))
    bars = per.groupBy(take, "bar").agg(
        F.countDistinct("island").alias("attempts"), F.sum("n").alias("frames"), F.max_by("n", "island").alias("last_attempt"),
        F.sum("silent").alias("silent"), F.round(F.sum("cost") / F.sum("n"), 6).alias("mean_cost"), F.sum("to_bar").alias("restarts_to"),
    )
    origin = p.where("back").groupBy(take, F.col("pb").alias("bar")).agg(F.count("*").alias("restarts_from"))
    return bars.join(holds, [take, "bar"], "left").join(origin, [take, "bar"], "left").na.fill(0, ["hold", "restarts_from"])


def take_summary(bars: DataFrame, take: str = "take") -> DataFrame:
    """Per take: bars reached, the furthest, attempts, restarts, holds, longest hold."""
    return bars.groupBy(take).agg(
        F.count("*").alias("reached"), F.max("bar").alias("furthest"), F.sum("attempts").alias("attempts"), F.sum("restarts_from").alias("restarts"),
        F.count_if(F.col("hold") > 0).alias("held_bars"), F.max("hold").alias("longest_hold"), F.round(F.avg("last_attempt"), 6).alias("mean_last"),
    )


def hardest_bars(bars: DataFrame, expected: float, take: str = "take", limit: int = 5) -> DataFrame:
    """The bars of each take that cost most: slowdown over the expected frames, holds and
    retries; the reasons in words."""
    slow = F.greatest(F.lit(0.0), F.col("last_attempt") / expected - 1)
    held, retry = F.col("hold") / expected, F.col("attempts") - 1
    s = bars.withColumn("score", F.round(slow + held + retry, 6)).where("score > 0")
    why = F.array_join(F.array_compact(F.array(F.when(slow > 0.25, "slow"), F.when(held > 0, "held"), F.when(retry > 0, F.concat(retry.cast("string"), F.lit(" retries"))))), ", ")
    w = Window.partitionBy(take).orderBy(F.desc("score"), "bar")
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).select(take, "rank", "bar", "score", F.when(why == "", "clean").otherwise(why).alias("reason"))
