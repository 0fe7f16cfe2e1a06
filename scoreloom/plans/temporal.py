"""Queries over ordered data: as-of and interval joins, islands, takes, event time."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import temporal as T
from ..sources.tables import table


def asof_segment(spark, base):
    """Each event with the last order placed before it, by day."""
    e = table(spark, base, "events", ["event_id", "user_id", "ts"]).select("event_id", (F.col("user_id") % 10).alias("k"), F.date_add(F.to_date("ts"), -365 * 24).alias("day"))
    o = table(spark, base, "orders", ["o_orderkey", "o_custkey", "o_orderdate"]).select((F.col("o_custkey") % 10).alias("k"), F.to_date("o_orderdate").alias("day"), F.col("o_orderkey").alias("orderkey"), F.to_date("o_orderdate").alias("order_day"))
    return T.asof_join(e, o, ["k"], "day", ["orderkey", "order_day"]).select("event_id", "orderkey", F.col("order_day").cast("string").alias("order_day"))


CHANGES = [(0, 0.0, 120.0), (1, 960.0, 60.0), (2, 960.0, 90.0), (3, 1920.0, 0.0), (4, 2880.0, 240.0)]


def tempo_map(spark, base):
    """Ticks to milliseconds along a map of tempo changes, some of them invalid."""
    c = spark.createDataFrame(CHANGES, "seq int, tick double, bpm double").withColumn("score", F.lit(1))
    seg = T.tempo_segments(c, ["score"], 960, 120.0)
    rows = table(spark, base, "lineitem", ["l_orderkey", "l_linenumber", "l_quantity"]).select("l_orderkey", "l_linenumber", F.lit(1).alias("score"), (F.col("l_quantity") * 100 - 50).alias("tick"))
    j = T.asof_join(rows.withColumn("start_tick", F.greatest("tick", F.lit(0.0))), seg.withColumn("st", F.col("start_tick")), ["score"], "start_tick", ["st", "start_ms", "ms_per_tick"])
    return j.select("l_orderkey", "l_linenumber", "tick", F.round(T.tick_to_ms(F.col("tick"), F.col("st"), F.col("start_ms"), F.col("ms_per_tick")), 5).alias("ms"))


SPANS = [("a", 100.0, 300.0), ("b", 250.0, 1200.0), ("c", 900.0, 900.0), ("d", 1100.0, 5000.0)]


def interval_join(spark, base):
    """How many prices lie in each span; spans overlap."""
    s = spark.createDataFrame(SPANS, "span string, lo double, hi double")
    p = table(spark, base, "lineitem", ["l_extendedprice"])
    return T.interval_join(p, s, "l_extendedprice", "lo", "hi", 256.0).groupBy("span").agg(F.count("*").alias("n"), F.round(F.max("l_extendedprice"), 2).alias("greatest"))


def interval_join_spans(spark, base):
    """Orders of a priority that fall into the six hours after an event."""
    e = table(spark, base, "events", ["event_id", "ts", "event_type"]).where("event_type = 'error'").select("event_id", F.unix_timestamp("ts").cast("double").alias("lo")).withColumn("hi", F.col("lo") + 21600.0)
    p = table(spark, base, "events", ["event_id", "ts", "event_type"]).where("event_type = 'purchase'").select(F.col("event_id").alias("p"), F.unix_timestamp("ts").cast("double").alias("at"))
    return T.interval_join(p, e, "at", "lo", "hi", 21600.0).groupBy("event_id").agg(F.count("*").alias("n"))


def _path(spark, base):
    """A take per user: events in time, the reference frame from the value, bars of 16."""
    e = table(spark, base, "events", ["event_id", "user_id", "ts", "event_type", "value"])
    return e.select(
        F.col("user_id").alias("take"), F.struct("ts", "event_id").alias("t"), F.floor(F.col("value") / 2).cast("int").alias("pos"),
        F.when(F.col("event_type") != "signup", F.floor(F.col("value") / 32).cast("int")).alias("bar"), (F.col("event_type") == "error").alias("silent"), F.col("value").alias("cost"),
    )


def take_bars(spark, base):
    return T.analyze_takes(_path(spark, base), hold_from=1).drop("mean_cost")


def take_summary(spark, base):
    return T.take_summary(T.analyze_takes(_path(spark, base), hold_from=1))


def hardest_bars(spark, base):
    return T.hardest_bars(T.analyze_takes(_path(spark, base), hold_from=1), 2.0)


def attempts_islands(spark, base):
    p = _path(spark, base)
    i = T.islands(p, ["take"], ["t"], "bar")
    return i.where("island is not null").groupBy("take").agg(F.countDistinct("island").alias("runs"), F.count("*").alias("frames"))


def event_windows(spark, base):
    """Events per type in tumbling hours of event time."""
    e = table(spark, base, "events", ["ts", "event_type", "value"])
    w = F.window(F.col("ts").cast("timestamp"), "1 hour")
    return e.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


def event_sessions(spark, base):
    """Sessions of a user: events at most two hours apart."""
    e = table(spark, base, "events", ["ts", "user_id"])
    w = F.session_window(F.col("ts").cast("timestamp"), "2 hours")
    return e.groupBy("user_id", w.alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


def capture_ratio(spark, base):
    """Frames produced over those a fixed rate would give, per user."""
    e = table(spark, base, "events", ["ts", "user_id"])
    a = e.groupBy("user_id").agg(F.count("*").alias("n"), (F.unix_timestamp(F.max("ts")) - F.unix_timestamp(F.min("ts"))).alias("seconds"))
    return a.select("user_id", "n", F.round(F.try_divide("n", F.col("seconds") / 3600.0), 6).alias("per_hour"))


QUERIES = {f.__name__: f for f in (asof_segment, tempo_map, interval_join, interval_join_spans, take_bars, take_summary, hardest_bars, attempts_islands, event_windows, event_sessions, capture_ratio)}

_PATH = """path as (select user_id as take, ts, event_id, floor(value / 2)::int as pos, case when event_type <> 'signup' then floor(value / 32)::int end as bar, event_type = 'error' as silent, value as cost from events),
p1 as (select *, lag(bar) over w as pb, lag(pos) over w as pp from path window w as (partition by take order by ts, event_id)),
p2 as (select *, bar is not null and bar is distinct from pb as enter, bar is not null and pos is not distinct from pp as still, coalesce(bar is not null and bar is distinct from pb and pb is not null and pp - pos >= 20, false) as back from p1),
p3 as (select *, sum(enter::int) over w as island, sum((not still)::int) over w as stand from p2 window w as (partition by take order by ts, event_id)),
runs as (select take, bar, stand, count(*) as n from p3 where bar is not null and still group by 1, 2, 3),
holds as (select take, bar, max(n) as hold from runs group by 1, 2),
per as (select take, bar, island, count(*) as n, count(*) filter (silent) as silent, sum(cost) as cost, count(*) filter (back) as to_bar from p3 where bar is not null group by 1, 2, 3),
b0 as (select take, bar, count(distinct island) as attempts, sum(n)::bigint as frames, arg_max(n, island) as last_attempt, sum(silent)::bigint as silent, round(sum(cost) / sum(n), 6) as mean_cost, sum(to_bar)::bigint as restarts_to from per group by 1, 2),
origin as (select take, pb as bar, count(*) as restarts_from from p3 where back group by 1, 2),
bars as (select b0.*, coalesce(hold, 0) as hold, coalesce(restarts_from, 0) as restarts_from from b0 left join holds using (take, bar) left join origin using (take, bar))"""

SQL = {
    "asof_segment": "with e as (select event_id, user_id % 10 as k, (ts::date - 365 * 24) as day from events), o as (select o_custkey % 10 as k, o_orderdate::date as day, max(o_orderkey) as orderkey from orders group by 1, 2) select event_id, orderkey, o.day::varchar as order_day from e asof left join o on e.k = o.k and e.day >= o.day",
    "tempo_map": "with seg as (select * from (values (0.0, 0.0, 60000.0 / (120 * 960)), (960.0, 500.0, 60000.0 / (90 * 960)), (2880.0, 500.0 + 1920 * 60000.0 / (90 * 960), 60000.0 / (240 * 960))) v(st, ms, rate)), r as (select l_orderkey, l_linenumber, l_quantity * 100 - 50 as tick from lineitem) select l_orderkey, l_linenumber, tick, round(ms + (greatest(tick, 0) - st) * rate, 5) as ms from r asof join seg on greatest(r.tick, 0) >= seg.st",
    "interval_join": "with s as (select * from (values " + ", ".join(f"('{a}', {b}, {c})" for a, b, c in SPANS) + ") v(span, lo, hi)) select span, count(*) as n, round(max(l_extendedprice), 2) as greatest from lineitem join s on l_extendedprice >= lo and l_extendedprice < hi group by 1",
    "interval_join_spans": "with e as (select event_id, floor(epoch(ts)) as lo from events where event_type = 'error'), p as (select floor(epoch(ts)) as pt from events where event_type = 'purchase') select event_id, count(*) as n from e join p on pt >= lo and pt < lo + 21600 group by 1",
    "take_bars": f"with {_PATH} select take, bar, attempts, frames, last_attempt, silent, restarts_to, hold, restarts_from from bars",
    "take_summary": f"with {_PATH} select take, count(*) as reached, max(bar) as furthest, sum(attempts)::bigint as attempts, sum(restarts_from)::bigint as restarts, count(*) filter (hold > 0) as held_bars, max(hold) as longest_hold, round(avg(last_attempt), 6) as mean_last from bars group by 1",
    "hardest_bars": f"with {_PATH}, s as (select *, greatest(0, last_attempt / 2.0 - 1) as slow, hold / 2.0 as held, attempts - 1 as retry from bars), r as (select *, round(slow + held + retry, 6) as score from s), q as (select *, row_number() over (partition by take order by score desc, bar) as rank, array_to_string(list_filter([case when slow > 0.25 then 'slow' end, case when held > 0 then 'held' end, case when retry > 0 then retry || ' retries' end], lambda x: x is not null), ', ') as why from r where score > 0) select take, rank, bar, score, case when coalesce(why, '') = '' then 'clean' else why end as reason from q where rank <= 5",
    "attempts_islands": f"with {_PATH} select take, count(distinct island) as runs, count(*) as frames from p3 where bar is not null group by 1",
    "event_windows": "select date_trunc('hour', ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2",
    "event_sessions": "with a as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 2 hours then 0 else 1 end as st from events), b as (select *, sum(st) over (partition by user_id order by ts rows unbounded preceding) as s from a) select user_id, min(ts) as start, count(*) as n from b group by user_id, s",
    "capture_ratio": "select user_id, count(*) as n, round(count(*) / nullif((floor(epoch(max(ts))) - floor(epoch(min(ts)))) / 3600.0, 0), 6) as per_hour from events group by 1",
}
