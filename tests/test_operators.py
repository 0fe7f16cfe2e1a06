
import numpy as np
import pytest
from pyspark.sql import functions as F

from scoreloom.functions import exprs as X
from scoreloom.operators import feed, grading, ingest, ordering, profile, scoretime, signals, stats, temporal


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def one(spark, column, **values):
    import pandas as pd

    return spark.createDataFrame(pd.DataFrame({k: [v] for k, v in values.items()})).select(column.alias("x")).first().x


# ordering ---------------------------------------------------------------------

def test_running_total_over_partitions(spark):
    df = spark.range(1000).withColumn("k", (F.col("id") * 7919) % 1000).withColumn("w", F.when(F.col("id") % 10 == 0, None).otherwise(F.lit(2)))
    got = {r.k: r.upto for r in ordering.running_total(df, ["k"], F.col("w"), parts=7).collect()}
    want, total = {}, 0
    by = {r.k: r.w for r in df.collect()}
    for k in range(1000):
        total += by[k] or 0
        want[k] = total
    assert got == want


def test_rank_in_group_hot_group_and_null_group(spark):
    df = spark.range(500).select(F.when(F.col("id") % 5 == 0, None).when(F.col("id") % 5 < 4, "hot").otherwise("b").alias("g"), (F.col("id") * 37 % 500).alias("v"))
    got = {(r.g, r.v): r["rank"] for r in ordering.rank_in_group(df, ["g"], ["v"], parts=5).collect()}
    assert len(got) == 500
    for g in (None, "hot", "b"):
        vs = sorted(v for (h, v) in got if h == g)
        assert [got[(g, v)] for v in vs] == list(range(1, len(vs) + 1))


def test_running_total_empty(spark):
    assert ordering.running_total(spark.range(0), ["id"]).count() == 0


@pytest.mark.parametrize("n,width,parts", [(300, 5, 7), (9, 6, 8), (2, 4, 3), (0, 4, 2)])
def test_sliding_compare_crosses_partitions(spark, n, width, parts):
    import pandas as pd

    def compare(pdf, a_to, b_from):
        k = pdf["k"].tolist()
        out = [(k[i], k[j]) for i in range(min(a_to, len(k))) for j in range(max(i + 1, b_from), min(len(k), i + width))]
        return pd.DataFrame(out, columns=["x", "y"])

    df = spark.range(n).select((F.col("id") * 17 % 1009).alias("k"))
    ks = sorted(r.k for r in df.collect())
    want = sorted((ks[i], ks[j]) for i in range(n) for j in range(i + 1, min(n, i + width)))
    got = rows(ordering.sliding_compare([(df, ["k"])], width, compare, "x long, y long", parts, chunk=10))
    assert sorted(got) == want


# expressions ------------------------------------------------------------------

def test_quantile_definitions(spark):
    v = F.array(*[F.lit(float(x)) for x in (5, 1, 4, 2, 3, 6, 8, 7)])
    df = spark.range(1)
    got = df.select(X.quarter_low(v), X.quarter_high(v), X.upper_median(v), X.quantile_exclusive(v, 0.25), X.p90_nearest(F.array(F.lit(0), F.lit(1), F.lit(12)))).first()
    assert tuple(got) == (3.0, 7.0, 5.0, 2.25, 12)


@pytest.mark.parametrize("midi,fret", [(40, 0), (44, 4), (45, 0), (64, 0), (88, 24), (89, None), (39, None)])
def test_min_fret(spark, midi, fret):
    assert one(spark, X.min_fret("m"), m=midi) == fret


@pytest.mark.parametrize("step,octave,alter,want", [("C", "4", None, 60), ("f", "4", "1", 66), ("B", "3", "-1.0", 58), ("H", "4", None, None), ("C", "x", None, None), ("C", "4", "q", 60)])
def test_note_midi(spark, step, octave, alter, want):
    df = spark.createDataFrame([(step, octave, alter)], "s string, o string, a string")
    assert df.select(X.note_midi("s", "o", "a").alias("x")).first().x == want


@pytest.mark.parametrize("title,want", [("Test piece", "test"), ("7", "digits-only"), ("ab", "too-short"), ("", None), ("Prelude", None), ("contest", None)])
def test_suspicious_title(spark, title, want):
    assert one(spark, X.suspicious_title("t"), t=title) == want


@pytest.mark.parametrize("raw,want", [("Robinson\nfrom a book", "Robinson"), ("F. Sor (1778-1839)", "F. Sor"), ("Dowland 1563-1626", "Dowland"), ("X fl. 1610 in Rome", "X"), ("  A   B ,", "A B")])
def test_normalize_composer(spark, raw, want):
    assert one(spark, X.normalize_composer("r"), r=raw).strip() == want


@pytest.mark.parametrize("seconds,want", [(61.4, "1:01"), (61.5, "1:02"), (0.0, "—"), (float("inf"), "—"), (3600.0, "60:00")])
def test_format_duration(spark, seconds, want):
    assert one(spark, X.format_duration("s"), s=seconds) == want


def test_resolve_grade_prefers_curator_and_takes_empty_as_missing(spark):
    df = spark.createDataFrame([("5", "7"), ("", "7"), (None, None), ("", "")], "g string, m string")
    got = [tuple(r.x) for r in df.select(X.resolve_grade("g", "m").alias("x")).collect()]
    assert got == [("curator", "5", "curator"), ("model", "7", "model"), ("none", None, None), ("none", None, None)]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0, 0.0, 0.0],), ([0.0, 0.0, 0.0, 0.0],)], "v array<double>")
    got = [r.x for r in df.select(X.normalize_bands("v", 2).alias("x")).collect()]
    assert np.allclose(got[0], [0.6, 0.8, 0, 0]) and got[1] == [0.0] * 4
    assert one(spark, X.cosine_distance(F.array(F.lit(0.0)), F.array(F.lit(1.0))), z=1) == 1.0


# statistics -------------------------------------------------------------------

def test_percentile_ranks_with_ties(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (4.0,), (None,), (float("nan"),)], "x double")
    got = {r.x: round(r.pct, 3) for r in stats.percentile_ranks(df, ["x"]).collect()}
    assert got == {1.0: 0.0, 2.0: 50.0, 4.0: 100.0}
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,)], "x double")
    assert [round(r.pct, 1) for r in stats.percentile_ranks(df, ["x"]).orderBy("x").collect()] == [0.0, 33.3, 66.7, 100.0]


def test_statistics_of_an_empty_table(spark):
    e = spark.createDataFrame([], "g string, x double, y double")
    assert stats.eta_squared(e, "g", ["x"]).count() == 0
    assert stats.pearson(e, ["x", "y"]).count() == 0
    assert stats.percentile_ranks(e, ["x"]).count() == 0
    assert stats.concentration(e, "g", "g").count() == 0


def test_pearson_of_a_constant_is_left_out(spark):
    df = spark.range(50).select(F.col("id").cast("double").alias("a"), F.lit(1.0).alias("b"), (F.col("id") * -2).cast("double").alias("c"))
    assert rows(stats.pearson(df, ["a", "b", "c"])) == [("a", "c", 50, -1.0)]


def test_impute_median(spark):
    df = spark.createDataFrame([(1.0, None), (None, None), (3.0, None), (float("nan"), None)], "a double, b double")
    assert sorted(r.a for r in stats.impute_median(df, ["a", "b"]).collect()) == [1.0, 2.0, 2.0, 3.0]
    assert {r.b for r in stats.impute_median(df, ["a", "b"]).collect()} == {0.0}


def test_rule_bands_cover_the_range(spark):
    edges = [b[0] for b in grading.BANDS] + [grading.BANDS[-1][1]]
    assert all(a[1] == b[0] for a, b in zip(grading.BANDS, grading.BANDS[1:])) and edges[0] == 0 and edges[-1] > 100
    df = spark.createDataFrame([(0.0,), (20.0,), (100.0,), (None,)], "x double")
    assert [r.b for r in df.select(X.band("x", grading.BANDS).alias("b")).collect()] == ["3", "5", "8", None]


def test_round_robin(spark):
    df = spark.createDataFrame([("e", "a", i) for i in range(5)] + [("e", "b", 10)] + [("f", "a", 99)], "s string, k string, i int")
    got = [(r.place, r.k, r.i) for r in stats.round_robin(df, "s", "k", ["i"], {"e": 4}).orderBy("place").collect()]
    assert got == [(1, "a", 0), (2, "b", 10), (3, "a", 1), (4, "a", 2)]


def test_logistic_learns_and_scores_without_library(spark):
    rng = np.random.default_rng(1)
    data = [(i, float(a), float(b), 3 if a + b < -0.5 else 5 if a + b < 0.7 else 7) for i, (a, b) in enumerate(rng.normal(size=(300, 2)))]
    df = spark.createDataFrame(data, "id int, a double, b double, label int")
    got = grading.evaluate(df, df, ["a", "b"]).first()
    assert got.n == 300 and got.exact > 0.85 and got.within_one == got.exact


# profile ----------------------------------------------------------------------

def test_deltas_add_and_retract(spark):
    a = spark.createDataFrame([(1, "x", 1.0), (1, None, float("nan")), (2, "", 2.0)], "load_id int, t string, d double")
    once = profile.apply_deltas(profile.deltas(a, ["t", "d"]))
    twice = profile.apply_deltas(once, profile.deltas(a.where("load_id = 2"), ["t", "d"], sign=-1))
    assert rows(twice) == rows(profile.apply_deltas(profile.deltas(a.where("load_id = 1"), ["t", "d"])))
    assert profile.apply_deltas(once, profile.deltas(a, ["t", "d"], sign=-1)).count() == 0
    p = {(r.load_id, r.column_name): r for r in profile.profile(once).collect()}
    assert p[(1, "d")].n_nan == 1 and p[(1, "t")].n_null == 1 and p[(2, "t")].n_blank == 1 and p[(1, "d")].n_distinct == 1
    assert p[(2, "t")].entropy == 0.0 and p[(2, "t")].least is None


def test_departures_find_what_was_planted(spark):
    rng = np.random.default_rng(3)
    data = []
    for load in range(1, 13):
        for _ in range(800):
            v = float(round(rng.normal(97, 20)))
            m = int(round(rng.normal(75, 4)))
            if load == 4 and rng.random() < 0.08:
                v /= 60
            if load == 7 and rng.random() < 0.2:
                m = None
            data.append((load, v if rng.random() > 0.05 else None, m))
    df = spark.createDataFrame(data, "load_id int, tempo_bpm double, midi_max int")
    d = profile.departures(profile.deltas(df, ["tempo_bpm", "midi_max"])).where(F.abs("z") > profile.DEPARTURE)
    assert rows(d.select("load_id", "column_name").distinct()) == [(4, "tempo_bpm"), (7, "midi_max")]
    assert profile.departures(profile.deltas(df.limit(0), ["tempo_bpm"])).count() == 0
    assert profile.departures(profile.deltas(df.where("load_id = 1"), ["tempo_bpm"])).where(F.abs("z") > 1).count() == 0


# feed -------------------------------------------------------------------------

def piece(spark, *rows_):
    return spark.createDataFrame([(i, i, t, c, g) for i, (t, c, g) in enumerate(rows_)], "candidate_id int, pos int, title string, composer string, grade string").withColumn("model_grade", F.lit(None).cast("string"))


def status(spark, **s):
    return spark.createDataFrame([(int(k[1:]), v) for k, v in s.items()] or [], "candidate_id int, status string")


def names(df):
    return [r.title for r in df.orderBy("place").collect()]


def test_feed_takes_turns_and_hides(spark):
    p = piece(spark, ("a1", "A", "5"), ("a2", "A", "5"), ("a3", "A", "6"), ("b1", "B", "5"), ("c1", "C", "9"), ("d1", None, "5"))
    assert names(feed.build_feed(p, status(spark), 5)) == ["a1", "b1", "d1", "a2", "a3"]
    assert names(feed.build_feed(p, status(spark, c0="too_hard", c3="completed"), 5)) == ["a2", "b1", "d1", "a3"]
    assert names(feed.build_feed(p, status(spark, c0="completed"), 5, cap=4)) == ["a2", "b1", "d1", "a3"]
    assert names(feed.build_feed(p, status(spark), 1)) == []


def test_feed_sinks_groups_found_too_hard(spark):
    p = piece(spark, ("a1", "A", "5"), ("a2", "A", "5"), ("a3", "A", "5"), ("a4", "A", "5"), ("b1", "B", "5"))
    assert names(feed.build_feed(p, status(spark, c0="too_hard", c1="too_hard"), 5)) == ["b1", "a3", "a4"]


# records ----------------------------------------------------------------------

def test_last_writer_wins_is_idempotent(spark):
    cur = spark.createDataFrame([("p", 1, "a", "2024-01-02"), ("p", 2, "b", "2024-01-02")], "pid string, cid int, v string, at string")
    inc = spark.createDataFrame([("p", 1, "x", "2024-01-02"), ("p", 2, "y", "2024-01-03"), ("p", 3, "z", "2024-01-01"), ("p", 4, None, "2024-01-09")], "pid string, cid int, v string, at string")
    ok = F.col("v").isNotNull()
    m = signals.lww_merge(cur, inc, ["pid", "cid"], "at", ok)
    assert [(r[1], r[2]) for r in rows(m.select("pid", "cid", "v", "at"))] == [(1, "a"), (2, "y"), (3, "z")]
    assert rows(signals.lww_merge(m, inc, ["pid", "cid"], "at", ok)) == rows(m)
    assert tuple(signals.merge_report(cur, inc, ["pid", "cid"], "at", ok).first()) == (1, 1, 1, 1)


def test_toggle(spark):
    log = spark.createDataFrame([(1, i, v) for i, v in enumerate("aab")] + [(2, i, v) for i, v in enumerate("abb")] + [(3, 0, "a")], "k int, t int, v string")
    assert rows(signals.toggle_state(log, ["k"], "v", ["t"])) == [(1, "b"), (2, None), (3, "a")]


def test_backup_survives_bad_records(spark):
    r = spark.createDataFrame([("p", "1", "ok", 3), ("p", "2", None, 4), ("q", "1", "ok", 5)], "pid string, cid string, s string, n int")
    out = signals.export_backup(r, "pid", "cid", ["s", "n"], 2)
    bad = out.unionByName(spark.createDataFrame([("z", "{broken"), ("y", '{"version":9,"records":{"1":{"s":"ok","n":1}}}')], "pid string, backup string"))
    back = signals.import_backup(bad, "pid", "s string, n int", (1, 2), F.col("s").isNotNull())
    assert rows(back) == [("p", "1", "ok", 3), ("q", "1", "ok", 5)]


# ordered data -----------------------------------------------------------------

def test_asof_join(spark):
    left = spark.createDataFrame([("a", 5, "l1"), ("a", 1, "l2"), ("b", 9, "l3"), ("a", None, "l4"), ("a", 3, "l5")], "k string, t int, id string")
    right = spark.createDataFrame([("a", 3, 30), ("a", 5, 50), ("a", 5, 51), ("a", None, 99)], "k string, t int, v int")
    got = {r.id: r.v for r in temporal.asof_join(left, right, ["k"], "t", ["v"]).collect()}
    assert got == {"l1": 51, "l2": None, "l3": None, "l4": None, "l5": 30}


def test_interval_join_is_the_product_filtered(spark):
    import random

    rng = random.Random(2)
    pts = [(i, rng.uniform(0, 50)) for i in range(80)] + [(99, 10.0)]
    spans = [(j, a, a + rng.uniform(0, 20)) for j in range(20) for a in [rng.uniform(0, 45)]] + [(77, 10.0, 10.0), (78, 10.0, 20.0)]
    p, s = spark.createDataFrame(pts, "i int, at double"), spark.createDataFrame(spans, "j int, lo double, hi double")
    got = {(r.i, r.j) for r in temporal.interval_join(p, s, "at", "lo", "hi", 7.0).collect()}
    assert got == {(i, j) for i, x in pts for j, a, b in spans if a <= x < b}


def test_tempo_segments(spark):
    c = spark.createDataFrame([(0, 960.0, 120.0), (1, 1920.0, 60.0), (2, 1920.0, 240.0), (3, -1.0, 50.0), (4, 5.0, 0.0), (5, float("nan"), 50.0)], "seq int, tick double, bpm double").withColumn("s", F.lit(1))
    got = [(r.start_tick, round(r.start_ms, 6)) for r in temporal.tempo_segments(c, ["s"], 960, 60.0).orderBy("start_tick").collect()]
    assert got == [(0.0, 0.0), (960.0, 1000.0), (1920.0, 1500.0)]


def test_take_analysis(spark):
    pos = [0, 1, 2] + [2] * 9 + [3, 40, 41, 5, 6]
    bar = [p // 4 if p < 40 else 10 for p in pos]
    path = spark.createDataFrame([(1, t, p, b, t == 1, 0.5) for t, (p, b) in enumerate(zip(pos, bar))], "take int, t int, pos int, bar int, silent boolean, cost double")
    got = {r.bar: r for r in temporal.analyze_takes(path).collect()}
    assert got[0].hold == 9 and got[0].attempts == 1 and got[0].silent == 1
    assert got[10].restarts_from == 1 and got[1].restarts_to == 1
    s = temporal.take_summary(temporal.analyze_takes(path)).first()
    assert s.reached == 3 and s.restarts == 1 and s.longest_hold == 9


# ingest -----------------------------------------------------------------------

def test_gate_gives_one_code_and_duplicates_point_at_the_first(spark):
    df = spark.createDataFrame([(1, "s", 5), (2, "s", 1), (3, "s", 5), (4, "t", 0), (5, None, 9), (6, None, 9)], "id int, sha string, n int")
    g = ingest.gate(df, [(F.col("n") == 0, "A"), (F.col("n") < 2, "B")], "id", "sha")
    assert {r.id: (r.code, r.winner) for r in g.collect()} == {1: (None, None), 2: ("B", None), 3: ("DUPLICATE", 1), 4: ("A", None), 5: (None, None), 6: (None, None)}


def test_first_wins_and_parent_fallback(spark):
    a = spark.createDataFrame([("x", "1"), (None, "9")], "candidate_id string, v string")
    b = spark.createDataFrame([("x", "2", "w"), ("y", "3", "w")], "candidate_id string, v string, extra string")
    assert rows(ingest.first_wins([a, b], "candidate_id", ["v"]).select("candidate_id", "v", "extra")) == [("x", "1", None), ("y", "3", "w")]
    kids = spark.createDataFrame([("x#m1",), ("y#m1",), ("z",)], "candidate_id string")
    parents = spark.createDataFrame([("x", "px"), ("y", "py"), ("y#m1", "own")], "candidate_id string, p string")
    assert rows(ingest.parent_fallback(kids, parents, "candidate_id", ["p"])) == [("x#m1", "px"), ("y#m1", "own"), ("z", None)]


def test_sniff(spark):
    cases = [(b"PK\x03\x04rest", "mxl"), (b"  \n<?xml version='1.0'?><a/>", "musicxml"), (b"\xef\xbb\xbf<?xml version='1.0'?>", "musicxml"), (b"<score-partwise/>", "musicxml"), (b"hello", None), (b"", None)]
    df = spark.createDataFrame([(bytearray(c),) for c, _ in cases], "c binary")
    assert [r.f for r in df.select(ingest.sniff_format(F.col("c")).alias("f")).collect()] == [w for _, w in cases]




@pytest.mark.parametrize("parts,chunk", [(1, 7), (4, 10), (9, 1000)])
def test_sliding_compare_reaches_over_partitions(spark, parts, chunk):
    import numpy as np
    import pandas as pd

    def reach(pdf, order):
        return np.searchsorted(pdf["k"].to_numpy(), pdf["k"].to_numpy() + 6, "right") - 1 - np.arange(len(pdf))

    def compare(pdf, a_to, b_from, far):
        k = pdf["k"].tolist()
        return pd.DataFrame([(k[i], k[j]) for i in range(a_to) for j in range(max(i + 1, b_from), len(k)) if j - i < 3 or j - i <= far[i]], columns=["x", "y"])

    values = sorted([*range(0, 60, 5), *range(60, 90), *range(90, 150, 20)])
    want = sorted((a, b) for i, a in enumerate(values) for j, b in enumerate(values) if i < j and (j - i < 3 or b - a <= 6))
    got = rows(ordering.sliding_compare([(spark.createDataFrame([(v,) for v in values], "k long"), ["k"])], 3, compare, "x long, y long", parts, chunk=chunk, reach=reach))
    assert sorted(got) == want


def test_sliding_compare_samples_few_orders_at_once(spark, monkeypatch):
    """The driver holds border samples of at most so many ranges, from few rows each."""
    import pandas as pd

    name, seen, cut = "spark.sql.execution.rangeExchange.sampleSizePerPartition", [], ordering.cut

    def watched(df):
        seen.append((df.rdd.getNumPartitions(), int(spark.conf.get(name))))
        return cut(df)

    def compare(pdf, a_to, b_from):
        k = pdf["k"].tolist()
        return pd.DataFrame([(k[i], k[j]) for i in range(min(a_to, len(k))) for j in range(max(i + 1, b_from), min(len(k), i + 3))], columns=["x", "y"])

    monkeypatch.setattr(ordering, "cut", watched)
    monkeypatch.setattr(ordering, "AT_ONCE", 10)
    before = spark.conf.get(name)
    orders = [(spark.range(n, n + 200).select(F.col("id").alias("k")), ["k"]) for n in (0, 1000, 2000, 3000)]
    got = rows(ordering.sliding_compare(orders, 3, compare, "x long, y long", [6, 4, 7, 12]))
    assert sorted(got) == sorted((n + i, n + j) for n in (0, 1000, 2000, 3000) for i in range(200) for j in range(i + 1, min(200, i + 3)))
    assert [n for n, _ in seen] == [10, 7, 12] and {k for _, k in seen} == {ordering.BORDER_ROWS}
    assert spark.conf.get(name) == before


def test_every_column_of_every_load_is_profiled(spark, tmp_path):
    from datetime import datetime

    from scoreloom.operators import profile

    late, usual = datetime(2020, 1, 1), datetime(2024, 1, 1)
    data = [(1, "a", "T", usual, 60.0), (1, "b", " ", usual, 61.0), (1, None, "T", late, None), (2, "a", None, None, 60.0)]
    spark.createDataFrame(data, "load_id int, candidate_id string, title string, extracted_at timestamp, tempo_bpm double").write.parquet(f"{tmp_path}/features.parquet")
    got = {(r.load_id, r.column_name): (r.n_rows, r.n_null, r.n_blank, r.n_distinct) for r in profile.QUERIES["p4_profile"](spark, str(tmp_path)).collect()}
    assert got == {
        (1, "candidate_id"): (3, 1, 0, 2), (1, "title"): (3, 0, 1, 1), (1, "extracted_at"): (3, 0, 0, 2), (1, "tempo_bpm"): (3, 1, 0, 2),
        (2, "candidate_id"): (1, 0, 0, 1), (2, "title"): (1, 1, 0, 0), (2, "extracted_at"): (1, 1, 0, 0), (2, "tempo_bpm"): (1, 0, 0, 1),
    }


def test_kept_counts_follow_the_files(spark, tmp_path, monkeypatch):
    """Only new files are scanned; a changed or removed file takes its counts away."""
    import shutil

    def write(name, data):
        spark.createDataFrame(data, "load_id int, a double, b string").coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/src/{name}")

    def counts(columns):
        kept.update(f"{tmp_path}/src", spark, columns)
        return rows(kept.read(spark, columns))

    def afresh(columns):
        df = spark.read.option("recursiveFileLookup", True).parquet(f"{tmp_path}/src")
        return rows(profile.deltas(df, columns).select(*profile.KEYS, "n"))

    kept = profile.CountTable(f"{tmp_path}/kept")
    write("one", [(1, 1.0, "x"), (1, 1.0, None), (2, float("nan"), "")])
    assert counts(["a"]) == afresh(["a"]) and len(kept.log.commits(spark)) == 1
    assert counts(["a", "b"]) == afresh(["a", "b"]) and len(kept.log.commits(spark)) == 2
    write("two", [(3, 5.0, "y"), (1, 1.0, "x")])
    assert counts(["a", "b"]) == afresh(["a", "b"])
    assert counts(["b"]) == afresh(["b"]) and len(kept.log.commits(spark)) == 3
    write("two", [(3, 7.0, "y")])
    assert counts(["a", "b"]) == afresh(["a", "b"])
    shutil.rmtree(tmp_path / "src" / "one")
    assert counts(["a", "b"]) == afresh(["a", "b"]) == [(3, "a", "7.0", 1), (3, "b", "y", 1)]
    n = len(kept.log.commits(spark))
    assert not kept.log.commit(kept.read(spark, ["a"]), {}, n - 1)  # a second writer from an old state
    assert counts(["a"]) == [(3, "a", "7.0", 1)] and len(kept.log.commits(spark)) == n


def test_latest_store_merges(spark, tmp_path):
    from scoreloom.sources.stores import LatestStore

    store = LatestStore(f"{tmp_path}/s", ["k"], ["t"], merge_after=2)
    assert store.read(spark) is None
    for i in (0, 1, 1, 2, 3, 4):
        store.write(spark.createDataFrame([(1, 10 - i, i), (i, 5, i)], "k int, t int, v int"), i)
    assert rows(store.read(spark)) == [(0, 5, 0), (1, 10, 0), (2, 5, 2), (3, 5, 3), (4, 5, 4)]


def test_longest_prefix_of_any_length(spark):
    names = spark.createDataFrame([("Sor",), ("Sorin",), ("S",), ("Bach, J.",), (None,), ("",)], "name string")
    listed = spark.createDataFrame([("Sor", "classical"), ("Bach", None), ("So", "x"), (None, "y"), ("", "z")], "entry string, era string")
    assert rows(stats.longest_prefix(names, "name", listed, "entry", ["era"])) == [("Bach, J.", "Bach", None), ("Sor", "Sor", "classical"), ("Sorin", "Sor", "classical")]
    assert stats.longest_prefix(names, "name", listed.limit(0), "entry", ["era"]).count() == 0


def test_quantiles_of_a_large_group_and_null_group(spark):
    from statistics import median

    from scoreloom.plans.stats import quantiles_side_by_side

    df = spark.range(1000).select(F.when(F.col("id") % 2 == 0, "big").when(F.col("id") % 3 == 0, None).otherwise("c").alias("g"), ((F.col("id") * 37) % 101).cast("double").alias("x"))
    got = {r.g: r for r in quantiles_side_by_side(df, "g", "x").collect()}
    assert got["big"].n == 500
    for g in (None, "big", "c"):
        v = sorted(r.x for r in df.collect() if r.g == g)
        r = got[g]
        assert (r.n, r["median"], r.q1, r.q3, r.upper_median) == (len(v), median(v), v[len(v) // 4], v[3 * len(v) // 4], v[len(v) // 2])
    m = {r.g: r["median"] for r in stats.medians(df.unionByName(spark.createDataFrame([("none", None)], "g string, x double")), ["g"]).collect()}
    assert m["none"] is None and m[None] == got[None]["median"]


def test_gate_keeps_one_of_equal_contents(spark):
    df = spark.createDataFrame([(3, "s", 1), (1, "s", 1), (1, "s", 1), (2, "s", 0), (4, None, 1), (5, None, 1), (6, "t", 1), (None, "t", 1)], "id int, sha string, ok int")
    got = rows(ingest.gate(df, [(F.col("ok") == 0, "BAD")], "id", "sha").select("id", "sha", "code", "winner"))
    assert got == sorted([(3, "s", "DUPLICATE", 1), (1, "s", "DUPLICATE", 1), (1, "s", None, None), (2, "s", "BAD", None), (4, None, None, None), (5, None, None, None), (6, "t", None, None), (None, "t", "DUPLICATE", 6)], key=repr)


def test_only_small_sides_are_broadcast(spark):
    from scoreloom.plans.cut import size_checked

    hinted = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    df = spark.range(100).withColumn("t", F.repeat(F.lit("x"), 1000))
    assert hinted(size_checked(df, 100)) and hinted(size_checked(df.limit(0), 0))
    assert not hinted(size_checked(df, 99)) and not hinted(size_checked(df.withColumn("t", F.repeat("t", 300)), 100))


def test_asof_join_over_ranges(spark):
    """A key that holds most rows, keys without a right row, ties, nulls: as plain loops."""
    import random

    rng = random.Random(2)
    key = lambda: rng.choice(["hot"] * 8 + ["b", None])
    left = [(i, key(), rng.choice([None, *range(60)])) for i in range(400)]
    right = [(key(), rng.choice([None, *range(60)]), rng.randrange(9)) for _ in range(60)]
    l, r = spark.createDataFrame(left, "id int, k string, t int").repartition(5), spark.createDataFrame(right, "k string, t int, v int")
    want = []
    for i, k, t in left:
        ok = [(u, v) for h, u, v in right if h == k and u is not None and t is not None and u <= t]
        want.append((i, k, t, max(ok)[1] if ok else None))
    assert rows(temporal.asof_join(l, r, ["k"], "t", ["v"])) == sorted(want, key=repr)
    assert temporal.asof_join(l.limit(0), r, ["k"], "t", ["v"]).count() == 0 and {x.v for x in temporal.asof_join(l, r.limit(0), ["k"], "t", ["v"]).collect()} == {None}


def test_bars_of_a_path_are_not_broadcast(spark):
    """Bars that overlap, gaps, frames before nought and a null; long bars make a list
    that its plan takes for a small one."""
    bars = [(1, 0, -70, 80), (1, 1, 5, 200), (1, 2, 300, 1), (2, 0, 0, 64), (2, 1, 64, 1000)]
    path = [(k, t, pos) for k in (1, 2, 3) for t, pos in enumerate([None, *range(-80, 320, 7), 63, 64, 128, 204, 205, 300, 301, 1063, 1064])]
    got = scoretime.bar_of_path(spark.createDataFrame(path, "k int, t int, pos long"), spark.createDataFrame(bars, "k int, bar int, first_frame long, frames long"), ["k"])
    want = [(k, t, pos, b) for k, t, pos in path for b in [bar for j, bar, a, n in bars if j == k and pos is not None and a <= pos < a + n] or [None]]
    by = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted((tuple(r) for r in got.collect()), key=by) == sorted(want, key=by)
    assert "Broadcast" not in got._jdf.queryExecution().toString()


def test_folds_are_fitted_together(spark, monkeypatch):
    """The models of ``evaluate`` for each fold, in as many passes as one of them takes."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 3)) * [1, 50, 0.01] + [0, 1000, 0]
    y = (x[:, 0] + rng.normal(size=400) * 0.7 > 0).astype(int) + 2 * (x[:, 1] + rng.normal(size=400) * 20 > 1030)
    df = spark.createDataFrame([(f"k{i}", int(v), *map(float, r)) for i, (v, r) in enumerate(zip(y, x))], "k string, label int, a double, b double, c double")
    passes, summed = [], grading.summed
    monkeypatch.setattr(grading, "summed", lambda *a: passes.append(1) or summed(*a))
    got = grading.cross_validate(df, ["a", "b", "c"], "k", k=3).first()
    dealt = grading.folds(df, "label", "k", 3, 42).cache()
    want = [grading.evaluate(dealt.where(F.col("fold") != i), dealt.where(F.col("fold") == i), ["a", "b", "c"]).first() for i in range(3)]
    assert (got.folds, got.n) == (3, sum(r.n for r in want)) and len(passes) < 60
    assert abs(got.exact - np.mean([r.exact for r in want])) < 0.004 and abs(got.within_one - np.mean([r.within_one for r in want])) < 0.004
    assert abs(got.exact_std - np.std([r.exact for r in want])) < 0.004
