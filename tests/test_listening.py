import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from scoreloom.operators import listening as L
from scoreloom.streaming import follow as S


def varied(bars=16):
    notes = [(960.0 * k, 960.0 * (k + 1), 40 + (k * 7 + k // 4 * 5) % 30) for k in range(4 * bars)]
    return L.build_reference(notes, [(3840.0 * b, 3840.0) for b in range(bars)])


def test_reference_has_a_frame_every_fiftieth_of_a_second():
    ref = varied()
    assert len(ref.frames) == 640 and ref.bar_frames == 40
    assert ref.bar[0] == 0 and ref.bar[39] == 0 and ref.bar[40] == 1 and ref.bar[-1] == 15
    n = np.linalg.norm(ref.frames, axis=1)
    assert np.allclose(n[n > 0], 1)


def test_tempo_table():
    t = L.tempo_table([(960, 120), (1920, 60), (1920, 240), (-5, 9), (3, 0)], 960, 60)
    assert np.allclose(t[:, :2], [[0, 0], [960, 1000], [1920, 1500]])
    ticks = np.array([-10, 0, 500, 960, 1500, 5000.0])
    assert np.allclose(L.ms_to_ticks(t, L.ticks_to_ms(t, ticks)), np.maximum(ticks, 0))


@pytest.mark.parametrize("events", [[], [("hesitate", 100, 40)], [("tempo", 0, 0.7)], [("restart", 200, 120)], [("silence", 150, 30)]])
def test_offline_alignment_is_within_a_bar(events):
    ref = varied()
    live, silent, truth = L.perform(ref, events, noise=0.02)
    path, cost = L.viterbi(ref, live, silent)
    off = np.abs(ref.bar[path].astype(int) - ref.bar[truth].astype(int))[~silent]
    assert np.quantile(off, 0.95) <= 1 and np.isnan(cost[silent]).all()


def brute(ref, live, silent):
    """The same model by plain loops."""
    n, w = len(ref.frames), np.log(np.array(L.STEPS) / sum(L.STEPS))
    d = [p + e for p, e in zip(L.log_prior(n, ref.rate), L.emissions(ref.frames, live[0], silent[0], L.SIGMA))]
    back = []
    for t in range(1, len(live)):
        e, top = L.emissions(ref.frames, live[t], silent[t], L.SIGMA), int(np.argmax(d))
        row, frm = [], []
        for j in range(n):
            best, k = max(((d[j - s] + w[s], -s) for s in range(4) if j >= s), key=lambda x: x)
            best += np.log1p(-L.JUMP)
            leap = np.log(L.JUMP) - np.log(n) + d[top]
            row.append(max(best, leap) + e[j])
            frm.append(top if leap > best else j + k)
        d, back = row, back + [frm]
    path = [int(np.argmax(d))]
    for frm in reversed(back):
        path.append(frm[path[-1]])
    return path[::-1]


def path_score(ref, live, silent, path):
    """Log-probability of a path; a move is taken as the better of a step and a jump."""
    w = np.log(np.array(L.STEPS) / sum(L.STEPS)) + np.log1p(-L.JUMP)
    total = L.log_prior(len(ref.frames), ref.rate)[path[0]]
    for t, p in enumerate(path):
        total += L.emissions(ref.frames, live[t], silent[t], L.SIGMA)[p]
        if t:
            d = p - path[t - 1]
            total += max(w[d] if 0 <= d < 4 else -np.inf, np.log(L.JUMP) - np.log(len(ref.frames)))
    return total


def test_viterbi_finds_as_good_a_path_as_plain_loops():
    ref = varied(2)
    live, silent, _ = L.perform(ref, [("restart", 50, 30), ("silence", 20, 3)], noise=0.1)
    a, b = L.viterbi(ref, live, silent)[0], brute(ref, live, silent)
    assert np.isclose(path_score(ref, live, silent, a), path_score(ref, live, silent, b))


def test_budget_and_empty():
    ref = varied(2)
    with pytest.raises(ValueError):
        L.viterbi(ref, ref.frames, np.zeros(80, bool), cells=100)
    r, live, _, halved = L.fit_budget(ref, ref.frames, np.zeros(80, bool), 2000)
    assert halved == 1 and len(r.frames) == 40 and len(live) == 40
    assert L.viterbi(ref, np.zeros((0, L.DIM)), np.zeros(0, bool))[0].size == 0


def test_follower_tracks_and_its_state_can_be_stored():
    ref = varied()
    live, silent, truth = L.perform(ref, [], noise=0.02)
    f = L.Follower(ref)
    whole = [f.step(v, s) for v, s in zip(live, silent)]
    assert np.mean(np.abs(np.array(whole) - truth) <= 40) > 0.95 and f.confidence > 0.5
    state, parts = None, []
    for at in range(0, len(live), 100):
        g = L.Follower(ref, state)
        parts += [g.step(v, s) for v, s in zip(live[at : at + 100], silent[at : at + 100])]
        state = g.state
    assert parts == whole


def test_noise_gate_goes_on_from_its_floor():
    e = [0.01, 0.5, 0.012, float("nan"), 0.4, 0.011]
    whole, _ = L.noise_gate(e)
    a, floor = L.noise_gate(e[:3])
    assert whole == a + L.noise_gate(e[3:], floor)[0] and whole[:3] == [True, False, True]


def test_takes_align_in_groups(spark):
    ref = varied(4)
    live, silent, truth = L.perform(ref, [])
    rows = [(k, t, v.tolist() if t != 5 else None, False) for k in (1, 2) for t, v in enumerate(live)]
    df = spark.createDataFrame(rows, "take long, t long, vec array<double>, silent boolean")
    got = L.align_takes(df, ref).toPandas()
    assert len(got) == 2 * len(live) and got[got.t == 5].silent.all() and (np.abs(got[got["take"] == 1].sort_values("t").pos.to_numpy() - truth) <= 40).all()
    assert L.align_takes(df.limit(0), ref).count() == 0


def test_stream_follower_equals_the_batch(spark, tmp_path):
    ref = varied(2)
    live, silent, _ = L.perform(ref, [], noise=0.05)
    for i, at in enumerate((0, 30, 55)):
        part = live[at : (30, 55, len(live))[i]]
        spark.createDataFrame(pd.DataFrame({"take": [7] * len(part), "t": range(at, at + len(part)), "vec": [v.tolist() for v in part], "silent": False})).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    S.use_rocksdb(spark)
    src = spark.readStream.schema("take long, t long, vec array<double>, silent boolean").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = S.follow(src, ref).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").orderBy("t").toPandas()
    f = L.Follower(ref)
    want = [f.step(v, s) for v, s in zip(live, silent)]
    assert len(got) == len(live)
    assert got.position.tolist() == want or np.mean(np.abs(got.position - want) <= 20) > 0.9


def test_upsert_sink_is_idempotent(spark, tmp_path):
    write = S.upsert_latest(f"{tmp_path}/s", ["k"], ["t"])
    a = spark.createDataFrame([(1, 1, "a"), (2, 5, "b")], "k int, t int, v string")
    b = spark.createDataFrame([(1, 2, "c"), (2, 4, "old")], "k int, t int, v string")
    for i, batch in enumerate((a, b, b)):
        write(batch, i)
    from scoreloom.sources.stores import LatestStore

    assert sorted(tuple(r) for r in LatestStore(f"{tmp_path}/s", ["k"], ["t"]).read(spark).select("k", "v").collect()) == [(1, "c"), (2, "b")]


def test_windowed_counts_in_batch(spark):
    e = spark.createDataFrame([("2024-01-01 00:10:00", "a"), ("2024-01-01 00:50:00", "a"), ("2024-01-01 01:00:00", "b")], "ts string, event_type string").withColumn("ts", F.to_timestamp_ntz("ts"))
    assert sorted((str(r.start), r.event_type, r.n) for r in S.windowed_counts(e).collect()) == [("2024-01-01 00:00:00", "a", 2), ("2024-01-01 01:00:00", "b", 1)]
