"""Queries that SQL can't say: their rows against plain recomputation, not only counts."""

import os
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest

from scoreloom.operators import grading
from scoreloom.operators import listening as L
from scoreloom.plans import catalogue, scores, stats
from scoreloom.plans.ship import ship
from tests.compare import DATA, connect

BASE = f"{DATA}/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(BASE), reason="no test tables")


def got(spark, name):
    ship(spark)
    return catalogue.QUERIES[name](spark, BASE).toPandas()


@pytest.fixture(scope="module")
def events():
    return connect(BASE).execute("select event_id, user_id, event_type, value, dayofmonth(ts) as take from events order by event_id").df()


def loop_gate(energy):
    floor, out = None, []
    for e in energy:
        floor = e if floor is None else min(floor * L.NOISE_RISE, e)
        out.append(e < max(L.NOISE_LEAST, floor) * L.NOISE_GATE)
    return out, floor


def test_noise_floor(spark, events):
    want = {}
    for take, part in events.groupby("take"):
        silent, floor = loop_gate(part["value"] / 100)
        want[take] = (len(part), sum(silent), round(floor, 6))
    assert {r.take: (r.frames, r.silent, r.floor) for r in got(spark, "noise_floor").itertuples()} == want


def test_stream_gate(spark, events):
    """The floor kept as state gives what one fold over the take gives."""
    want = {take: (len(part), sum(loop_gate(part["value"] / 100)[0])) for take, part in events.groupby("take")}
    assert {r.take: (r.frames, r.silent) for r in got(spark, "stream_gate").itertuples()} == want


def test_stream_follow(spark, events):
    ref = L.build_reference([(960.0 * k, 960.0 * (k + 1), 45 + (k * 7) % 24) for k in range(16)], [(3840.0 * b, 3840.0) for b in range(4)])
    want = {}
    for user, part in events.groupby("user_id"):
        f, furthest, locked = L.Follower(ref), -1, 0
        for i, kind in zip(part["event_id"], part["event_type"]):
            f.step(L.normalize([1.0 if (i * 7 + s * 5) % 11 < 3 else 0.0 for s in range(L.DIM)])[0], kind == "error")
            furthest = max(furthest, int(f.display))
            locked += f.confidence > 0.5
        want[user] = (len(part), furthest, locked)
    rows = {r.take: (r.frames, r.furthest, r.locked) for r in got(spark, "stream_follow").itertuples()}
    assert set(rows) == set(want)
    assert np.mean([rows[k] == want[k] for k in want]) == 1.0


def test_viterbi_align(spark, events):
    """Every take decoded on its own and summarised by plain loops."""
    e = connect(BASE).execute("select vec_id, embedding from embeddings").df().set_index("vec_id").embedding
    ref, lo, n = scores._reference(), e.index.min(), len(e)
    want = {}
    for take, part in events.groupby("take"):
        live = np.stack([np.abs(np.asarray(e[lo + i % n][: L.DIM], float)) for i in part["event_id"]])
        silent = (part["event_type"] == "error").to_numpy()
        path, _ = L.viterbi(ref, L.normalize(live), silent)
        bars = [int(ref.bar[p]) if ref.bar[p] >= 0 else None for p in path]
        attempts, last, restarts, hold, stand = Counter(), {}, 0, defaultdict(int), 0
        for t, (p, b) in enumerate(zip(path, bars)):
            pb, pp = (bars[t - 1], path[t - 1]) if t else (None, None)
            if b is None:
                stand = 0
                continue
            if b != pb:
                attempts[b] += 1
                last[b] = 0
                restarts += pb is not None and pp - p >= 20
            last[b] += 1
            stand = stand + 1 if pp is not None and p == pp else 0
            if stand >= 8:
                hold[b] = max(hold[b], stand)
        want[take] = (len(attempts), max(attempts), sum(attempts.values()), restarts, len(hold), max(hold.values(), default=0), round(np.mean(list(last.values())), 6))
    rows = {r.take: (r.reached, r.furthest, r.attempts, r.restarts, r.held_bars, r.longest_hold, round(r.mean_last, 6)) for r in got(spark, "viterbi_align").itertuples()}
    assert rows == want


def test_note_features(spark, events):
    semis, strings = dict(zip("CDEFGAB", (0, 2, 4, 5, 7, 9, 11))), (40, 45, 50, 55, 59, 64)
    want = defaultdict(lambda: [0, 0, 0.0])
    for i, u in zip(events["event_id"], events["user_id"]):
        if i % 13 == 0:
            continue  # broken
        bars = 1 + (i % 3 > 0) + (i % 3 > 1)
        bar = [(4 + u * k % 3) * 12 + semis["CDEFGAB"[i * k % 7]] for k in range(1, 7)]
        frets = [min((m - s for s in strings if 0 <= m - s <= 24), default=None) for m in bar * bars]
        frets = [f for f in frets if f is not None]
        shifts = sum(abs(a - b) >= 4 for a, b in zip(frets, frets[1:]))
        w = want[(0, 1, 0.0)]
        w[0] += 1
        w[1] += shifts
        w[2] += 6.0 * bars
    rows = {(r.max_stack, r.voices, r.ratio): [r.n, r.shifts, r.quarters] for r in got(spark, "note_features").itertuples()}
    assert rows == dict(want)


def labelled(spark):
    ship(spark)
    d = stats._labelled(spark, BASE).toPandas()
    return d[stats.NUMERIC].to_numpy(float), d["label"].to_numpy(), d


def fit(x, y, steps=4000):
    """The same penalised likelihood by plain accelerated descent."""
    classes, index = np.unique(y, return_inverse=True)
    mean, std = x.mean(0), x.std(0)
    z = np.hstack([(x - mean) / np.where(std > 0, std, 1), np.ones((len(x), 1))])
    hot = np.eye(len(classes))[index]
    weight = len(y) / (len(classes) * hot.sum(0))[index]
    w, m, t = np.zeros((z.shape[1], len(classes))), np.zeros((z.shape[1], len(classes))), 1.0
    rate = 1 / (0.5 * np.linalg.norm(z * np.sqrt(weight)[:, None], 2) ** 2 + 1)
    for _ in range(steps):
        p = np.exp(z @ m - (z @ m).max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = z.T @ ((p - hot) * weight[:, None])
        g[:-1] += m[:-1]
        new, s = m - rate * g, (1 + np.sqrt(1 + 4 * t * t)) / 2
        m, w, t = new + (t - 1) / s * (new - w), new, s
    return lambda q: classes[(np.hstack([(q - mean) / np.where(std > 0, std, 1), np.ones((len(q), 1))]) @ w).argmax(1)]


def test_lr_train_score(spark):
    x, y, _ = labelled(spark)
    p = fit(x, y)(x)
    r = got(spark, "lr_train_score").iloc[0]
    assert r.n == len(y) and abs(r.exact - (p == y).mean()) <= 0.02 and abs(r.within_one - (abs(p - y) <= 1).mean()) <= 0.02


def test_lr_composer_out(spark):
    x, y, d = labelled(spark)
    n = d["composer"].value_counts()
    n = n[n >= 10]
    who = min(n[n == n.max()].index)
    held = (d["composer"] == who).to_numpy()
    p = fit(x[~held], y[~held])(x[held])
    r = got(spark, "lr_composer_out").iloc[0]
    assert r.n == held.sum() and abs(r.exact - (p == y[held]).mean()) <= 0.1 and abs(r.within_one - (abs(p - y[held]) <= 1).mean()) <= 0.1


def test_lr_cross_validated(spark):
    """Five folds over the classes of five rows or more; about as good as the plain fit
    on folds of its own."""
    x, y, _ = labelled(spark)
    n = Counter(y.tolist())
    ok = np.array([n[v] >= 5 for v in y])
    x, y = x[ok], y[ok]
    fold = np.random.default_rng(5).permutation(len(y)) % 5
    exact = [(fit(x[fold != k], y[fold != k], 1500)(x[fold == k]) == y[fold == k]).mean() for k in range(5)]
    r = got(spark, "lr_cross_validated").iloc[0]
    assert r.folds == 5 and r.n == len(y) and abs(r.exact - np.mean(exact)) <= 0.1 and r.exact <= r.within_one and 0 <= r.exact_std < 0.2


def test_stored_coefficients_score_as_the_model(spark):
    """A fitted model written down as plain numbers predicts what the library does."""
    from pyspark.ml.feature import VectorAssembler

    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 3))
    df = spark.createDataFrame(pd.DataFrame({**{f"f{i}": x[:, i] for i in range(3)}, "label": (x[:, 0] > 0).astype(int) + (x[:, 1] > 0.5)}))
    model, classes = grading.fit_logistic(df, ["f0", "f1", "f2"])
    a = grading.score_logistic(df, ["f0", "f1", "f2"], model.coefficientMatrix.toArray().tolist(), list(model.interceptVector), classes)
    b = model.transform(VectorAssembler(inputCols=["f0", "f1", "f2"], outputCol="_x").transform(df))
    assert [r.predicted for r in a.collect()] == [classes[int(r.prediction)] for r in b.collect()]


def test_departures_count_what_they_say(spark):
    """The worst cell's rows as DuckDB counts them, where the cell says how; and the
    loads and columns found are those of the departures."""
    d = got(spark, "p4_departures")
    con = connect(BASE)
    cells = {"null": "{c} is null", "NaN": "isnan({c}::double)", "zero": "{c} = 0", "negative": "{c} < 0", **{f"multiple of {m}": "{c} = floor({c}) and {c} % " + str(m) + " = 0 and not isnan({c}::double)" for m in (2, 5, 10, 25)}}
    checked = 0
    for r in d.itertuples():
        cond = cells.get(r.cell) or (f"{{c}} = {r.cell[6:]}" if r.cell.startswith("value ") else None)
        if cond:
            checked += 1
            assert con.execute(f"select count(*) from features where load_id = {r.load_id} and {cond.format(c=r.column_name)}").fetchone()[0] == r.x
    found = got(spark, "p4_found")
    assert checked and sorted(map(tuple, found.to_numpy().tolist())) == sorted(zip(d["load_id"], d["column_name"])) and (d["z"].abs() > 5.5).all()


def test_every_query_is_checked():
    """No query is left to a count: those without SQL have a test above."""
    here = {n for n in globals() if n.startswith("test_")}
    without = set(catalogue.QUERIES) - set(catalogue.SQL)
    named = {n[5:] for n in here} | {"p4_found", "p4_departures"}
    assert without <= named, sorted(without - named)

