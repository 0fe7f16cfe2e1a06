"""Aligning recorded performances to a score: references, offline and online decoding.

A take is a group; a frame is a 24-number chroma vector. The decoders are dynamic
programmes over all reference frames, vectorised over states; the reference is small
(minutes at 20 frames a second) and goes to the tasks as a broadcast value.
"""

from __future__ import annotations

import random
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------- fixed values
DIM, REGISTER = 24, 64  # two registers of twelve pitch classes, the upper from MIDI 64
RATE = 20.0  # frames a second
PARTIALS = ((0, 1.0), (12, 1 / 2), (19, 1 / 3), (24, 1 / 4), (28, 1 / 5), (31, 1 / 6))
SIGMA, STEPS, JUMP = 0.12, (0.15, 0.6, 0.2, 0.05), 1e-5
HEAD_SECONDS, HEAD_MASS = 0.5, 0.9
CELLS = 120_000_000
HOLD_FRAMES = 10
NOISE_RISE, NOISE_LEAST, NOISE_GATE = 1.0008, 1e-4, 2.5
# ---------------------------------------------------------------- end of fixed values


def normalize(v: np.ndarray) -> np.ndarray:
    """Both registers of each row scaled to unit length, then the row; zeros stay."""
    v = np.atleast_2d(np.asarray(v, float)).copy()
    for part in (v[:, : DIM // 2], v[:, DIM // 2 :], v):
        n = np.linalg.norm(part, axis=1, keepdims=True)
        np.divide(part, n, out=part, where=n > 0)
    return v


def chroma(pitches: Sequence[int]) -> np.ndarray:
    """The chroma of sounding pitches with their first partials, not normalised."""
    v = np.zeros(DIM)
    for p in pitches:
        for offset, weight in PARTIALS:
            q = p + offset
            v[(DIM // 2 if q >= REGISTER else 0) + q % 12] += weight
    return v


@dataclass
class Reference:
    """frames: unit vectors; bar: the bar of each frame, -1 past the end."""

    frames: np.ndarray
    bar: np.ndarray
    rate: float = RATE

    @property
    def bar_frames(self) -> int:
        return int(len(self.frames) / max(len(set(self.bar[self.bar >= 0].tolist())), 1) + 0.5)


def tempo_table(changes: Sequence[tuple[float, float]], per_quarter: int, fallback: float = 120.0) -> np.ndarray:
    """Rows (tick, ms, ms per tick); invalid changes dropped, the last of equal ticks
    counts, before the first the fallback."""
    ok = {float(t): float(b) for t, b in sorted(((t, b) for t, b in changes if np.isfinite(t) and t >= 0 and np.isfinite(b) and b > 0), key=lambda x: x[0])}
    if not ok or min(ok) > 0:
        ok[0.0] = fallback
    rows, ms, before = [], 0.0, None
    for t in sorted(ok):
        rate = 60000.0 / (ok[t] * per_quarter)
        if before is not None:
            ms += (t - before[0]) * before[1]
        rows.append((t, ms, rate))
        before = (t, rate)
    return np.array(rows)


def ticks_to_ms(tempo: np.ndarray, ticks) -> np.ndarray:
    t = np.maximum(np.asarray(ticks, float), 0)
    k = np.searchsorted(tempo[:, 0], t, "right") - 1
    return tempo[k, 1] + (t - tempo[k, 0]) * tempo[k, 2]


def ms_to_ticks(tempo: np.ndarray, ms) -> np.ndarray:
    m = np.maximum(np.asarray(ms, float), 0)
    k = np.searchsorted(tempo[:, 1], m, "right") - 1
    return tempo[k, 0] + (m - tempo[k, 1]) / tempo[k, 2]


def build_reference(notes: Sequence[tuple[float, float, int]], bars: Sequence[tuple[float, float]], changes: Sequence[tuple[float, float]] = ((0, 120),), per_quarter: int = 960, rate: float = RATE) -> Reference:
    """The frames of a score from notes (start, end, midi) and bars (start, length) in
    ticks. A frame holds what sounds at its time; a note counts from its start until
    just before its end. Notes that don't last are dropped."""
    notes = sorted((n for n in notes if np.isfinite(n[0]) and np.isfinite(n[1]) and n[1] > n[0]), key=lambda n: n[0])
    tempo = tempo_table(changes, per_quarter)
    end = max([n[1] for n in notes] + [b + d for b, d in bars], default=0.0)
    count = int(np.ceil(ticks_to_ms(tempo, [end])[0] * rate / 1000 - 1e-9))
    ticks = ms_to_ticks(tempo, np.arange(count) * 1000 / rate)
    frames = np.zeros((count, DIM))
    for a, b, m in notes:
        frames[np.searchsorted(ticks, a - 1e-9) : np.searchsorted(ticks, b - 1e-9)] += chroma([m])
    starts = np.array([b for b, _ in bars])
    k = np.searchsorted(starts, ticks + 1e-9, "right") - 1 if len(bars) else np.full(count, -1)
    ends = np.array([b + d for b, d in bars]) if len(bars) else np.zeros(1)
    return Reference(normalize(frames) if count else frames, np.where((k >= 0) & (ticks < ends[np.maximum(k, 0)]), k, -1), rate)


def log_prior(n: int, rate: float) -> np.ndarray:
    head = min(n, max(1, int(rate * HEAD_SECONDS + 0.5)))
    with np.errstate(divide="ignore"):
        return np.log(np.where(np.arange(n) < head, HEAD_MASS / head, (1 - HEAD_MASS) / (n - head) if n > head else 0.0))


def emissions(ref: np.ndarray, live: np.ndarray, silent, sigma: float) -> np.ndarray:
    """Log-likelihood of every state for a live frame; a silent one says nothing."""
    return np.zeros(len(ref)) if silent else (ref @ live - 1.0) / sigma


def viterbi(ref: Reference, live: np.ndarray, silent: np.ndarray, sigma: float = SIGMA, steps: Sequence[float] = STEPS, jump: float = JUMP, cells: int = CELLS) -> tuple[np.ndarray, np.ndarray]:
    """The most likely path through the reference, and each frame's cosine distance
    (NaN where silent). Each step advances by the index of a step weight or jumps
    anywhere; of equal scores the smaller advance wins, and a jump only when better."""
    n, t = len(ref.frames), len(live)
    if not n or not t:
        return np.zeros(0, int), np.zeros(0)
    if n * t > cells:
        raise ValueError(f"{n} x {t} cells are more than {cells}; decimate first")
    w = np.asarray(steps, float)
    with np.errstate(divide="ignore"):
        ls = np.log(np.maximum(w, 0) / w.sum())
    stay, leap = np.log1p(-jump), np.log(jump) - np.log(n) if jump > 0 else -np.inf
    back, source = np.zeros((t, n), np.uint8), np.zeros(t, int)
    d = log_prior(n, ref.rate) + emissions(ref.frames, live[0], silent[0], sigma)
    moves = np.full((len(ls), n), -np.inf)
    for s in range(1, t):
        source[s] = int(np.argmax(d))
        for k, l in enumerate(ls):
            moves[k, k:] = d[: n - k] + l
        pick = np.argmax(moves, 0)
        best = moves[pick, np.arange(n)] + stay
        jumped = leap + d[source[s]] > best
        back[s] = np.where(jumped, 255, pick)
        d = np.where(jumped, leap + d[source[s]], best) + emissions(ref.frames, live[s], silent[s], sigma)
        d -= d.max()
    path = np.zeros(t, int)
    at = int(np.argmax(d))
    for s in range(t - 1, -1, -1):
        path[s] = at
        if s:
            at = source[s] if back[s, at] == 255 else max(0, at - int(back[s, at]))
    cost = 1.0 - np.einsum("ij,ij->i", ref.frames[path], live)
    return path, np.where(np.asarray(silent, bool), np.nan, cost)


class Follower:
    """Forward filtering for a live cursor. ``position`` is the likeliest frame,
    ``confidence`` the mass within a bar of it, ``display`` the smoothed cursor: a far
    jump must hold ``HOLD_FRAMES`` before it is followed. The state is the vector of
    log masses and a few scalars, so it can be stored between micro-batches."""

    def __init__(self, ref: Reference, state: tuple | None = None, sigma: float = SIGMA, steps: Sequence[float] = STEPS, jump: float = JUMP):
        self.ref, self.sigma, self.jump = ref, sigma, jump
        w = np.asarray(steps, float)
        self.step_weights = w / w.sum()
        self.alpha = log_prior(len(ref.frames), ref.rate)
        self.started, self.position, self.display, self.target, self.held, self.confidence = False, 0, 0, -1, 0, 0.0
        if state is not None:
            blob, self.started, self.position, self.display, self.target, self.held = state
            self.alpha = np.frombuffer(blob, float).copy()

    def reset(self) -> None:
        """Back to where a take begins."""
        self.__init__(self.ref, None, self.sigma, self.step_weights, self.jump)

    @property
    def state(self) -> tuple:
        return self.alpha.tobytes(), self.started, int(self.position), int(self.display), int(self.target), int(self.held)

    def step(self, live: np.ndarray, silent: bool) -> int:
        n = len(self.ref.frames)
        e = emissions(self.ref.frames, live, silent, self.sigma)
        if not self.started:
            a, self.started = self.alpha + e, True
        else:
            # masses instead of logarithms: the largest is 1, so nothing that matters is lost
            p = np.exp(self.alpha - self.alpha.max())
            moved = np.zeros(n)
            for k, w in enumerate(self.step_weights):
                moved[k:] += w * p[: n - k]
            with np.errstate(divide="ignore"):
                a = np.log((1 - self.jump) * moved + self.jump * p.sum() / n) + e
        self.position = int(np.argmax(a))
        self.alpha = a - a[self.position]
        p = np.exp(self.alpha)
        window = self.ref.bar_frames
        self.confidence = float(p[max(0, self.position - window) : self.position + window + 1].sum() / p.sum())
        near = max(window, 4)
        if abs(self.position - self.display) <= near:
            self.display, self.target, self.held = self.position, -1, 0
        else:
            if self.target >= 0 and abs(self.position - self.target) <= near:
                self.held += 1
            else:
                self.target, self.held = self.position, 1
            if self.held >= HOLD_FRAMES:
                self.display, self.target, self.held = self.position, -1, 0
            elif self.display < n - 1:
                self.display += 1
        return self.position


def noise_gate(energy: Sequence[float], floor: float = float("inf")) -> tuple[list[bool], float]:
    """Whether each frame is silent against a floor that follows the quietest energy
    and drifts up slowly; the floor goes on to the next batch. Energies that are not
    finite leave it as it is."""
    out = []
    for e in energy:
        if np.isfinite(e):
            floor = e if floor == float("inf") else min(floor * NOISE_RISE, e)
        threshold = max(NOISE_LEAST, 0.0 if floor == float("inf") else floor)
        out.append(bool(e < threshold * NOISE_GATE))
    return out, floor


def decimate(live: np.ndarray, silent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Half the rate: neighbours averaged (the last alone if it has none) and normalised,
    silent where both are."""
    if len(live) % 2:
        live, silent = np.vstack([live, live[-1:]]), np.append(silent, silent[-1])
    return normalize((live[0::2] + live[1::2]) / 2), np.asarray(silent[0::2], bool) & np.asarray(silent[1::2], bool)


def fit_budget(ref: Reference, live: np.ndarray, silent: np.ndarray, cells: int = CELLS) -> tuple[Reference, np.ndarray, np.ndarray, int]:
    """Both rates halved until the alignment fits the budget; how often is returned."""
    halved = 0
    while len(ref.frames) * len(live) > cells:
        frames, _ = decimate(ref.frames, np.zeros(len(ref.frames), bool))
        ref = Reference(frames, ref.bar[::2], ref.rate / 2)
        live, silent = decimate(live, silent)
        halved += 1
    return ref, live, silent, halved


def perform(ref: Reference, events: Sequence[tuple], noise: float = 0.0, seed: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A synthetic take: (frames, silent, true reference frames). Events by reference
    frame: ("hesitate", at, frames), ("tempo", from, factor), ("restart", at, back),
    ("silence", at, frames)."""
    rng = random.Random(seed)
    pos, truth, quiet, pace = 0.0, [], [], 1.0
    done: set = set()
    while int(pos) < len(ref.frames):
        here = int(pos)
        hit = next((i for i, e in enumerate(events) if i not in done and here >= e[1]), None)
        if hit is not None:
            done.add(hit)
            kind, _, amount = events[hit]
            if kind in ("hesitate", "silence"):
                truth += [here] * int(amount)
                quiet += [kind == "silence"] * int(amount)
            elif kind == "tempo":
                pace = float(amount)
            else:
                pos = max(0, here - int(amount))
            continue
        truth.append(here)
        quiet.append(False)
        pos += pace
    frames = ref.frames[truth] + noise * np.array([[rng.gauss(0, 1) for _ in range(DIM)] for _ in truth])
    return normalize(np.maximum(frames, 0)), np.array(quiet, bool), np.array(truth)


def align_takes(frames: DataFrame, ref: Reference, cells: int = CELLS) -> DataFrame:
    """(take, t, pos, bar, silent, cost) of frames (take, t, vec, silent): each take
    decoded on its own, one group a take. Takes too long for the budget are decimated,
    their ``t`` then counts the coarser frames. Null vectors count as silent."""
    shared = frames.sparkSession.sparkContext.broadcast(ref)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        missing = np.array([v is None for v in pdf["vec"]])
        live = normalize(np.array([np.zeros(DIM) if v is None else v for v in pdf["vec"]], float))
        silent = missing | pdf["silent"].fillna(False).to_numpy(bool)
        r, live, silent, halved = fit_budget(shared.value, live, silent, cells)
        path, cost = viterbi(r, live, silent, cells=cells)
        bar = r.bar[path]
        out = pd.DataFrame({"take": pdf["take"].iloc[0], "t": np.arange(len(path)) << halved, "pos": path, "bar": bar.astype(object), "silent": silent, "cost": cost})
        out.loc[bar < 0, "bar"] = None
        return out

    return frames.select("take", "t", "vec", "silent").groupBy("take").applyInPandas(run, "take long, t long, pos int, bar int, silent boolean, cost double").withColumn("cost", F.nanvl("cost", F.lit(None)))
