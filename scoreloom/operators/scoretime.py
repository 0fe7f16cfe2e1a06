"""Bars, ticks and notes of a score, and spectra as pitch classes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import normalize_bands

# ---------------------------------------------------------------- fixed values
TICKS_PER_QUARTER = 960  # where no bar tells
PITCH_LOW, PITCH_HIGH = 40, 96
UPPER_FROM = 64  # MIDI pitch from which the upper register holds
SILENCE_DB = -85.0
CONCERT_A, CONCERT_A_MIDI = 440.0, 69
STRETCH = 64  # frames that paths and bars meet by
# ---------------------------------------------------------------- end of fixed values


def ticks_per_quarter(bars: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by..., tpq): the resolution that a score's first bar (bar, duration, numerator,
    denominator) with positive numbers implies; 960 where none does."""
    ok = (F.col("duration") > 0) & (F.col("numerator") > 0) & (F.col("denominator") > 0)
    implied = F.col("duration") * F.col("denominator") / (F.col("numerator") * 4)
    first = F.min_by(F.when(ok, implied), F.when(ok, F.col("bar")))
    return bars.groupBy(*by).agg(F.coalesce(first.cast("double"), F.lit(float(TICKS_PER_QUARTER))).alias("tpq"))


def bar_spans(bars: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by..., starts, durations): the bars of each score (bar, start, duration) in
    order, as arrays; a score's bars are few."""
    rows = F.array_sort(F.collect_list(F.struct("bar", "start", "duration")))
    return bars.groupBy(*by).agg(rows.alias("_b")).select(*by, F.transform("_b", lambda b: b["start"]).alias("starts"), F.transform("_b", lambda b: b["duration"]).alias("durations"))


def loop_range(starts: Column, durations: Column, first: Column, last: Column) -> Column:
    """From where to where bars ``first``..``last`` (counted from 1) sound, in ticks; null
    if they are no range of the score."""
    valid = (first >= 1) & (last >= first) & (last <= F.size(starts))
    a, b = F.get(starts, first - 1), F.get(starts, last - 1) + F.get(durations, last - 1)
    return F.when(valid, F.struct(a.alias("start_tick"), b.alias("end_tick")))


def tick_at_frame(ticks: Column, frame: Column) -> Column:
    """The tick of a reference frame, frames outside counting as the nearest; 0 without
    frames."""
    inside = F.greatest(F.lit(0), F.least(frame, F.size(ticks) - 1))
    return F.when(F.size(ticks) == 0, F.lit(0).cast("double")).otherwise(F.get(ticks, inside.cast("int")).cast("double"))


def sounding_notes(beats: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by..., start_tick, end_tick, midi) of every sounding note of beats (start,
    duration, rest, notes: array of (midi, dead, ghost)), in all parts and voices. Rests,
    beats without length, muted and ghost notes don't sound; the ends of ties do."""
    sounding = beats.where(~F.coalesce("rest", F.lit(False)) & (F.col("duration") > 0))
    n = sounding.select(*by, F.col("start").alias("start_tick"), (F.col("start") + F.col("duration")).alias("end_tick"), F.explode("notes").alias("n"))
    return n.where(~F.coalesce("n.dead", F.lit(False)) & ~F.coalesce("n.ghost", F.lit(False))).select(*by, "start_tick", "end_tick", "n.midi")


def tempo_changes(scores: DataFrame, automations: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by..., tick, bpm, seq) for ``temporal.tempo_segments``: a score's first tempo
    (by..., tempo) at tick 0, then the tempo automations of its bars (bar, start, duration,
    ratio, bpm, kind) at their share of the bar."""
    head = scores.select(*by, F.lit(0.0).alias("tick"), F.col("tempo").cast("double").alias("bpm"), F.lit(-1).cast("long").alias("seq"))
    rest = automations.where("kind = 'tempo'").select(*by, (F.col("start") + F.col("ratio") * F.col("duration")).cast("double").alias("tick"), F.col("bpm").cast("double").alias("bpm"), F.col("bar").cast("long").alias("seq"))
    return head.unionByName(rest)


def frequency(midi: float) -> float:
    return CONCERT_A * 2 ** ((midi - CONCERT_A_MIDI) / 12)


def pitch_bins(spark: SparkSession, sample_rate: float, size: int) -> DataFrame:
    """(midi, slot, first, last): for each pitch the bins of a spectrum of ``size``
    samples that lie within half a semitone, ``last`` excluded, and at least the nearest
    one. slot: the pitch class in the lower or upper register. 57 rows."""
    hz, bins = sample_rate / size, size // 2
    hertz = lambda m: F.lit(CONCERT_A) * F.pow(F.lit(2.0), (m - CONCERT_A_MIDI) / 12)
    p = spark.range(PITCH_LOW, PITCH_HIGH + 1).select(F.col("id").cast("int").alias("midi"))
    lo = F.greatest(F.ceil(hertz(F.col("midi") - 0.5) / hz), F.lit(0))
    hi = F.least(F.ceil(hertz(F.col("midi") + 0.5) / hz), F.lit(bins))
    near = F.least(F.greatest(F.floor(hertz(F.col("midi")) / hz + 0.5), F.lit(0)), F.lit(bins - 1))
    slot = F.when(F.col("midi") >= UPPER_FROM, 12).otherwise(0) + F.col("midi") % 12
    return p.select("midi", slot.alias("slot"), F.when(hi > lo, lo).otherwise(near).cast("int").alias("first"), F.when(hi > lo, hi).otherwise(near + 1).cast("int").alias("last"))


def spectrum_chroma(spectra: DataFrame, frame: str, db: str, bins: DataFrame) -> DataFrame:
    """(frame, slot, weight): the amplitude of each pitch class in spectra of decibels, one
    array a frame. Levels up to -85 and those that are no finite number count nothing;
    slots without sound have no row. The pitches' bins are spread out and met by an
    equi-join; there are few, whatever the spectra."""
    level = spectra.select(frame, F.posexplode(db).alias("bin", "d")).where((F.col("d") > SILENCE_DB) & ~F.isnan("d") & (F.col("d") < float("inf")))
    of_bin = bins.select("slot", F.explode(F.sequence("first", F.col("last") - 1)).alias("bin"))
    return level.join(F.broadcast(of_bin), "bin").groupBy(frame, "slot").agg(F.sum(F.pow(F.lit(10.0), F.col("d").cast("double") / 20)).alias("weight"))


def sane_notes(notes: DataFrame) -> DataFrame:
    """Notes (start_tick, end_tick, midi) of finite numbers that last."""
    ok = [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < float("inf")) for c in ("start_tick", "end_tick", "midi")]
    return notes.where(ok[0] & ok[1] & ok[2] & (F.col("end_tick") > F.col("start_tick")))


def reference_length(notes: DataFrame, bars: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by..., ticks): where the last note or bar of each score ends."""
    ends = notes.select(*by, F.col("end_tick").cast("double").alias("_e")).unionByName(bars.select(*by, (F.col("start") + F.col("duration")).cast("double").alias("_e")))
    return ends.groupBy(*by).agg(F.max("_e").alias("ticks"))


def bar_frames(bars: DataFrame, by: Sequence[str], ms_per_tick: float, rate: float = 20.0) -> DataFrame:
    """(by..., bar, first_frame, frames): the reference frames, ``rate`` a second, that lie
    in each bar (bar, start, duration); bars too short to hold one have no row."""
    at = lambda tick: F.ceil(tick * ms_per_tick * rate / 1000)
    lo, hi = at(F.col("start")), at(F.col("start") + F.col("duration"))
    return bars.where("duration > 0").select(*by, "bar", lo.alias("first_frame"), (hi - lo).alias("frames")).where("frames > 0")


def bar_of_path(path: DataFrame, frames: DataFrame, by: Sequence[str]) -> DataFrame:
    """A path of reference frames (by..., t, pos) with the bar each lies in, null past the
    bars: an equi-join on stretches of ``STRETCH`` frames, of which each bar lists those it
    touches, and within one by the bar's ends. Bars that overlap give a row each. The list
    is longer than its plan tells, so it is sorted and never broadcast."""
    last = F.col("first_frame") + F.col("frames") - 1
    of = lambda frame: F.floor(frame / STRETCH)
    each = frames.where("frames > 0").select(*[F.col(c).alias(f"_{c}") for c in by], F.col("bar").alias("_bar"), F.col("first_frame").alias("_first"), last.alias("_last"), F.explode(F.sequence(of(F.col("first_frame")), of(last))).alias("_of"))
    same = of(F.col("pos")) == F.col("_of")
    for c in by:
        same = same & (F.col(c) == F.col(f"_{c}"))
    return path.join(each.hint("merge"), same & F.col("pos").between(F.col("_first"), F.col("_last")), "left").select(*path.columns, F.col("_bar").alias("bar"))


def halve(frames: DataFrame, by: Sequence[str]) -> DataFrame:
    """Frames (by..., t, vec, silent; t from 0 without gaps) at half the rate: neighbours
    averaged, the last alone if it has none, both registers and then the whole scaled to
    unit length; silent where both are."""
    pair = frames.groupBy(*by, F.floor(F.col("t") / 2).alias("t")).agg(F.min_by("vec", "t").alias("_a"), F.max_by("vec", "t").alias("_b"), F.min("silent").alias("silent"))
    mean = F.zip_with("_a", "_b", lambda x, y: (x.cast("double") + y.cast("double")) / 2)
    return pair.select(*by, "t", normalize_bands(mean, 12).alias("vec"), "silent")
