"""Column expressions shared by the operators. All stay inside whole-stage codegen."""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------- fixed values
# Fragments of a path that mark test data and the like.
PATH_NOISE = ("ear-training", "ear_training", "/omr", "omr_data", "musicclassification", "/dataset", "processed_pdf", "training-data", "test_files", "test-fixtures", "/samples/", "demo/data", "guitar-duo", "guitar_duo")
# Words that make a title suspicious.
TITLE_TOKENS = ("demo", "demo1", "test", "test1", "example", "sample", "asdf", "noname", "scratch", "placeholder", "lorem")
# Semitones of the steps above C.
SEMITONES = {"C": 0, "D": 2, "E": 4, "F": 5, "G": 7, "A": 9, "B": 11}
# Pitches of the open strings.
OPEN_STRINGS = (40, 45, 50, 55, 59, 64)
FRETS = 24
LICENCE_CODES = {"cc-zero": "CC0-1.0", "publicdomain": "PD-Marker"}
PLACEHOLDER = "dummy-"
# What may trail a composer's name, first one, then the other: a span of years, and the
# years of a date marked as such with all that follows.
DATE_TAILS = (r"(?:c\.?\s*)?\d{3,4}\s*[-–]\s*\d{3,4}\s*", r"(?i:fl|c|d)\.?\s*\d{3,4}.*")
# ---------------------------------------------------------------- end of fixed values


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_null(c) -> Column:
    """Empty text as null: how CSV cells say that a value is missing."""
    return F.when(col(c) != "", col(c))


def strip(c) -> Column:
    """Without white space (of any kind, Unicode's too) at both ends; ``trim`` takes spaces only."""
    return F.regexp_replace(F.regexp_replace(col(c), r"(?U)^\s+", ""), r"(?U)\s+$", "")


def to_float(c) -> Column:
    """A number typed as text; empty or malformed gives null."""
    return blank_null(c).try_cast("double")


def leading_int(c) -> Column:
    """The integer a text begins with ("7b" gives 7), null without one."""
    return F.regexp_extract(col(c), r"^\s*([+-]?\d+)", 1).try_cast("int")


def strict_int(c) -> Column:
    return col(c).try_cast("int")


def clamp_level(c, low: int = 1, high: int = 10) -> Column:
    """The value within [low, high], else null."""
    return F.when(col(c).between(low, high), col(c))


def resolve_grade(grade, model, grade_source=None, model_source=None) -> Column:
    """struct(kind, grade, source): the curator's grade if there is one, else the
    model's, else none. Empty text counts as missing."""
    g, m = blank_null(grade), blank_null(model)
    gs = F.coalesce(col(grade_source), F.lit("curator")) if grade_source else F.lit("curator")
    ms = F.coalesce(col(model_source), F.lit("model")) if model_source else F.lit("model")
    return F.struct(
        F.when(g.isNotNull(), "curator").when(m.isNotNull(), "model").otherwise("none").alias("kind"),
        F.coalesce(g, m).alias("grade"),
        F.when(g.isNotNull(), gs).when(m.isNotNull(), ms).alias("source"),
    )


def first_match(text, needles: Sequence[str]) -> Column:
    """The first of ``needles``, in their order, that the text contains; else null."""
    t = F.lower(col(text))
    return F.coalesce(*[F.when(t.contains(n.lower()), F.lit(n)) for n in needles])


def first_code(*gates: tuple[Column, str]) -> Column:
    """The code of the first gate that holds; null if none does. Conditions must not
    throw: all may be evaluated whatever the order."""
    return F.coalesce(*[F.when(c, F.lit(code)) for c, code in gates])


def flags(*tests: tuple[Column, str]) -> Column:
    """All codes whose test holds, as an array in order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(code)) for c, code in tests]))


def suspicious_title(title) -> Column:
    """The suspicious token of a title, 'digits-only' or 'too-short', else null."""
    t = strip(title)
    token = F.lower(F.regexp_extract(t, r"(?i)\b(" + "|".join(TITLE_TOKENS) + r")\b", 1))
    return F.when(t == "", F.lit(None)).when(token != "", token).when(t.rlike(r"^\d{1,2}\z"), "digits-only").when(F.length(t) <= 2, "too-short")


def looks_like_username(name) -> Column:
    return strip(name).rlike(r"^[a-z0-9][a-z0-9_\-]{1,15}\z")


def normalize_composer(raw) -> Column:
    """The first line without bracketed remarks and trailing dates, single spaces, no
    punctuation at the ends; null is the empty name."""
    first = F.regexp_replace(F.substring_index(F.translate(col(raw), "\r", "\n"), "\n", 1), r"\s*\([^)]*\)", "")
    bare = reduce(lambda s, tail: F.regexp_replace(s, rf"\s+{tail}$", ""), DATE_TAILS, first)
    return F.coalesce(F.btrim(F.regexp_replace(bare, r"\s+", " "), F.lit(" ,.;")), F.lit(""))


# Letters with marks below U+0250, and the plain letters they decompose to.
_BASE = {chr(c): unicodedata.normalize("NFD", chr(c))[0] for c in range(0xC0, 0x250) if len(unicodedata.normalize("NFD", chr(c))) > 1}
_BASE |= {chr(c): unicodedata.normalize("NFD", chr(c))[0] for c in range(0x1E00, 0x1F00) if len(unicodedata.normalize("NFD", chr(c))) > 1}


def fold_text(c) -> Column:
    """Lower case without diacritics, set apart or not; letters that are no form of
    another stay. Column expressions only."""
    return F.lower(F.translate(F.regexp_replace(col(c), r"\p{Mn}+", ""), "".join(_BASE), "".join(_BASE.values())))


def licence_code(raw, known: Mapping[str, str] = LICENCE_CODES) -> Column:
    """The code of a licence's short name: that of a known one, else the name in capitals,
    'unknown' where there is none."""
    t = F.coalesce(col(raw), F.lit(""))
    return F.coalesce(*[F.when(t == k, F.lit(v)) for k, v in known.items()], F.nullif(F.upper(t), F.lit("")), F.lit("unknown"))


def is_placeholder(source) -> Column:
    """Whether a grade's source is a stand-in."""
    return F.coalesce(col(source).startswith(PLACEHOLDER), F.lit(False))


def minutes_to_seconds(typed) -> Column:
    """Seconds of minutes typed as text: what the text begins with, if that is a positive
    finite number."""
    n = F.regexp_extract(F.trim(col(typed)), r"^([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1).try_cast("double")
    return F.when((n > 0) & (n < float("inf")), n * 60)


def clock(ms) -> Column:
    """Milliseconds as m:ss, cut off; null stays null."""
    s = F.floor(col(ms) / 1000)
    return F.when(s.isNotNull(), F.format_string("%d:%02d", F.floor(s / 60).cast("long"), (s % 60).cast("long")))


def tracking_label(confidence) -> Column:
    c = col(confidence)
    return F.when(c > 0.5, "locked").when(c > 0.15, "searching").otherwise("lost")


def slug(c, default: str = "backup") -> Column:
    """Lower case, everything else than letters and digits one hyphen, none outside."""
    s = F.regexp_replace(F.lower(col(c)), "[^a-z0-9]+", "-")
    s = F.regexp_replace(F.regexp_replace(s, "^-", ""), "-$", "")
    return F.when(s == "", F.lit(default)).otherwise(s)


def safe_filename(cid) -> Column:
    return F.translate(col(cid), "/:@", "___")


def shorten(c, n: int) -> Column:
    """White space collapsed, and an ellipsis where longer than ``n``."""
    s = strip(F.regexp_replace(col(c), r"\s+", " "))
    return F.when(F.length(s) > n, F.concat(F.substring(s, 1, n - 1), F.lit("…"))).otherwise(s)


def earliest_needle(text, needles: Sequence[str], width: int = 80) -> Column:
    """``width`` letters from where the earliest of ``needles`` stands; null if none does."""
    low = F.lower(col(text))
    at = F.array_min(F.array_compact(F.array(*[F.when(F.locate(n.lower(), low) > 0, F.locate(n.lower(), low)) for n in needles])))
    return F.when(at.isNotNull(), col(text).substr(at, F.lit(width)))


def detect_number(text, patterns: Sequence[str], low: int = 1, high: int = 10) -> Column:
    """The first number that a pattern captures and that lies within the bounds; a
    match out of bounds lets the next pattern try."""
    tries = []
    for p in patterns:
        v = F.regexp_extract(col(text), p, 1).try_cast("int")
        tries.append(F.when(v.between(low, high), v))
    return F.coalesce(*tries)


def format_duration(seconds) -> Column:
    """m:ss, rounded half up; a dash where there is none."""
    s = F.floor(col(seconds) + 0.5)
    ok = col(seconds).isNotNull() & (col(seconds) > 0) & (col(seconds) < float("inf"))
    return F.when(ok, F.format_string("%d:%02d", F.floor(s / 60).cast("long"), (s % 60).cast("long"))).otherwise("—")


def round_half_up(c, places: int) -> Column:
    """Rounding as floor(x f + 1/2) / f, NaN as null."""
    f = 10**places
    return F.floor(F.nanvl(col(c), F.lit(None)) * f + 0.5) / f


def pick_sorted(values: Column, index: Column) -> Column:
    """The element of the sorted array at a place counted from nought."""
    return F.get(F.array_sort(values), index)


def quarter_low(values: Column) -> Column:
    return pick_sorted(values, F.floor(F.size(values) / 4).cast("int"))


def quarter_high(values: Column) -> Column:
    return pick_sorted(values, F.floor(F.size(values) * 3 / 4).cast("int"))


def upper_median(values: Column) -> Column:
    return pick_sorted(values, F.floor(F.size(values) / 2).cast("int"))


def p90_nearest(values: Column) -> Column:
    """Nearest rank with ties to even, as round(0.9 (n - 1))."""
    return pick_sorted(values, F.bround(F.lit(0.9) * (F.size(values) - 1)).cast("int"))


def quantile_exclusive(values: Column, q: float) -> Column:
    """Interpolated at place q (n + 1), within the data."""
    n = F.size(values)
    pos = F.lit(q) * (n + 1)
    j = F.greatest(F.lit(1), F.least(F.floor(pos).cast("int"), n - 1))
    s = F.array_sort(values)
    lo, hi = F.get(s, j - 1), F.get(s, j)
    return F.when(n >= 2, lo + (hi - lo) * (pos - j))


def note_midi(step, octave, alter) -> Column:
    """MIDI pitch of a written note; null where step or octave is unreadable, and an
    unreadable alter counts as none."""
    semi = reduce(lambda acc, kv: acc.when(F.upper(col(step)) == kv[0], kv[1]), SEMITONES.items(), F.when(F.lit(False), 0))
    return (col(octave).try_cast("int") + 1) * 12 + semi + F.coalesce(col(alter).try_cast("double").cast("int"), F.lit(0))


def min_fret(midi) -> Column:
    """The lowest fret of any string that can sound the pitch, null if none can."""
    return F.array_min(F.filter(F.array(*[col(midi) - s for s in OPEN_STRINGS]), lambda f: (f >= 0) & (f <= FRETS)))


def band(value, bands: Sequence[tuple[float, float, str]]) -> Column:
    """The label of the half-open range a value falls in, the last one beyond all."""
    return reduce(lambda acc, b: acc.when((col(value) >= b[0]) & (col(value) < b[1]), b[2]), bands, F.when(col(value).isNull(), None)).otherwise(bands[-1][2])


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalize(a) -> Column:
    """Scaled to unit length; a zero vector stays zero."""
    n = norm(a)
    return F.when(n > 0, F.transform(col(a), lambda x: x.cast("double") / n)).otherwise(F.transform(col(a), lambda x: x.cast("double")))


def normalize_bands(a, cut: int) -> Column:
    """Both parts of a vector scaled to unit length, then the whole."""
    v = col(a)
    return l2_normalize(F.concat(l2_normalize(F.slice(v, 1, cut)), l2_normalize(F.slice(v, cut + 1, 100_000))))


def cosine_distance(a, b) -> Column:
    """1 - cosine; 1 where a vector is zero."""
    return F.lit(1.0) - F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))
