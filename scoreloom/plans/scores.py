"""Queries over score files and takes made from the tables: every row of the table
becomes a file or a frame, so nothing is sampled."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions.exprs import first_code
from ..operators import listening as L
from ..operators import notes as N
from ..operators import temporal as T
from ..sources import scores as S
from ..sources.schemas import validate
from ..sources.stores import extract_links
from ..sources.tables import table
from .cut import cut, spread

STEPS = "CDEFGAB"


def _files(spark, base):
    """A small score for each event: its pitches and length follow from the event."""
    e = table(spark, base, "events", ["event_id", "user_id", "event_type", "value"])
    step = lambda k: F.substring(F.lit(STEPS), (F.col("event_id") * k % 7 + 1).cast("int"), F.lit(1))
    note = lambda k: F.concat(F.lit("<note><pitch><step>"), step(k), F.lit("</step><octave>"), (3 + F.col("user_id") * k % 3).cast("string"), F.lit("</octave></pitch><duration>1</duration><voice>1</voice><type>eighth</type></note>"))
    bar = F.concat(F.lit("<measure>"), *[note(k) for k in range(1, 7)], F.lit("</measure>"))
    head = F.concat(F.lit('<?xml version="1.0"?><score-partwise><work><work-title>'), F.col("event_type"), F.lit('</work-title></work><identification><creator type="composer">U'), F.col("user_id").cast("string"), F.lit('</creator></identification><part-list><score-part id="P1"><part-name>'), F.when(F.col("event_id") % 11 == 0, "Flute").otherwise("Guitar"), F.lit("</part-name></score-part></part-list><part id=\"P1\">"))
    attrs = F.concat(F.lit("<measure><attributes><divisions>1</divisions><key><fifths>"), (F.col("event_id") % 5 - 2).cast("string"), F.lit("</fifths></key><time><beats>3</beats><beat-type>4</beat-type></time><clef><sign>G</sign></clef></attributes><sound tempo=\"90\"/></measure>"))
    text = F.concat(head, attrs, bar, F.when(F.col("event_id") % 3 > 0, bar).otherwise(""), F.when(F.col("event_id") % 3 > 1, bar).otherwise(""), F.when(F.col("event_id") % 13 == 0, F.lit("<broken>")).otherwise(F.lit("</part></score-partwise>")))
    return spread(e).select(F.col("event_id").cast("string").alias("id"), text.cast("binary").alias("content"), F.lit("musicxml").alias("format"))


def xml_features(spark, base):
    f = S.read_scores(_files(spark, base)).where("error is null")
    return f.select(F.col("id").cast("long").alias("event_id"), "midi_min", "midi_max", "measure_count", "note_count", "notes_per_measure", "key_fifths", "time_sig", "duration_sec_approx")


def xml_gates(spark, base):
    """The gates of validation over parsed measures: the first failing one names the row."""
    m = S.read_scores(_files(spark, base), "measures")
    guitar = reduce(lambda a, b: a | b, [F.lower(F.array_join("tokens", " ")).contains(w) for w in S.GUITAR_WORDS]) | F.exists("tokens", lambda t: t.startswith("midi-program-"))
    code = F.coalesce("error", first_code(
        (F.col("parts") == 0, "NO_PARTS"), (F.col("parts") > 1, "MULTIPLE_PARTS"), (~guitar, "NON_GUITAR_INSTRUMENT"),
        ((F.size("clefs") > 0) & ~F.arrays_overlap("clefs", F.array(F.lit("G"), F.lit("F"), F.lit("C"))), "TAB_ONLY"),
        ((F.col("staves") > 1) & (F.col("tab_staves") == 0), "MULTI_STAFF_PITCHED"), (F.col("pitched") < 16, "FRAGMENT"), (F.col("lowest") < 38, "OUT_OF_GUITAR_RANGE_LOW"),
        (F.col("title") == "", "MISSING_TITLE"), (F.col("composer") == "", "MISSING_COMPOSER"),
    ), F.lit("ACCEPTED"))
    return m.select(F.col("id").cast("long").alias("event_id"), code.alias("code"))


def accidentals(spark, base):
    """Notes outside the key, from exploded notes and windows instead of the tree."""
    n = N.read_notes(_files(spark, base))
    return N.accidentals(n).select(F.col("doc").cast("long").alias("event_id"), "outside")


def note_features(spark, base):
    """Polyphony, position shifts and length from exploded notes."""
    n = cut(N.read_notes(_files(spark, base)))
    return N.polyphony(n).join(N.position_shifts(n), "doc").join(N.quarters(n), "doc").groupBy("max_stack", "voices", "ratio").agg(F.count("*").alias("n"), F.sum("shifts").alias("shifts"), F.round(F.sum("quarters"), 3).alias("quarters"))


PROPS = {"type": "object", "required": ["k"], "additionalProperties": False, "properties": {"k": {"type": "integer"}}}


def schema_errors(spark, base):
    """The events' JSON against a schema."""
    e = table(spark, base, "events", ["event_id", "props"])
    made = F.when(F.col("event_id") % 10 == 0, F.lit('{"k": "x", "z": 1}')).when(F.col("event_id") % 10 == 1, F.lit("{}")).otherwise(F.col("props"))
    v = validate(spread(e).select(F.col("event_id").cast("string").alias("id"), made.alias("json")), PROPS)
    return v.groupBy(F.size("errors").alias("n_errors")).agg(F.count("*").alias("n"))


def lilypond_split(spark, base):
    """Files with one or two scores, comments and strings that hold braces among them."""
    e = table(spark, base, "events", ["event_id", "event_type"])
    text = F.concat(F.lit('\\header { title = "'), F.col("event_type"), F.lit(' } {" composer = "x" }\n% \\score { not this }\n\\score { { c d e } }\n'), F.when(F.col("event_id") % 2 == 0, F.lit("%{ } %}\\score { { f } }")).otherwise(F.lit("")))
    s = S.split_lilypond(e.select(F.col("event_id").cast("string").alias("id"), text.alias("text")))
    return s.groupBy("title", "movement").agg(F.count("*").alias("n"))


def page_links(spark, base):
    """Links to scores out of pages."""
    e = table(spark, base, "events", ["event_id", "event_type"])
    html = F.concat(F.lit("<p>Grade "), (F.col("event_id") % 12).cast("string"), F.lit('</p><a href="/s/'), F.col("event_id").cast("string"), F.lit('.mxl">'), F.col("event_type"), F.lit("</a><a href='x.html'>no</a>"))
    links = extract_links(e.select(F.lit("http://scores.example/list").alias("url"), html.alias("html")), (".mxl", ".musicxml"))
    return links.select("href", "text", F.regexp_extract("context", r"Grade (\d+)", 1).cast("int").alias("grade"))


def _reference():
    """Sixteen bars of four quarters at 120."""
    notes = [(960.0 * k, 960.0 * (k + 1), 45 + (k * 7) % 24) for k in range(64)]
    return L.build_reference(notes, [(3840.0 * b, 3840.0) for b in range(16)])


def _takes(spark, base):
    """A take per day: frames are the events in time, chroma from the vectors."""
    e = table(spark, base, "events", ["event_id", "ts", "value", "event_type"]).withColumn("take", F.dayofmonth("ts").cast("long"))
    v = table(spark, base, "embeddings", ["vec_id", "embedding"])
    n = v.agg(F.struct(F.count("*").alias("n"), F.min("vec_id").alias("lo")).alias("s")).scalar()
    j = e.withColumn("n", n).withColumn("vec_id", F.col("n.lo") + F.col("event_id") % F.col("n.n")).join(v, "vec_id")
    vec = F.transform(F.slice("embedding", 1, L.DIM), lambda x: F.abs(x).cast("double"))
    return j.select("take", F.col("event_id").alias("t"), vec.alias("vec"), (F.col("event_type") == "error").alias("silent"))


def viterbi_align(spark, base):
    """Every take decoded against the reference and summarised."""
    return T.take_summary(T.analyze_takes(L.align_takes(_takes(spark, base), _reference())))


def noise_floor(spark, base):
    """Silence per take against an adaptive floor, as a fold over each take."""
    import pandas as pd

    e = table(spark, base, "events", ["event_id", "ts", "value"]).select(F.dayofmonth("ts").cast("long").alias("take"), F.col("event_id").alias("t"), (F.col("value") / 100).alias("energy"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        silent, floor = L.noise_gate(pdf.sort_values("t")["energy"].tolist())
        return pd.DataFrame({"take": [int(pdf["take"].iloc[0])], "frames": [len(pdf)], "silent": [sum(silent)], "floor": [round(floor, 6)]})

    return e.groupBy("take").applyInPandas(run, "take long, frames long, silent long, floor double")


QUERIES = {f.__name__: f for f in (xml_features, xml_gates, accidentals, note_features, schema_errors, lilypond_split, page_links, viterbi_align, noise_floor)}

_M = """m as (select event_id, user_id, event_id % 13 = 0 as broken, event_id % 11 = 0 as flute, 1 + (event_id % 3 > 0)::int + (event_id % 3 > 1)::int as bars, event_id % 5 - 2 as fifths from events),
n as (select event_id, k, ([0, 2, 4, 5, 7, 9, 11])[event_id * k % 7 + 1] + (4 + user_id * k % 3) * 12 as midi from events, (select unnest([1, 2, 3, 4, 5, 6]) as k)), r as (select event_id, min(midi) as lo, max(midi) as hi from n group by 1)"""
SQL = {
    "xml_features": f"with {_M} select event_id, lo as midi_min, hi as midi_max, bars + 1 as measure_count, bars * 6 as note_count, round(bars * 6.0 / (bars + 1), 1) as notes_per_measure, fifths::varchar as key_fifths, '3/4' as time_sig, round(3.0 * (bars + 1) / 90 * 60, 1) as duration_sec_approx from m join r using (event_id) where not broken",
    "xml_gates": f"with {_M} select event_id, case when broken then 'XML_MALFORMED' when flute then 'NON_GUITAR_INSTRUMENT' when bars * 6 < 16 then 'FRAGMENT' when lo < 38 then 'OUT_OF_GUITAR_RANGE_LOW' else 'ACCEPTED' end as code from m join r using (event_id)",
    "accidentals": f"with {_M}, o as (select m.event_id, bars * count(*) filter (case when fifths > 0 then instr(substr('FCGDAEB', 1, fifths), st) > 0 when fifths < 0 then instr(substr('BEADGCF', 1, -fifths), st) > 0 else false end) as outside from m join (select event_id, substr('CDEFGAB', (event_id * k % 7 + 1)::int, 1) as st from events, (select unnest([1, 2, 3, 4, 5, 6]) as k)) using (event_id) where not broken group by m.event_id, bars) select event_id, outside from o",
    "schema_errors": "select case event_id % 10 when 0 then 2 when 1 then 1 else 0 end as n_errors, count(*) as n from events group by 1",
    "lilypond_split": "select event_type || ' } {' as title, k as movement, count(*) as n from events, (select unnest([1, 2]) as k) where k = 1 or event_id % 2 = 0 group by 1, 2",
    "page_links": "select 'http://scores.example/s/' || event_id || '.mxl' as href, event_type as text, (event_id % 12)::int as grade from events",
}
