"""Musical features of exploded notes, relationally.

``notes``: (doc, part, measure, pos, step, alter, octave, is_chord, is_rest, voice,
string, fret, fifths, divisions, duration), one row a note in document order; ``fifths``
and ``divisions`` stand on the row where they are set. Every window is partitioned by
document (and part or string), the unit the reading order holds in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import min_fret, note_midi

# ---------------------------------------------------------------- fixed values
SHARPS, FLATS = "FCGDAEB", "BEADGCF"
# ---------------------------------------------------------------- end of fixed values

NOTE_SCHEMA = "doc string, part int, measure int, pos int, step string, alter string, octave string, is_chord boolean, is_rest boolean, voice string, string string, fret int, fifths int, divisions int, duration int"


def read_notes(files: DataFrame) -> DataFrame:
    """Files (id, content, format) as exploded notes; unreadable ones have no rows."""
    import pandas as pd

    from ..sources import scores as S

    names = [c.split()[0] for c in NOTE_SCHEMA.split(", ")]

    def run(batches):
        for pdf in batches:
            rows = []
            for i, blob, fmt in zip(pdf["id"], pdf["content"], pdf["format"]):
                xml, _ = (None, None) if blob is None else S.open_score(bytes(blob), fmt)
                root = S.parse(xml)[0] if xml is not None else None
                if root is None:
                    continue
                pos = 0
                for part_no, part in enumerate(e for e in root.iter() if S.local(e) == "part"):
                    fifths = divisions = None  # set, but not yet put on a note
                    for measure_no, m in enumerate(c for c in part if S.local(c) == "measure"):
                        divisions = next((S.whole(e.text) for e in reversed(list(m.iter())) if S.local(e) == "divisions" and S.whole(e.text)), divisions)
                        for c in m:
                            if S.local(c) == "attributes":
                                f = S.descend(c, "key", "fifths")
                                fifths = S.whole(f.text) if f is not None else fifths
                            if S.local(c) != "note":
                                continue
                            p = S.child(c, "pitch")
                            tech = S.descend(c, "notations", "technical")
                            rows.append((
                                i, part_no, measure_no, pos, (S.text_of(p, "step") or "").strip().upper() or None, S.text_of(p, "alter"), S.text_of(p, "octave"), S.child(c, "chord") is not None, S.child(c, "rest") is not None,
                                (S.text_of(c, "voice") or "").strip() or None, S.text_of(tech, "string"), S.whole(S.text_of(tech, "fret")), fifths, divisions, S.whole(S.text_of(c, "duration")),
                            ))
                            fifths = divisions = None
                            pos += 1
            out = pd.DataFrame(rows, columns=names).astype(object)
            yield out.where(out.notna(), None)

    return files.select("id", "content", "format").mapInPandas(run, NOTE_SCHEMA)


def with_pitch(notes: DataFrame) -> DataFrame:
    return notes.withColumn("midi", note_midi("step", "octave", "alter")).withColumn("min_fret", min_fret("midi"))


def chord_stacks(notes: DataFrame) -> DataFrame:
    """Adds ``stack``: how many notes sound together up to this one of its chord; a
    chord ends with its measure."""
    w = Window.partitionBy("doc", "part", "measure").orderBy("pos")
    run = F.sum((~F.col("is_chord")).cast("int")).over(w)
    return notes.withColumn("_run", run).withColumn("stack", F.when(F.col("is_chord"), F.row_number().over(Window.partitionBy("doc", "part", "measure", "_run").orderBy("pos")) + F.when(F.col("_run") == 0, 1).otherwise(0)).otherwise(1)).drop("_run")


def polyphony(notes: DataFrame) -> DataFrame:
    """(doc, max_stack, voices, ratio, share): ``ratio`` counts a measure from the first
    chord of the document on, as the published numbers do; ``share`` counts measures
    that have a chord or several voices themselves."""
    per = chord_stacks(notes).groupBy("doc", "part", "measure").agg(F.max("stack").alias("stack"), F.countDistinct("voice").alias("voices"))
    w = Window.partitionBy("doc").orderBy("part", "measure")
    run = per.withColumn("seen", F.max("stack").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    several = F.col("voices") >= 2
    return run.groupBy("doc").agg(
        F.max(F.when(F.col("stack") >= 2, F.col("stack")).otherwise(0)).alias("max_stack"), F.max("voices").alias("voices"),
        F.round(F.avg(((F.col("seen") >= 2) | several).cast("double")), 3).alias("ratio"), F.round(F.avg(((F.col("stack") >= 2) | several).cast("double")), 3).alias("share"),
    )


def position_shifts(notes: DataFrame, least: int = 4) -> DataFrame:
    """(doc, shifts): jumps of the lowest reachable fret between melodic neighbours."""
    m = with_pitch(notes).where("min_fret is not null and not is_chord")
    d = F.abs(F.col("min_fret") - F.lag("min_fret").over(Window.partitionBy("doc").orderBy("pos")))
    return m.withColumn("d", d).groupBy("doc").agg(F.count_if(F.col("d") >= least).alias("shifts"))


def string_jumps(notes: DataFrame, above: int = 4) -> DataFrame:
    """(doc, jumps): fret distances above ``above`` on the same string; documents without
    fingering have no row."""
    f = notes.where("string is not null and fret is not null")
    d = F.abs(F.col("fret") - F.lag("fret").over(Window.partitionBy("doc", "string").orderBy("pos")))
    return f.withColumn("d", d).groupBy("doc").agg(F.count_if(F.col("d") > above).alias("jumps"))


def active_keys(notes: DataFrame) -> DataFrame:
    """Adds ``key``: the key signature in force at each note, 0 before the first."""
    w = Window.partitionBy("doc", "part").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return notes.withColumn("key", F.coalesce(F.last("fifths", ignorenulls=True).over(w), F.lit(0)))


def accidentals(notes: DataFrame) -> DataFrame:
    """(doc, outside): notes whose alteration differs from what the key gives their step."""
    n = active_keys(notes).where("step is not null")
    table = F.when(F.col("key") > 0, F.when(F.instr(F.lit(SHARPS), F.col("step")).between(1, F.least("key", F.lit(7))), 1).otherwise(0)).when(
        F.col("key") < 0, F.when(F.instr(F.lit(FLATS), F.col("step")).between(1, F.least(-F.col("key"), F.lit(7))), -1).otherwise(0)
    ).otherwise(0)
    written = F.coalesce(F.col("alter").try_cast("double").cast("int"), F.when(F.trim("alter") == "", 0), F.when(F.col("alter").isNull(), 0))
    return n.groupBy("doc").agg(F.count_if(written != table).alias("outside"))


def quarters(notes: DataFrame) -> DataFrame:
    """(doc, quarters): length of the first part by its first voice, with the divisions
    carried forward from measure to measure."""
    w = Window.partitionBy("doc").orderBy("measure").rowsBetween(Window.unboundedPreceding, 0)
    first = notes.where("part = 0")
    per = first.groupBy("doc", "measure").agg(F.max("divisions").alias("divisions"), F.sum(F.when(~F.col("is_chord") & (F.coalesce("voice", F.lit("1")) == "1"), F.col("duration"))).alias("ticks"))
    carried = per.withColumn("d", F.last("divisions", ignorenulls=True).over(w))
    return carried.groupBy("doc").agg(F.sum(F.try_divide("ticks", "d")).alias("quarters"))
