"""Checks and orders of a finished manifest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import placed_values, running_total, value_at

# ---------------------------------------------------------------- fixed values
CENTRAL_GRADES, LEAST_CENTRAL = (3, 4, 5, 6), 20
HINTS = ((2, "very early"), (4, "beginner"), (6, "intermediate"), (8, "advanced"), (10_000, "concert"))
STATUS_LABELS = {"not_seen": "", "playing": "playing", "completed": "completed", "too_hard": "too hard", "not_for_me": "skipped"}
# ---------------------------------------------------------------- end of fixed values


def consensus_summary(judged: DataFrame) -> DataFrame:
    """One row over judged probes (delta): how many there are, how many have a grade, how
    many of those lie within one and within two, and the mean distance; null without any."""
    d = F.abs("delta")
    scored = F.count("delta")
    return judged.agg(F.count("*").alias("probes"), scored.alias("scored"), (F.count("*") - scored).alias("unscored"), F.count_if(d <= 1).alias("within_one"), F.count_if(d <= 2).alias("within_two"), F.round(F.avg(d), 6).alias("mean_abs_delta"))


def feed_counts(pieces: DataFrame, top: int = 10) -> DataFrame:
    """(kind, value, n): pieces per grade, per era, and of the ``top`` composers; pieces
    without grade or era under '(missing)', without a composer under '?'. One pass."""
    g, e, c = (F.col(x).cast("string") for x in ("grade", "era", "composer"))
    cells = F.array(F.struct(F.lit("grade").alias("kind"), F.coalesce(g, F.lit("(missing)")).alias("value")), F.struct(F.lit("era").alias("kind"), F.coalesce(e, F.lit("(missing)")).alias("value")), F.struct(F.lit("composer").alias("kind"), F.coalesce(c, F.lit("?")).alias("value")))
    n = pieces.select(F.explode(cells).alias("x")).groupBy("x.kind", "x.value").agg(F.count("*").alias("n"))
    best = n.where("kind = 'composer'").orderBy(F.desc("n"), "value").limit(top)
    return n.where("kind <> 'composer'").unionByName(best)


def feed_quality(pieces: DataFrame) -> DataFrame:
    """One row: pieces, those with a grade, in the central range and whether they are
    enough, distinct composers, missing eras and lengths, and of the lengths least,
    quartiles at (n + 1)/4 and so on, interpolated, and greatest."""
    central = F.count_if(F.col("grade").isin(*CENTRAL_GRADES))
    base = pieces.agg(
        F.count("*").alias("pieces"), F.count("grade").alias("graded"), central.alias("central"), (central >= LEAST_CENTRAL).alias("enough"),
        F.countDistinct(F.coalesce("composer", F.lit("?"))).alias("composers"), F.count_if(F.col("era").isNull()).alias("no_era"), F.count_if(F.col("duration").isNull()).alias("no_duration"),
    )
    n = F.col("n")

    def quartile(k):
        pos = F.lit(k) * (n + 1) / 4
        j = F.greatest(F.lit(1), F.least(F.floor(pos), n - 1))
        return F.when(n >= 2, value_at(j - 1, "duration") + (value_at(j, "duration") - value_at(j - 1, "duration")) * (pos - j))

    placed = placed_values(pieces.where("duration is not null").withColumn("_all", F.lit(1)), ["_all"], "duration")
    lengths = placed.groupBy("n").agg(F.struct(F.min("duration").alias("least"), *[F.round(quartile(k), 6).alias(f"q{k}") for k in (1, 2, 3)], F.max("duration").alias("greatest")).alias("l"))
    return base.withColumn("_l", lengths.agg(F.first("l")).scalar()).select("*", "_l.*").drop("_l")


def numbered(df: DataFrame, order: Sequence[str], name: str = "place") -> DataFrame:
    """Adds each row's place, from 1, in a total order, by ranges and not in one task."""
    return running_total(df, order, name=name)


def grade_rank(grade: Column) -> Column:
    """What typed grades are sorted by: their number, and 99 for anything else."""
    return F.coalesce(F.when(grade.rlike("^[0-9]+$"), grade.try_cast("int")), F.lit(99))


def both_ends(df: DataFrame, by: Column, tie: Sequence[str], k: int = 5) -> DataFrame:
    """(end, place, ...): the ``k`` rows with the least ``by`` ('best'), ties in the order
    ``tie``, and the ``k`` with the greatest ('worst'), the last first. Two top-k selections;
    nothing is sorted as a whole."""
    ranked = df.withColumn("_by", by)
    key = F.struct("_by", *tie)

    def end(name, order):
        top = ranked.orderBy(*order).limit(k)
        rows = top.agg(F.array_sort(F.collect_list(F.struct(key.alias("k"), *df.columns))).alias("r"))  # k rows
        seq = F.col("r") if name == "best" else F.reverse("r")
        return rows.select(F.lit(name).alias("end"), F.posexplode(seq).alias("i", "x")).select("end", (F.col("i") + 1).alias("place"), *[F.col(f"x.{c}") for c in df.columns])

    up = [F.col("_by"), *[F.col(t) for t in tie]]
    return end("best", up).unionByName(end("worst", [c.desc() for c in up]))


def undeclared_grades(syllabi: DataFrame) -> DataFrame:
    """(name, place, grade) of the pieces of syllabi (name, grades, pieces: array of (title,
    grade)) whose grade the syllabus doesn't declare; a null grade is never declared."""
    p = syllabi.select("name", "grades", F.posexplode("pieces").alias("place", "p"))
    return p.where(~F.coalesce(F.array_contains(F.coalesce("grades", F.array()), F.col("p.grade")), F.lit(False))).select("name", "place", "p.grade")


def level_hint(level: Column) -> Column:
    out = None
    for most, word in HINTS:
        out = F.when(level <= most, word) if out is None else out.when(level <= most, word)
    return out


def grade_badge(kind: Column, grade: Column, placeholder: Column) -> Column:
    """A grade as shown: bare from a curator, marked otherwise, a dash without one."""
    g = F.concat(F.lit("G"), grade.cast("string"))
    marked = F.concat(g, F.when(placeholder, " (placeholder)").otherwise(" (estimated)"))
    return F.when((kind == "none") | grade.isNull(), "—").when(kind == "curator", g).otherwise(marked)


def status_chip(status: Column) -> Column:
    return F.coalesce(*[F.when(status == k, F.lit(v)) for k, v in STATUS_LABELS.items()], F.lit(""))


def clef_suits(clefs: Column) -> Column:
    """Whether any clef of a score has the sign a guitar is written in."""
    return F.coalesce(F.exists(clefs, lambda c: F.coalesce(c == "G", F.lit(False))), F.lit(False))


def without_containers(entries: DataFrame) -> DataFrame:
    """Fetched entries without those that only say what a file held."""
    return entries.where(~(F.coalesce("container", F.lit(False)) | F.coalesce(F.col("status") == "container", F.lit(False))))


def conversion_buckets(files: DataFrame) -> DataFrame:
    """(bucket, n, blocks, clean): files (path, blocks, clean, error) by how much of them
    was converted: all, some, none, or fatal where they could not be read. A file
    without a score block counts as one of a single block."""
    blocks = F.greatest(F.col("blocks"), F.lit(1))
    bucket = F.when(F.coalesce("error", F.lit("")) != "", "fatal").when(F.col("clean") >= blocks, "all").when(F.col("clean") > 0, "some").otherwise("none")
    alive = bucket != "fatal"
    return files.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.sum(F.when(alive, blocks).otherwise(0)).alias("blocks"), F.sum(F.when(alive, F.col("clean")).otherwise(0)).alias("clean"))
