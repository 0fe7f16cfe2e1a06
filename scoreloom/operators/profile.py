"""Problem 4: column-level profiles from maintained value counts.

The state is a table (load_id, column_name, value, n): how often each value of each
column occurs in each load. It is kept in a written log of signed deltas
(``CountTable``): new files add their counts, files that are gone or changed take theirs
away; every metric is derived from the counts and so is exact.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from hashlib import md5

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.cut import cut, kept_folder, size_checked
from ..sources.stores import CommitLog, stamped_files
from ..sources.tables import table
from .ordering import null_safe, running_total

KEYS = ["load_id", "column_name", "value"]
COUNTS = "load_id int, value string, n long, column_name string"
# what a well-formed value of a text column looks like; blank counts apart
PATTERNS = {"key_fifths": "^-?[0-7]$", "time_sig": "^[0-9]{1,2}/[0-9]{1,2}$", "grade": "^([1-9]|10)$"}
EDGES = (0.001, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.98, 0.99, 0.995, 0.999)
COMMON = 0.002  # share of all values from which a single value is watched by itself
LEAST_COMMON = 20
DEPARTURE = 5.5  # standard deviations beyond which a load departs from the others


def deltas(df: DataFrame, columns: Sequence[str], load: str = "load_id", sign: int = 1) -> DataFrame:
    """The value counts that the rows of ``df`` add (``sign`` 1) or take away (-1).
    Null is a value of its own; numbers keep their text form, NaN is 'NaN'. Counted
    in each partition before the shuffle."""
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns])
    return (
        df.select(F.col(load).alias("load_id"), F.explode(cells).alias("x"))
        .groupBy("load_id", "x.column_name", "x.value").agg((F.count("*") * sign).alias("n"))
    )


def apply_deltas(*parts: DataFrame) -> DataFrame:
    """The table of counts after all ``parts`` (counts and signed deltas); values that
    no longer occur are dropped. Order doesn't matter. A count below zero would mean
    that more was retracted than ever loaded; such rows are kept and show."""
    return reduce(DataFrame.unionByName, parts).groupBy(*KEYS).agg(F.sum("n").alias("n")).where("n <> 0")


class CountTable:
    """Value counts of a parquet table's columns, kept in ``folder`` and brought up to
    date before they are read.

    Each update is one commit: a part of signed counts, partitioned by column, and a
    note of the files it covers (path, length, time of change), by column. Only files
    that no commit covers are scanned; of a file that is gone or changed, the commits
    that cover it are negated, and what else they covered is counted anew. Nothing is
    scanned when nothing changed. Two writers can't both commit after the same state:
    the later one starts over from the other's.
    """

    def __init__(self, folder: str):
        self.log = CommitLog(folder)

    def update(self, source: str, spark: SparkSession, columns: Sequence[str], load: str = "load_id") -> None:
        columns = list(columns)
        files = stamped_files(spark, source)
        while columns:
            commits = self.log.commits(spark)
            groups: dict[tuple, list[str]] = {}
            for c in columns:
                groups.setdefault(tuple(k for k, (_, note) in enumerate(commits) if c in note["columns"]), []).append(c)
            part, covered = None, {}
            for seen, cs in groups.items():
                live = {k for k in seen if not any(k in commits[j][1]["negates"].get(c, ()) for j in seen for c in cs)}
                known = {f: k for k in live for c in cs for f in commits[k][1]["covers"].get(c, ())}
                stale = {k for f, k in known.items() if f not in files}
                add = [f for f in files if f not in known or known[f] in stale]
                for c in cs:
                    covered[c] = (add, sorted(stale))
                if add:
                    got = deltas(spark.read.parquet(*sorted({f.rsplit("|", 2)[0] for f in add})).where(F.col(load).isNotNull()), cs, load)
                    part = got if part is None else part.unionByName(got)
                for k in sorted(stale):
                    gone = spark.read.schema(COUNTS).parquet(commits[k][0]).where(F.col("column_name").isin(cs)).withColumn("n", -F.col("n"))
                    part = gone if part is None else part.unionByName(gone)
            if part is None:
                return
            changed = [c for c, (add, stale) in covered.items() if add or stale]
            note = {"columns": changed, "covers": {c: covered[c][0] for c in changed}, "negates": {c: covered[c][1] for c in changed}}
            if self.log.commit(part, note, len(commits), partition_by="column_name"):
                return

    def read(self, spark: SparkSession, columns: Sequence[str]) -> DataFrame:
        """(load_id, column_name, value, n) of ``columns``; of other columns no file is
        opened."""
        parts = [at for at, note in self.log.commits(spark) if set(columns) & set(note["columns"])]
        if not parts:
            return spark.createDataFrame([], COUNTS)
        read = [spark.read.schema(COUNTS).parquet(at).where(F.col("column_name").isin(list(columns))) for at in parts]
        return read[0].select(*KEYS, "n") if len(read) == 1 else apply_deltas(*[r.select(*KEYS, "n") for r in read])


def maintained(spark: SparkSession, base: str, name: str, columns: Sequence[str]) -> DataFrame:
    """The kept counts of columns of a table below ``base``, brought up to date."""
    source = f"{base}/{name}.parquet"
    kept = CountTable(f"{kept_folder(spark)}/value_counts/{md5(source.encode()).hexdigest()}")
    kept.update(source, spark, columns)
    return kept.read(spark, columns)


def exact_round(c) -> Column:
    """Six places, by a rule whose steps any engine takes alike."""
    return F.floor(c * 1e6 + 0.5) / 1e6


def profile(counts: DataFrame, by: Sequence[str] = ("load_id", "column_name"), patterns: Mapping[str, str] = PATTERNS) -> DataFrame:
    """One row per group of ``by``: rows, nulls, NaN, blanks, zeros, distinct values,
    least, greatest and mean number, odd forms, share of the commonest value and
    entropy in bits. Null, NaN and blank are no values for the distinct count and the
    distribution; a column of nothing else has entropy 0 and null range."""
    merged = counts if "load_id" in by else counts.groupBy("column_name", "value").agg(F.sum("n").alias("n"))
    num = F.expr("try_cast(value as double)")
    is_nan = F.col("value") == "NaN"
    blank = F.trim("value") == ""
    valued = F.col("value").isNotNull() & ~is_nan & ~blank
    odd = F.lit(False)
    for c, p in patterns.items():
        odd = odd | ((F.col("column_name") == c) & valued & ~F.col("value").rlike(p))
    n, when = F.col("n"), lambda c, x=None: F.sum(F.when(c, n if x is None else x).otherwise(0))
    total = F.sum(F.when(valued, n))
    return merged.groupBy(*by).agg(
        F.sum("n").alias("n_rows"),
        when(F.col("value").isNull()).alias("n_null"),
        when(is_nan).alias("n_nan"),
        when(blank).alias("n_blank"),
        when(valued & (num == 0)).alias("n_zero"),
        F.sum(F.when(valued, 1).otherwise(0)).alias("n_distinct"),
        F.min(F.when(valued, num)).alias("least"),
        F.max(F.when(valued, num)).alias("greatest"),
        # summed as decimals: sums of doubles depend on their order
        exact_round(F.sum(F.when(valued, num.try_cast("decimal(28,9)") * n)).cast("double") / F.sum(F.when(valued & num.isNotNull(), n))).alias("mean"),
        when(odd).alias("n_odd"),
        exact_round(F.max(F.when(valued, n)) / total).alias("top_share"),
        F.round(F.coalesce(F.log2(total) - F.sum(F.when(valued, n * F.log2(n))) / total, F.lit(0.0)), 6).alias("entropy"),
    )


def cell_counts(counts: DataFrame) -> DataFrame:
    """(load_id, column_name, cell, x): rows of each load in each cell. The cells of a
    column: null, NaN, negative, zero, between and below quantiles of all loads,
    single values that are common over all loads, quarters of the fraction, and
    multiples of 2, 5, 10 and 25. Null, NaN apart, non-numbers have no cell."""
    num = F.expr("try_cast(value as double)")
    counts = counts.withColumn("v", num)
    values = counts.where("v is not null and not isnan(v)").groupBy("column_name", "v").agg(F.sum("n").alias("n"))
    run = cut(running_total(values, ["column_name", "v"], F.col("n"), "upto"))
    ends = F.broadcast(run.groupBy("column_name").agg(F.max("upto").alias("end"), F.sum("n").alias("total")))  # one row a column
    qs = F.array(*[F.lit(q) for q in EDGES])
    placed = run.join(ends, "column_name").withColumn("upto", F.col("upto") - F.col("end") + F.col("total"))
    hit = F.filter(qs, lambda q: (F.ceil(q * F.col("total")) <= F.col("upto")) & (F.ceil(q * F.col("total")) > F.col("upto") - F.col("n")))
    edges = placed.select("column_name", "v", F.explode(hit).alias("q")).groupBy("column_name").agg(F.sort_array(F.collect_list("v")).alias("edges"))
    common = placed.where(F.col("n") >= F.greatest(F.lit(LEAST_COMMON), F.col("total") * COMMON)).select("column_name", "v", F.lit(True).alias("common"))
    v = F.col("v")
    frac = v - F.floor(v)
    above = F.size(F.filter("edges", lambda e: e < v))
    several = [F.when((frac == 0) & (F.abs(v) % m == 0), F.lit(f"multiple of {m}")) for m in (2, 5, 10, 25)]
    cells = F.array_compact(
        F.concat(
            F.array(
                F.concat(F.lit("between "), above.cast("string")),
                F.when(F.col("common"), F.concat(F.lit("value "), v.cast("string"))),
                F.when(v < 0, F.lit("negative")),
                F.when(v == 0, F.lit("zero")),
                F.when(frac == 0, F.lit("whole")).otherwise(F.concat(F.lit("fraction "), F.floor(frac * 4).cast("string"))),
                *several,
            ),
            F.transform(F.sequence(above, F.size("edges")), lambda i: F.when(i < F.size("edges"), F.concat(F.lit("up to "), i.cast("string")))),
        )
    )
    # few rows a column each: edges, and values of a fixed share of all rows
    of_value = run.select("column_name", "v").join(F.broadcast(edges), "column_name").join(F.broadcast(common), ["column_name", "v"], "left").select("column_name", "v", F.explode(cells).alias("cell"))
    numbers = counts.where("v is not null and not isnan(v)").join(of_value, ["column_name", "v"]).groupBy("load_id", "column_name", "cell").agg(F.sum("n").alias("x"))
    rest = counts.where("value is null or isnan(v)").groupBy("load_id", "column_name", F.when(F.col("value").isNull(), "null").otherwise("NaN").alias("cell")).agg(F.sum("n").alias("x"))
    return numbers.unionByName(rest)


def departures(counts: DataFrame) -> DataFrame:
    """(load_id, column_name, cell, x, expected, z): how far each load's share of each
    cell lies from that of the other loads.

    The expected share comes from the loads that agree with the median one; shares
    are compared on the arc-sine scale, where their spread is the same at any rate,
    so one threshold serves rare and common cells and loads of any size. A cell that
    varies more between loads than by chance (its median deviation says so) is held
    to its own spread. Empty input gives no rows, a single load departs from nothing.
    """
    cells = cell_counts(counts)
    sizes = counts.groupBy("load_id", "column_name").agg(F.sum("n").alias("size"))
    kinds = cells.select("column_name", "cell").distinct()
    full = sizes.join(kinds, "column_name").join(cells, ["load_id", "column_name", "cell"], "left").fillna(0, ["x"])
    w = Window.partitionBy("column_name", "cell")  # as many rows as loads
    scale = lambda x, n: F.asin(F.sqrt((x + 0.375) / (n + 0.75)))
    share = F.col("x") / F.col("size")
    z = (
        full.withColumn("mid", F.median(share).over(w))
        .withColumn("z0", 2 * F.sqrt("size") * (F.asin(F.sqrt(F.least(share, F.lit(1.0)))) - F.asin(F.sqrt(F.least("mid", F.lit(1.0))))))
        .withColumn("good", F.abs("z0") < 4)
        .withColumn("some", F.avg(F.col("good").cast("int")).over(w) > 0.5)
        .withColumn("base", F.when(F.col("some"), F.sum(F.when(F.col("good"), F.col("x"))).over(w) / F.sum(F.when(F.col("good"), F.col("size"))).over(w)).otherwise(F.col("mid")))
        .withColumn("expected", F.col("base") * F.col("size"))
        .withColumn("z", 2 * F.sqrt("size") * (scale(F.col("x"), F.col("size")) - scale(F.col("expected"), F.col("size"))))
        .withColumn("zmid", F.median("z").over(w))
        .withColumn("spread", F.greatest(F.lit(1.0), 1.4826 * F.median(F.abs(F.col("z") - F.col("zmid"))).over(w)))
    )
    return z.select("load_id", "column_name", "cell", "x", F.round("expected", 3).alias("expected"), F.round(F.col("z") / F.col("spread"), 3).alias("z"))


WATCHED = ["tempo_bpm", "midi_max", "barre_count"]


def p4_found(spark: SparkSession, base: str) -> DataFrame:
    """Loads and watched columns that went wrong."""
    d = departures(maintained(spark, base, "features", WATCHED))
    return d.where(F.abs("z") > DEPARTURE).select("load_id", "column_name").distinct()


def p4_departures(spark: SparkSession, base: str) -> DataFrame:
    """The same with the cell that tells most, and by how much."""
    d = departures(maintained(spark, base, "features", WATCHED)).where(F.abs("z") > DEPARTURE)
    worst = F.max_by(F.struct("cell", "x", "expected", "z"), F.struct(F.abs("z"), "cell")).alias("w")
    return d.groupBy("load_id", "column_name").agg(worst).select("load_id", "column_name", "w.*")


def _columns(spark, base):
    return [c for c in table(spark, base, "features").columns if c != "load_id"]


def p4_profile(spark: SparkSession, base: str) -> DataFrame:
    """Every column but ``load_id`` itself, of every load."""
    return profile(maintained(spark, base, "features", _columns(spark, base)))


def p4_profile_all(spark: SparkSession, base: str) -> DataFrame:
    """Every column over all loads but the first, which is retracted by its negated
    counts."""
    counts = maintained(spark, base, "features", _columns(spark, base))
    first = counts.where("load_id = 1").withColumn("n", -F.col("n"))
    return profile(apply_deltas(counts, first), by=("column_name",))


_TEXT = ["candidate_id", "title", "extracted_at", "source", "composer_normalized", "grade", "grade_source", "key_fifths", "time_sig"]
_NUMBERS = (
    "midi_min midi_max midi_range midi_median key_changes tempo_bpm meter_changes smallest_division dotted_count tied_count tuplet_count notes_per_measure "
    "accidentals_outside_key max_chord_stack polyphonic_measure_ratio voice_count_max ornament_mordent ornament_trill ornament_turn grace_count harmonic_count barre_count "
    "position_shift_proxy pitch_min_fret_max pitch_min_fret_p90 pitch_position_shifts measure_count note_count duration_sec_approx"
).split()


def _sql(where: str, key: str) -> str:
    parts = [f"select load_id, '{c}' as column_name, {c}::varchar as t, try_cast({c}::varchar as double) as v, trim({c}::varchar, ' ') = '' as blank, count(*) as n from features where {where} group by all" for c in _TEXT]
    parts += [f"select load_id, '{c}' as column_name, {c}::varchar as t, {c}::double as v, false as blank, count(*) as n from features where {where} group by all" for c in _NUMBERS]
    odd = " or ".join(f"(column_name = '{c}' and not regexp_matches(t, '{p}'))" for c, p in PATTERNS.items())
    return f"""with u as ({' union all '.join(parts)}),
w as (select {'load_id, ' if key else ''}column_name, t, v, blank, t is not null and not coalesce(isnan(v), false) and not coalesce(blank, false) as ok, sum(n) as n from u group by all)
select {key}column_name, sum(n)::bigint as n_rows, sum(case when t is null then n else 0 end)::bigint as n_null, sum(case when isnan(v) then n else 0 end)::bigint as n_nan,
 sum(case when blank then n else 0 end)::bigint as n_blank, sum(case when ok and v = 0 then n else 0 end)::bigint as n_zero, sum(case when ok then 1 else 0 end)::bigint as n_distinct,
 min(case when ok then v end) as least, max(case when ok then v end) as greatest, floor(sum(case when ok then try_cast(v as decimal(28,9)) * n end)::double / sum(case when ok and v is not null then n end) * 1e6::double + 0.5::double) / 1e6::double as mean,
 sum(case when ok and ({odd}) then n else 0 end)::bigint as n_odd, floor(max(case when ok then n end) / sum(case when ok then n end) * 1e6::double + 0.5::double) / 1e6::double as top_share,
 round(coalesce(log2(sum(case when ok then n end)) - sum(case when ok then n * log2(n) end) / sum(case when ok then n end), 0), 6) as entropy
from w group by all"""


QUERIES = {"p4_found": p4_found, "p4_departures": p4_departures, "p4_profile": p4_profile, "p4_profile_all": p4_profile_all}
SQL = {"p4_profile": _sql("load_id is not null", "load_id, "), "p4_profile_all": _sql("load_id is not null and load_id <> 1", "")}
