"""Profiles as a log of operations: their state, the active one, and what they read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.cut import size_checked

# ---------------------------------------------------------------- fixed values
LOWEST, HIGHEST = 1, 10
DEFAULT_NAME = "You"
# ---------------------------------------------------------------- end of fixed values


def level_or_none(level):
    """A level within the bounds, else null."""
    return F.when(level.between(LOWEST, HIGHEST), level)


def profile_state(ops: DataFrame) -> DataFrame:
    """(id, display_name, level, created) of the profiles that remain after operations
    (id, seq, op, display_name, level, sets_level). A create without a name is void, and
    so is whatever precedes an id's first valid create or follows its delete; an update
    with a blank name is refused as a whole; a level out of bounds is none. Aggregates by
    id, no window: ids aren't used again."""
    named = F.trim(F.coalesce("display_name", F.lit("")))
    o = ops.withColumn("_name", F.when(named != "", named))
    born = F.min(F.when((F.col("op") == "create") & F.col("_name").isNotNull(), F.col("seq")))
    life = o.groupBy("id").agg(born.alias("_born"), F.min(F.when(F.col("op") == "delete", F.col("seq"))).alias("_gone")).where("_born is not null and (_gone is null or _gone < _born)")
    valid = o.join(life, "id").where((F.col("seq") >= F.col("_born")) & ((F.col("op") == "create") & (F.col("seq") == F.col("_born")) | (F.col("op") == "update") & (F.col("display_name").isNull() | F.col("_name").isNotNull())))
    sets = (F.col("op") == "create") | F.coalesce("sets_level", F.lit(False))
    return valid.groupBy("id").agg(F.max_by("_name", F.when(F.col("_name").isNotNull(), F.col("seq"))).alias("display_name"), F.max_by(F.struct(level_or_none(F.col("level")).alias("l")), F.when(sets, F.col("seq"))).alias("_l"), F.min("_born").alias("created")).select("id", "display_name", F.col("_l.l").alias("level"), "created")


def seeded(profiles: DataFrame, legacy: DataFrame) -> DataFrame:
    """The profiles of each owner, or, for an owner without any, a default one that takes
    over the level (text) it had before there were profiles."""
    none = legacy.join(profiles.select("owner").distinct(), "owner", "left_anti")
    was = level_or_none(F.regexp_extract(F.coalesce("legacy_level", F.lit("")), r"^\s*([+-]?\d+)", 1).try_cast("int"))
    return profiles.select("owner", "id", "display_name", "level", "created").unionByName(
        none.select("owner", F.concat(F.lit("p_"), F.substring(F.md5(F.col("owner").cast("string")), 1, 12)).alias("id"), F.lit(DEFAULT_NAME).alias("display_name"), was.alias("level"), F.lit(0).cast("long").alias("created"))
    )


def active_profile(profiles: DataFrame, pointers: DataFrame) -> DataFrame:
    """Each owner's active profile: the one its pointer names if it exists, else the
    first created. Owners without profiles have none."""
    p = profiles.alias("p").join(size_checked(pointers.select("owner", "active"), 500_000).alias("a"), "owner", "left")
    best = F.min_by(F.struct("id", "display_name", "level"), F.struct((F.coalesce(F.col("id") != F.col("active"), F.lit(True))).cast("int"), "created", "id"))
    return p.groupBy("owner").agg(best.alias("r")).select("owner", "r.*")


def saved_levels(active: DataFrame, wanted: DataFrame) -> DataFrame:
    """(owner, id, level): the active profiles' levels after saves (owner, seq, level): the
    last number within the bounds, rounded half up, or none after a clear (null); other
    numbers change nothing."""
    ok = F.col("level").isNull() | F.col("level").between(LOWEST, HIGHEST)
    last = wanted.where(ok).groupBy("owner").agg(F.max_by(F.struct(F.floor(F.col("level") + 0.5).cast("int").alias("l")), "seq").alias("s"))
    j = active.join(last, "owner", "left")
    return j.select("owner", "id", F.when(F.col("s").isNotNull(), F.col("s.l")).otherwise(F.col("level")).alias("level"))


def of_profile(records: DataFrame, profile) -> DataFrame:
    """All records of one profile; the filter reaches the scan."""
    return records.where(F.col("profile_id") == profile)


def status_or_default(pieces: DataFrame, statuses: DataFrame, default: str = "not_seen") -> DataFrame:
    """Pieces with their status, the default where there is no record."""
    s = statuses.select("candidate_id", F.col("status").alias("_s"))
    return pieces.join(s, "candidate_id", "left").withColumn("status", F.coalesce("_s", F.lit(default))).drop("_s")


def new_id(seed):
    """A short id that sorts by time: the time and random digits in base 36."""
    random = F.conv(F.pmod(F.xxhash64(seed, F.uuid()), F.lit(36**6)).cast("string"), 10, 36)
    return F.concat(F.lit("p_"), F.lower(F.conv(F.unix_millis(F.current_timestamp()).cast("string"), 10, 36)), F.lit("_"), F.lower(F.lpad(random, 6, "0")))


# practice sessions -------------------------------------------------------------

# What may follow what.
STEPS = {"loading": ("ready",), "ready": ("recording",), "recording": ("analyzing",), "analyzing": ("done",), "done": ("ready", "recording")}


def phases(events: DataFrame) -> DataFrame:
    """(session, phase, refused): where each session of events (session, seq, to) ends when
    it begins at 'loading' and every step that may not follow is refused. A fold over the
    session's events in order; sessions are short."""
    allowed = F.create_map(*[F.lit(x) for k, v in STEPS.items() for x in (k, ",".join(v))])
    start = F.struct(F.lit("loading").alias("phase"), F.lit(0).alias("refused"))

    def step(state, e):
        ok = F.array_contains(F.split(F.coalesce(F.element_at(allowed, state["phase"]), F.lit("")), ","), e["to"])
        return F.struct(F.when(ok, e["to"]).otherwise(state["phase"]).alias("phase"), (state["refused"] + F.when(ok, 0).otherwise(1)).alias("refused"))

    rows = events.where("to is not null").groupBy("session").agg(F.array_sort(F.collect_list(F.struct("seq", "to"))).alias("e"))
    return rows.select("session", F.aggregate("e", start, step).alias("s")).select("session", "s.phase", "s.refused")
