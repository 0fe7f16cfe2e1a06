"""From candidates to an accepted manifest: union, dedupe, ordered gates, checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import PATH_NOISE, first_code, first_match
from ..plans.cut import cut, size_checked


def first_wins(parts: Sequence[DataFrame], key: str, order: Sequence[str]) -> DataFrame:
    """The union by name of several sources, of each ``key`` the row of the first source,
    and within it the first by ``order``. Null keys are dropped; columns that a source
    lacks are null. Aggregated before the shuffle."""
    every = None
    for i, p in enumerate(parts):
        p = p.withColumn("_src", F.lit(i))
        every = p if every is None else every.unionByName(p, allowMissingColumns=True)
    body = [c for c in every.columns if c not in (key, "_src")]
    best = F.min_by(F.struct(*body), F.struct("_src", *order))
    return every.where(F.col(key).isNotNull()).groupBy(key).agg(best.alias("r")).select(key, "r.*")


def parent_fallback(children: DataFrame, parents: DataFrame, key: str, body: Sequence[str], mark: str = "#") -> DataFrame:
    """Each child with its own parent record or, without one, that of the id before
    ``mark``. One join on both ids: a child asks for at most two keys, and the exact one
    wins."""
    stem = F.substring_index(key, mark, 1)
    ask = F.array_distinct(F.array(F.col(key), stem))
    asked = children.withColumn("_k", F.explode(ask)).withColumn("_exact", (F.col("_k") == F.col(key)).cast("int"))
    p = parents.select(F.col(key).alias("_k"), F.struct(*body).alias("_p"))
    got = asked.join(p, "_k", "left")
    rest = [c for c in children.columns if c != key]
    pick = F.max_by("_p", F.when(F.col("_p").isNotNull(), F.col("_exact")).otherwise(-1))
    return got.groupBy(key, *rest).agg(pick.alias("_p")).select(key, *rest, *[F.col(f"_p.{c}").alias(c) for c in body])


def incremental(candidates: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What hasn't been fetched yet."""
    return candidates.join(done.select(key), key, "left_anti")


def content_keys(df: DataFrame, content: str) -> DataFrame:
    """Adds the SHA-256 of the content in hexadecimal, the identity of a file."""
    return df.withColumn("sha256", F.sha2(F.col(content).cast("binary"), 256))


def new_blobs(blobs: DataFrame, stored: DataFrame) -> DataFrame:
    """The contents not stored yet, each once: a content-addressed write-if-absent."""
    return content_keys(blobs, "content").join(stored.select("sha256"), "sha256", "left_anti").groupBy("sha256").agg(F.min_by("content", "id").alias("content"), F.min("id").alias("id"))


def sniff_format(content: Column) -> Column:
    """'mxl' for a zip archive, 'musicxml' for XML that begins like a score, else null."""
    head = F.decode(F.substring(content, 1, 192), "ISO-8859-1")
    lead = F.substring(F.regexp_replace(head, r"^\s+", ""), 1, 64)
    bom = F.hex(F.substring(content, 1, 3)) == "EFBBBF"
    return F.when(F.hex(F.substring(content, 1, 4)) == "504B0304", "mxl").when(
        lead.startswith("<?xml") | lead.startswith("<score-") | lead.startswith("<!DOCTYPE score"), "musicxml"
    ).when(bom & F.substring(head, 1, 128).contains("<?xml"), "musicxml")


def gate(df: DataFrame, gates: Sequence[tuple[Column, str]], id_col: str, sha: str | None = None) -> DataFrame:
    """Adds ``code``: the first gate that holds, in order, null for accepted rows. With
    ``sha``, of accepted rows of equal content the first by id stays and the others are
    'DUPLICATE' of ``winner``. Every row has exactly one outcome."""
    out = df.withColumn("code", first_code(*gates))
    if sha is None:
        return out
    accepted = F.col("code").isNull() & F.col(sha).isNotNull()
    firsts = size_checked(cut(out.where(accepted).groupBy(sha).agg(F.min(id_col).alias("_w"), F.count("*").alias("_n")).where("_n > 1").select(F.col(sha).alias("_s"), "_w")), 1_000_000)
    # what needs no partner gets a key of its own, so that nulls don't meet in one task
    asked = out.withColumn("_k", F.when(accepted, F.col(sha)).otherwise(F.concat(F.lit("-"), F.xxhash64(id_col).cast("string"))))
    again = F.row_number().over(Window.partitionBy("_k", id_col).orderBy(F.lit(0)))  # only rows of one id meet
    found = asked.withColumn("_a", again).join(firsts, F.col("_k") == F.col("_s"), "left")
    dup = F.col("_w").isNotNull() & (~F.col(id_col).eqNullSafe(F.col("_w")) | (F.col("_a") > 1))
    return found.withColumns({"winner": F.when(dup, F.col("_w")), "code": F.when(dup, "DUPLICATE").otherwise(F.col("code"))}).drop("_k", "_s", "_w", "_a")


def path_noise(path: str) -> Column:
    return first_match(path, PATH_NOISE)


def flag_counts(df: DataFrame, flags: str) -> DataFrame:
    """Rows per flag; rows without any as '(clean)'."""
    return df.select(F.explode(F.when(F.size(flags) > 0, F.col(flags)).otherwise(F.array(F.lit("(clean)")))).alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))


def capped_sections(df: DataFrame, section: str, order: Sequence[str], cap: int) -> DataFrame:
    """The first ``cap`` rows of each section, with how many more there are."""
    w = Window.partitionBy(section)
    return df.withColumns({"rn": F.row_number().over(w.orderBy(*order)), "more": F.greatest(F.count("*").over(w) - cap, F.lit(0))}).where(F.col("rn") <= cap)
