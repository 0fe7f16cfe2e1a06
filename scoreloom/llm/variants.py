"""Problem 2: variant spellings of people's names."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.cut import cut, size_checked, spread
from ..sources.tables import table
from .canonical import parsed
from .graph import followed
from .names import NICKNAMES, Name, align, is_cyrillic, skeleton, word_distance

CROWD = 50  # holders of one surname from which their given names decide who meets
REP = "tokens array<string>, short array<boolean>, surname int, gen int, cyr boolean, m_title boolean"


def delete_keys(token: str) -> set[str]:
    """The token and what remains of it when any one letter is dropped. Two tokens
    within one edit, or one swap of neighbours, share a key. Cyrillic tokens have
    keys of their skeletons only, Latin ones of both forms."""
    forms = [("s", skeleton(token))]
    if not is_cyrillic(token):
        forms.append(("f", token.replace("rn", "m")))
    return {k + x for k, t in forms for x in {t, *(t[:i] + t[i + 1 :] for i in range(len(t)))}}


def similar_tokens(tokens: DataFrame) -> DataFrame:
    """All pairs (t, u) of distinct ``token`` values within one edit, each with
    itself too, by joining the symmetric-delete neighbourhoods and checking."""

    def spread(batches):
        for pdf in batches:
            rows = [(t, k) for t in pdf["token"] for k in delete_keys(t)]
            yield pd.DataFrame(rows, columns=["token", "k"])

    def verify(batches):
        for pdf in batches:
            keep = [word_distance(t, u) < 9 for t, u in zip(pdf["t"], pdf["u"])]
            yield pdf[keep]

    keys = tokens.select("token").mapInPandas(spread, "token string, k string")
    near = (
        keys.select(F.col("token").alias("t"), "k")
        .join(keys.select(F.col("token").alias("u"), "k"), "k")
        .where("t <> u")
        .select("t", "u")
        .distinct()
        .mapInPandas(verify, "t string, u string")
    )
    return near.unionByName(tokens.select(F.col("token").alias("t"), F.col("token").alias("u")))


def given_keys(token: str, asks: bool) -> set[str]:
    """What a given name shares with every form of it that ``align`` allows: of its own
    letters and of its skeleton the first, the second, and the second in its place, so
    that one edit or swap leaves one; the same of the names it is a nickname of; and itself
    as the end of another, and every end it has, which differ as one asks or offers."""
    keys = set()
    for t in (token, *NICKNAMES.get(token, ())):
        sk = skeleton(t)
        forms = [("s", sk)] if is_cyrillic(t) else [("s", sk), ("r", t.replace("rn", "m"))]
        for tag, f in forms:
            keys.update(tag + c for c in f[:2])
            keys.update({tag + "2" + f[1]} if len(f) > 1 else ())
    keys.update(("x" if asks else "w") + token[-n:] for n in range(4, len(token)))
    keys.add(("w" if asks else "x") + token)
    return keys


def meeting_keys(groups: DataFrame) -> DataFrame:
    """(key, asks, offers): with what a group asks others of a like surname to compare,
    and what it offers. A group all of whose words may be the surname asks for those with
    a surname of so many words."""

    def run(batches):
        for pdf in batches:
            rows = []
            for key, tokens, surname, full, cyr, m_title in zip(*(pdf[c] for c in ("key", "tokens", "surname", "full", "cyr", "m_title"))):
                n = len(tokens)
                given = list(tokens) if cyr or not surname else list(tokens[: n - surname])
                asks = set().union(*(given_keys(t, True) for t in given)) if given else set()
                if cyr or surname in (0, n):
                    asks.add(f"*{n}")
                if m_title:
                    asks |= given_keys("m", True)
                offers = {f"*{surname}"} | (given_keys(tokens[0], False) if surname < n else set()) if full and surname else set()
                rows.append((key, sorted(asks), sorted(offers)))
            yield pd.DataFrame(rows, columns=["key", "asks", "offers"])

    return groups.select("key", "tokens", "surname", "full", "cyr", "m_title").mapInPandas(run, "key string, asks array<string>, offers array<string>")


def name_classes(values: DataFrame, ambiguous: bool = False) -> DataFrame:
    """Which distinct spellings in ``value`` name the same person.

    Columns: ``name``, ``person`` (a representative key), one row per spelling of
    somebody; spellings of nobody, null and blank ones are left out, and so are
    short forms (surname only, initials) that fit several people. With ``ambiguous``
    those are kept, without a person, and a column ``key`` has what equal spellings
    share.

    Spellings equal up to order, case, accents and decoration form a group at once.
    Groups meet through surname words within one edit (symmetric-delete index) and what
    their given names share, and are compared by optimal assignment of words; every full
    group points to the closest one of more authority (more wordings, more rows), and
    pointers are followed to their end. Short forms join the one person that all groups they fit
    belong to. A group with several wordings never counts as another's typing error.
    """
    given = values.where("value is not null").groupBy(F.col("value").alias("name")).agg(F.count("*").alias("n"))
    given = cut(given.where(F.trim(F.regexp_replace("name", "(?U)\\s", " ")) != ""))
    names = cut(parsed(spread(given)).join(given, "name").where("kind = 'person'"))
    rep = F.struct(*[c.split()[0] for c in REP.split(", ")])
    groups = cut(
        names.groupBy("key").agg(
            F.count("*").alias("wordings"),
            F.sum("n").alias("weight"),
            F.max_by(rep, F.struct((F.col("surname") > 0).cast("int"), -F.length("name"), "name")).alias("rep"),
        )
        .select("key", "wordings", "weight", "rep.*")
        .withColumn("authority", F.struct("wordings", "weight", "key"))
        .withColumn("full", F.expr("size(tokens) > 1 and not exists(short, x -> x)"))
    )
    # words by which groups meet: the surname's where it is known, else all
    words = groups.select(
        "key", "full", F.expr("surname > 0").alias("ordered"),
        F.explode(F.expr("case when surname > 0 and not cyr then slice(tokens, -surname, surname) else filter(tokens, (t, i) -> not short[i] and length(t) > 2) end")).alias("token"),
    ).where("length(token) > 2")
    near = similar_tokens(words.select("token").distinct())
    asking = words.select(F.col("key").alias("a"), F.col("token").alias("t")).join(near, "t").select("a", "u")
    offering = words.where("full and ordered").select(F.col("key").alias("b"), F.col("token").alias("u"))
    # where many hold one surname they meet only if their given names share something as
    # well, so that not all are compared with one another; the pairs found are the same
    hot = size_checked(offering.groupBy("u").agg(F.count("*").alias("n")).where(f"n > {CROWD}").select("u"), 200_000)
    keys = cut(meeting_keys(groups))
    keyed = lambda df, end, c: df.join(hot, "u", "left_semi").join(keys.select(F.col("key").alias(end), F.explode(c).alias("k")), end)
    pairs = (
        asking.join(hot, "u", "left_anti").join(offering, "u").select("a", "b")
        .unionByName(keyed(asking, "a", "asks").join(keyed(offering, "b", "offers"), ["u", "k"]).select("a", "b"))
        .where("a <> b").distinct()
    )
    givens = cut(
        groups.where("full and surname > 0 and not cyr and wordings > 1")
        .select(F.explode(F.expr("slice(tokens, 1, size(tokens) - surname)")).alias("token"), "key")
        .groupBy("token").agg(F.count("*").alias("n")).where("n > 1 and length(token) > 2").select("token")
    )
    is_given = givens.withColumn("known", F.lit(True))
    marked = (
        groups.select("key", F.posexplode("tokens").alias("i", "token"))
        .join(is_given, "token", "left")
        .groupBy("key").agg(F.collect_set(F.when(F.col("known"), F.col("token"))).alias("known"))
    )
    side = groups.join(marked, "key", "left")

    def score(batches):
        known: dict[str, Name] = {}

        def name(key: str, row) -> Name:
            n = known.get(key)
            if n is None:
                d = row if isinstance(row, dict) else row.asDict()
                n = Name("person", list(d["tokens"]), [bool(x) for x in d["short"]], int(d["surname"]), int(d["gen"]), bool(d["cyr"]), bool(d["m_title"]))
                if len(known) < 100_000:
                    known[key] = n
            return n

        for pdf in batches:
            out = []
            for a, b, ra, rb, ka, kb in zip(*(pdf[c] for c in ("a", "b", "ra", "rb", "known_a", "known_b"))):
                m = align(name(a, ra), name(b, rb), frozenset(ka) | frozenset(kb))
                if m:
                    out.append((a, b, float(m.cost), int(m.edits), bool(m.partial)))
            yield pd.DataFrame(out, columns=["a", "b", "cost", "edits", "partial"])

    packed = F.struct(*[c.split()[0] for c in REP.split(", ")])
    links = (
        pairs.join(side.select(F.col("key").alias("a"), packed.alias("ra"), F.col("known").alias("known_a")), "a")
        .join(side.select(F.col("key").alias("b"), packed.alias("rb"), F.col("known").alias("known_b")), "b")
        .mapInPandas(score, "a string, b string, cost double, edits int, partial boolean")
    )
    about = groups.select("key", "authority", "wordings", "full", "cyr")
    links = cut(
        links.join(about.select(F.col("key").alias("a"), F.col("authority").alias("aa"), F.col("wordings").alias("wa"), F.col("full").alias("fa"), F.col("cyr").alias("ca")), "a")
        .join(about.select(F.col("key").alias("b"), F.col("authority").alias("ab")), "b")
        .where("edits = 0 or wa < 2 or ca")
    )
    parent = links.where("fa and aa < ab").groupBy(F.col("a").alias("key")).agg(F.min_by("b", F.struct("cost", F.struct(-F.col("ab.wordings"), -F.col("ab.weight"), F.col("ab.key")))).alias("root"))
    roots = cut(groups.where("full").select("key").join(parent, "key", "left").select("key", F.coalesce("root", "key").alias("root")))
    roots = followed(roots)
    short = (
        links.where("not fa")
        .join(roots.select(F.col("key").alias("b"), "root"), "b")
        .groupBy(F.col("a").alias("key"))
        .agg(F.countDistinct("root").alias("people"), F.min("root").alias("root"))
    )
    lone = groups.where("not full").select("key").join(short, "key", "left").where("people is null or people = 1").select("key", F.coalesce("root", "key").alias("root"))
    found = names.select("name", "key").join(roots.unionByName(lone), "key", "left" if ambiguous else "inner")
    return found.select("name", F.col("root").alias("person"), *["key"] * ambiguous)


def spelled_names(spark: SparkSession, base: str) -> DataFrame:
    parts = [
        table(spark, base, t, [c]).select(F.col(c).alias("value"))
        for t, c in (("dummy_advisor_grades", "composer_normalized"), ("guitar_loot_candidate", "composer_hint"), ("mutopia_candidate", "composer"))
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def p2_classes(spark: SparkSession, base: str) -> DataFrame:
    """One row per spelling: the person's representative and how many spellings it has."""
    c = name_classes(spelled_names(spark, base))
    return c.join(c.groupBy("person").agg(F.count("*").alias("spellings")), "person").select("name", "person", "spellings")


def p2_found(spark: SparkSession, base: str, part: int = 500) -> DataFrame:
    """Every pair of spellings of one person, as the query defines. A person with more
    than ``part`` spellings is spread over as many tasks as keep a part that small."""
    c = cut(name_classes(spelled_names(spark, base)))
    sized = c.join(c.groupBy("person").agg(F.ceil(F.count("*") / part).alias("parts")), "person")
    left = sized.select("person", F.col("name").alias("name_a"), F.pmod(F.xxhash64("name"), F.col("parts")).alias("salt"))
    right = sized.select("person", F.col("name").alias("name_b"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("salt"))
    return left.join(right, ["person", "salt"]).where("name_a < name_b").select("name_a", "name_b")
