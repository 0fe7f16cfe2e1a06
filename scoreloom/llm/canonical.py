"""Problem 7: free-entered values mapped to the entries of a canonical list."""

from __future__ import annotations

import uuid
from dataclasses import asdict

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.cut import cut, size_checked, spread
from ..sources.tables import table
from .names import Name, align, parse, skeleton

SHARD_ROWS = 20_000  # words of the list, and of the values, that one task holds


def levenshtein(a: str, b: str) -> int:
    """Edits to insert, delete or replace: a metric, so the triangle inequality
    holds. Columns of the table are kept as bit vectors of vertical differences."""
    if not a or not b:
        return len(a) + len(b)
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    last = 1 << len(a) - 1
    up, down, score = full, 0, len(a)
    for c in b:
        same = places.get(c, 0)
        zero = (((same & up) + up) ^ up) | same | down
        plus = down | (full & ~(zero | up))
        minus = up & zero
        score += bool(plus & last) - bool(minus & last)
        plus = (plus << 1 | 1) & full
        minus = minus << 1 & full
        up, down = minus | (full & ~(zero | plus)), plus & zero
    return score


class BKTree:
    """Strings under an edit metric. A node's children hang at their distance from
    it; for a query at distance d within radius r only children at d-r..d+r can
    hold an answer. ``find`` therefore returns *every* entry within the radius."""

    def __init__(self, metric=levenshtein):
        self.metric = metric
        self.root = None
        self.visited = 0

    def add(self, word: str, value) -> None:
        if self.root is None:
            self.root = (word, [value], {})
            return
        node = self.root
        while True:
            d = self.metric(word, node[0])
            if d == 0:
                node[1].append(value)
                return
            if d not in node[2]:
                node[2][d] = (word, [value], {})
                return
            node = node[2][d]

    def find(self, word: str, radius: int) -> list[tuple[int, str, list]]:
        found, stack = [], [self.root] if self.root else []
        while stack:
            w, values, children = stack.pop()
            self.visited += 1
            d = self.metric(word, w)
            if d <= radius:
                found.append((d, w, values))
            stack += [c for k, c in children.items() if d - radius <= k <= d + radius]
        return found


NAME_SCHEMA = "name string, kind string, tokens array<string>, short array<boolean>, surname int, gen int, cyr boolean, m_title boolean, key string"


def parsed(names: DataFrame) -> DataFrame:
    """One row of ``name`` per spelling, with what ``names.parse`` says of it."""

    def run(batches):
        for pdf in batches:
            out = [asdict(p) | {"key": p.key, "name": s} for s, p in ((s, parse(s)) for s in pdf["name"])]
            yield pd.DataFrame(out, columns=["name", "kind", "tokens", "short", "surname", "gen", "cyr", "m_title", "key"])

    return names.select("name").mapInPandas(run, NAME_SCHEMA)


def name_of(row) -> Name:
    return Name(row["kind"], list(row["tokens"]), [bool(x) for x in row["short"]], int(row["surname"]), int(row["gen"]), bool(row["cyr"]), bool(row["m_title"]))


_TREES: dict[tuple[str, int], BKTree] = {}  # of this worker: a shard's tree is built once


def near_words(words: DataFrame, listed: DataFrame, radius: int = 2, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(word, entry_word) of every distinct ``word`` and every distinct ``entry_word``
    whose skeletons are within ``radius`` edits.

    The list is cut into shards of at most about ``shard_rows`` words, of which each
    worker holds the BK-tree that it is asked for; the words are cut into chunks, several
    a core, so that the search is spread however few the words are. Every shard answers
    for every word."""
    spark = words.sparkSession
    cores = spark.sparkContext.defaultParallelism
    shards = max(1, -(-listed.count() // shard_rows))
    chunks = max(cores, -(-words.count() // shard_rows))
    ask = words.withColumn("chunk", F.pmod(F.xxhash64("word"), F.lit(chunks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    held = listed.withColumn("shard", F.pmod(F.xxhash64("entry_word"), F.lit(shards)).cast("int")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    this = uuid.uuid4().hex

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame(columns=["word", "entry_word"])
        shard = int(key[0])
        tree = _TREES.get((this, shard))
        if tree is None:
            if len(_TREES) > 4 or any(k[0] != this for k in _TREES):
                _TREES.clear()
            tree = _TREES[(this, shard)] = BKTree()
            for w in right["entry_word"]:
                tree.add(skeleton(w), w)
        out = [(w, e) for w in left["word"] for _, _, es in tree.find(skeleton(w), radius) for e in es]
        return pd.DataFrame(out, columns=["word", "entry_word"])

    # few bytes but much work: the number of partitions is given, so that none are joined
    n = chunks * min(shards, 64)
    return ask.repartition(n, "shard", "chunk").groupBy("shard", "chunk").cogroup(held.repartition(n, "shard", "chunk").groupBy("shard", "chunk")).applyInPandas(run, "word string, entry_word string")


def map_to_list(values: DataFrame, entries: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Map each distinct ``value`` to the entry of ``entry`` it means.

    Columns: ``raw_composer``, ``composer`` (empty string: none of the list),
    ``cost``. Values that say nothing of a person map to none; wordings of unnamed
    and folk authorship map to the entries of that kind. Null and blank values are
    left out, repeated ones count once, an empty list maps all to none.

    The distinct words of the values are looked up in BK-trees over the surname words
    of the list (Levenshtein, radius 2, so that swapped neighbours are within); the
    entries so met are compared word by word, and of all shards' the closest wins. Two
    entries equally close: none. A spelling with a wrong letter that itself comes
    in several wordings (decorated, reordered) is another person's own name. Which
    words are given names is asked of the whole list, so its sharding doesn't matter.
    """
    spark = values.sparkSession
    names = values.select(F.col("value").alias("name")).where(F.trim(F.regexp_replace("name", "(?U)\\s", " ")) != "").distinct()
    names = cut(parsed(spread(cut(names))))  # few bytes, but each is parsed
    entries = cut(parsed(entries.select(F.col("entry").alias("name")).where("name is not null").distinct()))
    people, listed = names.where("kind = 'person'"), entries.where("kind = 'person'")
    entry_words = cut(listed.select(F.col("name").alias("entry"), F.explode(F.expr("slice(tokens, -greatest(1, surname), greatest(1, surname))")).alias("entry_word")).distinct())
    words = cut(people.select("name", F.explode(F.expr("filter(tokens, (t, i) -> not (short[i] and length(t) < 3))")).alias("word")).distinct())
    near = near_words(words.select("word").distinct(), entry_words.select("entry_word").distinct(), shard_rows=shard_rows)
    met = words.join(near, "word").join(entry_words, "entry_word").select("name", "entry").distinct()
    given = listed.where("surname > 0").select(F.explode(F.expr("filter(slice(tokens, 1, size(tokens) - surname), t -> length(t) > 2)")).alias("word")).distinct()
    known = words.join(given, "word", "left_semi").groupBy("name").agg(F.collect_set("word").alias("known"))
    rep = F.struct("kind", "tokens", "short", "surname", "gen", "cyr", "m_title")
    ready = (
        met.join(people.join(known, "name", "left").select("name", "key", "known", rep.alias("a")), "name")
        .join(size_checked(listed.select(F.col("name").alias("entry"), rep.alias("b")), 50_000), "entry")
        .repartition(4 * spark.sparkContext.defaultParallelism, "name")
    )

    def compare(batches):
        memo: dict[str, Name] = {}
        for pdf in batches:
            out = []
            for name, key, known, a, entry, b in zip(*(pdf[c] for c in ("name", "key", "known", "a", "entry", "b"))):
                e = memo.get(entry)
                if e is None:
                    if len(memo) > 50_000:
                        memo.clear()
                    e = memo[entry] = name_of(b)
                givens = {t for t in e.tokens[: len(e.tokens) - e.surname] if len(t) > 2}
                if known is not None:
                    givens.update(known)
                m = align(name_of(a), e, frozenset(givens))
                if m:
                    out.append((name, key, entry, m.cost, m.edits))
            yield pd.DataFrame(out, columns=["name", "key", "entry", "cost", "edits"])

    hits = ready.mapInPandas(compare, "name string, key string, entry string, cost double, edits int")
    wordings = names.where("kind = 'person' and not cyr").groupBy("key").agg(F.count("*").alias("wordings"))
    closest = F.struct("cost", "entry")
    best = (
        hits.join(wordings, "key", "left")
        .where("edits = 0 or coalesce(wordings, 1) < 2")
        .groupBy("name")
        .agg(F.sort_array(F.collect_list(closest)).alias("c"))  # the entries one value is like
        .where(F.expr("size(c) = 1 or c[0].cost < c[1].cost"))
        .select("name", F.col("c")[0]["entry"].alias("entry"), F.col("c")[0]["cost"].alias("cost"))
    )
    unnamed = entries.where("kind in ('anonymous', 'traditional')").groupBy("kind").agg(F.min("name").alias("other"))
    return (
        names.join(best, "name", "left")
        .join(F.broadcast(unnamed), "kind", "left")  # at most two rows
        .select(F.col("name").alias("raw_composer"), F.coalesce("entry", "other", F.lit("")).alias("composer"), "cost")
    )


def p7_found(spark: SparkSession, base: str) -> DataFrame:
    grades = table(spark, base, "dummy_advisor_grades", ["composer_normalized"])
    listed = table(spark, base, "composer_era", ["composer"])
    return map_to_list(grades.withColumnRenamed("composer_normalized", "value"), listed.withColumnRenamed("composer", "entry")).select("raw_composer", "composer")


def p7_era_counts(spark: SparkSession, base: str) -> DataFrame:
    """Rows of the corpus by the era that the mapping gives them."""
    grades = table(spark, base, "dummy_advisor_grades", ["composer_normalized"])
    eras = table(spark, base, "composer_era", ["composer", "era"])
    mapped = p7_found(spark, base).where("composer <> ''")
    return (
        grades.groupBy("composer_normalized").agg(F.count("*").alias("n"))
        .join(mapped, F.col("composer_normalized") == F.col("raw_composer"), "left")
        .join(eras, "composer", "left")
        .groupBy(F.coalesce("era", F.lit("unmapped")).alias("era")).agg(F.sum("n").alias("n_rows"))
    )
