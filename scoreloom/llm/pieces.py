"""Problem 3: the same piece in sources that share no key."""

from __future__ import annotations

import heapq
import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordering import sliding_compare
from ..plans.cut import cut, size_checked
from ..sources.tables import table
from .graph import components
from .names import Name, align, osa, parse, skeleton
from .text import delook, fold, repair

WINDOW = 12  # rows at least; see ``alike``
MEASURES = 0.16  # by how much the measures of one piece may differ
RANGE_ROWS = 40_000  # rows of a range partition, about
TEXT_MB = 8  # of spellings or labels that are broadcast: the driver holds each such table and its copies at once
# totals of the weighted similarities from which a pair may be a match: where number
# and opus or the by-names agree, where only one of number and opus does, and where
# composer and features alone speak
ACCEPT, ACCEPT_HALF, ACCEPT_BARE = 5.5, 7.5, 9.0

# ---------------------------------------------------------------- fixed values
# Names of musical forms in several languages, by the word they are filed under.
FORMS_TEXT = """
study: study studies etude etuden estudio studio studie ubung exercise ejercicio
waltz: waltz walzer valse vals valzer
march: march marche marsch marcha marcia
mazurka: mazurka masurka mazurca mazurek
lesson: lesson lecon lektion leccion lezione
prelude: prelude praludium preludio preludium preludes
minuet: minuet menuett menuet minueto minuetto minue
romance: romance romanze romanza
nocturne: nocturne notturno nocturno nachtstuck
barcarolle: barcarolle barcarola barkarole
variations: variations variationen variaciones variazioni variation
divertimento: divertimento divertissement divertimiento
galliard: galliard gaillarde gallarda galliarde gagliarda
pavan: pavan pavane pavana padovana
fantasia: fantasia fancy fancie fantasie fantaisie fantasy phantasie
rondo: rondo rondeau
sonatina: sonatina sonatine
landler: landler laendler
capriccio: capriccio caprice capricho caprichio
andante: andante andantino
lullaby: lullaby wiegenlied berceuse nana
sonata: sonata sonate
gavotte: gavotte gavota gavotta
bourree: bourree bourre
tarantella: tarantella tarantelle
polonaise: polonaise polonesa
allegro: allegro allegretto
"""
KEY_WORDS = frozenset("major minor maj min dur moll mayor menor majeur mineur maggiore minore sharp flat sostenido bemol diese is es do re mi fa sol la si ut cis des dis fis ges gis as ais bes in en em a b c d e f g h am bm cm dm em fm gm hm gr".split())
NOTE_WORDS = frozenset("solo score mxl xml musicxml pdf mid for two guitar guitars guitarra guitare gitarre arr transcr ed op opus oeuvre opp no nr num numero n und and y et of the at der die das le les el los de du des von aus a an on song memories lied".split())
# ---------------------------------------------------------------- end of fixed values
FORMS = {w: line.split(":")[0] for line in FORMS_TEXT.strip().split("\n") for w in line.split(":")[1].split()}
_DELETED: dict[str, set[str]] = {}
for _w in FORMS:
    if len(_w) >= 5:
        for _k in (_w, *(_w[:i] + _w[i + 1 :] for i in range(len(_w)))):
            _DELETED.setdefault(_k, set()).add(_w)
FORM_ID = {f: i for i, f in enumerate(sorted(set(FORMS.values())))}

_OPUS = re.compile(r"\b(?:opu*s|op{1,2}|oeuvre|ouevre|opsu|ous|opuss|opu)\b\s*[.:]?\s*(\d{1,6})\b|\bo(\d{1,3})\b|\bop(\d{1,3})\b")
_NUMBER = re.compile(r"(?:\bno|\bnr|\bnum|\bnumero|\bnumber|\bn|#)\s*[.:]?\s*[°º]?\s*(\d{1,6})\b|\bno(\d{1,3})\b|\bnr(\d{1,3})\b|\bn(\d{1,3})\b")


@lru_cache(30_000)
def form_of(word: str) -> str | None:
    """The form a word names, one letter wrong allowed in words of five or more."""
    f = FORMS.get(word)
    if f is None and len(word) >= 5:
        maybe = {w for k in (word, *(word[:i] + word[i + 1 :] for i in range(len(word)))) for w in _DELETED.get(k, ())}
        near = {FORMS[w] for w in maybe if osa(word, w, 1) <= 1}
        f = near.pop() if len(near) == 1 else None
    return f


_SUFFIX = re.compile(r"\.(?:mxl|xml|musicxml|pdf|mid)\b")
_DEGREE = re.compile(r"n\s*[°º]")
_WORDS = re.compile(r"[a-z]+(?:['’][a-z]+)?|\d+")
_NO_NAME = KEY_WORDS | NOTE_WORDS


@lru_cache(40_000)
def _word(w: str) -> str | None:
    """None: of no interest; else the form it names after ":" or the word itself."""
    if w in _NO_NAME or len(w) < 3:
        return None
    f = form_of(w)
    return ":" + f if f else w


def parse_title(title: str | None) -> tuple[str | None, int, int, str]:
    """(form, number, opus, by-name words sorted, longest first); -1: not given."""
    if not title:
        return None, -1, -1, ""
    s = title.lower() if title.isascii() and "&" not in title and "\\" not in title else fold(delook(repair(title)))
    s = s.replace("_", " ")
    if "." in s:
        s = _SUFFIX.sub(" ", s)
    if "°" in s or "º" in s:
        s = _DEGREE.sub("no ", s)
    opus = number = -1
    if any("0" <= c <= "9" for c in s):
        m = _OPUS.search(s)
        if m:
            opus = int(m.group(m.lastindex))
            s = s[: m.start()] + " " + s[m.end() :]
        m = _NUMBER.search(s)
        if m:
            number = int(m.group(m.lastindex))
            s = s[: m.start()] + " " + s[m.end() :]
    form, rest = None, []
    for w in _WORDS.findall(s):
        if w.isdigit():
            if number < 0 and len(w) <= 3:
                number = int(w)
            continue
        f = _word(w)
        if f is None:
            continue
        if f[0] == ":":
            form = form or f[1:]
        else:
            rest.append(f)
    if len(rest) > 1:
        rest = sorted(dict.fromkeys(rest), key=lambda w: (-len(w), w))
    return form, number, opus, " ".join(rest)


@lru_cache(30_000)
def byname_likeness(a: str, b: str) -> float:
    """Share of the shorter by-name's letters whose words have a partner within one
    edit in the other."""
    x, y = a.split(), b.split()
    if sum(map(len, x)) > sum(map(len, y)):
        x, y = y, x
    total = sum(map(len, x))
    if not total:
        return 0.0
    left, hit = list(y), 0
    for w in x:
        for v in left:
            if w == v or len(w) > 3 and osa(w.rstrip("s"), v.rstrip("s"), 2 if len(w) > 8 else 1) <= (2 if len(w) > 8 else 1):
                left.remove(v)
                hit += len(w)
                break
    return hit / total


KIND = {"nobody": 0, "anonymous": 1, "traditional": 2, "person": 3}


def described(grades: DataFrame, features: DataFrame) -> DataFrame:
    """One row per candidate_id: the latest title and composer as parsed, and the
    medians (over loads) of what the features say; missing numbers are null. A column
    ``dummy_grade`` is kept."""
    extra = [c for c in ("dummy_grade",) if c in grades.columns]
    latest = (
        grades.where("candidate_id is not null")
        .groupBy("candidate_id")
        .agg(F.max_by(F.struct("source", "title", "composer_normalized", *extra), F.struct("graded_at", "title", "composer_normalized", *extra)).alias("r"))
        .select("candidate_id", F.lower(F.trim("r.source")).alias("source"), "r.title", F.col("r.composer_normalized").alias("composer"), *[f"r.{c}" for c in extra])
    )
    numbers = ["midi_min", "midi_max", "measure_count", "note_count", "tempo_bpm"]  # not positive means missing
    number = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None))
    values = {
        "fifths": F.expr("case when regexp_like(key_fifths, '^[+]?-?[0-7]$') then try_cast(key_fifths as int) end"),
        "time": F.expr("case when time_sig = 'C' then 404 when regexp_like(time_sig, '^[0-9]+[/-][0-9]+$') then 100 * try_cast(regexp_extract(time_sig, '^([0-9]+)', 1) as int) + try_cast(regexp_extract(time_sig, '([0-9]+)$', 1) as int) end"),
        **{c: F.when(number(c) > 0, number(c)) for c in numbers},
    }
    # the lower middle of each column, from counts of its values: no list of a piece's rows
    rows = features.where("candidate_id is not null").select("candidate_id", *[v.cast("double").alias(c) for c, v in values.items()])
    about = rows.groupBy("candidate_id").agg(*[F.expr(f"percentile_disc(0.5) within group (order by {c})").cast("double").alias(c) for c in values])

    def titles(batches):
        memo: dict = {}
        for pdf in batches:
            out = []
            for t in pdf["title"]:
                got = memo.get(t)
                if got is None:
                    form, number, opus, byname = parse_title(t)
                    got = (FORM_ID.get(form, -1), number, opus, byname)
                    if len(memo) < 20_000:
                        memo[t] = got
                out.append(got)
            pdf[["form", "number", "opus", "byname"]] = pd.DataFrame(out, index=pdf.index, columns=["form", "number", "opus", "byname"])
            yield pdf[["candidate_id", "source", "composer", *extra, "form", "number", "opus", "byname"]]

    def people(batches):
        for pdf in batches:
            out = []
            for s in pdf["composer"]:
                p = parse(s)
                who = ""
                if p.kind == "person":
                    sur = p.tokens[len(p.tokens) - p.surname :] if p.surname else [max((t for t, x in zip(p.tokens, p.short) if not x), key=len)]
                    who = "".join(skeleton(t) for t in sur) + str(p.gen)
                out.append((KIND[p.kind], who))
            yield pd.DataFrame({"composer": pdf["composer"], "kind": [k for k, _ in out], "who": [w for _, w in out]})

    parsed = latest.mapInPandas(titles, "candidate_id string, source string, composer string, " + "".join(f"{c} int, " for c in extra) + "form int, number int, opus int, byname string")
    # of all deliveries, which needs no second look for the latest
    spelled = cut(grades.where("composer_normalized is not null").select(F.col("composer_normalized").alias("composer")).distinct())
    names = cut(spelled.mapInPandas(people, "composer string, kind int, who string"))
    return (
        parsed.join(size_checked(names, 200_000, TEXT_MB), "composer", "left")
        .fillna({"kind": 0, "who": ""})
        .join(about, "candidate_id", "left")
    )


_NAMES: dict[str, Name] = {}


def _name(s: str) -> Name:
    n = _NAMES.get(s)
    if n is None:
        if len(_NAMES) > 20_000:
            _NAMES.clear()
        n = _NAMES[s] = parse(s)
    return n


@lru_cache(40_000)
def same_person(a: str, b: str) -> bool:
    x, y = _name(a), _name(b)
    if x.key == y.key or align(x, y) is not None or align(y, x) is not None:
        return True
    # two misspellings of one name may be two edits apart
    n, m = x.surname, y.surname
    if not (n and n == m and x.gen == y.gen and x.tokens[-n:] == y.tokens[-m:]) or len(x.tokens) == n or len(y.tokens) == m:
        return False
    g, h = x.tokens[0], y.tokens[0]
    return min(len(g), len(h)) > 3 and g[0] == h[0] and osa(g, h, 2) <= 2


def alike(pdf: pd.DataFrame, order: list[str]) -> np.ndarray:
    """For each row how many of the next have the same key up to the measures, and
    measures within ``MEASURES``: where rows are dense, the window is that much wider.
    Missing values are alike."""
    m = pdf["measure_count"].fillna(-1.0).to_numpy(float)
    new = np.zeros(len(m), bool)
    for c in order[: order.index("measure_count")]:
        v = pdf[c]
        v = v.to_numpy() if v.dtype == object else v.fillna(-99.0).to_numpy(float)
        new[1:] |= v[1:] != v[:-1]
    start = np.flatnonzero(np.concatenate([[True], new[1:]])) if len(m) else np.zeros(0, np.int64)
    out = np.zeros(len(m), np.int64)
    for a, b in zip(start, [*start[1:], len(m)]):
        if b - a > 1:
            out[a:b] = a + np.searchsorted(m[a:b], np.where(m[a:b] > 0, m[a:b] / (1 - MEASURES), m[a:b]), "right") - 1 - np.arange(a, b)
    return out


def neighbours(pdf: pd.DataFrame, a_to: int, b_from: int, reach: np.ndarray | None = None) -> pd.DataFrame:
    """Compares rows with those after them in the window (see ``sliding_compare``).
    First all the numbers at once by shifted arrays; names and by-names only for pairs
    that the numbers leave possible."""
    n = len(pdf)
    out = []
    col = {c: pdf[c].to_numpy() for c in ("kind", "form", "number", "opus")}
    num = {c: pdf[c].to_numpy(float) for c in ("fifths", "time", "midi_min", "midi_max", "measure_count", "note_count", "tempo_bpm")}
    source = pd.factorize(pdf["source"])[0]
    row, composer, byname = (pdf[c].to_numpy() for c in ("id", "composer", "byname"))
    has = np.array([bool(b) for b in byname], bool)
    for k in range(1, min(n, WINDOW if reach is None else max(WINDOW, int(reach.max(initial=0)) + 1))):
        if k < WINDOW:
            a, b, first = slice(0, n - k), slice(k, n), np.arange(n - k)
        else:
            first = np.flatnonzero(reach >= k)
            first = first[(first < a_to) & (first + k >= b_from)]
            a, b = first, first + k

        def off(c, a=a, b=b):
            return np.abs(num[c][a] - num[c][b])

        def part(c, a=a, b=b):
            return off(c) / np.maximum(num[c][a], num[c][b])

        def grade(d, near, plus, far, minus, out_of=None, worse=None):
            """plus within near, minus beyond far, between them nothing; nothing where
            a value is missing."""
            with np.errstate(invalid="ignore"):
                g = np.where(d <= near, plus, np.where(d > far, minus, 0.0))
                if out_of is not None:
                    g = np.where(d > out_of, worse, g)
            return np.where(np.isnan(d), 0.0, g)

        with np.errstate(invalid="ignore", divide="ignore"):
            like = (
                grade(off("fifths"), 0, 1.0, 0, -2.0)
                + grade(off("time"), 0, 0.7, 0, -1.5)
                + grade(off("midi_min"), 1, 1.0, 2, -2.0, 4, -4.0)
                + grade(off("midi_max"), 2, 0.5, 3, -0.7)
                + grade(part("measure_count"), 0.06, 1.2, 0.08, -1.5, 0.16, -4.0)
                + grade(part("note_count"), 0.14, 1.0, 0.2, -1.5, 0.35, -4.0)
                + grade(part("tempo_bpm"), 0.04, 1.5, 0.08, -0.5)
            )
        ka, kb = col["kind"][a], col["kind"][b]
        named = (ka > 0) & (kb > 0)
        ok = (first < a_to) & (first + k >= b_from) & (source[a] != source[b]) & ~(named & (ka != kb))
        ng, no = (col["number"][a] >= 0) & (col["number"][b] >= 0), (col["opus"][a] >= 0) & (col["opus"][b] >= 0)
        same_n, same_o = ng & (col["number"][a] == col["number"][b]), no & (col["opus"][a] == col["opus"][b])
        ok &= ~(ng & ~same_n) & ~(no & ~same_o)
        fg = (col["form"][a] >= 0) & (col["form"][b] >= 0)
        same_f = fg & (col["form"][a] == col["form"][b])
        title = 1.5 * same_o + np.where(same_n, np.where(same_o, 2.0, 1.0), 0.0) + np.where(same_f, 1.0, np.where(fg, -2.0, 0.0))
        both = has[a] & has[b]
        best = like + title + 3.0 * named + 3.0 * both
        need = np.where(both | same_n & same_o, ACCEPT, np.where(same_n | same_o, ACCEPT_HALF, ACCEPT_BARE))
        for at in np.flatnonzero(ok & (best >= need) & (like > 0)):
            i = first[at]
            j = i + k
            total, least = like[at] + title[at], need[at]
            if both[at]:
                near = byname_likeness(byname[i], byname[j])
                total += 3.0 if near >= 0.65 else -3.0
                if near < 0.65 and not (same_n[at] and same_o[at]):
                    least = ACCEPT_HALF if same_n[at] or same_o[at] else ACCEPT_BARE
            if named[at]:
                if ka[at] == 3:
                    if not same_person(composer[i], composer[j]):
                        continue
                    total += 3.0
                else:
                    total += 1.5
            if total >= least:
                out.append((*sorted((int(row[i]), int(row[j]))), float(total)))
    return pd.DataFrame(out, columns=["a", "b", "total"])


def best_assignment(edges: dict[int, dict[int, float]]) -> dict[int, int]:
    """The partner of each left node that has one in a one-to-one assignment of greatest
    total gain; ``edges``: for each left node the gains of its right nodes, all positive.

    Shortest augmenting paths over reduced costs, from each left node to the nearest free
    right node or to being left alone. Only the edges there are are held, so memory grows
    with them and not with the product of the sides; a search ends at its first goal."""
    partner: dict[int, int] = {}  # of right nodes
    chosen: dict[int, int] = {}
    pot_l = {i: max(gains.values()) for i, gains in edges.items()}  # reduced cost: pot_l + pot_r - gain >= 0
    pot_r: dict[int, float] = {}
    for root in sorted(edges):
        dist, before = {root: 0.0}, {}
        heap: list[tuple[float, int, int]] = [(0.0, 0, root)]  # distance, side, node
        dist_r: dict[int, float] = {}
        done_l: set[int] = set()
        goal, total = None, np.inf
        while heap:
            d, side, k = heapq.heappop(heap)
            if d >= total:
                break
            if side == 0:
                if k in done_l:
                    continue
                done_l.add(k)
                if d + pot_l[k] < total:  # this one stays alone
                    goal, total = (0, k), d + pot_l[k]
                for j, g in edges[k].items():
                    nd = d + pot_l[k] + pot_r.get(j, 0.0) - g
                    if nd < dist_r.get(j, np.inf) - 1e-12:
                        dist_r[j], before[j] = nd, k
                        heapq.heappush(heap, (nd, 1, j))
            elif d <= dist_r[k]:
                if k not in partner:
                    if d + pot_r.get(k, 0.0) < total:
                        goal, total = (1, k), d + pot_r.get(k, 0.0)
                elif d < dist.get(partner[k], np.inf):
                    dist[partner[k]] = d
                    heapq.heappush(heap, (d, 0, partner[k]))
        for i in done_l:
            pot_l[i] -= max(0.0, total - dist[i])
        for j, d in dist_r.items():
            if d < total:
                pot_r[j] = pot_r.get(j, 0.0) + total - d
        side, k = goal
        if side == 0 and k == root:
            continue
        # turn the path round
        j = k if side == 1 else chosen.pop(k)
        while True:
            i = before[j]
            last = chosen.get(i)
            partner[j], chosen[i] = i, j
            if i == root:
                break
            j = last
    return chosen


def assign(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of the pairs of one component of two sources the one-to-one set of the greatest
    total confidence."""
    pdf = pdf.sort_values(["a", "b"], kind="stable")
    li, ri = ({c: i for i, c in enumerate(sorted(set(pdf[k])))} for k in ("x", "y"))
    edges: dict[int, dict[int, float]] = {}
    for x, y, t in zip(pdf["x"], pdf["y"], pdf["total"]):
        if t > 0:
            gains = edges.setdefault(li[x], {})
            gains[ri[y]] = max(gains.get(ri[y], 0.0), t)
    chosen = best_assignment(edges)
    return pdf[[chosen.get(li[x]) == ri[y] for x, y in zip(pdf["x"], pdf["y"])]]


def one_to_one(pairs: DataFrame) -> DataFrame:
    """For each two sources the assignment that maximises total confidence. Pairs whose
    ends have no other pair there are taken at once; the rest is cut into connected
    components, and each is solved exactly, in memory that grows with its pairs."""
    first = F.col("sa") < F.col("sb")
    extra = [c for c in pairs.columns if c not in ("a", "b", "sa", "sb", "total")]
    result = ["a", "b", "total", *extra]
    oriented = pairs.select(
        *result,
        F.least("sa", "sb").alias("sx"), F.greatest("sa", "sb").alias("sy"),
        F.when(first, F.col("a")).otherwise(F.col("b")).alias("x"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("y"),
    )
    side = ["sx", "sy"]
    nx = oriented.groupBy(*side, "x").agg(F.count("*").alias("nx"))
    ny = oriented.groupBy(*side, "y").agg(F.count("*").alias("ny"))
    counted = cut(oriented.join(nx, [*side, "x"]).join(ny, [*side, "y"]))
    alone = counted.where("nx = 1 and ny = 1").select(*result)
    node = lambda mark, c: F.concat_ws("\x01", "sx", "sy", F.lit(mark), c)
    rest = cut(counted.where("nx > 1 or ny > 1").select(node("x", "x").alias("nodex"), node("y", "y").alias("nodey"), "x", "y", *result))
    if rest.isEmpty():
        return alone
    labels = components(rest.select(F.col("nodex").alias("a"), F.col("nodey").alias("b"))).withColumnRenamed("node", "nodex")
    solved = rest.join(labels, "nodex").groupBy("component").applyInPandas(lambda pdf: assign(pdf)[result], "a string, b string, total double" + "".join(f", {c} string" for c in extra))
    return alone.unionByName(solved)


def matches(grades: DataFrame, features: DataFrame) -> DataFrame:
    """(candidate_a, candidate_b, confidence): pieces of different sources that are the
    same, at most one partner per piece and other source.

    Sorted neighbourhood: the pieces are sorted by several composite keys (number and
    key; by-name; composer and form; composer and features; composer and number or
    opus), and within a sliding window of each order, as wide as equal keys with like
    measures go on, compared by weighted similarities of title, composer and
    features. A number or opus that differs, or another person, rules a pair out.
    Null in any field is no evidence either way; rows without candidate_id are left
    out; repeated rows count once; an empty table has no matches. The windows run over
    range partitions, so one composer may hold any share of the rows.
    """
    return matches_of(cut(described(grades, features))).drop("composer_a", "composer_b")


def matches_of(rows: DataFrame) -> DataFrame:
    """``matches`` for what ``described`` gives, with the composers as spelled."""
    # a number for each piece, so that neither the orders nor the pairs carry its texts
    keyed = rows.withColumn("id", F.monotonically_increasing_id())
    features = ["fifths", "time", "midi_min", "midi_max", "measure_count", "note_count", "tempo_bpm"]
    named = ["kind", "who"]
    orders = [
        ("opus >= 0 and number >= 0", ["opus", "number", "fifths", "time", "measure_count", "note_count", "id"]),
        ("byname <> ''", ["byname", "fifths", "measure_count", "id"]),
        ("kind > 0", [*named, "form", "fifths", "time", "measure_count", "note_count", "id"]),
        ("kind > 0", [*named, "fifths", "time", "midi_min", "measure_count", "note_count", "id"]),
        # without the key, which may be wrong or missing on one side
        ("kind > 0 and number >= 0", [*named, "number", "measure_count", "note_count", "id"]),
        ("kind > 0 and opus >= 0", [*named, "opus", "measure_count", "note_count", "id"]),
    ]
    keep = ["id", "source", "composer", "kind", "form", "number", "opus", "byname", *features]
    # ranges of each order by the rows that it has
    held = rows.agg(*[F.count_if(F.expr(which)).alias(f"n{k}") for k, (which, _) in enumerate(orders)]).first()
    parts = [max(2, min(20_000, -(-n // RANGE_ROWS))) for n in held]
    found = sliding_compare([(keyed.where(which).select(*dict.fromkeys([*keep, *order])), order) for which, order in orders], WINDOW, neighbours, "a long, b long, total double", parts, reach=alike)
    best = found.groupBy("a", "b").agg(F.max("total").alias("total"))
    for end in "ab":
        best = best.join(keyed.select(F.col("id").alias(end), F.struct(F.col("candidate_id").alias("i"), F.col("source").alias("s"), F.col("composer").alias("c")).alias(f"_{end}")), end)
    first, second = F.least("_a", "_b"), F.greatest("_a", "_b")  # by candidate_id
    pairs = cut(best.select(first.alias("x"), second.alias("y"), "total").select(F.col("x.i").alias("a"), F.col("y.i").alias("b"), F.col("x.s").alias("sa"), F.col("y.s").alias("sb"), F.col("x.c").alias("ca"), F.col("y.c").alias("cb"), "total"))
    return one_to_one(pairs).select(F.col("a").alias("candidate_a"), F.col("b").alias("candidate_b"), F.col("ca").alias("composer_a"), F.col("cb").alias("composer_b"), F.round(1 / (1 + F.exp(-(F.col("total") - ACCEPT))), 4).alias("confidence"))


def _tables(spark, base):
    grades = table(spark, base, "dummy_advisor_grades", ["candidate_id", "source", "title", "composer_normalized", "graded_at"])
    features = table(spark, base, "features", ["candidate_id", "key_fifths", "time_sig", "midi_min", "midi_max", "measure_count", "note_count", "tempo_bpm"])
    return grades, features


def p3_found(spark: SparkSession, base: str) -> DataFrame:
    return matches(*_tables(spark, base)).select("candidate_a", "candidate_b")


def p3_matches(spark: SparkSession, base: str) -> DataFrame:
    """The same with each match's confidence."""
    return matches(*_tables(spark, base))
