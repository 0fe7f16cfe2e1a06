"""Problem 9: passages of evaluation texts inside training text."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.cut import cut, size_checked, spread
from ..sources.tables import table
from .text import letters, repair

GRAM = 10  # letters of a seed
RARE = 4  # passages that may share a seed
OWN_ITEMS = 2  # passages that may share a word peculiar to them
OWN_LETTERS = 5  # letters of a seed that belong to such words
LEAST_OWN, LEAST_SEEDS = 3, 20  # a passage with fewer takes the words and seeds that the fewest others share
SEEDS = 2  # seeds that bring a document and a passage to alignment
ANCHOR = 6  # letters of a run from which a seeded pair is aligned: the least stretch has three unaltered words in a row
ANCHORED = 12  # letters that such runs of the least stretch have together
NEAR, SHIFT = 150, 60  # letters between runs of one stretch, and by how much altered words may shift them
DROP = 100  # by how much an alignment's score may fall before it is given up
PIECE = 2_000  # letters of a passage, and five times as many of a document, that are aligned at once
OVERLAP = 600  # letters that neighbouring pieces share
SIEVE_BITS = (20, 27)  # least and greatest size of the sieve of seeds, as a power of two
LEAST_WORDS = 10  # of a stretch
AGREE = 0.75  # share of a stretch's words that are unaltered
SLACK = 0.03  # by which a pair may fall short of that before it is not even aligned
SHARE = 1 / 3  # of the passage's words that the stretches make up
OWN = 0.4  # share of a stretch's words peculiar to the passage that are unaltered
_BASE = np.uint64(0x9E3779B97F4A7C15)
_PROBES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


@dataclass
class Item:
    """A passage. codes: its letters, without spaces; word: for each letter its word's
    number; own: for each word whether few passages have it; sizes: letters of each word."""

    codes: np.ndarray
    word: np.ndarray
    own: np.ndarray
    sizes: np.ndarray

    @property
    def n_words(self) -> int:
        return len(self.sizes)


def item_of(words: list[str], own: set[str]) -> Item:
    sizes = np.array([len(w) for w in words])
    return Item(codes("".join(words)), np.repeat(np.arange(len(words)), sizes), np.array([w in own for w in words], bool), sizes)


def codes(s: str | bytes) -> np.ndarray:
    return np.frombuffer(s.encode("ascii") if isinstance(s, str) else s, np.uint8)


def hashes(c: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A hash of the ``gram`` letters from each place on."""
    n = len(c) - gram + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(gram):
            h = h * _BASE + c[k : k + n]
        return h ^ (h >> np.uint64(29))


def words_of(passage: str) -> list[str]:
    return [w for w in (letters(x).decode() for x in re.split(r"[\s\-–—/]+", repair(passage))) if w]


def own_grams(item: Item) -> np.ndarray:
    """Hashes of the letter n-grams that lie in or at words which few passages have
    (names, places, numbers). Turns of phrase give no seeds."""
    if len(item.codes) < GRAM:
        return np.zeros(0, np.uint64)
    near = np.convolve(item.own[item.word], np.ones(GRAM, int), "valid") >= OWN_LETTERS
    return np.unique(hashes(item.codes)[near])


def probes(h: np.ndarray, power: int) -> Iterator[np.ndarray]:
    """Three bits of a sieve of 2^power for each hash."""
    with np.errstate(over="ignore"):
        for m in _PROBES:
            yield (h * m) >> np.uint64(64 - power)


def sifted(c: np.ndarray, sieve: np.ndarray, power: int, chunk: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """(place, hash) of the letters' n-grams whose bits the sieve all has: every seed,
    and a few others by chance."""
    places, found = [], []
    for at in range(0, max(1, len(c) - GRAM + 1), chunk):
        h = hashes(c[at : at + chunk + GRAM - 1])
        k = np.arange(len(h))
        for bit in probes(h, power):
            ok = (sieve[(bit[k] >> np.uint64(3)).astype(np.int64)] >> (bit[k] & np.uint64(7)).astype(np.uint8)) & 1 == 1
            k = k[ok]
        places.append(k + at)
        found.append(h[k])
    return np.concatenate(places), np.concatenate(found)


def possible(item: Item, doc: np.ndarray) -> float:
    """No less than the share of the passage's words that stretches can make up. A word
    is at best unaltered if its letters stand in the document in runs of ``ANCHOR``
    letters of the passage, or if it is too short for one: between two altered words,
    fewer letters than that in a row."""
    grams, which = np.unique(hashes(item.codes, ANCHOR), return_inverse=True)
    met = np.zeros(len(grams), bool)
    if len(grams):
        of_doc = hashes(doc, ANCHOR)
        at = np.searchsorted(grams, of_doc)
        at[at == len(grams)] = 0
        met[at[grams[at] == of_doc]] = True
    known = met[which]
    if not known.any():
        return 0.0
    covered = np.convolve(known, np.ones(ANCHOR, int)) > 0
    good = np.bincount(item.word[covered], minlength=item.n_words) == item.sizes
    whole, run = good.copy(), 0
    for k in range(1, len(good) - 1):
        if whole[k] or whole[k - 1] or whole[k + 1] or run + item.sizes[k] >= ANCHOR:
            run = 0
        else:
            good[k] = True
            run += item.sizes[k]
    taken = np.zeros(item.n_words, bool)
    for _ in stretches(good, taken, AGREE - SLACK):
        pass
    return taken.sum() / item.n_words


def by_letter(p: np.ndarray, w: np.ndarray, match: int, mismatch: int) -> dict[int, np.ndarray]:
    """For each letter of ``p`` what it scores against the letters of ``w``."""
    return {int(c): np.where(w == c, match, mismatch).astype(np.int16) for c in np.unique(p)}


def smith_waterman(p: np.ndarray, w: np.ndarray, match: int = 2, mismatch: int = 2, gap: int = 1) -> tuple[int, np.ndarray, int, int]:
    """The best local alignment of ``p`` and ``w``: its score, for each letter of
    ``p`` the place in ``w`` of the equal letter it is set against (-1: none), and
    the range of ``p`` it covers. A row is filled at once: of the scores plus what as
    many gaps cost, gaps along the row are a running maximum."""
    n, m = len(p), len(w)
    slope = (gap * np.arange(m + 1)).astype(np.int16)
    G = np.empty((n + 1, m + 1), np.int16)  # pieces are short enough for that
    G[0] = slope
    G[:, 0] = 0
    scores = by_letter(p, w, match + gap, gap - mismatch)
    floor, other, step = slope[1:], np.empty(m, np.int16), np.int16(gap)
    for i in range(1, n + 1):
        up, row = G[i - 1], G[i, 1:]
        np.add(up[:-1], scores[int(p[i - 1])], out=row)
        np.subtract(up[1:], step, out=other)
        np.maximum(row, other, out=row)
        np.maximum(row, floor, out=row)
        np.maximum.accumulate(row, out=row)
    H = np.subtract(G, slope, out=G)
    i, j = divmod(int(H.argmax()), m + 1)
    best, set_to, end = int(H[i, j]), np.full(n, -1), i
    while i and j and H[i, j] > 0:
        h = H[i, j]
        if p[i - 1] == w[j - 1] and h == H[i - 1, j - 1] + match:
            set_to[i - 1] = j - 1
            i, j = i - 1, j - 1
        elif h == H[i - 1, j] - gap:
            i -= 1
        elif h == H[i, j - 1] - gap:
            j -= 1
        else:
            i, j = i - 1, j - 1
    return best, set_to, i, end


def stretches(good: np.ndarray, taken: np.ndarray, agree: float = AGREE) -> Iterator[tuple[int, int]]:
    """Longest ranges of words, not ``taken``, that begin and end with a good word
    and have the share ``agree`` of good ones at least, ``LEAST_WORDS`` words or more;
    of equally long ones the first. Those given are taken from then on."""
    n = len(good)
    over = np.concatenate([[0], np.cumsum(good)]) - agree * np.arange(n + 1)
    while (good & ~taken).sum() >= agree * LEAST_WORDS:
        crossed = np.concatenate([[0], np.cumsum(taken)])
        starts = np.flatnonzero(good & ~taken)
        best, at = 0, 0
        for part in np.split(starts, range(256, len(starts), 256)):
            ends = starts + 1
            ok = (over[ends][None, :] >= over[part][:, None] - 1e-9) & (crossed[ends][None, :] == crossed[part][:, None])
            size = np.where(ok, ends[None, :] - part[:, None], 0)
            k = int(size.argmax())
            if size.flat[k] > best:
                best, at = int(size.flat[k]), int(part[k // len(ends)])
        if best < LEAST_WORDS:
            return
        taken[at : at + best] = True
        yield at, at + best


def runs(p: np.ndarray, w: np.ndarray, free_p: np.ndarray, free_w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in ``p``, place in ``w``, letters) of the longest runs of ``ANCHOR`` or
    more equal letters, all of them free, in the order of ``w``."""
    a, b = hashes(p, ANCHOR), hashes(w, ANCHOR)
    ok_a = np.flatnonzero(np.convolve(~free_p, np.ones(ANCHOR, int), "valid") == 0) if len(a) else np.zeros(0, np.int64)
    ok_b = np.flatnonzero(np.convolve(~free_w, np.ones(ANCHOR, int), "valid") == 0) if len(b) else np.zeros(0, np.int64)
    ok_a = ok_a[np.argsort(a[ok_a], kind="stable")]
    lo, hi = (np.searchsorted(a[ok_a], b[ok_b], side) for side in ("left", "right"))
    n = hi - lo
    x = np.repeat(ok_b, n)
    i = ok_a[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())]
    order = np.lexsort((x, x - i))
    i, x = i[order], x[order]
    start = np.flatnonzero(np.concatenate([[True], (np.diff(x) != 1) | (np.diff(i) != 1)])) if len(i) else np.zeros(0, np.int64)
    length = np.diff(np.append(start, len(i))) + ANCHOR - 1
    order = np.argsort(x[start], kind="stable")
    return i[start][order], x[start][order], length[order]


def extend(p: np.ndarray, w: np.ndarray, match: int = 2, mismatch: int = 2, gap: int = 1) -> list[tuple[int, int]]:
    """The equal letters (place in ``p``, place in ``w``) of the best alignment that
    begins at the first letters of both and ends anywhere within a piece."""
    p = p[:PIECE]
    w = w[: 2 * len(p) + DROP]
    m = len(w)
    slope = (gap * np.arange(m + 1)).astype(np.int16)
    scores = by_letter(p, w, match + gap, gap - mismatch)
    rows, best, end, step = [-slope], 0, (0, 0), np.int16(gap)
    up, other = np.zeros(m + 1, np.int16), np.empty(m, np.int16)
    for i in range(1, len(p) + 1):
        row = np.empty(m + 1, np.int16)
        row[0] = -gap * i
        np.add(up[:-1], scores[int(p[i - 1])], out=row[1:])
        np.subtract(up[1:], step, out=other)
        np.maximum(row[1:], other, out=row[1:])
        np.maximum.accumulate(row, out=row)
        up = row
        row = row - slope
        rows.append(row)
        j = int(row.argmax())
        if row[j] > best:
            best, end = int(row[j]), (i, j)
        elif row[j] < best - DROP:
            break
    (i, j), out = end, []
    while i and j:
        h = rows[i][j]
        if p[i - 1] == w[j - 1] and h == rows[i - 1][j - 1] + match:
            i, j = i - 1, j - 1
            out.append((i, j))
        elif h == rows[i - 1][j] - gap:
            i -= 1
        elif h == rows[i][j - 1] - gap:
            j -= 1
        else:
            i, j = i - 1, j - 1
    return out


def rest(item: Item, doc: np.ndarray, free: np.ndarray, taken: np.ndarray, kept: np.ndarray) -> None:
    """Adds to ``taken`` and ``kept`` every further stretch anywhere in the document,
    however low it scores: from each run of equal letters both sides are aligned
    outwards. Letters not ``free`` belong to stretches found before. Since chance and
    turns of phrase reach as low, a stretch that has words peculiar to the item but
    keeps less than ``OWN`` of them is none."""
    inner = np.concatenate([[False], item.word[1:] == item.word[:-1]])
    found = True
    while found and (~taken).sum() >= LEAST_WORDS:
        found = False
        free_p = ~taken[item.word]
        p, w = np.where(free_p, item.codes, 255).astype(np.int16), np.where(free, doc, -1).astype(np.int16)
        i, x, length = runs(item.codes, doc, free_p, free)
        seen: set[tuple[int, int]] = set()
        for k in range(len(i)):
            lo, hi = np.searchsorted(x, [x[k] - NEAR - SHIFT, x[k] + NEAR + SHIFT + 1])
            near = (np.abs(i[lo:hi] - i[k]) <= NEAR) & (np.abs(x[lo:hi] - i[lo:hi] - x[k] + i[k]) <= SHIFT)
            if length[lo:hi][near].sum() < ANCHORED or (int(i[k]), int(x[k])) in seen:
                continue
            set_to = np.full(len(p), -1)
            for a, b in extend(p[i[k] :], w[x[k] :]):
                set_to[i[k] + a] = x[k] + b
            for a, b in extend(p[: i[k]][::-1], w[: x[k]][::-1]):
                set_to[i[k] - 1 - a] = x[k] - 1 - b
            seen.update((int(a), int(set_to[a])) for a in np.flatnonzero(set_to >= 0))
            # a word counts if its letters stand side by side
            whole = (set_to >= 0) & (~inner | (set_to - np.concatenate([[-1], set_to[:-1]]) == 1))
            matched = np.bincount(item.word[whole], minlength=item.n_words) == item.sizes
            new = np.zeros(item.n_words, bool)
            for a, b in stretches(matched, taken.copy()):
                own = item.own[a:b]
                if not own.any() or (matched[a:b] & own).sum() >= OWN * own.sum():
                    new[a:b] = True
            if new.any():
                taken |= new
                kept |= matched & new
                used = set_to[new[item.word]]
                free[used[used >= 0]] = False
                found = True
                break


def pieces(n: int, size: int, overlap: int) -> list[tuple[int, int]]:
    """Ranges of ``size`` that cover ``n`` places and overlap."""
    return [(at, min(n, at + size)) for at in range(0, max(1, n - overlap), size - overlap)]


def copied(item: Item, doc: np.ndarray, places: np.ndarray) -> tuple[float, float]:
    """What share of the passage's words stands in the document in stretches, and what
    share of the words peculiar to it in them is unaltered. The document is first
    looked at where the seeds' places let expect the passage; after each alignment what it covered is blanked
    on both sides and the rest aligned again. Short stretches, which score no more than
    chance does, and those far from any seed are found by ``rest``. Long passages and
    windows are aligned in overlapping pieces, so memory is bounded."""
    if item.n_words < LEAST_WORDS:
        return 0.0, 0.0
    if item.codes.tobytes() in doc.tobytes():
        return 1.0, float(item.own.any())
    if possible(item, doc) < SHARE - 0.02:
        return 0.0, 0.0
    taken = np.zeros(item.n_words, bool)
    kept = np.zeros(item.n_words, bool)
    free = np.ones(len(doc), bool)
    # where in the passage each place's n-gram stands, so where in the document its ends are to be sought
    h = hashes(item.codes)
    by_hash = np.argsort(h, kind="stable")
    sought = hashes(doc)[places]
    at = np.searchsorted(h[by_hash], sought)
    at[at == len(h)] = 0
    places, offsets = places[h[by_hash[at]] == sought], by_hash[at[h[by_hash[at]] == sought]]
    for p_from, p_to in pieces(len(item.codes), PIECE, OVERLAP):
        spare = SHIFT + (p_to - p_from) // 4
        windows: list[list[int]] = []
        for x, i in zip(places, offsets):
            if not p_from - spare <= i < p_to + spare:
                continue
            lo, hi = max(0, x - (i - p_from) - spare), min(len(doc), x + (p_to - i) + spare)
            if windows and lo <= windows[-1][1]:
                windows[-1][1] = max(windows[-1][1], hi)
                windows[-1][0] = min(windows[-1][0], lo)
            else:
                windows.append([lo, hi])
        for first, last in windows:
            for lo, hi in pieces(last - first, 5 * PIECE, PIECE):
                align(item, doc, free, taken, kept, p_from, p_to, first + lo, first + hi)
    rest(item, doc, free, taken, kept)
    own = item.own & taken
    return taken.sum() / item.n_words, (kept & own).sum() / max(1, own.sum()) if own.any() else 0.0


def align(item: Item, doc: np.ndarray, free: np.ndarray, taken: np.ndarray, kept: np.ndarray, p_from: int, p_to: int, lo: int, hi: int) -> None:
    """Adds what stretches the letters ``p_from``..``p_to`` of the passage have in
    ``lo``..``hi`` of the document."""
    p = np.where(taken[item.word], 255, item.codes)[p_from:p_to].astype(np.int16)
    w = np.where(free[lo:hi], doc[lo:hi], -1).astype(np.int16)
    word = item.word[p_from:p_to]
    # every round blanks what it aligned, so this ends
    while (p != 255).any() and (w >= 0).any():
        score, set_to, _, _ = smith_waterman(p, w)
        if score < 60:  # lower ones are left to rest()
            return
        matched = np.bincount(word[set_to >= 0], minlength=item.n_words) == item.sizes
        before = taken.copy()
        for a, b in stretches(matched, taken):
            kept[a:b] |= matched[a:b]
        new = taken & ~before
        w[set_to[set_to >= 0]] = -1  # never equal to a letter again
        if new.any():
            p[taken[word]] = 255
            free[lo + set_to[(set_to >= 0) & new[word]]] = False
        else:
            p[set_to >= 0] = 255


def passages_of(items: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pid, words, own): each distinct passage with the words peculiar to it; (item_id,
    pid); and (h, pid), its seeds. Words and n-grams are counted over all passages. A
    passage of which nearly everything stands in others too takes the words and n-grams
    that the fewest share."""

    def read(batches):
        for pdf in batches:
            rows = [(i, " ".join(words_of(p))) for i, p in zip(pdf["item_id"], pdf["passage"])]
            yield pd.DataFrame([r for r in rows if r[1]], columns=["item_id", "text"])

    rows = cut(items.where("passage is not null and item_id is not null").select("item_id", "passage").mapInPandas(read, "item_id long, text string").withColumn("digest", F.md5("text")))
    distinct = cut(rows.groupBy("digest").agg(F.min("item_id").alias("pid"), F.first("text").alias("text")))
    members = rows.select("item_id", "digest").join(distinct.select("digest", "pid"), "digest").select("item_id", "pid").distinct()
    words = distinct.select("pid", F.explode(F.array_distinct(F.split("text", " "))).alias("word"))
    counts = cut(words.groupBy("word").agg(F.count("*").alias("n"), F.min("pid").alias("lo"), F.max("pid").alias("hi")))
    # of a word in at most two passages least and greatest are all
    few = counts.where(f"n <= {OWN_ITEMS}").select("word", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("pid")).groupBy("pid").agg(F.collect_set("word").alias("own"))
    known = cut(distinct.join(few, "pid", "left").select("pid", F.split("text", " ").alias("words"), F.coalesce("own", F.array().cast("array<string>")).alias("own")))
    poor = known.where(F.size("own") < LEAST_OWN)
    by_rarity = Window.partitionBy("pid").orderBy("n", "word")  # the words of one passage
    ranked = poor.select("pid", F.explode(F.array_distinct("words")).alias("word")).join(size_checked(counts.select("word", "n"), 500_000), "word").withColumn("r", F.row_number().over(by_rarity))
    limit = ranked.where(f"r <= {LEAST_OWN}").groupBy("pid").agg(F.max("n").alias("most"))
    taken = ranked.join(limit, "pid").where("n <= most").groupBy("pid").agg(F.collect_set("word").alias("own"))
    known = cut(known.where(F.size("own") >= LEAST_OWN).unionByName(poor.drop("own").join(taken, "pid").select("pid", "words", "own")))

    def grams(batches):
        for pdf in batches:
            rows = [(pid, h) for pid, ws, own in zip(pdf["pid"], pdf["words"], pdf["own"]) for h in own_grams(item_of(list(ws), set(own))).view(np.int64)]
            yield pd.DataFrame(rows, columns=["pid", "h"])

    every = cut(known.mapInPandas(grams, "pid long, h long"))
    shared = every.groupBy("h").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("pid").orderBy("n", "h"))  # the n-grams of one passage
    seeds = every.join(shared, "h").withColumn("r", place).where(f"n <= {RARE} or r <= {LEAST_SEEDS}").select("h", "pid")
    return known, members, cut(seeds)


def sieve_of(seeds: DataFrame) -> tuple[np.ndarray, int]:
    """A bit array that has the bits of every seed, and its size as a power of two: 64
    bits a seed, but at most 2^27 (16 MB) however many there are. Beyond that more
    n-grams pass by chance; the join decides in any case."""
    n = seeds.count()
    power = min(SIEVE_BITS[1], max(SIEVE_BITS[0], int(64 * max(1, n)).bit_length()))
    segment = 1 << 13  # bytes

    def mark(batches):
        bits = np.zeros(1 << power - 3, np.uint8)
        for pdf in batches:
            for bit in probes(pdf["h"].to_numpy(np.int64).view(np.uint64), power):
                np.bitwise_or.at(bits, (bit >> np.uint64(3)).astype(np.int64), np.left_shift(np.uint8(1), (bit & np.uint64(7)).astype(np.uint8)))
        parts = bits.reshape(-1, segment)
        rows = [(int(k), parts[k].tobytes()) for k in np.flatnonzero(parts.any(1))]
        yield pd.DataFrame(rows, columns=["k", "bits"])

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"k": [pdf["k"].iloc[0]], "bits": [np.bitwise_or.reduce(np.stack([np.frombuffer(b, np.uint8) for b in pdf["bits"]])).tobytes()]})

    out = np.zeros(1 << power - 3, np.uint8).reshape(-1, segment)
    for r in seeds.select("h").mapInPandas(mark, "k int, bits binary").groupBy("k").applyInPandas(merge, "k int, bits binary").toLocalIterator():
        out[r.k] = np.frombuffer(r.bits, np.uint8)  # at most 2,048 of them
    return out.reshape(-1), power


def leaks(docs: DataFrame, items: DataFrame, least_share: float = SHARE - 0.02) -> DataFrame:
    """(doc_id, item_id, share, own): every document that copies a passage.

    Texts become runs of letters and digits, so layout, markup, case, broken
    encodings, hyphens and even missing spaces don't matter. The documents are scanned
    once, however many items there are: a sieve of bounded size lets the n-grams through
    that may be seeds, and only of texts with such n-grams is anything shuffled. Equal
    texts are from there on one. Their n-grams are joined with the seeds, and
    Smith-Waterman alignment decides on the pairs that share two. Neither items nor
    seeds are held in one place.

    Null, empty and blank texts and passages copy nothing; repeated rows of one doc_id
    give one row; a passage shorter than ten words cannot be copied; items with equal
    passages each have their row.
    """
    spark = docs.sparkSession
    known, members, seeds = passages_of(items)
    bits, power = sieve_of(seeds)
    shared = spark.sparkContext.broadcast(bits)

    def sift(batches):
        sieve = shared.value
        for pdf in batches:
            ids, bodies = pdf["doc_id"].tolist(), [letters(t) if t else b"" for t in pdf["text"]]
            found, ends = [], np.cumsum([len(b) for b in bodies])
            # as many texts at once as make up some millions of letters
            for k in np.split(np.arange(len(ids)), np.flatnonzero(np.diff(ends // (1 << 22))) + 1) if ids else ():
                last = ends[k] - (ends[k[0]] - len(bodies[k[0]]))
                place, h = sifted(codes(b"".join(bodies[i] for i in k)), sieve, power)
                owner = np.searchsorted(last, place, "right")
                inside = place + GRAM <= last[owner]
                place, h, owner = place[inside], h[inside], owner[inside]
                for i in np.flatnonzero(np.bincount(owner, minlength=len(k)) >= SEEDS):
                    mine = slice(*np.searchsorted(owner, [i, i + 1]))
                    body = bodies[k[i]]
                    found.append((ids[k[i]], body, (place[mine] - last[i] + len(body)).astype(np.int32), h[mine].view(np.int64)))
            yield pd.DataFrame(found, columns=["doc_id", "body", "at", "h"])

    suspects = docs.where("text is not null and doc_id is not null").select("doc_id", "text").mapInPandas(sift, "doc_id long, body binary, at array<int>, h array<long>")
    suspects = cut(suspects.withColumn("digest", F.sha2("body", 256)))
    texts = suspects.groupBy("digest").agg(F.first(F.struct("body", "at", "h")).alias("t"))
    grams = texts.select("digest", F.explode(F.arrays_zip("t.at", "t.h")).alias("g")).select("digest", "g.at", "g.h")
    pairs = cut(grams.join(size_checked(seeds, 500_000), "h").groupBy("digest", "pid").agg(F.sort_array(F.collect_list("at")).alias("places")).where(F.size("places") >= SEEDS))
    # a costly step on few bytes: spread by number, which the adaptive planner leaves alone
    n = max(4 * spark.sparkContext.defaultParallelism, -(-pairs.count() // 2_000))
    ready = (
        pairs.join(size_checked(known, 50_000), "pid").repartition(n, "digest")
        .join(texts.select("digest", "t.body").repartition(n, "digest"), "digest")
    )

    def decide(batches):
        memo: dict[int, Item] = {}
        for pdf in batches:
            out = []
            for digest, pid, body, places, words, own in zip(*(pdf[c] for c in ("digest", "pid", "body", "places", "words", "own"))):
                item = memo.get(pid)
                if item is None:
                    if len(memo) > 20_000:
                        memo.clear()
                    item = memo[pid] = item_of(list(words), set(own))
                share, of_own = copied(item, codes(bytes(body)), np.asarray(places))
                if share >= least_share and of_own >= OWN:
                    out.append((digest, pid, round(float(share), 4), round(float(of_own), 4)))
            yield pd.DataFrame(out, columns=["digest", "pid", "share", "own"])

    decided = size_checked(cut(ready.mapInPandas(decide, "digest string, pid long, share double, own double")), 200_000)
    found = suspects.select("doc_id", "digest").join(decided, "digest").join(size_checked(members, 200_000), "pid")
    return found.groupBy("doc_id", "item_id").agg(F.max("share").alias("share"), F.max("own").alias("own"))


def _tables(spark, base):
    return spread(table(spark, base, "documents", ["doc_id", "text"])), table(spark, base, "eval_items", ["item_id", "passage"])


def p9_found(spark: SparkSession, base: str) -> DataFrame:
    return leaks(*_tables(spark, base)).select("doc_id", "item_id")


def p9_items(spark: SparkSession, base: str) -> DataFrame:
    """Per item how many documents copy it, and how much at most."""
    return leaks(*_tables(spark, base)).groupBy("item_id").agg(F.count("*").alias("n_docs"), F.max("share").alias("share"))
