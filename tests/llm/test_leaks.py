import random
import re

import numpy as np
import pytest

from scoreloom.llm import leaks as L
from scoreloom.llm.text import stream

PLACES = ["Besilmor", "Quelltom", "Vreston", "Grieresona", "Loutunmor", "Stogneth", "Kilvorula", "Cintrhof"]
PEOPLE = ["Ulrike Gailvenini", "Antonio Drauntra", "Wenzel Cutemow", "Silvio Glotero"]


def passage(k, people=PEOPLE):
    r = random.Random(k)
    p, q, s = r.sample(PLACES, 3)
    w, n = people[k % 4] + "xyzw"[k % 4] * (k // 4), 100 + 7 * k
    p, q, s = f"{p}{chr(97 + k)}", f"{q}{chr(97 + k)}ve", f"{s}{chr(97 + k)}ro"
    return (
        f"By January the cedar ribs had shrunk {k + 3} lines, so {w} repaired two folding music stands in {p}. Rain spoiled {k + 9} pages at {q}, and {w} burned the rest for {n} florins. "
        f"The road between {p} and {s} took {w} {k + 4} days, despite three written warnings. Hardly a soul in {q} knew that {w} had lent {n} florins to the printer of {s}."
    )


ITEMS = {k: passage(k) for k in range(12)}
NOISE = "The sonatina in G major feels easy until bar 99, where the thumb stroke needs a new fingering. Our script rejected the file because it holds 3 parts and no title. "


def altered(text, every, rng):
    ws = text.split(" ")
    return " ".join(rng.choice(["some", "also", "thing"]) if i % every == every - 1 else w for i, w in enumerate(ws))


def test_disguised_copies_are_found_and_near_misses_not(spark):
    rng = random.Random(1)
    p = ITEMS[3]
    sentences = re.split(r"(?<=\.) ", ITEMS[5])
    copies = {
        1: NOISE + p + NOISE, 2: p.upper(), 3: re.sub(r"[^a-z0-9]", "", p.lower()), 4: "> " + re.sub(r"(.{38})", r"\1-\n> ", p), 5: altered(p, 4, rng), 6: p.replace("e", "é").encode().decode("latin-1"),
        7: "".join(c + "​" * (i % 5 == 0) for i, c in enumerate(p)), 8: "<p>" + p.replace(" ", " <b>x</b> ", 1) + "</p>", 9: p.replace("a", "а").replace("o", "о"), 10: NOISE * 300 + p,
    }
    split = {20: f"{sentences[2]} {NOISE} {sentences[0]}"}
    misses = {30: NOISE, 31: NOISE + " ".join(sentences[0].split()[:9]), 32: passage(40, ["Norbert Schunidor", "Inés Bravolund", "Tadeo Kintrella", "Renata Mosquist"]), 33: "Which statement follows from the passage?", 34: "", 35: " ", 36: None}
    docs = spark.createDataFrame([(k, v, "clash") for d in (copies, split, misses) for k, v in d.items()] + [(1, copies[1], "again")], "doc_id long, text string, passage string")
    items = spark.createDataFrame([(k, v, "clash") for k, v in ITEMS.items()] + [(90, None, ""), (91, "", ""), (92, "short", "")], "item_id long, passage string, text string")
    got = sorted((r.doc_id, r.item_id) for r in L.leaks(docs, items).collect())
    assert got == sorted([(k, 3) for k in copies] + [(20, 5)])
    assert L.leaks(docs.limit(0), items).count() == 0 and L.leaks(docs, items.limit(0)).count() == 0


def test_short_and_far_stretches_are_found():
    """Ten short words with two altered score below chance; the second stretch has no
    seed and stands far from the first."""
    first = "So he and Ulrike ate at ten on the Besilmor road"
    second = "it was as if no one of us had to go in"
    p = f"{first} . We never understood whether anybody thought about leaving earlier , {second} . Everything afterwards remained unexplained throughout."
    item = L.item_of(L.words_of(p), {"ulrike", "besilmor"})
    a, b = first.split(), second.split()
    b[3] = b[8] = "xyz"
    for doc in (" ".join([*a, NOISE * 12, *b]), " ".join([*b, NOISE * 12, *a])):
        c = L.codes(stream(doc))
        seed = stream(doc).index("ulrike")
        share, own = L.copied(item, c, np.array([seed, seed + 1]))
        assert share >= (len(a) + len(b) - 1) / item.n_words and own == 1
    b[5] = b[1] = b[10] = "xyz"
    c = L.codes(stream(" ".join([*a, NOISE * 12, *b])))
    assert L.copied(item, c, np.array([stream(" ".join(a)).index("ulrike")]))[0] <= (len(a) + 1) / item.n_words


def test_passages_that_several_items_share(spark):
    """Equal passages count as one; where nearly all of a passage stands in others too,
    its rarest words and n-grams serve. How many items there are doesn't matter."""
    p = ITEMS[3]
    near = [p.replace("January", m).replace("cedar", w) for m, w in (("March", "spruce"), ("April", "maple"), ("June", "walnut"), ("July", "cherry"), ("August", "ebony"))]
    items = [(k, v) for k, v in ITEMS.items()] + [(100, p), (101, p), (102, p.upper())] + [(200 + i, q) for i, q in enumerate(near)]
    docs = spark.createDataFrame([(1, NOISE + p), (2, near[2]), (3, NOISE), (4, ITEMS[7])], "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in L.leaks(docs, spark.createDataFrame(items, "item_id long, passage string")).collect()}
    assert {(1, 3), (1, 100), (1, 101), (1, 102), (2, 202), (4, 7)} <= got
    assert not any(d == 3 for d, _ in got) and {i for d, i in got if d == 4} == {7}


def test_many_items_make_no_difference(spark):
    docs = spark.createDataFrame([(k, NOISE + passage(k)) for k in range(0, 26, 5)], "doc_id long, text string")
    items = lambda n: spark.createDataFrame([(k, passage(k)) for k in range(n)], "item_id long, passage string")
    assert sorted((r.doc_id, r.item_id) for r in L.leaks(docs, items(26)).collect()) == [(k, k) for k in range(0, 26, 5)]


def test_sieve_lets_every_seed_through(spark):
    rng = np.random.default_rng(4)
    h = rng.integers(0, 1 << 63, 5000, dtype=np.int64)
    bits, power = L.sieve_of(spark.createDataFrame([(int(x), 1) for x in h], "h long, pid long"))

    def passes(x):
        ok = np.ones(len(x), bool)
        for bit in L.probes(x.view(np.uint64), power):
            ok &= (bits[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return ok

    assert passes(h).all() and passes(rng.integers(0, 1 << 63, 100_000, dtype=np.int64)).mean() < 1e-3
    c = np.frombuffer(("abcdefghij" * 50).encode(), np.uint8)
    full = np.full(1 << 17, 255, np.uint8)
    for chunk in (7, 64, 1 << 20):
        place, found = L.sifted(c, full, 20, chunk)
        assert place.tolist() == list(range(len(c) - L.GRAM + 1)) and (found == L.hashes(c)).all()


def test_bound_is_no_lower_than_alignment():
    """What ``possible`` says is never less than what alignment finds."""
    rng = random.Random(6)
    for k in range(30):
        p = passage(k)
        ws = p.split()
        a = rng.randrange(len(ws))
        part = altered(" ".join(ws[a : a + rng.randint(8, 60)]), rng.choice([4, 5, 9]), rng)
        words = L.words_of(p)
        item, doc = L.item_of(words, set(words)), L.codes(stream(NOISE + part + NOISE))
        taken, kept, free = np.zeros(item.n_words, bool), np.zeros(item.n_words, bool), np.ones(len(doc), bool)
        L.align(item, doc, free, taken, kept, 0, len(item.codes), 0, len(doc))
        assert L.possible(item, doc) >= taken.mean() - 1e-9


def test_long_passages_are_aligned_in_pieces(monkeypatch):
    monkeypatch.setattr(L, "PIECE", 700)
    monkeypatch.setattr(L, "OVERLAP", 300)
    p = " ".join(passage(k) for k in range(20))  # some 6,000 letters
    rng = random.Random(8)
    item = L.item_of(L.words_of(p), {"ulrike", "besilmord"})
    doc = L.codes(stream(NOISE * 5 + altered(p, 6, rng)))
    assert L.copied(item, doc, np.arange(0, len(doc), 500))[0] > 0.9


def plain_sw(p, w, match=2, mismatch=2, gap=1):
    best = 0
    h = [[0] * (len(w) + 1) for _ in range(len(p) + 1)]
    for i in range(1, len(p) + 1):
        for j in range(1, len(w) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (match if p[i - 1] == w[j - 1] else -mismatch), h[i - 1][j] - gap, h[i][j - 1] - gap)
            best = max(best, h[i][j])
    return best


def test_smith_waterman_against_loops():
    rng = random.Random(2)
    for _ in range(150):
        p, w = ("".join(rng.choice("abc") for _ in range(rng.randint(1, 14))) for _ in "pw")
        score, set_to, lo, hi = L.smith_waterman(np.frombuffer(p.encode(), np.uint8).astype(np.int16), np.frombuffer(w.encode(), np.uint8).astype(np.int16))
        assert score == plain_sw(p, w)
        used = set_to[set_to >= 0]
        assert (np.diff(used) > 0).all() and all(p[i] == w[set_to[i]] for i in range(len(p)) if set_to[i] >= 0)


@pytest.mark.parametrize("good,want", [("1" * 10, [(0, 10)]), ("1" * 9, []), ("1110111011", [(0, 10)]), ("1010101010", []), ("1" * 10 + "0" * 10 + "1" * 12, [(20, 32), (0, 10)])])
def test_stretches(good, want):
    g = np.array([c == "1" for c in good])
    assert list(L.stretches(g, np.zeros(len(g), bool))) == want


def test_stream():
    assert stream("<b>Ä-\nb</b> &amp; Ç​1") == "abc1"
