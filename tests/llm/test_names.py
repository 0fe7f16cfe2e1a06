import pytest

from scoreloom.llm import canonical, variants
from scoreloom.llm.names import Name, align, osa, parse, word_distance


@pytest.mark.parametrize("raw", ["Anon", "?Anon", "[anon.]", "ANON.", "Anoymous", "anonyme", "Anónimo", "autor desconocido", "unbekannter Meister", "Unknown composer", "Anon, 17th century", "Anon. lute book"])
def test_unnamed(raw):
    assert parse(raw).kind == "anonymous"


@pytest.mark.parametrize("raw", ["Trad.", "TRADITIONAL", "Traditonal", "Canción popular", "air populaire", "Folk song", "Volksweise", "trad. melody", "Trad. arr."])
def test_folk(raw):
    assert parse(raw).kind == "traditional"


@pytest.mark.parametrize("raw", [None, "", "   ", " ", "N/A", "-", "???", "1843", "TBD", "score.mxl", "#REF!", "see page 3", "Op. 12 No. 4", "guitar solo", "arr. for two guitars", "[composer]", "null", "unknown file", "x" * 1])
def test_nobody(raw):
    assert parse(raw).kind == "nobody"


SAME = [
    ("Welveloz, Pilar", "Pilar Welveloz"), ("WELVELOZ", "Pilar Welveloz"), ("P. Welveloz", "Pilar Welveloz"), ("Welveloz, Pil.", "Pilar Welveloz"), ("welveloz_pilar", "Pilar Welveloz"),
    ("PilarWelveloz", "Pilar Welveloz"), ("Pi1ar Welvelöz", "Pilar Welveloz"), ("Piler Wevleloz", "Pilar Welveloz"), ("attrib. to Pilar Welveloz (1761-1803)", "Pilar Welveloz"),
    ("Pilar Welveloz / ed. anon.", "Pilar Welveloz"), ("Pilar Welveloz, from a lute book", "Pilar Welveloz"), ("Don Welveloz", "Pilar Welveloz"), ("Пилар Велвелоз", "Pilar Welveloz"),
    ("Klara Traistetti", "Klara Giovanni Traistetti"), ("K. G. Traistetti", "Klara Giovanni Traistetti"), ("Manolo Nirtimsen", "Manuel Nirtimsen"), ("Nirtimsen, Fco.", "Francisco Nirtimsen"),
    ("Potelero, Zach the younger", "Zacharias Potelero II"), ("Zacharias Potelero (père)", "Zacharias Potelero I"), ("EdmundvonTrignigic", "Edmund von Trignigič"), ("BartolomÃ© BrasisiÄ\u008d", "Bartolomé Brasisič"),
    ("Schausund, M. S.", "Matteo Sigrid Schausund"), ("M. Schausund", "Matteo Sigrid Schausund"), ("Stornbeira, Dietrich", "Dietrich Stombeira"),
]


@pytest.mark.parametrize("a,b", SAME)
def test_same_person(a, b):
    assert align(parse(a), parse(b)) is not None


OTHER = [
    ("Zacharias Potelero jr.", "Zacharias Potelero I"), ("Silvio Schosunard", "Octavio Schosunard"), ("A. Welveloz", "Pilar Welveloz"), ("Giovanni Traistetti", "Klara Giovanni Traistetti"),
    ("Welvelzo P", "Pilar Welveloz"), ("Pilar Wevlelzoo", "Pilar Welveloz"), ("Pilar", "Pilar Welveloz"), ("Welveloz II", "Pilar Welveloz"),
]


@pytest.mark.parametrize("a,b", OTHER)
def test_another_person(a, b):
    assert align(parse(a), parse(b)) is None


def test_a_known_given_name_is_no_misspelling():
    g = frozenset({"ludwig", "hedwig", "octavio", "ottavio"})
    assert align(parse("Octavio Kirtaseau"), parse("Ottavio Kirtaseau"), g) is None
    assert align(parse("Octavo Kirtaseau"), parse("Octavio Kirtaseau"), g) is not None


def test_distances_against_plain_recursion():
    import functools
    import random

    @functools.cache
    def slow(a, b):
        if not a or not b:
            return len(a) + len(b)
        best = min(slow(a[1:], b) + 1, slow(a, b[1:]) + 1, slow(a[1:], b[1:]) + (a[0] != b[0]))
        if len(a) > 1 and len(b) > 1 and a[0] == b[1] and a[1] == b[0]:
            best = min(best, slow(a[2:], b[2:]) + 1)
        return best

    @functools.cache
    def lev(a, b):
        if not a or not b:
            return len(a) + len(b)
        return min(lev(a[1:], b) + 1, lev(a, b[1:]) + 1, lev(a[1:], b[1:]) + (a[0] != b[0]))

    rng = random.Random(4)
    for _ in range(400):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 6))) for _ in "ab")
        assert osa(a, b, 9) == slow(a, b) and osa(a, b, 2) == min(3, slow(a, b))
        assert canonical.levenshtein(a, b) == lev(a, b)
        if len(a) > 2 and len(b) > 2:
            near = word_distance(a, b) < 9
            assert near == (slow(a, b) <= 1)
            if near:
                assert variants.delete_keys(a) & variants.delete_keys(b)


def test_bk_tree_finds_all_and_prunes():
    import random

    rng = random.Random(5)
    words = list({"".join(rng.choice("abcdefg") for _ in range(rng.randint(3, 9))) for _ in range(600)})
    tree = canonical.BKTree()
    for w in words:
        tree.add(w, w)
    tree.add(words[0], "again")
    for q in words[:40] + ["", "zzz"]:
        tree.visited = 0
        got = sorted((d, w) for d, w, _ in tree.find(q, 1))
        assert got == sorted((canonical.levenshtein(q, w), w) for w in words if canonical.levenshtein(q, w) <= 1)
        assert tree.visited < len(words)
    assert sorted(tree.find(words[0], 0)[0][2]) == sorted([words[0], "again"]) and canonical.BKTree().find("a", 3) == []


LISTED = ["Pilar Welveloz", "Ottavio Welveloz", "Klara Giovanni Traistetti", "Zacharias Potelero I", "Zacharias Potelero II", "Anonymous", "Traditional"]


@pytest.mark.parametrize("shard", [20_000, 2])
def test_mapping(spark, shard):
    cases = {"Pilar Welveloz": "Pilar Welveloz", "Welveloz": "", "P. Welveloz": "Pilar Welveloz", "Traistetti": "Klara Giovanni Traistetti", "Matteo Welveloz": "", "Potelero jr.": "Zacharias Potelero II", "Potelero": "", "?Anon": "Anonymous", "trad": "Traditional", "N/A": "", "Kkara Traisettti": "Klara Giovanni Traistetti", "y" * 5000: ""}
    vals = [(c, 1) for c in cases] * 2 + [(None, 1), ("", 1), ("  ", 1), (" ", 1)]
    v = spark.createDataFrame(vals, "value string, entry int")
    e = spark.createDataFrame([(x, "era") for x in LISTED] + [(None, None)], "entry string, composer string")
    got = [(r.raw_composer, r.composer) for r in canonical.map_to_list(v, e, shard).collect()]
    assert dict(got) == cases and len(got) == len(cases)


@pytest.mark.parametrize("shard", [20_000, 1, 3])
def test_given_names_are_those_of_the_whole_list(spark, shard):
    """Mario is no misspelling of Maria where both are given names of the list, in
    whatever shard they stand."""
    e = spark.createDataFrame([("Maria Sorell",), ("Mario Kintreva",), ("Anna Vrestol",)], "entry string")
    v = spark.createDataFrame([("Mario Sorell",), ("Maria Sorel",), ("Marka Sorell",)], "value string")
    got = {r.raw_composer: r.composer for r in canonical.map_to_list(v, e, shard).collect()}
    assert got == {"Mario Sorell": "", "Maria Sorel": "Maria Sorell", "Marka Sorell": "Maria Sorell"}


def test_mapping_of_empty_tables(spark):
    v = spark.createDataFrame([("Pilar Welveloz",)], "value string")
    e = spark.createDataFrame([("Pilar Welveloz",)], "entry string")
    assert [r.composer for r in canonical.map_to_list(v, e.limit(0)).collect()] == [""]
    assert canonical.map_to_list(v.limit(0), e).count() == 0


def test_a_misspelling_with_wordings_of_its_own_is_another_person(spark):
    e = spark.createDataFrame([("Ignacio Isidro Driergalrz",)], "entry string")
    v = spark.createDataFrame([("Ignacio Driergalez",), ("Driergalez, Ignacio",), ("Ignacoi Driergalrz",)], "value string")
    got = {r.raw_composer: r.composer for r in canonical.map_to_list(v, e).collect()}
    assert got == {"Ignacio Driergalez": "", "Driergalez, Ignacio": "", "Ignacoi Driergalrz": "Ignacio Isidro Driergalrz"}


@pytest.mark.parametrize("crowd", [50, 0])
def test_classes(spark, crowd, monkeypatch):
    monkeypatch.setattr(variants, "CROWD", crowd)
    a = ["Pilar Welveloz", "Welveloz, Pilar", "PILAR WELVELOZ", "Piler Welveloz", "P. Welveloz", "Пилар Велвелоз", "Pilar Welveloz "]
    b = ["Ottavio Welveloz", "Welveloz, Ottavio", "Ottavio Welveloz (?)"]
    c = ["Zacharias Potelero I", "Potelero, Zacharias sr."]
    d = ["Zacharias Potelero II", "Zach Potelero (fils)"]
    odd = ["Welveloz", "Anon", "N/A", None, "", " ", "z" * 3000]
    vals = [(v, "x") for v in [*a, *b, *c, *d, *odd, *a]]
    df = spark.createDataFrame(vals, "value string, person string")
    got = {}
    for r in variants.name_classes(df).collect():
        got.setdefault(r.person, set()).add(r.name)
    want = [set(a), set(b), set(c), set(d), {"z" * 3000}]
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want))
    assert variants.name_classes(df.limit(0)).count() == 0


def test_pairs_are_those_of_the_classes(spark, tmp_path):
    base = str(tmp_path)
    names = ["Pilar Welveloz", "Welveloz, Pilar", "pilar welveloz", "Ottavio Welveloz"]
    spark.createDataFrame([(n,) for n in names], "composer_normalized string").write.parquet(f"{base}/dummy_advisor_grades.parquet")
    spark.createDataFrame([("Welveloz, Ottavio",), (None,)], "composer_hint string").write.parquet(f"{base}/guitar_loot_candidate.parquet")
    spark.createDataFrame([("Pilar Welveloz",), ("",)], "composer string").write.parquet(f"{base}/mutopia_candidate.parquet")
    got = sorted(tuple(r) for r in variants.p2_found(spark, base).collect())
    assert got == sorted([("Pilar Welveloz", "Welveloz, Pilar"), ("Pilar Welveloz", "pilar welveloz"), ("Welveloz, Pilar", "pilar welveloz"), ("Ottavio Welveloz", "Welveloz, Ottavio")])


def test_like_names_share_a_meeting_key(spark):
    """Whatever ``align`` takes for one person meets by a key."""
    import pandas as pd

    known = [p for pair in SAME for p in pair] + ["Danny Kolb", "Daniel Kolb", "Nando Kolb", "Fernando Kolb", "Kkara Kolb", "Klara Kolb", "Lkara Kolb", "lara Kolb", "Bill Kolb", "William Kolb", "Kolb", "M. Kolb", "Manuel Kolb"]
    parsed = {raw: parse(raw) for raw in dict.fromkeys(known)}
    rows = [(raw, n.tokens, n.short, n.surname, n.gen, n.cyr, n.m_title, n.full == len(n.tokens) > 1) for raw, n in parsed.items()]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["key", "tokens", "short", "surname", "gen", "cyr", "m_title", "full"]), "key string, tokens array<string>, short array<boolean>, surname int, gen int, cyr boolean, m_title boolean, full boolean")
    keys = {r.key: (set(r.asks), set(r.offers)) for r in variants.meeting_keys(df).collect()}
    pairs = 0
    for a, x in parsed.items():
        for b, y in parsed.items():
            if a != b and y.surname and y.full == len(y.tokens) > 1 and align(x, y):
                pairs += 1
                assert keys[a][0] & keys[b][1], (a, b)
    assert pairs > 30


@pytest.mark.parametrize("a,b,want", [("nando", "fernando", True), ("danny", "daniel", True), ("rafi", "rafael", True), ("maria", "maria", False), ("ana", "mariana", False), ("mario", "maria", False), ("anna", "hanna", False)])
def test_familiar_forms(a, b, want):
    from scoreloom.llm.names import familiar

    assert familiar(a, b) is want


def test_key_ignores_order_case_and_decoration():
    assert parse("Welveloz, Pilar (1761-1803)").key == parse("pilar welveloz").key == parse("by PILAR WELVELOZ *").key
    assert isinstance(parse("a"), Name)


def test_names_of_any_number_of_words():
    long = "Maria Ana Luisa Teresa Carmen Rosa Elena Pilar Isabel Welveloz"
    assert align(parse(long), parse(long)).cost == 0
    assert align(parse("Welveloz, Maria A. L. T. C. R. E. P. I."), parse(long)) is not None
    assert align(parse("Maria Ana Luisa Teresa Carmen Rosa Elena Piler Isabel Wevleloz"), parse(long)).edits == 2
    assert align(parse("Maria Welveloz"), parse(long)) is not None and align(parse(long), parse("Maria Welveloz")) is not None
    assert align(parse("Maria Ana Luisa Teresa Carmen Rosa Elena Pilar Isabel Dotgau"), parse(long)) is None


def test_long_names_of_like_words_end_soon():
    """Where every word fits every other there are too many ways to try them all."""
    same = lambda n, sur: Name("person", ["a"] * n + sur, [True] * n + [False] * len(sur), len(sur))
    full = lambda n, sur: Name("person", [f"a{chr(98 + k)}x" for k in range(n)] + sur, [False] * (n + len(sur)), len(sur))
    assert align(same(24, ["lopez"]), full(24, ["lopez"])).given == 24
    assert align(same(40, ["lopez"]), full(20, ["lopez"])).given == 20
    assert align(same(24, ["lopez"]), full(24, ["lopez", "lopez"])) is None
    assert align(same(900, ["lopez"]), full(2, ["lopez"])).given == 2


def test_values_of_many_words_are_mapped(spark):
    long = "Maria Ana Luisa Teresa Carmen Rosa Elena Pilar Isabel Welveloz"
    values = ["Welveloz, Maria Ana Luisa Teresa Carmen Rosa Elena Pilar Isabel", "Maria Ana Luisa Teresa Carmen Rosa Elena Pilar Isobel Welveloz"]
    got = canonical.map_to_list(spark.createDataFrame([(v,) for v in values], "value string"), spark.createDataFrame([(long,), ("Octavio Dotgau",)], "entry string")).collect()
    assert {r.raw_composer: r.composer for r in got} == dict.fromkeys(values, long)
