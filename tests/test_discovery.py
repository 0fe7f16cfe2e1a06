"""Pages, listings, fetching, rewrites, reports: values on small inputs."""

import json

import pytest
from pyspark.sql import functions as F

from scoreloom.functions import seeded
from scoreloom.operators import profiles, quality, scoretime
from scoreloom.sources import discovery as D
from scoreloom.sources import reports as R
from scoreloom.sources import scores as S


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


PAGE = """<html><h2 id="wiki_Composer">Composer</h2><p>said to be</p><div><a href="/wiki/Category:Sor,_F"> </a><a href="/wiki/Category:Sor,_F">Sor, F</a></div>
<ul><li><a href="/wiki/Special:ReverseLookup/12">#12</a> <b>MusicXML</b> file, Creative Commons Attribution 4.0<li><span><a href="/wiki/Special:ReverseLookup/12">again MXL</a></span></ul>
<div><div><a href="/wiki/Special:ReverseLookup/13">#13</a></div> PDF only</div><p><a href="/x/ReverseLookup/">none</a>"""


def test_files_of_a_page():
    root = D.page(PAGE)
    (i, label, licence), = [r for r in D.file_rows(root, levels=2)]
    assert i == "12" and label.startswith("#12 MusicXML file") and licence.startswith("Creative Commons Attribution 4.0")
    # with more levels the whole page names a format
    assert [r[0] for r in D.file_rows(root)] == ["12", "13"]
    assert D.named_after(root) == "Sor, F" and D.named_after(D.page("<h2>Composer</h2><a href='/wiki/Category:X'>X</a>")) == ""
    assert D.named_after(D.page("<h2 id=Composer></h2><p></p><p></p><p></p><p></p><p><a href='/wiki/Category:X'>X</a></p>")) == ""
    for broken in (None, "", "<a <b></i>", "</p>" * 50, "<div>" * 3000):
        assert D.file_rows(D.page(broken)) == []
    assert D.licence_in("all rights, public domain here") == "public domain here" and D.licence_in("") == "unknown"


def test_pages_that_give_nothing(spark):
    df = spark.createDataFrame([("File:A", PAGE, 1), ("A b", PAGE, 1), ("C", None, 1), ("", PAGE, 1), (None, PAGE, 1), ("D", "", 1)], "title string, html string, label int")
    got = D.page_candidates(df)
    assert {(r.work_id, r.file_id, r.composer) for r in got.collect()} == {("A_b", "12", "Sor, F"), ("A_b", "13", "Sor, F")}
    assert D.page_candidates(df.limit(0)).count() == 0


@pytest.mark.parametrize("pages,want", [([[1, 2], [3], [1], [2], [4]], {1, 2, 3}), ([[1], [1], [2], [2], [2], [3]], {1, 2}), ([[1], [2]], {1, 2}), ([], set()), ([[None], [None], [5]], set())])
def test_listing_stops(spark, pages, want):
    df = spark.createDataFrame([(p, i) for p, ids in enumerate(pages) for i in ids], "page int, id int")
    assert {r.id for r in D.until_stale(df, "page", "id").collect()} == want


def test_repositories(spark):
    a = spark.createDataFrame([("r", "x y.mxl"), ("r", "x y.mxl"), ("f", "z.mxl"), ("", "q.mxl"), (None, "q.mxl")], "repo string, path string")
    b = spark.createDataFrame([("r", "d/e.musicxml"), ("u", "k.MXL")], "repo string, path string")
    meta = spark.createDataFrame([("r", "", False, "CC0-1.0"), ("f", "main", True, None)], "repo string, default_branch string, fork boolean, spdx string")
    got = {r.candidate_id: (r.file_path, r.license_spdx, r.format_label) for r in D.repo_candidates([a, b], meta).collect()}
    assert got == {"gh:r@HEAD:x y.mxl": ("r/HEAD/x%20y.mxl", "CC0-1.0", "mxl"), "gh:r@HEAD:d/e.musicxml": ("r/HEAD/d/e.musicxml", "CC0-1.0", "musicxml"), "gh:u@HEAD:k.MXL": ("u/HEAD/k.MXL", "unknown", "mxl")}
    assert D.repo_candidates([a, b], meta, skip_forks=False).count() == 4


def test_retries_and_waits():
    slept, answers = [], iter([("API rate limit exceeded", []), ("rate limit", []), ("", [1])])
    assert D.retried(lambda: next(answers), sleep=slept.append) == [1] and slept == [60, 120]
    assert D.retried(lambda: ("boom", [9])) == [] and D.retried(lambda: ("rate limit", []), retries=1, sleep=slept.append) == [] and slept == [60, 120, 60]
    now, slept = [0.0], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    replies = iter([(503, {}, b""), (429, {"Retry-After": "7"}, b""), (500, {}, b""), (200, {}, b"ok"), (404, {}, b"")])
    s = D.Session(lambda url: next(replies), D.Politeness(), clock=lambda: now[0], sleep=sleep)
    assert s.get("u") == (200, b"ok", 4, "") and slept == [0.5, 7.0, 6.0]
    assert s.get("u")[0] == 404 and slept[-1] == 0.5
    s = D.Session(lambda url: 1 / 0, D.Politeness(retries=1), clock=lambda: now[0], sleep=sleep)
    assert s.get("u") == (0, b"", 2, "ZeroDivisionError: division by zero")
    with pytest.raises(ValueError):
        D.Politeness(spacing=0.1)


def test_fetch_reasons(spark):
    def transport(url):
        return {"a": (200, {}, b"PK\x03\x04.."), "b": (200, {}, b""), "c": (200, {}, b"hello"), "d": (404, {}, b"x")}[url[-1]]

    df = spark.createDataFrame([(x, f"http://h/{x}") for x in "abcde"] + [("n", None)], "id string, url string")
    got = {r.id: (r.reason, r.format, r.content is not None) for r in D.fetch_all(df, transport, D.Politeness(retries=0), sleep=lambda s: None).collect()}
    assert got == {"a": (None, "mxl", True), "b": ("empty_body", None, False), "c": ("format_undetected", None, False), "d": ("http_404", None, False), "e": ("network_error", None, False)}
    codes = spark.createDataFrame([("http_404",), ("LY_CONVERSION_FAILED",), (None,)], "r string").select(D.reject_code(F.col("r")).alias("c"))
    assert [r.c for r in codes.collect()] == ["FETCH_FAILED", "LY_CONVERSION_FAILED", "FETCH_FAILED"]


def test_includes(spark):
    files = spark.createDataFrame([("/a/x.ly", 'c\n\\include "./y.ly"\n\\include "no.ly"\nd'), ("/a/y.ly", 'e\n\\include "x.ly"'), ("/b/y.ly", None)], "path string, text string")
    got = dict(rows(D.inline_includes(files)))
    assert got["/a/x.ly"] == 'c\n% inlined include ./y.ly\ne\n\\include "x.ly"\n% end inlined ./y.ly\n\\include "no.ly"\nd' and got["/b/y.ly"] == ""


@pytest.mark.parametrize("kind,src,want", [
    ("header", 'a \\header { t = "}" { } } b', "a  b"), ("header", "% \\header { }\nc", "% \\header { }\nc"), ("header", "\\header { x", "\\header { x"),
    ("rename", "\\new TabStaff { \\TabVoice TabStaffs }", "\\new Staff { \\Voice TabStaffs }"),
    ("drop", '\\new TabStaff { a { b } } c \\context TabStaff << << d >> e >> f', " c  f"), ("drop", '\\TabStaff { a } \\new TabStaff = "g" { b }', ' \\new TabStaff = "g" { b }'), ("drop", "\\new TabStaff { a", "\\new TabStaff { a"), ("drop", "\\new TabStaff \\x { a } % \\new TabStaff { b }", "\\new TabStaff \\x { a } % \\new TabStaff { b }"),
])
def test_rewrites(kind, src, want):
    assert S.REWRITES[kind](src) == want


def test_reports_and_records(spark, tmp_path):
    df = spark.createDataFrame([("a|b", None), ("c", 2)], "k string, n int")
    assert R.markdown("T", [("S", df.orderBy("k"))], most=1) == "# T\n\n## S\n\n| k | n |\n| --- | --- |\n| a\\|b |  |\n\n… and 1 more\n"
    assert R.tally(df, "k", ["c", "z"]).first().asDict() == {"c": 1, "z": 0, "total": 2}
    m = R.model_record(spark, ["a"], [3, 5], [[0.5], [1]], [0.1, -2], [1], [2])
    m.coalesce(1).write.json(f"{tmp_path}/m")
    back = [json.loads(line) for p in (tmp_path / "m").glob("*.json") for line in p.read_text().splitlines()]
    assert back == [{"features": ["a"], "classes": [3, 5], "coef": [[0.5], [1.0]], "intercept": [0.1, -2.0], "mean": [1.0], "std": [2.0]}]
    s = spark.createDataFrame([(0, None, None, None, None, None), (2, 1.5, 1.0, 2.0, 0.0, 3.0)], "n int, m double, a double, b double, lo double, hi double").select(R.summary_text("n", "m", "a", "b", "lo", "hi").alias("t"))
    assert [r.t for r in s.collect()] == ["—", "n=2 · med=1.5 (p25=1.0, p75=2.0) · range=[0.0, 3.0]"]


def test_seeded_numbers():
    """The generator's known first numbers for seeds 1 and 2, and draws without repeats."""
    first = [int(u * 2**32) for u, _ in zip(seeded.mulberry32(1), range(2))]
    again = [int(u * 2**32) for u, _ in zip(seeded.mulberry32(1), range(2))]
    assert first == again and first != [int(u * 2**32) for u, _ in zip(seeded.mulberry32(2), range(2))]
    u = [x for x, _ in zip(seeded.mulberry32(7), range(20_000))]
    assert 0 <= min(u) and max(u) < 1 and abs(sum(u) / len(u) - 0.5) < 0.01
    assert sorted(seeded.places(9, 5, 3)) == [0, 1, 2, 3, 4] and len(set(seeded.places(10, 1000, 1))) == 10 and seeded.places(3, 0, 1) == []


def test_phases_and_ids(spark):
    e = [("a", i, t) for i, t in enumerate(["ready", "recording", "analyzing", "done", "ready"])] + [("b", 0, "done"), ("b", 1, "ready"), ("b", 2, "x"), ("c", 0, None)]
    got = rows(profiles.phases(spark.createDataFrame(e, "session string, seq int, to string")))
    assert got == [("a", "ready", 0), ("b", "ready", 2)]
    ids = [r.i for r in spark.range(50).select(profiles.new_id(F.col("id")).alias("i")).collect()]
    assert len(set(ids)) == 50 and all(i.startswith("p_") and len(i.split("_")) == 3 and i == i.lower() for i in ids)


def test_both_ends_and_loops(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(9)], "i int, d int")
    got = rows(quality.both_ends(df, F.col("d"), ["i"], 2))
    assert got == [("best", 1, 0, 0), ("best", 2, 3, 0), ("worst", 1, 8, 2), ("worst", 2, 5, 2)]
    assert quality.both_ends(df.limit(0), F.col("d"), ["i"], 2).count() == 0
    s = spark.createDataFrame([(1, [0.0, 10.0], [10.0, 5.0])], "k int, s array<double>, d array<double>")
    for (a, b), want in {(1, 2): (0.0, 15.0), (2, 2): (10.0, 15.0), (2, 1): None, (0, 1): None, (1, 3): None, (None, 1): None}.items():
        r = s.select(scoretime.loop_range(F.col("s"), F.col("d"), F.lit(a).cast("int"), F.lit(b).cast("int")).alias("r")).first().r
        assert (None if r is None else tuple(r)) == want
    assert s.select(scoretime.tick_at_frame(F.array().cast("array<double>"), F.lit(3)).alias("t")).first().t == 0.0


def test_link_titles_and_context():
    p = D.page('<li>Grade 3 <b>Lágrima</b> <a href="a/one.mxl">MXL</a> <a href="b/Two.xml">  A  Waltz </a></li><span><a href="/x/three.musicxml">xml</a></span>')
    links = [a for a in p.walk() if a.tag == "a"]
    assert [D.link_title(a) for a in links] == ["Lágrima", "A Waltz", "Lágrima"] and D.around(links[0]) == "Grade 3 Lágrima MXL A Waltz"
    lone = D.page('<span><a href="/x/three.v2.musicxml?d=1">xml</a></span>')
    a = next(x for x in lone.walk() if x.tag == "a")
    assert D.link_title(a) == "three.v2" and D.around(a) == "xml"


def test_attributed_names(spark):
    from scoreloom.operators import stats

    listed = spark.createDataFrame([("John Danyel", "renaissance"), ("John", "x"), ("F. Sor", None), ("", "y")], "entry string, era string")
    names = ["John Danyel", "Attr. John Danyel", "JOHN DANYEL", "John Danyel 1564", "after ?John", "Anon, 16th", "The Board Lute Book", "F. Sor", "Nobody", "", None, "?  john d"]
    got = {r.n: (r.found, r.how) for r in stats.attributed(spark.createDataFrame([(n,) for n in names], "n string"), "n", listed, "entry", "era", ("lute book",), "old").collect()}
    assert got == {
        "John Danyel": ("renaissance", "exact"), "Attr. John Danyel": ("renaissance", "exact"), "JOHN DANYEL": ("renaissance", "case"), "John Danyel 1564": ("renaissance", "prefix"), "after ?John": (None, "none"), "Anon, 16th": ("old", "unnamed"),
        "The Board Lute Book": ("old", "marker"), "F. Sor": (None, "exact"), "Nobody": (None, "none"), "": (None, "none"), None: (None, "none"), "?  john d": ("x", "prefix"),
    }


def test_folders_and_copies(spark, tmp_path):
    from scoreloom.sources import stores

    d = tmp_path / "s"
    d.mkdir()
    (d / "a.json").write_text('{"k": 1}')
    (d / "schema.json").write_text('{"k": 9}')
    assert rows(stores.read_folder(spark, str(d), "k int")) == [(1, "a.json")]
    stores.write_json(spark.createDataFrame([(1, 2)], "b int, a int"), f"{tmp_path}/w")
    assert [line for p in (tmp_path / "w").glob("part*.json") for line in p.read_text().splitlines()] == ['{"a":2,"b":1}']
    none = spark.createDataFrame([], "path string, modified timestamp")
    first = stores.copy_changed(spark, str(d), f"{tmp_path}/t", none).cache()
    assert first.count() == 2 and (tmp_path / "t" / "a.json").read_text() == '{"k": 1}'
    assert stores.copy_changed(spark, str(d), f"{tmp_path}/t", first).count() == 0 and len(list((tmp_path / "t").iterdir())) == 2


def test_locale_order(spark):
    """Titles in the order of a language, not of bytes."""
    df = spark.createDataFrame([(t,) for t in ("b", "A", "Á", "a", "B", "z")], "t string")
    assert [r.t for r in df.orderBy(F.collate("t", "UNICODE")).collect()] == ["a", "A", "Á", "b", "B", "z"]


def test_reset_follower():
    from tests.test_listening import varied
    from scoreloom.operators import listening as L

    ref = varied(2)
    f, g = L.Follower(ref), L.Follower(ref)
    for v in ref.frames[:9]:
        f.step(v, False)
    f.reset()
    assert f.state == g.state and [f.step(v, False) for v in ref.frames[:5]] == [g.step(v, False) for v in ref.frames[:5]]
