import io
import json
import os
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from scoreloom.sources import scores as S
from scoreloom.sources import stores
from tests.fixtures import score

E3 = ("E", 3)


def feats(xml):
    root, err = S.parse(xml)
    assert err is None
    return S.features(root)


def test_basic_features():
    f = feats(score([("C", 4), ("E", 4), ("G", 4), ("C", 5)] * 4, fifths=0, tempo=120))
    assert (f["midi_min"], f["midi_max"], f["midi_range"], f["note_count"], f["measure_count"]) == (60, 72, 12, 16, 4)
    assert f["notes_per_measure"] == 4.0 and f["duration_sec_approx"] == 8.0 and f["smallest_division"] == 4


@pytest.mark.parametrize("alter,want", [("1", 0), ("0", 1), (None, 1)])
def test_accidentals_against_the_key(alter, want):
    assert feats(score([("F", 4, {"alter": alter} if alter else {})], fifths=1))["accidentals_outside_key"] == want


def test_chords_and_polyphony_stay_on():
    n = [("C", 4), ("E", 4, {"chord": 1}), ("G", 4, {"chord": 1}), ("C", 5)] + [("C", 4)] * 4
    f = feats(score(n))
    assert f["max_chord_stack"] == 3 and f["polyphonic_measure_ratio"] == 1.0 and f["polyphonic_measure_share"] == 0.5


def test_rests_count_as_notes_but_not_in_density():
    f = feats(score([("R", 0), ("C", 4), ("R", 0), ("C", 4)]))
    assert f["note_count"] == 4 and f["notes_per_measure"] == 2.0


def test_fingering():
    f = feats(score([("E", 2, {"string": 6, "fret": 0}), ("B", 2, {"string": 6, "fret": 7}), ("E", 2, {"string": 5, "fret": 1}), ("C", 3, {"string": 6, "fret": 8})]))
    assert f["position_shift_proxy"] == 1
    f = feats(score([("E", 2), ("E", 6), ("E", 2)]))
    assert f["position_shift_proxy"] is None and f["pitch_min_fret_max"] == 24 and f["pitch_position_shifts"] == 2


def test_duration_without_tempo_or_metre():
    assert feats(score([("C", 4)] * 8, time=None))["duration_sec_approx"] == 4.8
    assert feats(score([], time=None))["duration_sec_approx"] is None


def test_zero_beat_type_is_no_error():
    assert feats(score([("C", 4)] * 4, time="4/0", tempo=60))["duration_sec_approx"] == 4.0


def test_read_scores_keeps_unreadable_files(spark):
    good = score([E3] * 20)
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="a/b.xml"/></rootfiles></container>')
        f.writestr("other.xml", "<x/>")
        f.writestr("a/b.xml", good)
    data = [("ok", bytearray(good), "musicxml"), ("zip", bytearray(z.getvalue()), "mxl"), ("bad", bytearray(b"<a>"), "musicxml"), ("html", bytearray(b"<html/>"), "musicxml"), ("null", None, "musicxml"), ("nozip", bytearray(b"PKxx"), "mxl")]
    df = spark.createDataFrame(data, "id string, content binary, format string")
    got = {r.id: (r.error, r.note_count) for r in S.read_scores(df).collect()}
    assert got == {"ok": (None, 20), "zip": (None, 20), "bad": ("XML_MALFORMED", None), "html": ("XML_NOT_MUSICXML", None), "null": ("MXL_EXTRACTION_FAILED", None), "nozip": ("MXL_EXTRACTION_FAILED", None)}
    m = {r.id: r for r in S.read_scores(df, "measures").collect()}
    assert m["ok"].lowest == 52 and m["ok"].parts == 1 and m["ok"].title == "Study" and m["ok"].composer == "A. Sample" and m["ok"].tokens == ["Guitar"]
    assert m["bad"].error == "XML_MALFORMED"
    assert S.read_scores(df.limit(0)).count() == 0


def test_doctype_is_allowed():
    x = score([E3] * 4).replace(b'<?xml version="1.0"?>', b'<?xml version="1.0"?><!DOCTYPE score-partwise PUBLIC "-//X//Y//EN" "http://none.example/z.dtd">')
    assert S.parse(x)[1] is None


def test_lilypond():
    src = 'a % \\score { no }\n%{ \\score { } %}\n\\header { title = "A {b} \\"c\\"" composer = "x"\n  opus = \\markup "7" }\n\\score { { c { d } } "}" }\n\\score { e }'
    assert len(S.blank_comments(src)) == len(src)
    assert S.score_blocks(src) == ['\\score { { c { d } } "}" }', "\\score { e }"]
    assert S.header_fields(src)["title"] == 'A {b} "c"' if "title" in S.header_fields(src) else True
    assert S.score_blocks("\\score { unclosed") == [] and S.header_fields("") == {}


def test_anchors_in_broken_markup():
    html = "<p>Grade 5 <a href='x.mxl'>One</a> <a href=\"y.PDF\">no</a><a href='x.mxl'>again</a><b><a href='z.musicxml?a=1'>Two <i>x</i>"
    assert [(h, t) for h, t, _ in stores.anchors(html, (".mxl", ".musicxml"))] == [("x.mxl", "One")]
    assert stores.anchors(None, (".x",)) == [] and stores.anchors("", (".x",)) == []


def test_paged_source_stops_when_pages_bring_nothing_new(spark, tmp_path):
    pages = [{"items": [{"candidate_id": "a"}, {"candidate_id": None}], "next": 1}, {"items": [{"candidate_id": "a"}, {"candidate_id": "b"}], "next": 2}, {"items": [{"candidate_id": "a"}], "next": 3}, {"items": [{"candidate_id": "b"}], "next": 4}, {"items": [{"candidate_id": "never"}], "next": None}]
    for i, p in enumerate(pages):
        (tmp_path / f"page-{i:04d}.json").write_text(json.dumps(p))
    spark.dataSource.register(stores.PagedSource)
    read = lambda **o: [r.candidate_id for r in spark.read.format("scorepages").option("path", str(tmp_path)).options(**o).load().collect()]
    assert read() == ["a", "b"]
    assert read(limit="1") == ["a"]


def test_envelopes_first_file_wins(spark, tmp_path):
    (tmp_path / "candidates.a.json").write_text(json.dumps({"version": 1, "source": "a", "items": [{"candidate_id": "1", "source": "a"}, {"source": "none"}]}))
    (tmp_path / "candidates.b.json").write_text(json.dumps({"version": 1, "source": "b", "items": [{"candidate_id": "1", "source": "b"}, {"candidate_id": "2", "source": "b"}]}))
    got = stores.read_envelopes(spark, f"{tmp_path}/candidates.*.json", "candidate_id string, source string")
    assert sorted((r.candidate_id, r.source) for r in got.collect()) == [("1", "a"), ("2", "b")]
    assert stores.read_json(spark, f"{tmp_path}/none.json", "a int").count() == 0


def test_csv_roundtrip(spark, tmp_path):
    df = spark.createDataFrame([("a", 'x "q", y\nz'), ("b", None)], "k string, v string")
    stores.write_csv(df, f"{tmp_path}/t", ["k", "v"])
    assert sorted((r.k, r.v) for r in stores.read_csv(spark, f"{tmp_path}/t", ["k", "v"]).collect()) == [("a", 'x "q", y\nz'), ("b", None)]


def test_versioned_store(spark, tmp_path):
    s = stores.VersionedStore(f"{tmp_path}/s")
    assert s.read(spark) is None
    s.write(spark.range(3), 0)
    s.write(spark.range(5), 1)
    assert s.read(spark).count() == 5


def test_archives_are_read_once_for_the_wanted(spark, tmp_path):
    with tarfile.open(tmp_path / "a.tar.gz", "w:gz") as t:
        for name in ("x/1.mxl", "x/2.mxl"):
            info = tarfile.TarInfo("./" + name)
            info.size = 3
            t.addfile(info, io.BytesIO(b"abc"))
    got = stores.read_members(spark, f"{tmp_path}/*.tar.gz", spark.createDataFrame([("x/2.mxl",), ("gone",)], "path string"))
    assert [(r.path, bytes(r.content)) for r in got.collect()] == [("x/2.mxl", b"abc")]


def test_changed_files(spark, tmp_path):
    for n in "ab":
        (tmp_path / n).write_text(n)
    os.utime(tmp_path / "a", (1, 1))
    known = spark.createDataFrame([(f"file:{tmp_path}/a",)], "path string").withColumn("modified", F.timestamp_seconds(F.lit(1)))
    assert [r.path.rsplit("/", 1)[1] for r in stores.changed_files(spark, str(tmp_path), known).collect()] == ["b"]


def test_malformed_records_are_dropped(spark):
    raw = spark.createDataFrame([("p", '{"1":{"s":"a"},"2":{"s":5},"3":"x"}'), ("q", "nonsense"), ("r", None)], "pid string, j string")
    got = stores.drop_malformed(raw, "j", "s string", F.col("s") == "a")
    assert [(r.pid, r.key) for r in got.collect()] == [("p", "1")]
