import pytest

from scoreloom.operators import notes as N
from scoreloom.sources import scores as S
from scoreloom.sources.schemas import errors, validate
from tests.fixtures import score

SCORES = {
    "plain": score([("C", 4), ("E", 4), ("G", 4), ("C", 5)] * 4, fifths=0),
    "key": score([("F", 4), ("F", 4, {"alter": "1"}), ("F", 4, {"alter": "0"}), ("B", 3, {"alter": "-1"})] * 2, fifths=1),
    "flat": score([("B", 3), ("B", 3, {"alter": "-1"}), ("E", 4)], fifths=-2),
    "chords": score([("C", 4)] * 4 + [("C", 4), ("E", 4, {"chord": 1}), ("G", 4, {"chord": 1}), ("C", 5)] + [("C", 4)] * 4),
    "voices": score([("C", 4), ("E", 4, {"voice": 2})] * 4),
    "fingered": score([("E", 2, {"string": 6, "fret": 0}), ("B", 2, {"string": 6, "fret": 7}), ("E", 2, {"string": 5, "fret": 1}), ("E", 6)]),
    "rests": score([("R", 0), ("C", 4), ("R", 0), ("C", 6)]),
    "broken": b"<score-partwise>",
}


@pytest.fixture(scope="module")
def notes(spark):
    df = spark.createDataFrame([(k, bytearray(v), "musicxml") for k, v in SCORES.items()], "id string, content binary, format string")
    return N.read_notes(df).cache()


def expected(name):
    return {k: S.features(S.parse(v)[0])[name] for k, v in SCORES.items() if k != "broken"}


def test_polyphony_as_from_the_tree(notes):
    got = {r.doc: r for r in N.polyphony(notes).collect()}
    assert {k: r.max_stack for k, r in got.items()} == expected("max_chord_stack")
    assert {k: r.ratio for k, r in got.items()} == expected("polyphonic_measure_ratio")
    assert {k: r.share for k, r in got.items()} == expected("polyphonic_measure_share")
    assert {k: r.voices for k, r in got.items() if k != "rests"} == {k: v for k, v in expected("voice_count_max").items() if k != "rests"}


def test_accidentals_as_from_the_tree(notes):
    assert {r.doc: r.outside for r in N.accidentals(notes).collect()} == expected("accidentals_outside_key")


def test_shifts_as_from_the_tree(notes):
    assert {r.doc: r.shifts for r in N.position_shifts(notes).collect()} == expected("pitch_position_shifts")
    assert {r.doc: r.jumps for r in N.string_jumps(notes).collect()} == {k: v for k, v in expected("position_shift_proxy").items() if v is not None}


def test_quarters_as_from_the_tree(notes):
    want = {k: S.quarters(S.parse(v)[0]) for k, v in SCORES.items() if k != "broken"}
    assert {r.doc: r.quarters for r in N.quarters(notes).collect()} == want


SCHEMA = {
    "type": "object", "required": ["a", "d"], "additionalProperties": False, "$defs": {"p": {"type": "object", "required": ["g"], "properties": {"g": {"type": "integer"}}}},
    "properties": {"a": {"enum": ["x", "y"]}, "d": {"type": "string", "format": "date"}, "u": {"type": "string", "format": "uri"}, "ps": {"type": "array", "minItems": 1, "items": {"$ref": "#/$defs/p"}}},
}


@pytest.mark.parametrize("doc,n", [({"a": "x", "d": "2024-02-29"}, 0), ({"a": "z", "d": "2023-02-29"}, 2), ({"d": "2024-01-01"}, 1), ({"a": "x", "d": "2024-01-01", "ps": []}, 1), ({"a": "x", "d": "2024-01-01", "ps": [{"g": 1}, {"g": True}, {}]}, 2), ({"a": "x", "d": "20240101", "u": "no uri", "z": 1}, 3), ([], 1)])
def test_schema(doc, n):
    assert len(errors(doc, SCHEMA)) == n


def test_validate_rows(spark):
    df = spark.createDataFrame([("1", '{"a":"x","d":"2024-01-01"}'), ("2", "{"), ("3", None)], "id string, json string")
    assert {r.id: r.errors for r in validate(df, SCHEMA).collect()} == {"1": [], "2": ["not JSON"], "3": ["not JSON"]}
