import random

import numpy as np
import pytest

from scoreloom.llm import abuse, abuse_examples
from tests.llm import abuse_heldout


@pytest.fixture(scope="module")
def model():
    return abuse.train([], per_template=25)


def test_held_out_accuracy(model):
    """Sentences of the same families from another seed, with other fillings."""
    rng = random.Random(99)
    test = abuse_examples.examples(6, 12345)
    s = model.scores([t for t, _ in test]) >= 0.5
    y = np.array([bool(l) for _, l in test])
    assert (s == y).mean() > 0.97 and s[y].mean() > 0.97 and s[~y].mean() < 0.04
    del rng


DISGUISES = [
    "Shut your mouth, you useless cretin, nobody asked you.", "5hut y0ur m0uth, y0u u$3l3$$ cr3t1n, n0b0dy 4$k3d y0u.", "Shut your m.o.u.t.h, you useless c.r.e.t.i.n, nobody asked you.",
    "Shut your m***h, you u*****s cretin, nobody a***d you.", "Ѕhut уоur mоuth, уоu uselеss crеtin, nоbоdу аskеd уоu.", "Sh​ut yo​ur mo​uth, you usele​ss cre​tin, nobody asked you.",
    "shut your mouth you useless cretin nobody asked you The key signature says D minor", "Shut yuor mouth, you useles cretin, noboddy asked you.", "Niemand würde dich vermissen, also verschwinde endlich für immer.",
    "Nadie te echarÃ­a de menos, asÃ\xad que desaparece para siempre.", "Tu ne manquerais à personne, alors disparais pour de bon.", "I want you naked on my bed tonight, moaning while I ride you.",
]
HARMLESS = [
    "", " ", "My teacher reported that someone had called the soloist a useless cretin, and the comment is gone now.", "Our rules say that calling another member vermin leads to a ban.",
    "The attack on the G-string is a killer, but the naked harmonics up there are gorgeous.", "Qué idiota soy, ayer estudié sin metrónomo y sonó a basura.", "Set the metronome to 94 and play only the melody until it stops feeling stiff.",
    "Le modérateur a retiré 153 messages pour injures.", "123 456 \\relative c' { a b c }", "🎸🎸🎸",
]


@pytest.mark.parametrize("t", DISGUISES)
def test_disguises(model, t):
    assert model.scores([t])[0] >= 0.5
    assert model.scores(["The model says grade 5, a student says grade 3. " * 200 + t])[0] >= 0.5


@pytest.mark.parametrize("t", HARMLESS)
def test_harmless(model, t):
    assert model.scores([t])[0] < 0.5


def test_held_out_sentences():
    """Sentences that no template gives, in four languages (see ``abuse_heldout``)."""
    f = abuse.train([])
    bad, good = (f.scores(abuse_heldout.sentences(t)) >= abuse.EXCLUDE for t in (abuse_heldout.BAD, abuse_heldout.GOOD))
    assert len(bad) >= 60 and bad.mean() >= 0.9 and good.mean() <= 0.05


def test_short_and_foreign_parts_are_read():
    assert abuse.units("Whore!") == [["whore"]] and abuse.units("You. Idiot.") == [["you", "idiot"]]
    assert abuse.units("Nice tone. Bravo!") == [["nice", "tone", "bravo"]]
    assert abuse.units("Ты дурак") == [["ты", "дурак"]] and abuse.units("") == abuse.units(" ... ") == []
    # a sentence inside the braces of a score is read, its notes are not
    assert abuse.units("\\relative c' { a4 b8 c You are vermin }")[0][-3:] == ["you", "are", "vermin"]
    assert abuse.units("\\relative c' { a4 b8 <c e g>2 r4 | \\bar } Good.") == [["good"]]


def test_kept_filter_is_the_fitted_one(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(abuse, "PER_TEMPLATE", 2)
    monkeypatch.setattr(abuse, "kept_folder", lambda spark: str(tmp_path / "kept"))
    spark.createDataFrame([(1, "s", "A dry tremolo ruins the coda."), (2, "s", None)], "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    fits = []
    train = abuse.train
    monkeypatch.setattr(abuse, "train", lambda *a, **k: fits.append(1) or train(*a, per_template=2, **k))
    a, b = abuse.fitted(spark, str(tmp_path)), abuse.fitted(spark, str(tmp_path))
    assert len(fits) == 1 and np.array_equal(a.machine.w, b.machine.w) and a.lexicon.counts == b.lexicon.counts
    t = ["You filthy rat.", "A bar of rest."]
    assert np.allclose(a.scores(t), b.scores(t))


def test_pair_sum_against_loops():
    m = abuse.Machine(np.random.default_rng(1))
    m.w[:] = np.random.default_rng(2).normal(size=abuse.SLOTS)
    rows = [[9, 5, 1], [7, 0, 0], [0, 0, 0]]
    m.w[0] = 0
    got = m.margin(np.array(rows))
    rows = [[i for i in r if i] for r in rows]
    for r, g in zip(rows, got):
        want = m.bias + sum(m.w[i] for i in r) + sum(float(m.v[i] @ m.v[j]) for a, i in enumerate(r) for j in r[a + 1 :])
        assert abs(g - want) < 1e-4


def test_terms_are_words_and_pairs_once():
    rows = [["a", "b", "a", "b"], ["x"], [], ["a", "b"]]
    rows = abuse.ids(rows)
    t = abuse.terms(rows)
    assert [(t[i] > 0).sum() for i in range(4)] == [6, 1, 0, 3]  # a b; ab ba; a_a b_b
    assert set(t[3][t[3] > 0]) < set(t[0]) and (abuse.terms(rows[3:])[0] == t[3][:3]).all()


def test_training_is_repeatable():
    a, b = (abuse.train(["A dry tremolo ruins the coda."] * 3, per_template=3) for _ in range(2))
    assert np.array_equal(a.machine.w, b.machine.w) and np.array_equal(a.machine.v, b.machine.v)


def test_rows(spark, model):
    df = spark.createDataFrame([(1, "s", "Go to hell, moron.", 0.1), (1, "s", "Go to hell, moron.", 0.1), (2, None, None, 0.2), (3, "s", "", 0.3)], "doc_id long, source string, text string, score double")
    got = sorted((r.doc_id, r.score >= 0.5) for r in abuse.scored(df, model).collect())
    assert got == [(1, True), (1, True), (2, False), (3, False)]
    assert abuse.scored(df.limit(0), model).count() == 0


def test_common_words_come_from_all_documents(spark, monkeypatch):
    """A word common in the corpus but not in the training sample isn't taken for the
    example word it resembles; a rare misspelling is, at any size of corpus."""
    monkeypatch.setattr(abuse, "SAMPLE_DOCS", 4)
    text = ["Una tapa de cedro suena bien."] * 5 + ["Eres un cerdo asqueroso."] * 8 + ["Eres un cerdoo asqueroso."] + ["A plain bar line stands here."] * 60
    for times in (1, 3):
        docs = spark.createDataFrame([(i, "s", t) for i, t in enumerate(text * times)], "doc_id long, source string, text string").repartition(3)
        common = abuse.common_words(docs, per_template=10)
        assert "cedro" in common and "cerdoo" not in common
        lexicon = abuse.Lexicon(abuse.example_counts(abuse.example_units(per_template=10)[0]) + common)
        assert lexicon.plain("cedro") == "cedro" and lexicon.plain("cerdoo") in ("cerdo", "cerdos")
    f = abuse.train([], per_template=3, common=common)
    assert f.lexicon.plain("cedro") == "cedro"
    assert abuse.common_words(docs.limit(0), per_template=3) == {}
