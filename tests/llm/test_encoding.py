import random

import pytest

tiktoken = pytest.importorskip("tiktoken")

from scoreloom.llm import encoding as E  # noqa: E402

try:
    ENC = E.encoder(E.FOLDER, E.VOCABULARY)
except FileNotFoundError:
    pytest.skip("no vocabulary", allow_module_level=True)
OWN = tiktoken.Encoding("t", pat_str=ENC.words.pattern, mergeable_ranks=ENC.ranks, special_tokens={})
TEXTS = ["", " ", "Hello world", "<|endoftext|> x", "a" * 5000, " " * 3000 + "x", "日本語のギター🎸", "naïve​ café\r\n\t", "1234567890" * 50, "don't we'll I'M", "é" * 2000, "\x00\x01", "­soft"]


@pytest.mark.parametrize("t", TEXTS)
def test_as_the_public_library(t):
    assert ENC.encode(t) == OWN.encode_ordinary(t)
    assert OWN.decode(ENC.encode(t)) == t


def test_random_texts():
    rng = random.Random(1)
    for _ in range(1500):
        t = "".join(rng.choice("ab eé\n\t .,'st漢🎸0<|>-_") for _ in range(rng.randrange(200)))
        assert ENC.encode(t) == OWN.encode_ordinary(t)


def test_fragments_never_cut_a_token():
    assert b"".join(ENC.fragments(" Straße".encode())) == " Straße".encode()
    for tok in list(ENC.ranks)[::97]:
        assert ENC.fragments(tok) == [tok]


def test_rows(spark):
    df = spark.createDataFrame([(1, "Hi", "x"), (2, None, "x"), (3, "", "x"), (3, "", "x")], "doc_id long, text string, ids string")
    got = sorted((r.doc_id, r.ids) for r in E.encoded(df).collect())
    assert got == [(1, OWN.encode("Hi")), (2, []), (3, []), (3, [])]
    assert E.encoded(df.limit(0)).count() == 0
