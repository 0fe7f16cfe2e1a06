import pytest

from scoreloom.llm.capping import capped

SCHEMA = "candidate_id string, source string, title string, composer_normalized string, quality_score double, graded_at string, kept string"


def brute(rows, least, share):
    """Plain loops over the same rows."""
    inf = float("inf")
    last = {}
    for r in rows:
        cid, src, _, comp, q, at, _ = r
        if cid is None:
            continue
        score = -inf if q is None or q != q else q
        key = ((at is not None, at or ""), score, (src is not None, src or ""), (comp is not None, comp or ""))
        if cid not in last or key > last[cid][0]:
            last[cid] = (key, r)
    n, groups = len(last), {}
    for cid, (_, r) in last.items():
        comp = " ".join((r[3] or "").lower().replace(" ", " ").split())
        src = " ".join((r[1] or "").lower().replace(" ", " ").split())
        if comp:
            q = r[4]
            groups.setdefault((src, comp), []).append((inf if q is None or q != q else -q, cid))
    cap = max(least, n // share)
    return {cid for g in groups.values() for _, cid in sorted(g)[cap:]}


@pytest.mark.parametrize("salts", [1, 3])
def test_against_loops(spark, salts):
    import random

    rng = random.Random(9)
    rows = []
    for i in range(600):
        comp = "Hot  One" if i % 3 == 0 else rng.choice(["hot one ", "B", "b ", None, " ", "C d", "c\td"])
        q = rng.choice([None, float("nan"), 0.5, 0.5, round(rng.random(), 2), 1.0, 0.0])
        rows.append((f"id{rng.randrange(450)}", rng.choice(["Src", " src", "other", None]), "t", comp, q, rng.choice(["2024-01-01", "2024-01-02", None]), "clash"))
    rows += rows[:50] + [(None, "src", "t", "B", 1.0, "2024", "x")]
    df = spark.createDataFrame(rows, SCHEMA).drop("kept")
    got = capped(df, salts, 3, 20)
    assert {r.candidate_id for r in got.where("not kept").collect()} == brute(rows, 3, 20)
    assert got.count() == len({r[0] for r in rows if r[0]})


def test_small_and_empty(spark):
    rows = [(c, "s", "t", "A", q, "1", "x") for c, q in (("a", 1.0), ("b", None), ("c", float("nan")), ("d", 0.0))]
    df = spark.createDataFrame(rows, SCHEMA).drop("kept")
    assert [r.candidate_id for r in capped(df).where("not kept").collect()] == ["c"]
    assert capped(df.limit(0)).count() == 0
