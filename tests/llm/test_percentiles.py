import math
import random

import pytest

from scoreloom.llm.percentiles import grade_number, merge_counts, percentiles, value_counts

POINTS = (0.0, 0.01, 0.25, 0.5, 0.9, 1.0)


def data(spark, n=400):
    rng = random.Random(3)
    rows = []
    for i in range(n):
        v = rng.choice([None, float("nan"), 0.0, -0.0, rng.paretovariate(1.1), -rng.random(), 3.5])
        rows.append((rng.choice(["a", "b", None]), rng.randrange(3), v, "clash"))
    return rows, spark.createDataFrame(rows, "g string, day int, x double, metric string").drop("metric")


def brute(rows):
    out = {}
    for g in {r[0] for r in rows}:
        v = sorted(r[2] for r in rows if r[0] == g and r[2] is not None and r[2] == r[2])
        for p in POINTS if v else ():
            out[(g, p)] = v[max(1, math.ceil(p * len(v))) - 1]
    return out


def test_exact_and_combined(spark):
    rows, df = data(spark)
    days = [value_counts(df.where(f"day = {d}"), ["g"], ["x"]) for d in range(3)]
    got = {(r.g, r.p): r.value for r in percentiles(merge_counts(days, ["g"]), ["g"], POINTS).collect()}
    assert got == brute(rows)


@pytest.mark.parametrize("error", [0.01, 0.2])
def test_bounded_error(spark, error):
    rows, df = data(spark)
    got = {(r.g, r.p): r.value for r in percentiles(value_counts(df, ["g"], ["x"], error), ["g"], POINTS).collect()}
    want = brute(rows)
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) <= error * abs(want[k]) * 1.000001 for k in want)


def test_no_values(spark):
    df = spark.createDataFrame([("a", None), ("a", float("nan"))], "g string, x double")
    assert percentiles(value_counts(df, ["g"], ["x"]), ["g"]).count() == 0
    assert percentiles(value_counts(df.limit(0), ["g"], ["x"]), ["g"]).count() == 0


def test_grades(spark):
    df = spark.createDataFrame([(g,) for g in ("5", " 05", "10 ", "010", "11", "0", "", None, "5a", " ")], "grade string")
    assert [r.g for r in df.select(grade_number("grade").alias("g")).collect()] == [5, 5, 10, 10, None, None, None, None, None, None]
