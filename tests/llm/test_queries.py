"""The queries against SQL where there is SQL, and all of them on the smallest tables."""

import os

import pytest

from scoreloom.llm.queries import QUERIES, SQL
from scoreloom.plans.ship import ship
from tests.compare import DATA, differences

BASE = f"{DATA}/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(BASE), reason="no test tables")


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, name):
    ship(spark)
    assert differences(spark, name, QUERIES[name], SQL[name], BASE) is None


COLUMNS = {
    "p1_found": "candidate_id", "p2_found": "name_a name_b", "p3_found": "candidate_a candidate_b", "p7_found": "raw_composer composer", "p8_ids": "doc_id ids", "p9_found": "doc_id item_id", "p10_found": "doc_id",
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_found_has_its_columns_and_no_repeated_rows(spark, name):
    ship(spark)
    df = QUERIES[name](spark, BASE)
    assert df.columns == COLUMNS[name].split()
    rows = [tuple(map(str, r)) for r in df.collect()]
    assert rows and len(rows) == len(set(rows))


def test_no_match_lies_in_two_splits(spark):
    """Matched pieces, and equal spellings of a composer that is somebody, share a split."""
    from pyspark.sql import functions as F

    from scoreloom.llm.names import parse

    ship(spark)
    split = {r.candidate_id: r.split for r in QUERIES["p6_split"](spark, BASE).collect()}
    pairs = QUERIES["p3_found"](spark, BASE).collect()
    assert pairs and all(split[r.candidate_a] == split[r.candidate_b] for r in pairs)
    rows = spark.read.parquet(f"{BASE}/dummy_advisor_grades.parquet").groupBy("candidate_id").agg(F.max_by("composer_normalized", F.struct("graded_at", "title", "composer_normalized")).alias("c")).collect()
    of = {}
    for r in rows:
        if parse(r.c).kind == "person":
            of.setdefault(r.c, set()).add(split[r.candidate_id])
    assert of and all(len(s) == 1 for s in of.values())
