import random

import pytest

from leafmill.llm import reading_level
from leafmill.llm.lookalikes import Lookalikes

WORDS = {g: [f"{'simple' if g < 3 else 'learned'}{c}{g}" for c in "abcdefghijklmnopqrst"] for g in (1, 2, 3, 4)}


def text(rng, g, n=60):
    out = []
    for _ in range(n // 3):
        level = min(4, max(1, g + rng.choice((0, 0, 0, 0, -1, 1))))
        out += ["the", rng.choice(WORDS[level]), rng.choice(("of", "and", "in"))]
    return " ".join(out)


@pytest.fixture(scope="module")
def shelf():
    rng = random.Random(1)
    return [(i, text(rng, 1 + i % 4), 1 + i % 4) for i in range(600)]


def levels(spark, docs, grades):
    d = spark.createDataFrame(docs, "doc_id long, text string, grade string")
    g = spark.createDataFrame(grades, "doc_id long, rater string, grade int")
    return {r.doc_id: r.grade for r in reading_level.reading_levels(d, g, Lookalikes.fit(d, usual_first=True)).collect()}


def test_held_out_grades(spark, shelf):
    rng = random.Random(2)
    grades = [(i, f"r{k}", g if rng.random() < 0.9 else min(4, g + 1)) for i, _, g in shelf[:200] for k in range(2)] + [(0, "r9", None), (9999, "r1", 2), (1, "r0", 2)]
    odd = [(1000, None, "x"), (1001, "", "x"), (1002, "the of and " * 5, "x"), (1003, "la carte de la barque et le pont " * 20, "x"), (1004, "旧地图" * 200, "x"), (None, "the of", "x")]
    got = levels(spark, [(i, t, "x") for i, t, _ in shelf] + odd + [(0, shelf[0][1], "again")], grades)
    assert set(got) == {i for i, _, _ in shelf}
    assert sum(got[i] == g for i, _, g in shelf[200:]) >= 0.95 * 400


def test_no_documents_and_no_grades(spark, shelf):
    assert levels(spark, [], []) == {}
    got = levels(spark, [(i, t, "x") for i, t, _ in shelf[:80]], [])
    assert len(got) == 80 and set(got.values()) <= {1, 2, 3, 4}


@pytest.mark.parametrize("grades", [[], [(i, "r1", None) for i in range(600)]])
def test_no_usable_grades_give_equal_parts(spark, shelf, grades):
    """Hard words are the longer ones here, as mostly."""
    longer = [(i, t.replace("learned", "extraordinarily"), "x") for i, t, _ in shelf]
    got = levels(spark, longer, grades)
    assert all(110 <= sum(g == k for g in got.values()) <= 190 for k in (1, 2, 3, 4))
    assert sum(got[i] for i, _, g in shelf if g == 4) > sum(got[i] for i, _, g in shelf if g == 1) + 300
