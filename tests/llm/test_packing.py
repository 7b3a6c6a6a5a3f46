import itertools
import random

import numpy as np
import pytest

from leafmill.llm import packing


def optimum(sizes, capacity):
    """Fewest containers by exhaustive search."""
    for n in range(1, len(sizes) + 1):
        for where in itertools.product(range(n), repeat=len(sizes)):
            if max(np.bincount(where, sizes, n)) <= capacity:
                return n
    return 0


def test_bound_is_below_the_optimum_and_fit_above():
    rng = random.Random(3)
    for _ in range(60):
        sizes = np.array([rng.randint(1, 20) for _ in range(rng.randint(1, 6))])
        best = optimum(sizes, 20)
        bins = packing.best_fit_decreasing(sizes, 20)
        assert packing.lower_bound(sizes, np.ones(len(sizes)), 20) <= best <= bins.max() + 1
        assert np.bincount(bins, sizes).max() <= 20


def test_bound_is_tight_where_sums_are_not():
    assert packing.lower_bound(np.array([11, 12, 13]), np.array([4, 1, 1]), 20) == 6


@pytest.mark.parametrize("target", [10**9, 300])
def test_everything_is_packed_once(spark, target):
    rng = random.Random(5)
    sizes = [(i, rng.choice([0, 1, 7, 30, 64, 99, 100, 101, 250, 333])) for i in range(400)] + [(0, 5)]
    df = spark.createDataFrame(sizes, "doc_id long, tokens long")
    rows = packing.pack(df, capacity=100, target=target).collect()
    whole = {}
    for i, n in sizes:
        whole[i] = max(n, whole.get(i, 0))
    fill, got, parts = {}, {}, {}
    for r in rows:
        fill[r.container] = fill.get(r.container, 0) + r.tokens
        got[r.doc_id] = got.get(r.doc_id, 0) + r.tokens
        parts.setdefault(r.doc_id, []).append(r.part)
    assert got == whole and max(fill.values()) <= 100
    assert all(sorted(p) == list(range(len(p))) for p in parts.values())
    assert all(len(parts[i]) == 1 for i, n in whole.items() if n <= 100)
    assert len(fill) <= 1.06 * sum(whole.values()) / 100 + 3


def test_no_items(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, tokens long")).count() == 0


def test_tokens_of_odd_texts(spark):
    docs = spark.createDataFrame([(1, "one two"), (2, ""), (3, None), (None, "x"), (4, "<|endoftext|>"), (5, "词" * 5000)], "doc_id long, text string")
    got = {r.doc_id: r.tokens for r in packing.sizes(docs).collect()}
    assert set(got) == {1, 2, 4, 5} and got[1] == 2 and got[2] == 0 and got[4] > 1 and got[5] >= 5000


def test_bound_is_tight_for_equal_sizes():
    for size, number, least in ((700, 6000, 3000), (520, 6000, 2000), (1000, 7, 4), (683, 3001, 1501)):
        assert packing.lower_bound(np.array([size]), np.array([number]), 2048) == least


def test_groups_stay_small_whatever_the_gap(spark):
    """Sizes with a wide gap between bound and optimum: what a group holds doesn't grow with the corpus."""
    rng = random.Random(9)
    largest = []
    for n in (2000, 20_000):
        df = spark.createDataFrame([(i, rng.randint(600, 759)) for i in range(n)], "doc_id long, tokens long")
        report = []
        assert packing.pack(df, target=150_000, report=report).select("doc_id").distinct().count() == n
        assert [r["containers"] for r in report] == sorted((r["containers"] for r in report), reverse=True)
        largest.append(max(r["items"] for r in report[1:]))
        assert all(r["tokens"] <= 150_000 for r in report[1:])
    assert largest[1] <= 150_000 // 600


def test_equal_sizes_are_certified_almost_without_exchange(spark):
    df = spark.range(8000).selectExpr("id as doc_id", "700L as tokens")
    report = []
    used = packing.pack(df, target=150_000, report=report).select("container").distinct().count()
    assert used == report[-1]["containers"] == report[-1]["bound"] == 4000


def test_many_items_without_tokens_are_spread(spark):
    df = spark.range(5000).selectExpr("id as doc_id", "0L as tokens")
    report = []
    assert packing.pack(df, most=500, report=report).count() == 5000
    assert max(r["items"] for r in report) < 700
