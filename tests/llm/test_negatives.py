"""Hard negatives against a version that scores every pair of rows."""

import random

import numpy as np
import pytest

from plain_versions import hard_negatives
from vigilog.llm import negatives

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def vectors(n, width=6, seed=1, step=0.25):
    rng = random.Random(seed)
    return [(i, [rng.randrange(-4, 5) * step for _ in range(width)], rng.randrange(4)) for i in range(n)]


def check(spark, rows, **more):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = sorted(map(tuple, negatives.mine(df, **more).collect()), key=repr)
    assert got == hard_negatives(rows)
    return got


@pytest.mark.parametrize("shape", [(1, 1, 1), (7, 5, 9), (65, 33, 70), (3, 200, 5), (128, 64, 96)])
def test_strassen_is_exact(shape):
    m, k, n = shape
    rng = np.random.default_rng(3)
    a, b = rng.integers(-10**6, 10**6, (m, k)), rng.integers(-10**6, 10**6, (k, n))
    assert (negatives.strassen(a, b, leaf=4) == a @ b).all()


def test_many_ties(spark):
    assert check(spark, vectors(700))


def test_wide_vectors_and_several_tiles(spark, monkeypatch):
    monkeypatch.setattr(negatives, "TILE", 16)
    assert check(spark, vectors(450, width=40, seed=2, step=0.037))


def test_blocks_of_anchors(spark, monkeypatch):
    monkeypatch.setattr(negatives, "ANCHORS", 16)
    assert check(spark, vectors(4200, width=3, seed=4))


def test_one_vector_for_a_third_of_the_rows(spark):
    rows = [(i, [0.5, 0.5, 0.5] if i % 3 == 0 else v, g) for i, v, g in vectors(900, 3)]
    assert check(spark, rows)


def test_odd_rows(spark):
    rows = vectors(220, 4) + [
        (None, [1.0, 1.0, 1.0, 1.0], 1), (None, None, 1), (300, None, 1), (400, [1.0, None], 1),
        (500, [float("nan")] * 4, 1), (600, [float("inf"), 0.0, 0.0, 0.0], 1), (700, [], 2), (800, [1.0], 2),
        (900, [1.0, 1.0, 1.0, 1.0, 1.0, 1.0], None), (100, [1.0, 1.0, 1.0, 1.0], 3), (100, [1.0, 1.0, 1.0, 1.0], 3),
        (-100, [-1.0, -1.0, -1.0, -1.0], 3), (1000, [-0.001, 0.001, 0.0, 0.0], 0)]
    assert check(spark, rows)


def test_no_rows_no_anchors_and_clashing_names(spark):
    assert check(spark, []) == []
    assert check(spark, vectors(90)[1:]) == []
    rows = vectors(300)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr(
        "*", "1 AS number", "2 AS v", "3 AS id", "4 AS slot", "5 AS rank", "6 AS anchor_id")
    assert sorted(map(tuple, negatives.mine(df).collect()), key=repr) == hard_negatives(rows)


def test_scores_beyond_64_bits_are_an_error(spark):
    rows = [(0, [1e30], 1), (1, [1e30], 1)]
    with pytest.raises(Exception, match="64 bits|overflow|OVERFLOW"):
        negatives.mine(spark.createDataFrame(rows, SCHEMA)).collect()
