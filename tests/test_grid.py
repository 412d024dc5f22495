"""Grids of parameters against one point at a time, and evaluations that are kept by signature."""

import math
import random

import pytest
from pyspark.sql import functions as F

from gleanspark.operators import grid, losses, ngram

POINTS = grid.points({"min_window": [2], "max_window": [5, 9], "num_windows": [1, 3]})


def table(spark, n=30):
    rng = random.Random(1)
    rows = [(i, [rng.random() for _ in range(k)], [rng.random() for _ in range(k)]) for i in range(n) for k in [i % 12]]
    return spark.createDataFrame(rows, "id long, uni array<double>, bi array<double>")


def test_points_and_signature():
    assert POINTS[1] == {"min_window": 2, "max_window": 5, "num_windows": 3} and len(POINTS) == 4
    assert grid.signature({"b": 1, "a": [2]}) == grid.signature({"a": [2], "b": 1})


def test_grid_equals_single_points(spark):
    df = table(spark)
    got = {(r.id, r.point): r.score for r in grid.vote_grid(df, POINTS).collect()}
    for k, p in enumerate(POINTS):
        one = dict(losses.window_vote(df, ngram.window_sizes(*p.values())).collect())
        assert {i: s for (i, q), s in got.items() if q == k} == pytest.approx(one)
    low = grid.lowest_grid(df.select("id", F.col("bi").alias("r")), [{"k": 0.1}, {"k": 0.5}], least=3).collect()
    for r in low:
        mine = sorted(df.filter(f"id = {r.id}").first().bi)
        mine = mine[: max(1, math.floor(len(mine) * (0.1, 0.5)[r.point]))]
        assert r.score == pytest.approx(sum(mine) / len(mine))
    assert {r.id % 12 for r in low} == set(range(3, 12))


def test_best_transfer_and_ties(spark):
    schema = "method string, point int, val_auc double, test_auc double"
    a = spark.createDataFrame([("x", 0, 0.7, 0.6), ("x", 1, 0.9, 0.5), ("x", 2, 0.9, 0.8), ("y", 0, None, 0.5)], schema)
    b = spark.createDataFrame([("x", 0, 0.8, 0.75), ("x", 1, 0.6, 0.55), ("x", 2, 0.5, 0.5)], schema)
    assert [tuple(r) for r in grid.best(a).collect()] == [("x", 1, 0.9, 0.5)]
    row = grid.transfer(a, b).first()
    assert (row.point, row.transferred_auc, row.own_point, row.own_auc) == (1, 0.55, 0, 0.75)
    assert row.gap == pytest.approx(0.2) and grid.transfer(a.limit(0), b).count() == 0


def test_stored_evaluations_run_once(spark, tmp_path):
    ran = []

    def run(methods):
        ran.append(sorted(methods))
        rows = [(m, k, 0.5 + k / 10, 0.5) for m, g in methods.items() for k in range(len(g))]
        return spark.createDataFrame(rows, "method string, point int, val_auc double, test_auc double")

    path = f"file://{tmp_path}/kept"
    first = grid.stored(path, {"wbc": POINTS}, run, spark)
    assert first.count() == 4 and ran == [["wbc"]]
    again = grid.stored(path, {"wbc": POINTS[::-1]}, run, spark)
    assert ran == [["wbc"]] and {(r.point, r.val_auc) for r in again.collect()} == {(3, 0.5), (2, 0.6), (1, 0.7), (0, 0.8)}
    grid.stored(path, {"wbc": POINTS, "low": [{"k": 0.1}]}, run, spark)
    assert ran == [["wbc"], ["low"]]
