"""Whole grids of parameters in one pass: scores of all points, their AUC on each split, the best, and its transfer.

A point's scores come from arrays that all points share, so that a grid costs one reading; the AUCs of all points and
splits come from one job of running sums.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanspark.operators import ngram, ranking
from gleanspark.operators.losses import running
from gleanspark.sources.scratch import near, stash


def points(grid: Mapping[str, Sequence]) -> list[dict]:
    """All combinations, the last parameter fastest."""
    return [dict(zip(grid, values, strict=True)) for values in itertools.product(*grid.values())]


def signature(params: Mapping) -> str:
    """The parameters as text that does not depend on their order."""
    return json.dumps(params, sort_keys=True)


def _scored(df: DataFrame, score: Callable[..., Sequence[float | None]], of: Sequence[str]) -> DataFrame:
    """id, point (from 0) and score; ``score`` gives one for each point, none for texts that have none."""

    @F.pandas_udf("array<double>")
    def every(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([score(*row) for row in zip(*(batch[c] for c in batch), strict=True)], dtype=object)

    scores = df.select("id", F.posexplode(every(F.struct(*of))).alias("point", "score"))
    return scores.filter("score is not null")


def vote_grid(losses: DataFrame, grid: Sequence[Mapping]) -> DataFrame:
    """id, point and score of window votes; points have min_window, max_window and num_windows.

    Each window size that some points share is counted once.
    """
    sizes = [ngram.window_sizes(p["min_window"], p["max_window"], p["num_windows"]) for p in grid]
    every = sorted(set().union(*sizes))

    def score(uni: np.ndarray, bi: np.ndarray) -> list[float | None]:
        sums = running(uni - bi)
        share = {w: np.mean(sums[w:] > sums[:-w]) for w in every if w < len(sums)}
        held = [[share[w] for w in ws if w in share] for ws in sizes]
        return [float(np.mean(x)) if x else None for x in held]

    return _scored(losses, score, ("uni", "bi"))


def lowest_grid(values: DataFrame, grid: Sequence[Mapping], least: int = 1) -> DataFrame:
    """id, point and score: the mean of the lowest share ``k`` of an array r, for each point; one sort for all.

    Arrays of fewer than ``least`` entries have no score.
    """

    def score(r: np.ndarray) -> list[float | None]:
        if len(r) < least:
            return [None] * len(grid)
        sums = running(np.sort(r))
        counts = [max(1, int(np.floor(len(r) * p["k"]))) for p in grid]
        return [float(sums[n] / n) for n in counts]

    return _scored(values, score, ("r",))


def evaluate(scores: DataFrame, by: Sequence[str] = ("method", "point"), val: str = "val", test: str = "test") -> DataFrame:
    """by, val_auc and test_auc (each the better of both directions) of scores with label and split; null with one class."""
    aucs = ranking.roc_auc(scores, [*by, "split"])
    on = lambda s: F.max(F.when(F.col("split") == s, F.col("auc_dir")))
    return aucs.groupBy(*by).agg(on(val).alias("val_auc"), on(test).alias("test_auc"))


def best(evaluated: DataFrame, by: Sequence[str] = ("method",)) -> DataFrame:
    """Of each group the point of the highest val_auc, the first of equal ones; points without one are passed over."""
    row = F.struct("point", "val_auc", "test_auc")
    order = F.struct("val_auc", -F.col("point"))
    got = evaluated.filter("val_auc is not null").groupBy(*by).agg(F.max_by(row, order).alias("x"))
    return got.select(*by, "x.*")


def transfer(source: DataFrame, target: DataFrame) -> DataFrame:
    """method, point (best on the source), val_auc and test_auc there, test_auc of it and of the best on the target.

    Both are tables of ``evaluate``, as computed or as read back; ``gap`` is what the transfer loses.
    """
    chosen = near(stash(best(source), "chosen"))
    own = best(target).select("method", F.col("point").alias("own_point"), F.col("test_auc").alias("own_auc"))
    there = target.select("method", "point", F.col("test_auc").alias("transferred_auc"))
    joined = chosen.join(there, ["method", "point"], "left").join(own, "method", "left")
    return joined.withColumn("gap", F.col("own_auc") - F.col("transferred_auc"))


def stored(path: str, methods: Mapping[str, Sequence[Mapping]], run: Callable[[dict], DataFrame], spark) -> DataFrame:
    """The evaluation at ``path``; only methods whose points it lacks are run and added.

    ``run`` takes the missing methods and gives method, point, val_auc and test_auc.  Rows are kept by signature, so
    that grids in another order, or parts of them, are found again; ``point`` is the place in the grid asked for.
    """
    names = [(m, k, signature(p)) for m, grid in methods.items() for k, p in enumerate(grid)]
    wanted = spark.createDataFrame(names, "method string, point int, params string")
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    exists = jvm.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jvm)
    have = spark.read.parquet(path) if exists else None
    held = set() if have is None else {tuple(r) for r in have.select("method", "params").distinct().collect()}
    missing = {m: grid for m, grid in methods.items() if any((m, signature(p)) not in held for p in grid)}
    if missing:
        new = run(missing).join(F.broadcast(wanted), ["method", "point"])
        new.select("method", "params", "val_auc", "test_auc").write.mode("append").parquet(path)
        have = spark.read.parquet(path)
    latest = have.groupBy("method", "params").agg(F.max("val_auc").alias("val_auc"), F.max("test_auc").alias("test_auc"))
    return wanted.join(latest, ["method", "params"])
