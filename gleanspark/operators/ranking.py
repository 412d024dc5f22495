"""Precision at k, rank statistics and thresholds over long score tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleanspark.operators.running import quantiles, running
from gleanspark.sources.scratch import near, stash


def unpivot(
    df: DataFrame, keys: Sequence[str], values: Sequence[str], name: str = "metric", value: str = "score"
) -> DataFrame:
    return df.unpivot(list(keys), list(values), name, value)


def precision_at_k(
    df: DataFrame,
    by: Sequence[str],
    ks: Sequence[int],
    *,
    score: str = "score",
    label: str = "label",
    order: str = "i",
    lower_better: bool = True,
    finite_only: bool = False,
) -> DataFrame:
    """by, k, precision, n: the mean label of the k best rows; no row where k exceeds the group.

    NaN scores come last when low is better and first otherwise, as an argsort has them; ``finite_only`` drops
    them first.  Ties go by ``order``.  Groups are ranked once for all k; only the best rows are kept per group.
    """
    if finite_only:
        df = df.filter(~F.isnan(score) & (F.abs(score) != float("inf")))
    w = Window.partitionBy(*by)
    by_score = [F.asc(score), F.asc(order)] if lower_better else [F.desc(score), F.desc(order)]
    top = df.withColumn("_rank", F.row_number().over(w.orderBy(*by_score))).filter(F.col("_rank") <= max(ks))
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    sums = top.groupBy(*by).agg(*(F.sum(F.when(F.col("_rank") <= k, F.col(label))).alias(f"_{k}") for k in ks))
    rows = sizes.join(sums, list(by)) if by else sizes.crossJoin(sums)
    each = F.explode(
        F.array(
            *(F.struct(F.lit(k).alias("k"), (F.col(f"_{k}") / F.lit(float(k))).alias("precision")) for k in ks if k > 0)
        )
    )
    return rows.select(*by, "n", each.alias("_p")).select(
        *by, "_p.k", "_p.precision", "n"
    ).filter(F.col("k") <= F.col("n"))


def precision_report(
    df: DataFrame,
    by: Sequence[str],
    ks: Sequence[int],
    *,
    score: str = "score",
    label: str = "label",
    order: str = "i",
    lower_better: bool = True,
    finite_only: bool = False,
    expected: DataFrame | None = None,
) -> DataFrame:
    """by, k, precision, n_samples, n_labeled, n_positive, n_negative and status, a row for each group and k.

    With ``finite_only`` rows without a finite score are left out first, and n_samples counts what is left; otherwise
    they rank like NaN.  precision is null where k exceeds the group, where one of the k best has no label, or where the
    group has no finite score (or, unless ``finite_only``, no label).  ``expected`` has the groups to report on, with
    status "no samples" where there are none.
    """
    value = F.coalesce(F.col(score).cast("double"), F.lit(float("nan")))
    rows = df.withColumn("_s", value).withColumn("_ok", ~F.isnan("_s") & (F.abs("_s") != float("inf")))
    totals = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_all"), F.count_if("_ok").alias("_finite"))
    used = rows.filter("_ok") if finite_only else rows
    best = [F.asc("_s"), F.asc(order)] if lower_better else [F.desc("_s"), F.desc(order)]
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*best))
    top = used.withColumn("_r", rank).filter(F.col("_r") <= max(ks))
    hits = lambda k: F.when(F.count(F.when(F.col("_r") <= k, F.col(label))) == k, F.sum(F.when(F.col("_r") <= k, F.col(label))) / float(k))
    sums = top.groupBy(*by).agg(*(hits(k).alias(f"_{k}") for k in ks))
    counts = used.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_used"),
        F.count(label).alias("n_labeled"),
        F.count_if(F.col(label) == 1).alias("n_positive"),
    )
    joined = _join_nulls(_join_nulls(totals, counts, by), sums, by)
    if expected is not None:
        joined = _join_nulls(expected.select(*by), joined, by)
    n, none = F.coalesce("_used", "_all", F.lit(0)), F.lit(0).cast("long")
    bad = F.col("_finite") == 0 if finite_only else (F.col("_finite") == 0) | (F.coalesce("n_labeled", none) == 0)
    words = "no finite scores" if finite_only else "no valid scores or labels"
    status = F.when(F.col("_all").isNull(), "no samples").when(bad, words).otherwise("ok")
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"_{k}").alias("p")) for k in ks)))
    out = joined.select("*", status.alias("status"), each.alias("_e"))
    return out.select(
        *by,
        "_e.k",
        F.when(F.col("status") == "ok", F.col("_e.p")).alias("precision"),
        n.cast("long").alias("n_samples"),
        F.coalesce("n_labeled", none).alias("n_labeled"),
        F.coalesce("n_positive", none).alias("n_positive"),
        (F.coalesce("n_labeled", none) - F.coalesce("n_positive", none)).alias("n_negative"),
        "status",
    )


def _join_nulls(a: DataFrame, b: DataFrame, by: Sequence[str]) -> DataFrame:
    """Left join on ``by``, nulls being equal."""
    other = b.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(by)), *(c for c in b.columns if c not in by))
    if not by:
        return a.crossJoin(F.broadcast(other))
    same = reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(by)))
    return a.join(other, same, "left").drop(*(f"_k{i}" for i in range(len(by))))


def average_ranks(df: DataFrame, by: Sequence[str], score: str, name: str) -> DataFrame:
    """``df`` with the rank of its score in its group, ties averaged; ranks come from counts of distinct scores."""
    counts = df.groupBy(*by, score).agg(F.count(F.lit(1)).alias("_c"))
    ranked = running(counts, by, [score], {"_below": F.col("_c")})
    ranks = ranked.select(*by, score, (F.col("_below") + (F.col("_c") + 1) / F.lit(2.0)).alias(name))
    return _join_nulls(df, ranks, [*by, score])


def roc_auc(df: DataFrame, by: Sequence[str], *, score: str = "score", label: str = "label") -> DataFrame:
    """by, auc, auc_dir (the better of both directions), n_pos, n_neg; null with one class only.

    Scores are counted first; wins then come from running sums over ranges of distinct scores.
    """
    counts = df.groupBy(*by, score).agg(F.sum(label).alias("p"), F.sum(1 - F.col(label)).alias("q"))
    below = running(counts, by, [score], {"below": F.col("q")})
    wins = below.withColumn("u", F.col("p") * (F.col("below") + F.col("q") / F.lit(2.0)))
    positive, negative = F.sum("p").cast("long").alias("n_pos"), F.sum("q").cast("long").alias("n_neg")
    got = wins.groupBy(*by).agg(F.sum("u").alias("u"), positive, negative)
    auc = F.try_divide(F.col("u"), (F.col("n_pos") * F.col("n_neg")).cast("double"))
    return got.select(*by, auc.alias("auc"), F.greatest(auc, 1 - auc).alias("auc_dir"), "n_pos", "n_neg")


def oriented(
    df: DataFrame, by: Sequence[str], split: str = "split", on: str = "val", score: str = "score"
) -> DataFrame:
    """``df`` with scores negated where that gives the better AUC on the rows of split ``on``."""
    flips = roc_auc(df.filter(F.col(split) == on), by, score=score)
    flips = flips.select(*by, F.coalesce(F.col("auc") < 0.5, F.lit(False)).alias("_flip"))
    joined = _join_nulls(df, near(stash(flips, "directions")), by)
    return joined.withColumn(score, F.when(F.col("_flip"), -F.col(score)).otherwise(F.col(score))).drop("_flip")


def spearman(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """a, b, rho of each pair of columns; null where a column is constant."""
    ranked = df.select(*columns)
    for c in columns:
        ranked = average_ranks(ranked, (), c, f"_rank_{c}")
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    varied = lambda c: F.stddev_pop(f"_rank_{c}") >= 1e-12
    rho = [
        F.struct(
            F.lit(a).alias("a"),
            F.lit(b).alias("b"),
            F.when(varied(a) & varied(b), F.corr(f"_rank_{a}", f"_rank_{b}")).alias("rho"),
        )
        for a, b in pairs
    ]
    row = ranked.agg(*(r.alias(f"_{i}") for i, r in enumerate(rho)))
    return row.select(F.explode(F.array(*(f"_{i}" for i in range(len(pairs))))).alias("_r")).select("_r.*")


def best_threshold(
    df: DataFrame, by: Sequence[str], *, score: str = "score", label: str = "label", higher: bool = True
) -> DataFrame:
    """by, threshold, balanced_accuracy: the best midpoint of neighbouring distinct scores, the smallest on ties.

    Scores are counted first, so that one sweep of running sums tries every midpoint.
    """
    counts = df.groupBy(*by, score).agg(F.sum(label).alias("p"), F.sum(1 - F.col(label)).alias("q"))
    totals = df.groupBy(*by).agg(F.sum(label).alias("pt"), F.sum(1 - F.col(label)).alias("qt"))
    below = running(counts, by, [score], {"pl": F.col("p"), "ql": F.col("q"), "_n": F.lit(1).cast("long")})
    above = below.select(*by, F.col("_n"), F.col(score).alias("_next"), "pl", "ql")
    pairs = _join_nulls(
        above, below.select(*by, (F.col("_n") + 1).alias("_n"), F.col(score).alias("_low")), [*by, "_n"]
    )
    s = _join_nulls(pairs.filter(F.col("_low").isNotNull()), totals, by).filter("pt > 0 and qt > 0")
    right = (F.col("ql") / F.col("qt") + (F.col("pt") - F.col("pl")) / F.col("pt")) / 2
    tried = s.select(
        *by,
        ((F.col("_low") + F.col("_next")) / 2).alias("threshold"),
        F.round(right if higher else 1 - right, 12).alias("balanced_accuracy"),
    )
    first = F.struct(-F.col("balanced_accuracy"), F.col("threshold"))
    best = tried.groupBy(*by).agg(F.min_by(F.struct("threshold", "balanced_accuracy"), first).alias("_b"))
    return best.select(*by, "_b.*")


def balanced_accuracy(
    df: DataFrame, by: Sequence[str], *, label: str = "label", predicted: str = "predicted"
) -> DataFrame:
    """by and balanced_accuracy: the mean of both classes' recalls; 0 where a class is empty."""
    right = lambda v: F.count_if((F.col(label) == v) & (F.col(predicted) == v)) / F.count_if(F.col(label) == v)
    both = (F.count_if(F.col(label) == 0) > 0) & (F.count_if(F.col(label) == 1) > 0)
    return df.groupBy(*by).agg(F.when(both, (right(0) + right(1)) / 2).otherwise(0.0).alias("balanced_accuracy"))


def _medians(df: DataFrame, by: Sequence[str], score: str, label: str) -> DataFrame:
    """by and the medians _0 and _1 of both classes; nothing for groups without scores."""
    each = quantiles(df.filter(F.col(label).isin(0, 1)), score, [0.5], [*by, label])
    of = lambda v: F.max(F.when(F.col(label) == v, F.col("q")[0])).alias(f"_{v}")
    return each.groupBy(*by).agg(of(0), of(1))


def class_medians(df: DataFrame, by: Sequence[str], *, score: str = "score", label: str = "label") -> DataFrame:
    """by, median_0, median_1 and their midpoint; with one class only, that class's median (fallback)."""
    got = _join_nulls(df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")), _medians(df, by, score, label), by).drop("_n")
    got = got.withColumnsRenamed({"_0": "median_0", "_1": "median_1"})
    return got.withColumn("midpoint", F.coalesce((F.col("median_0") + F.col("median_1")) / 2, "median_1", "median_0"))


def midpoint_threshold(
    df: DataFrame, by: Sequence[str], *, score: str = "score", label: str = "label", higher: bool = True
) -> DataFrame:
    """by and threshold: the midpoint of the classes' medians or, where that puts all rows on one side, the median of
    the class beyond it; null where that does too, and with one class only."""
    ends = df.groupBy(*by).agg(F.min(score).alias("_low"), F.max(score).alias("_high"))
    got = _join_nulls(ends, _medians(df, by, score, label), by)
    splits = lambda t: (F.col("_high") > t) & (F.col("_low") <= t) if higher else (F.col("_low") < t) & (F.col("_high") >= t)
    middle, other = (F.col("_0") + F.col("_1")) / 2, F.col("_1" if higher else "_0")
    found = F.when(splits(middle), middle).when(splits(other) & middle.isNotNull(), other)
    return got.select(*by, found.alias("threshold"))


def majority_threshold(
    df: DataFrame, by: Sequence[str], *, score: str = "score", label: str = "label", higher: bool = True
) -> DataFrame:
    """by and threshold: one that gives all rows the majority's label (0 on ties), just outside the scores."""
    member = F.count_if(F.col(label) == 1) > F.count_if(F.col(label) == 0)
    eps = F.lit(1e-9) * F.greatest(F.lit(1.0), F.abs(F.max(score)))
    below = member if higher else ~member
    return df.groupBy(*by).agg(F.when(below, F.min(score) - eps).otherwise(F.max(score) + eps).alias("threshold"))


def calibrated_threshold(
    df: DataFrame, by: Sequence[str], *, score: str = "score", label: str = "label", higher: bool = True
) -> DataFrame:
    """by, threshold and method: the best midpoint, else the medians' midpoint, else the majority's side."""
    names = {"score": score, "label": label, "higher": higher}
    best = best_threshold(df, by, **names).select(*by, F.col("threshold").alias("_best"))
    middle = midpoint_threshold(df, by, **names).withColumnRenamed("threshold", "_middle")
    every = majority_threshold(df, by, **names).withColumnRenamed("threshold", "_every")
    joined = _join_nulls(_join_nulls(every, middle, by), best, by)
    method = F.when(F.col("_best").isNotNull(), "sweep").when(
        F.col("_middle").isNotNull(), "medians"
    ).otherwise("majority")
    return joined.select(*by, F.coalesce("_best", "_middle", "_every").alias("threshold"), method.alias("method"))


def threshold_label(score: Column, threshold: Column, higher: bool = True) -> Column:
    return (score > threshold if higher else score < threshold).cast("int")


def proxy_label(
    df: DataFrame, by: Sequence[str], threshold: float | None = None, *, score: str = "score", higher: bool = True
) -> DataFrame:
    """``df`` with label: whether a score lies strictly beyond the threshold, or without one beyond its group's median.

    Null in degenerate groups: fewer than 2 rows (4 for the median), constant scores, or one side empty.
    """
    aggs = [F.count(score).alias("_n"), F.min(score).alias("_low"), F.max(score).alias("_high")]
    ends = df.groupBy(*by).agg(*aggs)
    if threshold is None:
        ends = _join_nulls(ends, quantiles(df, score, [0.5], by).select(*by, F.col("q")[0].alias("_t")), by)
    else:
        ends = ends.withColumn("_t", F.lit(float(threshold)))
    joined = _join_nulls(df, ends, by)
    t = F.col("_t")
    both = (F.col("_high") > t) & (F.col("_low") <= t) if higher else (F.col("_low") < t) & (F.col("_high") >= t)
    usable = both & (F.col("_n") >= (4 if threshold is None else 2)) & (F.col("_low") < F.col("_high"))
    label = F.when(usable, threshold_label(F.col(score), t, higher))
    return joined.withColumn("label", label).drop("_t", "_n", "_low", "_high")


def median_label(df: DataFrame, by: Sequence[str], *, score: str = "score", higher: bool = True) -> DataFrame:
    return proxy_label(df, by, score=score, higher=higher)
