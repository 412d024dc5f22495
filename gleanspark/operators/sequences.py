"""Positional comparisons, decoding adjustments and features of vectors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleanspark.functions.text import cosine, entropy01, let, minmax01, norm, penalty, sigmoid, softmax, total
from gleanspark.operators.running import quantiles
from gleanspark.sources.scratch import near, stash


def overlap(a: Column, b: Column) -> Column:
    """Share of equal places over the shorter length; 0 if that is 0."""
    n = F.least(F.size(a), F.size(b))
    same = F.size(
        F.filter(F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x == y), lambda x: x)
    )
    return F.when(n > 0, same / n).otherwise(0.0)


def common_prefix(a: Column, b: Column) -> Column:
    n = F.least(F.size(a), F.size(b))
    at = F.array_position(F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x == y), False)
    return F.when(n < 1, F.lit(0)).when(at == 0, n).otherwise(at - 1).cast("int")


def explored(scores: Column, share: Column | float) -> Column:
    """The distribution that a step draws from, with a share of it spread evenly."""
    share = F.lit(share) if isinstance(share, float) else share
    p = lambda s: F.zip_with(softmax(scores), F.sequence(F.lit(1), F.size(scores)), lambda x, _: (1 - s) * x + s / F.size(scores))
    return let(share, p)


def cheap_logits(lp: Column, strength: float, scale: float, sign: float = 1.0) -> Column:
    """Log-probabilities less a penalty that grows with confidence."""
    return let(
        entropy01(softmax(lp)),
        lambda h: F.zip_with(
            lp, minmax01(lp), lambda x, m: x - F.lit(strength * sign) * (1 + F.lit(scale) * (1 - h)) * m
        ),
    )


def mean_gate(a: Column, b: Column, gamma: float) -> Column:
    """Sigmoid of the mean difference of two arrays."""
    return sigmoid(F.lit(gamma) * total(F.zip_with(a, b, lambda x, y: y - x)) / F.size(a))


def contrastive(target: Column, reference: Column | None, strength: float, gamma: float) -> Column:
    """Log-probabilities moved along the difference to the target, gated by its mean.

    Where there is no reference of the same words (None, null or of another length): the cheap adjustment.
    """
    cheap = cheap_logits(target, 0.35, 0.5)
    if reference is None:
        return cheap
    moved = let(
        mean_gate(target, reference, gamma),
        lambda g: F.zip_with(target, reference, lambda t, r: t + F.lit(strength) * g * (r - t)),
    )
    return F.when(reference.isNotNull() & (F.size(reference) == F.size(target)), moved).otherwise(cheap)


def gated(
    lp: Column,
    risks: Column,
    prefix: Column,
    strength: float,
    gamma: float,
    aux: float = 0.0,
    mode: str = "delta",
    sign: float = 1.0,
) -> Column:
    """Log-probabilities less a capped penalty of the candidates' risks, gated by the prefix's risk (slow and fast)."""
    pen = penalty(risks, prefix, mode)
    side = minmax01(lp) if aux > 0 else F.transform(lp, lambda x: F.lit(0.0))
    both = F.zip_with(pen, side, lambda g, a: F.least(F.lit(1.0), g + F.lit(aux) * a))
    return let(
        sigmoid(F.lit(gamma) * prefix), lambda w: F.zip_with(lp, both, lambda x, g: x - F.lit(strength * sign) * w * g)
    )


def legacy_fast(lp: Column, prefix: Column, strength: float, gamma: float, sign: float = 1.0) -> Column:
    """The fast mode without candidates' risks: penalties by the log-probabilities themselves."""
    return let(
        sigmoid(F.lit(gamma) * prefix),
        lambda w: F.zip_with(lp, minmax01(lp), lambda x, m: x - F.lit(strength * sign) * w * m),
    )


def refreshed(step: Column, every: int, first: Column) -> Column:
    """Whether a cached risk is computed anew: each ``every`` steps, and at the first step."""
    return F.lit(True) if every <= 1 else (step % every == 0) | first


def cached(value: str, refresh: Column, by: str, step: str) -> Column:
    """The value of the latest refreshed step of the same prompt."""
    w = Window.partitionBy(by).orderBy(step).rowsBetween(Window.unboundedPreceding, 0)
    return F.last(F.when(refresh, F.col(value)), ignorenulls=True).over(w)


def sparse_risks(lp: Column, risks: Column, prefix: Column, top: int, scored: Column) -> Column:
    """Risks of the ``top`` likeliest candidates where the step scores any; the prefix's risk for all others."""
    order = F.array_sort(F.transform(lp, lambda x, i: F.struct((-x).alias("v"), i.alias("i"))))
    best = F.transform(F.slice(order, 1, max(top, 1)), lambda s: s["i"])
    return let(
        best,
        lambda b: F.transform(
            risks, lambda r, i: F.when(scored & F.array_contains(b, i) & F.lit(top > 0), r).otherwise(prefix)
        ),
    )


def vote_gate(
    lp: Column,
    reference: Column | None,
    risks: Column | None,
    prefix: Column,
    vote: Column,
    strength: float,
    contrast: float,
    gamma: float,
    mode: str = "delta",
) -> Column:
    """Log-probabilities moved under the product of the risk's and the window vote's gates.

    Along the difference to a reference of the same words; else less the candidates' penalties, or without risks
    (null or None: the risk's gate is then 1) less their own scaled log-probabilities.
    """
    plain = F.lit(1.0) if risks is None else sigmoid(F.lit(gamma) * prefix)
    gate = F.least(F.lit(1.0), plain * sigmoid(F.lit(gamma) * vote))
    pen = minmax01(lp) if risks is None else penalty(risks, prefix, mode)
    less = let(gate, lambda w: F.zip_with(lp, pen, lambda x, g: x - F.lit(strength) * w * g))
    if reference is None:
        return less
    moved = let(gate, lambda w: F.zip_with(lp, reference, lambda t, r: t + F.lit(contrast) * w * (r - t)))
    return F.when(reference.isNotNull() & (F.size(reference) == F.size(lp)), moved).otherwise(less)


def adjusted(scores: Column) -> Column:
    """The distribution that a step draws from."""
    return softmax(scores)


def top_k_only(p: Column, k: int) -> Column:
    """A distribution cut to its ``k`` likeliest entries (ties by place) and renormalized."""
    order = F.array_sort(F.transform(p, lambda x, i: F.struct((-x).alias("v"), i.alias("i"))))
    return let(
        F.transform(F.slice(order, 1, k), lambda s: s["i"]),
        lambda b: _renormalized(F.transform(p, lambda x, i: F.when(F.array_contains(b, i), x).otherwise(0.0))),
    )


def nucleus_only(p: Column, share: float) -> Column:
    """A distribution cut to the fewest likeliest entries that hold ``share`` of it (ties by place), renormalized."""
    order = F.array_sort(F.transform(p, lambda x, i: F.struct((-x).alias("v"), i.alias("i"))))

    def kept(s: Column) -> Column:
        before = F.transform(
            s,
            lambda e, k: F.struct(
                e["i"].alias("i"), total(F.transform(F.slice(s, F.lit(1), k), lambda f: -f["v"])).alias("b")
            ),
        )
        ids = F.transform(F.filter(before, lambda e: e["b"] < share), lambda e: e["i"])
        return let(
            ids, lambda b: _renormalized(F.transform(p, lambda x, i: F.when(F.array_contains(b, i), x).otherwise(0.0)))
        )

    return let(order, kept)


def _renormalized(p: Column) -> Column:
    return let(p, lambda q: let(total(q), lambda t: F.transform(q, lambda x: x / t)))


def loss_zip(target: Column, reference: Column, tail: bool = False) -> Column:
    """Pairs (t, r) of two loss arrays, as many as the shorter has, from their starts or their ends."""
    n = F.least(F.size(target), F.size(reference))
    part = lambda a: F.slice(a, F.size(a) - n + 1 if tail else F.lit(1), n)
    pairs = F.zip_with(part(target), part(reference), lambda t, r: F.struct(t.alias("t"), r.alias("r")))
    return F.when(n > 0, pairs).otherwise(F.filter(pairs, lambda _: F.lit(False)))


def array_vote(pairs: Column, sizes: list[int]) -> Column:
    """The window vote of one text's loss pairs: the mean over sizes of the share of windows where r exceeds t; 0 below
    two losses or where no size fits."""
    n = F.size(pairs)

    def share(w: int) -> Column:
        window = lambda k: total(F.transform(F.slice(pairs, k, w), lambda p: p["r"] - p["t"]))
        wins = F.size(F.filter(F.sequence(F.lit(1), n - w + 1), lambda k: window(k) > 0))
        return F.when(n >= w, wins / (n - w + 1))

    shares = F.array_compact(F.array(*(share(w) for w in sizes)))
    return F.when(n < 2, F.lit(0.0)).otherwise(
        let(shares, lambda a: F.when(F.size(a) > 0, total(a) / F.size(a)).otherwise(0.0))
    )


def feature_norms(v: Column) -> list[Column]:
    d = F.transform(v, lambda x: x.cast("double"))
    return [F.size(v).alias("dim"), norm(v).alias("l2"), (total(F.transform(d, F.abs)) / F.size(v)).alias("mean_abs")]


def masked_stats(v: Column, least: float) -> list[Column]:
    """mean, std (population), min, max, lower median and quartiles of the entries of at least ``least``."""
    return _masked(F.array_sort(F.filter(F.transform(v, lambda x: x.cast("double")), lambda x: x >= least)))


def _masked(a: Column) -> list[Column]:
    n = F.size(a)
    mean = total(a) / n

    def quantile(p: float) -> Column:
        at = (n - 1) * F.lit(p)
        low, high = F.get(a, F.floor(at).cast("int")), F.get(a, F.ceil(at).cast("int"))
        return low + (high - low) * (at - F.floor(at))

    some = lambda c: F.when(n > 0, c).otherwise(0.0)
    std = let(mean, lambda m: F.sqrt(total(F.transform(a, lambda x: (x - m) * (x - m))) / n))
    return [
        some(mean).alias("mean"),
        some(std).alias("std"),
        some(F.get(a, F.lit(0))).alias("min"),
        some(F.get(a, n - 1)).alias("max"),
        some(F.get(a, F.floor((n - 1) / 2).cast("int"))).alias("median"),
        some(quantile(0.25)).alias("p25"),
        some(quantile(0.75)).alias("p75"),
    ]


def context_evolution(rows: DataFrame, group: str, order: str, vec: str) -> DataFrame:
    """group, order and the norm of the change of the running mean vector (from the second row of each group)."""
    dims = rows.select(group, order, F.posexplode(vec).alias("d", "x")).withColumn("x", F.col("x").cast("double"))
    w = Window.partitionBy(group, "d").orderBy(order)
    mean = F.avg("x").over(w.rowsBetween(Window.unboundedPreceding, 0))
    moved = dims.select(group, order, "d", mean.alias("m")).withColumn("step", F.col("m") - F.lag("m").over(w))
    return moved.filter("step is not null").groupBy(group, order).agg(
        F.sqrt(F.sum(F.col("step") * F.col("step"))).alias("change")
    )


def transitions(rows: DataFrame, group: str, order: str, vec: str) -> DataFrame:
    """group, order, distance and cosine between each vector and the one before it."""
    w = Window.partitionBy(group).orderBy(order)
    pairs = rows.select(group, order, vec, F.lag(vec).over(w).alias("_before")).filter("_before is not null")
    gap = norm(F.zip_with(vec, "_before", lambda x, y: x.cast("double") - y.cast("double")))
    return pairs.select(group, order, gap.alias("distance"), cosine(F.col(vec), F.col("_before")).alias("cosine"))


def transition_extremes(moves: DataFrame, group: str, order: str, length: int | None = None) -> DataFrame:
    """group and the places (0 to 1) of the least and greatest distance among its moves, the first on ties."""
    first = lambda c: F.min_by(F.col(order), F.struct(c, F.col(order)))
    low, high = F.min(order), F.max(order)
    got = moves.groupBy(group).agg(
        first(F.col("distance")).alias("at_least"),
        first(-F.col("distance")).alias("at_most"),
        low.alias("_low"),
        high.alias("_high"),
    )
    span = F.greatest(F.col("_high") - F.col("_low"), F.lit(1))
    place = lambda c: ((F.col(c) - F.col("_low")) / span).alias(c)
    return got.select(group, place("at_least"), place("at_most"))


def attention_stats(cells: DataFrame) -> DataFrame:
    """layer: mean row entropy, concentration, distance, sparsity, and mass on the place itself and the one before.

    ``cells`` has layer, head, t, s, w (weight of place s for place t).  Sparsity is the share of cells below the
    layer's lower median.
    """
    # stored: means computed twice may differ in the last bit, and cells are compared with a median of themselves
    mean = stash(cells.groupBy("layer", "t", "s").agg(F.avg("w").alias("w")), "mean-cells")
    safe = F.greatest("w", F.lit(1e-8))
    row = mean.groupBy("layer", "t").agg(
        F.sum(-F.col("w") * F.ln(safe)).alias("h"),
        F.max("w").alias("top"),
        F.sum(F.col("w") * F.abs(F.col("t") - F.col("s"))).alias("far"),
        F.sum(F.when(F.col("t") == F.col("s"), F.col("w"))).alias("self"),
        F.sum(F.when(F.col("t") == F.col("s") + 1, F.col("w"))).alias("prev"),
    )
    lower = quantiles(mean, "w", [0.5], ["layer"], discrete=True).select("layer", F.col("q")[0].alias("m"))
    sparse = mean.join(near(stash(lower, "medians")), "layer").groupBy("layer").agg(
        (F.count_if(F.col("w") < F.col("m")) / F.count(F.lit(1))).alias("sparsity")
    )
    stats = row.groupBy("layer").agg(
        F.avg("h").alias("entropy"),
        F.avg("top").alias("concentration"),
        F.avg("far").alias("distance"),
        F.avg("self").alias("self_mass"),
        F.avg(F.coalesce("prev", F.lit(0.0))).alias("prev_mass"),
    )
    return stats.join(sparse, "layer")


def head_stats(cells: DataFrame) -> DataFrame:
    """layer, head: mean entropy of its rows and mean of their greatest weights."""
    safe = F.greatest("w", F.lit(1e-8))
    rows = cells.groupBy("layer", "head", "t").agg(F.sum(-F.col("w") * F.ln(safe)).alias("h"), F.max("w").alias("top"))
    return rows.groupBy("layer", "head").agg(F.avg("h").alias("entropy"), F.avg("top").alias("focus"))


def activation_stats(v: Column, eps: float = 1e-6) -> list[Column]:
    """sparsity, utilization, peak, positive and negative shares, and entropy of the softmax of the entries."""
    d = F.transform(v, lambda x: x.cast("double"))
    share = lambda f: F.size(F.filter(d, f)) / F.size(d)
    entropy = -total(F.transform(softmax(d), lambda p: p * F.ln(F.greatest(p, F.lit(1e-12)))))
    return [
        share(lambda x: F.abs(x) < eps).alias("sparsity"),
        share(lambda x: F.abs(x) > eps).alias("utilization"),
        F.array_max(F.transform(d, F.abs)).alias("peak"),
        share(lambda x: x > 0).alias("positive"),
        share(lambda x: x < 0).alias("negative"),
        entropy.alias("entropy"),
    ]


def prediction_stats(p: Column) -> list[Column]:
    top = F.sort_array(p, False)
    return [
        (-total(F.transform(p, lambda x: x * F.ln(F.greatest(x, F.lit(1e-12)))))).alias("entropy"),
        F.get(top, F.lit(0)).alias("top1"),
        (F.get(top, F.lit(0)) - F.coalesce(F.get(top, F.lit(1)), F.lit(0.0))).alias("margin"),
    ]


def stability(top1: str) -> Column:
    """Aggregate: a layer's mean confidence over its deviation."""
    return F.avg(top1) / F.greatest(F.stddev_pop(top1) + 1e-8, F.lit(1e-12))


def local_std(v: Column, mask: Column, reach: int = 2) -> list[Column]:
    """Deviation of the unmasked values up to ``reach`` places from the first, middle and last; 0 for fewer than two."""
    n, seen = F.size(v), F.zip_with(v, mask, lambda x, m: F.when(m > 0, x.cast("double")))

    def near(c: Column) -> Column:
        low = F.greatest(F.lit(0), c - reach)
        part = F.array_compact(F.slice(seen, low + 1, F.greatest(F.lit(0), F.least(n, c + reach + 1) - low)))
        spread = lambda k: let(total(k) / F.size(k), lambda m: F.sqrt(total(F.transform(k, lambda x: (x - m) * (x - m))) / F.size(k)))
        return let(part, lambda k: F.when(F.size(k) >= 2, spread(k)).otherwise(0.0))

    return [
        near(c).alias(name) for name, c in (("first", F.lit(0)), ("mid", F.floor(n / 2).cast("int")), ("last", n - 1))
    ]


def seeded_pairs(vocabulary: int, hidden: int, n: int, seed: int) -> list[tuple[int, int]]:
    """``n`` places (i below ``vocabulary``, j below ``hidden``) drawn with replacement; the driver holds them."""
    rng = np.random.default_rng(seed)
    return list(zip(rng.integers(0, vocabulary, n).tolist(), rng.integers(0, hidden, n).tolist(), strict=True))


def select_mc_arrays(o: Column, h: Column, pairs: list[tuple[int, int]], deltas: list[float], scale: float) -> Column:
    """The same score of one row's arrays, over pairs that all rows share."""
    drawn = F.array(
        *(
            F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(float(d)).alias("d"))
            for (i, j), d in zip(pairs, deltas, strict=True)
        )
    )
    return F.lit(scale) * total(F.transform(drawn, lambda p: F.get(o, p["i"]) * F.get(h, p["j"]) * p["d"]))


def select_mc(pairs: DataFrame, scale: float) -> DataFrame:
    """id and score: scale times the sum of o * h * delta over the drawn pairs (columns id, o, h, delta)."""
    return pairs.groupBy("id").agg((F.lit(scale) * F.sum(F.col("o") * F.col("h") * F.col("delta"))).alias("score"))
