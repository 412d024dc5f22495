"""Mixing sources to target weights by entropy balancing.

Among all document rates between 0 and ``cap`` that give each source its target of words, the rates nearest to
1 in relative entropy are min(cap, exp(tilt * size)), with one tilt per source.  The tilts solve a convex dual;
Newton steps (kept inside a bracket) find them, each with one distributed sum of words and its derivative over
the counts of documents by source and size.  Rates are then rounded into copies, from large to small documents
with the error carried on: a source misses its target by less than a document, mostly a short one.

The driver holds one row per source, as the weights do; documents and their sizes stay distributed.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleanspark.llm.common import count_words, stash

#: Documents of one source and size that are ranked together, about, unless that makes more than so many cells.
CELL, CELLS = 1_000, 1_000_000
#: Words are summed as decimals, in which the order of the sum does not show: reruns find the same tilts.
EXACT = "decimal(38,9)"


def cycled_weights(sources: list[str | None], cycle: tuple[float, ...] = (3, 1, 2)) -> dict[str | None, float]:
    """Weights by code point order of the source, null last."""
    order = sorted((s for s in sources if s is not None)) + [None] * (None in sources)
    return {s: cycle[k % len(cycle)] for k, s in enumerate(order)}


def share(
    sizes: dict[str | None, int], weights: dict[str | None, float], budget: float, cap: float
) -> dict[str | None, float]:
    """Targets by weight, at most ``cap`` times the source's size; the excess goes to the others by weight."""
    out, open_, left = {}, {s for s in sizes if weights.get(s, 0) > 0}, budget
    out |= {s: 0.0 for s in sizes if s not in open_}
    while open_:
        total = sum(weights[s] for s in open_)
        full = {s for s in open_ if left * weights[s] / total > cap * sizes[s]}
        if not full:
            return out | {s: left * weights[s] / total for s in open_}
        for s in full:
            out[s] = float(cap * sizes[s])
        left -= sum(out[s] for s in full)
        open_ -= full
    return out


def solve_tilts(
    hist: DataFrame, sums: dict[int, tuple[int, int, float]], cap: float, rounds: int = 80, close: float = 1e-7
) -> dict[int, float]:
    """Tilt by source number; ``hist`` has k, size and n, ``sums`` words, documents with words, and the target."""
    spark = hist.sparkSession
    tilts = {
        k: math.inf
        if t >= cap * w * (1 - 1e-12)
        else -math.inf
        if t <= 0
        else 0.0
        for k, (w, n, t) in sums.items()
        if w
    }
    scale = {k: w / n for k, (w, n, _) in sums.items() if w}  # mean size: tilts are per mean document
    at = {k: math.log(sums[k][2] / sums[k][0]) for k, v in tilts.items() if v == 0}
    low, high = {k: -math.inf for k in at}, {k: math.inf for k in at}
    done: dict[int, float] = {}
    for _ in range(rounds):
        if not at:
            break
        now = spark.createDataFrame([(k, v / scale[k]) for k, v in at.items()], "k long, tilt double")
        x = F.col("tilt") * F.col("size")
        words = F.col("n") * F.col("size") * F.exp(F.least(x, F.lit(math.log(cap))))
        slope = F.when(x < math.log(cap), words * F.col("size")).otherwise(0.0)
        found = hist.join(F.broadcast(now) if len(at) <= 10_000 else now, "k").groupBy("k").agg(
            F.sum(words.cast(EXACT)).alias("f"), F.sum(slope.cast(EXACT)).alias("d")
        ).collect()
        for k, f, d in ((k, float(f), float(d)) for k, f, d in found):
            miss, v = f - sums[k][2], at[k]
            if abs(miss) <= close * sums[k][2]:
                done[k] = at.pop(k)
                continue
            if miss > 0:
                high[k] = v
            else:
                low[k] = v
            new = v - miss * scale[k] / d if d > 0 else math.nan
            if not low[k] < new < high[k]:
                new = (low[k] + high[k]) / 2 if math.isfinite(low[k] + high[k]) else 2 * v + (1 if miss < 0 else -1)
            at[k] = new
    if at:
        raise ValueError(f"no tilt after {rounds} rounds for {len(at)} sources")
    return {k: (v if math.isinf(v) else done[k] / scale[k]) for k, v in tilts.items()}


def _quotas(cells: pd.DataFrame) -> pd.DataFrame:
    """Extra copies of each cell of one source (bounded by its sizes and ``CELLS``)."""
    cells = cells.sort_values(["size", "salt"], ascending=[False, True])
    want = have = 0.0
    extra = []
    for size, n, part in zip(cells["size"], cells["n"], cells["part"], strict=True):
        want += n * part * size
        extra.append(min(n, max(0, round((want - have) / size))))
        have += extra[-1] * size
    return cells.assign(extra=extra)[["k", "size", "salt", "extra"]]


def mix(
    docs: DataFrame,
    weights: Callable[[list[str | None]], dict[str | None, float]] = cycled_weights,
    *,
    percent: float = 150.0,
    cap: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    seed: int = 0,
) -> DataFrame:
    """``id_col``, source, size, source_size, target, rate, copies and taken (copies * size) of every row.

    Sizes are words; targets share ``percent`` of all words by ``weights`` and stop at ``cap`` times a source's
    words.  Null texts have size 0 and, like all documents without words, one copy and nothing taken; a null
    source is a source; null ids stay.  Repeated rows are documents of their own.  Reruns give the same rows (rows
    that agree in id, text, source and size are interchangeable, and are ranked in one task).  Very long texts count
    whole.  Other columns are dropped, whatever their names.  An empty table gives an empty one.  A source whose tilt is
    not found in 80 Newton steps is an error.
    """
    spark = docs.sparkSession
    order = F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col))
    sized = docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).alias("source"),
        count_words(F.col(text_col)).alias("size"),
        order.alias("order"),
    )
    sized = stash(sized, "sizes")
    totals = {
        r[0]: (r[1], r[2])
        for r in sized.groupBy("source").agg(F.sum("size"), F.count(F.when(F.col("size") > 0, 1))).collect()
    }
    names = list(totals)
    targets = share(
        {s: w for s, (w, _) in totals.items()}, weights(names), percent / 100 * sum(w for w, _ in totals.values()), cap
    )
    small = len(names) <= 10_000
    numbers = spark.createDataFrame(
        [(s, k, totals[s][0], float(targets[s])) for k, s in enumerate(names)],
        "source string, k long, source_size long, target double",
    )
    near = (lambda d: F.broadcast(d)) if small else (lambda d: d)
    numbered = sized.join(
        near(numbers.withColumnRenamed("source", "_s")), F.col("source").eqNullSafe(F.col("_s")), "left"
    ).drop("_s")
    hist = stash(numbered.filter("size > 0").groupBy("k", "size").agg(F.count(F.lit(1)).alias("n")), "size-counts")
    tilts = solve_tilts(hist, {k: (*totals[s], targets[s]) for k, s in enumerate(names)}, cap)
    solved = spark.createDataFrame(
        [(k, min(v, 1e300) if v > 0 else max(v, -1e300)) for k, v in tilts.items()], "k long, tilt double"
    )
    bound = math.log(cap)
    rate = F.when(F.col("tilt") >= 1e300, F.lit(float(cap))).when(F.col("tilt") <= -1e300, F.lit(0.0)).when(
        F.col("tilt") * F.col("size") >= bound, F.lit(float(cap))
    ).otherwise(F.exp(F.col("tilt") * F.col("size")))
    cell = max(CELL, sum(n for _, n in totals.values()) // CELLS)
    rated = hist.join(near(solved), "k").select(
        "k", "size", F.ceil(F.col("n") / cell).alias("salts"), rate.alias("rate")
    )
    whole = F.floor("rate").cast("long")
    dealt = numbered.filter("size > 0").join(rated, ["k", "size"]).withColumn("salt", F.pmod("order", "salts"))
    dealt = stash(dealt.withColumn("whole", whole), "dealt")
    cells = dealt.groupBy("k", "size", "salt").agg(
        F.count(F.lit(1)).alias("n"), F.first(F.col("rate") - F.col("whole")).alias("part")
    )
    quotas = cells.groupBy("k").applyInPandas(_quotas, "k long, size long, salt long, extra long")
    rank = F.row_number().over(Window.partitionBy("k", "size", "salt").orderBy("order", "id"))
    taken = dealt.withColumn("rank", rank).join(quotas, ["k", "size", "salt"]).withColumn(
        "copies", F.col("whole") + (F.col("rank") <= F.col("extra")).cast("long")
    )
    columns = lambda d: d.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))
    empty = numbered.filter("size = 0").withColumn("rate", F.lit(1.0)).withColumn("copies", F.lit(1).cast("long"))
    return columns(taken).unionByName(columns(empty))
