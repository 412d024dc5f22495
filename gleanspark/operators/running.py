"""Places and running sums over a whole table's order without gathering its rows in one task.

Rows are dealt by ranges of the order and stored, so that the ranges stay what they are; a row's sum is that within its
range plus those of the ranges before, of which only one row a range and group meets in one place.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleanspark.sources.scratch import near, stash


def running(df: DataFrame, by: Sequence[str], order: Sequence[str], sums: Mapping[str, Column]) -> DataFrame:
    """``df`` with the named sums over all rows of the group before each row (0 at first); nulls are a group."""
    values = {f"_{name}": value for name, value in sums.items()}
    placed = df.withColumns(values).repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id())
    placed = stash(placed, "ranges")
    local = Window.partitionBy("_part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    within = placed.withColumns({name: F.coalesce(F.sum(f"_{name}").over(local), F.lit(0)) for name in sums})
    totals = placed.groupBy("_part", *by).agg(*(F.sum(f"_{name}").alias(f"_{name}") for name in sums))
    ahead = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(
        F.col("_part").alias("_p"),
        *(F.col(b).alias(f"_by{k}") for k, b in enumerate(by)),
        *(F.coalesce(F.sum(f"_{name}").over(ahead), F.lit(0)).alias(f"_b_{name}") for name in sums),
    )
    same = F.col("_part") == F.col("_p")
    for k, b in enumerate(by):
        same = same & F.col(b).eqNullSafe(F.col(f"_by{k}"))
    joined = within.join(near(stash(before, "range-sums")), same)
    added = joined.withColumns({name: F.col(name) + F.col(f"_b_{name}") for name in sums})
    return added.select(*df.columns, *sums)


def with_ordinal(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """``df`` with each row's place (from 0) in ``order``, which must be total for a stable result."""
    return running(df, (), order, {name: F.lit(1).cast("long")})


def quantiles(df: DataFrame, x: str, ps: Sequence[float], by: Sequence[str] = (), *, discrete: bool = False) -> DataFrame:
    """by and q: the quantiles of the group's values, in the order of ``ps``; groups without values are missing.

    Interpolated between the two places beside (n - 1) p or, if ``discrete``, the value at place ceil(n p) - 1.  Places
    come from running counts of distinct values for all groups and parts at once, so that no task holds a group's values.
    Nulls are left out; NaN is the largest value.
    """
    values = df.filter(F.col(x).isNotNull()).groupBy(*by, F.col(x).cast("double").alias("_x"))
    counts = values.agg(F.count(F.lit(1)).alias("_c"))
    placed = running(counts, by, ["_x"], {"_before": F.col("_c")})
    n = placed.groupBy(*by).agg(F.sum("_c").alias("_n"))
    sizes = near(stash(n.select(*(F.col(b).alias(f"_k{k}") for k, b in enumerate(by)), "_n"), "group-sizes"))
    same = F.lit(True)
    for k, b in enumerate(by):
        same = same & F.col(b).eqNullSafe(F.col(f"_k{k}"))
    here = lambda at: F.max(F.when((F.col("_before") <= at) & (at < F.col("_before") + F.col("_c")), F.col("_x")))
    aggs, found = [], []
    for k, p in enumerate(ps):
        at = F.ceil(F.col("_n") * F.lit(p)) - 1 if discrete else (F.col("_n") - 1) * F.lit(float(p))
        low, high = F.greatest(F.floor(at), F.lit(0)), F.greatest(F.ceil(at), F.lit(0))
        aggs += [here(low).alias(f"_l{k}"), here(high).alias(f"_h{k}"), F.max(at - low).alias(f"_w{k}")]
        a, b, w = (F.col(f"_{c}{k}") for c in "lhw")
        found.append(F.when((w == 0) | (a == b), a).otherwise((1 - w) * a + w * b))
    joined = placed.join(sizes, same) if by else placed.crossJoin(F.broadcast(sizes))  # one row where there is no group
    return joined.groupBy(*by).agg(*aggs).select(*by, F.array(*found).alias("q"))
