"""Group summaries, row selection, sharding and merging."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleanspark.operators.running import quantiles, running, with_ordinal
from gleanspark.sources.scratch import near, stash

PARTS = (0.05, 0.25, 0.5, 0.75, 0.95)


def five_stats(x: str) -> list[Column]:
    """mean, sum, std (population), min, max; NaN in, NaN out, as arrays have it."""
    nan = F.bool_or(F.isnan(x))
    return [
        F.avg(x).alias("mean"),
        F.sum(x).alias("sum"),
        F.stddev_pop(x).alias("std"),
        F.when(nan, float("nan")).otherwise(F.min(x)).alias("min"),
        F.max(x).alias("max"),
    ]


def dist_summary(df: DataFrame, x: str, by: str | None = None) -> DataFrame:
    """One row for all and, with ``by``, one for each of its values: n, mean, std, min, max and percentiles."""
    aggs = [
        F.count(F.lit(1)).alias("n"),
        F.avg(x).alias("mean"),
        F.stddev_pop(x).alias("std"),
        F.min(x).alias("min"),
        F.max(x).alias("max"),
    ]
    marks = [F.col("q")[k].alias(f"p{round(p * 100)}") for k, p in enumerate(PARTS)]
    every = df.agg(*aggs).join(quantiles(df, x, PARTS), how="left").select("*", *marks).drop("q")
    if by is None:
        return every
    q = quantiles(df, x, PARTS, [by]).withColumnRenamed(by, "_by")
    own = df.groupBy(by).agg(*aggs).join(q, F.col(by).eqNullSafe(F.col("_by")), "left").select(by, *every.columns[:5], *marks)
    return own.unionByName(every.withColumn(by, F.lit(None).cast(df.schema[by].dataType)))


def nearest_ranks(df: DataFrame, x: str, ps: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """by, p, value at index round-half-even((n - 1) p), from the running counts of distinct values."""
    counts = df.filter(F.col(x).isNotNull()).groupBy(*by, x).agg(F.count(F.lit(1)).alias("c"))
    run = running(counts, by, [x], {"before": F.col("c")})
    n = counts.groupBy(*by).agg(F.sum("c").alias("n"))
    marks = F.array(*(F.struct(F.lit(p).alias("p"), F.bround((F.col("n") - 1) * F.lit(p), 0).alias("at")) for p in ps))
    wanted = n.select(*(F.col(b).alias(f"_{b}") for b in by), F.explode(marks).alias("w")).select("*", "w.*").drop("w")
    here = (F.col("before") <= F.col("at")) & (F.col("before") + F.col("c") > F.col("at"))
    for b in by:
        here = here & F.col(b).eqNullSafe(F.col(f"_{b}"))
    return run.join(F.broadcast(wanted), here).select(*by, "p", F.col(x).alias("value"))


def length_stats(df: DataFrame, by: str, text_col: str = "text") -> DataFrame:
    """by, unit (chars or words), n, mean, min, max, p50, p90, p99 (nearest ranks) of the texts' lengths."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.size(F.array_remove(F.split(text, r"(?U)[\s\x1c-\x1f\x85]+"), "")).cast("long")
    units = F.array(
        F.struct(F.lit("chars").alias("unit"), F.length(text).cast("long").alias("v")),
        F.struct(F.lit("words").alias("unit"), words.alias("v")),
    )
    rows = df.select(F.col(by), F.explode(units).alias("u")).select(by, "u.*")
    sums = rows.groupBy(by, "unit").agg(
        F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"), F.min("v").alias("min"), F.max("v").alias("max")
    )
    marks = nearest_ranks(rows, "v", (0.5, 0.9, 0.99), (by, "unit"))
    wide = marks.groupBy(F.col(by).alias("_by"), F.col("unit").alias("_unit")).agg(
        *(F.max(F.when(F.col("p") == p, F.col("value"))).alias(f"p{round(p * 100)}") for p in (0.5, 0.9, 0.99))
    )
    same = F.col(by).eqNullSafe(F.col("_by")) & (F.col("unit") == F.col("_unit"))
    return sums.join(wide, same).drop("_by", "_unit")


def zero_quantification(df: DataFrame, x: str, short: Column, by: str) -> DataFrame:
    zero = F.col(x) == 0
    count = lambda c, name: F.count_if(c).alias(name)
    return df.rollup(by).agg(
        F.count(F.lit(1)).alias("n"),
        count(zero, "zero"),
        (F.count_if(zero) / F.count(F.lit(1))).alias("zero_share"),
        count(short, "short"),
        count(zero & short, "zero_short"),
        count(zero & ~short, "zero_long"),
    )


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row of each key by ``order``."""
    return df.withColumn(
        "_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    ).filter("_n = 1").drop("_n")


def upsert(old: DataFrame, new: DataFrame, key: str, batch: str) -> DataFrame:
    """Both tables with the latest batch's row for each key, and place: keys in the order in which they first came."""
    both = old.unionByName(new)
    latest = keep_first(both, [key], [F.desc(batch)])
    first = both.groupBy(F.col(key).alias("_key")).agg(F.min(batch).alias("_first"))
    joined = latest.join(first, F.col(key).eqNullSafe(F.col("_key")))
    return with_ordinal(joined, ["_first", key], "place").drop("_key", "_first")


def union_first(tables: Sequence[DataFrame], key: str) -> DataFrame:
    """All tables' rows, of each key those of the first table that has it (one row, if that has several)."""
    marked = [t.withColumn("_source", F.lit(k)) for k, t in enumerate(tables)]
    every = reduce(lambda a, b: a.unionByName(b), marked)
    return keep_first(every, [key], ["_source"]).drop("_source")


def positional_join(a: DataFrame, b: DataFrame, index: str) -> DataFrame:
    """Both tables' columns by equal index; an error unless each index is once in either."""
    marks = a.select(index, F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(
        b.select(index, F.lit(0).alias("a"), F.lit(1).alias("b"))
    )
    odd = marks.groupBy(index).agg(
        F.sum("a").alias("a"), F.sum("b").alias("b")
    ).filter("a <> 1 or b <> 1").limit(3).collect()
    if odd:
        raise ValueError(f"rows do not match: {[(r[0], r.a, r.b) for r in odd]} (index, rows in either table)")
    return a.join(b, index)


def merge_payloads(shards: Sequence[DataFrame], model: str, example: str) -> DataFrame:
    """All shards' rows; an error where two have the same example of a model."""
    every = reduce(lambda a, b: a.unionByName(b), shards)
    twice = every.groupBy(model, example).count().filter("count > 1").limit(3).collect()
    if twice:
        raise ValueError(f"in several shards: {[(r[0], r[1]) for r in twice]}")
    return every


def mode_summary(rows: DataFrame, by: str, modes: Sequence[str]) -> DataFrame:
    """by, mode, mean_overlap, mean_lcp and n_scored over the columns <mode>_overlap and <mode>_lcp; 0 without values."""
    each = F.explode(
        F.array(
            *(
                F.struct(F.lit(m).alias("mode"), F.col(f"{m}_overlap").alias("o"), F.col(f"{m}_lcp").alias("l"))
                for m in modes
            )
        )
    )
    long = rows.select(by, each.alias("m")).select(by, "m.*")
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    return long.groupBy(by, "mode").agg(
        mean("o").alias("mean_overlap"), mean("l").alias("mean_lcp"), F.count("o").alias("n_scored")
    )


def wall_and_span(rows: DataFrame, by: str, wall: str, index: str) -> DataFrame:
    """by, wall (the sum) and span (the largest index plus one)."""
    return rows.groupBy(by).agg(F.sum(wall).alias("wall"), (F.max(index) + 1).alias("span"))


def gate(rows: DataFrame, keep: Column, least: int, *, label: str | None = None, classes: int = 1) -> DataFrame:
    """The rows that hold; an error if fewer than ``least`` do, or if they have fewer than ``classes`` labels."""
    kept = rows.filter(keep)
    n, found = kept.agg(F.count(F.lit(1)), F.count_distinct(label) if label else F.lit(classes)).first()
    if n < least or found < classes:
        raise ValueError(f"{n} rows with {found} labels; at least {least} with {classes} are needed")
    return kept


def skip_existing(
    runs: DataFrame, manifest: DataFrame, key: str, done: Sequence[str] = ("ok", "skipped_existing")
) -> DataFrame:
    """The runs that the manifest does not have as done."""
    return runs.join(
        near(stash(manifest.filter(F.col("status").isin(*done)).select(key).distinct(), "done")), key, "left_anti"
    )


def keyed_config(
    rows: DataFrame, configs: dict[str, dict[str, str]], key: str, default: str | None = None
) -> DataFrame:
    """``rows`` with the fields of the configuration that their key names; a miss is an error, or takes ``default``."""
    spark = rows.sparkSession
    fields = sorted({f for c in configs.values() for f in c})
    schema = ", ".join(["_key string", *(f"`{f}` string" for f in fields)])
    table = F.broadcast(spark.createDataFrame([(k, *(c.get(f) for f in fields)) for k, c in configs.items()], schema))
    wanted = F.col(key)
    if default is None:
        missing = rows.select(key).distinct().join(
            table, wanted.eqNullSafe(F.col("_key")), "left_anti"
        ).limit(3).collect()
        if missing:
            raise ValueError(f"no configuration for {[r[0] for r in missing]}")
    else:
        wanted = F.when(wanted.isin(*configs), wanted).otherwise(F.lit(default))
    return rows.withColumn("_wanted", wanted).join(table, F.col("_wanted") == F.col("_key")).drop("_wanted", "_key")


def shard_of(i: Column, n: Column, shards: int) -> Column:
    """Shard s holds rows floor(n s / shards) to floor(n (s + 1) / shards)."""
    return F.floor(((i + 1) * shards - 1) / n).cast("long")


def merge_checks(df: DataFrame, index: str) -> DataFrame:
    """n, distinct, duplicated indexes and missing ones within the span."""
    per = df.groupBy(index).agg(F.count(F.lit(1)).alias("c"))
    return per.agg(
        F.sum("c").alias("n"),
        F.count(F.lit(1)).alias("n_distinct"),
        F.count_if(F.col("c") > 1).alias("n_duplicated"),
        (F.max(index) - F.min(index) + 1 - F.count(F.lit(1))).alias("n_missing"),
    )


def config_signatures(runs: DataFrame, config: str, *, skip: Sequence[str], defaults: dict[str, str]) -> DataFrame:
    """signature (sorted key and value structs) and n_runs of each distinct configuration.

    ``config`` is a map of strings; keys it lacks take their ``defaults``, keys in ``skip`` don't count.  More than
    one row means that the runs must not be merged.
    """
    missing = F.create_map(
        *(F.lit(x) for kv in defaults.items() for x in kv)
    ) if defaults else F.create_map().cast("map<string,string>")
    own = F.coalesce(config, F.create_map().cast("map<string,string>"))
    whole = F.map_concat(F.map_filter(missing, lambda k, _: ~F.map_contains_key(own, k)), own)
    entries = F.sort_array(F.map_entries(F.map_filter(whole, lambda k, _: ~k.isin(list(skip)))))
    return runs.groupBy(entries.alias("signature")).agg(F.count(F.lit(1)).alias("n_runs"))


def seeded(key: str, seed: int) -> Column:
    """A pseudo-random order of keys that other engines can repeat: hex of the SHA-256 of seed and key."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)


def shuffled(df: DataFrame, key: str, seed: int, name: str = "place") -> DataFrame:
    """``df`` with each row's place in a seeded order of its unique keys."""
    return with_ordinal(df.withColumn("_order", seeded(key, seed)), ["_order", key], name).drop("_order")


def sample_n(df: DataFrame, n: int, key: str, seed: int) -> DataFrame:
    """``n`` rows without replacement, by a seeded order of their keys, in key order; an error where there are fewer."""
    drawn = df.withColumn("_order", seeded(key, seed)).orderBy("_order", key).limit(n)
    drawn = stash(drawn.drop("_order"), "sample")
    if (got := drawn.count()) < n:
        raise ValueError(f"{n} rows wanted, {got} are there")
    return drawn.orderBy(key)


def offset_slice(df: DataFrame, index: str, offset: int, limit: int) -> DataFrame:
    """The rows at ``offset`` to ``offset + limit - 1``."""
    return df.filter((F.col(index) >= offset) & (F.col(index) < offset + limit))


def stratified_split(df: DataFrame, key: str, label: str, seed: int, test: float = 0.2, val: float = 0.2) -> DataFrame:
    """``df`` with split: of all rows ceil(test n) are test, of the rest a share of val / (1 - test) rounded up are val.

    Rows are numbered within their label in a seeded order, and labels take turns by the share of them that has been
    dealt, so that each split has each label's share within a row.
    """
    numbered = running(
        df.withColumn("_order", seeded(key, seed)), [label], ["_order", key], {"_k": F.lit(1).cast("long")}
    )
    sizes = numbered.groupBy(F.col(label).alias("_label")).agg(F.count(F.lit(1)).alias("_n"))
    placed = numbered.join(F.broadcast(sizes), F.col(label).eqNullSafe(F.col("_label")))
    at = ((F.col("_k") + 0.5) / F.col("_n")).alias("_at")
    placed = with_ordinal(placed.select(*df.columns, "_order", at), ["_at", label, "_order", key], "_place")
    n = placed.count()
    n_test = math.ceil(round(test * n, 9))
    n_val = math.ceil(round(val / (1 - test) * (n - n_test), 9))
    split = F.when(F.col("_place") < n_test, "test").when(F.col("_place") < n_test + n_val, "val").otherwise("train")
    return placed.withColumn("split", split).select(*df.columns, "split")


def pair_delta(df: DataFrame, run: str, base: str, post: str, on: str, value: str) -> DataFrame:
    """Value of the post run less that of the base run; status tells where one is missing."""
    a = df.filter(F.col(run) == base).select(on, F.col(value).alias("base"))
    b = df.filter(F.col(run) == post).select(on, F.col(value).alias("post"))
    return a.join(b, on, "full").select(
        on,
        "base",
        "post",
        (F.col("post") - F.col("base")).alias("delta"),
        F.when(F.col("base").isNull() | F.col("post").isNull(), "missing").otherwise("ok").alias("status"),
    )
