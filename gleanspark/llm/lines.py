"""Line dedup by site-relative frequency.

Per host, the pages that contain a line are divided by the host's pages; lines above the ratio are boilerplate
and dropped.  Counting runs on 64-bit hashes with partial sums before the shuffle; only lines whose hash may
exceed the ratio are then counted by their text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanspark.llm.common import BROADCAST_CHARS, WORD, broadcast_small, fresh, let, stash

#: A host's list of boilerplate is searched in place up to this length.
SHORT_LIST = 256


def _lines(text: Column) -> Column:
    """Distinct lines of a text that hold a word."""
    return F.array_distinct(F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD)))


def boilerplate(
    docs: DataFrame,
    *,
    ratio: float = 0.1,
    min_pages: int = 3,
    min_texts: int = 2,
    host_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """host, line, n_pages and host_pages of each line that exceeds ``ratio`` on its host.

    A page counts once for a line.  The line must be on ``min_pages`` pages and, so that a page's own copies do
    not make it boilerplate, in at least ``min_texts`` (1 or 2) different texts.
    """
    rows = docs.select(F.col(host_col).alias("host"), F.col(text_col).alias("text"))
    totals = rows.groupBy("host").agg(F.count(F.lit(1)).alias("host_pages"))
    each = let(
        F.xxhash64("text"),  # once a text, not once a line
        lambda t: F.transform(_lines(F.col("text")), lambda x: F.struct(t.alias("t"), x.alias("line"))),
    )
    exploded = rows.select("host", F.explode(each).alias("x")).select("host", "x.t", "x.line")
    enough = (F.col("n_pages") >= min_pages) & (F.col("n_pages") > F.lit(ratio) * F.col("host_pages"))
    counted = exploded.groupBy("host", F.xxhash64("line").alias("h")).agg(
        F.count(F.lit(1)).alias("n_pages"), F.min("t").alias("t0"), F.max("t").alias("t1")
    )
    if min_texts > 1:
        counted = counted.filter("t0 < t1")
    likely = stash(
        counted.filter(F.col("n_pages") >= min_pages).join(
            totals, counted["host"].eqNullSafe(totals["host"])
        ).filter(enough).select(counted["host"], "h", "host_pages"),
        "likely-lines",
    )
    mine = exploded.withColumn("h", F.xxhash64("line")).alias("a").join(
        broadcast_small(likely).alias("b"), F.expr("a.h = b.h and a.host <=> b.host")
    )
    exact = mine.groupBy("a.host", "line", "host_pages").agg(
        F.count(F.lit(1)).alias("n_pages"), F.min("t").alias("t0"), F.max("t").alias("t1")
    )
    if min_texts > 1:
        exact = exact.filter("t0 < t1")
    return exact.filter(enough).select("host", "line", "n_pages", "host_pages")


def drop_boilerplate(
    docs: DataFrame,
    *,
    ratio: float = 0.1,
    min_pages: int = 3,
    min_texts: int = 2,
    host_col: str = "source",
    text_col: str = "text",
    into: str = "line_dedup",
    broadcast_chars: int = BROADCAST_CHARS,
) -> DataFrame:
    """``docs`` with the struct ``into``: text (without the host's boilerplate lines), n_lines, n_dropped.

    All rows stay, repeated ones too (each counts as a page).  Rows without a host form a host of their own.  A null
    text stays null with 0 lines and counts as a page; blank lines are never boilerplate; a text all of whose lines are
    boilerplate becomes empty; very long texts and lines are treated whole.  A column named like ``into`` is replaced,
    all other columns stay as they are, whatever their names.  A line at the ratio exactly stays.
    """
    names = {"host_col": host_col, "text_col": text_col}
    found = boilerplate(docs, ratio=ratio, min_pages=min_pages, min_texts=min_texts, **names)
    found = stash(found, "boilerplate")
    size = found.agg(F.sum(F.length("line") + 24)).first()[0] or 0
    longest = found.groupBy("host").count().agg(F.max("count")).first()[0] or 0
    host, gone, row = fresh(docs, "_host", "_gone", "_row")
    lines = F.split(F.col(text_col), "\n")
    if size <= broadcast_chars and longest <= SHORT_LIST:
        lists = F.broadcast(found.groupBy(F.col("host").alias(host)).agg(F.collect_set("line").alias(gone)))
        joined = docs.join(lists, F.col(host_col).eqNullSafe(F.col(host)), "left").drop(host)
        kept = F.filter(lines, lambda x: ~F.array_contains(gone, x))
    else:
        joined = _with_places(docs, found, host_col, text_col, row, gone)
        kept = _between(lines, F.col(gone))
    kept = F.when(F.col(gone).isNull(), lines).otherwise(kept)
    zero = F.lit(0)
    done = F.struct(
        F.array_join(kept, "\n").alias("text"),
        F.coalesce(F.size(lines), zero).cast("long").alias("n_lines"),
        F.coalesce(F.size(lines) - F.size(kept), zero).cast("long").alias("n_dropped"),
    )
    return joined.withColumn(into, done).drop(gone)


def _between(lines: Column, places: Column) -> Column:
    """The lines but for those at ``places`` (structs of at and line), as slices between them."""

    def slices(ls: Column, at: Column) -> Column:
        before, after = F.concat(F.array(F.lit(-1)), at), F.concat(at, F.array(F.size(ls)))
        return F.flatten(F.zip_with(before, after, lambda a, b: F.slice(ls, a + 2, b - a - 1)))

    return let(
        lines,
        lambda ls: let(
            F.array_sort(
                F.transform(F.filter(places, lambda g: F.get(ls, g["at"]) == g["line"]), lambda g: g["at"])
            ),
            lambda at: slices(ls, at),
        ),
    )


def _with_places(docs: DataFrame, found: DataFrame, host_col: str, text_col: str, row: str, gone: str) -> DataFrame:
    """``docs`` with ``gone``: the places of a text's boilerplate lines, for lists too long to send to every task.

    Lines meet the lists by host and hash; what a row gets back are its own lines of that hash.
    """
    stored = stash(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    lines = stored.select(
        F.col(row).alias("r"), F.col(host_col).alias("o"), F.posexplode(F.split(text_col, "\n")).alias("at", "x")
    )
    lists = found.select("host", "line", F.xxhash64("line").alias("h"))
    hits = lines.select("r", "o", "at", F.xxhash64("x").alias("h")).alias("a").join(
        lists.alias("b"), F.expr("a.h = b.h and a.o <=> b.host")
    )
    places = stash(hits.groupBy("r").agg(F.collect_list(F.struct("at", "line")).alias(gone)), "places")
    return stored.join(places.withColumnRenamed("r", row), row, "left").drop(row)


def sql(ratio: float = 0.1, min_pages: int = 3) -> str:
    """DuckDB SQL of ``op10_line_dedup``."""
    return f"""
with d as (select doc_id, source, text, string_split(text, chr(10)) ls from documents),
t as (select source, count(*) tot from d group by source),
l as (select doc_id, source, text, unnest(list_distinct(ls)) line from d),
b as (select l.source, line from l join t on l.source is not distinct from t.source
      where regexp_matches(line, '[^\\x20\\x09-\\x0D]') group by l.source, line, tot
      having count(*) >= {min_pages} and count(*) > cast({ratio} as double) * tot and count(distinct text) > 1),
a as (select source, list(line) drops from b group by source),
k as (select d.doc_id, ls, list_filter(ls, lambda x: a.drops is null or not list_contains(a.drops, x)) kept
      from d left join a on d.source is not distinct from a.source)
select doc_id, cast(coalesce(len(ls), 0) as bigint) n_lines, cast(coalesce(len(ls) - len(kept), 0) as bigint) n_dropped,
       sha256(array_to_string(kept, chr(10))) text_sha256 from k"""
