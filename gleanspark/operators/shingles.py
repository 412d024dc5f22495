"""Character-shingle indexes and labels by long covered passages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleanspark.functions.text import normalize
from gleanspark.operators.running import with_ordinal
from gleanspark.sources.scratch import near, stash

BLOCK = 256


def short_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def _steps(size: int, step: int) -> Column:
    """The shingles at every ``step``-th position of norm."""
    rest = F.substring("norm", step, 2**31 - 1)
    return F.regexp_extract_all(rest, F.lit(f"(?s)(?=(.{{{size}}})).{{1,{step}}}"), F.lit(1))


def windows(docs: DataFrame, size: int, step: int = 1) -> DataFrame:
    """id, p (from 1) and shingle at every ``step``-th position of each normalized text (columns id, norm).

    An expression steps through a text and looks ahead, as taking substrings by place scans a text from its start
    each time.  Where every position counts, texts are first cut into overlapping blocks, so that no array of all
    shingles of a long text is made.
    """
    n = F.length("norm")
    if step > 1:
        found = docs.filter(n >= size + step - 1).select("id", F.posexplode(_steps(size, step)).alias("k", "shingle"))
        return found.select("id", ((F.col("k") + 1) * step).alias("p"), "shingle")
    cut = F.regexp_extract_all("norm", F.lit(f"(?s)(?=(.{{1,{BLOCK + size - 1}}})).{{1,{BLOCK}}}"), F.lit(1))
    blocks = docs.filter(n >= size).select("id", F.posexplode(cut).alias("k", "part")).filter(F.length("part") >= size)
    places = F.sequence(F.lit(1), F.least(F.length("part") - (size - 1), F.lit(BLOCK)))
    placed = blocks.select("id", "k", "part", F.explode(places).alias("q"))
    return placed.select(
        "id",
        (F.col("k") * BLOCK + F.col("q")).alias("p"),
        F.substring("part", F.col("q"), F.lit(size)).alias("shingle"),
    )


def normalized(docs: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), normalize(F.coalesce(text_col, F.lit(""))).alias("norm"))


def shingle_hashes(docs: DataFrame, size: int) -> DataFrame:
    """id, p and hash; a shorter text that isn't empty is one shingle."""
    long = windows(docs, size).select("id", "p", short_hash(F.col("shingle")).alias("hash"))
    return long.union(
        docs.filter((F.length("norm") < size) & (F.length("norm") > 0)).select(
            "id", F.lit(1).alias("p"), short_hash(F.col("norm")).alias("hash")
        )
    )


def build_index(corpus: DataFrame, id_col: str, size: int) -> DataFrame:
    return shingle_hashes(normalized(corpus, id_col), size).select("hash").distinct()


def capped_index(corpus: DataFrame, id_col: str, size: int, most: int, per_text: int = 50_000) -> DataFrame:
    """The first ``most`` distinct hashes in order of id and position, at most ``per_text`` new ones of each text.

    Places come from running counts over ranges, so that no task holds all hashes up to ``most``.  A hash that a text's
    cap leaves out is not taken from a later text either.
    """
    hashes = shingle_hashes(normalized(corpus, id_col), size)
    first = hashes.groupBy("hash").agg(F.min(F.struct("id", "p")).alias("first")).select("hash", "first.*")
    rank = F.row_number().over(Window.partitionBy("id").orderBy("p", "hash"))
    kept = first.withColumn("rank", rank).filter(F.col("rank") <= per_text)
    return with_ordinal(kept, ["id", "p", "hash"], "_at").filter(F.col("_at") < most).select("hash")


def _tried(texts: DataFrame, size: int, match: int) -> DataFrame:
    """id, short (below ``match``) and hash: all shingles of short texts, those at multiples of a run of longer ones.

    Where a run is several positions, one expression gives either, so that texts are read and normalized once.
    """
    n, run = F.length("norm"), match - size + 1
    if run > 1:
        places = F.sequence(F.lit(1), n - (size - 1))
        every = F.when(n >= match, _steps(size, run)).when(
            n >= size, F.transform(places, lambda k: F.substring("norm", k, F.lit(size)))
        ).when(n > 0, F.array("norm"))
        found = texts.select("id", (n < match).alias("short"), F.explode(every).alias("shingle"))
        return found.select("id", "short", short_hash(F.col("shingle")).alias("hash"))
    short = shingle_hashes(texts.filter((n < match) & (n > 0)), size).select("id", F.lit(True).alias("short"), "hash")
    if run < 1:
        return short
    long = windows(texts.filter(n >= match), size, run)
    return short.union(long.select("id", F.lit(False), short_hash(F.col("shingle"))))


def coverage_label(
    docs: DataFrame, index: DataFrame, id_col: str, size: int, match: int, compat: bool = False, text_col: str = "text"
) -> DataFrame:
    """``id_col`` and label: 1 if all shingles of some window of ``match`` characters are in the index.

    Of a text shorter than ``match`` any shingle in the index is enough, and one shorter than ``size`` is a shingle by
    itself; an empty or null text is 0.  Every run of match - size + 1 covered positions holds a multiple of that length,
    so only those positions of longer texts are looked up first, and whole texts only where one is found: two readings,
    the first of which shuffles ids of hits alone while the index is small enough to broadcast.  With ``compat``, a
    ``size`` above ``match`` labels every text of ``match`` characters 1; otherwise it is an error.
    """
    texts = normalized(docs, id_col, text_col)
    known = near(stash(index, "index"))
    run = match - size + 1
    if run < 1 and not compat:
        raise ValueError("the shingle is longer than the match: every long text would be positive")
    some = _tried(texts, size, match).join(known, "hash", "left_semi").select("id", "short").distinct()
    some = stash(some, "hit-texts")
    short = some.filter("short").select("id")
    if run < 1:
        long = texts.filter(F.length("norm") >= match).select("id")
    else:
        tried = near(some.filter("not short")).select(F.col("id").alias(id_col), F.col("short").alias("_short"))
        # the text depends on both sides, so that no text is normalized before the join
        again = docs.select(id_col, text_col).join(tried, id_col).select(
            id_col, F.when(~F.col("_short"), F.col(text_col)).alias(text_col)
        )
        again = normalized(again, id_col, text_col)
        found = windows(again.filter(F.length("norm") >= match), size)
        found = found.select("id", "p", short_hash(F.col("shingle")).alias("hash")).join(known, "hash", "left_semi")
        place = F.col("p") - F.row_number().over(Window.partitionBy("id").orderBy("p"))
        islands = found.select("id", "p", place.alias("g")).groupBy("id", "g").count()
        long = islands.filter(F.col("count") >= run).select("id")
    hits = near(stash(short.union(long).distinct(), "covered-texts"))
    labelled = docs.select(F.col(id_col).alias("id")).join(hits.withColumn("hit", F.lit(1)), "id", "left")
    return labelled.select(F.col("id").alias(id_col), F.coalesce("hit", F.lit(0)).alias("label"))
