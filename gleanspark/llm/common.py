"""What the operators of this package share: the word rule, scratch tables, small SQL pieces."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanspark.sources.scratch import free, scratch_dir, scratch_path, stash

__all__ = ["free", "scratch_dir", "scratch_path", "stash"]

#: A word is a maximal run of characters other than these six; ``bytes.split()`` splits at the same six bytes.
SPACES = r"\x20\x09-\x0D"
WORD = rf"[^{SPACES}]+"

#: Rows of ids that are broadcast at most.
BROADCAST_IDS = 500_000


def near_ids(ids: DataFrame, limit: int = BROADCAST_IDS) -> DataFrame:
    """A stored table of ids for a join: broadcast up to ``limit`` rows, shuffled beyond."""
    return F.broadcast(ids) if ids.count() <= limit else ids


#: Characters of a table that is broadcast at most.
BROADCAST_CHARS = 8_000_000


def broadcast_small(stored: DataFrame, limit: int = BROADCAST_CHARS) -> DataFrame:
    """A stored table for a join: broadcast up to ``limit`` bytes of its values as text, shuffled beyond."""
    size = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in stored.columns), F.lit(24).cast("long"))
    return F.broadcast(stored) if (stored.agg(F.sum(size)).first()[0] or 0) <= limit else stored


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until no column of ``df`` has them (in any case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """Array of the words of a text; null counts as empty."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def count_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def tables(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
