"""A corpus pipeline of five stages: quality rules, line dedup, near-duplicates, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``.  Rows with nulls, very long texts and empty tables pass as the stage's operator defines; columns of any
name pass as they are.  Rows without an id and rows of one id are documents of their own: near-duplicates keep one row
of each group, and decontamination goes by text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanspark.llm import leaks, lines, mixing, neardup, quality
from gleanspark.llm.common import fresh, near_ids, stash, tables


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep."""
    (verdict,) = fresh(docs, "verdict")
    return quality.judge(docs, into=verdict).filter(F.col(verdict)["kept"]).drop(verdict)


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their source's boilerplate lines; n_chars follows the text."""
    (done,) = fresh(docs, "done")
    text = F.col(done)["text"]
    new = lines.drop_boilerplate(docs, into=done).withColumns(
        {"text": text, "n_chars": F.length(text).cast(docs.schema["n_chars"].dataType)}
    )
    return new.select(docs.columns)


def _told_apart(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows and a column that differs between them: the id, or a stored number where ids are missing or shared."""
    if docs.groupBy("doc_id").count().filter("count > 1 or doc_id is null").isEmpty():
        return docs, "doc_id"
    (key,) = fresh(docs, "row")
    return stash(docs.withColumn(key, F.monotonically_increasing_id()), "numbered"), key


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class: that of the smallest id, or any where ids are missing or shared (rows are numbered then)."""
    rows, key = _told_apart(docs)
    later = neardup.near_duplicates(rows, id_col=key).filter(F.col("class_id") != F.col(key)).select(key)
    return rows.join(near_ids(stash(later, "later-copies")), key, "left_anti").select(docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into whose text no benchmark item leaks."""
    rows, key = _told_apart(docs)
    found = leaks.find_leaks(rows.select(key, "text"), tables(spark, sf_dir, "benchmark"), id_col=key)
    leaking = near_ids(stash(found.select(key).distinct(), "leaking"))
    return rows.join(leaking, key, "left_anti").select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of each document in the mix."""
    return mixing.mix(docs)


STAGES = [
    ("quality rules", keep_quality),
    ("line dedup", drop_boilerplate_lines),
    ("near-duplicates", keep_one_of_near_duplicates),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
]

#: Signatures, the latent search and Newton steps have no SQL; tests hold the stages against plain loops.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
