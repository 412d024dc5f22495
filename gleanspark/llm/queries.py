"""One query for each operator, over its whole table; SQL where SQL can express the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanspark.llm import (
    divergence,
    infill,
    leaks,
    lines,
    mixing,
    neardup,
    oracles,
    quality,
    repeats,
    secret_scan,
    tokens,
    urls,
    warc,
    wrapper,
)
from gleanspark.llm.common import tables

TOKENIZER = "word_bpe_49k.json"
URL_RULES = [
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
]


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.count_tokens(tables(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = repeats.remove_repeats(tables(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.round_trip(tables(spark, sf_dir, "pages"))
    return read.select(
        warc.page_id("id").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        F.col("type").alias("record_type"),
        warc.page_id("refers_to").alias("refers_to"),
    )


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(tables(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "copies"
    )


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = quality.judge(tables(spark, sf_dir, "documents").select("doc_id", "text"), into="_q")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return q.select("doc_id", *(F.col(f"_q.m.{n}") for n in names), "_q.base_failed", "_q.kept")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(tables(spark, sf_dir, "pages"), URL_RULES)


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(tables(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.find_leaks(tables(spark, sf_dir, "documents"), tables(spark, sf_dir, "benchmark"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.find_secrets(tables(spark, sf_dir, "documents")))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = lines.drop_boilerplate(tables(spark, sf_dir, "documents"))
    return done.select(
        "doc_id", "line_dedup.n_lines", "line_dedup.n_dropped", F.sha2("line_dedup.text", 256).alias("text_sha256")
    )


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.digest(tables(spark, sf_dir, "documents"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(tables(spark, sf_dir, "documents"))


def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = wrapper.extract(tables(spark, sf_dir, "pages"))
    text = F.col("main.text")
    return done.select("page_id", "url", text.alias("text"), F.length(text).cast("long").alias("n_chars"))


_ALL = (
    op1_token_counts,
    op2_substring_dedup,
    op3_warc,
    op4_mixing,
    op5_quality_rules,
    op6_url_filter,
    op7_near_duplicates,
    op8_decontamination,
    op9_secret_scan,
    op10_line_dedup,
    op11_fill_in_middle,
    op12_source_divergence,
    op13_html_extraction,
)
QUERIES = {f.__name__: f for f in _ALL}
SQL: dict[str, str] = {
    "op2_substring_dedup": oracles.repeats(),
    "op3_warc": oracles.warc(),
    "op5_quality_rules": oracles.rules(),
    "op6_url_filter": oracles.urls(URL_RULES),
    "op10_line_dedup": lines.sql(),
    "op11_fill_in_middle": infill.sql(),
    "op12_source_divergence": divergence.sql(),
}
