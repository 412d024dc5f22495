"""Token losses of an n-gram model trained on the corpus itself: the stand-in for language-model losses."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleanspark.functions.text import tokens
from gleanspark.sources.scratch import near, stash


def token_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, pos (from 0), tok and prev (null for the first token)."""
    words = docs.select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("w"))
    before = F.concat(
        F.array(F.lit(None).cast("string")), F.slice("w", F.lit(1), F.greatest(F.size("w") - 1, F.lit(0)))
    )
    pairs = F.arrays_zip(before.alias("prev"), F.col("w").alias("tok"))
    placed = words.filter(F.size("w") > 0).select("id", F.posexplode(pairs).alias("pos", "t"))
    return placed.select("id", "pos", F.col("t.tok").alias("tok"), F.col("t.prev").alias("prev"))


@dataclass
class Counts:
    """Stored counts of a corpus: of pairs (prev is null at a text's start), of words, and of all.

    One reading and one shuffle of the corpus, with sums before the shuffle; the others come from the pairs.
    """

    pairs: DataFrame  # prev, tok, cc
    words: DataFrame  # tok, c
    n: int
    v: int


def count(docs: DataFrame, **names: str) -> Counts:
    pairs = stash(token_table(docs, **names).groupBy("prev", "tok").agg(F.count(F.lit(1)).alias("cc")), "pair-counts")
    return _counts(pairs, stash(pairs.groupBy("tok").agg(F.sum("cc").alias("c")), "word-counts"))


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cased: bool = False) -> Counts:
    """Counts of words alone (no pairs), in their own case if asked for."""
    words = docs.select(F.explode(tokens(F.col(text_col), cased)).alias("tok"))
    return _counts(None, stash(words.groupBy("tok").agg(F.count(F.lit(1)).alias("c")), "word-counts"))


def _counts(pairs: DataFrame | None, words: DataFrame) -> Counts:
    n, v = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    return Counts(pairs, words, int(n), int(v))


def unigram_losses(
    docs: DataFrame,
    counts: Counts,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    lower: bool = False,
    cased: bool = False,
    first: bool = False,
) -> DataFrame:
    """id, n and total: number and sum of the add-one unigram losses of each text's tokens but the first (or with it).

    No token is shuffled while the words can be broadcast; beyond that, words are counted by text first.  Words that
    the counts lack have the loss of a count of 0.  ``lower`` looks up the lower-cased words.
    """
    w = tokens(F.col(text_col), cased and not lower)
    words = docs.select(
        F.col(id_col).alias("id"),
        F.explode(w if first else F.slice(w, F.lit(2), F.greatest(F.size(w), F.lit(1)))).alias("tok"),
    )
    known = near(counts.words)
    each = words.withColumn("m", F.lit(1).cast("long"))
    if known is counts.words:
        each = words.groupBy("id", "tok").agg(F.count(F.lit(1)).alias("m"))
    loss = -F.ln((F.coalesce("c", F.lit(0)) + 1) / F.lit(float(counts.n + counts.v)))
    joined = each.join(known, "tok", "left")
    return joined.groupBy("id").agg(F.sum("m").alias("n"), F.sum(loss * F.col("m")).alias("total"))


def bigram_model(counts: Counts, weight: float = 0.7) -> DataFrame:
    """prev, tok and the losses uni (add-one unigram) and bi (bigram interpolated with it)."""
    pairs = counts.pairs.filter("prev is not null")
    ahead = stash(pairs.groupBy("prev").agg(F.sum("cc").alias("cp")), "ahead-counts")
    p_uni = (F.col("c") + 1) / F.lit(float(counts.n + counts.v))
    bi = -F.ln(F.lit(weight) * F.col("cc") / F.col("cp") + F.lit(1 - weight) * p_uni)
    joined = pairs.join(near(counts.words), "tok").join(near(ahead), "prev")
    return joined.select("prev", "tok", (-F.ln(p_uni)).alias("uni"), bi.alias("bi"))


def of_all_texts(docs: DataFrame, scores: DataFrame, fill: dict[str, object], id_col: str = "doc_id") -> DataFrame:
    """``scores`` (by id) for every text; texts without one (too few tokens) take the values of ``fill``."""
    return docs.select(F.col(id_col).alias("id")).join(scores, "id", "left").fillna(fill)


def vote_diagnostics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, input_tokens, nll_len (losses that both models have) and short (too few to vote) of every text."""
    n = F.size(F.coalesce(tokens(F.col(text_col)), F.array().cast("array<string>"))).cast("long")
    losses = F.greatest(n - 1, F.lit(0).cast("long"))
    return docs.select(
        F.col(id_col).alias("id"), n.alias("input_tokens"), losses.alias("nll_len"), (losses < 2).alias("short")
    )


def greedy_successors(counts: Counts) -> DataFrame:
    """prev and tok: the word that most often follows each word, the first by code point on ties."""
    pairs = counts.pairs.filter("prev is not null")
    return pairs.groupBy("prev").agg(F.min_by("tok", F.struct((-F.col("cc")).alias("c"), "tok")).alias("tok"))


def greedy_decode(prompts: DataFrame, successors: DataFrame, steps: int) -> DataFrame:
    """``prompts`` with words: what greedy decoding adds after the column last, step by step for all prompts at once.

    A step is a join with the stored successors (broadcast where small); a prompt ends where its last word has none.
    """
    after = near(stash(successors.select(F.col("prev").alias("_prev"), F.col("tok").alias("_next")), "successors"))
    rows = prompts.withColumns({"_now": F.col("last"), "words": F.array().cast("array<string>")})
    for _ in range(steps):
        rows = rows.join(after, F.col("_now") == F.col("_prev"), "left")
        more = F.when(F.col("_next").isNotNull(), F.concat("words", F.array("_next"))).otherwise(F.col("words"))
        rows = rows.withColumns({"words": more, "_now": F.col("_next")}).drop("_prev", "_next")
    return rows.drop("_now")


def window_sizes(low: int, high: int, n: int) -> list[int]:
    """Geometric window sizes; (2, 40, 10) has a list of its own (fixed value)."""
    if (low, high, n) == (2, 40, 10):
        return [2, 3, 4, 6, 9, 13, 18, 25, 32, 40]
    if n <= 1:
        return [low]
    return sorted({round(low * (high / low) ** (k / (n - 1))) for k in range(n)})
