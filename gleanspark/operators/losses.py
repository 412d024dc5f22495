"""Token losses of the corpus's own n-gram model as arrays, one for each text.

Texts are cut into blocks of bounded size, which ask for the counts of their distinct words and pairs (``tallies``), so that
what is shuffled grows with these, not with tokens.  Windows of all sizes come from one array's running sums.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanspark.operators.moments import moments
from gleanspark.operators.tallies import BLOCK_BYTES, Block, tallied


def loss_arrays(
    docs: DataFrame,
    weight: float = 0.7,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """id, uni and bi of every row: the losses of all tokens but the first, in order.

    ``uni`` is the add-one unigram loss, ``bi`` that of the bigram interpolated with it.  Null texts and texts of fewer
    than two words have empty arrays; repeated rows stay repeated; other columns are dropped.
    """
    return tallied(docs, id_col, _bytes(F.lower(text_col)), block_bytes=block_bytes).losses(weight)


def _bytes(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).cast("binary")


def unigram_means(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, mean add-one unigram loss of the lower-cased tokens but the first; null without one; rows stay repeated."""
    tallies = tallied(docs, id_col, _bytes(F.lower(text_col)), pairs=False)
    every = float(tallies.n + tallies.v)

    def scored(block: Block) -> list[pa.Array]:
        return [block.means(-np.log((block.c + 1) / every))]

    return tallies.look_up(scored, "nll double")


def cased_means(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, own and low: the mean unigram loss of the tokens but the first in their own and in lower case.

    The model is one of words in their own case; null for texts of fewer than two words.
    """
    tallies = tallied(docs, id_col, _bytes(F.col(text_col)), _bytes(F.lower(text_col)), pairs=False)
    every = float(tallies.n + tallies.v)

    def scored(block: Block, low: Block) -> list[pa.Array]:
        loss = -np.log((block.c + 1) / every)
        return [block.means(loss), low.means(loss)]

    return tallies.look_up(scored, "own double, low double")


def infilling_arrays(
    docs: DataFrame,
    weight: float = 0.7,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """id, n (words) and r of every row: the infilling scores of all tokens but the first, in order.

    A token's log-probability is standardized by mean and deviation over the vocabulary after the previous word, less
    that of the likeliest word there (star); the next token's standardized log-probability comes in less the one it has
    after that likeliest word, which is that of the unigram distribution if nothing follows the word.  Later places have the
    same terms in both texts, as the model sees one word back.
    Null texts and texts of fewer than two words have empty arrays; repeated rows stay repeated.
    """
    return moments(docs, weight, id_col=id_col, text_col=text_col, block_bytes=block_bytes).infilling()


def infilling_mean(scores: DataFrame, share: float = 0.1, last: int | None = None, least: int = 2) -> DataFrame:
    """id and score of every text: the mean of the lowest ``share`` of r, over the ``last`` tokens if given.

    A text of fewer than ``least`` tokens, or without a score, has 0.
    """

    def lowest(n: int, r: np.ndarray) -> float:
        some = r if last is None else r[max(len(r) - last + 1, 0) :]
        if n < least or not len(some):
            return 0.0
        k = max(1, int(np.floor(len(some) * share)))
        return float(np.mean(np.partition(some, k - 1)[:k]))

    return scores.select("id", _each(lowest, F.col("n"), F.col("r")).alias("score"))


def arrays_of(rows: DataFrame) -> DataFrame:
    """The same form from rows of id, pos, uni and bi."""
    listed = rows.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "uni", "bi"))).alias("x"))
    return listed.select("id", F.col("x.uni").alias("uni"), F.col("x.bi").alias("bi"))


# --- windows ----------------------------------------------------------------------------------------------------------


def running(losses: np.ndarray) -> np.ndarray:
    """Sums of the first 0, 1, 2 ... losses."""
    return np.concatenate(([0.0], np.cumsum(losses)))


def _each(score: Callable[..., float | None], *columns: Column) -> Column:
    """``score`` of each row's arrays; null where it gives None."""

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for batch in batches:
            rows = zip(*(batch[c] for c in batch), strict=True)
            yield pd.Series([score(*row) for row in rows], dtype=object).astype("float64")

    return scored(F.struct(*columns))


def vote(uni: np.ndarray, bi: np.ndarray, sizes: Sequence[int]) -> float | None:
    """The mean over window sizes of the share of windows whose reference loss exceeds the target's."""
    sums = running(uni - bi)
    shares = [np.mean(sums[w:] > sums[:-w]) for w in sizes if w < len(sums)]
    return float(np.mean(shares)) if shares else None


def least_mean(losses: np.ndarray, width: int) -> float | None:
    """The least mean of ``width`` losses in a row, of all where there are fewer."""
    sums = running(losses)
    if len(sums) <= width:
        return float(sums[-1] / len(losses)) if len(losses) else None
    return float((sums[width:] - sums[:-width]).min() / width)


def votes(sizes: Sequence[int]) -> Column:
    """``vote`` of each row's losses; null without a window."""
    return _each(lambda u, b: vote(u, b, sizes), F.col("uni"), F.col("bi"))


def minimum(width: int) -> Column:
    """Minus the least mean loss of ``width`` tokens, of all tokens where there are fewer; null without losses."""
    return -_each(lambda b: least_mean(b, width), F.col("bi"))


def window_vote(losses: DataFrame, sizes: Sequence[int]) -> DataFrame:
    """id and score (``vote``) of the texts that have a window of some size."""
    return losses.select("id", votes(sizes).alias("score")).filter("score is not null")


def window_minimum(losses: DataFrame, width: int) -> DataFrame:
    """id and score (``minimum``) of the texts that have losses."""
    return losses.select("id", minimum(width).alias("score")).filter("score is not null")


def window_perplexity(losses: DataFrame, width: int) -> DataFrame:
    """id and perplexity: the least of windows of ``width`` tokens scored without context (uni).

    The last window is left out, as in the published table: a text of just ``width`` tokens is infinite, a shorter
    one is scored whole.
    """

    def least(losses: np.ndarray) -> float | None:
        return least_mean(losses if len(losses) < width else losses[:-1], width) if len(losses) != width else np.inf

    score = _each(least, F.col("uni"))
    return losses.select("id", F.exp(score).alias("perplexity")).filter("perplexity is not null")


def mean(losses: Column) -> Column:
    """Null for an empty array."""
    return F.aggregate(losses, F.lit(0.0), lambda s, x: s + x, lambda s: s / F.nullif(F.size(losses), F.lit(0)))
