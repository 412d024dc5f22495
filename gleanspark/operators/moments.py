"""Moments over the vocabulary after each word, and the infilling scores that need them, from counts in compressed lists.

A block of texts (``tallies``) knows the whole counts of its words and pairs.  Each distinct pair of the corpus has one owner among
the blocks; it adds the pair to its sums by previous word, which go to that word's bucket.  The bucket adds them up, keeps mean,
deviation and likeliest next word, and answers the blocks.  Of that likeliest word's pairs with the words that texts have
next, a block looks up in the stored buckets what it does not hold itself.  No pair is a row.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanspark.operators.tallies import (
    BLOCK_BYTES,
    BUCKET_BYTES,
    Block,
    Tallied,
    asked_lists,
    bucket_of,
    filled,
    flat_keys,
    joined,
    keys_of,
    lines,
    numbers,
    pack,
    places_of,
    tallied,
    unpack,
)
from gleanspark.sources.scratch import stash


def _floats(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.float64)


def _columns(table: pa.Table, *names: str) -> Iterator[tuple]:
    return zip(*(table[c].to_pylist() for c in names), strict=True)


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), np.uint64, len(words))


def _deviation(mean, square):
    return np.sqrt(np.maximum(square - mean * mean, 0.0) + 1e-8)


@dataclass
class Model:
    """Numbers of buckets; the bigram's weight and the unigram's; words and distinct words; sums of the unigram part (b) and
    of the unigram distribution (u); the likeliest word."""

    n_words: int
    n_pairs: int
    weight: float
    rest: float
    every: float
    b1: float = 0.0
    b2: float = 0.0
    u1: float = 0.0
    u2: float = 0.0
    top: bytes = b""
    top_q: float = 0.0

    def q(self, c: np.ndarray) -> np.ndarray:
        return self.rest * (c + 1) / self.every


def _of_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """c and m: words of a bucket by count; tok: the first word that has the highest."""
    for batch in batches:
        for data in batch.column(1).to_pylist():
            keys, counts, *_ = unpack(data)
            counts = numbers(counts)
            c, m = np.unique(counts, return_counts=True)
            every = keys_of([keys])
            top = min(every.take(pa.array(np.flatnonzero(counts == counts.max()))).to_pylist(), key=lambda w: w[:-1])[:-1]
            columns = [pa.array(c), pa.array(m, pa.int64()), pa.array([*[None] * (len(c) - 1), top], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["c", "m", "tok"])


def _xlog(x: Column, k: int) -> Column:
    return x * F.pow(F.ln(x), F.lit(k))


def _model(tallies: Tallied, weight: float) -> Model:
    rest, every = round(1 - weight, 12), float(tallies.n + tallies.v)
    model = Model(tallies.n_words, tallies.pairs, weight, rest, every)
    counts = tallies.kept.filter(f"bucket < {tallies.n_words}").mapInArrow(_of_counts, "c long, m long, tok binary")
    q, u = F.lit(rest) * (F.col("c") + 1) / F.lit(every), (F.col("c") + 1) / F.lit(every)
    sums = {"b1": _xlog(q, 1), "b2": _xlog(q, 2), "u1": _xlog(u, 1), "u2": _xlog(u, 2)}
    top = F.min(F.when(F.col("tok").isNotNull(), F.struct((-F.col("c")).alias("c"), "tok")))
    row = counts.agg(*(F.sum(F.col("m") * x).alias(k) for k, x in sums.items()), top.alias("top")).first()
    if row.top:
        for k in sums:
            setattr(model, k, float(row[k]))
        model.top, model.top_q = bytes(row.top.tok), float(model.q(np.int64(-row.top.c)))
    return model


class _Scored:
    """A block with its words, pairs by previous (``prev``) and next (``tok``) word, and their probabilities ``p``."""

    def __init__(self, blocks: pa.Table, answers: pa.Table, model: Model):
        self.block: Block = filled(blocks, answers, model.n_words, model.n_pairs)[0]
        self.model, block = model, self.block
        self.words = unpack(blocks["words"][0].as_py())[0].split(b"\n") if block.v else []
        self.prev, self.tok = np.divmod(block.codes, max(block.v, 1))
        self.q = model.q(block.c)
        self.p = model.weight * block.cc / np.maximum(block.cp[self.prev], 1) + self.q[self.tok]
        self.asked = np.unique(self.prev)

    def sums(self) -> Iterator[tuple[int, bytes]]:
        """For each word that another follows: sums over the pairs that the block owns, and the likeliest of these."""
        block, words = self.block, self.words
        own, v = block.own, block.v
        prev, tok, p = self.prev[own], self.tok[own], self.p[own]
        q = self.q[tok]
        lp, lq = np.log(p), np.log(q)
        d1 = np.bincount(prev, p * lp - q * lq, v)
        d2 = np.bincount(prev, p * lp * lp - q * lq * lq, v)
        ended = lines(words)
        rank = np.empty(v, np.int64)
        rank[pc.sort_indices(pa.array(words, pa.large_binary())).to_numpy()] = np.arange(v)
        order = np.lexsort((rank[tok], -p, prev))
        lead = order[np.flatnonzero(np.diff(prev[order], prepend=-1))]
        best_p, best = np.zeros(v), np.full(v, v)
        best_p[prev[lead]], best[prev[lead]] = p[lead], tok[lead]
        at = self.asked
        toks = pa.concat_arrays([ended, lines([b""])]).take(pa.array(best[at]))
        h = _hashes(words)[at]
        values = (x[at] for x in (block.cp, d1, d2, best_p))
        return asked_lists(bucket_of(h, self.model.n_words), ended.take(pa.array(at)), toks, *values)

    def learn(self, answers: pa.Table) -> None:
        """Likeliest next word (``star``, a place in ``stars``) by word and, where these come along, mean, deviation and the
        likeliest word's probability."""
        m, v = self.model, self.block.v
        self.mean, self.sd, self.top = np.zeros(v), np.ones(v), np.ones(v)
        star = [m.top] * v
        first = m.n_words + m.n_pairs
        for bucket, data, more in _columns(answers, "bucket", "data", "more"):
            if first <= bucket < first + m.n_words:
                places, stars = unpack(data)
                at = self.asked[np.cumsum(numbers(places))]
                if more is not None:
                    self.mean[at], self.sd[at], self.top[at] = map(_floats, unpack(more))
                for k, s in zip(at.tolist(), stars.split(b"\n"), strict=False):
                    star[k] = s
        self.stars = sorted({star[k] for k in self.asked.tolist()})
        number = {s: k for k, s in enumerate(self.stars)}
        self.star = np.fromiter((number.get(s, 0) for s in star), np.int64, v)
        # places whose next word is of the same text; star and next word there, and what the block holds of them
        block = self.block
        last = np.zeros(len(block.flat) + 1, bool)
        last[block.ends[1:] - 1] = True
        self.inner = np.flatnonzero(~last[block.later])
        at = block.later[self.inner]
        codes = self.star[block.flat[at - 1]] * max(v, 1) + block.flat[at + 1]
        self.codes, self.found = np.unique(codes, return_inverse=True)
        place = {w: k for k, w in enumerate(self.words)}
        own = np.fromiter((place.get(s, -1) for s in self.stars), np.int64, len(self.stars))
        self.s, self.next = np.divmod(self.codes, max(v, 1))
        self.s_cp, self.s_mean, self.s_sd = np.zeros(len(own), np.int64), np.zeros(len(own)), np.ones(len(own))
        here = np.isin(own, self.asked)
        self.s_cp[here], self.s_mean[here], self.s_sd[here] = (x[own[here]] for x in (block.cp, self.mean, self.sd))
        self.away = np.flatnonzero(~here)
        pair = own[self.s] * max(v, 1) + self.next
        k = np.minimum(np.searchsorted(block.codes, pair), max(len(block.codes) - 1, 0))
        hit = (own[self.s] >= 0) & (block.codes[k] == pair) if len(block.codes) else np.zeros(len(pair), bool)
        self.cc = np.zeros(len(pair), np.int64)
        self.cc[hit] = block.cc[k[hit]]
        self.apart = np.flatnonzero(~hit)

    def wanted(self) -> Iterator[tuple[int, bytes]]:
        """Likeliest words whose moments the block lacks, and their pairs with next words that it does not hold."""
        m, h, hs = self.model, _hashes(self.words), _hashes(self.stars)
        away, apart = self.away, self.apart
        ended = lines(self.stars)
        yield from asked_lists(bucket_of(hs[away], m.n_words), ended.take(pa.array(away)))
        s, n = self.s[apart], self.next[apart]
        both = joined(pa.array(self.stars, pa.large_binary()), s, lines(self.words), n)
        yield from asked_lists(m.n_words + bucket_of((hs[s] << np.uint64(32)) | h[n], m.n_pairs), both)

    def scores(self, answers: pa.Table) -> np.ndarray:
        """The infilling scores of all tokens but the first of the texts."""
        m, block = self.model, self.block
        first = 2 * m.n_words + m.n_pairs
        for bucket, data in _columns(answers, "bucket", "data"):
            if first <= bucket < first + m.n_words:
                places, cp, *values = unpack(data)
                at = self.away[np.cumsum(numbers(places))]
                self.s_cp[at] = numbers(cp)
                self.s_mean[at], self.s_sd[at] = map(_floats, values)
            elif bucket >= first:
                places, cc = map(numbers, unpack(data))
                self.cc[self.apart[np.cumsum(places)]] = cc
        c = block.c[self.next]
        q, cp = m.q(c), self.s_cp[self.s]
        p = m.weight * self.cc / np.maximum(cp, 1) + q
        other = (np.log(p) - self.s_mean[self.s]) / self.s_sd[self.s]
        lone = (np.log((c + 1) / m.every) - m.u1) / _deviation(m.u1, m.u2)
        other = np.where(cp > 0, other, lone)
        lp, mean, sd = np.log(self.p), self.mean[self.prev], self.sd[self.prev]
        z, r0 = (lp - mean) / sd, (lp - np.log(self.top[self.prev])) / sd
        r = r0[block.place]
        r[self.inner] += z[block.place[self.inner + 1]] - other[self.found]
        return r


def _rows(number: int, lists: Iterator[tuple[int, bytes]]) -> pa.Table:
    every = list(lists)
    columns = [
        pa.array([number] * len(every), pa.int64()),
        pa.array([b for b, _ in every], pa.int32()),
        pa.array([d for _, d in every], pa.binary()),
    ]
    return pa.Table.from_arrays(columns, ["block", "bucket", "data"])


_LISTS = "block long, bucket int, data binary"


def _added(model: Model):
    """Sums of blocks as moments of the bucket's words: one answer for each block, and all words in a row of no block."""

    def added(asked: pa.Table) -> pa.Table:
        lists = [unpack(d) for d in asked["data"].to_pylist()]
        found = keys_of([x[0] for x in lists]).dictionary_encode()
        codes, distinct = found.indices.to_numpy(), len(found.dictionary)
        toks = [t for x in lists for t in x[2].split(b"\n")[:-1]]
        cp = np.zeros(distinct, np.int64)
        cp[codes] = np.concatenate([numbers(x[3]) for x in lists])
        d1, d2 = (np.bincount(codes, np.concatenate([_floats(x[k]) for x in lists]), distinct) for k in (4, 5))
        p = np.concatenate([_floats(x[6]) for x in lists])
        top = np.zeros(distinct)
        np.maximum.at(top, codes, p)
        star: list[bytes | None] = [None] * distinct
        for k in np.flatnonzero(p == top[codes]).tolist():
            was = star[codes[k]]
            if was is None or toks[k] < was:
                star[codes[k]] = toks[k]
        for k in np.flatnonzero(top <= model.top_q).tolist():
            if top[k] < model.top_q or model.top < star[k]:
                star[k] = model.top
        top = np.maximum(top, model.top_q)
        mean = model.b1 + d1
        sd = _deviation(mean, model.b2 + d2)
        ended = lines(star)
        kept = [bytes(flat_keys(x)[0]) for x in (found.dictionary, ended)]
        blocks, answers, more, start = [None], [pack(*kept, cp, mean, sd)], [None], 0
        for block, x in zip(asked["block"].to_pylist(), lists, strict=True):
            n = len(x[1]) // 8
            mine = codes[start : start + n]
            start += n
            blocks.append(block)
            answers.append(pack(x[1], bytes(flat_keys(ended.take(pa.array(mine)))[0])))
            more.append(pack(*(y[mine] for y in (mean, sd, top))))
        columns = [
            pa.array(blocks, pa.int64()),
            pa.array([asked["bucket"][0].as_py()] * len(blocks), pa.int32()),
            pa.array(answers, pa.binary()),
            pa.array(more, pa.binary()),
        ]
        return pa.Table.from_arrays(columns, ["block", "bucket", "data", "more"])

    return added


def _found(model: Model):
    """What the stored bucket has of the keys that blocks want: moments of words, counts of pairs (0 if it has none)."""

    def found(wanted: pa.Table, kept: pa.Table) -> pa.Table:
        if not wanted.num_rows:
            return _rows(0, iter(()))
        bucket = wanted["bucket"][0].as_py()
        keys, *values = unpack(kept["data"][0].as_py()) if kept.num_rows else [b""] * 5
        known = keys_of([keys])
        if bucket < model.n_words:
            values = [numbers(values[1]), *map(_floats, values[2:])]
        else:
            values = [numbers(values[0])]
        none = [0, 0.0, 1.0]
        outer = [unpack(d) for d in wanted["data"].to_pylist()]
        lists = [keys_of([x[0]]) for x in outer]
        at = pc.fill_null(pc.index_in(pa.concat_arrays(lists), value_set=known), -1).to_numpy(zero_copy_only=False)
        values = [np.append(x, y)[at] for x, y in zip(values, none, strict=False)]
        answers, start = [], 0
        for x, each in zip(outer, lists, strict=True):
            got = [y[start : start + len(each)] for y in values]
            start += len(each)
            answers.append(pack(x[1], *got))
        first = 2 * model.n_words + model.n_pairs
        columns = [
            wanted["block"].combine_chunks(),
            pa.array([first + bucket] * len(answers), pa.int32()),
            pa.array(answers, pa.binary()),
        ]
        return pa.Table.from_arrays(columns, ["block", "bucket", "data"])

    return found


class Moments:
    """Stored moments of a corpus's words, by bucket (``kept``) and as answers to blocks."""

    def __init__(self, docs: DataFrame, weight: float, id_col: str, text_col: str, block_bytes: int, bucket_bytes: int):
        text = F.coalesce(F.lower(text_col), F.lit("")).cast("binary")
        self.tallies = tallied(docs, id_col, text, block_bytes=block_bytes, bucket_bytes=bucket_bytes, keep=True)
        self.model = model = _model(self.tallies, weight)

        def sums(blocks: pa.Table, answers: pa.Table) -> pa.Table:
            scored = _Scored(blocks, answers, model)
            return _rows(blocks["block"][0].as_py(), scored.sums() if scored.block.v else iter(()))

        asked = self.by_block(self.tallies.answers).applyInArrow(sums, _LISTS)
        added = stash(asked.groupBy("bucket").applyInArrow(_added(model), f"{_LISTS}, more binary"), "moments")
        self.kept = added.filter("block is null").select("bucket", "data")
        shift = (F.col("bucket") + model.n_words + model.n_pairs).cast("int").alias("bucket")
        self.answers = added.filter("block is not null").select("block", shift, "data", "more")

    def by_block(self, answers: DataFrame):
        return self.tallies.blocks.groupBy("block").cogroup(answers.groupBy("block"))

    def losses(self) -> DataFrame:
        """id, uni and bi of every row (``losses.loss_arrays``)."""
        return self.tallies.losses(self.model.weight)

    def words(self) -> DataFrame:
        """prev, mean, sd and likeliest of every word that another follows."""

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for data in batch.column(1).to_pylist():
                    keys, stars, _, mean, sd = unpack(data)
                    names = (pa.array([w.decode() for w in x.split(b"\n")[:-1]], pa.string()) for x in (keys, stars))
                    prev, star = names
                    columns = [prev, pa.array(_floats(mean)), pa.array(_floats(sd)), star]
                    yield pa.RecordBatch.from_arrays(columns, ["prev", "mean", "sd", "likeliest"])

        return self.kept.mapInArrow(rows, "prev string, mean double, sd double, likeliest string")

    def infilling(self) -> DataFrame:
        """id, n and r of every row (``losses.infilling_arrays``)."""
        model = self.model

        def wanted(blocks: pa.Table, answers: pa.Table) -> pa.Table:
            scored = _Scored(blocks, answers, model)
            scored.learn(answers)
            return _rows(blocks["block"][0].as_py(), scored.wanted() if scored.block.v else iter(()))

        def scores(blocks: pa.Table, answers: pa.Table) -> pa.Table:
            scored = _Scored(blocks, answers, model)
            scored.learn(answers)
            block = scored.block
            ids = blocks["ids"].combine_chunks().flatten()
            return pa.Table.from_arrays(
                [ids, pa.array(np.diff(block.ends), pa.int64()), block.lists(scored.scores(answers))], ["id", "n", "r"]
            )

        kept = self.kept.union(self.tallies.kept.filter(f"bucket >= {model.n_words}"))
        stars = self.answers.withColumn("more", F.lit(None).cast("binary"))
        asked = self.by_block(stars).applyInArrow(wanted, _LISTS)
        found = asked.groupBy("bucket").cogroup(kept.groupBy("bucket")).applyInArrow(_found(model), _LISTS)
        others = self.tallies.answers.union(stash(found, "likeliest-words")).withColumn("more", F.lit(None).cast("binary"))
        answers = self.answers.union(others)
        return self.by_block(answers).applyInArrow(scores, f"id {self.tallies.of}, n long, r array<double>")


def moments(
    docs: DataFrame,
    weight: float = 0.7,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
    bucket_bytes: int = BUCKET_BYTES,
) -> Moments:
    return Moments(docs, weight, id_col, text_col, block_bytes, bucket_bytes)


def vocabulary_moments(docs: DataFrame, weight: float = 0.7, **names) -> DataFrame:
    """After each word that another follows: mean and sd of the log-probability over the vocabulary, likeliest word."""
    return moments(docs, weight, **names).words()
