"""Benchmark decontamination by latent semantic retrieval.

Benchmark items are cut into passages.  A truncated SVD of the TF-IDF rows of these passages and of all passages of the
corpus gives a latent basis of far fewer dimensions than passages.  One reading of the corpus counts document
frequencies and multiplies its co-occurrence counts by the benchmark's own leading directions (a randomised SVD, its
products dealt over tasks); the decomposition follows from that product (Nystrom's method).  The corpus as a whole
weighs as much as the benchmark.  Products are sums of whole numbers, whatever task a document is in.
Term weights are the square root of the inverse document frequency on either side, so that a product weighs a shared
word once, and latent directions are scaled to equal variance, so that those that all passages of a language share
don't hide the others.

Every document is read in overlapping windows.  A window is a candidate for a passage if its latent product with it
reaches a share of the passage's product with itself (the cosine, times the window's latent length over the
passage's), so that a window's other words do not hide a short passage.  Candidates whose region lacks the words of
a leak are dropped by presence alone.  The others leak if, within a span of twice the passage's words, the longest
common subsequence of words covers most of the passage, or half of it and the item's answer (its last words) too, as a
paraphrase does.

Two readings of the corpus serve a benchmark of up to ``BLOCK_CHARS`` characters and ``BLOCK_WORDS`` different words;
a longer one is searched in blocks of that size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanspark.llm.common import free, stash

#: Characters and different words of benchmark text in a block: latent rows of its words are 64 MB at a rank of 128.
BLOCK_CHARS, BLOCK_WORDS = 8_000_000, 125_000
#: Words of a window's step (windows are two steps) and of a passage; bytes of text that a worker reads at a time.
STEP, PASSAGE, CHUNK = 48, 48, 1_000_000
#: Steps whose products are summed at a time; the largest number in the directions that corpus counts are multiplied by.
STEPS_OF_SUM, LEVELS = 1024, 1024
#: A word in one of so many steps is multiplied as a matrix's column, a rarer one by itself.
FREQUENT = 64
#: Candidates whose common subsequences are found at a time; words that fit into the bits of a number.
TRIED, BITS = 4096, 64
#: Items of fewer words leak nothing; passages of fewer words than ``SHORT`` leak only as a whole, word by word.
LEAST, SHORT = 4, 8
#: Words in a block of rows of the basis when products are summed; rows of a task.
ROWS_OF_SUM, ROWS_OF_TASK = 8192, 64
_words = re.compile(r"\w+").findall


def words_of(text: str | None) -> list[str]:
    return _words((text or "").lower())


@dataclass(frozen=True)
class Bounds:
    cosine: float = 0.2  # of a candidate: its latent product with a passage over the passage's with itself
    overlap: float = 0.8  # of a leak without its answer
    paraphrase: float = 0.5  # of a leak with its answer
    answer: float = 0.8  # of the answer's words
    span: int = 2  # words that a match may lie in, times those matched against
    rank: int = 128  # of the basis at most; half the passages where these are few, 16 at least


@dataclass(frozen=True)
class Passage:
    item: int
    words: tuple[str, ...]
    answer: tuple[str, ...]
    around: int  # words beyond the region where the answer may be: the item's, where it has other passages


def passages_of(item: int, text: str | None) -> list[Passage]:
    """An item's words cut into passages of about equal length; the answer is the last quarter, three words at least."""
    w = words_of(text)
    if len(w) < LEAST:
        return []
    n = max(1, round(len(w) / PASSAGE))
    edges = [len(w) * i // n for i in range(n + 1)]
    answer = tuple(w[-max(3, len(w) // 4) :])
    return [
        Passage(item, tuple(w[a:b]), answer, len(w) if n > 1 else 0) for a, b in zip(edges, edges[1:], strict=False)
    ]


def common_length(short: tuple[str, ...], long: list[str], span: int) -> int:
    """Length of the longest common subsequence with ``span * len(short)`` neighbouring words of ``long``.

    Spans begin at each half of the short side's length.  The short side's places are the bits of an integer.
    """
    places: dict[str, int] = {}
    for i, w in enumerate(short):
        places[w] = places.get(w, 0) | 1 << i
    hits = [(i, places[w]) for i, w in enumerate(long) if w in places]
    n, full, best, begin = len(short), (1 << len(short)) - 1, 0, 0
    for start in range(0, max(1, len(long) - span * n + max(1, n // 2)), max(1, n // 2)):
        while begin < len(hits) and hits[begin][0] < start:
            begin += 1
        row, end = full, begin
        while end < len(hits) and hits[end][0] < start + span * n:
            hit = row & hits[end][1]
            row = (row + hit | row - hit) & full
            end += 1
        best = max(best, n - row.bit_count())
        if best == n or end == len(hits):
            break
    return best


def leak(p: Passage, words: list[str], first: int, bounds: Bounds) -> tuple[float, bool] | None:
    """Covered share of the passage and whether the answer is there too; None if the step at ``first`` has no leak."""
    region = words[max(0, first - STEP) : first + 3 * STEP]
    n = len(p.words)
    if n < SHORT:
        found = any(region[i] == p.words[0] and tuple(region[i : i + n]) == p.words for i in range(len(region) - n + 1))
        return (1.0, True) if found else None
    share = common_length(p.words, region, bounds.span) / n
    if share < bounds.paraphrase:
        return None
    if p.around:
        region = words[max(0, first - STEP - p.around) : first + 3 * STEP + p.around]
    answered = common_length(p.answer, region, bounds.span) >= bounds.answer * len(p.answer)
    return (share, answered) if share >= bounds.overlap or answered else None


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    held, size = [], 0
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            for row in zip(*(c.to_pylist() for c in batch.slice(i, 256).columns), strict=True):
                held.append(row)
                size += len(row[-1] or "")
                if size > CHUNK:
                    yield held
                    held, size = [], 0
    if held:
        yield held


def _all_numbers(texts: list[list[str]], vocabulary: dict[str, int]) -> np.ndarray:
    """Word number of each word, the vocabulary's size where it has none."""
    of = map(vocabulary.get, chain.from_iterable(texts), repeat(len(vocabulary)))
    return np.fromiter(of, np.int64, sum(map(len, texts)))


def _numbers(
    texts: list[list[str]], vocabulary: dict[str, int], ids: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Word number, text and step (numbered on through the texts) of each word of the vocabulary; steps in all."""
    none = len(vocabulary)
    counts = np.array([len(w) for w in texts], np.int64)
    ids = _all_numbers(texts, vocabulary) if ids is None else ids
    own = np.repeat(np.arange(len(texts)), counts)
    steps = -(-counts // STEP)
    place = np.arange(len(ids)) - (np.cumsum(counts) - counts)[own]
    step = (np.cumsum(steps) - steps)[own] + place // STEP
    known = ids < none
    return ids[known], own[known], step[known], int(steps.sum())


def _sums(rows: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different numbers of ``own``, which is sorted, and the sum of the rows of each."""
    starts = np.flatnonzero(np.append(True, np.diff(own) != 0))
    return own[starts], np.add.reduceat(rows, starts, axis=0)


def _add_products(out: np.ndarray, ids: np.ndarray, step: np.ndarray, directions: np.ndarray) -> None:
    """Add to ``out`` the steps' co-occurrence counts times ``directions`` (whole numbers): sums are exact.

    Sums over a step's words are exact in single precision up to 2**24, beyond any that ``LEVELS`` and a step's or a
    passage's words allow; those over steps are in double precision.
    """
    starts = np.flatnonzero(np.append(True, np.diff(step) != 0)) if len(step) else np.empty(0, np.int64)
    ends = np.append(starts, len(ids))
    for i in range(0, len(starts), STEPS_OF_SUM):
        low, high = ends[i], ends[min(i + STEPS_OF_SUM, len(starts))]
        part, firsts = ids[low:high], starts[i : i + STEPS_OF_SUM] - low
        of = np.repeat(np.arange(len(firsts)), np.diff(np.append(firsts, len(part))))
        times = np.bincount(part, minlength=len(out))
        common = np.flatnonzero(times * FREQUENT >= len(firsts))
        column = np.full(len(out), -1)
        column[common] = np.arange(len(common))
        at = column[part]
        dense = np.bincount((of * len(common) + at)[at >= 0], minlength=len(firsts) * len(common))
        dense = dense.reshape(len(firsts), len(common)).astype(np.float32)
        sums = dense @ directions[common]
        rare = np.flatnonzero(at < 0)
        part, of = part[rare], of[rare]
        if len(part):
            which, more = _sums(directions[part], of)
            sums[which] += more
        sums = sums.astype(np.float64)
        out[common] += dense.T.astype(np.float64) @ sums
        if len(part):
            order = np.argsort(part, kind="stable")
            which, more = _sums(sums[of[order]], part[order])
            out[which] += more


def frequencies(
    docs: DataFrame, vocabulary: dict[str, int], directions: np.ndarray
) -> tuple[int, np.ndarray, int, np.ndarray]:
    """Documents, those with each word of the vocabulary, passages, and their co-occurrence counts times ``directions``.

    One reading of the whole corpus: a document's passages are all its steps.  A task yields its sums for the words it
    met, by blocks of words.
    """
    size, wide = directions.shape
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, directions.astype(np.float32)))
    kinds = "start long, docs long, passages long, words binary, n binary, product binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, directions = shared.value
        counts, total, passages = np.zeros(size, np.int64), 0, 0
        out = np.zeros((size, wide))
        for held in _chunks(batches):
            ids, own, step, n = _numbers([words_of(text) for (text,) in held], vocabulary)
            total += len(held)
            passages += n
            counts += np.bincount(np.unique(own * size + ids) % size, minlength=size)
            _add_products(out, ids, step, directions)
        rows = [(-1, total, passages, b"", b"", b"")]
        for i in range(0, size, ROWS_OF_SUM):
            some = i + np.flatnonzero(counts[i : i + ROWS_OF_SUM])
            product = out[some].astype(np.int64)
            if len(some) and abs(product).max() < 1 << 31:
                product = product.astype(np.int32)
            rows.append((i, 0, 0, *(x.tobytes() for x in (some, counts[some], product))))
        types = [pa.int64()] * 3 + [pa.binary()] * 3
        columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
        yield pa.record_batch(columns, [k.split()[0] for k in kinds.split(", ")])

    def added(part: pd.DataFrame) -> pd.DataFrame:
        start = int(part["start"].iloc[0])
        here = min(ROWS_OF_SUM, size - start) if start >= 0 else 0
        n, out = np.zeros(here, np.int64), np.zeros((here, wide), np.int64)
        for words, counts, product in zip(part["words"], part["n"], part["product"], strict=True):
            at = np.frombuffer(words, np.int64) - start
            n[at] += np.frombuffer(counts, np.int64)
            kind = np.int32 if len(product) == 4 * len(at) * wide else np.int64
            out[at] += np.frombuffer(product, kind).reshape(len(at), wide)
        sums = [int(part[k].sum()) for k in ("docs", "passages")]
        return pd.DataFrame([(start, *sums, b"", n.tobytes(), out.tobytes())], columns=part.columns)

    made = stash(docs.select("_text").mapInArrow(run, kinds), "frequencies")
    sums = made.groupBy("start").applyInPandas(added, kinds).collect()
    free(made)
    shared.unpersist()
    df, product = np.zeros(size), np.zeros((size, wide))
    total = passages = 0
    for r in sums:
        if r.start < 0:
            total, passages = r.docs, r.passages
            continue
        n = np.frombuffer(bytes(r.n), np.int64)
        df[r.start : r.start + len(n)] = n
        product[r.start : r.start + len(n)] = np.frombuffer(bytes(r.product), np.int64).reshape(-1, wide)
    return total, df, passages, product


def latent_basis(spark: SparkSession, rows: list[tuple[list[int], list[float]]], width: int, rank: int, seed: int = 7):
    """The leading right singular vectors (width x rank) of sparse rows and the singular values.

    Randomised subspace iteration.  Rows are dealt over tasks; each round sends the basis out and gets back its
    product with the rows' square, summed over tasks by blocks of words.
    """
    wide = min(rank + 8, width, len(rows))
    tasks = max(2, min(spark.sparkContext.defaultParallelism * 4, -(-len(rows) // ROWS_OF_TASK)))
    dealt = spark.createDataFrame(rows, "at array<int>, value array<double>").repartition(tasks)

    def product(basis: np.ndarray) -> np.ndarray:
        shared = spark.sparkContext.broadcast(basis)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            basis = shared.value
            out = np.zeros((width, basis.shape[1]), np.float32)
            for batch in batches:
                for at, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    out[at] += np.outer(value, np.asarray(value) @ basis[at])
            starts = range(0, width, ROWS_OF_SUM)
            parts = [
                pa.array(starts, pa.int64()),
                pa.array([out[i : i + ROWS_OF_SUM].tobytes() for i in starts], pa.binary()),
            ]
            yield pa.record_batch(parts, ["start", "m"])

        def added(parts: pd.DataFrame) -> pd.DataFrame:
            m = sum(np.frombuffer(x, np.float32).astype(np.float64) for x in parts["m"])
            return pd.DataFrame({"start": parts["start"].iloc[:1], "m": [m.astype(np.float32).tobytes()]})

        sums = dealt.mapInArrow(run, "start long, m binary").groupBy("start").applyInPandas(
            added, "start long, m binary"
        ).collect()
        shared.unpersist()
        whole = b"".join(bytes(r.m) for r in sorted(sums))
        return np.frombuffer(whole, np.float32).reshape(width, -1).astype(np.float64)

    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, wide)))[0].astype(np.float32)
    for _ in range(2):
        basis = np.linalg.qr(product(basis))[0].astype(np.float32)
    square = basis.T.astype(np.float64) @ product(basis)
    values, turn = np.linalg.eigh((square + square.T) / 2)
    order = np.argsort(-values)[:rank]
    return basis @ turn[:, order], np.sqrt(np.maximum(values[order], 0.0))


def fit(
    directions: np.ndarray, product: np.ndarray, weights: np.ndarray, rank: int
) -> tuple[np.ndarray, np.ndarray]:
    """Leading singular vectors and values of weighted rows, from ``product``: their co-occurrence times ``directions``.

    Nystrom's method; the weights cancel in the small matrix.
    """
    small = directions.T @ product
    values, turn = np.linalg.eigh((small + small.T) / 2)
    some = values > 1e-10 * max(values[-1], 1e-300)
    root = weights[:, None] * (product @ (turn[:, some] / np.sqrt(values[some])))
    basis, values, _ = np.linalg.svd(root, full_matrices=False)
    return basis[:, :rank], values[:rank]


def _joined(of: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Presence in a step joined over the region that ``leak`` reads: the step before it and the two after it too."""
    out = of.copy()
    for by in (-1, 1, 2):
        a, b = (slice(None, -by), slice(by, None)) if by > 0 else (slice(-by, None), slice(None, by))
        same = own[a] == own[b]
        out[a] |= of[b] & same[:, None]
    return out


def _weights(total: int, df: np.ndarray) -> np.ndarray:
    """Square roots of the inverse document frequencies, above zero for words in all documents."""
    return np.sqrt(np.log(1.0 + total / np.maximum(df, 1)))


class Searcher:
    """Finds a block's passages in documents."""

    def __init__(self, passages: list[Passage], vocabulary: dict[str, int], rows: np.ndarray, bounds: Bounds):
        """``rows`` are the latent rows of the words, weights and scales included."""
        self.passages, self.vocabulary, self.bounds = passages, vocabulary, bounds
        self.rows = np.concatenate([rows, np.zeros((1, rows.shape[1]))]).astype(np.float32)
        of = [[vocabulary[w] for w in p.words] for p in passages]
        none = len(vocabulary)
        latent = np.stack([self.rows[w].sum(axis=0) for w in of])
        square = (latent.astype(np.float64) ** 2).sum(axis=1)
        self.directions = (latent / np.maximum(square, 1e-9)[:, None]).T.astype(np.float32).copy()
        self.dark = np.flatnonzero(square < 1e-6)  # passages that the basis doesn't show are candidates everywhere
        bits = [np.left_shift(np.uint64(1), np.arange(len(w), dtype=np.uint64)) if len(w) <= BITS else None for w in of]
        #: Different words of each passage, and their places in it as bits; None for passages that the bits can't hold.
        self.places = [None if b is None else self._places(np.array(w), b) for w, b in zip(of, bits, strict=True)]
        pad = lambda lists: np.array([w + [none] * (max(map(len, lists)) - len(w)) for w in lists], np.int32)
        self.of, self.answers = pad(of), pad([[vocabulary[w] for w in p.answer] for p in passages])
        self.n = n = np.array([len(w) for w in of])
        m = np.array([len(p.answer) for p in passages])
        self.least = np.where(n < SHORT, n, np.ceil(bounds.paraphrase * n - 1e-9)).astype(np.int32)
        self.enough = np.ceil(bounds.overlap * n - 1e-9).astype(np.int32)
        alone = np.array([p.around == 0 for p in passages])
        self.answered = np.where(alone, np.ceil(bounds.answer * m - 1e-9), 0).astype(np.int32)

    def __call__(self, texts: list[str | None]) -> Iterator[tuple[int, int, float, bool]]:
        """Text number, passage number, share and answer of the leaks."""
        words = [words_of(t) for t in texts]
        none = len(self.vocabulary)
        steps = np.array([-(-len(w) // STEP) for w in words], np.int64)
        last = np.cumsum(steps)
        n = int(last[-1]) if len(last) else 0
        if not n:
            return
        every = _all_numbers(words, self.vocabulary)
        ids, _, step, _ = _numbers(words, self.vocabulary, every)
        own = np.repeat(np.arange(len(words)), steps)
        begins = np.searchsorted(step, np.arange(n + 1))
        sizes = np.array([len(w) for w in words], np.int64)
        text_ends = np.cumsum(sizes)
        wide = max(16, 8_000_000 // (none + 1))
        seen: dict[tuple[int, int], tuple[float, bool]] = {}
        for i in range(0, n, wide):  # a block of steps, with those around that its windows and regions need
            low, high = max(0, i - 1), min(n, i + wide + 2)
            at, here = ids[begins[low] : begins[high]], step[begins[low] : begins[high]] - low
            vectors = self._vectors(at, here, high - low)
            mine = np.arange(i - low, min(n, i + wide) - low)
            follows = own[low + mine] == own[np.minimum(low + mine + 1, n - 1)]
            follows &= low + mine + 1 < n
            window = vectors[mine] + np.where(follows, 1, 0)[:, None].astype(np.float32) * vectors[
                np.minimum(mine + 1, high - low - 1)
            ]
            near = window @ self.directions >= self.bounds.cosine
            near[:, self.dark] = True
            k, p = np.nonzero(near)
            if not len(k):
                continue
            present = np.zeros((high - low, none + 1), bool)
            present[here, at] = True
            k, p = self._possible(_joined(present, own[low:high]), mine[k], p)
            text = own[k + low]
            first = (k + low - (last - steps)[text]) * STEP
            keep = self._alike(every, (text_ends - sizes)[text], text_ends[text], first, p)
            k, p = k[keep], p[keep]
            for step_, passage in zip((k + low).tolist(), p.tolist(), strict=True):
                text = int(own[step_])
                if seen.get((text, passage), (0.0, False))[0] < 1.0:
                    first = (step_ - int(last[text] - steps[text])) * STEP
                    found = leak(self.passages[passage], words[text], first, self.bounds)
                    if found and found > seen.get((text, passage), (0.0, False)):
                        seen[text, passage] = found
        for (text, passage), (share, answered) in seen.items():
            yield text, passage, share, answered

    def _vectors(self, ids: np.ndarray, step: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros((n, self.rows.shape[1]), np.float32)
        starts = np.flatnonzero(np.append(True, np.diff(step) != 0)) if len(step) else np.empty(0, np.int64)
        ends = np.append(starts, len(ids))
        for i in range(0, len(starts), 256):  # a few steps at a time, as rows of words take memory
            part = ids[ends[i] : ends[min(i + 256, len(starts))]]
            out[step[starts[i : i + 256]]] = np.add.reduceat(self.rows[part], starts[i : i + 256] - ends[i], axis=0)
        return out

    @staticmethod
    def _places(words: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        different, at = np.unique(words, return_inverse=True)
        places = np.zeros(len(different), np.uint64)
        np.bitwise_or.at(places, at, bits)
        return different, places

    def _alike(
        self, every: np.ndarray, begin: np.ndarray, end: np.ndarray, first: np.ndarray, p: np.ndarray
    ) -> np.ndarray:
        """Numbers of the candidates whose common subsequence is long enough for a paraphrase, as ``leak`` finds it.

        Many at a time, places of a passage being bits of a number.  Passages that are too short or too long for that
        are kept.  ``begin`` and ``end`` bound a candidate's text in ``every``, ``first`` is its step's first word.
        """
        long = np.array([x is None for x in self.places])
        kept = [np.flatnonzero((self.n[p] < SHORT) | long[p])]
        tried = np.flatnonzero((self.n[p] >= SHORT) & ~long[p])
        tried = tried[np.argsort(p[tried], kind="stable")]
        table = np.zeros(len(self.vocabulary) + 1, np.uint64)
        wide, span = 4 * STEP, self.bounds.span
        for i in range(0, len(tried), TRIED):
            some = tried[i : i + TRIED]
            low = begin[some] + np.maximum(0, first[some] - STEP)
            high = np.minimum(end[some], begin[some] + first[some] + 3 * STEP)
            at = low[:, None] + np.arange(wide)
            region = np.where(at < high[:, None], every[np.minimum(at, len(every) - 1)], len(self.vocabulary))
            hits = np.zeros((len(some), wide + span * BITS), np.uint64)
            cuts = np.flatnonzero(np.append(True, np.diff(p[some]) != 0))
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(some)], strict=True):
                different, places = self.places[p[some[a]]]
                table[different] = places
                hits[a:b, :wide] = table[region[a:b]]
                table[different] = 0
            n = self.n[p[some]]
            half = np.maximum(1, n // 2)
            spans = -(-np.maximum(1, high - low - span * n + half) // half)
            which = np.repeat(np.arange(len(some)), spans)
            start = (np.arange(len(which)) - np.repeat(np.cumsum(spans) - spans, spans)) * half[which]
            order = np.argsort(-n[which], kind="stable")
            which, start = which[order], start[order]
            base, length = which * hits.shape[1] + start, span * n[which]
            flat = hits.ravel()
            full = np.uint64(2**64 - 1) >> (64 - n[which]).astype(np.uint64)
            rows = full.copy()
            for t in range(int(length[0])):
                m = int(np.searchsorted(-length, -t))  # spans of more than t words come first
                row = rows[:m]
                hit = row & flat[base[:m] + t]
                rows[:m] = (row + hit) | (row - hit)
            best = np.zeros(len(some), np.int64)
            np.maximum.at(best, which, n[which] - np.bitwise_count(rows & full).astype(np.int64))
            kept.append(some[best / n >= self.bounds.paraphrase])
        return np.sort(np.concatenate(kept))

    def _possible(self, present: np.ndarray, k: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of candidates those whose region has the words of a leak: no subsequence is longer than the words present."""
        keep = []
        for i in range(0, len(k), 65_536):
            a, b = k[i : i + 65_536], p[i : i + 65_536]
            have = present[a[:, None], self.of[b]].sum(axis=1, dtype=np.int32)
            some = np.flatnonzero(have >= self.least[b])
            a, b, have = a[some], b[some], have[some]
            told = present[a[:, None], self.answers[b]].sum(axis=1, dtype=np.int32) >= self.answered[b]
            keep.append(i + some[(have >= self.enough[b]) | told])
        at = np.concatenate(keep)
        return k[at], p[at]


def _search_block(docs: DataFrame, passages: list[Passage], bounds: Bounds) -> DataFrame:
    """id, item, overlap and answered of the leaks of one block of passages, which the driver holds."""
    spark = docs.sparkSession
    vocabulary = {w: i for i, w in enumerate(sorted({w for p in passages for w in p.words + p.answer}))}
    of = [np.array([vocabulary[w] for w in p.words], np.int64) for p in passages]
    distinct = [np.unique(own, return_counts=True) for own in of]
    own_df = np.bincount(np.concatenate([at for at, _ in distinct]), minlength=len(vocabulary))
    first = _weights(len(passages), own_df)
    rows = [(at.tolist(), (n * first[at]).tolist()) for at, n in distinct]
    rank = max(16, min(bounds.rank, len(passages) // 2))
    directions = first[:, None] * latent_basis(spark, rows, len(vocabulary), rank + 8)[0]
    directions = np.round(directions * (LEVELS / np.maximum(abs(directions).max(axis=0), 1e-300)))
    total, df, n, product = frequencies(docs, vocabulary, directions)
    weights = _weights(total, df)
    product *= len(passages) / max(n, 1)
    numbers = np.repeat(np.arange(len(of)), [len(own) for own in of])
    _add_products(product, np.concatenate(of), numbers, directions.astype(np.float32))
    basis, values = fit(directions, product, weights, rank)
    some = values > 1e-6 * values[0]
    basis = basis[:, some] / values[some]
    shared = spark.sparkContext.broadcast((passages, vocabulary, (basis * weights[:, None]).astype(np.float32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Searcher(*shared.value, bounds)
        kinds = {"id": pa.int64(), "item": pa.int64(), "overlap": pa.float64(), "answered": pa.bool_()}
        for held in _chunks(batches):
            texts = [x for _, x in held]
            found = [(held[t][0], search.passages[p].item, share, answered) for t, p, share, answered in search(texts)]
            if found:
                columns = [pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds.values(), strict=True)]
                yield pa.record_batch(columns, list(kinds))

    return docs.select("_id", "_text").mapInArrow(run, "id long, item long, overlap double, answered boolean")


def _blocks(items: DataFrame) -> Iterator[list[Passage]]:
    """Passages of all items in blocks of ``BLOCK_CHARS`` characters and ``BLOCK_WORDS`` different words, about."""
    n = max(1, -(-int(items.agg(F.sum(F.length("text"))).first()[0] or 0) // BLOCK_CHARS))
    for k in range(n):
        held: list[Passage] = []
        known: set[str] = set()
        for item, text in items.filter(F.pmod(F.xxhash64("item"), F.lit(n)) == k).collect():
            held += passages_of(item, text)
            known.update(words_of(text))
            if len(known) > BLOCK_WORDS:
                yield held
                held, known = [], set()
        if held:
            yield held


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    bounds: Bounds = Bounds(),
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """``id_col``, ``item_col``, overlap and answered of every document and item that leaks into it.

    Words are runs of letters, digits and underscores in lower case.  overlap is the best covered share of one
    of the item's passages.  Null and empty texts, and items of fewer than four words (null and empty ones too), leak
    nothing; items of fewer than eight leak only where all their words stand side by side; items of words that every
    document has are searched like others.  Very long texts are read window by window.  A document without an id is
    reported with a null id; rows of one id, and equal items, are reported once for each id and item.  Ids and items
    must be integers; other columns are dropped, whatever their names.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).alias("text"))
    parts = [stash(_search_block(rows, block, bounds), "leaks") for block in _blocks(items)]
    if not parts:
        return spark.createDataFrame([], f"{id_col} long, {item_col} long, overlap double, answered boolean")
    every = parts[0]
    for part in parts[1:]:
        every = every.union(part)
    best = [F.max("overlap").alias("overlap"), F.max("answered").alias("answered")]
    return every.groupBy(F.col("id").alias(id_col), F.col("item").alias(item_col)).agg(*best)


def brute_force(
    docs: list[tuple[int, str | None]], items: list[tuple[int, str | None]], bounds: Bounds = Bounds()
) -> set[tuple[int, int]]:
    """Leaking pairs, with every window of every document tried against every passage, for tests."""
    out = set()
    split = [(d, words_of(t)) for d, t in docs]
    for item, text in items:
        for p in passages_of(item, text):
            own = set(p.words)
            for d, w in split:
                if sum(x in own for x in w) >= bounds.paraphrase * min(SHORT, len(p.words)):
                    if any(leak(p, w, i, bounds) for i in range(0, len(w), STEP)):
                        out.add((d, item))
    return out
