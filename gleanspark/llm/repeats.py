"""Exact removal of repeated word windows by super-k-mer partitioning.

A window's minimiser is the least hash among its runs of ``m`` words.  Consecutive windows of a document with
the same minimiser travel as one packed string (their words, once each) to the minimiser's bucket.  Equal
windows have equal minimisers, so they meet in one bucket; there their words are sorted and equal neighbours
share the smallest document that holds them.  Buckets arrive sorted by document and are read as a stream:
a bucket that one document alone fills is passed over, and what is kept in memory are the distinct windows of
one bucket, up to a number: rows with other windows are handed on, and their windows are dealt one by one, by a hash of
all their words.  Equal packed strings of one map batch are merged before the shuffle, so that a passage in a third of
all documents costs its bucket one row per batch and not one per document.

Buckets that a sample of the documents shows to be large (a frequent pair of words) are split by a second minimiser of
more words, and those that are large still (a template's first words, with many different ends) by the whole window:
equal windows share these too, and still meet.

Packed strings travel compressed with a small dictionary, as neighbours share most of their words.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanspark.llm.common import stash

#: Bytes of text that a worker packs at a time, windows in one packed string, words whose hash it remembers,
#: documents listed in one row, rows of a bucket and bytes of unpacked strings that are sorted at a time.
CHUNK, LONGEST, REMEMBERED, LISTED, SORTED, SORTED_BYTES = 1_000_000, 256, 100_000, 4096, 512, 1_000_000
#: Runs of words shorter than this many bytes become minimisers only where there is no other: they are frequent.
FREQUENT_BYTES = 9
#: The dictionary is trained on this many texts' first characters; it changes sizes, never results.
SAMPLE_TEXTS, SAMPLE_CHARS, DICTIONARY = 400, 4000, 16_384
#: Buckets of more rows than this, as a share of the documents tells, are split by a minimiser of so many words; at
#: most so many buckets are (beyond that, the largest).  This decides where windows meet, never which are equal.
LARGE, SHARE, SECOND, SPLIT = 200_000, 0.01, 6, 1_000_000


#: Distinct windows of a bucket in memory (some 230 bytes each), not counting those of the rows sorted last.
SEEN = 300_000
#: Windows that are dealt one by one in a batch.
DEALT = 20_000


class WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while have < width:
        step = min(have, width - have)
        x = np.minimum(x[:-step], x[step:])
        have += step
    return x


def _bucket(least: np.ndarray) -> np.ndarray:
    return (least >> np.uint64(24)).astype(np.uint32).view(np.int32)


class Packer:
    """Super-k-mers of whole documents."""

    def __init__(self, window: int, m: int, dictionary: bytes = b"", large: Sequence[np.ndarray] = ()):
        """``large`` are the sorted numbers of the buckets to be split by the second minimiser, and by the window."""
        self.window, self.m, self.hashes = window, m, WordHash()
        self.large = large
        self.zip = zstandard.ZstdCompressor(
            level=1, dict_data=zstandard.ZstdCompressionDict(dictionary), write_dict_id=False
        ).compress

    def __call__(self, rows: Iterable[tuple[int, int, str]]) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
        """Lists of buckets, smallest documents and packed data; rows are document, key of its text, text."""
        held, size = [], 0
        for doc, key, text in rows:
            words = text.encode("utf-8", "replace").split()
            if len(words) >= self.window:
                held.append((doc, key, words))
                size += len(text)
            if size > CHUNK:
                yield self._pack(held)
                held, size = [], 0
        if held:
            yield self._pack(held)

    def _least(self, h: np.ndarray, lens: np.ndarray, m: int) -> np.ndarray:
        """The least rank of the runs of ``m`` words in each window."""
        n = len(h) - m + 1
        run, chars = h[:n].copy(), lens[:n].copy()
        for i in range(1, m):
            run = _mixed(run) + h[i : n + i]
            chars += lens[i : n + i]
        order = (_mixed(run) >> np.uint64(1)) | ((chars < FREQUENT_BYTES).astype(np.uint64) << np.uint64(63))
        return _sliding_min(order, self.window - m + 1)

    def _pack(self, held: list[tuple[int, int, list[bytes]]]) -> tuple[list[int], list[int], list[bytes]]:
        if len(self.hashes) > REMEMBERED:
            self.hashes.clear()
        words = [w for _, _, ws in held for w in ws]
        n, k, m = len(words), self.window, self.m
        lens = np.fromiter(map(len, words), np.int64, n)
        h = np.fromiter(map(self.hashes.__getitem__, words), np.uint64, n)
        least = self._least(h, lens, m)  # of the window that starts at each word
        for large, longer in zip(self.large, (min(SECOND, k), k), strict=False):
            if len(large) and len(least):
                at = np.minimum(np.searchsorted(large, _bucket(least)), len(large) - 1)
                more = self._least(h, lens, longer)
                least = np.where(large[at] == _bucket(least), _mixed(least + _mixed(more)), least)
        counts = np.array([len(ws) for _, _, ws in held])
        ends = np.cumsum(counts)
        owner = np.repeat(np.arange(len(held)), counts)[: len(least)]
        at = np.flatnonzero(np.arange(len(least)) + k <= ends[owner])
        fresh = np.concatenate(([True], (np.diff(at) != 1) | (least[at[1:]] != least[at[:-1]])))
        first = np.flatnonzero(fresh)
        first = np.union1d(
            first,
            np.concatenate(
                [
                    np.arange(a, b, LONGEST)
                    for a, b in zip(first, np.append(first[1:], len(at)), strict=True)
                    if b - a > LONGEST
                ]
                or [first[:0]]
            ),
        ).astype(np.int64)
        last = np.append(first[1:], len(at)) - 1
        start, stop = at[first], at[last] + k  # words of each super-k-mer
        begin = np.cumsum(lens + 1) - lens - 1
        joined = b" ".join(words)
        cuts = zip(begin[start].tolist(), (begin[stop - 1] + lens[stop - 1]).tolist(), strict=True)
        own = owner[start]
        docs = np.array([d for d, _, _ in held], np.int64)[own]
        keys = np.array([x for _, x, _ in held], np.int64)[own]
        starts = (start - (ends - counts)[own]).astype(np.int32)
        buckets = _bucket(least[start])
        return self.rows(buckets, docs, keys, starts, [joined[a:b] for a, b in cuts])

    def deal(self, rows: Iterable[tuple[int, bytes]], unzip) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
        """The windows of packed rows, one by one, in buckets by all their words."""
        held: list[tuple[np.ndarray, ...]] = []
        texts: list[bytes] = []

        def packed() -> tuple[list[int], list[int], list[bytes]]:
            buckets = np.array([xxhash.xxh32_intdigest(t) for t in texts], np.uint32).view(np.int32)
            out = self.rows(buckets, *(np.concatenate(x) for x in zip(*held, strict=True)), texts)
            held.clear(), texts.clear()
            return out

        for doc, data in rows:
            docs, keys, starts, text = _unpacked(doc, data)
            text = unzip(text)
            gaps = [i for i, b in enumerate(text) if b == 32]
            begin, end, k = [0, *(g + 1 for g in gaps)], [*gaps, len(text)], self.window - 1
            for i, (a, b) in enumerate(zip(begin[: len(begin) - k], end[k:], strict=True)):
                held.append((docs, keys, starts + i))
                texts += [text[a:b]] * len(docs)
                if len(texts) > DEALT:
                    yield packed()
        if texts:
            yield packed()

    def rows(
        self, buckets: np.ndarray, docs: np.ndarray, keys: np.ndarray, starts: np.ndarray, texts: list[bytes]
    ) -> tuple[list[int], list[int], list[bytes]]:
        """Buckets, smallest documents and packed data; documents of equal texts share a row."""
        index: dict[bytes, int] = {}
        same = np.array([index.setdefault(t, i) for i, t in enumerate(texts)])
        times = np.bincount(same, minlength=len(texts))
        short = (keys == 0) & (starts < 1 << 16)
        one = np.flatnonzero((times == 1) & (same == np.arange(len(same))) & short)
        flat, compress = starts[one].astype("<u2").tobytes(), self.zip
        out = (
            buckets[one].tolist(),
            docs[one].tolist(),
            [b"\x00" + flat[2 * j : 2 * j + 2] + compress(texts[i]) for j, i in enumerate(one.tolist())],
        )
        if len(one) < len(texts):
            rest = np.flatnonzero((times[same] > 1) | ~short)
            rest = rest[np.lexsort((docs[rest], same[rest]))]
            for group in np.split(rest, np.flatnonzero(np.diff(same[rest])) + 1):
                for j in range(0, len(group), LISTED):
                    i = group[j : j + LISTED]
                    data = b"\x01" + struct.pack(
                        "<I", len(i)
                    ) + docs[i].tobytes() + keys[i].tobytes() + starts[i].tobytes() + compress(texts[i[0]])
                    for o, v in zip(out, (int(buckets[i[0]]), int(docs[i[0]]), data), strict=True):
                        o.append(v)
        return out


def _unpacked(doc: int, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
    """Documents, keys, first words and the compressed text of a packed row."""
    if data[0] == 0:
        return np.array([doc]), np.zeros(1, np.int64), np.frombuffer(data, "<u2", 1, 1).astype(np.int32), data[3:]
    n = struct.unpack_from("<I", data, 1)[0]
    return np.frombuffer(data, np.int64, n, 5), np.frombuffer(data, np.int64, n, 5 + 8 * n), np.frombuffer(
        data, np.int32, n, 5 + 16 * n
    ), data[5 + 20 * n :]


def _cost(data: bytes) -> int:
    """About the bytes that a packed row takes when its windows are compared for each of its documents."""
    if data[0] == 0:
        return zstandard.frame_content_size(data[3:21])
    n = struct.unpack_from("<I", data, 1)[0]
    return (n + 1) * zstandard.frame_content_size(data[5 + 20 * n : 23 + 20 * n])


def _unzip(dictionary: bytes):
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)).decompress


class Bucket:
    """Windows of one bucket, fed by ascending document.

    Once ``most`` windows are known, rows that hold others go to ``rest``: all rows of a window are judged here if it is
    known, and all are in ``rest`` if not.  Rows that hold both are judged twice and their stretches may be given twice.
    """

    def __init__(self, window: int, unzip, most: int | None = None):
        self.window, self.unzip, self.most = window, unzip, SEEN if most is None else most
        self.seen: dict[bytes, int] = {}
        self.rest: list[tuple[int, bytes]] = []

    def feed(self, rows: list[tuple[int, bytes]]) -> Iterator[tuple[np.ndarray, ...]]:
        """Documents, keys, first words and numbers of windows that a smaller document holds too."""
        alike: dict[bytes, list[tuple[np.ndarray, ...]]] = {}
        number: dict[bytes, int] = {}
        of = []
        for doc, data in rows:
            docs, keys, starts, text = _unpacked(doc, data)
            alike.setdefault(text, []).append((docs, keys, starts))
            of.append(number.setdefault(text, len(number)))
        windows = []
        for which, (text, found) in enumerate(alike.items()):
            text = self.unzip(text)
            raw = np.frombuffer(text, np.uint8)
            gaps = np.flatnonzero(raw == 32)
            begin, end = np.append(0, gaps + 1), np.append(gaps, len(raw))
            lowest = int(found[0][0][0])
            k = self.window - 1
            windows += [
                (text[a:b], lowest, which, i)
                for i, (a, b) in enumerate(zip(begin[: len(begin) - k].tolist(), end[k:].tolist(), strict=True))
            ]
        windows.sort()
        least: list[dict[int, int]] = [{} for _ in alike]
        last, lowest, later = None, 0, set()
        full, unknown = len(self.seen) >= self.most, np.iinfo(np.int64).max
        for text, doc, which, i in windows:
            if text != last:
                last, lowest = text, self.seen.get(text, unknown) if full else self.seen.setdefault(text, doc)
            if lowest == unknown:
                later.add(which)
            least[which][i] = lowest
        if later:
            self.rest += [row for row, which in zip(rows, of, strict=True) if which in later]
        for which, found in enumerate(alike.values()):
            docs, keys, starts = (np.concatenate(x) for x in zip(*found, strict=True))
            firsts = np.array([least[which][i] for i in range(len(least[which]))])
            cut = np.flatnonzero(np.diff(firsts)) + 1  # stretches of windows with one smallest document
            for a, b in zip(np.append(0, cut), np.append(cut, len(firsts)), strict=True):
                later = docs > firsts[a]
                if later.any():
                    yield docs[later], keys[later], starts[later] + int(a), np.full(later.sum(), b - a, np.int32)


#: Base of the rolling hash and its inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        _POWERS[:] = [
            np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, b, np.uint64))))
            for b in (_BASE, pow(_BASE, -1, 1 << 64))
        ]
    return _POWERS


def sort_windows(docs: list[int], data: list[bytes], window: int, unzip) -> list[np.ndarray]:
    """What ``Bucket.feed`` gives for whole buckets, many at a time.

    Windows are sorted by a hash of their bytes and by document; equal neighbours are compared byte by byte.
    """
    found = [_unpacked(d, x) if x[0] else None for d, x in zip(docs, data, strict=True)]
    texts = [unzip(x[3:] if f is None else f[3]) for f, x in zip(found, data, strict=True)]
    # occurrences: document, key, first word and number of the text
    one = [i for i, f in enumerate(found) if f is None]
    starts = np.frombuffer(b"".join(data[i][1:3] for i in one), "<u2").astype(np.int32)
    many = [(f, i) for i, f in enumerate(found) if f is not None]
    lowest = np.array(docs, np.int64)
    doc = np.concatenate([lowest[one], *(f[0] for f, _ in many)])
    key = np.concatenate([np.zeros(len(one), np.int64), *(f[1] for f, _ in many)])
    first = np.concatenate([starts, *(f[2] for f, _ in many)])
    text = np.concatenate([np.array(one, np.int64), *(np.full(len(f[0]), i) for f, i in many)])

    joined = b" ".join(texts) + b" "
    raw = np.frombuffer(joined, np.uint8)
    stops = np.flatnonzero(raw == 32)
    begins = np.concatenate(([0], stops[:-1] + 1))
    n_words = np.diff(np.searchsorted(stops, np.cumsum([len(t) + 1 for t in texts]), "left"), prepend=0)
    n = n_words - (window - 1)
    before = np.cumsum(n) - n
    at = np.arange(n.sum()) - np.repeat(before - (np.cumsum(n_words) - n_words), n)
    a, b = begins[at], stops[at + window - 1]
    power, inverse = _powers(len(raw))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(raw * power[: len(raw)])))
    hashes = _mixed((sums[b] - sums[a]) * inverse[a])
    mine = np.repeat(lowest, n)
    order = np.lexsort((mine, hashes))
    equal = hashes[order[1:]] == hashes[order[:-1]]
    left, right = order[:-1][equal], order[1:][equal]
    if not all(
        joined[p:q] == joined[r:s]
        for p, q, r, s in zip(a[left].tolist(), b[left].tolist(), a[right].tolist(), b[right].tolist(), strict=True)
    ):
        again = list(Bucket(window, unzip, len(hashes)).feed(list(zip(docs, data, strict=True))))  # unequal windows share a hash
        return [np.concatenate(x) for x in zip(*again, strict=True)] or [np.empty(0, np.int64)] * 4
    runs = np.flatnonzero(np.concatenate(([True], ~equal)))
    least = np.empty(len(order), np.int64)
    least[order] = np.repeat(mine[order[runs]], np.diff(np.append(runs, len(order))))

    wide = n[text]
    which = np.repeat(np.arange(len(text)), wide)
    offset = np.arange(len(which)) - np.repeat(np.cumsum(wide) - wide, wide)
    hit = np.flatnonzero(least[before[text][which] + offset] < doc[which])
    which, offset = which[hit], offset[hit]
    cut = np.flatnonzero(np.concatenate(([True], (np.diff(which) != 0) | (np.diff(offset) != 1)))) if len(hit) else hit
    o = which[cut]
    return [
        doc[o], key[o], (first[o] + offset[cut]).astype(np.int32), np.diff(np.append(cut, len(hit))).astype(np.int32)
    ]


def _rows_of(packed: Iterable[tuple[list[int], list[int], list[bytes]]]) -> Iterator[pa.RecordBatch]:
    for buckets, docs, data in packed:
        columns = [pa.array(buckets, pa.int32()), pa.array(docs, pa.int64()), pa.array(data, pa.binary())]
        yield pa.record_batch(columns, ["bucket", "doc", "data"])


def _to_windows(window: int, m: int, dictionary: bytes):
    """Rows that a bucket handed on, dealt window by window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, unzip = Packer(window, m, dictionary), _unzip(dictionary)
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns), strict=True)
            yield from _rows_of(pack.deal(rows, unzip))

    return run


def _to_buckets(window: int, m: int, dictionary: bytes, large: Sequence[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = Packer(window, m, dictionary, large)
        for batch in batches:
            parts = (batch.slice(i, 256) for i in range(0, batch.num_rows, 256))
            rows = (row for part in parts for row in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True))
            yield from _rows_of(pack(rows))

    return run


def _from_buckets(window: int, dictionary: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, unzip = ["doc", "key", "first", "n", "rest"], _unzip(dictionary)
        state, now, held, lone = Bucket(window, unzip), None, [], True
        small: tuple[list[int], list[bytes]] = ([], [])  # rows of whole buckets
        size = 0

        def judged(found: Iterable[np.ndarray]) -> pa.RecordBatch:
            columns = [pa.array(x) for x in found]
            return pa.record_batch([*columns, pa.nulls(len(columns[0]), pa.binary())], names)

        def work(rows: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
            if found := list(state.feed(rows)):
                yield judged(np.concatenate(x) for x in zip(*found, strict=True))
            if state.rest:
                docs, data = zip(*state.rest, strict=True)
                none = [np.zeros(len(docs), t) for t in (np.int64, np.int32, np.int32)]
                yield pa.record_batch(
                    [pa.array(docs, pa.int64()), *map(pa.array, none), pa.array(data, pa.binary())], names
                )
                state.rest = []

        def flush() -> pa.RecordBatch:
            return judged(sort_windows(*small, window, unzip))

        for batch in batches:
            if not batch.num_rows:
                continue
            buckets, docs, data = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
            offsets = np.frombuffer(data.buffers()[1], np.int32)[data.offset : data.offset + len(data)]
            many = np.frombuffer(data.buffers()[2], np.uint8)[offsets] > 0
            ends = np.append(np.flatnonzero(np.diff(buckets)) + 1, len(buckets))
            begins = np.append(0, ends[:-1])
            alone = (docs[begins] == docs[ends - 1]) & (np.add.reduceat(many, begins, dtype=np.int64) == 0)
            for begin, end, single in zip(begins.tolist(), ends.tolist(), alone.tolist(), strict=True):
                if buckets[begin] != now or begin:
                    if not lone:
                        cost = sum(_cost(x) for _, x in held)
                        if state.seen or len(held) > SORTED or cost > 4 * SORTED_BYTES:
                            yield from work(held)
                        else:
                            small[0].extend(d for d, _ in held)
                            small[1].extend(x for _, x in held)
                            size += cost
                            if size > SORTED_BYTES:
                                yield flush()
                                small[0].clear()
                                small[1].clear()
                                size = 0
                    state, now, held, lone = Bucket(window, unzip) if state.seen else state, buckets[begin], [], True
                    if single and end < len(buckets):  # the whole bucket is one document's
                        continue
                lone = lone and single and (not held or held[0][0] == docs[begin])
                held += zip(docs[begin:end].tolist(), data[begin:end].to_pylist(), strict=True)
                while len(held) > SORTED and not lone:
                    yield from work(held[:SORTED])
                    held = held[SORTED:]
        if not lone:
            yield from work(held)
        if small[0]:
            yield flush()

    return run


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc, key and text; the key tells rows of one id apart and is 0 where ids are unique."""
    ids = docs.select(F.col(id_col).cast("long").alias("doc")).filter("doc is not null").groupBy("doc").count()
    unique = ids.filter("count > 1").isEmpty()
    return docs.select(
        F.col(id_col).cast("long").alias("doc"),
        (F.lit(0) if unique else F.xxhash64(text_col)).cast("long").alias("key"),
        F.col(text_col).alias("text"),
        F.col(id_col).alias("id"),
    )


def _train(texts: list[str]) -> bytes:
    parts = [d[i : i + 120] for d in (t.encode("utf-8", "replace") for t in texts) for i in range(0, len(d), 120)]
    try:
        return zstandard.train_dictionary(DICTIONARY, parts).as_bytes()
    except zstandard.ZstdError:  # too few texts to train on
        return b"".join(parts)[:DICTIONARY]


def _large(
    rows: DataFrame, window: int, m: int, share: float, least: int, split: Sequence[np.ndarray] = ()
) -> np.ndarray:
    """Sorted numbers of the buckets that would have more than ``least`` rows, by a share of the documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = Packer(window, m, large=split)
        for batch in batches:
            for buckets, _, _ in pack(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)):
                own, n = np.unique(np.array(buckets, np.int32), return_counts=True)
                yield pa.record_batch([pa.array(own), pa.array(n)], ["bucket", "n"])

    counts = rows.sample(share, 7).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    found = counts.filter(
        F.col("n") > least * share
    ).orderBy(F.desc("n"), "bucket").limit(SPLIT).select("bucket").collect()
    return np.sort(np.array([r[0] for r in found], np.int32))


def _found(keyed: DataFrame, window: int, m: int, share: float = SHARE, least: int = LARGE) -> DataFrame:
    rows = keyed.select("doc", "key", "text").filter(F.col("doc").isNotNull() & F.col("text").isNotNull())
    dictionary = _train([r[0] for r in rows.select(F.substring("text", 1, SAMPLE_CHARS)).limit(SAMPLE_TEXTS).collect()])
    large = [_large(rows, window, m, share, least)]
    if len(large[0]):
        large.append(_large(rows, window, m, share, least, large))

    def judge(packed: DataFrame) -> DataFrame:
        dealt = packed.repartition("bucket").sortWithinPartitions("bucket", "doc")
        out = dealt.mapInArrow(_from_buckets(window, dictionary), "doc long, key long, first int, n int, rest binary")
        return stash(out, "repeats")

    kind = "bucket int, doc long, data binary"
    judged = [judge(rows.mapInArrow(_to_buckets(window, m, dictionary, large), kind))]
    while not (rest := judged[-1].filter("rest is not null")).isEmpty():
        judged.append(judge(rest.select("doc", "rest").mapInArrow(_to_windows(window, m, dictionary), kind)))
    found = [j.filter("rest is null").drop("rest") for j in judged]
    return reduce(DataFrame.unionByName, found)


def find_repeats(
    docs: DataFrame, *, window: int = 13, m: int = 2, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Stretches of repeated windows: doc, key (tells rows of one id apart), first (word), n (windows).

    Each listed window's words also start in a document with a smaller id.
    """
    return _found(_keyed(docs, id_col, text_col), window, m)


def remove_repeats(
    docs: DataFrame, *, window: int = 13, m: int = 2, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id_col``, kept_text (kept words joined by one space), n_words and n_removed of every row.

    A word goes if a window of ``window`` words covers it whose words also start in a document with a smaller
    id; windows are judged on the input.  A null text has no words (kept_text is empty).  A row without an id
    keeps all words and is no earlier document for others; rows with the same id do not remove each other's
    words.  Very long texts are read whole.  Other columns are dropped, whatever their names.
    """
    keyed = _keyed(docs, id_col, text_col)
    found = _found(keyed, window, m)
    by_row = found.groupBy("doc", "key").agg(F.collect_list("first").alias("first"), F.collect_list("n").alias("n"))

    @F.pandas_udf("kept_text string, n_words long, n_removed long")
    def kept(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, firsts, ns in batches:
            out = []
            for text, first, n in zip(texts, firsts, ns, strict=True):
                words = (text or "").encode("utf-8", "replace").split()
                rest = words
                if first is not None and len(first):
                    edge = np.zeros(len(words) + 1, np.int64)
                    size = len(edge)
                    edge += np.bincount(first, minlength=size) - np.bincount(first + n + (window - 1), minlength=size)
                    rest = [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]
                out.append((b" ".join(rest).decode(), len(words), len(words) - len(rest)))
            yield pd.DataFrame(out, columns=["kept_text", "n_words", "n_removed"])

    done = keyed.join(by_row, ["doc", "key"], "left").select("id", kept("text", "first", "n").alias("_k"))
    return done.select(F.col("id").alias(id_col), "_k.*")


def brute_force(docs: list[tuple[int, str | None]], window: int = 13) -> dict[int, tuple[int, int, str]]:
    """n_words, n_removed and kept words by id, by plain loops, for tests (ids differ)."""
    words = {d: (t or "").encode().split() for d, t in docs}
    least: dict[tuple, int] = {}
    for d in sorted(words):
        for i in range(len(words[d]) - window + 1):
            least.setdefault(tuple(words[d][i : i + window]), d)
    out = {}
    for d, w in words.items():
        gone = {
            j for i in range(len(w) - window + 1) if least[tuple(w[i : i + window])] < d for j in range(i, i + window)
        }
        out[d] = (len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode())
    return out
