"""Counts of a corpus's words and pairs of words, brought back to the blocks of texts that ask for them.

A task numbers the words of a block of texts and stores the texts as numbers, once, by block.  The block asks for the counts of
its distinct words in compressed lists, one for each bucket of words; a bucket counts its words over all blocks, by the words
themselves, and answers where another block has the word too (elsewhere the block's own counts are the whole ones), with a
number that the word has in all blocks.  Pairs of such words are then asked for by these numbers, and answered likewise; no
other pair can be in two blocks.  Lists are in an order that the block finds again, so that answers need no keys or places.
Texts, as numbers, then meet the answers.  Shuffled are the compressed lists, a few bytes for each distinct key; the stored blocks
stay where they are.  With ``keep``, pairs are asked for as text, and buckets store the counts of all (``moments``).
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanspark.sources.scratch import stash

#: Bytes of text in a block, and bytes of text whose keys share a bucket on average; one task holds either.
BLOCK_BYTES, BUCKET_BYTES = 4_000_000, 10_000_000
#: Beyond so many blocks these grow with the root of the input, so many times at most.
MANY_BLOCKS, LARGER = 50, 4


def grown(block_bytes: int, size: int) -> int:
    """Bytes of a block for an input of ``size`` bytes: larger blocks ask for fewer words and pairs in all."""
    return round(block_bytes * min(max(1.0, (size / (MANY_BLOCKS * block_bytes)) ** 0.5), LARGER))


def pack(*parts: bytes | np.ndarray) -> bytes:
    """Bytes, floats and whole numbers (by places of value, as the high ones are mostly 0), compressed."""
    raw = [p if isinstance(p, bytes) else p.tobytes() if p.dtype == np.float64 else _planes(p) for p in parts]
    head = np.array([len(raw), *map(len, raw)], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join(raw))


def unpack(data: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int.from_bytes(raw[:8], "little")
    ends = np.cumsum([8 * (n + 1), *np.frombuffer(raw, np.int64, n, 8)])
    return [raw[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _planes(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a, "<i8").view(np.uint8).reshape(-1, 8).T.tobytes()


def numbers(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view("<i8").ravel()


def places_of(at: np.ndarray) -> np.ndarray:
    return np.diff(at, prepend=0)


def bucket_of(h: np.ndarray, n: int) -> np.ndarray:
    """A bucket below ``n`` for each hash."""
    return (((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(n)).astype(np.int64)


class Block:
    """Texts as word numbers: ``flat`` in a row, ``ends`` of texts in it; distinct pairs of neighbours as ``codes``.

    ``place`` is the pair of each token but a text's first, ``c``, ``cp`` and ``cc`` are the block's own counts of words,
    of words that another follows, and of pairs.  ``v`` words are numbered.
    """

    def __init__(self, sizes: np.ndarray, flat: np.ndarray, v: int, pairs: bool = True):
        self.ends, self.flat, self.v = np.concatenate(([0], np.cumsum(sizes))), flat, v
        self.c = np.bincount(self.flat, minlength=self.v)
        first = np.zeros(len(self.flat) + 1, bool)
        first[self.ends] = True
        self.later = np.flatnonzero(~first[:-1])
        if pairs:
            codes = self.flat[self.later - 1] * self.v + self.flat[self.later]
            self.codes, self.place, self.cc = np.unique(codes, return_inverse=True, return_counts=True)
            self.cp = np.bincount(self.flat[self.later - 1], minlength=self.v)

    def lists(self, values: np.ndarray) -> pa.Array:
        """Values of all tokens but the first as one array for each text."""
        ends = self.ends - np.minimum(np.arange(len(self.ends)), np.cumsum([0, *(np.diff(self.ends) > 0)]))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.float64()))

    def means(self, values: np.ndarray) -> pa.Array:
        """The mean over each text's tokens but the first of values by word; null without one."""
        cuts = zip(self.ends[:-1].tolist(), self.ends[1:].tolist(), strict=True)
        each = (values[self.flat[a + 1 : b]] for a, b in cuts)
        return pa.array([float(x.mean()) if len(x) else None for x in each], pa.float64())


def lines(words: list[bytes]) -> pa.Array:
    """Words with a line end each."""
    return pa.array([w + b"\n" for w in words], pa.large_binary())


def joined(before: pa.Array, prev: np.ndarray, after: pa.Array, tok: np.ndarray) -> pa.Array:
    """Pairs of words by their places in two lists, the second with line ends."""
    parts = before.take(pa.array(prev)), after.take(pa.array(tok))
    return pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.large_binary()))


def flat_keys(keys: pa.Array) -> tuple[memoryview, np.ndarray]:
    """The keys in a row, and where each begins and the last ends."""
    if not len(keys):
        return memoryview(b""), np.zeros(1, np.int64)
    _, ends, raw = keys.buffers()
    return memoryview(raw), np.frombuffer(ends, np.int64)[keys.offset : keys.offset + len(keys) + 1]


def asked_lists(buckets: np.ndarray, keys: pa.Array, *values: np.ndarray | pa.Array) -> Iterator[tuple[int, bytes]]:
    """A bucket and its list (keys, their places, values) for each bucket that the block needs."""
    order = np.argsort(buckets, kind="stable")
    cuts = np.flatnonzero(np.diff(buckets[order], prepend=-1, append=-1)) if len(order) else []
    texts = {k: flat_keys(x.take(pa.array(order))) for k, x in enumerate((keys, *values)) if isinstance(x, pa.Array)}
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        at = order[a:b]
        of = lambda k, x: bytes(texts[k][0][texts[k][1][a] : texts[k][1][b]]) if k in texts else x[at]  # noqa: B023, E731
        yield int(buckets[at[0]]), pack(of(0, keys), places_of(at), *(of(k, x) for k, x in enumerate(values, 1)))


def requests_of(words: list[bytes], block: Block, n_words: int, n_pairs: int) -> Iterator[tuple[int, bytes]]:
    h, ended = np.fromiter(map(zlib.crc32, words), np.uint64, len(words)), lines(words)
    if not n_pairs:
        yield from asked_lists(bucket_of(h, n_words), ended, block.c)
        return
    yield from asked_lists(bucket_of(h, n_words), ended, block.c, block.cp)
    prev, tok = np.divmod(block.codes, max(block.v, 1))
    both = joined(pa.array(words, pa.large_binary()), prev, ended, tok)
    yield from asked_lists(n_words + bucket_of((h[prev] << np.uint64(32)) | h[tok], n_pairs), both, block.cc)


def _numbering() -> dict[bytes, int]:
    """Gives each new word the next number."""
    at = defaultdict()
    at.default_factory = at.__len__
    return at


def _cut(block_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A row for each block: its number, the ids of its texts, its words, and its texts as numbers of words.

    Of several texts a row the first is counted; words of the others are numbered and asked for along with its own.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, at, size, ids, held = TaskContext.get().partitionId() << 32, _numbering(), 0, [], None

        def row() -> pa.RecordBatch:
            each = [p for texts in held for p in (np.array(list(map(len, texts))), np.concatenate(texts))]
            listed = pa.concat_arrays(ids)
            columns = [
                pa.array([block]),
                pa.ListArray.from_arrays(pa.array([0, len(listed)], pa.int32()), listed),
                pa.array([pack(b"\n".join(at), np.array([len(at)]))], pa.binary()),
                pa.array([pack(*each)], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(columns, ["block", "ids", "words", "data"])

        for batch in batches:
            start, columns = 0, [c.to_pylist() for c in batch.columns[1:]]
            held = held or [[] for _ in columns]
            for k, texts in enumerate(zip(*columns, strict=True)):
                for kept, text in zip(held, texts, strict=True):
                    words = text.split()
                    kept.append(np.fromiter(map(at.__getitem__, words), np.int64, len(words)))
                size += len(texts[0])
                if size >= block_bytes:
                    ids.append(batch.column(0).slice(start, k + 1 - start))
                    yield row()
                    block, at, size, ids, held, start = block + 1, _numbering(), 0, [], [[] for _ in columns], k + 1
            if start < batch.num_rows:
                ids.append(batch.column(0).slice(start))
        if ids:
            yield row()

    return cut


def _read(words: bytes, data: bytes, pairs: bool) -> list[Block]:
    """The block's texts, and the others of its rows."""
    v = int(numbers(unpack(words)[1])[0])
    each = list(map(numbers, unpack(data)))
    return [Block(s, f, v, pairs and not k) for k, (s, f) in enumerate(zip(each[::2], each[1::2], strict=True))]


def _ask(n_words: int, n_pairs: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """block, bucket and list of keys for each block and bucket."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, words, data in zip(*(batch.column(k) for k in range(3)), strict=True):
                block = _read(words.as_py(), data.as_py(), bool(n_pairs))[0]
                every = list(requests_of(unpack(words.as_py())[0].split(b"\n"), block, n_words, n_pairs) if block.v else ())
                columns = [
                    pa.array(np.full(len(every), number.as_py())),
                    pa.array([b for b, _ in every], pa.int32()),
                    pa.array([d for _, d in every], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["block", "bucket", "data"])

    return ask


def keys_of(lists: list[bytes]) -> pa.Array:
    """Lists of keys, each with its line end, as one array."""
    flat = np.frombuffer(b"".join(lists), np.uint8)
    ends = np.concatenate(([0], np.flatnonzero(flat == 10) + 1)).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(flat)])


def _answers(bucket: int, blocks: list, lists: list, n: int, v: int) -> pa.Table:
    """Answers of a bucket; the first is of no block and has n and v."""
    none = [None] * (len(blocks) - 1)
    columns = [
        pa.array(blocks, pa.int64()),
        pa.array([bucket] * len(blocks), pa.int32()),
        pa.array(lists, pa.binary()),
        pa.array([n, *none], pa.int64()),
        pa.array([v, *none], pa.int64()),
    ]
    return pa.Table.from_arrays(columns, ["block", "bucket", "data", "n", "v"])


def _answer(asked: pa.Table) -> pa.Table:
    """block, bucket and list (places and whole counts) where another block has a key too; of a shared pair one block is told
    that it is its owner.  A row of no block has n, v, and the bucket's keys and counts."""
    lists = [unpack(d) for d in asked["data"].to_pylist()]
    found = keys_of([x[0] for x in lists]).dictionary_encode()
    codes, distinct = found.indices.to_numpy(), len(found.dictionary)
    counts = [np.concatenate([numbers(x[k]) for x in lists]) for k in range(2, len(lists[0]))]
    whole = [np.bincount(codes, c, distinct).astype(np.int64) for c in counts]
    shared = np.bincount(codes, minlength=distinct) > 1
    first = np.zeros(distinct, np.int64)
    first[codes[::-1]] = np.arange(len(codes))[::-1]
    blocks, answers, start = [None], [pack(bytes(flat_keys(found.dictionary)[0]), *whole)], 0
    for block, x in zip(asked["block"].to_pylist(), lists, strict=True):
        at = np.cumsum(numbers(x[1]))
        mine = codes[start : start + len(at)]
        some = shared[mine]
        if some.any():
            own = [(first[mine] == np.arange(start, start + len(at)))[some]] if len(whole) == 1 else []
            blocks.append(block)
            answers.append(pack(places_of(at[some]), *(w[mine[some]] for w in whole), *own))
        start += len(at)
    return _answers(asked["bucket"][0].as_py(), blocks, answers, int(counts[0].sum()), int((whole[0] > 0).sum()))


def filled(blocks: pa.Table, answers: pa.Table, n_words: int, n_pairs: int) -> list[Block]:
    """The block with whole counts, and the other texts of its rows; ``own`` are the pairs that it owns."""
    block, *others = _read(blocks["words"][0].as_py(), blocks["data"][0].as_py(), n_pairs > 0)
    if n_pairs:
        block.own = np.ones(len(block.codes), bool)
    for bucket, data in zip(answers["bucket"].to_pylist(), answers["data"].to_pylist(), strict=True):
        if bucket >= n_words + n_pairs:
            continue
        places, *counts = map(numbers, unpack(data))
        places = np.cumsum(places)
        if bucket >= n_words:
            block.cc[places] = counts[0]
            if len(counts) > 1:
                block.own[places] = counts[1] > 0
        else:
            block.c[places] = counts[0]
            if n_pairs:
                block.cp[places] = counts[1]
    return [block, *others]


# --- words by text, pairs by the numbers of words ---------------------------------------------------------------------


class Order:
    """Places of keys by bucket and then by ``key`` (distinct, not negative), and where each bucket's are (``of``)."""

    def __init__(self, buckets: np.ndarray, key: np.ndarray):
        self.at = np.argsort(buckets * (key.max(initial=0) + 1) + key)
        self.sorted = buckets[self.at]

    def of(self, bucket: int) -> np.ndarray:
        return self.at[slice(*np.searchsorted(self.sorted, (bucket, bucket + 1)))]

    def __iter__(self) -> Iterator[tuple[int, np.ndarray]]:
        cuts = np.flatnonzero(np.diff(self.sorted, prepend=-1, append=-1)) if len(self.at) else []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield int(self.sorted[a]), self.at[a:b]


def _word_order(words: list[bytes], n_words: int) -> Order:
    rank = np.empty(len(words), np.int64)
    rank[pc.sort_indices(pa.array(words, pa.large_binary())).to_numpy()] = np.arange(len(words))
    return Order(bucket_of(np.fromiter(map(zlib.crc32, words), np.uint64, len(words)), n_words), rank)


class _Pairs:
    """A block's pairs of words that other blocks have too, by these words' numbers (-1: no other has the word).

    In a bucket, the first word and the second's number over the count of buckets (``prev``, ``rest``) tell pairs apart.
    """

    def __init__(self, block: Block, number: np.ndarray, n_pairs: int):
        prev, tok = (number[x] for x in np.divmod(block.codes, max(block.v, 1)))
        self.pair = np.flatnonzero((prev >= 0) & (tok >= 0))
        self.prev, tok = prev[self.pair], tok[self.pair]
        self.rest = tok // n_pairs
        self.order = Order((self.prev + tok) % n_pairs, self.prev * (self.rest.max(initial=0) + 1) + self.rest)


def _lists(number: int, every: list[tuple[int, bytes]]) -> list[pa.Array]:
    """block, bucket and data of a block's lists."""
    return [
        pa.array(np.full(len(every), number, np.int64)),
        pa.array([b for b, _ in every], pa.int32()),
        pa.array([d for _, d in every], pa.binary()),
    ]


def _ask_words(n_words: int, pairs: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """block, bucket and list (words in order, their counts, with ``pairs`` also as the first of a pair)."""

    def lists(words: list[bytes], block: Block) -> Iterator[tuple[int, bytes]]:
        counts = [block.c, np.bincount(block.flat[block.later - 1], minlength=block.v)] if pairs else [block.c]
        for bucket, at in _word_order(words, n_words):
            yield bucket, pack(b"".join([words[k] + b"\n" for k in at.tolist()]), *(c[at] for c in counts))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, words, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                block = _read(words, data, False)[0]
                every = list(lists(unpack(words)[0].split(b"\n"), block)) if block.v else []
                yield pa.RecordBatch.from_arrays(_lists(number, every), ["block", "bucket", "data"])

    return ask


def _by_number(number: np.ndarray) -> np.ndarray:
    """Places of the numbers over 0, the largest first."""
    return np.argsort(-number, kind="stable")[: np.count_nonzero(number)]


def _answer_words(asked: pa.Table) -> pa.Table:
    """block, bucket and list where another block has a word too: numbers in the order asked (from 1 by falling count; 0 if no
    other block has the word); by falling number, thus rising, the whole counts, and how often the word is the last of a text.
    A row of no block has n and v."""
    lists = [unpack(d) for d in asked["data"].to_pylist()]
    found = keys_of([x[0] for x in lists]).dictionary_encode()
    codes, distinct = found.indices.to_numpy(), len(found.dictionary)
    own = [[numbers(p) for p in x[1:]] for x in lists]
    whole = [np.bincount(codes, np.concatenate(c), distinct).astype(np.int64) for c in zip(*own, strict=True)]
    shared = np.flatnonzero(np.bincount(codes, minlength=distinct) > 1)
    number = np.zeros(distinct, np.int64)
    number[shared[np.argsort(-whole[0][shared], kind="stable")]] = np.arange(1, len(shared) + 1)
    blocks, answers, start = [None], [None], 0
    for block, counts in zip(asked["block"].to_pylist(), own, strict=True):
        mine = codes[start : start + len(counts[0])]
        start += len(mine)
        if number[mine].any():
            some = mine[_by_number(number[mine])]
            blocks.append(block)
            answers.append(pack(number[mine], places_of(whole[0][some]), *(whole[0][some] - w[some] for w in whole[1:])))
    return _answers(asked["bucket"][0].as_py(), blocks, answers, int(whole[0].sum()), int((whole[0] > 0).sum()))


def _answer_pairs(asked: pa.Table) -> pa.Table:
    """block, bucket and list where another block has a pair too: counts in other blocks, in the order asked."""
    codes, own = [], []
    for data in asked["data"].to_pylist():
        prev, rest, cc = map(numbers, unpack(data))
        codes.append(np.cumsum(prev) << 32 | rest)
        own.append(cc)
    ends = np.cumsum([0, *map(len, own)])
    distinct, codes = np.unique(np.concatenate(codes), return_inverse=True)
    whole = np.bincount(codes, np.concatenate(own), len(distinct)).astype(np.int64)
    blocks, answers = [], []
    for block, a, b, cc in zip(asked["block"].to_pylist(), ends[:-1], ends[1:], own, strict=True):
        more = whole[codes[a:b]] - cc
        if more.any():
            blocks.append(block)
            answers.append((asked["bucket"][0].as_py(), pack(more)))
    columns = _lists(0, answers)
    return pa.Table.from_arrays([pa.array(blocks, pa.int64()), *columns[1:]], ["block", "bucket", "data"])


def _with_words(blocks: pa.Table, answers: pa.Table, n_words: int, pairs: bool) -> tuple[list[Block], np.ndarray]:
    """The block with whole counts of words, and the other texts of its rows; the words' numbers, -1 where no other block
    has the word."""
    words, data = blocks["words"][0].as_py(), blocks["data"][0].as_py()
    block, *others = _read(words, data, pairs)
    number = np.full(block.v, -1)
    if block.v and answers.num_rows:
        order = _word_order(unpack(words)[0].split(b"\n"), n_words)
        for bucket, data in zip(answers["bucket"].to_pylist(), answers["data"].to_pylist(), strict=True):
            if bucket < n_words:
                at = order.of(bucket)
                k, rises, *last = map(numbers, unpack(data))
                number[at] = np.where(k > 0, (k - 1) * n_words + bucket, -1)
                some = at[_by_number(k)]
                block.c[some] = np.cumsum(rises)
                if pairs:
                    block.cp[some] = block.c[some] - last[0]
    return [block, *others], number


def _ask_pairs(n_words: int, n_pairs: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """block, bucket and list (pairs in order, their counts) of a block that knows its words' numbers."""

    def ask(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        (block, *_), number = _with_words(blocks, answers, n_words, True)
        asked = _Pairs(block, number, n_pairs)
        every = [
            (n_words + bucket, pack(places_of(asked.prev[at]), asked.rest[at], block.cc[asked.pair[at]]))
            for bucket, at in asked.order
        ]
        return pa.Table.from_arrays(_lists(blocks["block"][0].as_py(), every), ["block", "bucket", "data"])

    return ask


def _whole(blocks: pa.Table, answers: pa.Table, n_words: int, n_pairs: int) -> list[Block]:
    """The block with whole counts, and the other texts of its rows."""
    (block, *others), number = _with_words(blocks, answers, n_words, n_pairs > 0)
    if n_pairs and answers.num_rows:
        asked = _Pairs(block, number, n_pairs)
        for bucket, data in zip(answers["bucket"].to_pylist(), answers["data"].to_pylist(), strict=True):
            if bucket >= n_words:
                block.cc[asked.pair[asked.order.of(bucket - n_words)]] += numbers(unpack(data)[0])
    return [block, *others]


class Tallied:
    """Stored blocks of texts, a row each, and the answers to them; ``n`` words in all, ``v`` distinct ones."""

    def __init__(self, docs: DataFrame, id_col: str, texts: Sequence, pairs: bool, block_bytes: int, bucket_bytes: int, keep: bool):
        size = docs.agg(F.sum(F.octet_length(texts[0]))).first()[0] or 0
        self.n_words = max(1, -(-size // (4 * bucket_bytes if pairs else bucket_bytes)))
        self.pairs = max(1, -(-size // (bucket_bytes if keep else 2 * bucket_bytes))) if pairs else 0
        rows = docs.select(F.col(id_col).alias("id"), *(t.alias(f"t{k}") for k, t in enumerate(texts)))
        if size < 128_000_000:  # small inputs may be one file
            rows = rows.repartition(max(1, min(-(-size // 1_000_000), 8)))
        self.of = rows.schema["id"].dataType.simpleString()
        cut = rows.mapInArrow(_cut(block_bytes if keep else grown(block_bytes, size)), f"block long, ids array<{self.of}>, words binary, data binary")
        self.blocks = stash(cut, "blocks", by="block" if size > 8 * block_bytes else None)
        stored, listed = self.blocks.select("block", "words", "data"), "block long, bucket int, data binary"
        ask = _ask(self.n_words, self.pairs) if keep else _ask_words(self.n_words, pairs)
        self.asked = stored.mapInArrow(ask, listed)
        answer = _answer if keep else _answer_words
        answers = stash(self.asked.groupBy("bucket").applyInArrow(answer, f"{listed}, n long, v long"), "answers")
        n, v = answers.filter(f"bucket < {self.n_words}").agg(F.sum("n"), F.sum("v")).first()
        self.n, self.v = int(n or 0), int(v or 0)
        self.answers = answers.filter("block is not null").select("block", "bucket", "data")
        self.kept = answers.filter("block is null").select("bucket", "data") if keep else None
        if pairs and not keep:
            both = stored.groupBy("block").cogroup(self.answers.groupBy("block"))
            of_pairs = both.applyInArrow(_ask_pairs(self.n_words, self.pairs), listed)
            self.asked = self.asked.union(of_pairs)
            found = of_pairs.groupBy("bucket").applyInArrow(_answer_pairs, listed)
            self.answers = self.answers.union(stash(found, "pair-answers"))

    def look_up(self, scored: Callable[..., list[pa.Array]], columns: str) -> DataFrame:
        """id and the named columns, made of a block with the whole counts and of the other texts of its rows."""
        n_words, n_pairs, names = self.n_words, self.pairs, [c.split()[0] for c in columns.split(", ")]
        fill = _whole if self.kept is None else filled

        def found(blocks: pa.Table, answers: pa.Table) -> pa.Table:
            block, *others = fill(blocks, answers, n_words, n_pairs)
            ids = blocks["ids"].combine_chunks().flatten()
            return pa.Table.from_arrays([ids, *scored(block, *others)], ["id", *names])

        return self.blocks.groupBy("block").cogroup(self.answers.groupBy("block")).applyInArrow(found, f"id {self.of}, {columns}")

    def losses(self, weight: float) -> DataFrame:
        """id, uni (add-one unigram) and bi (bigram interpolated with it): losses of all tokens but the first."""
        every = float(self.n + self.v)

        def scored(block: Block) -> list[pa.Array]:
            share = (block.c + 1) / every
            prev, tok = np.divmod(block.codes, max(block.v, 1))
            bi = -np.log(weight * block.cc / block.cp[prev] + (1 - weight) * share[tok])
            return [block.lists((-np.log(share))[block.flat[block.later]]), block.lists(bi[block.place])]

        return self.look_up(scored, "uni array<double>, bi array<double>")


def tallied(
    docs: DataFrame,
    id_col: str,
    *texts,
    pairs: bool = True,
    block_bytes: int = BLOCK_BYTES,
    bucket_bytes: int = BUCKET_BYTES,
    keep: bool = False,
) -> Tallied:
    """``texts`` are columns of bytes without nulls; ``keep`` stores the whole counts by bucket too (``kept``), and blocks stay at
    ``block_bytes`` (``grown``)."""
    return Tallied(docs, id_col, texts, pairs, block_bytes, bucket_bytes, keep)
