"""Near-duplicates by BagMinHash over multisets of word shingles, banding and exact verification.

Signature: each shingle with weight w (its number of occurrences) owns independent Poisson processes over the
dyadic weight intervals [0, 1), [1, 2), [2, 4), ...; a text takes the points whose weight coordinate is below
w, and each register keeps the first arrival among all of them.  Two texts agree in a register with the
probability of their weighted Jaccard similarity.  Processes are followed only as far as the registers need.  The
published hierarchy splits one process's intervals down to the weight; a process of its own for each dyadic interval
gives the same points in law, as processes over disjoint intervals are independent.

Classes are the components of the graph of texts whose shingle multisets overlap by ``similarity`` or more.
Equal texts count once from the banding on (each task signs equal texts of one read only once).  In each bucket of a band the members are compared with three leaders; then, in
buckets that still hold several classes, all members outside the bucket's main class are compared with all
members, in blocks.  Every pair that shares a bucket is thus compared or known to be in one class.

Each edit of a word changes up to five shingles: of 200 words, 4 edits far apart leave a similarity of 0.81 and 5 one of
0.77.  So copies with up to 2 % of the words edited are found, and those with more only where edits lie close together.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanspark.llm.common import BROADCAST_IDS, free, near_ids, stash
from gleanspark.llm.graph import components
from gleanspark.llm.repeats import REMEMBERED, WordHash, _mixed

#: Registers are BANDS * ROWS; at a similarity of 0.8 a pair misses all bands with a probability of 3e-6.
BANDS, ROWS = 24, 4
#: Bytes of text that a worker hashes at a time; shingles and members in a block of the last comparison, about.
CHUNK, BLOCK, BLOCK_ROWS = 1_000_000, 250_000, 500
LEADERS = 3


class Shingler:
    """Occurrences of word shingles as 64-bit hashes, many texts at a time."""

    def __init__(self, width: int):
        self.width, self.hashes = width, WordHash()

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Text number and shingle hash of each occurrence; a text of fewer words than the width is one shingle."""
        if len(self.hashes) > REMEMBERED:
            self.hashes.clear()
        words = [t.encode("utf-8", "replace").split() for t in texts]
        counts = np.array([len(w) for w in words], np.int64)
        flat = [w for ws in words for w in ws]
        flat += [b""] * (self.width - 1)
        h = np.fromiter(map(self.hashes.__getitem__, flat), np.uint64, len(flat))
        n = len(flat) - self.width + 1
        run = h[:n].copy()
        for i in range(1, self.width):
            run = _mixed(run) + h[i : n + i]
        run = _mixed(run)
        begin = np.cumsum(counts) - counts
        owner = np.repeat(np.arange(len(texts)), counts)
        keep = np.arange(len(owner)) + self.width <= (begin + counts)[owner]
        short = np.flatnonzero((counts > 0) & (counts < self.width))
        alone = [self.hashes[b"\0" + b" ".join(words[i])] for i in short.tolist()]
        return np.concatenate([owner[keep], short]), np.concatenate(
            [run[: len(owner)][keep], np.array(alone, np.uint64)]
        )


def weighted(owner: np.ndarray, shingle: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Owner, shingle and number of each distinct pair, and the number of each sorted occurrence within its run."""
    order = np.lexsort((shingle, owner))
    owner, shingle = owner[order], shingle[order]
    first = np.flatnonzero(
        np.concatenate(([True], (owner[1:] != owner[:-1]) | (shingle[1:] != shingle[:-1])))
    ) if len(owner) else np.empty(0, np.int64)
    times = np.diff(np.append(first, len(owner)))
    return owner[first], shingle[first], times, np.arange(len(owner)) - np.repeat(first, times)


def signatures(owner: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n: int, registers: int) -> np.ndarray:
    """Registers (first arrivals) of ``n`` texts; infinite for a text without shingles."""
    sig = np.full((n, registers), np.inf)
    total = np.bincount(owner, weights=weight, minlength=n)
    has = total > 0
    slack = 6.0
    todo = has.copy()
    while todo.any():
        until = np.zeros(n)
        until[todo] = (np.log(registers) + slack) / total[todo]
        level = 0
        pick = np.flatnonzero(todo[owner])
        while len(pick):
            low, wide = (0.0, 1.0) if level == 0 else (2.0 ** (level - 1), 2.0 ** (level - 1))
            pick = pick[weight[pick] > low]
            own, seed, w = owner[pick], _mixed(
                shingle[pick] + np.uint64(level * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
            ), weight[pick]
            x = np.zeros(len(pick))
            while len(own):
                seed = _mixed(seed + np.uint64(0xD1342543DE82EF95))
                x -= np.log(((seed >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / (registers * wide)
                on = x <= until[own]
                own, seed, x, w = own[on], seed[on], x[on], w[on]
                more = _mixed(seed ^ np.uint64(0xA0761D6478BD642F))
                put = slice(None) if level == 0 else low + (
                    _mixed(more) >> np.uint64(11)
                ).astype(np.float64) * 2.0**-53 * wide < w
                np.minimum.at(
                    sig.reshape(-1),
                    own[put] * registers
                    + ((more[put] >> np.uint64(32)) * np.uint64(registers) >> np.uint64(32)).astype(np.int64),
                    x[put],
                )
            level += 1
        todo = has & np.isinf(sig).any(axis=1)  # a register without an arrival so far: follow the processes further
        slack *= 3
    return sig


def bands_of(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    bits = sig.view(np.uint64).reshape(len(sig), bands, rows)
    out = np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.zeros((len(sig), 1), np.uint64)
    for r in range(rows):
        out = _mixed(out) + bits[:, :, r]
    return _mixed(out).view(np.int64)


def _chunks(rows: Iterable[tuple]) -> Iterator[list[tuple]]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1])
        if size > CHUNK:
            yield held
            held, size = [], 0
    if held:
        yield held


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            yield from zip(*(c.to_pylist() for c in batch.slice(i, 256).columns), strict=True)


def _sign(width: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(width)
        for held in _chunks(_rows(batches)):
            first = {key: text for _, key, text in held}
            number = {key: n for n, key in enumerate(first)}
            own, hashes, times, _ = weighted(*shingle(list(first.values())))
            sig = signatures(own, hashes, times.astype(np.float64), len(first), bands * rows)
            some = np.isfinite(sig[:, 0])
            found = iter(bands_of(sig[some], bands, rows).tolist())
            of = [next(found) if s else None for s in some.tolist()]
            columns = [
                pa.array([r[0] for r in held], pa.int64()),
                pa.array([r[1] for r in held], pa.binary()),
                pa.array([of[number[r[1]]] for r in held], pa.list_(pa.int64())),
            ]
            yield pa.record_batch(columns, ["id", "key", "bands"])

    return run


def _bag(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(width)
        for held in _chunks(_rows(batches)):
            own, hashes, times, nth = weighted(*shingle([t for *_, t in held]))
            bag = _mixed(np.repeat(hashes, times) + _mixed(nth.astype(np.uint64))).view(np.int64)
            ends = np.cumsum(np.bincount(own, weights=times, minlength=len(held))).astype(np.int32)
            yield pa.record_batch(
                [
                    pa.array([r[0] for r in held], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(np.concatenate((np.zeros(1, np.int32), ends))), pa.array(bag)),
                ],
                ["id", "bag"],
            )

    return run


def _compare(similarity: float):
    """Links between the queries and the targets of one block, one for each query and class."""

    def run(block: pd.DataFrame) -> pd.DataFrame:
        targets, queries = block[block["target"]], block[block["query"]]
        out = []
        if len(targets) and len(queries):
            sizes = targets["bag"].map(len).to_numpy()
            flat = np.concatenate(targets["bag"].tolist())
            owner = np.repeat(np.arange(len(targets)), sizes)
            order = np.argsort(flat, kind="stable")
            flat, owner = flat[order], owner[order]
            ids, classes = targets["id"].to_numpy(), targets["class"].to_numpy()
            for a, c, bag in zip(queries["id"], queries["class"], queries["bag"], strict=True):
                bag = np.asarray(bag)
                low, high = np.searchsorted(flat, bag, "left"), np.searchsorted(flat, bag, "right")
                at = np.repeat(low - np.cumsum(high - low) + (high - low), high - low) + np.arange((high - low).sum())
                both = np.bincount(owner[at], minlength=len(sizes))
                hit = np.flatnonzero((both >= similarity * (len(bag) + sizes - both)) & (classes != c))
                _, one = np.unique(classes[hit], return_index=True)
                out += [(a, int(ids[i])) for i in hit[one]]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def _with_bags(docs: DataFrame, ids: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    return rows.join(ids, "id", "left_semi").mapInArrow(_bag(width), "id long, bag array<long>")


def near_duplicates(
    docs: DataFrame,
    *,
    similarity: float = 0.8,
    width: int = 5,
    bands: int = BANDS,
    rows: int = ROWS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``id_col`` and class_id (the smallest id of its class) of every row.

    A class is a component of the texts linked by a weighted Jaccard similarity of ``similarity`` or more of
    their multisets of ``width``-word shingles; a text of fewer words is one shingle; very long texts are taken whole.
    Texts without words (null, empty, blank) are alike only where they are equal, null counting as empty.  A row
    without an id has class null.  Rows of one id are one document: its texts are in one class, and so are their
    copies.  Other columns are dropped, whatever their names; repeated rows stay.
    """
    text = F.coalesce(text_col, F.lit(""))
    key = F.unhex(F.md5(text.cast("binary"))).alias("key")
    rows_in = docs.select(F.col(id_col).cast("long").alias("id"), key, text.alias("text"))
    signed = stash(
        rows_in.mapInArrow(_sign(width, bands, rows), "id long, key binary, bands array<long>"), "signatures"
    )
    known = signed.filter("id is not null")
    equal = stash(known.groupBy("key").agg(F.min("id").alias("rep")), "equal-texts")
    firsts = known.join(equal, (known["key"] == equal["key"]) & (known["id"] == equal["rep"]), "left_semi")
    banded = firsts.select("id", F.explode("bands").alias("bucket"))
    leaders = [
        F.min(F.struct(F.xxhash64(F.lit(t), "id").alias("h"), "id"))["id"].alias(f"l{t}") for t in range(LEADERS)
    ]
    shared = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), *leaders).filter("n > 1")
    members = stash(banded.join(shared, "bucket"), "members")
    led = F.explode(F.array_distinct(F.array(*(f"l{t}" for t in range(LEADERS))))).alias("to")
    pairs = members.select("id", led).filter("id <> to")
    pairs = stash(pairs.select(F.least("id", "to").alias("a"), F.greatest("id", "to").alias("b")).distinct(), "pairs")
    several = near_ids(stash(members.select("id").distinct(), "several"))
    bags = stash(_with_bags(docs, several, width, id_col, text_col), "bags")
    left, right = bags.select(F.col("id").alias("a"), F.col("bag").alias("x")), bags.select(
        F.col("id").alias("b"), F.col("bag").alias("y")
    )
    both = F.size(F.array_intersect("x", "y"))
    tried = pairs.join(left, "a").join(right, "b").select(
        "a", "b", both.alias("both"), (F.size("x") + F.size("y")).alias("all")
    )
    near = tried.filter(F.col("both") >= F.lit(similarity) * (F.col("all") - F.col("both"))).select("a", "b")
    links = stash(near.union(_of_one_id(known, equal)), "near-links")
    free(pairs)

    classes = components(links)
    more = _between_classes(members, bags, classes, similarity)
    if more is not None and not more.isEmpty():
        classes = components(links.union(more))
    free(members, bags)
    reps = equal.join(classes, F.col("rep") == F.col("node"), "left").select(
        "key", F.coalesce("root", "rep").alias("class_id")
    )
    merged = signed.join(reps, "key", "left").select(
        "id", F.when(F.col("id").isNotNull(), F.col("class_id")).alias("class_id")
    )
    return merged.select(F.col("id").alias(id_col), "class_id")


def _of_one_id(known: DataFrame, equal: DataFrame) -> DataFrame:
    """Links between the texts of each id that has several (most tables have none: ids and two keys are shuffled)."""
    ids = known.groupBy("id").agg((F.min("key") != F.max("key")).alias("many")).filter("many").select("id")
    texts = known.join(near_ids(stash(ids, "shared-ids")), "id", "left_semi").join(equal, "key").select("id", "rep")
    least = texts.groupBy("id").agg(F.min("rep").alias("a"))
    return texts.join(least, "id").select("a", F.col("rep").alias("b")).filter("a <> b").distinct()


def _small(table: DataFrame) -> DataFrame:
    """A stored table with a row for each of some buckets: broadcast where it is small, as a bucket may be large."""
    return F.broadcast(table) if table.count() <= BROADCAST_IDS else table


def _places() -> Column:
    """Blocks (t, q) of a member: as a target all q of its t, if it asks all t of its q; it goes to each once."""
    place = lambda t, q, target, query: F.struct(
        t.alias("t"), q.alias("q"), target.alias("target"), query.alias("query")
    )
    t, q, asks = F.col("t"), F.col("q"), F.col("asks")
    as_target = F.transform(F.sequence(F.lit(0), F.col("qs") - 1), lambda x: place(t, x, F.lit(True), asks & (x == q)))
    others = F.filter(F.sequence(F.lit(0), F.col("ts") - 1), lambda x: asks & (x != t))
    return F.concat(as_target, F.transform(others, lambda x: place(x, q, F.lit(False), F.lit(True))))


def _between_classes(members: DataFrame, bags: DataFrame, classes: DataFrame, similarity: float) -> DataFrame | None:
    """Links between the classes that still share a bucket."""
    placed = members.filter("n > 2").select("bucket", "id").join(classes, F.col("id") == F.col("node"), "left")
    placed = placed.select("bucket", "id", F.coalesce("root", "id").alias("class"))
    sizes = placed.groupBy("bucket", "class").agg(F.count(F.lit(1)).alias("m"))
    main = F.max_by("class", F.struct("m", "class")).alias("main")
    mixed = sizes.groupBy("bucket").agg(main, F.count(F.lit(1)).alias("k")).filter("k > 1").drop("k")
    mixed = stash(mixed, "mixed")
    open_ = stash(placed.join(_small(mixed), "bucket"), "mixed-buckets")
    if open_.isEmpty():
        return None
    with_bag = open_.join(bags, "id")
    size, outside = F.size("bag"), F.col("class") != F.col("main")
    blocks = lambda rows: F.greatest(
        F.lit(1), F.ceil(F.sum(F.when(rows, size)) / BLOCK), F.ceil(F.count_if(rows) / BLOCK_ROWS)
    ).cast("int")
    whole = with_bag.groupBy("bucket").agg(blocks(F.lit(True)).alias("ts"), blocks(outside).alias("qs"))
    whole = stash(whole, "blocks")
    one = lambda n, name: F.pmod(F.xxhash64("id"), n).cast("int").alias(name)
    dealt = open_.join(_small(whole), "bucket").select(
        "id", "bucket", "class", outside.alias("asks"), "ts", "qs", one("ts", "t"), one("qs", "q")
    )
    placed = dealt.select("id", "bucket", "class", F.explode(_places()).alias("at")).select(
        "id", "bucket", "class", "at.*"
    )
    found = placed.join(bags, "id").groupBy("bucket", "t", "q").applyInPandas(_compare(similarity), "a long, b long")
    return stash(found.distinct(), "late-links")


def brute_force(docs: list[tuple[int, str | None]], similarity: float = 0.8, width: int = 5) -> dict[int, int]:
    """Class by id, from all pairs, for tests (ids differ)."""

    def bag(text: str) -> Counter:
        w = text.encode().split()
        return Counter(
            tuple(w[i : i + width]) for i in range(len(w) - width + 1)
        ) if len(w) >= width else Counter([tuple(w)] * bool(w))

    bags = [(d, t or "", bag(t or "")) for d, t in docs]
    root = {d: d for d, _ in docs}

    def top(d: int) -> int:
        while root[d] != d:
            d = root[d]
        return d

    for i, (a, s, x) in enumerate(bags):
        for b, t, y in bags[:i]:
            both = (x & y).total()
            if s == t or (both and both >= similarity * (x.total() + y.total() - both)):
                low, high = sorted((top(a), top(b)))
                root[high] = low
    return {d: top(d) for d in root}
