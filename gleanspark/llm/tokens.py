"""Token counts by rank-synchronous array merging.

A batch's distinct pre-tokens are held as one flat array of symbol ids with ragged bounds.  In each round
every sequence finds its pair of lowest rank and merges all of that pair's occurrences at once; sequences
without a mergeable pair leave with their number of symbols.  A merge only makes pairs of higher rank (each
symbol is made by one merge), so merging a pair's occurrences together gives what one-by-one merging gives.

Texts are cut into pre-tokens here, by expressions; only those with characters that this Python's Unicode tables lack
are cut by the library's own normalizer and expressions, whose tables are of another version.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Unicode white space as the tokenizer's regular expressions know it (fixed values).
WHITE = r"\t-\r \x85\xa0  -     　"
NONE = np.int32(2**31 - 1)
#: Pre-tokens whose counts a worker remembers, and characters of text it splits before merging.
REMEMBERED, CHUNK = 300_000, 2_000_000


def byte_symbols() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    moved = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in set(plain))}
    return [chr(moved.get(b, b)) for b in range(256)]


def newer_characters() -> str:
    """A character class of what has no category here but one in the expressions' tables."""
    known = regex.compile(r"\P{Cn}").match
    found = [c for c in range(0x110000) if unicodedata.category(chr(c)) == "Cn" and known(chr(c))]
    starts = [*found[:1], *(b for a, b in zip(found, found[1:], strict=False) if b != a + 1)]
    ends = [*(a for a, b in zip(found, found[1:], strict=False) if b != a + 1), *found[-1:]]
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(starts, ends, strict=True))


@dataclass(frozen=True)
class MergeTable:
    """A byte-level BPE vocabulary with word ends as arrays; its size is that of the vocabulary file."""

    pairs: np.ndarray  # sorted left * size + right
    ranks: np.ndarray  # rank of each of ``pairs``
    made: np.ndarray  # symbol made, by rank
    first: np.ndarray  # symbol of a byte
    last: np.ndarray  # symbol of a byte that ends its pre-token
    size: int
    split: str
    specials: tuple[str, ...]
    newer: str  # characters without a category here that the expressions' tables know
    cutter: str  # the library's normalizer and pre-tokenizer, with an empty vocabulary

    @classmethod
    def load(cls, path: str) -> MergeTable:
        spec = json.loads(Path(path).read_text(encoding="utf-8"))
        model, vocab = spec["model"], spec["model"]["vocab"]
        end = model.get("end_of_word_suffix") or ""
        size = max(vocab.values()) + 1
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocab[a] * size + vocab[b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        symbols = byte_symbols()
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        return cls(
            keys[order], order.astype(np.int32), np.array([vocab[a + b] for a, b in merges], np.int32),
            np.array([vocab[s] for s in symbols], np.int32), np.array([vocab[s + end] for s in symbols], np.int32),
            size, pattern.replace(r"\s", WHITE), tuple(t["content"] for t in spec.get("added_tokens", [])),
            newer_characters(), json.dumps(spec | {"added_tokens": [], "post_processor": None, "model": {"type": "BPE", "vocab": {}, "merges": []}}),
        )

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.ranks[at], NONE)

    def count(self, words: list[bytes]) -> np.ndarray:
        """Number of symbols that each pre-token (not empty) ends with."""
        out = np.zeros(len(words), np.int64)
        if not words:
            return out
        lens = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(lens) - 1
        ids = self.first[flat]
        ids[ends] = self.last[flat[ends]]
        rank = np.full(len(ids), NONE, np.int32)
        rank[:-1] = self.rank(ids[:-1], ids[1:])
        rank[ends] = NONE
        who = np.arange(len(words))
        while True:
            lowest = np.minimum.reduceat(rank, np.cumsum(lens) - lens)
            live = lowest != NONE
            if not live.all():
                out[who[~live]] = lens[~live]
                if not live.any():
                    return out
                keep = np.repeat(live, lens)
                ids, rank, lens, who, lowest = ids[keep], rank[keep], lens[live], who[live], lowest[live]
            owner = np.repeat(np.arange(len(lens)), lens)
            at = np.flatnonzero(rank == lowest[owner])
            if (np.diff(at) == 1).any():  # a symbol paired with itself: every other one, from the left
                fresh = np.concatenate(([True], np.diff(at) != 1))
                at = at[(np.arange(len(at)) - np.flatnonzero(fresh)[np.cumsum(fresh) - 1]) % 2 == 0]
            ids[at] = self.made[rank[at]]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            lens = lens - np.bincount(owner[at], minlength=len(lens))
            ids, rank = ids[keep], rank[keep]
            at = at - np.arange(len(at))
            near = np.union1d(at, at - 1)
            near = near[near >= 0]
            inner = near[near + 1 < len(ids)]
            rank[near] = NONE
            rank[inner] = self.rank(ids[inner], ids[inner + 1])
            rank[np.cumsum(lens) - 1] = NONE


class Counter:
    """Token counts of whole texts, batch by batch."""

    def __init__(self, table: MergeTable):
        self.table, self.known = table, {}
        self.find = regex.compile(table.split).findall
        self.cut = regex.compile("|".join(map(regex.escape, sorted(table.specials, key=len, reverse=True))) or r"(?!)")

        self.newer = re.compile(f"[{table.newer}]" if table.newer else r"(?!)").search
        self.cutter, self.byte = None, {c: b for b, c in enumerate(byte_symbols())}

    def _by_library(self, text: str) -> list[str]:
        if self.cutter is None:
            from tokenizers import Tokenizer

            self.cutter = Tokenizer.from_str(self.table.cutter)
        words = self.cutter.pre_tokenizer.pre_tokenize_str(self.cutter.normalizer.normalize_str(text))
        return [bytes(map(self.byte.__getitem__, w)).decode("utf-8") for w, _ in words]

    def _split(self, text: str) -> list[str]:
        if not text.isascii():
            if self.newer(text):
                return self._by_library(text)
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # lower() looks at a final sigma's place
        return self.find(text.lower())

    def __call__(self, texts: list[str | None]) -> list[int]:
        out, held, size = [], [], 0
        for text in texts:
            parts = self.cut.split(text or "")
            held.append((len(parts) - 1, [w for p in parts for w in self._split(p)]))
            size += len(text or "")
            if size > CHUNK:
                out += self._flush(held)
                held, size = [], 0
        return out + self._flush(held)

    def _flush(self, held: list[tuple[int, list[str]]]) -> list[int]:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = list(set().union(*(w for _, w in held)) - self.known.keys())
        self.known.update(zip(new, self.table.count([w.encode("utf-8", "replace") for w in new]).tolist(), strict=True))
        known = self.known.__getitem__
        return [n + sum(map(known, words)) for n, words in held]


def count_tokens(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """``id_col``, n_bytes, n_tokens and over_limit (n_tokens > ``limit``) of every row.

    A null text counts as empty (0 bytes, 0 tokens); a null id stays null; repeated rows stay repeated; other
    columns are dropped, whatever their names.  Whole texts are counted, at any length.  An empty table gives none.
    """
    table = MergeTable.load(tokenizer)

    @F.pandas_udf("long")
    def n_tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = Counter(table)
        for texts in batches:
            yield pd.Series(count(texts.tolist()), dtype="int64")

    rows = docs.select(F.col(id_col), F.octet_length(F.coalesce(text_col, F.lit(""))).cast("long").alias("n_bytes"), n_tokens(text_col).alias("n_tokens"))
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)
