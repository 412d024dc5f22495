"""Secret scan: Aho-Corasick keyword prefilter, anchored expressions near hits, embedded checks.

One automaton pass over the folded text finds keyword hits.  At each hit the kind's expression is tried at
that place only.  Kinds with an embedded check (CRC-32, JSON header) keep a match only if the check holds.
Runs of hex digits have no keyword; a strided sample of the text stands in for it: a run of 24 covers four
consecutive sampled places.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def crc_holds(match: re.Match) -> bool:
    """The last six characters are the CRC-32 of the characters after the prefix before them, in base 62."""
    body, left = match[0].partition("_")[2], 0
    for c in body[-6:]:
        left = left * 62 + BASE62.index(c)
    return left == zlib.crc32(body[:-6].encode())


def jwt_holds(match: re.Match) -> bool:
    """The first part is base64url of a JSON object that names an algorithm."""
    head = match[0].partition(".")[0]
    try:
        found = json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
    except (ValueError, RecursionError):  # no base64, no JSON, or nested too deeply for a header
        return False
    return isinstance(found, dict) and isinstance(found.get("alg"), str)


@dataclass(frozen=True)
class Kind:
    """A sort of secret.  Matches are leftmost and non-overlapping; those that fail ``holds`` are dropped after that."""

    name: str
    keywords: tuple[str, ...]  # lower case; each match starts with one of them
    pattern: str
    flags: int
    holds: Callable[[re.Match], bool]
    run: str = ""  # where a try fails, all others within this run of characters fail too


BASE = (
    Kind(
        "assign",
        ("password", "passwd", "secret", "token", "apikey", "api_key"),
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        re.A | re.I,
        lambda m: len(m[2]) >= 6,
    ),
    Kind("access", ("akia",), r"AKIA[A-Z0-9]+", re.A, lambda m: len(m[0]) >= 20),
)
HEX, HEX_LEAST, STRIDE = "hex", 24, 6
ADDED = (
    Kind("hub", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), r"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])", re.A, crc_holds),
    Kind("registry", ("npm_",), r"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])", re.A, crc_holds),
    Kind("jwt", ("eyj",), r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", re.A, jwt_holds, r"[A-Za-z0-9_-]*"),
    Kind("pem", ("-----begin ",), r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----", re.A, lambda m: True),
)
NAMES = ["assign", "access", HEX, *(k.name for k in ADDED)]


class Scanner:
    def __init__(self) -> None:
        self.kinds = [(k, re.compile(k.pattern, k.flags), re.compile(k.run) if k.run else None) for k in BASE + ADDED]
        self.words = ahocorasick.Automaton()
        for at, (kind, *_) in enumerate(self.kinds):
            for word in kind.keywords:
                self.words.add_word(word, (at, len(word)))
        self.words.make_automaton()
        self.sampled = re.compile(r"[0-9a-f]{%d,}" % (HEX_LEAST // STRIDE)).finditer
        self.run = re.compile(r"[0-9a-f]*").match

    def __call__(self, text: str | None) -> list[tuple[str, int, int]]:
        """Kind, start and end (code points, exclusive) by start, then by kind as listed."""
        if not text:
            return []
        found = []
        upto = [0] * len(self.kinds)
        for end, (at, size) in self.words.iter(text.replace("İ", "i").lower()):  # U+0130 alone would change the length
            start = end - size + 1
            if start >= upto[at]:
                kind, pattern, run = self.kinds[at]
                if m := pattern.match(text, start):
                    upto[at] = m.end()
                    if kind.holds(m):
                        found.append((kind.name, start, m.end()))
                elif run:
                    upto[at] = run.match(text, start).end()
        found += self._hex(text)
        return sorted(found, key=lambda s: (s[1], NAMES.index(s[0])))

    def _hex(self, text: str) -> list[tuple[str, int, int]]:
        out, upto = [], 0
        for m in self.sampled(text[::STRIDE]):
            at = m.start() * STRIDE
            while at < m.end() * STRIDE:  # sampled places may belong to several runs
                if at >= upto and at < len(text):
                    start = at
                    while start > upto and text[start - 1] in "0123456789abcdef":
                        start -= 1
                    upto = max(self.run(text, at).end(), at + 1)
                    if upto - start >= HEX_LEAST:
                        out.append((HEX, start, upto))
                at += STRIDE
        return out


def find_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and secrets (array of kind, start, end, value by start, then kind as listed) of every row.

    Offsets are code points of the whole text, ends exclusive.  Null and empty texts have no secrets (empty
    array); repeated rows stay repeated; other columns are dropped, whatever their names.  Kinds overlap freely (ties
    in start go by kind); the time is linear in a text's length, very long ones and repeated keywords included.
    """

    @F.pandas_udf("array<struct<kind:string,start:long,end:long,value:string>>")
    def secrets(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scan = Scanner()
        for texts in batches:
            yield pd.Series(
                [[{"kind": k, "start": a, "end": b, "value": t[a:b]} for k, a, b in scan(t)] for t in texts.tolist()],
                dtype=object,
            )

    return docs.select(F.col(id_col), secrets(text_col).alias("secrets"))


def joined(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, the hash of their spans and all spans as text."""
    n = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("secrets", lambda s: s["kind"].isin("assign", "access", HEX))
    return found.select(
        id_col,
        n("assign"),
        n("access"),
        n(HEX),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("secrets")).alias("spans"),
    )


def brute_force(text: str | None) -> tuple[int, int, int, str]:
    """Base counts and hash by plain scans, for tests."""
    text = text or ""
    a = [("assign", m.start(), m.end()) for m in re.finditer(BASE[0].pattern, text, re.A | re.I) if len(m[2]) >= 6]
    k = [("access", m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    h = [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    spans = sorted(a + k + h, key=lambda s: (s[1], NAMES.index(s[0])))
    return len(a), len(k), len(h), hashlib.sha256(",".join(f"{n}:{i}:{j}" for n, i, j in spans).encode()).hexdigest()
