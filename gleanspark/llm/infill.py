"""Fill-in-the-middle by big-integer bit-parallelism.

A text's bytes are translated to a mask with one bit a byte for each class of bytes; boolean operations on the mask
and on its shifts mark where units end, ``bit_count`` counts them, and the end of the k-th one is found by halving the
mask again and again.  Only places come back from the workers; texts are put together by Spark.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanspark.llm.common import fresh

#: Of prefix, suffix and middle.
MARKERS = ("<P>", "<S>", "<M>")
#: Bits below which a ranked bit is found one by one.
NARROW = 64


def _class(members: bytes | range) -> bytes:
    """A table for ``bytes.translate``: 1 for the class's bytes, 0 for others."""
    held = set(members)
    return bytes(b"01"[b in held] for b in range(256))


#: Bytes that go on a code point, that are white space, and that end a line.
CONTINUED, SPACE, NEWLINE = _class(range(0x80, 0xC0)), _class(b"\t\n\v\f\r "), _class(b"\n")


def mask(text: bytes, table: bytes) -> int:
    """Bit i is set if byte i is of the class."""
    return int(text.translate(table)[::-1], 2)


def ends(text: bytes, unit: str) -> int:
    """Bit i is set if a unit ends with byte i; units together are the whole text.

    A ``char`` is a code point, a ``word`` a run of other than white space with the white space after it (and, for the
    first one, before it), a ``line`` goes to its newline.
    """
    if not text:
        return 0
    full = (1 << len(text)) - 1
    last = 1 << (len(text) - 1)
    if unit == "char":
        return ((full ^ mask(text, CONTINUED)) >> 1) | last
    if unit == "line":
        return mask(text, NEWLINE) | last
    if unit == "word":
        space = mask(text, SPACE)
        starts = ~space & (space << 1) & full
        before = starts & -starts if space & 1 else 0  # the first word takes what stands before it
        return ((starts ^ before) >> 1) | last
    raise ValueError(f"no unit {unit!r}: char, word or line")


def place(marks: int, width: int, k: int) -> int:
    """The place after the k-th set bit of the lowest ``width`` ones, 0 for k = 0."""
    if not k:
        return 0
    at = 0
    while width > NARROW:
        half = width >> 1
        low = marks & ((1 << half) - 1)
        n = low.bit_count()
        if k <= n:
            marks, width = low, half
        else:
            marks, width, at, k = marks >> half, width - half, at + half, k - n
    for _ in range(k - 1):
        marks &= marks - 1
    return at + (marks & -marks).bit_length()


def cut(text: bytes, h1: int, h2: int, unit: str = "char") -> tuple[int, int, int, int, int]:
    """Units, those before the middle and up to its end, and the bytes of both."""
    marks = ends(text, unit)
    n = marks.bit_count()
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    return n, a, b, place(marks, len(text), a), place(marks, len(text), b)


def draws(id_col: str, seed: int, n: int = 4) -> list[Column]:
    """The first groups of 8 hexadecimal digits of the SHA-256 of seed, colon and id, as numbers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(n)]


def infill(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    seed: int = 1,
    unit: str = "char",
    plain_percent: int = 10,
    spm_percent: int = 20,
    markers: tuple[str, str, str] = MARKERS,
    into: str = "infill",
) -> DataFrame:
    """``docs`` with the struct ``into``: n (units), form, prefix_n, middle_n (units; null if plain) and output.

    Two draws cut a text into prefix, middle and suffix; ``psm`` gives them as prefix, suffix, middle, each behind its
    marker, ``spm`` as suffix, prefix, middle.  ``plain`` texts stay as they are: empty ones, those that hold a marker,
    and ``plain_percent`` of the others.  Draws depend on seed and id alone: rows of one id are cut alike if their texts
    have as many units, rows without an id as if it were empty.  A null text counts as empty; blank and very long texts
    are cut whole; repeated rows stay repeated.  A column named like ``into`` is replaced, all others stay as they are,
    whatever their names.  An empty table gives none.
    """
    ends(b"", unit) if unit in ("char", "word", "line") else ends(b"x", unit)

    @F.pandas_udf("n long, a long, b long, at long, to long")
    def cuts(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for text, h1, h2 in batches:
            rows = [cut(*row, unit) for row in zip(text, h1, h2, strict=True)]
            yield pd.DataFrame(rows, columns=["n", "a", "b", "at", "to"], dtype="int64")

    (c,) = fresh(docs, "_cuts")
    text = F.coalesce(F.col(text_col), F.lit(""))
    h1, h2, h3, h4 = draws(id_col, seed)
    raw, at, to = text.cast("binary"), F.col(c)["at"].cast("int"), F.col(c)["to"].cast("int")
    prefix, middle = F.substring(raw, F.lit(1), at), F.substring(raw, at + 1, to - at)
    suffix = F.substring(raw, to + 1, F.octet_length(text))
    p, s, m = (F.encode(F.lit(x), "utf-8") for x in markers)
    held = F.contains(text, F.lit(markers[0])) | F.contains(text, F.lit(markers[1])) | F.contains(text, F.lit(markers[2]))
    plain = (F.length(text) == 0) | held | (h3 % 100 >= 100 - plain_percent)
    form = F.when(plain, "plain").when(h4 % 100 < spm_percent, "spm").otherwise("psm")
    psm, spm = F.concat(p, prefix, s, suffix, m, middle), F.concat(s, suffix, p, prefix, m, middle)
    output = F.when(form == "plain", text).otherwise(F.when(form == "psm", psm).otherwise(spm).cast("string"))
    done = F.struct(
        F.col(c)["n"].alias("n"),
        form.alias("form"),
        F.when(form != "plain", F.col(c)["a"]).alias("prefix_n"),
        F.when(form != "plain", F.col(c)["b"] - F.col(c)["a"]).alias("middle_n"),
        output.alias("output"),
    )
    return docs.withColumn(c, cuts(raw, h1, h2)).withColumn(into, done).drop(c)


def restored(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text that was cut, from output and form alone."""
    parts = F.split(output, "|".join(re.escape(x) for x in markers))
    psm, spm = (F.concat(*(F.get(parts, F.lit(k)) for k in order)) for order in ((1, 3, 2), (2, 3, 1)))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def digest(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, n, form, prefix_chars, middle_chars and digests of output and restored text."""
    (done,) = fresh(docs, "_infill")
    x = F.col(done)
    return infill(docs.select(id_col, text_col), id_col=id_col, text_col=text_col, into=done).select(
        F.col(id_col),
        x["n"].alias("n"),
        x["form"].alias("form"),
        x["prefix_n"].alias("prefix_chars"),
        x["middle_n"].alias("middle_chars"),
        F.sha2(x["output"], 256).alias("output_sha256"),
        F.sha2(restored(x["output"], x["form"]), 256).alias("restored_sha256"),
    )


def sql(seed: int = 1) -> str:
    """DuckDB SQL of ``op11_fill_in_middle``."""
    h = [f"('0x' || substr(h, {8 * k + 1}, 8))::bigint" for k in range(4)]
    return f"""
with d as (select doc_id, coalesce(text, '') t, sha256('{seed}:' || coalesce(doc_id::varchar, '')) h from documents),
q as (select doc_id, t, length(t) n, {", ".join(f"{x} h{k + 1}" for k, x in enumerate(h))} from d),
c as (select *, least(h1 % (n + 1), h2 % (n + 1)) a, greatest(h1 % (n + 1), h2 % (n + 1)) b,
  case when n = 0 or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain'
       when h4 % 100 < 20 then 'spm' else 'psm' end form from q),
p as (select *, substring(t, 1, a) prefix, substring(t, a + 1, b - a) middle, substring(t, b + 1, n - b) suffix from c)
select doc_id, n, form, case when form <> 'plain' then a end prefix_chars, case when form <> 'plain' then b - a end middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle
         else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) output_sha256, sha256(t) restored_sha256 from p"""
