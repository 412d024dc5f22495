"""Fill-in-the-middle: masks and ranked bits against plain loops, exact round trips, odd rows."""

import hashlib
import re
import time
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gleanspark.llm import infill

UNITS = {"char": r"(?s).", "line": r"[^\n]*\n|[^\n]+", "word": r"^\s*\S+\s*|\S+\s*|^\s+$"}
TEXT = st.text(alphabet="ab \n\té漢🙂<P>S", max_size=300)


@settings(max_examples=300, deadline=None)
@given(TEXT, st.sampled_from(sorted(UNITS)), st.integers(0, 2**32 - 1), st.integers(0, 2**32 - 1))
def test_cut_equals_a_plain_split(text, unit, h1, h2):
    units = re.findall(UNITS[unit], text, re.ASCII)
    assert "".join(units) == text
    n, a, b, at, to = infill.cut(text.encode(), h1, h2, unit)
    assert n == len(units) and (a, b) == tuple(sorted((h1 % (n + 1), h2 % (n + 1))))
    assert (at, to) == tuple(len("".join(units[:k]).encode()) for k in (a, b))


def test_every_rank_is_found():
    text = ("é" * 100 + "漢z" * 400).encode()
    marks = infill.ends(text, "char")
    ends = [k + 1 for k in range(len(text)) if k + 1 == len(text) or text[k + 1] & 0xC0 != 0x80]
    assert [infill.place(marks, len(text), k + 1) for k in range(len(ends))] == ends
    assert infill.place(marks, len(text), 0) == 0


def plain(doc_id, text):
    """The contract's row by slices of strings."""
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in infill.MARKERS) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    return n, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"


def test_odd_rows(spark):
    texts = [None, "", " \n", "a", "é漢🙂x" * 50, "has <P> inside", "<", "<S", "M>", ">", "a<M>b", "x<P", "\x00\x85 "]
    rows = [(k, t, "own", 7) for k, t in enumerate(texts * 20)] + [(None, "no id", "own", 7)] * 2
    rows.append((10**12, "long é " * 300_000, "own", 7))
    docs = spark.createDataFrame(rows, "doc_id long, text string, _cuts string, form int")
    done = infill.infill(docs)
    assert done.columns == [*docs.columns, "infill"] and {r._cuts for r in done.collect()} == {"own"}
    back = done.withColumn("back", infill.restored(F.col("infill.output"), F.col("infill.form")))
    got = Counter((r.doc_id, tuple(r.infill), r.back) for r in back.collect())
    assert got == Counter((i, plain(i, t), t or "") for i, t, *_ in rows)
    assert {"plain", "psm", "spm"} == {r.infill.form for r in back.collect()}
    assert infill.infill(docs.limit(0)).count() == 0


def test_parameters(spark):
    docs = spark.createDataFrame([(k, f"one two{k}  three\nfour five\n six") for k in range(60)], "doc_id long, text string")
    words = infill.infill(docs, unit="word", plain_percent=0, spm_percent=100, seed=3, markers=("[p]", "[s]", "[m]"))
    back = infill.restored(F.col("infill.output"), F.col("infill.form"), ("[p]", "[s]", "[m]"))
    rows = words.withColumn("back", back).collect()
    assert all(r.back == r.text and r.infill.form == "spm" and r.infill.n == 6 for r in rows)
    assert {r.infill.form for r in infill.infill(docs, plain_percent=100).collect()} == {"plain"}
    with pytest.raises(ValueError):
        infill.infill(docs, unit="page")


def test_very_long_text_is_linear(spark):
    took = []
    for n in (1_000_000, 8_000_000):
        text = ("é" * n).encode()
        began = time.process_time()
        assert infill.cut(text, n - 1, n // 2)[1:] == (n // 2, n - 1, 2 * (n // 2), 2 * (n - 1))
        took.append(time.process_time() - began)
    assert took[1] < 24 * took[0] + 0.5
