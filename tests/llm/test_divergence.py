"""The source audit against plain loops, and on odd rows."""

import re
from collections import Counter, defaultdict

import pytest

from gleanspark.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string"


def plain(rows, min_docs, top):
    """All rows of the audit by loops over whole vectors."""
    docs = [
        (lang or "", source or "", re.findall(divergence.TERM, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")))
        for _, text, lang, source in rows
    ]
    out = set()
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        df = Counter(t for _, _, ts in mine for t in set(ts))
        kept = [t for t in df if df[t] >= min_docs]
        v = len(kept)
        count = defaultdict(Counter)
        for _, source, ts in mine:
            count[source].update(t for t in ts if df[t] >= min_docs)
        sources = sorted({d[1] for d in mine}, key=str.encode)
        share = lambda c, n: 1 + 10**9 * (c + 2) // (n + 2 * v)
        p = {s: {t: share(count[s][t], sum(count[s].values())) for t in kept} for s in sources}
        both = Counter()
        for s in sources:
            both.update(count[s])
        q = {t: share(both[t], sum(both.values())) for t in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            parts = {
                "pair": [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s],
                "term": [(f(p[s][t], q[t]), t) for t in kept if count[s][t] and p[s][t] > q[t]],
            }
            for part, items in parts.items():
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                for k, (value, item) in enumerate(items[: top if part == "term" else None]):
                    out.add((lang, s, part, item, value, k + 1))
    return out


def test_equals_plain_loops(spark):
    import random

    rng = random.Random(4)
    words = ["Ab", "b", "été", "ÉTÉ", "漢字", "z9z", "c-d", "\U0001f642", "İ", "rare", "x"]
    rows = [
        (k, " ".join(rng.choices(words, k=rng.choice([0, 1, 5, 40]))), rng.choice(["en", "fr", None]), rng.choice(["a", "é", "z", None, "￿", "\U00010000"]))
        for k in range(120)
    ]
    rows += [(200, "alone", "de", "only"), (201, None, "xx", "s1"), (202, "", "xx", "s2"), (203, "Rare once", "xx", None)]
    rows += [(300, "b " * 200_000, "en", "a")] * 2
    rows += [(400 + k, f"tie{k % 4} tie{k % 4 + 4}", "t", f"s{k % 2}") for k in range(40)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for min_docs, top in ((10, 10), (1, 3)):
        got = [tuple(r) for r in divergence.audit(docs, min_docs=min_docs, top_terms=top).collect()]
        assert len(got) == len(set(got)) and set(got) == plain(rows, min_docs, top)


def test_large_counts_are_exact(spark):
    df = spark.createDataFrame([(9 * 10**15, 9 * 10**17 + 1, 12345)], "c long, n long, v long")
    got = df.select(divergence.share(df.c, df.n, df.v)).first()[0]
    assert got == 1 + 10**9 * (9 * 10**15 + 2) // (9 * 10**17 + 1 + 2 * 12345)


@pytest.mark.parametrize("names", ["lang string, source string, text string, term string, n int, v int, p int, held int"])
def test_names_and_empty(spark, names):
    rows = [(f"l{k % 2}", f"s{k % 3}", "w v", "t", 1, 2, 3, 4) for k in range(60)]
    docs = spark.createDataFrame(rows, names)
    assert divergence.audit(docs).columns == ["lang", "source", "part", "item", "value", "rank"]
    assert divergence.audit(docs).count() == 2 * 3 * 2
    assert divergence.audit(docs.limit(0)).count() == 0
