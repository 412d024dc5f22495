"""Quality rules: a table of thresholds compiled into one Spark projection, without user functions.

The projection binds the words, lines and five-word windows of a text once (``let``) and measures lengths,
symbols, stop words, lines and repeats on them; every rule then is a comparison of two measures' ratio.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanspark.llm.common import SPACES, WORD

#: Fixed word lists: the most frequent function words of the four languages.
STOP_WORDS = (
    "the and of to a in is that it was for on with as be by are this at from "
    "der die und in den von das zu mit sich für nicht des auf ist dem im ein eine als "
    "de la et le les des en du un une que pour est qui dans par sur pas avec au "
    "el las y los se del no con por para una su es al lo"
).split()
SYMBOLS = r"[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    """Bounds (inclusive, either may be missing) on ``measure / per``, for texts of at least ``words`` words."""

    name: str
    measure: str
    per: str
    least: float | None = None
    most: float | None = None
    words: int = 0

    def holds(self, m: Column) -> Column:
        ratio = m[self.measure] / F.greatest(m[self.per], F.lit(1))
        bounds = [
            ratio >= F.lit(self.least)
        ] * (self.least is not None) + [ratio <= F.lit(self.most)] * (self.most is not None)
        ok = bounds[0] if len(bounds) == 1 else bounds[0] & bounds[1]
        return (m["n_words"] < self.words) | ok if self.words else ok


RULES = (
    Rule("mean word length", "word_chars", "n_words", least=2.0, most=20.0),
    Rule("symbols to words", "n_symbols", "n_words", most=0.1),
    Rule("stop words", "n_stop_words", "n_words", least=0.01, words=50),
    Rule("repeated lines", "n_dup_lines", "n_lines", most=0.5),
    Rule("bullet lines", "n_bullet_lines", "n_lines", most=0.9),
    Rule("unfinished lines", "n_ellipsis_lines", "n_lines", most=0.3),
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _near_equal(items: Column, key: str) -> Column:
    """The ``i`` of the sorted structs whose ``key`` equals a neighbour's."""
    same = lambda k, d: F.get(items, k)[key] == F.get(items, k + F.lit(d))[key]
    at = F.filter(
        F.sequence(F.lit(0), F.size(items) - 1),
        lambda k: F.coalesce(same(k, 1), F.lit(False)) | F.coalesce((k > 0) & same(k, -1), F.lit(False)),
    )
    return F.transform(at, lambda k: F.get(items, k)["i"])


def _covered(places: Column, width: int) -> Column:
    """Words covered by windows that start at the sorted ``places``."""
    steps = F.aggregate(
        F.sequence(F.lit(1), F.size(places) - 1),
        F.lit(0),
        lambda a, k: a + F.least(F.lit(width), F.get(places, k) - F.get(places, k - 1)),
    )
    return F.when(F.size(places) > 1, steps + width).otherwise(0)


def repeated_words(words: Column, width: int = 5) -> Column:
    """Words in ``width``-word windows that occur twice or more in the same array, the first occurrence included.

    Windows are compared by hash first; only texts with equal hashes compare the windows' words, exactly.
    """
    start = lambda: F.sequence(F.lit(1), F.size(words) - (width - 1))
    hashes = F.transform(start(), lambda i: F.xxhash64(F.slice(words, i, width)))

    def exact(h: Column) -> Column:
        by_hash = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        texts = lambda p: F.sort_array(F.transform(p, lambda i: F.struct(F.array_join(F.slice(words, i + 1, width), " ").alias("t"), i.alias("i"))))
        alike = let(by_hash, lambda s: let(texts(_near_equal(s, "h")), lambda t: F.sort_array(_near_equal(t, "t"))))
        return let(alike, lambda p: _covered(p, width))

    some = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), exact(h)).otherwise(0))
    return F.when(F.size(words) > width, some).otherwise(0)


def measures(text: Column) -> Column:
    """Struct of the measures (long) that rules may name."""
    text = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(text, f"[{SPACES}]+"), "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))

    def of(w: Column) -> Column:
        fields = {
            "n_words": F.size(w),
            "word_chars": F.length(F.array_join(w, "")),
            "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)),
            "n_stop_words": F.size(F.filter(w, lambda x: F.lower(x).isin(STOP_WORDS))),
            "n_repeat_words": repeated_words(w),
        }
        counted = let(lines, lambda x: F.struct(
            F.size(x).alias("n_lines"),
            (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines"),
            F.size(F.filter(x, lambda y: F.substring(F.ltrim(y), 1, 1).isin("•", "*", "-"))).alias("n_bullet_lines"),
            F.size(
                F.filter(x, lambda y: F.rtrim(y).endswith("...") | F.rtrim(y).endswith("…"))
            ).alias("n_ellipsis_lines"),
        ))
        return let(
            counted,
            lambda c: F.struct(
                *(v.cast("long").alias(k) for k, v in fields.items()),
                *(c[k].cast("long").alias(k) for k in ("n_lines", "n_dup_lines", "n_bullet_lines", "n_ellipsis_lines")),
            ),
        )

    return let(words, of)


def judge(
    docs: DataFrame,
    rules: tuple[Rule, ...] = RULES,
    *,
    text_col: str = "text",
    into: str = "quality",
    min_words: int = 10,
    max_repeat_percent: int = 20,
) -> DataFrame:
    """``docs`` with the struct ``into``: the measures, base_failed, kept and failed (names of the rules that fail).

    base_failed: fewer than ``min_words`` words, or more than ``max_repeat_percent`` percent of them repeated;
    kept: neither that nor a failed rule.  Null and empty texts have measures of 0 and are not kept.  A column
    named like ``into`` is replaced; all others and repeated rows stay.
    """

    def verdict(m: Column) -> Column:
        failed = (m["n_words"] < min_words) | (
            F.lit(100) * m["n_repeat_words"] > F.lit(max_repeat_percent) * m["n_words"]
        )
        names = F.array_compact(
            F.array(*(F.when(~r.holds(m), F.lit(r.name)) for r in rules))
        ) if rules else F.array().cast("array<string>")
        kept = ~failed
        for r in rules:
            kept = kept & r.holds(m)
        return F.struct(m.alias("m"), failed.alias("base_failed"), kept.alias("kept"), names.alias("failed"))

    return docs.withColumn(into, let(measures(F.col(text_col)), verdict))


def brute_force(text: str | None) -> dict[str, int | bool]:
    """Base measures by plain loops, for tests."""
    import re
    from collections import Counter

    text = text or ""
    w = re.findall(WORD, text)
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    return {
        "n_words": len(w),
        "word_chars": sum(map(len, w)),
        "n_symbols": len(re.findall(SYMBOLS, text)),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
        "base_failed": len(w) < 10 or 100 * len(covered) > 20 * len(w),
    }
