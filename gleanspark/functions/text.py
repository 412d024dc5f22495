"""Column functions over texts, arrays and scores."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space for ``normalize``: wider than the engine's own classes (fixed value).
WIDE_SPACE = r"(?U)[\s\x1c-\x1f\x85\p{Z}]+"
WORD_GAP = r"[\x20\x09-\x0D]+"


def normalize(text: Column) -> Column:
    """Lower case, any run of Unicode white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), WIDE_SPACE, " "))


def tokens(text: Column, cased: bool = False) -> Column:
    """Words, in lower case unless ``cased``."""
    return F.array_remove(F.split(text if cased else F.lower(text), WORD_GAP), "")


def preview(text: Column, n: int = 200) -> Column:
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit("…"))).otherwise(text)


def on_or_after(text: Column, day: str) -> Column:
    """Whether an ISO date is ``day`` or later; a missing or malformed one passes."""
    return F.coalesce(F.try_to_date(F.substring(text, 1, 10)) >= F.lit(day).cast("date"), F.lit(True))


def row_text(*fields: Column, completion: Column | None = None) -> Column:
    """The first field that isn't empty, and a completion after a blank line."""
    first = F.coalesce(*(F.when(f != "", f) for f in fields))
    return first if completion is None else F.concat_ws("\n\n", first, F.when(completion != "", completion))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(total(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))) / (norm(a) * norm(b) + F.lit(1e-8))


def minmax01(a: Column) -> Column:
    """(x - min) / (span + 1e-8); zeros where the span is below 1e-8."""
    low, span = F.array_min(a), F.array_max(a) - F.array_min(a)
    return let(
        F.struct(low.alias("low"), span.alias("span")),
        lambda s: F.transform(
            a, lambda x: F.when(s["span"] < 1e-8, F.lit(0.0)).otherwise((x - s["low"]) / (s["span"] + 1e-8))
        ),
    )


def softmax(a: Column) -> Column:
    """Softmax; NaN and minus infinite entries count as -10,000, infinite ones as 10,000."""
    parts = lambda x: let(F.array_max(x), lambda m: F.transform(x, lambda y: F.exp(y - m)))
    shares = lambda p: let(total(p), lambda t: F.transform(p, lambda y: y / t))
    return let(let(finite(a, F.lit(-1e4), F.lit(1e4), -1e4), parts), shares)


def log_softmax(a: Column) -> Column:
    """Shifted by the maximum, so that no exponential overflows."""
    rest = lambda m: F.ln(total(F.transform(a, lambda x: F.exp(x - m))))
    return let(F.array_max(a), lambda m: let(rest(m), lambda t: F.transform(a, lambda x: x - m - t)))


def mix_uniform(p: Column, share: float) -> Column:
    mixed = F.transform(p, lambda x: (1 - share) * x + F.lit(share) / F.size(p))
    return let(mixed, lambda m: let(total(m), lambda t: F.transform(m, lambda x: x / t)))


def entropy01(p: Column) -> Column:
    """Entropy over ln of the number of entries, within 0 and 1."""
    h = -total(F.transform(p, lambda x: F.when(x > 0, x * F.ln(x)).otherwise(0.0)))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), h / (F.ln(F.size(p).cast("double")) + 1e-8)))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def finite(a: Column, nan: Column, high: Column, low: float = 0.0) -> Column:
    """An array with NaN, infinite and minus infinite entries replaced."""
    inf = float("inf")
    return F.transform(
        a, lambda x: F.when(F.isnan(x), nan).when(x == inf, high).when(x == -inf, F.lit(low)).otherwise(x)
    )


def penalty(risks: Column, prefix: Column, mode: str = "delta") -> Column:
    """Penalties of candidates within 0 and 1 by their risks.

    ``delta``: how far they exceed the prefix's risk; ``absolute``: the risks themselves; ``zscore``: standardized
    (sample deviation), zeros where that is below 1e-8.
    """
    clean = finite(risks, prefix, prefix)
    if mode == "absolute":
        return minmax01(clean)
    if mode == "delta":
        return minmax01(F.transform(clean, lambda x: F.greatest(x - prefix, F.lit(0.0))))
    if mode != "zscore":
        raise ValueError(f"no such mode: {mode}")

    def scaled(r: Column) -> Column:
        spread = lambda m: F.sqrt(total(F.transform(r, lambda x: (x - m) * (x - m))) / F.greatest(F.size(r) - 1, F.lit(1)))
        zeros = F.transform(r, lambda x: F.lit(0.0))
        z = lambda m, s: minmax01(F.transform(r, lambda x: (x - m) / (s + 1e-8)))
        return let(total(r) / F.size(r), lambda m: let(spread(m), lambda s: F.when(s < 1e-8, zeros).otherwise(z(m, s))))

    return let(clean, scaled)


def safe_float(text: Column, default: float = 0.0) -> Column:
    """A finite number, or ``default`` for anything else."""
    x = text.try_cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(default)).otherwise(x)


def safe_div(a: Column, b: Column, least: float = 1e-12) -> Column:
    return a / F.greatest(b, F.lit(least))


def log_ratio(a: Column, b: Column, eps: float = 1e-8) -> Column:
    return F.ln(a + F.lit(eps)) / F.ln(b + F.lit(eps))


def bottom_k_mean(a: Column, share: float) -> Column:
    """Mean of the max(1, int(n * share)) smallest values."""
    k = F.greatest(F.lit(1), F.floor(F.size(a) * F.lit(share)).cast("int"))
    return total(F.slice(F.array_sort(a), F.lit(1), k)) / k


#: Temperatures of the first twenty lengths (fixed values); 1 beyond.
DECAY = (
    10.0,
    9.53,
    9.06,
    8.59,
    8.12,
    7.65,
    7.18,
    6.71,
    6.24,
    5.77,
    5.30,
    4.83,
    4.36,
    3.89,
    3.42,
    2.95,
    2.49,
    2.01,
    1.54,
    1.0,
)


def decayed_temperature(length: Column) -> Column:
    """Sampling temperature at a total length in tokens."""
    return F.coalesce(F.get(F.array(*map(F.lit, DECAY)), (length - 1).cast("int")), F.lit(1.0))


def sanitized(a: Column) -> Column:
    """An array with zeros for NaN and large numbers for infinite entries."""
    return F.transform(
        a, lambda x: F.when(F.isnan(x), 0.0).when(x == float("inf"), 1e10).when(x == float("-inf"), -1e10).otherwise(x)
    )
