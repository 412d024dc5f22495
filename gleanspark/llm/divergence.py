"""Divergence of sources by wide term vectors.

Workers count a document's terms and sum them over documents; each language's terms then become arrays indexed by its
sources.  Higher-order functions turn an array into contributions of pairs of sources, which partial sums take in ahead
of the shuffle.  A pair in which neither source has the term
contributes the same for each such term; that share is multiplied out at the end instead of emitted, so that rows grow
with the sources a term occurs in, not with all pairs.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanspark.llm.common import broadcast_small, stash

#: A run of letters A to Z and of all characters beyond ASCII.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SCALE = 1_000_000_000
#: Each byte's lower-case letter, byte of a longer character, or the space that stands for all that ends a term.
FOLDED = bytes(b | 0x20 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
#: Counts that a worker holds before it hands them on, and bytes of a text that it cuts into terms at a time.
HELD, CHUNK = 400_000, 4_000_000


def share(count: Column, n: Column, v: Column) -> Column:
    """1 + floor(SCALE * (count + 2) / (n + 2 v)), exact for any long."""
    whole = lambda x: x.cast("decimal(20,0)")
    return F.lit(1).cast("long") + F.call_function("div", whole(count + 2) * F.lit(SCALE), whole(n + 2 * v))


def distance(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); shares are below 2^30, their squares below 2^63."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _columns(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    names = ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))
    return docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in names))


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in order, A to Z lower-cased and no other letter, in lists of bounded length."""
    folded, at = text.translate(FOLDED), 0
    while at < len(folded):
        end = folded.find(b" ", at + CHUNK)
        end = len(folded) if end < 0 else end
        yield folded[at:end].split()
        at = end


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, term, n and docs, summed over documents until there are too many."""
    n: dict[tuple[str, str], Counter[bytes]] = defaultdict(Counter)
    docs: dict[tuple[str, str], Counter[bytes]] = defaultdict(Counter)

    def rows() -> Iterator[pa.RecordBatch]:
        for (lang, source), counts in n.items():
            columns = [
                pa.array([lang] * len(counts), pa.string()),
                pa.array([source] * len(counts), pa.string()),
                pa.array(list(counts), pa.binary()),
                pa.array(list(counts.values()), pa.int64()),
                pa.array([docs[lang, source][t] for t in counts], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])
        n.clear(), docs.clear()

    held = 0
    for batch in batches:
        for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            mine, seen = n[lang, source], set()
            held -= len(mine)
            for terms in terms_of(text):
                mine.update(terms)
                seen.update(terms)
            docs[lang, source].update(seen)
            held += len(mine)
            if held > HELD:
                yield from rows()
                held = 0
    yield from rows()


def _counts(rows: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and docs (documents that hold the term).

    Workers have summed already, so that their rows are dealt once, by language and term, for this and the next sums.
    """
    each = rows.select("lang", "source", F.col("text").cast("binary")).mapInArrow(
        _count, "lang string, source string, term binary, n long, docs long"
    )
    dealt = each.withColumn("term", F.col("term").cast("string")).repartition("lang", "term")
    return dealt.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def vectors(
    docs: DataFrame,
    *,
    min_docs: int = 10,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
) -> tuple[DataFrame, DataFrame]:
    """Two stored tables: the kept terms' vectors, and what each language knows of its sources.

    The first has lang, term, total and counts (occurrences by index of the source).  The second has lang, sources (in
    order of UTF-8), n (occurrences of kept terms by source), absent (each source's share of a term that it lacks),
    total, v (kept terms).
    """
    rows = _columns(docs, text_col, lang_col, source_col)
    named = stash(rows.groupBy("lang").agg(F.array_sort(F.collect_set("source")).alias("sources")), "sources")
    kept = (
        _counts(rows)
        .groupBy("lang", "term")
        .agg(
            F.sum("docs").alias("docs"),
            F.sum("n").alias("total"),
            F.map_from_entries(F.collect_list(F.struct("source", "n"))).alias("by"),
        )
        .filter(F.col("docs") >= min_docs)
    )
    zero = F.lit(0).cast("long")
    wide = kept.join(broadcast_small(named), "lang").select(
        "lang", "term", "total", F.transform("sources", lambda s: F.coalesce(F.col("by")[s], zero)).alias("counts")
    )
    wide = stash(wide, "vectors")
    by_source = wide.select("lang", F.posexplode("counts").alias("i", "n")).groupBy("lang", "i").agg(F.sum("n").alias("n"))
    sums = by_source.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("i", "n"))).alias("by"))
    kinds = wide.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("total"))
    n = F.coalesce(F.transform("by", lambda x: x["n"]), F.transform("sources", lambda _: zero))
    groups = named.join(sums, "lang", "left").join(kinds, "lang", "left").select(
        "lang", "sources", n.alias("n"), F.coalesce("total", zero).alias("total"), F.coalesce("v", zero).alias("v")
    )
    absent = F.when(F.col("v") > 0, F.transform("n", lambda m: share(zero, m, F.col("v"))))
    return wide, stash(groups.withColumn("absent", absent), "source-sums")


def _joined(wide: DataFrame, groups: DataFrame) -> DataFrame:
    """Vectors with p (each source's share), absent, the language's q, and held (indices of sources with the term)."""
    about = groups.select("lang", "sources", "n", "absent", "v", F.col("total").alias("all"))
    each = wide.join(broadcast_small(about), "lang")
    p = F.transform(
        "counts",
        lambda c, i: F.when(c > 0, share(c, F.get("n", i), F.col("v"))).otherwise(F.get("absent", i)),
    )
    held = F.filter(F.sequence(F.lit(0), F.size("counts") - 1), lambda i: F.get("counts", i) > 0)
    q = share(F.col("total"), F.col("all"), F.col("v"))
    return each.select("lang", "term", "counts", "sources", "absent", p.alias("p"), q.alias("q"), held.alias("held"))


def pair_sums(wide: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item (another source of the language) and value: the pair's distance over all kept terms."""
    places = F.sequence(F.lit(0), F.size("p") - 1)
    each = _joined(wide, groups).withColumn("lacking", F.filter(places, lambda j: F.get("counts", j) == 0))
    pair = lambda i, j: F.struct(
        i.alias("i"), j.alias("j"), F.get("p", i).alias("p"), F.get("p", j).alias("q")
    )
    of = lambda i: F.concat(
        F.transform(F.slice(places, i + 2, F.size("p")), lambda j: pair(i, j)),
        F.transform(F.filter("lacking", lambda j: j < i), lambda j: pair(j, i)),
    )
    emitted = each.select("lang", F.explode(F.flatten(F.transform("held", of))).alias("x"))
    sums = emitted.groupBy("lang", "x.i", "x.j").agg(
        F.sum(distance(F.col("x.p"), F.col("x.q"))).alias("f"), F.count(F.lit(1)).alias("n")
    )
    rows = groups.select("*", F.posexplode("sources").alias("a", "source"))
    base = lambda b: distance(F.get("absent", "a"), F.get("absent", b))
    item = lambda item, b: F.struct(item.alias("item"), b.alias("b"), base(b).alias("base"))
    pairs = rows.select("lang", "source", "a", "v", F.explode(F.transform("sources", item)).alias("x")).filter("a <> x.b")
    i, j = F.least("a", "x.b").alias("i"), F.greatest("a", "x.b").alias("j")
    keyed = pairs.select("lang", "source", "x.item", "v", i, j, "x.base")
    zero = F.lit(0)
    value = F.coalesce("f", zero) + F.coalesce((F.col("v") - F.coalesce("n", zero)) * F.col("base"), zero)
    return keyed.join(sums, ["lang", "i", "j"], "left").select("lang", "source", "item", value.alias("value"))


def term_values(wide: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item (a kept term that the source has, with a larger share than its language) and value."""
    at = lambda i: F.struct(F.get("sources", i).alias("source"), F.get("p", i).alias("p"))
    each = _joined(wide, groups).select("lang", "term", "q", F.explode(F.transform("held", at)).alias("x"))
    value = distance(F.col("x.p"), F.col("q"))
    return each.filter("x.p > q").select("lang", "x.source", F.col("term").alias("item"), value.alias("value"))


def audit(
    docs: DataFrame,
    *,
    min_docs: int = 10,
    top_terms: int = 10,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
) -> DataFrame:
    """lang, source, part, item, value and rank: each source's distance to others, and the terms that set it apart.

    Part ``pair`` has all other sources of the language, part ``term`` up to ``top_terms`` kept terms; ranks go by value
    descending, then item in order of UTF-8.  Null texts, languages and sources count as empty; groups without terms, and
    languages without kept terms (whose pairs have value 0), appear with their pairs; a language of one source has no
    pairs.  Repeated rows count as documents each; very long texts are read whole; other columns are ignored, whatever
    their names.  Arithmetic is exact.  An empty table gives no row.
    """
    wide, groups = vectors(docs, min_docs=min_docs, text_col=text_col, lang_col=lang_col, source_col=source_col)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")

    def part(name: str, rows: DataFrame) -> DataFrame:
        ranked = rows.withColumn("rank", F.row_number().over(order))
        return ranked.select("lang", "source", F.lit(name).alias("part"), "item", "value", "rank")

    terms = part("term", term_values(wide, groups)).filter(F.col("rank") <= top_terms)
    return part("pair", pair_sums(wide, groups)).union(terms)


def sql(min_docs: int = 10, top_terms: int = 10) -> str:
    """DuckDB SQL of ``op12_source_divergence``."""
    share = "(1 + 1000000000::hugeint * ({c} + 2) // ({n} + 2 * {v}))::bigint"
    f = "(({p} - {q}) * ({p} - {q}) // ({p} + {q}))"
    order = "row_number() over (partition by lang, source order by value desc, encode(item))"
    return rf"""
with d as (select coalesce(lang, '') lang, coalesce(source, '') source,
  regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}') ts, row_number() over () r from documents),
t as (select lang, source, r, unnest(ts) term from d),
k as (select lang, term, count(*) total from t group by lang, term having count(distinct r) >= {min_docs}),
c as (select lang, source, term, count(*) c from t join k using (lang, term) group by lang, source, term),
g as (select distinct lang, source from d),
v as (select lang, count(*) v, sum(total) n from k group by lang),
n as (select lang, source, sum(c) n from c group by lang, source),
p as (select g.lang, g.source, k.term, coalesce(c.c, 0) c, {share.format(c="coalesce(c.c, 0)", n="coalesce(n.n, 0)", v="v.v")} p
      from g join k on g.lang = k.lang join v on v.lang = g.lang left join n on n.lang = g.lang and n.source = g.source
      left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
q as (select lang, term, {share.format(c="total", n="v.n", v="v.v")} q from k join v using (lang)),
pairs as (select a.lang, a.source, b.source item, sum({f.format(p="a.p", q="b.p")})::bigint value
          from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
every as (select a.lang, a.source, b.source item, coalesce(value, 0)::bigint value from g a join g b on a.lang = b.lang and a.source <> b.source
          left join pairs on pairs.lang = a.lang and pairs.source = a.source and pairs.item = b.source),
terms as (select lang, source, term item, {f.format(p="p", q="q")} value from p join q using (lang, term) where c > 0 and p > q)
select lang, source, 'pair' part, item, value, {order}::int rank from every
union all select * from (select lang, source, 'term', item, value, {order}::int rank from terms) where rank <= {top_terms}"""
