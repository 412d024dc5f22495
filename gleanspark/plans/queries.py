"""Named queries over the driver's tables, and the same results in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanspark.functions import text as X
from gleanspark.operators import losses as arrays
from gleanspark.operators import ml, ngram, ranking, sequences, shingles, summaries
from gleanspark.operators.moments import vocabulary_moments as word_moments
from gleanspark.operators.running import quantiles
from gleanspark.sources import tables as sources

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def r6(c, name: str):
    return F.round(c, 6).alias(name)


def or_0(c):
    """Rounded; 0 for texts of too few tokens for a score."""
    return F.coalesce(F.round(c, 6), F.lit(0.0))


# Texts and row filters

W = r"regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+')"
NORM = r"trim(regexp_replace(lower(text), '\s+', ' ', 'g'))"


@query(f"select doc_id, sha256({NORM}) norm_sha from documents")
def normalize_text(s, d):
    return table(s, d, "documents").select("doc_id", F.sha2(X.normalize(F.col("text")), 256).alias("norm_sha"))


@query(
    "select doc_id, cast(length(left(text, 6000)) as bigint) n_kept from documents where length(text) > 50 and "
    "length(text) >= 180"
)
def doc_length_gate(s, d):
    return table(s, d, "documents").filter((F.length("text") > 50) & (F.length("text") >= 180)).select(
        "doc_id", F.length(F.left("text", F.lit(6000))).cast("long").alias("n_kept")
    )


@query("select doc_id, substr(text, 101, 260) excerpt from documents where length(text) >= 400")
def excerpt_cut(s, d):
    return table(s, d, "documents").filter(F.length("text") >= 400).select(
        "doc_id", F.substring("text", 101, 260).alias("excerpt")
    )


@query("select doc_id, case when length(text) > 200 then left(text, 200) || '…' else text end preview from documents")
def text_preview(s, d):
    return table(s, d, "documents").select("doc_id", X.preview(F.col("text")).alias("preview"))


@query(
    "select conv_id, string_agg(coalesce(text, ''), chr(10) order by turn, text) flat from conversations group by "
    "conv_id"
)
def flatten_messages(s, d):
    turns = F.sort_array(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("t"))))
    return table(s, d, "conversations").groupBy("conv_id").agg(F.array_join(turns["t"], "\n").alias("flat"))


@query(
    "select event_type, count(*) n from events where coalesce(try_cast(substr(cast(ts as varchar), 1, 10) as date) >= "
    "date '2024-01-10', true) group by event_type"
)
def date_filter(s, d):
    return table(s, d, "events").filter(
        X.on_or_after(F.col("ts").cast("string"), "2024-01-10")
    ).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("select doc_id from documents where lower(coalesce(lang, '')) = lower('EN')")
def case_insensitive_filter(s, d):
    return table(s, d, "documents").filter(F.lower(F.coalesce("lang", F.lit(""))) == "EN".lower()).select("doc_id")


@query("select doc_id from (select * from documents order by doc_id limit 300) where length(text) > 50")
def corpus_cap(s, d):
    from gleanspark.sources.tables import read_corpus

    return read_corpus(table(s, d, "documents"), "doc_id", 300).select("doc_id")


@query(
    "select stream, count(*) n, cast(sum(length(text)) as bigint) chars from ((select 'documents' stream, text from "
    "documents order by doc_id limit 200) union all (select 'benchmark', text from benchmark order by item_id limit "
    "20)) group by stream"
)
def stream_union_cap(s, d):
    a = table(s, d, "documents").orderBy("doc_id").limit(200).select(F.lit("documents").alias("stream"), "text")
    b = table(s, d, "benchmark").orderBy("item_id").limit(20).select(F.lit("benchmark").alias("stream"), "text")
    return a.unionByName(b).groupBy("stream").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).cast("long").alias("chars")
    )


@query(
    "with p as (select item_id i, b.text member, d.text nonmember from benchmark b join documents d on item_id = "
    "doc_id) select i, sha256(member) text_sha, 1 as label from p union all select i, sha256(nonmember), 0 from p"
)
def unpivot_pairs(s, d):
    from gleanspark.sources.tables import pairs

    both = table(s, d, "benchmark").select(F.col("item_id").alias("i"), F.col("text").alias("member")).join(
        table(s, d, "documents").select(F.col("doc_id").alias("i"), F.col("text").alias("nonmember")), "i"
    )
    return pairs(both).select("i", F.sha2("text", 256).alias("text_sha"), "label")


# Shingles

_BENCH = (
    f"nb as (select item_id, {NORM} n from benchmark), bs as (select item_id, p, substr(n, p, {{k}}) g from (select "
    f"item_id, n, unnest(range(1, greatest(length(n) - {{k}} + 2, 1))) p from nb) union all select item_id, 1, n from "
    f"nb where length(n) < {{k}} and n <> '')"
)
_COVER = (
    f"{_BENCH.format(k=50)}, idx as (select distinct g from bs), nd as (select doc_id, source, {NORM} n from "
    f"documents), ds as (select doc_id, p, substr(n, p, 50) g from (select doc_id, n, unnest(range(1, "
    f"greatest(length(n) - 48, 1))) p from nd)), hit as (select doc_id, p - row_number() over (partition by doc_id "
    f"order by p) r from ds where g in (select g from idx)), pos as (select distinct doc_id from (select doc_id, r "
    f"from hit group by all having count(*) >= 51) union select doc_id from ds join nd using (doc_id) where length(n) < "
    f"100 and g in (select g from idx) union select doc_id from nd where length(n) < 50 and n <> '' and n in (select g "
    f"from idx)), cov as (select nd.doc_id, source, cast(pos.doc_id is not null as "
    f"int) label from nd left join pos using (doc_id))"
)


@query(f"with {_BENCH.format(k=50)} select distinct substr(sha256(g), 1, 16) hash from bs")
def shingle_index(s, d):
    return shingles.build_index(table(s, d, "benchmark"), "item_id", 50)


@query(
    f"with {_BENCH.format(k=50)}, f as (select substr(sha256(g), 1, 16) hash, min((item_id, p)) o from bs group by 1) "
    f"select hash from f order by o, hash limit 1000"
)
def capped_index(s, d):
    return shingles.capped_index(table(s, d, "benchmark"), "item_id", 50, 1000)


def _coverage(s, d, **kw):
    size, match = kw.pop("size", 50), kw.pop("match", 100)
    return shingles.coverage_label(
        table(s, d, "documents"),
        shingles.build_index(table(s, d, "benchmark"), "item_id", size),
        "doc_id",
        size,
        match,
        **kw,
    )


@query(f"with {_COVER} select doc_id, label from cov")
def coverage_label(s, d):
    return _coverage(s, d)


@query(
    f"with {_BENCH.format(k=200)}, nd as (select doc_id, {NORM} n from documents) select doc_id, cast(case when "
    f"length(n) >= 150 then 1 when n = '' then 0 else (n in (select g from bs))::int end as int) label from nd"
)
def coverage_label_compat(s, d):
    return _coverage(s, d, size=200, match=150, compat=True)


@query(f"with {_COVER} select doc_id, case source when 'src0' then 1 when 'src1' then 0 else label end label from cov")
def source_rule_label(s, d):
    rows = table(s, d, "documents").select("doc_id", "source").join(_coverage(s, d), "doc_id")
    return rows.select(
        "doc_id",
        F.when(F.col("source") == "src0", 1).when(
            F.col("source") == "src1", 0
        ).otherwise(F.col("label")).alias("label"),
    )


# Token losses

_LOSS = (
    f"tk as (select doc_id id, unnest({W}) tok, unnest(range(0, len({W}))) pos from documents), u as (select tok, "
    f"count(*) c from tk group by tok), sm as (select sum(c) n, count(*) v from u), tp as (select *, lag(tok) over "
    f"(partition by id order by pos) prev from tk), pr as (select prev, tok, count(*) cc from tp where pos > 0 group "
    f"by all), ah as (select prev, sum(cc) cp from pr group by prev), ls as (select id, pos, -ln(cast(c + 1 as "
    f"double) / (n + v)) uni, -ln(cast(0.7 as double) * cc / cp + cast(0.3 as double) * (c + 1) / (n + v)) bi from tp "
    f"join pr using (prev, tok) join u using (tok) join ah using (prev), sm where pos > 0)"
)


def losses(s, d):
    """id, uni and bi (arrays) of every document."""
    return arrays.loss_arrays(table(s, d, "documents"))


def _all(s, d, scores, **fill):
    """Scores (by id) as rows of all documents; texts of too few tokens take the values of ``fill``."""
    return ngram.of_all_texts(table(s, d, "documents"), scores, fill).withColumnRenamed("id", "doc_id")


def _of_all(select: str, inner: str) -> str:
    return f"with {_LOSS}, x as ({inner}) select doc_id, {select} from documents left join x on id = doc_id"


@query(_of_all("coalesce(nll, 0) nll", "select id, round(avg(uni), 6) nll from ls group by id"))
def unigram_nll(s, d):
    means = arrays.unigram_means(table(s, d, "documents"))
    return means.select(F.col("id").alias("doc_id"), or_0(F.col("nll")).alias("nll"))


@query(
    _of_all(
        "coalesce(nll, 0) nll, coalesce(n_losses, 0) n_losses",
        "select id, round(avg(bi), 6) nll, count(*) n_losses from ls group by id",
    )
)
def bigram_nll(s, d):
    return losses(s, d).select(
        F.col("id").alias("doc_id"),
        or_0(arrays.mean(F.col("bi"))).alias("nll"),
        F.size("bi").cast("long").alias("n_losses"),
    )


@query(
    f"with {_LOSS} select id doc_id, round(avg(bi), 6) mean_nll, round(sum(bi), 4) total_nll from ls where pos >= 32 "
    f"group by id"
)
def suffix_nll(s, d):
    """Losses of what follows the first 32 tokens, for the texts that have more (the others have no suffix)."""
    rest = losses(s, d).filter(F.size("bi") >= 32).select("id", F.slice("bi", F.lit(32), F.size("bi")).alias("a"))
    return rest.select(
        F.col("id").alias("doc_id"), r6(arrays.mean(F.col("a")), "mean_nll"), F.round(X.total(F.col("a")), 4).alias("total_nll")
    )


@query(
    _of_all(
        "round(t, 4) perplexity, round(ln(t + 1e-8) / ln(r + 1e-8), 6) small",
        "select id, exp(avg(bi)) t, exp(avg(uni)) r from ls group by id",
    )
)
def perplexity_metrics(s, d):
    """Null for texts without losses."""
    p = losses(s, d).select("id", *(F.exp(arrays.mean(F.col(c))).alias(n) for c, n in (("bi", "t"), ("uni", "r"))))
    return p.select(
        F.col("id").alias("doc_id"), F.round("t", 4).alias("perplexity"), r6(X.log_ratio(F.col("t"), F.col("r")), "small")
    )


_WC = W.replace("lower(text)", "text")
_CASED = f"""ck as (select doc_id id, unnest({_WC}) tok, unnest(range(0, len({_WC}))) pos from documents),
cu as (select tok, count(*) c from ck group by tok), cs as (select sum(c) n, count(*) v from cu),
lo as (select id, avg(-ln(cast(c + 1 as double) / (n + v))) o from ck join cu using (tok), cs where pos > 0 group by id),
ll as (select id, avg(-ln(cast(coalesce(c, 0) + 1 as double) / (n + v))) l from ck left join cu on cu.tok = lower(ck.tok), cs where pos > 0 group by id)"""


@query(
    f"with {_CASED} select doc_id, round(case when l > 0 then o / l else 0 end, 6) ratio, round(ln(exp(o) + 1e-8) / "
    f"ln(exp(l) + 1e-8), 6) log_ratio from documents left join lo on lo.id = doc_id left join ll on ll.id = doc_id"
)
def lowercase_ratio(s, d):
    """Mean loss of a text over that of its lower-cased form under one model of words in their own case, 0 where the
    latter is 0; and the logarithms' ratio of both perplexities."""
    o, low = F.col("own"), F.col("low")
    return arrays.cased_means(table(s, d, "documents")).select(
        F.col("id").alias("doc_id"),
        F.round(F.when(low > 0, o / low).otherwise(0.0), 6).alias("ratio"),
        r6(X.log_ratio(F.exp(o), F.exp(low)), "log_ratio"),
    )


@query()
def zlib_len(s, d):
    return table(s, d, "documents").select("doc_id", ml.zlib_length("text").alias("zlib_bytes"))


@query(
    f"with {_LOSS}, m as (select id, bi, avg(bi) over (partition by id order by pos rows between 31 preceding and "
    f"current row) m, row_number() over (partition by id order by pos) r from ls), x as (select id, round(-case when "
    f"max(r) >= 32 then min(m) filter (where r >= 32) else avg(bi) end, 6) score from m group by id) select doc_id, "
    f"coalesce(score, 0) score from documents left join x on id = doc_id"
)
def window_min(s, d):
    return losses(s, d).select(F.col("id").alias("doc_id"), or_0(arrays.minimum(32)).alias("score"))


@query(
    f"with {_LOSS}, m as (select id, uni, avg(uni) over (partition by id order by pos rows between current row and 31 "
    f"following) m, row_number() over (partition by id order by pos) r, count(*) over (partition by id) n from ls) "
    f"select id doc_id, round(exp(case when max(n) < 32 then avg(uni) else coalesce(min(m) filter (where r <= n - "
    f"32), 'inf'::double) end), 4) perplexity from m group by id"
)
def window_perplexity(s, d):
    return arrays.window_perplexity(losses(s, d), 32).select(
        F.col("id").alias("doc_id"), F.round("perplexity", 4).alias("perplexity")
    )


@query(
    f"select doc_id, cast(n as bigint) n_tokens, case when n between 1 and 20 then {list(X.DECAY)}[n] else 1 "
    f"end::double temperature from (select doc_id, coalesce(len({W}), 0) n from documents)"
)
def decayed_temperature(s, d):
    n = F.size(F.coalesce(X.tokens(F.col("text")), F.array()))
    return table(s, d, "documents").select(
        "doc_id", n.cast("long").alias("n_tokens"), X.decayed_temperature(n).alias("temperature")
    )


@query(
    "select page_id, cast(k as bigint) n, sha256(repeat(replace(coalesce(html, ''), chr(13) || chr(10), chr(10)) || "
    "chr(10), cast(k as int))) text_sha from pages, (select unnest([1, 3]) k)"
)
def wet_like_records(s, d):
    """Each page as an archive of four records: in English, in French, in English first, and one that is cut off."""
    body = F.concat(F.coalesce("html", F.lit("")), F.lit("\n"))
    record = lambda tag, k: F.concat(F.lit(f"WARC/1.0\nh1\nh2\nh3\nh4\nh5\nh6\nWARC-Identified-Content-Language: {tag}\nh8\n\n"), F.repeat(body, F.lit(k)))
    value = F.concat(record("eng", 1), record("fra", 2), record("eng,fra", 3), record("eng", 4))
    got = sources.web_text_split(table(s, d, "pages").select(F.col("page_id").alias("file"), value.alias("value")))
    return got.select(
        F.col("file").alias("page_id"), F.col("n").cast("long").alias("n"), F.sha2("text", 256).alias("text_sha")
    )


@query("select quality, toxic, count(*) n from labels group by quality, toxic")
def class_counts(s, d):
    return table(s, d, "labels").groupBy("quality", "toxic").agg(F.count(F.lit(1)).alias("n"))


_SIZES = (2, 3, 5, 8, 13)
_VOTES = ", ".join(
    f"sum(uni - bi) over (partition by id order by pos rows between {w - 1} preceding and current row) s{w}"
    for w in _SIZES
)
_SHARES = ", ".join(
    f"case when max(r) >= {w} then avg(case when s{w} > 0 then 1.0::double else 0 end) filter (where r >= {w}) end"
    for w in _SIZES
)


@query(
    f"with {_LOSS}, v as (select id, row_number() over (partition by id order by pos) r, {_VOTES} from ls), t as "
    f"(select id, list_filter([{_SHARES}], lambda x: x is not null) t from v group by id), x as (select id, "
    f"round(list_sum(t) / len(t), 6) score from t where len(t) > 0) select doc_id, coalesce(score, 0) score from "
    f"documents left join x on id = doc_id"
)
def wbc_score(s, d):
    """0 for texts of fewer than two losses."""
    return losses(s, d).select(F.col("id").alias("doc_id"), or_0(arrays.votes(_SIZES)).alias("score"))


@query(
    f"with {_LOSS}, o as (select id, bi, row_number() over (partition by id order by bi) r, count(*) over (partition "
    f"by id) n from ls) select id doc_id, round(avg(bi), 6) score from o where r <= greatest(1, floor(n * cast(0.2 as "
    f"double))) group by id"
)
def bottom_k_mean(s, d):
    a = losses(s, d).filter(F.size("bi") > 0).select(F.col("id").alias("doc_id"), F.col("bi").alias("a"))
    return a.select("doc_id", r6(X.bottom_k_mean(F.col("a"), 0.2), "score"))


_GREEDY = """uq as (select tok, cast(0.3 as double) * (c + 1) / (n + v) q, cast(c + 1 as double) / (n + v) u from u, sm),
b as (select sum(q * ln(q)) b1, sum(q * ln(q) * ln(q)) b2, sum(u * ln(u)) u1, sum(u * ln(u) * ln(u)) u2 from uq),
tt as (select tok t, q tq from uq order by q desc, tok limit 1),
mp as (select prev, tok, q, cast(0.7 as double) * cc / cp + q p from pr join uq using (tok) join ah using (prev)),
cx as (select prev h, b1 + sum(p * ln(p) - q * ln(q)) mu, b2 + sum(p * ln(p) * ln(p) - q * ln(q) * ln(q)) e2, max(p) bp, (array_agg(tok order by p desc, tok))[1] bt from mp, b group by prev, b1, b2),
hx as (select h, mu, sqrt(greatest(e2 - mu * mu, 0) + 1e-8) sd, case when tq > bp or (tq = bp and t < bt) then t else bt end star, greatest(bp, tq) sp from cx, tt),
zr as (select id, pos, star, (ln(p) - ln(sp)) / sd r0, lead(tok) over w nxt, lead((ln(p) - mu) / sd) over w z, count(*) over (partition by id) + 1 n from tp join mp using (prev, tok) join hx on h = prev where pos > 0 window w as (partition by id order by pos)),
rr as (select id, pos, n, r0 + coalesce(z - case when hx.h is null then (ln(uq.u) - u1) / sqrt(greatest(u2 - u1 * u1, 0) + 1e-8) else (ln(coalesce(mp.p, uq.q)) - mu) / sd end, 0) r from zr left join uq on uq.tok = nxt left join hx on hx.h = zr.star left join mp on mp.prev = zr.star and mp.tok = nxt, b),
kk as (select id, r, row_number() over (partition by id order by r, pos) k, count(*) over (partition by id) m from rr where {where}),
sr as (select id, avg(r) score from kk where k <= greatest(1, floor(m * cast(0.1 as double))) group by id)
select doc_id, round(coalesce(score, 0), 5) + 0.0::double score from documents left join sr on id = doc_id"""


@query(f"with {_LOSS}, " + _GREEDY.format(where="n >= 2"))
def infilling_score(s, d):
    """Standardized log-probability less that of the likeliest word, with the next place's difference; lowest tenth."""
    return arrays.infilling_mean(arrays.infilling_arrays(table(s, d, "documents"))).select(
        F.col("id").alias("doc_id"), (F.round("score", 5) + F.lit(0.0)).alias("score")
    )


@query(f"with {_LOSS}, " + _GREEDY.format(where="n >= 4 and pos > n - 64"))
def prefix_infilling(s, d):
    """The same over the last 64 tokens; 0 below four."""
    return arrays.infilling_mean(arrays.infilling_arrays(table(s, d, "documents")), last=64, least=4).select(
        F.col("id").alias("doc_id"), (F.round("score", 5) + F.lit(0.0)).alias("score")
    )


@query(
    f"with {_LOSS}, "
    + _GREEDY.split("zr as (")[0].rstrip().rstrip(",")
    + " select h prev, round(mu, 6) mean, round(sd, 6) sd from hx"
)
def vocabulary_moments(s, d):
    """Mean and deviation of the log-probability over the vocabulary after each word."""
    return word_moments(table(s, d, "documents")).select("prev", r6("mean", "mean"), r6("sd", "sd"))


@query(
    f"select doc_id, cast(n as bigint) input_tokens, cast(greatest(n - 1, 0) as bigint) nll_len, n - 1 < 2 short from "
    f"(select doc_id, coalesce(len({W}), 0) n from documents)"
)
def wbc_diagnostics(s, d):
    return ngram.vote_diagnostics(table(s, d, "documents")).withColumnRenamed("id", "doc_id")


# Rankings over two exact scores: distinct words per word, and characters per word

_SC = (
    f"sc as (select doc_id i, source, lang, len(w) n, cast(len(list_distinct(w)) as double) / len(w) ttr, "
    f"cast(length(array_to_string(w, '')) as double) / len(w) wlen from (select *, {W} w from documents) where len(w) "
    f"> 0), lb as (select sc.*, quality label, toxic from sc join labels on doc_id = i), lg as (unpivot (select i, "
    f"source, lang, label, toxic, ttr, wlen from lb) on ttr, wlen into name metric value score)"
)


def scores(s, d):
    w = table(s, d, "documents").select(
        F.col("doc_id").alias("i"), "source", "lang", X.tokens(F.col("text")).alias("w")
    ).filter(F.size("w") > 0)
    return w.select(
        "i",
        "source",
        "lang",
        (F.size(F.array_distinct("w")) / F.size("w")).alias("ttr"),
        (F.length(F.array_join("w", "")) / F.size("w")).alias("wlen"),
    )


def labelled(s, d):
    lab = table(s, d, "labels").select(F.col("doc_id").alias("i"), F.col("quality").alias("label"), "toxic")
    return scores(s, d).join(lab, "i")


def long(s, d):
    return ranking.unpivot(labelled(s, d), ["i", "source", "lang", "label", "toxic"], ["ttr", "wlen"])


_KS = (10, 50, 100)
_PK = (
    "select {by} k, avg(label) \"precision\", n from (select {by} label, row_number() over (partition by {pb} order "
    "by score, i) r, count(*) over (partition by {pb}) n from {t}), (select unnest([10, 50, 100]) k) where r <= k and "
    "k <= n group by {by} k, n"
)


@query(f"with {_SC} " + _PK.format(by="metric,", pb="metric", t="lg"))
def precision_at_k(s, d):
    return ranking.precision_at_k(long(s, d), ["metric"], _KS)


_ODD = "case when i % 11 = 0 then 'nan'::double when i % 13 = 0 then 'inf'::double else score end"


def _report_sql(rows: str, by: str, finite: bool, expected: str = "") -> str:
    """Rows (by, i, score, label) as the report that ``ranking.precision_report`` gives."""
    ok = "not isnan(score) and not isinf(score)"
    same = " and ".join(f"{{a}}.{b} is not distinct from {{b}}.{b}" for b in by.split(", "))
    on = lambda a, b: same.format(a=a, b=b)
    bad = "fin = 0" if finite else "fin = 0 or labeled = 0"
    word = "no finite scores" if finite else "no valid scores or labels"
    keys = ", ".join(f"x.{b}" for b in by.split(", "))
    return f"""rw as ({rows}), us as (select * from rw {f"where {ok}" if finite else ""}),
rk as (select *, row_number() over (partition by {by} order by score, i) r from us),
tt as (select {by}, count(*) al, count(*) filter (where {ok}) fin from rw group by {by}),
uc as (select {by}, count(*) used, count(label) labeled, count(*) filter (where label = 1) pos from us group by {by}),
pk as (select {by}, k, case when count(label) = k then sum(label)::double / k end p from rk, (select unnest([10, 50, 100]) k) where r <= k group by {by}, k),
ex as ({expected or f"select {by} from tt"}),
rp as (select {keys}, kk.k, case when al is null then 'no samples' when {bad} then '{word}' else 'ok' end status, p, cast(coalesce(used, al, 0) as bigint) n_samples, cast(coalesce(labeled, 0) as bigint) n_labeled, cast(coalesce(pos, 0) as bigint) n_positive
from ex x cross join (select unnest([10, 50, 100]) k) kk left join tt on {on("x", "tt")} left join uc on {on("x", "uc")} left join pk on {on("x", "pk")} and pk.k = kk.k)
select * exclude (p), n_labeled - n_positive n_negative, case when status = 'ok' then p end "precision" from rp"""


@query(f"with {_SC}, " + _report_sql(f"select metric, source, i, {_ODD} score, label from lg", "metric, source", True))
def precision_by_source(s, d):
    """Within each source, finite scores only (every 11th score is made NaN, every 13th infinite)."""
    odd = F.when(F.col("i") % 11 == 0, float("nan")).when(F.col("i") % 13 == 0, float("inf")).otherwise(F.col("score"))
    return ranking.precision_report(long(s, d).withColumn("score", odd), ["metric", "source"], _KS, finite_only=True)


@query(
    f"with {_SC}, al as (unpivot (select i, source, ttr, wlen from sc) on ttr, wlen into name metric value score), "
    + _report_sql(
        f"select metric, source, al.i, {_ODD.replace('i %', 'al.i %')} score, quality label from al left join labels "
        f"on doc_id = al.i",
        "metric, source",
        False,
        "select metric, source from (select unnest(['ttr', 'wlen']) metric), (select unnest(['src0', 'src1', 'src2', "
        "'src3', 'none']) source)",
    )
)
def precision_by_method(s, d):
    """Within each expected source, NaN scores and unlabelled rows kept; null where k exceeds the source."""
    lab = table(s, d, "labels").select(F.col("doc_id").alias("i"), F.col("quality").alias("label"))
    rows = ranking.unpivot(scores(s, d), ["i", "source"], ["ttr", "wlen"]).join(lab, "i", "left")
    odd = F.when(F.col("i") % 11 == 0, float("nan")).when(F.col("i") % 13 == 0, float("inf")).otherwise(F.col("score"))
    sources_ = ("src0", "src1", "src2", "src3", "none")
    expected = s.createDataFrame([(m, x) for m in ("ttr", "wlen") for x in sources_], "metric string, source string")
    return ranking.precision_report(rows.withColumn("score", odd), ["metric", "source"], _KS, expected=expected)


_MATRIX = (
    "mx as (select i, metric, score, 'quality' kind, label from lg union all select i, metric, score, 'toxic', toxic "
    "from lg)"
)


@query(f"with {_SC}, {_MATRIX} " + _PK.format(by="metric, kind,", pb="metric, kind", t="mx"))
def precision_matrix(s, d):
    both = long(s, d).select(
        "i", "metric", "score", F.expr("stack(2, 'quality', label, 'toxic', toxic) as (kind, label)")
    )
    return ranking.precision_at_k(both, ["metric", "kind"], _KS)


@query(
    f"with {_SC}, pk as ({_PK.format(by='metric,', pb='metric', t='lg')}) select metric, max(printf('%.2f', "
    f"\"precision\")) filter (where k = 10) p_10, max(printf('%.2f', \"precision\")) filter (where k = 50) p_50, "
    f"max(printf('%.2f', \"precision\")) filter (where k = 100) p_100 from pk group by metric"
)
def precision_wide(s, d):
    pk = ranking.precision_at_k(long(s, d), ["metric"], _KS)
    return pk.groupBy("metric").pivot("k", list(_KS)).agg(F.first(F.format_string("%.2f", "precision"))).select(
        "metric", *(F.col(str(k)).alias(f"p_{k}") for k in _KS)
    )


@query(
    "with f as (select lang, count(distinct source) filter (where source in ('src0', 'src1', 'src2')) a, "
    "count(distinct source) filter (where source in ('src3', 'src4', 'src5')) b from documents group by lang) select "
    "lang, case when a >= b then 'decoding' else 'sampling' end family from f"
)
def source_family(s, d):
    among = lambda *x: F.count_distinct(F.when(F.col("source").isin(*x), F.col("source")))
    got = table(s, d, "documents").groupBy("lang").agg(
        among("src0", "src1", "src2").alias("a"), among("src3", "src4", "src5").alias("b")
    )
    return got.select("lang", F.when(F.col("a") >= F.col("b"), "decoding").otherwise("sampling").alias("family"))


_AUC = (
    "au as (select metric, sum(label) p, sum(1 - label) q, sum(case when label = 1 then rk end) rs from (select "
    "metric, label, rank() over (partition by metric order by score) + (count(*) over (partition by metric, score) - "
    "1) / 2.0::double rk from lg) group by metric)"
)


@query(
    f"with {_SC}, {_AUC}, v as (select metric, (rs - p * (p + 1) / 2.0::double) / (p * q) auc, p, q from au) select "
    f"metric, round(auc, 9) auc, round(greatest(auc, 1 - auc), 9) auc_dir, cast(p as bigint) n_pos, cast(q as bigint) "
    f"n_neg from v"
)
def roc_auc(s, d):
    got = ranking.roc_auc(long(s, d), ["metric"])
    return got.select(
        "metric", F.round("auc", 9).alias("auc"), F.round("auc_dir", 9).alias("auc_dir"), "n_pos", "n_neg"
    )


_VAL = "case when i % 2 = 0 then 'val' else 'test' end"


@query(
    f"with {_SC}, o as (select *, {_VAL} split from lg), v as (select metric, label, rank() over (partition by metric "
    f"order by score) + (count(*) over (partition by metric, score) - 1) / 2.0::double rk from o where split = "
    f"'val'), a as (select metric, (sum(case when label = 1 then rk end) - sum(label) * (sum(label) + 1) / "
    f"2.0::double) / (sum(label) * sum(1 - label)) auc from v group by metric) select i, o.metric, split, case when "
    f"auc < 0.5 then -score else score end score from o join a on o.metric = a.metric"
)
def oriented_scores(s, d):
    rows = long(s, d).withColumn("split", F.when(F.col("i") % 2 == 0, "val").otherwise("test"))
    return ranking.oriented(rows, ["metric"]).select("i", "metric", "split", "score")


@query(
    f"with {_SC}, rk as (select "
    f"{', '.join(f'rank() over (order by {c}) + (count(*) over (partition by {c}) - 1) / 2.0::double {c}' for c in ('ttr', 'wlen', 'n'))} from sc) select 'ttr' a, 'wlen' b, round(corr(ttr, wlen), 9) rho from rk"
)
def spearman_matrix(s, d):
    return ranking.spearman(scores(s, d), ["ttr", "wlen"]).select("a", "b", F.round("rho", 9).alias("rho"))


@query(
    f"with {_SC}, m as (select i, wlen score, cast(ttr > (select quantile_cont(ttr, 0.5) from sc) as int) label from "
    f"sc), r as (select label, rank() over (order by score) + (count(*) over (partition by score) - 1) / 2.0::double "
    f"rk from m) select round((sum(case when label = 1 then rk end) - sum(label) * (sum(label) + 1) / 2.0::double) / "
    f"(sum(label) * sum(1 - label)), 9) auc from r"
)
def auc_vs_median(s, d):
    rows = ranking.median_label(scores(s, d).select("i", F.col("ttr").alias("score"), "wlen"), [])
    return ranking.roc_auc(rows, [], score="wlen").select(F.round("auc", 9).alias("auc"))


@query(
    f"with {_SC}, c as (select metric, score, sum(label) p, sum(1 - label) q from lg group by all), w as (select "
    f"metric, (score + lead(score) over o) / 2 t, sum(p) over o pl, sum(q) over o ql, sum(p) over (partition by "
    f"metric) pt, sum(q) over (partition by metric) qt from c window o as (partition by metric order by score)), b as "
    f"(select metric, t, round((ql::double / qt + (pt - pl)::double / pt) / 2, 12) ba from w where t is not null) "
    f"select metric, t threshold, ba balanced_accuracy from b qualify row_number() over (partition by metric order by "
    f"ba desc, t) = 1"
)
def best_threshold(s, d):
    return ranking.best_threshold(long(s, d), ["metric"])


@query(
    f"with {_SC} select metric, round(min(score) - 1e-9, 9) low, round(max(score) + 1e-9, 9) high, "
    f"round((quantile_cont(score, 0.5) filter (where label = 0) + quantile_cont(score, 0.5) filter (where label = 1)) "
    f"/ 2, 9) midpoint from lg group by metric"
)
def fallback_threshold(s, d):
    rows = long(s, d)
    ends = rows.groupBy("metric").agg(
        F.round(F.min("score") - 1e-9, 9).alias("low"), F.round(F.max("score") + 1e-9, 9).alias("high")
    )
    return ends.join(
        ranking.class_medians(rows, ["metric"]).select("metric", F.round("midpoint", 9).alias("midpoint")), "metric"
    )


@query("select event_id, cast(value > 50 as int) label from events")
def threshold_label(s, d):
    return table(s, d, "events").select("event_id", ranking.threshold_label(F.col("value"), F.lit(50.0)).alias("label"))


@query(
    "select event_id, cast(value > quantile_cont(value, 0.5) over (partition by event_type) as int) label from events"
)
def median_label(s, d):
    return ranking.median_label(table(s, d, "events"), ["event_type"], score="value").select("event_id", "label")


# Summaries

@query(
    "select event_type, round(avg(value), 6) mean, round(sum(value), 3) sum, round(stddev_pop(value), 6) std, "
    "min(value) min, max(value) max from events group by event_type"
)
def five_stats(s, d):
    got = table(s, d, "events").groupBy("event_type").agg(*summaries.five_stats("value"))
    return got.select("event_type", r6("mean", "mean"), F.round("sum", 3).alias("sum"), r6("std", "std"), "min", "max")


@query(
    "select event_type, count(*) n, round(avg(value), 6) mean, round(stddev_pop(value), 6) std, min(value) min, "
    "max(value) max, "
    + ", ".join(f"round(quantile_cont(value, {p}), 6) p{round(p * 100)}" for p in summaries.PARTS)
    + " from events group by rollup(event_type)"
)
def dist_summary(s, d):
    got = summaries.dist_summary(table(s, d, "events"), "value", "event_type")
    return got.select(
        "event_type",
        "n",
        r6("mean", "mean"),
        r6("std", "std"),
        "min",
        "max",
        *(r6(f"p{round(p * 100)}", f"p{round(p * 100)}") for p in summaries.PARTS),
    )


@query(
    "with e as (select event_type, floor(value / 40) z, user_id % 7 = 0 short from events) select event_type, "
    "count(*) n, cast(count_if(z = 0) as bigint) zero, round(count_if(z = 0)::double / count(*), 9) zero_share, "
    "cast(count_if(short) as bigint) short, cast(count_if(z = 0 and short) as bigint) zero_short, cast(count_if(z = 0 "
    "and not short) as bigint) zero_long from e group by rollup(event_type)"
)
def zero_quantification(s, d):
    e = table(s, d, "events").withColumn("z", F.floor(F.col("value") / 40))
    return summaries.zero_quantification(
        e, "z", F.col("user_id") % 7 == 0, "event_type"
    ).withColumn("zero_share", F.round("zero_share", 9))


@query(
    f"with {_SC} select metric, quantile_cont(score, 0.5) filter (where label = 0) median_0, quantile_cont(score, "
    f"0.5) filter (where label = 1) median_1 from lg group by metric"
)
def calibration_block(s, d):
    return ranking.class_medians(long(s, d), ["metric"]).select("metric", "median_0", "median_1")


@query(
    "select source, count(*) n, count(distinct text) n_unique, count(*) - count(distinct text) n_dup, "
    "round(count(distinct text)::double / count(*), 9) unique_ratio from documents group by source"
)
def dup_stats(s, d):
    got = table(s, d, "documents").groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("text").alias("n_unique")
    )
    return got.select(
        "source",
        "n",
        "n_unique",
        (F.col("n") - F.col("n_unique")).alias("n_dup"),
        F.round(F.col("n_unique") / F.col("n"), 9).alias("unique_ratio"),
    )


@query(
    "with o as (select length(text) v, row_number() over (order by length(text)) - 1 r, count(*) over () n from "
    "documents) select p, v as value from o, (select unnest([0.5, 0.9, 0.99])::double p) where r = round_even((n - 1) "
    "* p, 0)"
)
def length_quantiles(s, d):
    return summaries.nearest_ranks(
        table(s, d, "documents").select(F.length("text").cast("long").alias("v")), "v", (0.5, 0.9, 0.99)
    )


@query(
    "select source, count(*) n, cast(sum(quality) as bigint) n_pos, round(avg(quality), 9) rate, "
    "round(avg(length(text)), 6) mean_chars, quantile_cont(length(text), 0.5) median_chars from documents join labels "
    "using (doc_id) group by source"
)
def source_label_summary(s, d):
    rows = table(s, d, "documents").join(table(s, d, "labels"), "doc_id").withColumn("chars", F.length("text"))
    medians = quantiles(rows, "chars", [0.5], ["source"]).select(
        F.col("source").alias("of"), F.col("q")[0].alias("median_chars")
    )
    got = rows.groupBy("source").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("quality").cast("long").alias("n_pos"),
        F.round(F.avg("quality"), 9).alias("rate"),
        r6(F.avg("chars"), "mean_chars"),
    )
    return got.join(medians, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")


@query("select l_returnflag, round(avg(abs(l_discount - l_tax)), 9) mean_abs_delta from lineitem group by l_returnflag")
def mean_abs_delta(s, d):
    return table(s, d, "lineitem").groupBy("l_returnflag").agg(
        F.round(F.avg(F.abs(F.col("l_discount") - F.col("l_tax"))), 9).alias("mean_abs_delta")
    )


_OV = (
    f"ov as (select doc_id, lang, list_slice(w, 1, 16) a, list_slice(w, 17, 32) b from (select doc_id, lang, {W} w "
    f"from documents) where len(w) >= 32), oo as (select doc_id, lang, len(list_filter(range(1, 17), lambda k: a[k] = "
    f"b[k])) same, coalesce(list_min(list_filter(range(1, 17), lambda k: a[k] <> b[k])) - 1, 16) lcp from ov)"
)


def _overlaps(s, d):
    w = table(s, d, "documents").select("doc_id", "lang", X.tokens(F.col("text")).alias("w")).filter(F.size("w") >= 32)
    w = w.select("doc_id", "lang", F.slice("w", 1, 16).alias("a"), F.slice("w", 17, 16).alias("b"))
    return w.select(
        "doc_id",
        "lang",
        sequences.overlap(F.col("a"), F.col("b")).alias("overlap"),
        sequences.common_prefix(F.col("a"), F.col("b")).cast("long").alias("lcp"),
    )


@query(
    f"with {_OV} select lang, round(avg(same / 16.0::double), 9) mean_overlap, round(avg(lcp), 9) mean_lcp, count(*) "
    f"n from oo group by lang"
)
def mode_summary(s, d):
    return _overlaps(s, d).groupBy("lang").agg(
        F.round(F.avg("overlap"), 9).alias("mean_overlap"),
        F.round(F.avg("lcp"), 9).alias("mean_lcp"),
        F.count(F.lit(1)).alias("n"),
    )


@query(f"with {_OV} select doc_id, same / 16.0::double overlap, cast(lcp as bigint) lcp from oo")
def overlap_lcp(s, d):
    return _overlaps(s, d).select("doc_id", "overlap", "lcp")


# Vectors

_EM = "em as (select vec_id, label, list_transform(embedding, lambda x: x::double) v from embeddings)"


@query(
    f"with {_EM}, a as (select vec_id, list_sort(list_filter(v, lambda x: x >= 0)) a from em) select vec_id, "
    + ", ".join(
        f"round(case when len(a) > 0 then {e} else 0 end, 6) {n}"
        for n,
        e in (
            ("mean", "list_avg(a)"),
            ("std", "list_stddev_pop(a)"),
            ("min", "a[1]"),
            ("max", "a[len(a)]"),
            ("median", "a[(len(a) - 1) // 2 + 1]"),
            ("p25", "list_aggregate(a, 'quantile_cont', 0.25)"),
            ("p75", "list_aggregate(a, 'quantile_cont', 0.75)"),
        )
    )
    + " from a"
)
def masked_stats(s, d):
    got = table(s, d, "embeddings").select("vec_id", *sequences.masked_stats(F.col("embedding"), 0.0))
    return got.select("vec_id", *(r6(c, c) for c in got.columns[1:]))


@query(
    f"with {_EM} select vec_id, cast(len(v) as int) dim, round(sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) "
    f"l2, round(list_avg(list_transform(v, lambda x: abs(x))), 6) mean_abs from em"
)
def feature_norms(s, d):
    got = table(s, d, "embeddings").select("vec_id", *sequences.feature_norms(F.col("embedding")))
    return got.select("vec_id", "dim", r6("l2", "l2"), r6("mean_abs", "mean_abs"))


@query(
    f"with {_EM} select a.vec_id a, b.vec_id b, round(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) "
    f"* sqrt(list_dot_product(b.v, b.v)) + 1e-8), 6) cosine from em a join em b on b.vec_id = a.vec_id + 1"
)
def cosine_pairs(s, d):
    e = table(s, d, "embeddings").select("vec_id", "embedding")
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("b"), F.col("embedding").alias("y"))
    return e.join(after, "vec_id").select(
        F.col("vec_id").alias("a"), "b", r6(X.cosine(F.col("embedding"), F.col("y")), "cosine")
    )


@query(
    f"with {_EM}, x as (select label, vec_id, unnest(v) x, unnest(range(0, len(v))) k from em), m as (select label, "
    f"vec_id, k, avg(x) over (partition by label, k order by vec_id) m from x), st as (select label, vec_id, m - "
    f"lag(m) over (partition by label, k order by vec_id) step from m) select label, vec_id, round(sqrt(sum(step * "
    f"step)), 6) change from st where step is not null group by label, vec_id"
)
def context_evolution(s, d):
    return sequences.context_evolution(
        table(s, d, "embeddings"), "label", "vec_id", "embedding"
    ).withColumn("change", F.round("change", 6))


@query(
    f"with {_EM}, p as (select label, vec_id, v, lag(v) over (partition by label order by vec_id) b from em) select "
    f"label, vec_id, round(list_distance(v, b), 6) distance, round(list_dot_product(v, b) / (sqrt(list_dot_product(v, "
    f"v)) * sqrt(list_dot_product(b, b)) + 1e-8), 6) cosine from p where b is not null"
)
def layer_transitions(s, d):
    got = sequences.transitions(table(s, d, "embeddings"), "label", "vec_id", "embedding")
    return got.select("label", "vec_id", r6("distance", "distance"), r6("cosine", "cosine"))


@query(
    f"with {_EM}, e as (select vec_id, v, list_transform(v, lambda x: exp(x - list_max(v))) e from em), p as (select "
    f"vec_id, v, list_transform(e, lambda x: x / list_sum(e)) p from e) select vec_id, "
    + ", ".join(
        f"round(len(list_filter(v, lambda x: {c}))::double / len(v), 6) {n}"
        for n,
        c in (
            ("sparsity", "abs(x) < 0.05::double"),
            ("utilization", "abs(x) > 0.05::double"),
            ("positive", "x > 0"),
            ("negative", "x < 0"),
        )
    )
    + ", round(list_max(list_transform(v, lambda x: abs(x))), 6) peak, round(-list_sum(list_transform(p, lambda x: x "
      "* ln(greatest(x, 1e-12::double)))), 5) entropy from p"
)
def activation_stats(s, d):
    got = table(s, d, "embeddings").select("vec_id", *sequences.activation_stats(F.col("embedding"), 0.05))
    return got.select("vec_id", *(r6(c, c) for c in got.columns[1:-1]), F.round("entropy", 5).alias("entropy"))


@query(
    f"with {_EM}, p as (select vec_id id, v[k] o, v[k + 8] h, v[k + 16] delta from em, (select unnest(range(1, 9)) "
    f"k)) select id, round(8.0::double * sum(o * h * delta), 6) score from p group by id"
)
def select_mc(s, d):
    v = lambda k: F.get("embedding", k).cast("double")
    p = table(s, d, "embeddings").select(
        F.col("vec_id").alias("id"), "embedding", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("k")
    )
    p = p.select("id", v(F.col("k")).alias("o"), v(F.col("k") + 8).alias("h"), v(F.col("k") + 16).alias("delta"))
    return sequences.select_mc(p, 8.0).withColumn("score", F.round("score", 6))


@query()
def rf_member_proba(s, d):
    rows = table(s, d, "embeddings").withColumn("label", (F.col("label") < 5).cast("double"))
    return ml.member_probability(
        ml.fit_forest(rows.filter("vec_id % 5 <> 0"), "embedding", "label"), rows, "embedding"
    ).select("vec_id", "p_member")


@query(
    f"with {_EM}, p as (select label, list_transform(list_slice(v, 1, 8), lambda x: exp(x) / "
    f"list_sum(list_transform(list_slice(v, 1, 8), lambda y: exp(y)))) p from em), s as (select label, "
    f"-list_sum(list_transform(p, lambda x: x * ln(x))) h, list_max(p) t, list_max(p) - list_sort(p, 'DESC')[2] m "
    f"from p) select label, round(avg(h), 6) entropy, round(avg(t), 6) top1, round(avg(m), 6) margin, round(avg(t) / "
    f"(stddev_pop(t) + 1e-8), 5) stability from s group by label"
)
def prediction_stats(s, d):
    p = X.softmax(F.transform(F.slice("embedding", 1, 8), lambda x: x.cast("double")))
    rows = table(s, d, "embeddings").select("label", p.alias("p")).select(
        "label", *sequences.prediction_stats(F.col("p"))
    )
    return rows.groupBy("label").agg(
        r6(F.avg("entropy"), "entropy"),
        r6(F.avg("top1"), "top1"),
        r6(F.avg("margin"), "margin"),
        F.round(sequences.stability("top1"), 5).alias("stability"),
    )


@query(
    f"with {_EM}, c as (select label, unnest(range(0, 64)) k, list_transform(v, lambda x: abs(x) / "
    f"list_sum(list_transform(v, lambda y: abs(y)))) w from em), m as (select label, k // 8 t, k % 8 s, avg(w[k + 1]) "
    f"w from c group by all), r as (select label, t, sum(-w * ln(greatest(w, 1e-8::double))) h, max(w) top, sum(w * "
    f"abs(t - s)) far, sum(w) filter (where t = s) own, coalesce(sum(w) filter (where t = s + 1), 0) prev from m "
    f"group by label, t) select label, round(avg(h), 6) entropy, round(avg(top), 6) concentration, round(avg(far), 6) "
    f"distance, round(avg(own), 6) self_mass, round(avg(prev), 6) prev_mass, any_value(sp) sparsity from r join "
    f"(select label, round(count(*) filter (where w < md)::double / count(*), 6) sp from (select *, quantile_disc(w, "
    f"0.5) over (partition by label) md from m) group by label) using (label) group by label"
)
def attention_stats(s, d):
    v = F.transform("embedding", lambda x: F.abs(x.cast("double")))
    cells = table(s, d, "embeddings").select(
        F.col("label").alias("layer"),
        F.col("vec_id").alias("head"),
        X.let(v, lambda a: X.let(X.total(a), lambda z: F.transform(a, lambda x: x / z))).alias("w"),
    )
    cells = cells.select("layer", "head", F.posexplode("w").alias("k", "w")).select(
        "layer", "head", F.expr("k div 8").alias("t"), F.expr("k % 8").alias("s"), "w"
    )
    got = sequences.attention_stats(cells)
    return got.select(
        F.col("layer").alias("label"),
        *(r6(c, c) for c in ("entropy", "concentration", "distance", "self_mass", "prev_mass", "sparsity")),
    )


_AROUND = ", ".join(
    f"coalesce(round(stddev_pop(x) filter (where x > 0 and k between {low} and {high}), 6) * case when count(*) "
    f"filter (where x > 0 and k between {low} and {high}) >= 2 then 1 else 0 end, 0) {name}"
    for name, low, high in (("first", 1, 3), ("mid", 31, 35), ("last", 62, 64))
)


@query(
    f"with {_EM}, x as (select vec_id, unnest(range(1, 65)) k, unnest(v) x from em) select vec_id, {_AROUND} from x "
    f"group by vec_id"
)
def local_confidence_std(s, d):
    v = F.col("embedding")
    got = table(s, d, "embeddings").select(
        "vec_id", *sequences.local_std(v, F.transform(v, lambda x: (x > 0).cast("int")))
    )
    return got.select("vec_id", *(r6(c, c) for c in ("first", "mid", "last")))


@query(
    f"with {_EM}, x as (select vec_id, unnest(range(1, 9)) k, v from em), y as (select vec_id, k, v[k] t, v[k + 8] - "
    f"v[k] diff from x) select vec_id, k, round(t + 0.5::double / (1 + exp(-avg(diff) over (partition by vec_id))) * "
    f"diff, 6) adjusted from y"
)
def contrastive_adjust(s, d):
    at = lambda k: F.transform(F.slice("embedding", k, 8), lambda x: x.cast("double"))
    moved = table(s, d, "embeddings").select(
        "vec_id", F.posexplode(sequences.contrastive(at(1), at(9), 0.5, 1.0)).alias("k", "adjusted")
    )
    return moved.select("vec_id", (F.col("k") + 1).cast("long").alias("k"), r6("adjusted", "adjusted"))


_SM = (
    f"{_EM}, t as (select vec_id, list_slice(v, 1, 8) lp from em), e as (select vec_id, lp, list_transform(lp, lambda "
    f"x: exp(x - list_max(lp))) e from t), sp as (select vec_id, lp, list_transform(e, lambda x: x / list_sum(e)) p "
    f"from e), hn as (select vec_id, lp, least(1.0, greatest(0.0, -list_sum(list_transform(p, lambda x: x / "
    f"list_sum(p) * ln(x / list_sum(p)))) / (ln(8.0::double) + 1e-8))) h from sp), ad as (select vec_id, "
    f"list_transform(lp, lambda x: x - cast(0.5 as double) * (1 + (1 - h)) * (x - list_min(lp)) / (list_max(lp) - "
    f"list_min(lp) + 1e-8)) a from hn), ex as (select vec_id, list_transform(a, lambda x: exp(x - list_max(a))) e "
    f"from ad)"
)


@query(
    f"with {_SM} select vec_id, round(list_max(e) / list_sum(e), 5) top, round(list_min(e) / list_sum(e), 5) low from "
    f"ex"
)
def softmax_adjust(s, d):
    lp = F.transform(F.slice("embedding", 1, 8), lambda x: x.cast("double"))
    got = table(s, d, "embeddings").select("vec_id", lp.alias("lp")).select(
        "vec_id", sequences.adjusted(sequences.cheap_logits(F.col("lp"), 0.5, 1.0)).alias("p")
    )
    return got.select("vec_id", F.round(F.array_max("p"), 5).alias("top"), F.round(F.array_min("p"), 5).alias("low"))


# Runs, shards and grids

@query(
    "with a as (select lang, avg(length(text)) v from documents where source = 'src0' group by lang), b as (select "
    "lang, avg(length(text)) v from documents where source = 'src1' group by lang) select lang, round(a.v, 6) base, "
    "round(b.v, 6) post, round(b.v - a.v, 6) delta, case when a.v is null or b.v is null then 'missing' else 'ok' end "
    "status from a full join b using (lang)"
)
def pair_delta(s, d):
    runs = table(s, d, "documents").groupBy("source", "lang").agg(F.avg(F.length("text")).alias("v"))
    got = summaries.pair_delta(runs, "source", "src0", "src1", "lang", "v")
    return got.select("lang", r6("base", "base"), r6("post", "post"), r6("delta", "delta"), "status")


def _auc_of(where: str) -> str:
    return (
        f"(select metric, (sum(case when label = 1 then rk end) - sum(label) * (sum(label) + 1) / 2.0::double) / "
        f"(sum(label) * sum(1 - label)) auc from (select metric, label, rank() over (partition by metric order by "
        f"score) + (count(*) over (partition by metric, score) - 1) / 2.0::double rk from lg where {where}) group by "
        f"metric)"
    )


@query(
    f"with {_SC}, a as {_auc_of('i % 2 = 0')}, b as {_auc_of('i % 2 = 1')} select a.metric, round(a.auc, 9) oracle, "
    f"round(b.auc, 9) transferred, round(a.auc - b.auc, 9) gap from a join b on a.metric = b.metric"
)
def transfer_vs_oracle(s, d):
    rows = long(s, d)
    a = ranking.roc_auc(rows.filter("i % 2 = 0"), ["metric"]).select("metric", F.col("auc").alias("a"))
    b = ranking.roc_auc(rows.filter("i % 2 = 1"), ["metric"]).select("metric", F.col("auc").alias("b"))
    return a.join(b, "metric").select(
        "metric",
        F.round("a", 9).alias("oracle"),
        F.round("b", 9).alias("transferred"),
        F.round(F.col("a") - F.col("b"), 9).alias("gap"),
    )


_GRID = (
    "select distinct source, w, k from documents, (select unnest([2, 3, 5]) w), (select unnest([0.1, 0.2]::double[]) k)"
)


@query(_GRID)
def grid(s, d):
    """Every point of a grid for every source."""
    points = F.array(*(F.struct(F.lit(w).alias("w"), F.lit(k).alias("k")) for w in (2, 3, 5) for k in (0.1, 0.2)))
    return table(s, d, "documents").select("source").distinct().select("source", F.inline(points))


@query(
    f"with {_SC}, g as (select i, label, unnest([1, 2, 3]) ord, unnest([ttr, wlen, ttr * wlen]) score from lb), v as "
    f"(select ord, label, rank() over (partition by ord order by score) + (count(*) over (partition by ord, score) - "
    f"1) / 2.0::double rk from g where i % 2 = 0), a as (select ord, (sum(case when label = 1 then rk end) - "
    f"sum(label) * (sum(label) + 1) / 2.0::double) / (sum(label) * sum(1 - label)) auc from v group by ord) select "
    f"ord, round(greatest(auc, 1 - auc), 9) val_auc from a order by 2 desc, 1 limit 1"
)
def grid_best_on_val(s, d):
    points = labelled(s, d).select(
        "i", "label", F.posexplode(F.array("ttr", "wlen", F.col("ttr") * F.col("wlen"))).alias("ord", "score")
    )
    got = ranking.roc_auc(points.filter("i % 2 = 0"), ["ord"]).select(
        (F.col("ord") + 1).alias("ord"), F.round("auc_dir", 9).alias("val_auc")
    )
    return got.orderBy(F.desc("val_auc"), "ord").limit(1)


@query("select min(doc_id) doc_id, sha256(text) text_sha from documents group by text")
def dedup_first(s, d):
    return summaries.keep_first(table(s, d, "documents"), ["text"], ["doc_id"]).select(
        "doc_id", F.sha2("text", 256).alias("text_sha")
    )


@query(
    f"with {_SC}, a as (unpivot (select i, ttr, wlen from sc) on ttr, wlen into name metric value score) select "
    f"metric, i, score from a qualify row_number() over (partition by metric order by score, i) <= 10"
)
def top_n_per_metric(s, d):
    rows = ranking.unpivot(scores(s, d), ["i"], ["ttr", "wlen"])
    return rows.withColumn(
        "r", F.row_number().over(ranking.Window.partitionBy("metric").orderBy("score", "i"))
    ).filter("r <= 10").drop("r")


@query(
    "with n as (select *, row_number() over (order by l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 i, count(*) "
    "over () n from lineitem) select ((i + 1) * 7 - 1) // n shard, count(*) rows, min(i) first from n group by 1"
)
def shard_assign(s, d):
    from gleanspark.operators.running import with_ordinal

    rows = with_ordinal(
        table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"),
        ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"],
        "i",
    )
    n = rows.count()
    return rows.groupBy(summaries.shard_of(F.col("i"), F.lit(n), 7).alias("shard")).agg(
        F.count(F.lit(1)).alias("rows"), F.min("i").alias("first")
    )


@query(
    "with e as (select event_id i from events where event_id % 13 <> 5 union all select event_id from events where "
    "event_id % 97 = 0 and event_id % 13 <> 5), c as (select i, count(*) c from e group by i) select cast(sum(c) as "
    "bigint) n, count(*) n_distinct, cast(count_if(c > 1) as bigint) n_duplicated, max(i) - min(i) + 1 - count(*) "
    "n_missing from c"
)
def shard_merge_checks(s, d):
    e = table(s, d, "events").select(F.col("event_id").alias("i")).filter("i % 13 <> 5")
    return summaries.merge_checks(e.union(e.filter("i % 97 = 0")), "i")


@query(
    "select user_id, event_id, event_type, row_number() over (order by first, user_id) - 1 place from (select *, "
    "min(event_id) over (partition by user_id) first from events qualify row_number() over (partition by user_id "
    "order by event_id desc) = 1)"
)
def manifest_upsert(s, d):
    e = table(s, d, "events").select("user_id", "event_id", "event_type")
    return summaries.upsert(e.filter("event_id % 2 = 0"), e.filter("event_id % 2 = 1"), "user_id", "event_id")


@query("select doc_id, source from documents order by sha256('7:' || doc_id), doc_id limit 100")
def sample_n(s, d):
    return summaries.sample_n(table(s, d, "documents").select("doc_id", "source"), 100, "doc_id", 7)


@query("""with k as (select doc_id, quality, sha256('7:' || doc_id) h from labels), r as (select *, (row_number() over (partition by quality order by h, doc_id) - 0.5::double) / count(*) over (partition by quality) sh from k),
o as (select *, row_number() over (order by sh, quality nulls first, h, doc_id) - 1 place, count(*) over () n from r),
m as (select *, ceil(round(0.2::double * n, 9)) t from o)
select doc_id, quality, case when place < t then 'test' when place < t + ceil(round(0.25::double * (n - t), 9)) then 'val' else 'train' end split from m""")
def stratified_split(s, d):
    return summaries.stratified_split(
        table(s, d, "labels"), "doc_id", "quality", 7
    ).select("doc_id", "quality", "split")


@query(
    f"with {_COVER.replace('with ', '')}, {_LOSS}, nl as (select doc_id, coalesce(avg(uni), 0) nll from documents "
    f"left join ls on id = doc_id group by doc_id), fr as (select lang, doc_id i, label, round(nll, 6) score from cov "
    f"join nl using (doc_id) join documents using (doc_id)) "
    + _PK.format(by="lang,", pb="lang", t="fr")
)
def flagship(s, d):
    """Which documents hold a benchmark passage, and how well a cheap loss ranks them: P@k by language."""
    rows = _coverage(s, d).join(unigram_nll(s, d), "doc_id").join(
        table(s, d, "documents").select("doc_id", "lang"), "doc_id"
    )
    return ranking.precision_at_k(rows.withColumnRenamed("doc_id", "i"), ["lang"], _KS, score="nll")
