"""More queries over the driver's tables: decoding steps, proxy labels, gates, merges and reports, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanspark.functions import text as X
from gleanspark.operators import losses as arrays
from gleanspark.operators import ranking, sequences, summaries
from gleanspark.operators.running import with_ordinal
from gleanspark.plans.queries import _AUC, _CASED, _EM, _KS, _LOSS, _PK, _SC, W, _of_all, long, losses, query, r6, scores, table
from gleanspark.plans.queries import _all as of_all_documents
from gleanspark.plans.queries import lowercase_ratio, or_0

# Decoding steps: 20 candidates' log-probabilities, risks and a reference's log-probabilities from each vector


def _lsm(a: str) -> str:
    return f"list_transform({a}, lambda x: x - ln(list_sum(list_transform({a}, lambda y: exp(y)))))"


def _mm(a: str) -> str:
    return (
        f"list_transform({a}, lambda x: case when list_max({a}) - list_min({a}) < 1e-8::double then 0::double else (x "
        f"- list_min({a})) / (list_max({a}) - list_min({a}) + 1e-8::double) end)"
    )


_STEP = (
    f"{_EM}, st as (select vec_id, label, list_slice(v, 1, 20) xs, list_slice(v, 21, 40) r, list_slice(v, 41, 60) q, "
    f"v[61] pr, v[62] vt from em), lp as (select vec_id, label, {_lsm('xs')} lp, r, {_lsm('q')} rf, pr, vt from st)"
)
_GATE = "1 / (1 + exp(-5::double * {x}))"


def _digest(adjusted: str, eps: str) -> str:
    """SQL of the largest and smallest probability and the expected place of adjusted log-probabilities."""
    return (
        f"ex as (select vec_id, {eps} eps, list_transform(a, lambda x: exp(x - list_max(a))) e from ({adjusted})), dg "
        f"as (select vec_id, list_transform(e, lambda x: (1 - eps) * x / list_sum(e) + eps / 20) p from ex) select "
        f"vec_id, round(list_max(p), 6) top, round(list_min(p), 6) low, round(list_sum(list_transform(p, lambda x, i: "
        f"x * i)), 5) place from dg"
    )


def steps(s, d):
    part = lambda at: F.transform(F.slice("embedding", at, 20), lambda x: x.cast("double"))
    one = lambda at: F.get("embedding", F.lit(at)).cast("double")
    got = table(s, d, "embeddings").select(
        "vec_id",
        "label",
        part(1).alias("x"),
        part(21).alias("risks"),
        part(41).alias("q"),
        one(60).alias("prefix"),
        one(61).alias("vote"),
    )
    return got.select(
        "vec_id",
        "label",
        X.log_softmax(F.col("x")).alias("lp"),
        "risks",
        X.log_softmax(F.col("q")).alias("reference"),
        "prefix",
        "vote",
    )


def digest(rows, scores_, share):
    p = rows.select("vec_id", sequences.explored(scores_, share).alias("p"))
    place = X.total(F.transform("p", lambda x, i: x * (i + 1)))
    return p.select(
        "vec_id", r6(F.array_max("p"), "top"), r6(F.array_min("p"), "low"), F.round(place, 5).alias("place")
    )


def _gate(prefix="prefix", gamma=5.0):
    return X.sigmoid(F.lit(gamma) * F.col(prefix))


_CHEAP = (
    f"cp as (select vec_id, lp, rf, list_transform(lp, lambda x: exp(x) / list_sum(list_transform(lp, lambda y: "
    f"exp(y)))) p from lp), ch as (select vec_id, rf, lp, list_transform(list_zip(lp, {_mm('lp')}), lambda z: z[1] - "
    f"0.35::double * (1 + 0.5::double * (1 - least(1.0::double, greatest(0.0::double, -list_sum(list_transform(p, "
    f"lambda x: x * ln(x))) / (ln(20::double) + 1e-8::double))))) * z[2]) a from cp)"
)


@query(f"with {_STEP}, {_CHEAP}, " + _digest("select vec_id, a from ch", "0.07::double"))
def decode_cheap(s, d):
    rows = steps(s, d)
    return digest(rows, sequences.cheap_logits(F.col("lp"), 0.35, 0.5), 0.07)


_DIFF = "list_transform(list_zip(lp, rf), lambda z: z[2] - z[1])"


@query(
    f"with {_STEP}, {_CHEAP}, g as (select vec_id, lp, rf, a, 1 / (1 + exp(-2::double * list_sum({_DIFF}) / 20)) g "
    f"from ch), "
    + _digest(
        "select vec_id, case when vec_id % 5 = 0 then a else list_transform(list_zip(lp, rf), lambda z: z[1] + "
        "0.5::double * g * (z[2] - z[1])) end a, g from g",
        "case when vec_id % 5 = 0 then 0.05::double else 0.05::double * g end",
    )
)
def decode_contrastive(s, d):
    """Every fifth step has no reference of the same words and falls back to the cheap adjustment."""
    lp, ref = F.col("lp"), F.when(F.col("vec_id") % 5 != 0, F.col("reference"))
    share = F.when(ref.isNull(), 0.05).otherwise(0.05 * sequences.mean_gate(lp, F.col("reference"), 2.0))
    return digest(steps(s, d), sequences.contrastive(lp, ref, 0.5, 2.0), share)


_PENALTY = {
    "delta": _mm("list_transform(r, lambda y: greatest(y - pr, 0::double))"),
    "absolute": _mm("r"),
    "zscore": _mm("list_transform(r, lambda y: (y - list_avg(r)) / (list_aggregate(r, 'stddev_samp') + 1e-8::double))"),
}


def _slow_sql(mode: str, strength: str = "0.5", aux: str = "0", frm: str = "lp") -> str:
    both = (
        f"list_zip(lp, list_transform(list_zip(pn, {_mm('lp')}), lambda z: least(1.0::double, z[1] + {aux}::double * "
        f"z[2])))"
    )
    return (
        f"pn as (select vec_id, lp, {_GATE.format(x='pr')} g, {_PENALTY[mode]} pn from {frm}), ad as (select vec_id, "
        f"g, list_transform({both}, lambda z: z[1] - {strength}::double * g * z[2]) a from pn), "
        + _digest("select vec_id, a, g from ad", "0.07::double * g")
    )


@query(f"with {_STEP}, " + _slow_sql("delta"))
def decode_slow(s, d):
    return digest(steps(s, d), sequences.gated(F.col("lp"), F.col("risks"), F.col("prefix"), 0.5, 5.0), 0.07 * _gate())


@query(f"with {_STEP}, " + _slow_sql("absolute"))
def penalty_absolute(s, d):
    return digest(
        steps(s, d),
        sequences.gated(F.col("lp"), F.col("risks"), F.col("prefix"), 0.5, 5.0, mode="absolute"),
        0.07 * _gate(),
    )


@query(f"with {_STEP}, " + _slow_sql("zscore"))
def penalty_zscore(s, d):
    return digest(
        steps(s, d),
        sequences.gated(F.col("lp"), F.col("risks"), F.col("prefix"), 0.5, 5.0, mode="zscore"),
        0.07 * _gate(),
    )


_CACHED = (
    "fs as (select *, vec_id % 3 = 0 or row_number() over (partition by label order by vec_id) = 1 rfs from lp), ca "
    "as (select * exclude (pr), last_value(case when rfs then pr end ignore nulls) over (partition by label order by "
    "vec_id rows between unbounded preceding and current row) pr from fs)"
)


def _with_cache(s, d):
    """Steps whose prefix risk is computed anew at every third step of a prompt only."""
    first = F.row_number().over(ranking.Window.partitionBy("label").orderBy("vec_id")) == 1
    rows = steps(s, d).withColumn("fresh", sequences.refreshed(F.col("vec_id"), 3, first))
    return rows.withColumn("prefix", sequences.cached("prefix", F.col("fresh"), "label", "vec_id"))


@query(f"with {_STEP}, {_CACHED}, " + _slow_sql("delta", "0.3", "0.05", "ca"))
def decode_fast(s, d):
    return digest(
        _with_cache(s, d),
        sequences.gated(F.col("lp"), F.col("risks"), F.col("prefix"), 0.3, 5.0, aux=0.05),
        0.07 * _gate(),
    )


@query(
    f"with {_STEP}, {_CACHED}, ad as (select vec_id, {_GATE.format(x='pr')} g, list_transform(list_zip(lp, "
    f"{_mm('lp')}), lambda z: z[1] - 0.3::double * ({_GATE.format(x='pr')}) * z[2]) a from ca), "
    + _digest("select vec_id, a, g from ad", "0.07::double * g")
)
def decode_fast_legacy(s, d):
    return digest(_with_cache(s, d), sequences.legacy_fast(F.col("lp"), F.col("prefix"), 0.3, 5.0), 0.07 * _gate())


_SPARSE = (
    "sr as (select * exclude (r), list_transform(r, lambda x, i: case when rfs and "
    "list_contains(list_transform(list_slice(list_sort(list_transform(lp, lambda y, j: {'v': -y, 'i': j})), 1, 3), "
    "lambda e: e.i), i) then x else pr end) r from ca)"
)


@query(f"with {_STEP}, {_CACHED}, {_SPARSE}, " + _slow_sql("delta", "0.3", "0.05", "sr"))
def decode_sparse(s, d):
    """Only the three likeliest candidates have risks of their own, at the steps that refresh the prefix's."""
    risks = sequences.sparse_risks(F.col("lp"), F.col("risks"), F.col("prefix"), 3, F.col("fresh"))
    return digest(
        _with_cache(s, d), sequences.gated(F.col("lp"), risks, F.col("prefix"), 0.3, 5.0, aux=0.05), 0.07 * _gate()
    )


_VG = (
    f"vg as (select *, least(1.0::double, (case when label % 3 = 2 then 1 else {_GATE.format(x='pr')} end) * "
    f"({_GATE.format(x='vt')})) g from lp)"
)
_VA = (
    f"case when label % 3 = 0 then list_transform(list_zip(lp, rf), lambda z: z[1] + 0.5::double * g * (z[2] - z[1])) "
    f"when label % 3 = 1 then list_transform(list_zip(lp, {_PENALTY['delta']}), lambda z: z[1] - 0.3::double * g * "
    f"z[2]) else list_transform(list_zip(lp, {_mm('lp')}), lambda z: z[1] - 0.3::double * g * z[2]) end"
)


@query(f"with {_STEP}, {_VG}, " + _digest(f"select vec_id, g, {_VA} a from vg", "0.07::double * g"))
def decode_wbc(s, d):
    """A third of the prompts has a reference, a third risks, and a third neither (its risk gate is 1)."""
    rows, lp = steps(s, d), F.col("lp")
    at = lambda ref, risks: sequences.vote_gate(lp, ref, risks, F.col("prefix"), F.col("vote"), 0.3, 0.5, 5.0)
    kind = F.col("label") % 3
    both = F.when(
        kind == 0, at(F.col("reference"), F.col("risks"))
    ).when(kind == 1, at(None, F.col("risks"))).otherwise(at(None, None))
    gate = F.least(F.lit(1.0), F.when(kind == 2, F.lit(1.0)).otherwise(_gate()) * _gate("vote"))
    return digest(rows, both, 0.07 * gate)


_KEPT = "list_transform(p, lambda x, i: case when list_contains(b, i) then x else 0::double end)"


def _cut_sql(keep: str) -> str:
    return (
        f"pp as (select vec_id, list_transform(lp, lambda x: exp(x)) p from lp), so as (select vec_id, p, "
        f"list_sort(list_transform(p, lambda x, i: {{'v': -x, 'i': i}})) s from pp), bb as (select vec_id, p, {keep} "
        f"b from so), kp as (select vec_id, {_KEPT} k from bb) select vec_id, cast(len(list_filter(k, lambda x: x > "
        f"0)) as bigint) n, round(list_max(k) / list_sum(k), 6) top from kp"
    )


def _cut(s, d, cut):
    p = steps(s, d).select("vec_id", cut(F.transform("lp", F.exp)).alias("p"))
    return p.select(
        "vec_id", F.size(F.filter("p", lambda x: x > 0)).cast("long").alias("n"), r6(F.array_max("p"), "top")
    )


@query(f"with {_STEP}, " + _cut_sql("list_transform(list_slice(s, 1, 5), lambda e: e.i)"))
def sampling_top_k(s, d):
    return _cut(s, d, lambda p: sequences.top_k_only(p, 5))


@query(
    f"with {_STEP}, "
    + _cut_sql(
        "list_transform(list_filter(range(1, 21), lambda k: coalesce(-list_sum(list_transform(s[1:k - 1], lambda e: "
        "e.v)), 0) < 0.6::double), lambda k: s[k].i)"
    )
)
def sampling_nucleus(s, d):
    return _cut(s, d, lambda p: sequences.nucleus_only(p, 0.6))


@query(
    f"with {_EM}, lz as (select vec_id, list_slice(v, 1, 30 + vec_id % 3) t, list_slice(v, 35, 64) r from em), pz as "
    f"(select vec_id, list_slice(t, len(t) - least(len(t), len(r)) + 1, len(t)) t, list_slice(r, len(r) - "
    f"least(len(t), len(r)) + 1, len(r)) r from lz), vv as (select vec_id, ["
    + ", ".join(
        f"list_avg(list_transform(range(1, len(t) - {w - 2}), lambda k: (list_sum(list_transform(range(k, k + {w}), "
        f"lambda j: r[j] - t[j])) > 0)::int::double))"
        for w in (2, 3, 5, 8)
    )
    + "] a, len(t) n from pz) select vec_id, cast(n as bigint) n, round(list_sum(a) / len(a), 6) score from vv"
)
def loss_arrays_vote(s, d):
    """Two loss arrays of unlike length, aligned at their ends, and their window vote."""
    part = lambda at, n: F.transform(F.slice("embedding", F.lit(at), n), lambda x: x.cast("double"))
    rows = table(s, d, "embeddings").select(
        "vec_id",
        sequences.loss_zip(part(1, (30 + F.col("vec_id") % 3).cast("int")), part(35, F.lit(30)), tail=True).alias("z"),
    )
    return rows.select(
        "vec_id", F.size("z").cast("long").alias("n"), r6(sequences.array_vote(F.col("z"), [2, 3, 5, 8]), "score")
    )


@query(
    f"with {_EM}, p as (select label, vec_id, v, lag(v) over (partition by label order by vec_id) b from em), m as "
    f"(select label, vec_id, list_distance(v, b) d from p where b is not null), e as (select label, min_by(vec_id, "
    f"(d, vec_id)) a, min_by(vec_id, (-d, vec_id)) z, min(vec_id) lo, max(vec_id) hi from m group by label) select "
    f"label, round((a - lo)::double / greatest(hi - lo, 1), 6) at_least, round((z - lo)::double / greatest(hi - lo, "
    f"1), 6) at_most from e"
)
def transition_extremes(s, d):
    moves = sequences.transitions(table(s, d, "embeddings"), "label", "vec_id", "embedding")
    got = sequences.transition_extremes(moves, "label", "vec_id")
    return got.select("label", r6("at_least", "at_least"), r6("at_most", "at_most"))


@query(
    f"with {_EM}, c as (select label, vec_id, unnest(range(0, 64)) k, list_transform(v, lambda x: abs(x) / "
    f"list_sum(list_transform(v, lambda y: abs(y)))) w from em), r as (select label, vec_id, k // 8 t, sum(-w[k + 1] "
    f"* ln(greatest(w[k + 1], 1e-8::double))) h, max(w[k + 1]) top from c group by all) select label, vec_id, "
    f"round(avg(h), 6) entropy, round(avg(top), 6) focus from r group by label, vec_id"
)
def head_stats(s, d):
    v = F.transform("embedding", lambda x: F.abs(x.cast("double")))
    cells = table(s, d, "embeddings").select(
        F.col("label").alias("layer"),
        F.col("vec_id").alias("head"),
        X.let(v, lambda a: X.let(X.total(a), lambda z: F.transform(a, lambda x: x / z))).alias("w"),
    )
    cells = cells.select("layer", "head", F.posexplode("w").alias("k", "w")).select(
        "layer", "head", F.expr("k div 8").alias("t"), F.expr("k % 8").alias("s"), "w"
    )
    got = sequences.head_stats(cells)
    return got.select(
        F.col("layer").alias("label"), F.col("head").alias("vec_id"), r6("entropy", "entropy"), r6("focus", "focus")
    )


_PAIRS = sequences.seeded_pairs(32, 32, 12, 7)


@query(
    f"with {_EM} select vec_id, round({32 * 32 / 12}::double * ("
    + " + ".join(f"v[{i + 1}] * v[{33 + j}] * {(k + 1) / 8}::double" for k, (i, j) in enumerate(_PAIRS))
    + "), 6) score from em"
)
def select_mc_seeded(s, d):
    """The first 32 entries as output errors, the last 32 as hidden states, over twelve seeded places of both."""
    part = lambda at: F.transform(F.slice("embedding", at, 32), lambda x: x.cast("double"))
    got = sequences.select_mc_arrays(part(1), part(33), _PAIRS, [(k + 1) / 8 for k in range(len(_PAIRS))], 32 * 32 / 12)
    return table(s, d, "embeddings").select("vec_id", r6(got, "score"))


# Scalars


_RAW = (
    "case event_id % 6 when 0 then 'nan' when 1 then 'abc' when 2 then '1e400' when 3 then null else cast(value as "
    "varchar) end"
)


@query(
    f"select event_id, case when x is null or isnan(x) or isinf(x) then 0 else x end number from (select event_id, "
    f"try_cast({_RAW} as double) x from events)"
)
def safe_float(s, d):
    raw = F.expr(
        "case event_id % 6 when 0 then 'nan' when 1 then 'abc' when 2 then '1e400' when 3 then null else cast(value "
        "as string) end"
    )
    return table(s, d, "events").select("event_id", X.safe_float(raw).alias("number"))


@query(
    "select vec_id, list_transform(embedding, lambda x: x::double)[1] first, 0.0::double nans, 1e10::double high, "
    "-1e10::double low from embeddings"
)
def sanitized_features(s, d):
    """NaN and infinite entries put into each vector come back as numbers."""
    odd = F.concat(
        F.transform("embedding", lambda x: x.cast("double")),
        F.array(F.lit(float("nan")), F.lit(float("inf")), F.lit(float("-inf"))),
    )
    rows = table(s, d, "embeddings").select("vec_id", X.sanitized(odd).alias("v"))
    at = lambda k, name: F.get("v", k).alias(name)
    n = F.size("v")
    return rows.select("vec_id", at(F.lit(0), "first"), at(n - 3, "nans"), at(n - 2, "high"), at(n - 1, "low"))


@query(
    "select conv_id, turn, sha256(case when role = 'user' and text <> '' then text else 'content ' || turn end || "
    "case when turn % 3 = 0 then chr(10) || chr(10) || 'done' else '' end) text_sha from conversations"
)
def row_text(s, d):
    """The named field, else another one, and a completion after a blank line."""
    named = F.when(F.col("role") == "user", F.col("text"))
    other = F.concat(F.lit("content "), F.col("turn").cast("string"))
    done = F.when(F.col("turn") % 3 == 0, F.lit("done")).otherwise(F.lit(""))
    return table(s, d, "conversations").select(
        "conv_id", "turn", F.sha2(X.row_text(named, other, completion=done), 256).alias("text_sha")
    )


@query(
    "select o_orderkey, o_totalprice::double / greatest(o_custkey - 100, 1e-12::double) ratio from orders where "
    "o_custkey > 200"
)
def safe_div(s, d):
    got = table(s, d, "orders").filter("o_custkey > 200")
    return got.select(
        "o_orderkey",
        X.safe_div(F.col("o_totalprice").cast("double"), (F.col("o_custkey") - 100).cast("double")).alias("ratio"),
    )


@query(
    "select event_id, json_extract_string(js, '$.kind') kind, cast(json_extract_string(js, '$.user') as bigint) "
    "\"user\" from (select event_id, json_object('kind', event_type, 'user', user_id) js from events)"
)
def json_fields(s, d):
    js = F.to_json(F.struct(F.col("event_type").alias("kind"), F.col("user_id").alias("user")))
    got = table(s, d, "events").select("event_id", F.from_json(js, "kind string, user long").alias("j"))
    return got.select("event_id", "j.kind", "j.user")


@query(
    "select event_type, n, round(100.0::double * n / sum(n) over (), 6) percent from (select event_type, count(*) n "
    "from events group by event_type)"
)
def map_counts(s, d):
    """Counts by key as one map, and back as rows."""
    counts = table(s, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    one = counts.agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    rows = one.select(
        F.explode("m").alias("event_type", "n"),
        X.total(F.transform(F.map_values("m"), lambda x: x.cast("double"))).alias("t"),
    )
    return rows.select("event_type", "n", r6(100.0 * F.col("n") / F.col("t"), "percent"))


# Labels, thresholds and reports


@query(
    f"with {_SC}, t as (unpivot (select i, lang, ttr, wlen from sc) on ttr, wlen into name metric value score), g as "
    f"(select metric, lang, min(score) lo, max(score) hi, count(*) n from t group by all) select i, t.metric, t.lang, "
    f"case when n >= 2 and lo < hi and hi > 0.75 and lo <= 0.75 then (score > 0.75)::int end as label from t join g "
    f"on t.metric = g.metric and t.lang is not distinct from g.lang"
)
def proxy_threshold_label(s, d):
    """Null where a threshold puts all of a group's rows on one side."""
    rows = ranking.unpivot(scores(s, d), ["i", "lang"], ["ttr", "wlen"])
    return ranking.proxy_label(rows, ["metric", "lang"], 0.75).select("i", "metric", "lang", "label")


_PROXY = (
    "px as (select i, ttr, wlen, (case when max(wlen) over () > {t} and min(wlen) over () <= {t} then (wlen > "
    "{t})::int end) as label from sc), pl as (unpivot (select i, label, ttr, cast(n as double) n from px join (select "
    "i, n from sc) using (i)) on ttr, n into name metric value score)"
)


@query(
    f"with {_SC}, {_PROXY.format(t='5')}, r1 as ({_PK.format(by='metric,', pb='metric', t='pl')}) select metric, "
    f"'threshold' proxy, k, \"precision\", n from r1 union all select metric, 'median', k, \"precision\", n from "
    f"(with {_PROXY.format(t='quantile_cont(wlen, 0.5) over ()')} {_PK.format(by='metric,', pb='metric', t='pl')})"
)
def proxy_precision(s, d):
    """Precision at k of two rankings at finding what a proxy score labels, by a threshold and by its median."""
    rows = scores(s, d).join(
        table(s, d, "documents").select(
            F.col("doc_id").alias("i"), F.size(X.tokens(F.col("text"))).cast("double").alias("n")
        ),
        "i",
    )
    out = None
    for name, t in (("threshold", 5.0), ("median", None)):
        labelled = ranking.proxy_label(rows, [], t, score="wlen")
        long_ = ranking.unpivot(labelled, ["i", "label"], ["ttr", "n"])
        got = ranking.precision_at_k(long_, ["metric"], _KS).select(
            "metric", F.lit(name).alias("proxy"), "k", "precision", "n"
        )
        out = got if out is None else out.union(got)
    return out


_CAL = (
    "lx as (select metric, lang, label, case when lang = 'de' then 1.5::double else score end score from lg), gx as "
    "(select metric, lang, quantile_cont(score, 0.5) filter (where label = 0) m0, quantile_cont(score, 0.5) filter "
    "(where label = 1) m1, min(score) lo, max(score) hi, count(*) filter (where label = 0) n0, count(*) filter (where "
    "label = 1) n1 from lx group by metric, lang)"
)
_SWEEP = (
    "cx as (select metric, lang, score, sum(label) p, sum(1 - label) q from lx group by all), wx as (select metric, "
    "lang, (score + lead(score) over o) / 2 t, sum(p) over o pl, sum(q) over o ql, sum(p) over (partition by metric, "
    "lang) pt, sum(q) over (partition by metric, lang) qt from cx window o as (partition by metric, lang order by "
    "score)), bx as (select metric, lang, t from wx where t is not null and pt > 0 and qt > 0 qualify row_number() "
    "over (partition by metric, lang order by round((ql::double / qt + (pt - pl)::double / pt) / 2, 12) desc, t) = 1)"
)


def _flat(s, d):
    """Scores by language; those of one language are constant."""
    return long(s, d).withColumn("score", F.when(F.col("lang") == "de", 1.5).otherwise(F.col("score")))


@query(
    f"with {_SC}, {_CAL}, {_SWEEP} select g.metric, g.lang, round(coalesce(b.t, case when hi > (m0 + m1) / 2 and lo "
    f"<= (m0 + m1) / 2 then (m0 + m1) / 2 when m0 + m1 is not null and hi > m1 and lo <= m1 then m1 end, case when n1 "
    f"> n0 then lo - 1e-9::double * greatest(1, abs(hi)) else hi + 1e-9::double * greatest(1, abs(hi)) end), 10) "
    f"threshold, case when b.t is not null then 'sweep' when (hi > (m0 + m1) / 2 and lo <= (m0 + m1) / 2) or (m0 + m1 "
    f"is not null and hi > m1 and lo <= m1) then 'medians' else 'majority' end as method from gx g left join bx b on "
    f"b.metric = g.metric and b.lang is not distinct from g.lang"
)
def calibrated_threshold(s, d):
    return ranking.calibrated_threshold(_flat(s, d), ["metric", "lang"]).withColumn(
        "threshold", F.round("threshold", 10)
    )


@query(
    f"with {_SC}, {_CAL} select metric, lang, round(case when hi > (m0 + m1) / 2 and lo <= (m0 + m1) / 2 then (m0 + "
    f"m1) / 2 when m0 + m1 is not null and hi > m1 and lo <= m1 then m1 end, 9) threshold from gx"
)
def midpoint_threshold(s, d):
    return ranking.midpoint_threshold(_flat(s, d), ["metric", "lang"]).withColumn("threshold", F.round("threshold", 9))


@query(
    f"with {_SC}, {_CAL} select metric, lang, round(case when n1 > n0 then lo - 1e-9::double * greatest(1, abs(hi)) "
    f"else hi + 1e-9::double * greatest(1, abs(hi)) end, 10) threshold from gx"
)
def majority_threshold(s, d):
    return ranking.majority_threshold(_flat(s, d), ["metric", "lang"]).withColumn("threshold", F.round("threshold", 10))


@query(
    f"with {_SC} select metric, lang, round(case when count(*) filter (where label = 0) = 0 or count(*) filter (where "
    f"label = 1) = 0 then 0 else ((count(*) filter (where label = 0 and score <= 5))::double / count(*) filter (where "
    f"label = 0) + (count(*) filter (where label = 1 and score > 5))::double / count(*) filter (where label = 1)) / 2 "
    f"end, 9) balanced_accuracy from lg group by metric, lang"
)
def balanced_accuracy(s, d):
    rows = long(s, d).withColumn("predicted", (F.col("score") > 5).cast("int"))
    got = ranking.balanced_accuracy(rows, ["metric", "lang"])
    return got.withColumn("balanced_accuracy", F.round("balanced_accuracy", 9))


_VOTED = (
    "v as (select id, row_number() over (partition by id order by pos) r, sum(uni - bi) over (partition by id order "
    "by pos rows between 1 preceding and current row) s2, sum(uni - bi) over (partition by id order by pos rows "
    "between 4 preceding and current row) s5 from ls), t as (select id, list_filter([case when max(r) >= 2 then "
    "avg(case when s2 > 0 then 1.0::double else 0 end) filter (where r >= 2) end, case when max(r) >= 5 then avg(case "
    "when s5 > 0 then 1.0::double else 0 end) filter (where r >= 5) end], lambda x: x is not null) t from v group by "
    "id), y as (select id, round(list_sum(t) / len(t), 6) score from t where len(t) > 0)"
)


def _auc_sql(rows: str, name: str) -> str:
    return (
        f"select '{name}' metric, (sum(case when label = 1 then rk end) - sum(label) * (sum(label) + 1) / "
        f"2.0::double) / (sum(label) * sum(1 - label)) auc from (select label, rank() over (order by score) + "
        f"(count(*) over (partition by score) - 1) / 2.0::double rk from ({rows}))"
    )


@query(
    f"with {_LOSS}, {_VOTED}, a as "
    f"({_auc_sql('select quality label, coalesce(score, 0) score from labels join documents using (doc_id) left join y on id = doc_id', 'wbc')}) select round(auc, 9) auc, round(greatest(auc, 1 - auc), 9) auc_dir from a"
)
def wbc_auc(s, d):
    votes = losses(s, d).select(F.col("id").alias("doc_id"), or_0(arrays.votes((2, 5))).alias("score"))
    rows = votes.join(table(s, d, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id")
    return ranking.roc_auc(rows, []).select(F.round("auc", 9).alias("auc"), F.round("auc_dir", 9).alias("auc_dir"))


_BASE = (
    f"{_LOSS}, {_CASED}, nl as (select id, round(-avg(bi), 6) nll from ls group by id), mw as (select id, bi, avg(bi) over "
    f"(partition by id order by pos rows between 31 preceding and current row) m, row_number() over (partition by id "
    f"order by pos) r from ls), wm as (select id, round(-case when max(r) >= 32 then min(m) filter (where r >= 32) "
    f"else avg(bi) end, 6) wmin from mw group by id), bl as (select doc_id, quality label, coalesce(nll, 0) nll, "
    f"coalesce(wmin, 0) wmin, coalesce(round(case when l > 0 then o / l else 0 end, 6), 0) low from labels join documents "
    f"using (doc_id) left join nl on nl.id = doc_id left join wm on wm.id = doc_id left join lo on lo.id = doc_id left "
    f"join ll on ll.id = doc_id)"
)


@query(
    f"with {_BASE} select metric, split, round(greatest(auc, 1 - auc), 9) auc_dir from ("
    + " union all ".join(
        f"select '{split}' split, * from ({_auc_sql(f'select label, {m} score from bl where doc_id % 2 = {k}', name)})"
        for k, split in ((0, 'val'), (1, 'test'))
        for m, name in (("nll", "perplexity"), ("wmin", "window"), ("low", "lowercase"))
    )
    + ")"
)
def baseline_aucs(s, d):
    """Perplexity, window and lowercase baselines against the labels, on both splits."""
    both = losses(s, d).select(
        F.col("id").alias("doc_id"),
        or_0(-arrays.mean(F.col("bi"))).alias("perplexity"),
        or_0(arrays.minimum(32)).alias("window"),
    )
    lab = table(s, d, "labels").select("doc_id", F.col("quality").alias("label"))
    low = lowercase_ratio(s, d).select("doc_id", F.col("ratio").alias("lowercase"))
    rows = lab.join(both, "doc_id").join(low, "doc_id").withColumn(
        "split", F.when(F.col("doc_id") % 2 == 0, "val").otherwise("test")
    )
    long_ = ranking.unpivot(rows, ["doc_id", "split", "label"], ["perplexity", "window", "lowercase"])
    return ranking.roc_auc(long_, ["metric", "split"]).select("metric", "split", F.round("auc_dir", 9).alias("auc_dir"))


@query(
    f"with {_SC}, {_AUC}, av as (select metric, (rs - p * (p + 1) / 2.0::double) / (p * q) auc from au), dl as "
    f"(select avg(abs(ttr - wlen)) delta from sc) select metric, round(auc, 9) auc, round(delta, 9) mean_abs_delta "
    f"from av, dl"
)
def annotated_report(s, d):
    """Two score families as one struct column: AUC of each, and the mean absolute difference of both."""
    rows = labelled_structs(s, d)
    flat = rows.select("i", "label", F.col("scores.ttr").alias("ttr"), F.col("scores.wlen").alias("wlen"))
    lab = flat.filter("label is not null")
    auc = ranking.roc_auc(
        ranking.unpivot(lab, ["i", "label"], ["ttr", "wlen"]), ["metric"]
    ).select("metric", F.round("auc", 9).alias("auc"))
    return auc.crossJoin(
        F.broadcast(flat.agg(F.round(F.avg(F.abs(F.col("ttr") - F.col("wlen"))), 9).alias("mean_abs_delta")))
    )


def labelled_structs(s, d):
    lab = table(s, d, "labels").select(F.col("doc_id").alias("i"), F.col("quality").alias("label"))
    return scores(s, d).select("i", F.struct("ttr", "wlen").alias("scores")).join(lab, "i", "left")


@query(
    f"with ln as (select source, unnest(['chars', 'words']) unit, unnest([length(coalesce(text, '')), "
    f"coalesce(len({W.replace('lower(text)', 'text')}), 0)]) v from documents), r as (select *, row_number() over "
    f"(partition by source, unit order by v) - 1 r, count(*) over (partition by source, unit) c from ln) select "
    f"source, unit, count(*) n, round(avg(v), 6) mean, min(v) min, max(v) max, "
    + ", ".join(
        f"max(v) filter (where r = round_even((c - 1) * {p}::double, 0)) p{round(p * 100)}" for p in (0.5, 0.9, 0.99)
    )
    + " from r group by source, unit"
)
def length_stats(s, d):
    return summaries.length_stats(table(s, d, "documents"), "source").withColumn("mean", F.round("mean", 6))


@query("select event_type, round(sum(value), 3) wall, max(event_id) + 1 span from events group by event_type")
def wall_and_span(s, d):
    return summaries.wall_and_span(
        table(s, d, "events"), "event_type", "value", "event_id"
    ).withColumn("wall", F.round("wall", 3))


_EX = (
    f"ex as (select doc_id, lang, list_slice(w, 1, 16) a, list_slice(w, 17, 32) b, list_slice(w, 2, 17) c from "
    f"(select doc_id, lang, {W} w from documents) where len(w) >= 32), eo as (select lang, "
    + ", ".join(
        f"len(list_filter(range(1, 17), lambda k: a[k] = {y}[k])) / 16.0::double {m}_overlap, "
        f"coalesce(list_min(list_filter(range(1, 17), lambda k: a[k] <> {y}[k])) - 1, 16) {m}_lcp"
        for m, y in (("base", "b"), ("fast", "c"))
    )
    + " from ex)"
)


@query(
    f"with {_EX} select lang, 'base' mode, round(avg(base_overlap), 9) mean_overlap, round(avg(base_lcp), 9) "
    f"mean_lcp, count(*) n_scored from eo group by lang union all select lang, 'fast', round(avg(fast_overlap), 9), "
    f"round(avg(fast_lcp), 9), count(*) from eo group by lang"
)
def payload_merge(s, d):
    """Three shards of examples by model (language), merged with a check for doubles, and summed up by mode."""
    w = table(s, d, "documents").select("doc_id", "lang", X.tokens(F.col("text")).alias("w")).filter(F.size("w") >= 32)
    a = F.slice("w", 1, 16)
    modes = {"base": F.slice("w", 17, 16), "fast": F.slice("w", 2, 16)}
    columns = [
        c
        for m, b in modes.items()
        for c in (sequences.overlap(a, b).alias(f"{m}_overlap"), sequences.common_prefix(a, b).alias(f"{m}_lcp"))
    ]
    rows = w.select("doc_id", "lang", *columns)
    merged = summaries.merge_payloads([rows.filter(F.col("doc_id") % 3 == k) for k in range(3)], "lang", "doc_id")
    got = summaries.mode_summary(merged, "lang", list(modes))
    return got.select(
        "lang",
        "mode",
        F.round("mean_overlap", 9).alias("mean_overlap"),
        F.round("mean_lcp", 9).alias("mean_lcp"),
        "n_scored",
    )


# Joins, gates and slices


@query(
    f"with {_SC}, o as (select *, row_number() over (order by i) - 1 place from sc) select place, source, ttr from o"
)
def positional_join(s, d):
    """Samples and scores, each numbered by itself, joined by place."""
    left = with_ordinal(scores(s, d).select("i", "source"), ["i"], "place").select("place", "source")
    right = with_ordinal(scores(s, d).select("i", "ttr"), ["i"], "place").select("place", "ttr")
    return summaries.positional_join(left, right, "place")


@query(
    "select n i, coalesce(quality::double, 'nan'::double) quality from (select unnest(range(0, (select max(doc_id) + "
    "1 from labels))) n) left join labels on doc_id = n"
)
def indexed_scores(s, d):
    from gleanspark.sources.tables import dense_by_index

    return dense_by_index(
        table(s, d, "labels").select(F.col("doc_id").alias("i"), F.col("quality").cast("double").alias("quality"))
    )


@query(f"with {_SC} select i, ttr, label from lb where ttr is not null and wlen is not null and label in (0, 1)")
def proxy_row_gate(s, d):
    keep = F.col("ttr").isNotNull() & F.col("wlen").isNotNull() & F.col("label").isin(0, 1)
    from gleanspark.plans.queries import labelled

    return summaries.gate(labelled(s, d), keep, 8).select("i", "ttr", "label")


@query("select doc_id, quality from documents join labels using (doc_id) where length(trim(text)) >= 10")
def train_row_gate(s, d):
    rows = table(s, d, "documents").join(table(s, d, "labels"), "doc_id")
    return summaries.gate(
        rows, F.length(F.trim("text")) >= 10, 4, label="quality", classes=2
    ).select("doc_id", "quality")


_RUNS = (
    "rn as (select distinct source run_key from documents where source is not null), mf as (select run_key, case when "
    "cast(substr(run_key, 4) as int) % 3 = 0 then 'ok' when cast(substr(run_key, 4) as int) % 3 = 1 then 'error' else "
    "'skipped_existing' end status from rn)"
)


def _runs(s, d):
    runs = table(s, d, "documents").filter("source is not null").select(F.col("source").alias("run_key")).distinct()
    k = F.substring("run_key", 4, 9).cast("int") % 3
    return runs, runs.withColumn("status", F.when(k == 0, "ok").when(k == 1, "error").otherwise("skipped_existing"))


@query(f"with {_RUNS} select run_key from mf where status = 'error'")
def skip_existing(s, d):
    runs, manifest = _runs(s, d)
    return summaries.skip_existing(runs, manifest, "run_key")


@query("select distinct source run_key from documents where source in ('src1', 'src3')")
def run_filter(s, d):
    from gleanspark.sources.tables import only

    return only(_runs(s, d)[0], "run_key", " src1, src3 ,")


@query("select doc_id, 1 as label from documents")
def constant_label(s, d):
    from gleanspark.sources.tables import constant_label as fill

    return fill(table(s, d, "documents"), 1).select("doc_id", "label")


@query(
    "select doc_id, case source when 'src0' then 'm0' when 'src1' then 'm1' else 'other' end model, case source when "
    "'src0' then '1' when 'src1' then '2' else '9' end width from documents"
)
def keyed_config(s, d):
    configs = {
        "src0": {"model": "m0", "width": "1"},
        "src1": {"model": "m1", "width": "2"},
        "rest": {"model": "other", "width": "9"},
    }
    return summaries.keyed_config(
        table(s, d, "documents").select("doc_id", "source"), configs, "source", "rest"
    ).select("doc_id", "model", "width")


@query("select doc_id, source from documents where doc_id >= 100 and doc_id < 300")
def offset_slice(s, d):
    return summaries.offset_slice(table(s, d, "documents").select("doc_id", "source"), "doc_id", 100, 200)


@query("select doc_id, row_number() over (order by sha256('3:' || doc_id), doc_id) - 1 place from documents")
def seeded_shuffle(s, d):
    return summaries.shuffled(table(s, d, "documents").select("doc_id"), "doc_id", 3)


@query(
    "select source k, min(o) first from (select source, 0 o from documents union all select lang, 1 from documents) "
    "group by source"
)
def union_first(s, d):
    docs = table(s, d, "documents")
    tables_ = [docs.select(F.col(c).alias("k"), F.lit(o).alias("first")) for o, c in enumerate(("source", "lang"))]
    return summaries.union_first(tables_, "k")


@query(
    "select source, doc_id, sha256(left(text, 6000)) text_sha from documents where length(text) >= 180 and "
    "lower(coalesce(lang, '')) = 'en' qualify row_number() over (partition by source order by doc_id) <= 25"
)
def stream_row_filters(s, d):
    """Rows of a language and least length, cut to a most length, and at most 25 of each stream."""
    from gleanspark.sources.tables import row_filters

    got = row_filters(
        table(s, d, "documents"), stream="source", order="doc_id", equal={"lang": "EN"}, least=180, most=6000, cap=25
    )
    return got.select("source", "doc_id", F.sha2("text", 256).alias("text_sha"))


_ASKED = _of_all("round(coalesce(a, 0), 6) score", "select id, avg(bi) a from ls group by id")


@query(_ASKED)
def scorer_surface(s, d):
    """A scorer given as a function of batches: the mean of each text's losses, from arrays."""
    from gleanspark.operators.ml import score_texts

    a = losses(s, d).filter(F.size("bi") > 0).select("id", F.col("bi").alias("losses"))
    scored = score_texts(a, "id", "losses", lambda batch: [sum(x) / len(x) for x in batch])
    return of_all_documents(s, d, scored.select("id", r6("score", "score")), score=0.0)
