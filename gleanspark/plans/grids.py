"""Queries that evaluate whole grids of parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanspark.operators import grid, ngram
from gleanspark.operators.moments import moments
from gleanspark.plans.queries import _GREEDY, _LOSS, query, r6, table

#: The published grids (fixed values).
GRIDS = {
    "infilling": grid.points({"m": [1, 3, 5, 7], "k": [0.05, 0.1, 0.15, 0.2]}),
    "wbc": grid.points({"min_window": [2], "max_window": [32, 40, 56, 72], "num_windows": [8, 10, 12]}),
}


def _scores(s, d):
    """method, point, doc_id, label, split, corpus and score (0 for texts too short for one) of labelled documents.

    English documents are one corpus, the others another; even ids are for validation, odd ones for the test.
    Later places cancel in infilling scores of a model that sees one word back, so that points of one k are equal.
    """
    docs = table(s, d, "documents")
    model = moments(docs)
    found = {
        "infilling": grid.lowest_grid(model.infilling(), GRIDS["infilling"]),
        "wbc": grid.vote_grid(model.losses(), GRIDS["wbc"]),
    }
    kinds = F.when(F.col("lang") == "en", "a").otherwise("b")
    rows = table(s, d, "labels").join(docs.select("doc_id", "lang"), "doc_id").select(
        "doc_id",
        F.col("quality").alias("label"),
        F.when(F.col("doc_id") % 2 == 0, "val").otherwise("test").alias("split"),
        kinds.alias("corpus"),
    )
    out = None
    for method, scores in found.items():
        each = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(len(GRIDS[method]) - 1))).alias("point"))
        scores = scores.select(F.col("id").alias("doc_id"), "point", r6("score", "score"))
        part = each.join(scores, ["doc_id", "point"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)) + F.lit(0.0))
        part = part.withColumn("method", F.lit(method))
        out = part if out is None else out.unionByName(part)
    return out


def _sql() -> str:
    sizes = [ngram.window_sizes(*p.values()) for p in GRIDS["wbc"]]
    every = sorted(set().union(*sizes))
    lags = ", ".join(f"lag(c, {w}, 0) over (partition by id order by pos) l{w}" for w in every)
    shares = ", ".join(f"avg(case when c > l{w} then 1.0::double else 0 end) filter (where r >= {w}) s{w}" for w in every)
    votes = ", ".join(f"list_avg(list_filter([{', '.join(f's{w}' for w in ws)}], lambda x: x is not null))" for ws in sizes)
    ks = ", ".join(f"avg(r) filter (where k <= greatest(1, floor(m * cast({p['k']} as double))))" for p in GRIDS["infilling"])
    upto = {m: ", ".join(map(str, range(len(g)))) for m, g in GRIDS.items()}
    rr = _GREEDY.split("kk as (")[0].rstrip().rstrip(",")
    return f"""
with {_LOSS}, {rr},
kk as (select id, r, row_number() over (partition by id order by r, pos) k, count(*) over (partition by id) m from rr),
inf as (select id, [{ks}] a from kk group by id),
cs as (select id, pos, sum(uni - bi) over (partition by id order by pos rows unbounded preceding) c, row_number() over (partition by id order by pos) r from ls),
lv as (select *, {lags} from cs), sh as (select id, {shares} from lv group by id), vo as (select id, [{votes}] a from sh),
sp as (select 'infilling' as "method", id, unnest([{upto['infilling']}]) point, unnest(a) score from inf union all
       select 'wbc', id, unnest([{upto['wbc']}]), unnest(a) from vo),
pt as (select 'infilling' as "method", unnest([{upto['infilling']}]) point union all select 'wbc', unnest([{upto['wbc']}])),
gr as (select pt."method", pt.point, quality label, case when doc_id % 2 = 0 then 'val' else 'test' end split,
       case when lang = 'en' then 'a' else 'b' end corpus, round(coalesce(score, 0), 6) + 0.0::double score
       from labels join documents using (doc_id) cross join pt left join sp on sp.id = doc_id and sp."method" = pt."method" and sp.point = pt.point)"""


def _aucs(by: str) -> str:
    """au: val_auc and test_auc of gr by method, point and what else is named."""
    return f"""
rk as (select "method", point, split, label{by}, rank() over (partition by "method", point, split{by} order by score)
       + (count(*) over (partition by "method", point, split{by}, score) - 1) / 2.0::double rk from gr),
ua as (select "method", point, split{by}, (sum(case when label = 1 then rk end) - sum(label) * (sum(label) + 1) / 2.0::double)
       / nullif(sum(label) * sum(1 - label), 0) auc from rk group by all),
au as (select "method", point{by}, max(greatest(auc, 1 - auc)) filter (where split = 'val') val_auc,
       max(greatest(auc, 1 - auc)) filter (where split = 'test') test_auc from ua group by all)"""


_PARAMS = ", ".join(
    f"('{m}', {k}, '{grid.signature(p)}')" for m, g in GRIDS.items() for k, p in enumerate(g)
)


@query(
    f"{_sql()}, {_aucs('')}, pa(\"method\", point, params) as (values {_PARAMS}) select \"method\", params, round(val_auc, "
    f"9) val_auc, round(test_auc, 9) test_auc, point = arg_max(point, (round(val_auc, 12), -point)) over (partition by "
    f"\"method\") best from au join pa using (\"method\", point)"
)
def grid_evaluation(s, d):
    """Both AUCs of every point of the grids, and the best of each method on the validation split."""
    got = grid.evaluate(_scores(s, d)).withColumn("val_auc", F.round("val_auc", 12))
    chosen = grid.best(got).select("method", F.col("point").alias("best_point"))
    params = F.element_at(
        F.from_json(F.lit(_params_json()), "map<string,array<string>>")[F.col("method")], F.col("point") + 1
    )
    return got.join(chosen, "method").select(
        "method",
        params.alias("params"),
        F.round("val_auc", 9).alias("val_auc"),
        F.round("test_auc", 9).alias("test_auc"),
        (F.col("point") == F.col("best_point")).alias("best"),
    )


def _params_json() -> str:
    import json

    return json.dumps({m: [grid.signature(p) for p in g] for m, g in GRIDS.items()})


@query(
    f"{_sql()}, {_aucs(', corpus')}, be as (select \"method\", corpus, arg_max(point, (round(val_auc, 12), -point)) point "
    f"from au where val_auc is not null group by all) select a.\"method\", a.point, round(x.val_auc, 9) val_auc, "
    f"round(x.test_auc, 9) test_auc, round(t.test_auc, 9) transferred_auc, b.point own_point, round(o.test_auc, 9) own_auc, "
    f"round(o.test_auc - t.test_auc, 9) gap from be a join au x on x.\"method\" = a.\"method\" and x.point = a.point and "
    f"x.corpus = 'a' left join au t on t.\"method\" = a.\"method\" and t.point = a.point and t.corpus = 'b' left join be b "
    f"on b.\"method\" = a.\"method\" and b.corpus = 'b' left join au o on o.\"method\" = b.\"method\" and o.point = b.point "
    f"and o.corpus = 'b' where a.corpus = 'a'"
)
def grid_transfer(s, d):
    """Parameters chosen on one corpus, on the other corpus, beside those chosen there."""
    got = grid.evaluate(_scores(s, d), ("method", "point", "corpus")).withColumn("val_auc", F.round("val_auc", 12))
    one, other = (got.filter(F.col("corpus") == c).drop("corpus") for c in "ab")
    moved = grid.transfer(one, other)
    return moved.select(
        "method", "point", "own_point", *(F.round(c, 9).alias(c) for c in ("val_auc", "test_auc", "transferred_auc", "own_auc", "gap"))
    )
