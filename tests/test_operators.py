"""Edge cases of the audit's operators, against plain Python."""

import itertools
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gleanspark.functions import text as X
from gleanspark.operators import losses, moments, ml, ngram, ranking, sequences, shingles, summaries, tallies
from gleanspark.operators.running import quantiles
from gleanspark.sources import tables


def naive_label(norm, index, size, match):
    if len(norm) < match:
        parts = {norm[i : i + size] for i in range(max(len(norm) - size + 1, 1))} - {""}
        return int(bool(parts & index))
    ok = [norm[i : i + size] in index for i in range(len(norm) - size + 1)]
    return int(any(all(ok[i : i + match - size + 1]) for i in range(len(norm) - match + 1)))


@pytest.mark.parametrize(("size", "match"), [(6, 12), (6, 6), (3, 9)])
def test_coverage(spark, size, match):
    rng = random.Random(size)
    word = lambda n: "".join(rng.choices("ab c", k=n))
    corpus = [(i, word(40)) for i in range(6)]
    docs = [
        (i, rng.choice([word(rng.randint(0, 30)), word(5) + corpus[i % 6][1][3:25] + word(300), " ", "", "ab", None]))
        for i in range(80)
    ]
    corpus.append((6, "ab"))  # shorter than a shingle: one by itself
    norm = lambda t: " ".join((t or "").split())
    index = {norm(t)[i : i + size] for _, t in corpus for i in range(max(len(norm(t)) - size + 1, 1))}
    idx = shingles.build_index(spark.createDataFrame(corpus, "item long, text string"), "item", size)
    got = dict(
        shingles.coverage_label(spark.createDataFrame(docs, "doc long, text string"), idx, "doc", size, match).collect()
    )
    assert got == {i: naive_label(norm(t), index, size, match) for i, t in docs}


def test_coverage_refuses_saturation(spark):
    docs = spark.createDataFrame([(1, "abc")], "doc long, text string")
    with pytest.raises(ValueError):
        shingles.coverage_label(docs, shingles.build_index(docs, "doc", 5), "doc", 5, 3)


def test_normalize(spark):
    rows = [(" A\x1c\x85 b　C  ",), ("",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(X.normalize(F.col("t"))).collect()]
    assert got == ["a b c", "", None]


def test_precision_with_nan_ties_and_short_groups(spark):
    nan = float("nan")
    df = spark.createDataFrame(
        [(0, 1.0, 1), (1, nan, 1), (2, 1.0, 0), (3, 0.5, 1), (4, math.inf, 0)], "i long, score double, label int"
    )
    p = lambda **kw: {r.k: r.precision for r in ranking.precision_at_k(df, [], [0, 1, 2, 3, 5, 6], **kw).collect()}
    assert p() == {1: 1.0, 2: 1.0, 3: 2 / 3, 5: 3 / 5}
    assert p(lower_better=False) == {1: 1.0, 2: 0.5, 3: 1 / 3, 5: 3 / 5}
    assert p(finite_only=True) == {1: 1.0, 2: 1.0, 3: 2 / 3}


def test_auc_and_threshold_against_loops(spark):
    rng = random.Random(1)
    rows = [(i, float(rng.randint(0, 9)), rng.randint(0, 1)) for i in range(60)]
    df = spark.createDataFrame(rows, "i long, score double, label int")
    pos, neg = [s for _, s, y in rows if y], [s for _, s, y in rows if not y]
    auc = sum((a > b) + (a == b) / 2 for a, b in itertools.product(pos, neg)) / (len(pos) * len(neg))
    assert ranking.roc_auc(df, []).first().auc == pytest.approx(auc)
    marks = sorted({s for _, s, _ in rows})
    ba = lambda t: (sum(s > t for s in pos) / len(pos) + sum(s <= t for s in neg) / len(neg)) / 2
    best = max(((a + b) / 2 for a, b in itertools.pairwise(marks)), key=lambda t: (round(ba(t), 12), -t))
    got = ranking.best_threshold(df, []).first()
    assert (got.threshold, got.balanced_accuracy) == (best, pytest.approx(ba(best)))
    one = df.filter("label = 1")
    assert ranking.roc_auc(one, []).first().auc is None


def test_window_vote_against_loop(spark):
    rng = random.Random(2)
    rows = [(d, p, rng.random(), rng.random()) for d, n in enumerate((1, 2, 3, 9, 40)) for p in range(n)]
    table = losses.arrays_of(spark.createDataFrame(rows, "id long, pos int, uni double, bi double"))
    got = dict(losses.window_vote(table, (2, 3, 8)).collect())
    for d in range(5):
        x = [u - b for i, _, u, b in rows if i == d]
        t = [
            sum(sum(x[i : i + w]) > 0 for i in range(len(x) - w + 1)) / (len(x) - w + 1)
            for w in (2, 3, 8)
            if w <= len(x)
        ]
        assert got.get(d) == (pytest.approx(sum(t) / len(t)) if t else None)


def naive_infilling(texts, last=None, least=2):
    words = [(t or "").split() for t in texts]
    every = [w for t in words for w in t]
    voc, n = sorted(set(every)), len(every)
    follows = [p for t in words for p in itertools.pairwise(t)]

    def dist(h):
        u = [(every.count(w) + 1) / (n + len(voc)) for w in voc]
        cp = sum(a == h for a, _ in follows)
        p = [0.7 * follows.count((h, w)) / cp + 0.3 * x for w, x in zip(voc, u, strict=True)] if cp else u
        mean = sum(x * math.log(x) for x in p)
        sd = math.sqrt(sum(x * (math.log(x) - mean) ** 2 for x in p) + 1e-8)
        return {w: (math.log(x) - mean) / sd for w, x in zip(voc, p, strict=True)}

    out = []
    for t in words:
        x = t[-last:] if last else t
        r = []
        for i in range(1, len(x)):
            z = dist(x[i - 1])
            star = max(voc, key=lambda w: round(z[w], 12))
            r.append(z[x[i]] - z[star] + (dist(x[i])[x[i + 1]] - dist(star)[x[i + 1]] if i + 1 < len(x) else 0))
        low = sorted(r)[: max(1, int(len(r) * 0.1))]
        out.append(sum(low) / len(low) if len(t) >= least else 0.0)
    return out


def test_infilling_against_loop(spark):
    rng = random.Random(4)
    texts = [
        None,
        "",
        "a",
        "a b",
        "a b c",
        *(" ".join(rng.choices("abcdefgh", [9, 5, 3, 2, 2, 1, 1, 1], k=k)) for k in (4, 9, 25, 40)),
        "z a end",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    scores = losses.infilling_arrays(docs, block_bytes=40)
    assert dict(losses.infilling_mean(scores).collect()) == {
        i: pytest.approx(v, abs=1e-9) for i, v in enumerate(naive_infilling(texts))
    }


def test_infilling_and_moments_of_many_blocks_and_buckets(spark):
    """Texts whose words and pairs are spread over blocks and buckets, so that owners, sums and lookups cross them."""
    rng = random.Random(6)
    texts = [" ".join(rng.choices("abcdefgh", [9, 5, 3, 2, 2, 1, 1, 1], k=k)) for k in (5, 9, 30, 3, 12, 40)] + ["", "x end", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = moments.moments(docs, block_bytes=20, bucket_bytes=40)
    assert model.model.n_words > 1 and model.model.n_pairs > 3 and model.tallies.blocks.count() > 3
    assert dict(losses.infilling_mean(model.infilling()).collect()) == {
        i: pytest.approx(v, abs=1e-9) for i, v in enumerate(naive_infilling(texts))
    }
    words = [(t or "").split() for t in texts]
    every = [w for t in words for w in t]
    follows = [p for t in words for p in itertools.pairwise(t)]
    u = {w: (every.count(w) + 1) / (len(every) + len(set(every))) for w in set(every)}
    got = {r.prev: r for r in model.words().collect()}
    assert set(got) == {a for a, _ in follows}
    for h, r in got.items():
        cp = sum(a == h for a, _ in follows)
        p = {w: 0.7 * follows.count((h, w)) / cp + 0.3 * x for w, x in u.items()}
        mean = sum(x * math.log(x) for x in p.values())
        sd = math.sqrt(sum(x * math.log(x) ** 2 for x in p.values()) - mean**2 + 1e-8)
        assert (r.mean, r.sd, r.likeliest) == (
            pytest.approx(mean), pytest.approx(sd), min(p, key=lambda w: (-round(p[w], 12), w))  # noqa: B023
        )
    assert [r.bi for r in model.losses().orderBy("id").collect()] == [
        pytest.approx(r.bi) for r in losses.loss_arrays(docs).orderBy("id").collect()
    ]


def test_coverage_reads_short_and_long_texts_once(spark):
    """Short and long rows, also of one id, get their labels; the first reading has all of them in one scan."""
    known = "the quick brown fox jumps over a lazy dog and runs away again"
    rows = [(1, known[5:17]), (2, known), (3, "x" * 80), (4, known[:40] + "#" * 40), (5, None), (6, known[3:14] + "zz"), (7, "z"), (7, known)]
    docs = spark.createDataFrame(rows, "i long, text string")
    index = shingles.build_index(spark.createDataFrame([(0, known)], "i long, text string"), "i", 10)
    got = shingles.coverage_label(docs, index, "i", 10, 30)
    assert {(r.i, r.label) for r in got.collect()} == {(1, 1), (2, 1), (3, 0), (4, 1), (5, 0), (6, 1), (7, 1)}
    tried = shingles._tried(shingles.normalized(docs, "i"), 10, 30)
    assert tried._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1


def test_infilling_of_the_last_tokens(spark):
    rng = random.Random(5)
    texts = ["", "a b c", "a b c d", *(" ".join(rng.choices("abcdef", [6, 4, 3, 2, 1, 1], k=k)) for k in (6, 7, 30))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = dict(losses.infilling_mean(losses.infilling_arrays(docs), last=6, least=4).collect())
    assert got == {
        i: pytest.approx(v, abs=1e-9) for i, v in enumerate(naive_infilling(texts, last=6, least=4))
    } and got[1] == 0.0


def test_window_sizes():
    assert ngram.window_sizes(2, 40, 12) == [2, 3, 5, 6, 8, 10, 13, 18, 23, 30, 40]


def test_shards_splits_and_merges(spark):
    df = spark.range(10).withColumn("s", summaries.shard_of(F.col("id"), F.lit(10), 4))
    assert [r.s for r in df.orderBy("id").collect()] == [
        next(s for s in range(4) if 10 * s // 4 <= i < 10 * (s + 1) // 4) for i in range(10)
    ]
    rows = spark.createDataFrame([(0,), (1,), (1,), (4,)], "i long")
    assert tuple(summaries.merge_checks(rows, "i").first()) == (4, 3, 1, 2)
    lab = spark.range(192).withColumn("y", (F.col("id") % 2).cast("int"))
    n = {r.split: r["count"] for r in summaries.stratified_split(lab, "id", "y", 1).groupBy("split").count().collect()}
    assert n == {"train": 114, "val": 39, "test": 39}
    by = summaries.stratified_split(lab, "id", "y", 1).groupBy("split", "y").count().collect()
    assert all(abs(r["count"] - n[r.split] / 2) <= 1 for r in by)


def test_distributions_sum_to_one(spark):
    df = spark.createDataFrame(
        [([0.1, -2.0, 3.0],), ([1.0, 1.0, 1.0],), ([float("nan"), float("-inf"), 0.0],)], "lp array<double>"
    )
    lp = F.col("lp")
    forms = [
        X.softmax(lp),
        sequences.adjusted(sequences.cheap_logits(lp, 0.5, 1.0)),
        sequences.adjusted(sequences.contrastive(lp, X.minmax01(lp), 1.0, 0.5)),
        *(
            sequences.explored(sequences.gated(lp, lp, F.lit(0.2), 0.5, 1.0, 0.5, m), 0.07)
            for m in ("zscore", "delta", "absolute")
        ),
    ]
    forms += [
        sequences.explored(sequences.vote_gate(lp, r, k, F.lit(0.3), F.lit(0.4), 0.5, 0.5, 5.0), 0.1)
        for r in (None, lp)
        for k in (None, lp)
    ]
    forms += [
        sequences.nucleus_only(X.softmax(lp), 0.5),
        sequences.top_k_only(X.softmax(lp), 2),
        sequences.explored(sequences.legacy_fast(lp, F.lit(0.1), 0.3, 5.0), 0.0),
    ]
    for row in df.select(*(X.total(f).alias(f"c{i}") for i, f in enumerate(forms))).collect():
        assert all(v == pytest.approx(1.0) for v in row)


def test_overlap_and_prefix(spark):
    df = spark.createDataFrame(
        [(["a", "b", "c"], ["a", "b", "x", "y"]), ([], ["a"]), (["a"], ["a"])], "a array<string>, b array<string>"
    )
    got = df.select(
        sequences.overlap(F.col("a"), F.col("b")), sequences.common_prefix(F.col("a"), F.col("b"))
    ).collect()
    assert [tuple(r) for r in got] == [(pytest.approx(2 / 3), 2), (0.0, 0), (1.0, 1)]


def test_sources(spark, tmp_path):
    (tmp_path / "s.jsonl").write_text('{"text": " a ", "label": 1}\n\n{"text": " "}\n{"text": "b", "source": "x"}\n')
    df = tables.labelled(tables.read_jsonl(spark, str(tmp_path / "s.jsonl"), tables.SAMPLES))
    assert sorted(
        (r.text, r.source) for r in df.collect()
    ) == [("a", ""), ("b", "x")] and not tables.all_present(df, "label")
    assert [
        r.i for r in tables.read_indexed(spark, str(tmp_path / "s.jsonl"), "text string").orderBy("i").collect()
    ] == [0, 2, 3]
    dense = tables.dense_by_index(spark.createDataFrame([(2, 1.5)], "i long, x double"))
    assert [(r.i, math.isnan(r.x)) for r in dense.orderBy("i").collect()] == [(0, True), (1, True), (2, False)]
    assert tables.override({"a": {"b": 1, "c": 2}}, "a.b=-1") == {"a": {"b": -1.0, "c": 2}}
    head = ["", *[f"h{i}" for i in range(6)], "WARC-Identified-Content-Language: eng,fra", "x", "", "body"]
    (tmp_path / "w.wet").write_text("WARC/1.0".join(["", *["\n".join(head)] * 3]))
    assert [
        r.text.strip() for r in tables.web_text_records(spark, str(tmp_path / "w.wet")).collect()
    ] == ["body", "body"]


def test_config_signatures(spark):
    runs = spark.createDataFrame(
        [({"a": "1", "models": "x"},), ({"a": "1", "b": "0"},), ({"a": "1", "b": "2"},), (None,)],
        "config map<string,string>",
    )
    got = summaries.config_signatures(runs, "config", skip=["models"], defaults={"b": "0"})
    assert sorted((tuple(map(tuple, r.signature)), r.n_runs) for r in got.collect()) == [
        ((("a", "1"), ("b", "0")), 2), ((("a", "1"), ("b", "2")), 1), ((("b", "0"),), 1)
    ]


def test_local_std_and_window_perplexity_at_the_edges(spark):
    v = spark.createDataFrame([([1.0, 3.0, 5.0], [1, 0, 1]), ([2.0], [1]), ([], [])], "v array<double>, m array<int>")
    assert [
        tuple(r) for r in v.select(*sequences.local_std(F.col("v"), F.col("m"))).collect()
    ] == [(2.0, 2.0, 2.0), (0.0, 0.0, 0.0), (0.0, 0.0, 0.0)]
    rows = spark.createDataFrame(
        [(i, p, 0.0 if p < n - 1 else -1.0, 0.0) for i, n in ((1, 2), (2, 3), (3, 4)) for p in range(n)],
        "id long, pos int, uni double, bi double",
    )
    assert {
        r.id: r.perplexity for r in losses.window_perplexity(losses.arrays_of(rows), 3).collect()
    } == {1: pytest.approx(math.exp(-0.5)), 2: math.inf, 3: 1.0}


def test_decode_is_reproducible(spark):
    prompts = spark.createDataFrame([(1, "a"), (2, "zz")], "id long, last string")
    table = {"a": [("b", -0.1), ("a", -2.0)], "b": [("a", 0.0)]}
    one, two = (sorted(map(tuple, ml.decode(prompts, table).collect())) for _ in range(2))
    assert one == two and len(one[0][1]) == 16 and one[1][1] == []


def test_stream_index_equals_batch(spark, tmp_path):
    from gleanspark.streaming.index import stream_index

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(
        '{"id": 1, "text": "the quick brown fox"}\n{"id": 2, "text": "quick brown foxes"}\n'
    )
    stream_index(
        spark, str(tmp_path / "in"), "id long, text string", "id", 8, str(tmp_path / "out"), str(tmp_path / "cp")
    ).awaitTermination()
    batch = shingles.build_index(spark.read.schema("id long, text string").json(str(tmp_path / "in")), "id", 8)
    assert sorted(
        map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())
    ) == sorted(map(tuple, batch.collect()))


def test_log_softmax_of_large_entries(spark):
    df = spark.createDataFrame([([800.0, 799.0],), ([-900.0, -900.0],), ([0.5, 1.5, 2.0],)], "a array<double>")
    for a, got in df.select("a", X.log_softmax(F.col("a"))).collect():
        top = max(a)
        assert got == pytest.approx([x - top - math.log(sum(math.exp(y - top) for y in a)) for x in a])


def test_scores_of_one_row_and_of_none(spark):
    bundle = spark.createDataFrame([(0, "x")], "i long, t string")
    scores = spark.createDataFrame([(0, 1.5)], "i long, s double")
    assert [tuple(r) for r in tables.place_scores(bundle, scores).collect()] == [(0, "x", 1.5)]
    assert tables.place_scores(bundle.limit(0), scores.limit(0)).count() == 0
    with pytest.raises(ValueError):
        tables.place_scores(bundle, scores.limit(0))


def test_loss_arrays_against_loop(spark):
    """Blocks of any size give the same losses; odd texts have empty arrays, repeated rows stay."""
    rng = random.Random(8)
    texts = [" ".join(rng.choices(["a", "B", "é", "c"], k=rng.randint(0, 30))) for _ in range(40)]
    rows = [*enumerate(texts), (40, None), (41, " \t"), (42, "a"), (None, "a b a"), (7, texts[7]), (43, "a b " * 50_000)]
    words = [(t or "").lower().split() for _, t in rows]
    uni, pair, ahead = Counter(w for t in words for w in t), Counter(), Counter()
    for t in words:
        pair.update(itertools.pairwise(t))
        ahead.update(t[:-1])
    n, v = sum(uni.values()), len(uni)
    q = {w: (c + 1) / (n + v) for w, c in uni.items()}
    want = Counter()
    for (i, _), t in zip(rows, words, strict=True):
        both = [(-math.log(q[b]), -math.log(0.7 * pair[a, b] / ahead[a] + 0.3 * q[b])) for a, b in itertools.pairwise(t)]
        want[i, tuple(tuple(round(x, 9) for x in c) for c in zip(*both, strict=True)) or ((), ())] += 1
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, block int")
    for block_bytes in (50, 4_000_000):
        got = losses.loss_arrays(df, block_bytes=block_bytes).collect()
        assert Counter((r.id, *[tuple(tuple(round(x, 9) for x in c) for c in (r.uni, r.bi))]) for r in got) == want
    assert losses.loss_arrays(df.limit(0)).count() == 0


def test_quantiles_of_all_groups(spark):
    import numpy as np

    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), rng.choice([rng.random(), 0.5, -1.0])) for _ in range(500)]
    rows += [("one", 3.0), ("none", None), ("nan", math.nan), ("nan", 1.0), ("nan", 2.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    ps = [0.0, 0.05, 0.25, 0.5, 0.9, 1.0]
    got = {r.g: r.q for r in quantiles(df, "x", ps, ["g"]).collect()}
    assert set(got) == {"a", "b", None, "one", "nan"}
    for g in ("a", "b", None, "one"):
        values = [x for k, x in rows if k == g]
        assert got[g] == pytest.approx(np.quantile(values, ps).tolist())
    assert got["nan"][0] == 1.0 and got["nan"][3] == 2.0 and math.isnan(got["nan"][5])
    lower = {r.g: r.q[0] for r in quantiles(df, "x", [0.5], ["g"], discrete=True).collect()}
    for g in ("a", "b", "one"):
        values = sorted(x for k, x in rows if k == g)
        assert lower[g] == values[(len(values) - 1) // 2]
    every = [x for _, x in rows if x is not None and x == x]
    assert quantiles(df.filter("g <> 'nan' or g is null"), "x", [0.3]).first().q == pytest.approx([np.quantile(every, 0.3)])
    assert quantiles(df.filter("x is null"), "x", [0.5], ["g"]).count() == 0


def test_attention_means_are_computed_once(spark):
    """Means that a second reading gives otherwise, as sums in another order do, leave a lower median's share whole."""
    shaken = F.udf(lambda: random.SystemRandom().random(), "double").asNondeterministic()
    cells = spark.range(5 * 64).select(
        (F.col("id") % 5).alias("layer"),
        F.lit(0).alias("head"),
        F.expr("id div 5 div 8").alias("t"),
        F.expr("id div 5 % 8").alias("s"),
        shaken().alias("w"),
    )
    got = sequences.attention_stats(cells).collect()
    assert len(got) == 5 and {r.sparsity for r in got} == {31 / 64}


def test_blocks_ask_for_packed_keys_alone(spark):
    """What the blocks store for the shuffles is a few bytes a token; keys of one block are not answered."""
    rng = random.Random(11)
    syllables = [a + b for a in "bdfgklmnprst" for b in ("a", "e", "in", "or")]
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 3)))
    docs = spark.createDataFrame([(i, " ".join(word() for _ in range(300))) for i in range(1500)], "doc_id long, text string")
    got = tallies.tallied(docs, "doc_id", F.encode(F.col("text"), "UTF-8"), block_bytes=500_000)
    stored = sum(df.agg(F.sum(F.length("data"))).first()[0] for df in (got.asked, got.blocks))
    assert got.n == 450_000 and stored < 12 * got.n and got.blocks.count() > 4
    one = tallies.tallied(docs.coalesce(1).limit(50), "doc_id", F.encode(F.col("text"), "UTF-8"))
    assert one.answers.count() == 0 and one.n == 15_000


def test_losses_move_few_bytes_and_blocks_stay_where_they_are(spark):
    """Words go as text once, pairs by the numbers of words; the stored blocks are not shuffled again, and all counts are whole."""
    rng = random.Random(12)
    syllables = [a + b for a in "bdfgklmnprst" for b in ("a", "e", "in", "or")]
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 2)))
    texts = [" ".join(word() for _ in range(300)) for _ in range(1500)] + ["only here", "", "only"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = tallies.tallied(docs, "doc_id", F.encode(F.col("text"), "UTF-8"), block_bytes=200_000, bucket_bytes=300_000)
    assert got.pairs > 3 and got.n_words > 1 and got.blocks.count() > 10
    moved = sum(df.agg(F.sum(F.length("data"))).first()[0] for df in (got.asked, got.answers))
    assert moved < 3 * got.n
    rows = got.losses(0.7)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
    uni, pair, ahead = Counter(), Counter(), Counter()
    for t in map(str.split, texts):
        uni.update(t)
        pair.update(itertools.pairwise(t))
        ahead.update(t[:-1])
    assert (got.n, got.v) == (sum(uni.values()), len(uni))
    q = {w: (c + 1) / (got.n + got.v) for w, c in uni.items()}
    for r in rows.collect():
        both = list(itertools.pairwise(texts[r.id].split()))
        assert r.uni == pytest.approx([-math.log(q[b]) for _, b in both])
        assert r.bi == pytest.approx([-math.log(0.7 * pair[a, b] / ahead[a] + (1 - 0.7) * q[b]) for a, b in both])


def test_many_blocks_grow_and_words_have_whole_counts_by_falling_number(spark):
    """Beyond 50 blocks these are larger, so that less is asked for a token; answers have rising counts; losses are the same."""
    rng = random.Random(13)
    syllables = [a + b for a in "bdfgklmnprst" for b in ("a", "e", "in", "or")]
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 3)))
    rows = [(i, " ".join(word() for _ in range(300))) for i in range(1500)]
    docs, text = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), F.encode(F.col("text"), "UTF-8")
    got = tallies.tallied(docs, "doc_id", text, block_bytes=10_000, bucket_bytes=400_000)
    assert 50 < got.blocks.count() < sum(len(t) for _, t in rows) / 20_000
    for r in got.answers.filter(f"bucket < {got.n_words}").collect():
        number, rises, last = map(tallies.numbers, tallies.unpack(r.data))
        assert len(rises) == len(last) == (number > 0).sum() and (rises >= 0).all() and (last >= 0).all()
    one = tallies.tallied(docs, "doc_id", text)
    assert sorted(got.losses(0.7).collect()) == sorted(one.losses(0.7).collect())
