"""Sinks, artifacts, checks that refuse, and streams: what the queries do not show."""

import json
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanspark.operators import ml, ranking, sequences, shingles, summaries
from gleanspark.operators.running import running
from gleanspark.sources import tables


def test_checks_refuse(spark):
    a = spark.createDataFrame([(0, "x"), (1, "y")], "i long, t string")
    with pytest.raises(ValueError, match="do not match"):
        summaries.positional_join(a, a.filter("i = 0").select("i", F.lit(1).alias("n")), "i").collect()
    with pytest.raises(ValueError, match="several shards"):
        summaries.merge_payloads([a, a], "t", "i")
    with pytest.raises(ValueError, match="at least 8"):
        summaries.gate(a, F.lit(True), 8)
    with pytest.raises(ValueError, match="labels"):
        summaries.gate(a.withColumn("l", F.lit(1)), F.lit(True), 2, label="l", classes=2)
    with pytest.raises(ValueError, match="3 rows wanted"):
        summaries.sample_n(a, 3, "i", 1)
    with pytest.raises(ValueError, match="no configuration"):
        summaries.keyed_config(a, {"x": {"m": "1"}}, "t")
    with pytest.raises(ValueError, match="have no i"):
        tables.indexed(a.withColumn("i", F.when(F.col("i") > 0, F.col("i"))), ["t"])
    with pytest.raises(ValueError, match="2 rows, but scores of 4"):
        tables.place_scores(a, spark.createDataFrame([(3, 0.5)], "i long, s double"))
    placed = tables.place_scores(a, spark.createDataFrame([(1, 0.5)], "i long, s double")).orderBy("i").collect()
    assert math.isnan(placed[0].s) and placed[1].s == 0.5
    assert [r.i for r in tables.indexed(a.select("t"), ["t"]).orderBy("t").collect()] == [0, 1]
    with pytest.raises(Exception, match="boom"):
        tables.open_first([lambda: (_ for _ in ()).throw(ValueError("boom"))])


def test_running_sums_with_null_groups(spark):
    rows = [(g, k, k + 1) for g in ("a", None, "b") for k in range(20)]
    df = spark.createDataFrame(rows, "g string, k long, x long")
    got = {(r.g, r.k): r.s for r in running(df, ["g"], ["k"], {"s": F.col("x")}).collect()}
    assert got == {(g, k): k * (k + 1) // 2 for g, k, _ in rows}


def test_degenerate_labels_and_reports(spark):
    one = spark.createDataFrame([(k, "g", 1.0, k % 2) for k in range(6)], "i long, g string, score double, label int")
    assert {r.label for r in ranking.proxy_label(one, ["g"]).collect()} == {None}
    assert ranking.calibrated_threshold(one, ["g"]).first().method == "majority"
    few = spark.createDataFrame([(k, float(k)) for k in range(3)], "i long, score double")
    assert {r.label for r in ranking.proxy_label(few, []).collect()} == {None}
    assert [r.label for r in ranking.proxy_label(few, [], 0.5).orderBy("i").collect()] == [0, 1, 1]
    empty = ranking.precision_report(
        one.filter("i < 0"), ["g"], (1,), expected=spark.createDataFrame([("g",)], "g string")
    )
    assert [(r.status, r.precision, r.n_samples) for r in empty.collect()] == [("no samples", None, 0)]
    assert ranking.balanced_accuracy(one.withColumn("predicted", F.lit(1)).filter("label = 1"), ["g"]).first()[1] == 0.0


def test_documents_of_thresholds_and_configurations(spark, tmp_path):
    rows = spark.createDataFrame(
        [("wbc", 0.25, True), ("inf", -1.0, False)], "metric string, threshold double, higher boolean"
    )
    path = str(tmp_path / "t.json")
    tables.write_thresholds(rows, path, n_rows_used=9)
    assert tables.read_thresholds(path, ["wbc", "inf"]) == {"wbc": (0.25, True), "inf": (-1.0, False)}
    assert json.loads((tmp_path / "t.json").read_text())["n_rows_used"] == 9
    with pytest.raises(ValueError, match="schema"):
        tables.read_thresholds(path, ["wbc"], "other.v1")
    with pytest.raises(ValueError, match="has no"):
        tables.read_thresholds(path, ["zlib"])
    (tmp_path / "c.json").write_text('{"a": {"b": [1, 2]}}')
    assert tables.read_config(str(tmp_path / "c.json")) == {"a": {"b": [1, 2]}}


def test_metric_tree_and_markdown(spark):
    rows = spark.createDataFrame(
        [("m", "zlib", "s", 10, 0.5), ("m", "zlib", "s", 50, float("nan")), ("m", "zlib", "t", 10, 1.0)],
        "model string, metric string, source string, k int, precision double",
    )
    assert tables.metric_tree(rows, ["model", "metric", "source", "k"], "precision") == {
        "m": {"zlib": {"s": {"10": 0.5, "50": None}, "t": {"10": 1.0}}}
    }
    text = tables.markdown_by_model(rows, (10, 50))
    assert "## m: zlib" in text and "| s | 0.500 | N/A |" in text and "| t | 1.000 | N/A |" in text
    assert tables.html(
        [{"a": "<", "b": None}], ["a", "b"]
    ) == "<table><tr><th>a</th><th>b</th></tr><tr><td>&lt;</td><td></td></tr></table>"


def test_compressed_lengths(spark):
    texts = ["", None, "é" * 500, "abc"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    got = {r.i: r.n for r in df.select("i", ml.zlib_length("t").alias("n")).collect()}
    assert got == {i: len(zlib.compress((t or "").encode())) for i, t in enumerate(texts)}


def test_ratios_of_losses_and_compressed_lengths(spark):
    from gleanspark.plans import QUERIES

    sf = "/root/testdata/sf0.001"
    nll = {r.doc_id: r.nll for r in QUERIES["bigram_nll"](spark, sf).collect()}
    size = {
        r.doc_id: len(zlib.compress((r.text or "").encode()))
        for r in spark.read.parquet(f"{sf}/documents.parquet").collect()
    }
    got = QUERIES["zlib_ratios"](spark, sf).collect()
    assert len(got) == len(size)
    for r in got:
        assert r.ratio == pytest.approx(nll[r.doc_id] / (8 * size[r.doc_id]), abs=1e-8)
        assert r.log_ratio == pytest.approx(
            math.log(math.exp(nll[r.doc_id]) + 1e-8) / math.log(size[r.doc_id] + 1e-8), abs=2e-6
        )


def test_forests_are_stored_and_applied(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(1.5 * (i % 3 == 0), 1, 6)], float(i % 3 == 0)) for i in range(300)]
    df = spark.createDataFrame(rows, "i long, v array<double>, y double")
    model = ml.fit_forest(df.filter("i < 200"), "v", "y", trees=20)
    ml.save_forests({"small": model}, str(tmp_path / "m"), spark)
    own = {r.i: r.p_member for r in ml.member_probability(model, df, "v").collect()}
    back = {r.i: r.p_member for r in ml.apply_forest(spark, str(tmp_path / "m"), "small", df, "v").collect()}
    assert own == back and all(0 <= p <= 1 for p in own.values())
    right = sum((own[i] > 0.5) == (y == 1) for i, _, y in rows if i >= 200)
    assert right >= 80  # of 100 held-out rows
    with pytest.raises(ValueError, match="no artifact"):
        ml.apply_forest(spark, str(tmp_path / "m"), "large", df, "v")


def test_decoding_modes(spark):
    prompts = spark.createDataFrame([(i, "a") for i in range(40)], "id long, last string")
    table = {"a": [("b", -0.1), ("a", -3.0), ("c", -6.0)], "b": [("a", 0.0)], "c": [("a", 0.0)]}
    words = lambda **k: {w for r in ml.decode(prompts, table, **k).collect() for w in r.words}
    assert words(mode="top_k", top_k=1) == {"a", "b"} and words(mode="nucleus", share=0.5) == {"a", "b"}
    assert words(mode="decay") == {"a", "b", "c"} and words(mode="cheap", strength=6.0) == {"a", "b", "c"}
    with pytest.raises(Exception, match="no such mode"):
        words(mode="other")
    assert tables.example_seed(1, 2, 3) == 20_301


def test_risks_are_refreshed_and_sparse(spark):
    rows = [("p", k, float(k)) for k in range(1, 8)]
    df = spark.createDataFrame(rows, "p string, step long, risk double").withColumn(
        "fresh", sequences.refreshed(F.col("step"), 3, F.col("step") == 1)
    )
    got = [
        r.c for r in df.withColumn("c", sequences.cached("risk", F.col("fresh"), "p", "step")).orderBy("step").collect()
    ]
    assert got == [1.0, 1.0, 3.0, 3.0, 3.0, 6.0, 6.0]
    one = spark.createDataFrame([([-1.0, -3.0, -2.0], [9.0, 8.0, 7.0])], "lp array<double>, r array<double>")
    risks = lambda scored: one.select(sequences.sparse_risks(F.col("lp"), F.col("r"), F.lit(0.5), 2, F.lit(scored)).alias("r")).first().r
    assert risks(True) == [9.0, 0.5, 7.0] and risks(False) == [0.5, 0.5, 0.5]


def test_capped_index_by_text(spark):
    docs = spark.createDataFrame([(1, "abcdefgh"), (2, "abcdxyz")], "id long, text string")
    of = lambda *x: {r.hash for r in docs.limit(1).select(F.explode(F.array(*(shingles.short_hash(F.lit(s)) for s in x))).alias("hash")).collect()}
    assert {
        r.hash for r in shingles.capped_index(docs, "id", 4, 100, per_text=2).collect()
    } == of("abcd", "bcde", "bcdx", "cdxy")


def test_each_batch_is_scored_once(spark, tmp_path):
    from gleanspark.streaming.index import score_batches

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"id": 1, "x": 2}\n{"id": 2, "x": 3}\n')
    for _ in range(2):
        stream = spark.readStream.schema("id long, x long").json(str(tmp_path / "in"))
        score_batches(
            stream, lambda b: b.withColumn("y", F.col("x") * 10), str(tmp_path / "out"), str(tmp_path / "cp")
        ).awaitTermination()
    assert sorted((r.id, r.y) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(1, 20), (2, 30)]
