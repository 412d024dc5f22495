"""The pipeline's stages against plain loops, and that the entry registers everything."""

import pytest

import __spark_entry__ as entry
import corpus_pipeline as cp
from gleanspark.llm import leaks, lines, neardup, quality

SF = "/root/testdata/sf0.001"


def test_registered():
    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))
    assert set(entry.oracle_sql()) <= set(names)


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    for name, stage in cp.STAGES[:-1]:
        before = {r.doc_id: r for r in docs.collect()}
        done = stage(spark, docs, SF).cache()
        after = {r.doc_id: r for r in done.collect()}
        assert done.columns == ["doc_id", "text", "lang", "source", "n_chars"] and len(after) == done.count()
        if name == "quality rules":
            assert all(not quality.brute_force(r.text)["base_failed"] for r in after.values())
            assert set(after) == {r.doc_id for r in quality.judge(docs).filter("quality.kept").collect()}
        elif name == "line dedup":
            drops = {(r.host, r.line) for r in lines.boilerplate(docs).collect()}
            for d, r in before.items():
                assert after[d].text == "\n".join(
                    x for x in r.text.split("\n") if (r.source, x) not in drops
                ) and after[d].n_chars == len(after[d].text)
        elif name == "near-duplicates":
            classes = neardup.brute_force([(d, r.text) for d, r in before.items()])
            assert set(after) == set(classes.values())
        else:
            gone = {d for d, _ in leaks.brute_force([(d, r.text) for d, r in before.items()], bench)}
            assert set(after) == set(before) - gone
        docs = done
    mixed = cp.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in mixed} == {r.doc_id for r in docs.collect()} and sum(
        r.taken for r in mixed
    ) == pytest.approx(sum(r.target for r in {r.source: r for r in mixed}.values()), rel=0.02)


def test_rows_without_or_with_shared_ids(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    rows = [(0, b), (1, a), (1, b), (None, c), (None, c), (2, c), (None, f"{a} {item}"), (None, None)]
    docs = spark.createDataFrame(
        [(i, t, "en", "s", 1, 7) for i, t in rows],
        "doc_id long, text string, lang string, source string, n_chars long, row int",
    )
    kept = cp.keep_one_of_near_duplicates(spark, docs, SF)
    assert sorted(
        r.text or "" for r in kept.collect()
    ) == sorted(["", a, b, c, f"{a} {item}"]) and kept.columns == docs.columns
    clean = cp.drop_leaks(spark, docs, SF).collect()
    assert sorted(map(str, clean)) == sorted(str(r) for r in docs.collect() if item not in (r.text or ""))


def test_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, docs, SF).count() == 0
