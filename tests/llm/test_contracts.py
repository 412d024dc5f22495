"""The registered queries over a whole small table: SQL in another engine, or plain computations of their base fields."""

import hashlib
import os

import duckdb
import pytest

import __spark_entry__ as entry
from gleanspark.llm import leaks, neardup, queries, secret_scan

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


def rows(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet").collect()


@pytest.mark.parametrize("name", queries.SQL)
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    found = duck.sql(entry.oracle_sql()[name])
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=key)
    assert got == sorted((tuple(r[i] for i in at) for r in found.fetchall()), key=key) and got


def test_op1(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    docs = rows(spark, "documents")
    library = Tokenizer.from_file(public_tokenizers.path(queries.TOKENIZER))
    n = [len(e.ids) for e in library.encode_batch([r.text or "" for r in docs], add_special_tokens=False)]
    got = queries.op1_token_counts(spark, SF).collect()
    assert {tuple(r)[:4] for r in got} == {
        (r.doc_id, len((r.text or "").encode()), k, k > 2048) for r, k in zip(docs, n, strict=True)
    }


def test_op4(spark):
    docs = {r.doc_id: r for r in rows(spark, "documents")}
    size = {d: len((r.text or "").encode().split()) for d, r in docs.items()}
    got = queries.op4_mixing(spark, SF).collect()
    assert {r.doc_id: r["size"] for r in got} == size and all(0 <= r.taken <= 2 * r["size"] for r in got)
    by: dict = {}
    for r in got:
        by.setdefault(docs[r.doc_id].source, []).append(r)
    assert sum(x[0].target for x in by.values()) == pytest.approx(1.5 * sum(size.values()))
    order = sorted(by, key=lambda s: (s is None, s))
    open_ = []
    for k, source in enumerate(order):
        mine = by[source]
        total = sum(r["size"] for r in mine)
        assert {r.source_size for r in mine} == {total} and len({r.target for r in mine}) == 1
        assert mine[0].target <= 2 * total * (1 + 1e-12)
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= max(r["size"] for r in mine)
        if mine[0].target < 2 * total * (1 - 1e-9):
            open_.append(mine[0].target / (3, 1, 2)[k % 3])
    assert max(open_) == pytest.approx(min(open_))


def test_op7(spark):
    want = neardup.brute_force([(r.doc_id, r.text) for r in rows(spark, "documents")])
    assert dict(queries.op7_near_duplicates(spark, SF).collect()) == want


def test_op8(spark):
    want = leaks.brute_force(
        [(r.doc_id, r.text) for r in rows(spark, "documents")], [tuple(r) for r in rows(spark, "benchmark")]
    )
    got = {(r.doc_id, r.item_id) for r in queries.op8_decontamination(spark, SF).collect()}
    assert got <= want and len(got) >= 0.9 * len(want)


def test_op9(spark):
    docs = {r.doc_id: r.text for r in rows(spark, "documents")}
    got = queries.op9_secret_scan(spark, SF).collect()
    assert {
        r.doc_id: (r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got
    } == {d: secret_scan.brute_force(t) for d, t in docs.items()}
    for r in got:
        base = ",".join(s for s in r.spans.split(",") if s.split(":")[0] in ("assign", "access", "hex"))
        assert hashlib.sha256(base.encode()).hexdigest() == r.base_sha256
