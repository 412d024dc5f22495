"""Inputs that once crashed, stalled or misled an operator, and paths that small tables do not reach by themselves."""

import base64
import io
import random
import time

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F
from test_llm_operators import table

from gleanspark.llm import leaks, lines, mixing, neardup, repeats, secret_scan, urls, warc


def test_leaks_need_more_than_scattered_words(spark):
    rng = random.Random(1)
    voc = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(rng.choices(voc, k=rng.randint(50, 400)))) for i in range(300)]
    short = [(0, "w1 w2 w3"), (1, "w5 w9 w2 w7"), (2, "w1 w1 w2 w2 w3 w4 w5"), (3, " ".join(rng.choices(voc, k=30)))]
    bench = table(spark, short, "item_id long, text string")
    assert {
        tuple(r)[:2] for r in leaks.find_leaks(table(spark, docs), bench).collect()
    } == leaks.brute_force(docs, short)
    planted = [(1000, f"{docs[0][1]} w5 w9 w2 w7 {docs[1][1]}"), (1001, f"{docs[2][1]} {short[3][1]} {docs[3][1]}")]
    found = {tuple(r)[:2] for r in leaks.find_leaks(table(spark, docs + planted), bench).collect()}
    assert {(1000, 1), (1001, 3)} <= found and len({d for d, _ in found} - {1000, 1001}) <= 3


def test_leaks_of_common_words_and_far_answers(spark):
    common = "the of and to in is it that was for on are as with his they be at one have".split()
    rng = random.Random(2)
    voc = [f"v{i}" for i in range(2000)]
    docs = [(i, " ".join(rng.sample(common, 20) + rng.choices(voc, k=150))) for i in range(200)]
    phrase = " ".join(rng.choices(common, k=24))
    item = rng.choices(voc, k=300)
    half = [w if i % 5 < 3 or i >= 225 else "zz" for i, w in enumerate(item)]  # 60 % kept, the answer whole
    docs += [(500, f"{docs[0][1]} {phrase} {docs[1][1]}"), (501, " ".join(half))]
    items = [(0, phrase), (1, " ".join(item))]
    found = {
        tuple(r)[:2]
        for r in leaks.find_leaks(table(spark, docs), table(spark, items, "item_id long, text string")).collect()
    }
    assert {(500, 0), (501, 1)} <= found <= leaks.brute_force(docs, items)
    early = leaks.passages_of(1, items[1][1])[0]
    assert leaks.leak(early, half, 0, leaks.Bounds())[1]  # the answer lies some 200 words on


def test_the_basis_has_fewer_dimensions_than_passages(spark):
    rng = np.random.default_rng(3)
    rows = [
        (sorted(rng.choice(400, 20, replace=False).tolist()), [float(x) for x in rng.random(20) + 1])
        for _ in range(150)
    ]
    dense = np.zeros((150, 400))
    for i, (at, v) in enumerate(rows):
        dense[i, at] = v
    basis, values = leaks.latent_basis(spark, rows, 400, 40)
    assert basis.shape == (400, 40) and np.allclose(basis.T @ basis, np.eye(40), atol=1e-4)
    exact = np.linalg.svd(dense, compute_uv=False)
    assert np.allclose(values[:10], exact[:10], rtol=0.05) and values[0] == pytest.approx(exact[0], rel=1e-3)
    whole, _ = leaks.latent_basis(spark, rows, 400, 150)
    gap = lambda b: np.abs((dense @ b) @ (dense @ b).T - dense @ dense.T).max()
    assert gap(whole) < 1e-2 and gap(basis) > 1  # products change with the dimensions that are left out


def test_the_basis_is_fitted_on_every_corpus_passage(spark):
    rng = random.Random(4)
    names = [f"w{i}" for i in range(30)] + [f"other{i}" for i in range(30)]
    docs = [(i, " ".join(rng.choices(names, k=rng.choice([0, 1, 47, 48, 49, 200])))) for i in range(1500)]
    docs += [(1500, None), (1501, docs[3][1]), (1502, " ".join(rng.choices(names, k=30_000)))]
    vocabulary = {f"w{i}": i for i in range(30)}
    steps = [w[i : i + leaks.STEP] for _, t in docs for w in [leaks.words_of(t)] for i in range(0, len(w), leaks.STEP)]
    dense = np.array([[step.count(w) for w in vocabulary] for step in steps], float)
    directions = np.round(np.random.default_rng(2).uniform(-1, 1, (30, 30)) * leaks.LEVELS)
    for parts in (1, 7):
        rows = table(spark, docs).select(F.col("text").alias("_text")).repartition(parts)
        total, df, n, product = leaks.frequencies(rows, vocabulary, directions)
        assert (total, n) == (len(docs), len(steps))
        assert df.tolist() == [sum(w in set(leaks.words_of(t)) for _, t in docs) for w in vocabulary]
        assert (product == dense.T @ (dense @ directions)).all()  # to the last bit, however rows are dealt
    weights = leaks._weights(total, df)
    basis, values = leaks.fit(directions, product, weights, 30)
    assert np.allclose(values, np.linalg.svd(dense * weights, compute_uv=False), rtol=1e-5)
    assert np.allclose(np.linalg.norm(dense * weights @ basis, axis=0), values, rtol=1e-5)


def test_only_candidates_with_words_in_order_are_compared_one_by_one(monkeypatch):
    rng = random.Random(6)
    names = [f"w{i}" for i in range(60)]
    items = [rng.choices(names, k=k) for k in (5, 8, 9, 30, 63, 64, 65, 70, 150)]
    passages = [p for i, w in enumerate(items) for p in leaks.passages_of(i, " ".join(w))]
    texts = [" ".join(rng.choices([*names, "other"], k=k)) for k in (0, 1, 47, 48, 49, 95, 97, 400, 2000) for _ in "abc"]
    for w in items:
        half = [x if rng.random() < 0.6 else "other" for x in w]
        texts += [" ".join(rng.choices(names, k=60) + x + rng.choices(names, k=30)) for x in (w, half)]
    vocabulary = {w: i for i, w in enumerate(names)}
    bounds = leaks.Bounds(cosine=-1e9)  # all are candidates
    want, tried, compared, one = {}, 0, [], leaks.leak
    for i, text in enumerate(texts):
        words = leaks.words_of(text)
        for j, p in enumerate(passages):
            found = [f for first in range(0, len(words), leaks.STEP) if (f := one(p, words, first, bounds))]
            tried += -(-len(words) // leaks.STEP)
            if found:
                want[i, j] = max(found)
    monkeypatch.setattr(leaks, "leak", lambda *a: compared.append(one(*a)) or compared[-1])
    search = leaks.Searcher(passages, vocabulary, np.eye(60, dtype=np.float32), bounds)
    assert {(i, j): (share, answered) for i, j, share, answered in search([*texts, None])} == want
    assert {j for _, j in want} == set(range(len(passages))) and len(compared) < tried / 4


def test_a_large_bucket_is_handed_on_rather_than_held(monkeypatch):
    monkeypatch.setattr(repeats, "SEEN", 1000, raising=False)
    sizes, feed = [], repeats.Bucket.feed

    def fed(self, rows):
        yield from feed(self, rows)
        sizes.append(len(self.seen))

    monkeypatch.setattr(repeats.Bucket, "feed", fed)
    rng = random.Random(8)
    names = [f"name{i}" for i in range(3000)]
    docs = [(i, " ".join(rng.choices(names, k=9))) for i in range(1500)]
    docs += [(1500 + i, f"{docs[j][1]} {rng.choice(names)}") for i, j in enumerate(rng.sample(range(1500), 300))]
    docs += [(1800 + i, docs[j][1]) for i, j in enumerate(rng.sample(range(1800), 300))]
    pack = repeats.Packer(5, 2)
    rows = [row for part in pack((d, 0, t) for d, t in docs) for row in zip(*part, strict=True)]
    rows = sorted((0, doc, data) for _, doc, data in rows)  # all meet in one bucket
    kinds = {"bucket": pa.int32(), "doc": pa.int64(), "data": pa.binary()}
    columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds.values(), strict=True)]
    made = pa.record_batch(columns, list(kinds))
    batches = [made.slice(i, 700) for i in range(0, len(rows), 700)]
    gone, rounds = {}, 0
    while batches:
        rest, rounds = [], rounds + 1
        for out in repeats._from_buckets(5, b"")(iter(batches)):
            for doc, _, first, n, data in zip(*(c.to_pylist() for c in out.columns), strict=True):
                if data is None:
                    gone.setdefault(doc, set()).update(range(first, first + n + 4))
                else:
                    rest.append((doc, data))
        dealt = [row for part in pack.deal(rest, repeats._unzip(b"")) for row in zip(*part, strict=True)]
        columns = [pa.array(c, k) for c, k in zip(zip(*sorted(dealt), strict=True), kinds.values(), strict=False)]
        batches = [pa.record_batch(columns, list(kinds))] if dealt else []
    assert rounds == 2  # windows that are dealt by all their words don't meet in one bucket again
    want = {d: removed for d, (_, removed, _) in repeats.brute_force(docs, 5).items() if removed}
    assert {d: len(places) for d, places in gone.items()} == want and len(want) > 500
    assert max(sizes) < 1000 + 5 * repeats.SORTED, max(sizes)


def test_secrets_that_stall_or_nest():
    scan = secret_scan.Scanner()
    began = time.time()
    assert scan("eyJ" * 400_000) == [] and scan("eyJa." * 200_000) == [] and scan("token " * 200_000) == []
    assert time.time() - began < 10
    began = time.time()
    scan("eyJ" * 333_334)
    assert time.time() - began < 1
    nested = base64.urlsafe_b64encode(('{"a":' + "[" * 200_000).encode()).decode().rstrip("=")
    assert scan(f"{nested}.eyJhIjoxfQ.abc") == []
    good = "eyJhbGciOiJIUzI1NiJ9.eyJhIjoxfQ.abc"
    assert [s[0] for s in scan(f"eyJeyJ {good} eyJxeyJ.{good}")][:1] == ["jwt"]


def test_lines_keep_columns_of_any_name_and_long_lists(spark):
    rng = random.Random(4)
    rows = [
        (
            i,
            "\n".join(rng.choices(["menu", "foot", "x"] + [f"l{k}" for k in range(40)], k=8)),
            rng.choice(["s", None]),
            1,
            2,
            3,
            4,
        )
        for i in range(120)
    ]
    docs = spark.createDataFrame(
        [(*r, i % 5) for i, r in enumerate(rows)],
        "doc_id long, text string, source string, _host int, _drop int, _row int, _gone int, r int",
    )
    want = {r.doc_id: tuple(r) for r in lines.drop_boilerplate(docs).collect()}
    got = {r.doc_id: tuple(r) for r in lines.drop_boilerplate(docs, broadcast_chars=0).collect()}
    assert want == got and sum(r[-1].n_dropped for r in want.values()) > 0
    assert lines.drop_boilerplate(docs).columns == [*docs.columns, "line_dedup"]
    assert all(r[3:8] == (1, 2, 3, 4, r[0] % 5) for r in got.values())


def test_near_duplicates_of_shared_ids(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(30)) for x in "ab")
    c = " ".join(f"c{i}" for i in range(30))
    got = sorted(
        map(
            tuple, neardup.near_duplicates(table(spark, [(0, b), (1, a), (1, b), (2, a), (3, c), (None, a)])).collect()
        ),
        key=str,
    )
    assert got == [(0, 0), (1, 0), (1, 0), (2, 0), (3, 3), (None, None)]


def test_members_go_to_each_block_once_and_meet_all(spark):
    ts, qs = 3, 2
    made = [(i, i % ts, i % qs, i % 3 > 0, ts, qs) for i in range(24)]
    rows = table(spark, made, "id long, t int, q int, asks boolean, ts int, qs int")
    at = [(r.id, *r.at) for r in rows.select("id", F.explode(neardup._places()).alias("at")).collect()]
    assert len({x[:3] for x in at}) == len(at)
    assert len(at) == 24 * qs + 16 * (ts - 1)
    blocks = {x[1:3] for x in at}
    met = [
        (a, b)
        for block in blocks
        for a in (x[0] for x in at if x[1:3] == block and x[4])
        for b in (x[0] for x in at if x[1:3] == block and x[3])
    ]
    assert len(met) == len(set(met)) and set(met) == {(a, b) for a, *_ in made if a % 3 for b in range(24)}


@pytest.mark.parametrize("limits", [(300, 500), (250_000, 3)])
def test_classes_in_one_bucket_meet_in_any_blocks(spark, monkeypatch, limits):
    monkeypatch.setattr(neardup, "BLOCK", limits[0])
    monkeypatch.setattr(neardup, "BLOCK_ROWS", limits[1])
    ids = range(20)
    texts = [" ".join(f"w{i // 2}x{k}" for k in range(60)) + f" end{i}" for i in ids]
    docs = table(spark, list(zip(ids, texts, strict=True)))
    members = table(spark, [(7, i, 20) for i in ids], "bucket long, id long, n long")
    classes = table(spark, [(0, 0)], "node long, root long")  # each text is a class of its own
    bags = neardup._with_bags(docs, table(spark, [(i,) for i in ids], "id long"), 5, "doc_id", "text")
    found = {tuple(sorted(r)) for r in neardup._between_classes(members, bags, classes, 0.8).collect()}
    assert found == {(i, i + 1) for i in ids if i % 2 == 0}


def test_near_duplicates_by_number_of_edits(spark):
    """Recall of copies with up to 2 % of the words edited is at least 0.9, and no other pair is linked."""
    rng = random.Random(5)
    voc = [f"w{i}" for i in range(5000)]
    docs, caught = [], {}
    for edits in range(7):
        for k in range(20):
            text = rng.choices(voc, k=200)
            copy = list(text)
            for at in rng.sample(range(200), edits):
                copy[at] = "edited"
            docs += [(edits * 100 + 2 * k, " ".join(text)), (edits * 100 + 2 * k + 1, " ".join(copy))]
    found = dict(neardup.near_duplicates(table(spark, docs)).collect())
    assert found == neardup.brute_force(docs)
    for edits in range(7):
        caught[edits] = sum(found[edits * 100 + 2 * k + 1] == edits * 100 + 2 * k for k in range(20)) / 20
    assert min(caught[e] for e in range(5)) >= 0.9, caught


def test_repeats_in_split_buckets_and_of_rows_of_one_id(spark, monkeypatch):
    rng = random.Random(6)
    docs = []
    for d in range(150):
        t = " ".join(rng.choices([f"w{i}" for i in range(9)], k=rng.randint(0, 120)))
        docs.append((d, rng.choice(docs)[1] if docs and rng.random() < 0.3 else t))
    want = {k: v for k, v in repeats.brute_force(docs, 7).items()}
    keyed = repeats._keyed(table(spark, docs), "doc_id", "text")
    rows = keyed.select("doc", "key", "text").filter("text is not null")
    assert len(repeats._large(rows, 7, 2, 1.0, 20)) > 5
    monkeypatch.setattr(
        repeats, "_large", lambda rows, window, m, share, least, *more, of=repeats._large: of(rows, window, m, 1.0, 20, *more)
    )
    got = {
        r.doc_id: (r.n_words, r.n_removed, r.kept_text)
        for r in repeats.remove_repeats(table(spark, docs), window=7).collect()
    }
    assert got == want


def test_unequal_windows_of_one_hash(monkeypatch):
    """Where hashes of unequal windows agree, windows are compared by their bytes."""
    monkeypatch.setattr(repeats, "_powers", lambda n: [np.zeros(n + 1, np.uint64)] * 2)
    pack, unzip = repeats.Packer(3, 2), repeats._unzip(b"")
    rows = [(1, 0, "a b c d"), (2, 0, "x a b c"), (3, 0, "q r s t")]
    buckets, docs, data = next(pack(rows))
    order = np.lexsort((docs, buckets))
    for at in np.split(order, np.flatnonzero(np.diff(np.array(buckets)[order])) + 1):
        repeats.sort_windows([docs[i] for i in at], [data[i] for i in at], 3, unzip)
    everything = repeats.sort_windows(docs, data, 3, unzip)
    assert [tuple(int(x) for x in row) for row in zip(*everything, strict=True)] == [(2, 0, 1, 1)]


def test_urls_of_many_rules_by_join(spark):
    rng = random.Random(7)
    rules = [
        (
            rng.choice(["block", "allow"]),
            f"{rng.choice(['a.com', 'com', 'b.a.com'])}/{'/'.join(rng.choices(['x', 'yy', 'z'], k=rng.randint(0, 3)))}",
        )
        for _ in range(300)
    ]
    made = [
        (
            i,
            f"http://{rng.choice(['a.com', 'b.a.com', 'c.b.a.com', 'd.com', 'net'])}/{'/'.join(rng.choices(['x', 'yy', 'yyy', 'z'], k=rng.randint(0, 4)))}"
        )
        for i in range(300)
    ]
    pages = spark.createDataFrame(made, "page_id long, url string")
    assert sorted(urls.judge_urls(pages, rules).collect()) == sorted(
        urls.judge_urls(pages, rules, broadcast_chars=0).collect()
    )


def test_warc_errors_name_archive_and_record(tmp_path):
    record = warc.make_record("urn:page:1", None, b"x" * 5000, None, "2000-01-01T00:00:00Z")
    out = io.BytesIO()
    warc.write_archive(out, [record] * 3)
    data = bytearray(out.getvalue())
    for bad in (bytes(data[:-5]), bytes(data[:-20]) + b"\x00" * 20, bytes(data[:12]), bytes(data) + b"junk"):
        with pytest.raises(ValueError, match="some.warc.zst, record"):
            list(warc._records("some.warc.zst", io.BytesIO(bad)))
    damaged = bytes(data[:9]) + b"\xff" * 30 + bytes(data[39:])  # within the dictionary
    with pytest.raises((ValueError, zstandard.ZstdError)):
        list(warc._records("some.warc.zst", io.BytesIO(damaged)))
    for folder in ("/no/scheme", "viewfs://x/y"):
        with pytest.raises(ValueError):
            warc._store(folder)


def test_warc_equals_plain_computation(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rows = [(r.page_id, (r.html or "").encode()) for r in pages.collect()]
    best: dict[bytes, int] = {}
    for page, data in rows:
        best[data] = max(page, best.get(data, page))
    want = {
        p: (len(d), warc.base32_sha1(d), "response" if best[d] == p else "revisit", None if best[d] == p else best[d])
        for p, d in rows
    }
    got = warc.round_trip(pages).select(
        warc.page_id("id"), "payload_bytes", "payload_digest", "type", warc.page_id("refers_to")
    ).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == want


def test_mixing_equals_plain_optimum(spark):
    """Rates min(cap, exp(tilt * size)) with the tilt found by bisection; copies rounded with a bounded miss."""
    rng = random.Random(8)
    docs = [(i, "w " * rng.choice([1, 2, 30, 70, 400]), None, "abc"[i % 3]) for i in range(600)]
    rows = mixing.mix(table(spark, docs)).collect()
    for source in "abc":
        mine = [r for r in rows if r.source == source]
        sizes, target = np.array([r["size"] for r in mine], float), mine[0].target
        if target < 2 * sizes.sum() * (1 - 1e-9):
            low, high = -1.0, 1.0
            for _ in range(200):
                tilt = (low + high) / 2
                low, high = (tilt, high) if (
                    np.minimum(2, np.exp(tilt * sizes)) * sizes
                ).sum() < target else (low, tilt)
            assert np.allclose([r.rate for r in mine], np.minimum(2, np.exp(tilt * sizes)), rtol=1e-4)
        assert all(int(r.rate) <= r.copies <= int(np.ceil(r.rate)) for r in mine)
        assert abs(sum(r.taken for r in mine) - target) <= 400


def test_mixing_refuses_to_end_without_a_tilt(spark):
    hist = spark.createDataFrame([(0, 5, 3), (0, 9, 2)], "k long, size long, n long")
    with pytest.raises(ValueError):
        mixing.solve_tilts(hist, {0: (33, 5, 50.0)}, 2, rounds=1, close=1e-15)


def test_lines_of_a_very_long_text_in_linear_time(spark):
    """Each text is hashed once, and its places are cut out in order: eight times the lines take about eight times as long."""
    took = []
    for n in (25_000, 200_000):
        texts = ["\n".join(f"w{i}" if i % 2 else f"u{k} {i}" for i in range(n)) for k in range(3)]
        docs = table(spark, list(enumerate(texts))).cache()
        assert docs.count() == 3
        began = time.time()
        done = [r.line_dedup for r in sorted(lines.drop_boilerplate(docs).collect())]
        took.append(time.time() - began)
        assert all(r.n_lines == n and r.n_dropped == n // 2 for r in done)
        assert done[1].text == "\n".join(f"u1 {i}" for i in range(0, n, 2))
    assert took[1] < 12 * took[0] + 3


def test_a_template_with_many_ends(spark, monkeypatch):
    """First words that all share, with different ends: a bucket that no minimiser of six words splits."""
    rng = random.Random(2)
    names = [f"n{i}" for i in range(400)]
    first = " ".join(f"t{i}" for i in range(12))
    docs = [(i, f"{first} {' '.join(rng.choices(names, k=12))}") for i in range(300)]
    docs += [(300 + i, docs[rng.randrange(300)][1]) for i in range(100)]
    keyed = repeats._keyed(table(spark, docs), "doc_id", "text").select("doc", "key", "text")
    first = repeats._large(keyed, 13, 2, 1.0, 20)
    second = repeats._large(keyed, 13, 2, 1.0, 20, [first])
    assert len(first) and len(second)
    pack = repeats.Packer(13, 2, large=[first, second])
    sizes = {}
    for buckets, _, _ in pack((d, 0, t) for d, t in docs):
        for b in buckets:
            sizes[b] = sizes.get(b, 0) + 1
    assert max(sizes.values()) < 20
    want = repeats.brute_force(docs)
    large = lambda rows, window, m, share, least, *more, of=repeats._large: of(rows, window, m, 1.0, 20, *more)
    monkeypatch.setattr(repeats, "_large", large)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in repeats.remove_repeats(table(spark, docs)).collect()}
    assert got == want and sum(r[1] for r in want.values()) >= 1800


def test_a_hot_bucket_takes_linear_time(monkeypatch):
    """Each row of a bucket with many distinct windows is read once, whatever their number."""
    monkeypatch.setattr(repeats, "SEEN", 2000)
    pack, took = repeats.Packer(5, 2), []
    for n in (4_000, 16_000):
        docs = [(i, f"aa bb {i} {i + 1} {i + 2} {i + 3} {i + 4}") for i in range(n)]
        rows = sorted((0, d, x) for part in pack((d, 0, t) for d, t in docs) for _, d, x in zip(*part, strict=True))
        columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.binary()), strict=True)]
        made = pa.record_batch(columns, ["bucket", "doc", "data"])
        began = time.process_time()
        assert sum(b.num_rows for b in repeats._from_buckets(5, b"")(iter([made.slice(i, 500) for i in range(0, len(rows), 500)])))
        took.append(time.process_time() - began)
    assert took[1] < 8 * took[0] + 0.5


@pytest.mark.parametrize("name", ["host", "verdict", "PATH"])
def test_url_ids_of_any_name(spark, name):
    pages = spark.createDataFrame([(1, "http://a.com/x"), (2, None)], f"{name} long, url string")
    for limit in (1_000_000, 0):
        got = urls.judge_urls(pages, [("block", "com/")], id_col=name, broadcast_chars=limit)
        assert got.columns[0] == name and len({c.lower() for c in got.columns}) == 5
        assert {(r[0], r[4]) for r in got.select(name, *got.columns[1:]).collect()} == {(1, "block"), (2, "allow")}


def test_url_rules_are_those_of_the_contract(spark):
    from gleanspark.llm.queries import URL_RULES

    rows = [
        ("s://a.com/en/x", "com/en/", "block"),
        ("s://m.example.com/en/71", "example.com/en/7", "allow"),
        ("s://a.net/de/8", "net/de/", "allow"),
        ("s://example.net/de/9", "net/de/", "allow"),
        ("s://b.example.net/de/8", "example.net/de/8", "block"),
        ("s://a.org/es/", "org/es/", "block"),
        ("s://a.org/de/", None, "allow"),
    ]
    pages = spark.createDataFrame([(k, r[0]) for k, r in enumerate(rows)], "page_id long, url string")
    for limit in (0, 1000):
        got = urls.judge_urls(pages, URL_RULES, broadcast_chars=limit).orderBy("page_id").collect()
        assert [(r.rule, r.verdict) for r in got] == [r[1:] for r in rows]
