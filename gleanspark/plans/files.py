"""Queries that write files in the shared scratch folder and read them back, and greedy decoding."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanspark.functions import text as X
from gleanspark.operators.losses import mean
from gleanspark.operators.running import running
from gleanspark.operators import ml, ngram, ranking, sequences, shingles, summaries
from gleanspark.plans.queries import _BENCH, _KS, _PK, _SC, W, long, losses, query, r6, table
from gleanspark.sources import tables as sources
from gleanspark.sources.scratch import scratch_path

_ASCII = "regexp_replace(coalesce(text, ''), '[^ -~]', ' ', 'g')"


def _plain(text="text"):
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[^ -~]", " ")


@query("select doc_id, sha256(text) text_sha from documents")
def jsonl_scan(s, d):
    path = scratch_path(s, "jsonl")
    sources.write_jsonl(table(s, d, "documents").select("doc_id", "text"), path)
    return sources.read_jsonl(
        s, path, "doc_id long, text string", strict=True
    ).select("doc_id", F.sha2("text", 256).alias("text_sha"))


@query(
    "select count(*) filter (where event_id % 7 = 0) n_malformed, count(*) n_rows, count(*) filter (where event_id % "
    "7 <> 0) n_good from events"
)
def jsonl_malformed(s, d):
    """Every seventh line is cut off; those are reported and give rows of nulls."""
    path = scratch_path(s, "broken")
    line = F.to_json(F.struct("event_id"))
    table(s, d, "events").select(
        F.when(F.col("event_id") % 7 == 0, F.left(line, F.lit(5))).otherwise(line)
    ).write.text(path)
    bad = sources.malformed(s, path, "event_id long").agg(F.count(F.lit(1)).alias("n_malformed"))
    rows = sources.read_jsonl(s, path, "event_id long").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("event_id").alias("n_good")
    )
    return bad.crossJoin(F.broadcast(rows))


@query(
    f"select i, sha256(t) text_sha from (select row_number() over (partition by lang, source order by doc_id) - 1 i, "
    f"{_ASCII} t from documents) where trim(t) <> '' and i % 5 <> 2"
)
def jsonl_indexed(s, d):
    """A file for each language and source whose every fifth line is blank: places count blank lines."""
    path, of = scratch_path(s, "indexed"), ["lang", "source"]
    rows = table(s, d, "documents").select("doc_id", *of, _plain().alias("text"))
    placed = running(rows, of, ["doc_id"], {"at": F.lit(1).cast("long")})
    line = F.when(F.col("at") % 5 == 2, F.lit("")).otherwise(F.to_json(F.struct("text")))
    lines = placed.select(*of, "doc_id", line.alias("value")).repartition(*of).sortWithinPartitions(*of, "doc_id")
    lines.drop("doc_id").write.partitionBy(*of).text(path)
    got = sources.read_indexed(s, path, "text string").filter(F.trim("text") != "")
    return got.select("i", F.sha2("text", 256).alias("text_sha"))


@query(
    f"select sha256(t) text_sha, count(*) n from (select trim({_ASCII}, ' ') t from documents) where t <> '' group by t"
)
def text_lines(s, d):
    path = scratch_path(s, "lines")
    table(s, d, "documents").select(F.concat(F.lit("  "), _plain())).write.text(path)
    return sources.read_lines(s, path).groupBy(F.sha2("text", 256).alias("text_sha")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "select doc_id, coalesce(case when doc_id % 4 <> 0 then source end, '') source, sha256(trim(text, ' ')) text_sha "
    "from documents where trim(text, ' ') <> ''"
)
def labeled_scan(s, d):
    path = scratch_path(s, "samples")
    rows = table(s, d, "documents").select(
        "doc_id", "text", F.when(F.col("doc_id") % 4 != 0, F.col("source")).alias("source")
    )
    sources.write_jsonl(rows, path)
    got = sources.labelled(sources.read_jsonl(s, path, "doc_id long, text string, source string"))
    return got.select("doc_id", "source", F.sha2("text", 256).alias("text_sha"))


@query(
    "select (select count(*) from documents) = (select count(text) from documents) all_text, (select count(*) from "
    "documents d left join labels l using (doc_id) where l.quality is null) = 0 all_labelled"
)
def presence_gates(s, d):
    """Whether all rows have a text, and whether all have a label."""
    rows = table(s, d, "documents").join(table(s, d, "labels"), "doc_id", "left")
    return s.createDataFrame(
        [(sources.all_present(rows, "text"), sources.all_present(rows, "quality"))],
        "all_text boolean, all_labelled boolean",
    )


@query(f"with {_SC} " + _PK.format(by="metric,", pb="metric", t="lg"))
def csv_report(s, d):
    path = scratch_path(s, "csv")
    sources.write_csv(ranking.precision_at_k(long(s, d), ["metric"], _KS), path)
    return s.read.schema(
        "metric string, k int, precision double, n long"
    ).option("header", True).csv(path).select("metric", "k", "precision", "n")


@query("select event_type model, count(*) n, round(sum(value), 3) total from events group by event_type")
def model_scan(s, d):
    """Reports of all models, a folder each, in one scan; the model is the folder's name."""
    path = scratch_path(s, "models")
    table(s, d, "events").select("event_type", "value").write.partitionBy("event_type").json(path)
    got = sources.by_model(s, path + "/event_type={model}/*.json", "value double")
    return got.groupBy(F.replace("model", F.lit("event_type="), F.lit("")).alias("model")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 3).alias("total"))


@query("select coalesce(source, 'none') run from documents group by source having count(*) % 3 < 2")
def run_discovery(s, d):
    """A folder for each source at some depth, with samples, metadata or (by its number of rows) another file, which
    makes no run."""
    path = scratch_path(s, "runs")
    counts = table(s, d, "documents").groupBy(F.coalesce("source", F.lit("none")).alias("source")).count()
    for r in counts.collect():
        name = ("samples_labeled.jsonl", "run_meta.json", "notes.txt")[r["count"] % 3]
        _write_file(s, f"{path}/{'deep/' * (r['count'] % 2)}{r.source}/{name}", f'{{"rows": {r["count"]}}}')
    return sources.runs_in(s, path).select(F.regexp_extract("run", "([^/]+)$", 1).alias("run"))


def _write_file(s, path: str, text: str) -> None:
    at = s.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(s.sparkContext._jsc.hadoopConfiguration()).create(at)
    out.write(bytearray(text.encode()))
    out.close()


@query(
    "select count(*)::int n_target, (count(*) filter (item_id % 2 = 0))::int n_reference, round(sum(case when item_id % 2 "
    "= 0 then length(text) / 8.0::double end), 6) total from benchmark"
)
def loss_files(s, d):
    """Two files of one list each, read as arrays: a number for each item, and for each second one."""
    path = scratch_path(s, "losses")
    items = table(s, d, "benchmark").select("item_id", (F.length("text") / 8.0).alias("x"))
    for name, some in (("t", items), ("r", items.filter("item_id % 2 = 0"))):
        listed = some.agg(F.array_sort(F.collect_list(F.struct("item_id", "x")))["x"].alias("x"))
        listed.select(F.to_json("x").alias("value")).write.text(f"{path}-{name}")
    got = sources.read_losses(s, f"{path}-t", f"{path}-r")
    return got.select(
        F.size("target").alias("n_target"),
        F.size("reference").alias("n_reference"),
        F.round(X.total(F.col("reference")), 6).alias("total"),
    )


@query(f"with {_BENCH.format(k=50)} select distinct substr(sha256(g), 1, 16) hash, 50 shingle_chars from bs")
def index_store(s, d):
    path = scratch_path(s, "shingles")
    sources.write_index(shingles.build_index(table(s, d, "benchmark"), "item_id", 50), path, 50)
    index, size = sources.read_index(s, path)
    return index.withColumn("shingle_chars", F.lit(size))


@query("select doc_id i, quality label, case when doc_id % 3 = 0 then 'test' else 'train' end split from labels")
def split_store(s, d):
    path = scratch_path(s, "splits")
    split = F.when(F.col("doc_id") % 3 == 0, "test").otherwise("train").alias("split")
    sources.write_splits(
        table(s, d, "labels").select(F.col("doc_id").alias("i"), F.col("quality").alias("label"), split), path
    )
    return sources.read_splits(
        s, path, f"i long, label {table(s, d, 'labels').schema['quality'].dataType.simpleString()}, split string"
    )


@query(
    f"with {_SC}, pk as ({_PK.format(by='metric,', pb='metric', t='lg')}) select metric, "
    + ", ".join(
        f"regexp_replace(max(printf('%.4f', \"precision\")) filter (where k = {k}), '\\.?0+$', '') \"P@{k}\""
        for k in _KS
    )
    + " from pk group by metric"
)
def flat_report(s, d):
    """P@k as text with up to four decimals, trailing zeros dropped."""
    return sources.flat(ranking.precision_at_k(long(s, d), ["metric"], _KS), ["metric"], "k", "precision", _KS)


@query(
    f"with {_SC}, pk as ({_PK.format(by='metric, lang,', pb='metric, lang', t='lg')}) select case metric when 'ttr' "
    f"then 'zlib' else 'Other' end metric, case metric when 'ttr' then 2 else 6 end place, "
    + ", ".join(
        f"max(printf('%.2f', \"precision\")) filter (where lang = '{m}' and k = 10) \"{m}_P@10\""
        for m in ("de", "en", "es", "fr")
    )
    + " from pk where k = 10 group by pk.metric"
)
def wide_report(s, d):
    """Metric rows in their order, a column for each model (language) and k."""
    pk = ranking.precision_at_k(long(s, d), ["metric", "lang"], (10,)).withColumn(
        "metric", F.when(F.col("metric") == "ttr", "zlib").otherwise("Other")
    )
    got = sources.wide(pk, "metric", ["lang", "k"], "precision", names=[f"{m}_P@10" for m in ("de", "en", "es", "fr")])
    return got.select(
        "metric", F.col("place").cast("int").alias("place"), *(c for c in got.columns if c not in ("metric", "place"))
    )


@query(
    "select doc_id, case when doc_id % 2 = 0 then doc_id else -1 end number from documents"
)
def shard_number(s, d):
    """Of a shard's file for each document, every second of which has another ending."""
    end = F.when(F.col("doc_id") % 2 == 0, ".json").otherwise(".txt")
    name = F.concat(F.lit("shard_"), F.col("doc_id").cast("string"), end)
    return table(s, d, "documents").select("doc_id", sources.shard_number(name).alias("number"))


_TAGS = ", ".join(
    f"({k}, '{n}', '{f}')"
    for k,
    (n, f) in enumerate([(n, "sampling") for n in sources.STRATEGIES] + [(n, "decoding") for n in sources.DECODERS])
)


@query(
    f"with t(place, source, family) as (values {_TAGS}) select cast(place as bigint) place, t.source, family, count(*) n "
    f"from t join documents on doc_id % (select count(*) from t) = place group by all"
)
def source_table(s, d):
    """Documents by the kind of sample that their id stands for."""
    kinds = sources.source_table(s)
    n = len(sources.STRATEGIES) + len(sources.DECODERS)
    counts = table(s, d, "documents").groupBy((F.col("doc_id") % n).alias("place")).agg(F.count(F.lit(1)).alias("n"))
    return kinds.join(counts, "place")


@query(
    "with c as (select user_id, count(*) n from events group by user_id) select n % 3 mode, count(*) n_runs from c "
    "group by 1"
)
def config_signatures(s, d):
    """Configurations of runs (users): a missing key takes its default, the run's own name does not count."""
    runs = table(s, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    mode = (F.col("n") % 3).cast("string")
    full = F.create_map(F.lit("mode"), mode, F.lit("run"), F.col("user_id").cast("string"))
    config = F.when(F.col("n") % 3 == 0, F.create_map(F.lit("run"), F.col("user_id").cast("string"))).otherwise(full)
    got = summaries.config_signatures(runs.select(config.alias("c")), "c", skip=["run"], defaults={"mode": "0"})
    return got.select(F.get("signature", F.lit(0))["value"].cast("long").alias("mode"), "n_runs")


@query(
    "select 'documents' stream, doc_id id, sha256(text) text_sha from documents where doc_id % 2 = 0 union all select "
    "'ids', vec_id, sha256(array_to_string(list_transform(list_slice(embedding, 1, 5), lambda x: 'w' || "
    "cast(floor(abs(x) * 8) as bigint)), ' ')) from embeddings union all select 'chat', conv_id, "
    "sha256(string_agg(coalesce(text, ''), chr(10) order by turn, text)) from conversations group by conv_id"
)
def stream_modes(s, d):
    """Texts, token ids by a vocabulary, and chat messages as one stream."""
    docs = sources.corpus_rows(table(s, d, "documents").filter("doc_id % 2 = 0"))
    ids = F.transform(F.slice("embedding", 1, 5), lambda x: F.floor(F.abs(x) * 8))
    vocabulary = s.range(4096).select(
        F.col("id").alias("token"), F.concat(F.lit("w"), F.col("id").cast("string")).alias("word")
    )
    coded = sources.corpus_rows(
        table(s, d, "embeddings").select("vec_id", ids.alias("ids")), tokens="ids", vocabulary=vocabulary
    )
    turns = F.sort_array(F.collect_list(F.struct("turn", F.col("text").alias("content"))))
    chats = sources.corpus_rows(table(s, d, "conversations").groupBy("conv_id").agg(turns.alias("m")), messages="m")
    part = lambda df, name, key: df.select(F.lit(name).alias("stream"), F.col(key).alias("id"), F.sha2("text", 256).alias("text_sha"))
    return part(docs, "documents", "doc_id").unionByName(part(coded, "ids", "vec_id")).unionByName(
        part(chats, "chat", "conv_id")
    )


@query("select doc_id, sha256(trim(text, ' ')) text_sha from documents where length(trim(text, ' ')) >= 400")
def prefix_stream(s, d):
    """Prefixes from the first source that can be read; the first two cannot."""
    missing = lambda: s.read.parquet(f"{d}/missing.parquet")
    named = [
        ("a", None, missing), ("a", None, missing), ("b", "x", missing), ("c", None, lambda: table(s, d, "documents"))
    ]
    texts = sources.prefix_stream(named, 400)
    ids = table(s, d, "documents").select("doc_id", F.trim("text").alias("t"))
    return ids.join(
        texts.distinct(), F.col("t") == F.col("text"), "left_semi"
    ).select("doc_id", F.sha2("t", 256).alias("text_sha"))


_NEXT = (
    f"tb as (select item_id id, {W} w from benchmark), tk as (select id, unnest(w) tok, unnest(range(0, len(w))) pos "
    f"from tb), pv as (select *, lag(tok) over (partition by id order by pos) prev from tk), cc as (select prev, tok, "
    f"count(*) c from pv where prev is not null group by all), nx as (select prev, tok from cc qualify row_number() "
    f"over (partition by prev order by c desc, tok) = 1)"
)


@query(
    f"with recursive {_NEXT}, pr as (select id, w[10] last, list_slice(w, 11, 18) truth from tb where len(w) >= 10), "
    f"st(id, k, now, ws) as (select id, 0, last, cast([] as varchar[]) from pr union all select st.id, k + 1, nx.tok, "
    f"list_append(ws, nx.tok) from st join nx on nx.prev = st.now where k < 8), fi as (select id, ws from st qualify "
    f"row_number() over (partition by id order by k desc) = 1), ov as (select id, ws, truth, least(len(ws), "
    f"len(truth)) n from fi join pr using (id)) select id item_id, sha256(array_to_string(ws, ' ')) words_sha, case "
    f"when n > 0 then round(len(list_filter(range(1, n + 1), lambda k: ws[k] = truth[k]))::double / n, 9) else 0 end "
    f"overlap, cast(coalesce(list_min(list_filter(range(1, n + 1), lambda k: ws[k] <> truth[k])) - 1, n) as int) lcp "
    f"from ov"
)
def decode_benchmark(s, d):
    """Greedy continuation of each item's first ten words, against what follows: overlap and common prefix."""
    items = table(s, d, "benchmark")
    w = items.select(F.col("item_id"), X.tokens(F.col("text")).alias("w")).filter(F.size("w") >= 10)
    prompts = w.select("item_id", F.get("w", F.lit(9)).alias("last"), F.slice("w", 11, 8).alias("truth"))
    got = ngram.greedy_decode(prompts, ngram.greedy_successors(ngram.count(items, id_col="item_id")), 8)
    words = F.sha2(F.array_join("words", " "), 256).alias("words_sha")
    overlap = F.round(sequences.overlap(F.col("words"), F.col("truth")), 9).alias("overlap")
    return got.select("item_id", words, overlap, sequences.common_prefix(F.col("words"), F.col("truth")).alias("lcp"))


@query(f"with recursive {_NEXT} select prev, tok from nx")
def greedy_successors(s, d):
    return ngram.greedy_successors(ngram.count(table(s, d, "benchmark"), id_col="item_id"))


@query()
def zlib_ratios(s, d):
    """Log-perplexity over the logarithm of the compressed bytes, and mean loss over the compressed bits."""
    p = losses(s, d).select(F.col("id").alias("doc_id"), mean(F.col("bi")).alias("nll"))
    size = table(s, d, "documents").select("doc_id", ml.zlib_length("text").alias("bytes"))
    rows = size.join(p, "doc_id", "left").withColumn("nll", F.coalesce("nll", F.lit(0.0)))
    ratio = X.log_ratio(F.exp("nll"), F.col("bytes").cast("double"))
    return rows.select("doc_id", r6(ratio, "log_ratio"), F.round(F.col("nll") / (F.col("bytes") * 8), 9).alias("ratio"))



@query(
    "select cast(time_bucket(interval '1 hour', ts) as timestamp) \"start\", event_type, count(*) n, round(sum(value), 3) "
    "total from events where ts is not null group by all"
)
def event_windows(s, d):
    """Events by hour and type, read as a stream of four batches in order of time."""
    from gleanspark.streaming.windows import windows_of_stream

    got = windows_of_stream(table(s, d, "events").select("ts", "event_type", "value"), 4, "1 hour", ["event_type"], value_col="value")
    return got.withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("total", F.round("total", 3))
