"""Scans and sinks: JSON lines, plain lines, web text records, metric trees and tables."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from gleanspark.operators.running import running, with_ordinal
from gleanspark.sources.scratch import near, stash

SAMPLES = "text string, source string, prompt_prefix string, prefix_tokens int, label int"


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str, *, strict: bool = False) -> DataFrame:
    """JSON lines; blank lines are skipped.  ``strict`` stops at a malformed line."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)


def malformed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """file and text of each malformed line (blank lines are none)."""
    parsed = F.from_json("value", f"{schema}, _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"})
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value", parsed.alias("_r"))
    return lines.filter(
        "_r._corrupt_record is not null and trim(value) <> ''"
    ).select("file", F.col("value").alias("text"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("text")).filter("text <> ''")


def _numbered(rows: DataFrame) -> DataFrame:
    """file, i and value of text rows: each row's place in its file, whatever the splits that files are read in."""
    at = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    placed = stash(rows.select(*at, F.monotonically_increasing_id().alias("row"), "value"), "text-rows")
    return running(placed, ["file"], ["block", "row"], {"i": F.lit(1).cast("long")}).select("file", "i", "value")


def read_indexed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with ``i``, the line's place in its file (blank lines count but give no row)."""
    rows = _numbered(spark.read.text(path)).filter(F.trim("value") != "")
    return rows.select("i", F.from_json("value", schema).alias("_r")).select("i", "_r.*")


def read_losses(spark: SparkSession, target: str, reference: str) -> DataFrame:
    """target and reference: two files of one JSON list of numbers each, as arrays of one row."""
    one = lambda path, name: spark.read.text(path, wholetext=True).select(F.from_json("value", "array<double>").alias(name))
    return one(target, "target").crossJoin(F.broadcast(one(reference, "reference")))


def indexed(rows: DataFrame, order: Sequence[str], index: str = "i") -> DataFrame:
    """``rows`` with their index, which is made from their order where no row has one; an error where only some have."""
    if index not in rows.columns:
        return with_ordinal(rows, order, index)
    n, have = rows.agg(F.count(F.lit(1)), F.count(index)).first()
    if 0 < have < n:
        raise ValueError(f"{n - have} of {n} rows have no {index}")
    return rows if have else with_ordinal(rows.drop(index), order, index)


def place_scores(bundle: DataFrame, scores: DataFrame, index: str = "i") -> DataFrame:
    """``bundle`` with the scores of its index (NaN where missing); an error where their lengths differ."""
    top = scores.agg(F.max(index)).first()[0]
    if (n := bundle.count()) != (m := 0 if top is None else top + 1):
        raise ValueError(f"{n} rows, but scores of {m}")
    doubles = [f.name for f in scores.schema if f.dataType == T.DoubleType()]
    return bundle.join(scores, index, "left").withColumns({c: F.coalesce(c, F.lit(float("nan"))) for c in doubles})


def labelled(df: DataFrame) -> DataFrame:
    """Samples that aren't blank, trimmed, with an empty source for a missing one."""
    return df.withColumn("text", F.trim("text")).filter("text <> ''").withColumn(
        "source", F.coalesce("source", F.lit(""))
    )


def all_present(df: DataFrame, column: str) -> bool:
    """Whether a column is set in every row (and there is one)."""
    return bool(df.agg(F.coalesce(F.bool_and(F.col(column).isNotNull()), F.lit(False))).first()[0])


def dense_by_index(scores: DataFrame, index: str = "i") -> DataFrame:
    """A row for each index from 0 to the largest; missing scores are NaN."""
    spark = scores.sparkSession
    top = scores.agg(F.max(index)).first()[0]
    every = spark.range(0, (top if top is not None else -1) + 1).select(F.col("id").alias(index))
    doubles = [f.name for f in scores.schema if f.dataType == T.DoubleType()]
    return every.join(scores, index, "left").withColumns({c: F.coalesce(c, F.lit(float("nan"))) for c in doubles})


def read_corpus(df: DataFrame, order: str, most: int, longer: int = 50) -> DataFrame:
    """Of the first ``most`` rows those with a text (or content) of more than ``longer`` characters."""
    text = F.coalesce(F.col("text"), F.col("content")) if "content" in df.columns else F.col("text")
    return df.orderBy(order).limit(most).withColumn("text", text).filter(F.length("text") > longer)


def only(df: DataFrame, key: str, names: str) -> DataFrame:
    """The rows whose key is in a comma-separated list; all of them where that is empty."""
    wanted = [n.strip() for n in names.split(",") if n.strip()]
    return df.filter(F.col(key).isin(wanted)) if wanted else df


def constant_label(df: DataFrame, value: int) -> DataFrame:
    return df.withColumn("label", F.lit(value))


def row_filters(
    df: DataFrame, *, stream: str, order: str, equal: dict[str, str], least: int, most: int, cap: int | None = None
) -> DataFrame:
    """Rows whose columns equal the given values (in any case; unset ones don't count) and whose text has ``least``
    characters; texts are cut to ``most``; the first ``cap`` of each stream."""
    for name, value in equal.items():
        if value:
            df = df.filter(F.lower(F.coalesce(name, F.lit(""))) == value.lower())
    df = df.filter(F.length("text") >= least).withColumn("text", F.left("text", F.lit(most)))
    if cap is None:
        return df
    return df.withColumn(
        "_n", F.row_number().over(Window.partitionBy(stream).orderBy(order))
    ).filter(F.col("_n") <= cap).drop("_n")


def pairs(df: DataFrame) -> DataFrame:
    """member and nonmember columns as rows of text and label."""
    return df.selectExpr("i", "stack(2, member, 1, nonmember, 0) as (text, label)")


def corpus_rows(
    df: DataFrame,
    *,
    text: str | None = None,
    tokens: str | None = None,
    vocabulary: DataFrame | None = None,
    messages: str | None = None,
) -> DataFrame:
    """``df`` with text from a field (or content), from token ids by a vocabulary (token, word), or from chat messages.

    Ids without a word are skipped; messages are joined by line ends.
    """
    if messages is not None:
        parts = F.transform(messages, lambda m: F.coalesce(m["content"], F.lit("")))
        return df.withColumn("text", F.array_join(parts, "\n"))
    if tokens is None:
        name = text or "text"
        found = [F.col(c) for c in (name, "content") if c in df.columns]
        return df.withColumn("text", F.coalesce(*found))
    keyed = stash(df.withColumn("_row", F.monotonically_increasing_id()), "token-rows")
    ids = keyed.select("_row", F.posexplode(tokens).alias("_p", "token"))
    words = ids.join(near(stash(vocabulary.select("token", "word"), "vocabulary")), "token")
    joined = words.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("_p", "word")))["word"].alias("_w"))
    back = keyed.join(joined, "_row", "left")
    return back.withColumn(
        "text", F.array_join(F.coalesce("_w", F.array().cast("array<string>")), " ")
    ).drop("_row", "_w")


def open_first(readers: Sequence[Callable[[], DataFrame]]) -> DataFrame:
    """The first table that can be opened, its schema included; the last error if none can."""
    failed: Exception | None = None
    for read in readers:
        try:
            found = read()
            found.schema  # noqa: B018
            return found
        except Exception as e:  # noqa: BLE001
            failed = e
    raise failed if failed else ValueError("no source is given")


def prefix_stream(
    sources: Sequence[tuple[str, str | None, Callable[[], DataFrame]]], min_chars: int, text_col: str = "text"
) -> DataFrame:
    """Trimmed texts of at least ``min_chars`` from the first readable source; one of a name and configuration is tried once."""
    tried: dict[tuple[str, str | None], Callable[[], DataFrame]] = {}
    for name, config, read in sources:
        tried.setdefault((name, config), read)
    texts = open_first(list(tried.values())).select(F.trim(text_col).alias("text"))
    return texts.filter(F.length("text") >= min_chars)


def web_text_records(spark: SparkSession, path: str, language: str = "eng") -> DataFrame:
    """Texts of web text archives (file, n, text) in a language; records are split where they begin, not by file.

    As in ``web_text_split``, the last record of a file is left out.
    """
    parts = _numbered(spark.read.option("lineSep", "WARC/1.0").text(path))
    last = parts.groupBy(F.col("file").alias("_f")).agg(F.max("i").alias("last"))
    inner = parts.join(F.broadcast(last), F.col("file") == F.col("_f")).filter("i > 0 and i < last")
    return _in_language(inner.select("file", F.col("i").alias("n"), F.split("value", "\r?\n").alias("l")), language)


def web_text_split(archives: DataFrame, language: str = "eng") -> DataFrame:
    """Records of whole archives (file, value) whose 8th line names the language first; the body starts at the 11th.

    The last record of a file is left out, as an archive's end is often cut off.
    """
    parts = archives.select("file", F.posexplode(F.split("value", "WARC/1.0")).alias("n", "record"))
    last = F.max("n").over(Window.partitionBy("file"))
    lines = parts.withColumn("last", last).filter("n > 0 and n < last").select(
        "file", "n", F.split("record", "\r?\n").alias("l")
    )
    return _in_language(lines, language)


def _in_language(lines: DataFrame, language: str) -> DataFrame:
    named = F.get("l", F.lit(7)).contains(f"WARC-Identified-Content-Language: {language}")
    return lines.filter(named).select("file", "n", F.array_join(F.slice("l", 11, 1_000_000_000), "\n").alias("text"))


def by_model(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """Reports of all models in one scan; the model is the parent folder's name."""
    return spark.read.schema(schema).json(pattern.replace("{model}", "*")).withColumn(
        "model", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1)
    )


def runs_in(spark: SparkSession, folder: str) -> DataFrame:
    """run: the folders that hold samples or a run's metadata, as Spark lists them (any store)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    found = files.option("pathGlobFilter", "{samples*.jsonl,run_meta.json}").load(folder).select("path")
    return found.select(F.regexp_extract("path", r"^(.*)/[^/]+$", 1).alias("run")).distinct()


def read_config(path: str) -> dict:
    """A YAML or JSON file (JSON is YAML's subset; without a YAML reader only that is read)."""
    text = Path(path).read_text()
    try:
        import yaml
    except ImportError:
        return json.loads(text)
    return yaml.safe_load(text) or {}


THRESHOLDS = "gleanspark.thresholds.v1"


def write_thresholds(rows: DataFrame, path: str, schema: str = THRESHOLDS, **provenance: object) -> dict:
    """A small table (metric, threshold, higher) as a document of a named schema, with where it comes from."""
    found = {r.metric: {"threshold": r.threshold, "higher_is_member": bool(r.higher)} for r in rows.collect()}
    document = {"schema": schema, **provenance, "thresholds": found}
    write_tree(document, path)
    return document


def read_thresholds(path: str, metrics: Sequence[str], schema: str = THRESHOLDS) -> dict[str, tuple[float, bool]]:
    """Threshold and direction by metric; an error for another schema or a missing metric."""
    document = json.loads(Path(path).read_text())
    if document.get("schema") != schema:
        raise ValueError(f"{path} has the schema {document.get('schema')}, not {schema}")
    found = document.get("thresholds") or {}
    missing = [m for m in metrics if m not in found]
    if missing:
        raise ValueError(f"{path} has no {missing}")
    return {m: (float(found[m]["threshold"]), bool(found[m]["higher_is_member"])) for m in metrics}


def write_index(index: DataFrame, path: str, size: int) -> None:
    """A shingle index with the length of its shingles."""
    index.select(
        "hash", F.lit(size).alias("shingle_chars")
    ).write.mode("overwrite").partitionBy("shingle_chars").parquet(path)


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    found = spark.read.schema("hash string, shingle_chars int").parquet(path)
    sizes = [r[0] for r in found.select("shingle_chars").distinct().limit(2).collect()]
    if len(sizes) != 1:
        raise ValueError(f"{path} has shingles of {sizes or 'no'} lengths")
    return found.select("hash"), sizes[0]


def write_splits(rows: DataFrame, path: str, index: str = "i") -> None:
    """Per-sample rows (index, label, source, split, scores) as JSON lines, below a folder for each split."""
    rows.withColumn("_split", F.col("split")).write.mode("overwrite").partitionBy("_split").json(path)


def read_splits(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("recursiveFileLookup", True).json(path)


def merge_config(base: dict, over: dict) -> dict:
    out = dict(base)
    for k, v in over.items():
        out[k] = merge_config(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def override(config: dict, setting: str) -> dict:
    """``a.b=value`` with true, false, null, digits and floats read as such."""
    path, _, raw = setting.partition("=")
    words = {"true": True, "false": False, "null": None, "none": None}
    if raw.lower() in words:
        value = words[raw.lower()]
    elif raw.isdigit():
        value = int(raw)
    else:
        try:
            value = float(raw)
        except ValueError:
            value = raw
    for key in reversed(path.split(".")):
        value = {key: value}
    return merge_config(config, value)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def metric_tree(rows: DataFrame, keys: Sequence[str], value: str) -> dict:
    """A small long table as a nested dict; NaN becomes null."""
    tree: dict = {}
    for r in rows.collect():
        at = tree
        for k in keys[:-1]:
            at = at.setdefault(str(r[k]), {})
        v = r[value]
        at[str(r[keys[-1]])] = None if isinstance(v, float) and not math.isfinite(v) else v
    return tree


def write_tree(tree: dict, path: str) -> None:
    Path(path).write_text(json.dumps(tree, ensure_ascii=False, indent=2))


#: Rows of the wide table, in this order; others follow by name (fixed values).
WIDE_ROWS = ("Perplexity", "zlib", "Lowercase", "Window", "Small")


def wide(
    rows: DataFrame, row: str, columns: Sequence[str], value: str, places: int = 2, names: Sequence[str] | None = None
) -> DataFrame:
    """One row per ``row`` (with its place) and a column per combination of ``columns``, as text with fixed decimals.

    ``names`` are the combinations to show (present or not); without them all are looked up first.
    """
    name = F.concat_ws("_P@", *(F.col(c).cast("string") for c in columns))
    got = rows.withColumn("_c", name).groupBy(row).pivot("_c", list(names) if names else None).agg(
        F.first(F.format_string(f"%.{places}f", F.col(value)))
    )
    known = F.array_position(F.array(*map(F.lit, WIDE_ROWS)), F.col(row))
    return got.withColumn("place", F.when(known > 0, known).otherwise(F.lit(len(WIDE_ROWS) + 1)))


def flat(rows: DataFrame, keys: Sequence[str], k: str, value: str, ks: Sequence[int]) -> DataFrame:
    """One row for the keys and a column P@k for each k, with up to four decimals."""
    got = rows.groupBy(*keys).pivot(k, list(ks)).agg(F.first(short_number(value)))
    return got.select(*keys, *(F.col(str(x)).alias(f"P@{x}") for x in ks))


def markdown_by_model(rows: DataFrame, ks: Sequence[int]) -> str:
    """A small long table (model, metric, source, k, precision) as a section for each model and metric, three decimals."""
    found: dict[str, dict[str, dict[str, dict[int, float | None]]]] = {}
    for r in rows.orderBy("model", "metric", "source", "k").collect():
        found.setdefault(r.model, {}).setdefault(r.metric, {}).setdefault(r.source, {})[r.k] = r.precision
    out = []
    for model, metrics in found.items():
        for metric, sources in metrics.items():
            shown = lambda v: None if v is None or math.isnan(v) else f"{v:.3f}"
            lines = [{"source": s, **{f"P@{k}": shown(p.get(k)) for k in ks}} for s, p in sources.items()]
            out.append(f"## {model}: {metric}\n\n" + markdown(lines, ["source", *(f"P@{k}" for k in ks)]))
    return "\n\n".join(out)


def short_number(x: str, places: int = 4) -> Column:
    """A number with up to ``places`` (at least one) decimals, trailing zeros dropped."""
    return F.regexp_replace(F.format_string(f"%.{places}f", F.col(x)), r"\.?0+$", "")


def markdown(rows: list[dict], columns: Sequence[str]) -> str:
    head = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    return "\n".join(
        head + ["| " + " | ".join("N/A" if r.get(c) is None else str(r[c]) for c in columns) + " |" for r in rows]
    )


def html(rows: list[dict], columns: Sequence[str]) -> str:
    import html as h

    cell = lambda t, v: f"<{t}>{h.escape('' if v is None else str(v))}</{t}>"
    body = "".join("<tr>" + "".join(cell("td", r.get(c)) for c in columns) + "</tr>" for r in rows)
    return f"<table><tr>{''.join(cell('th', c) for c in columns)}</tr>{body}</table>"


def shard_number(name: Column) -> Column:
    """Trailing number of a shard's file name, -1 without one."""
    return F.coalesce(F.regexp_extract(name, r"_(\d+)\.json$", 1).try_cast("long"), F.lit(-1).cast("long"))


def example_seed(seed: int, example: int, mode: int) -> int:
    """Seed of one example and mode of a decoding benchmark (fixed values)."""
    return seed + 10_000 * example + 100 * mode


#: Where samples come from, in reporting order: the strategies, then the decoding modes (fixed values).
STRATEGIES = (
    "top_k", "top_k_internet", "temperature_decay", "temperature_decay_internet", "nucleus", "nucleus_internet"
)
DECODERS = (
    "memorization_baseline",
    "memorization_topk_control",
    "memorization_risk_fast",
    "memorization_risk_slow",
    "memorization_wbc",
    "memorization_wbc_no_infilling",
    "memorization_cheap_logits",
    "memorization_contrastive",
    "memorization_ppl_gated_contrastive",
    "memorization_resample_contrastive",
    "memorization_sparse_infilling",
)


def source_table(spark: SparkSession) -> DataFrame:
    """place, source and family of each kind of sample."""
    named = [(s, "sampling") for s in STRATEGIES] + [(s, "decoding") for s in DECODERS]
    return spark.createDataFrame(
        [(k, s, f) for k, (s, f) in enumerate(named)], "place long, source string, family string"
    )
