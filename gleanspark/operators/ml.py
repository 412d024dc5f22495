"""Compression lengths, the member forest and the sequential decode loop: what SQL has no words for."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType
from pyspark.sql.window import Window

from gleanspark.functions.text import DECAY


@F.arrow_udf(LongType())
def zlib_length(texts: pa.Array) -> pa.Array:
    """Bytes of the compressed UTF-8 text; null counts as empty.  Texts are read where Arrow holds them, not copied."""
    return pa.array([len(zlib.compress(t.as_buffer() or b"")) for t in texts], pa.int64())


def fit_forest(df: DataFrame, vec: str, label: str, *, trees: int = 50, depth: int = 5, seed: int = 0) -> PipelineModel:
    """Standardized random forest with balanced class weights n / (2 n_c)."""
    n = df.groupBy(label).count().withColumn("_w", F.sum("count").over(Window.partitionBy()) / (2 * F.col("count")))
    rows = df.join(F.broadcast(n.select(label, "_w")), label).withColumn(
        "_v", array_to_vector(F.transform(vec, lambda x: x.cast("double")))
    )
    scaler = StandardScaler(inputCol="_v", outputCol="_s", withMean=True)
    forest = RandomForestClassifier(
        featuresCol="_s", labelCol=label, weightCol="_w", numTrees=trees, maxDepth=depth, seed=seed
    )
    return Pipeline(stages=[scaler, forest]).fit(rows)


def member_probability(model: PipelineModel, df: DataFrame, vec: str) -> DataFrame:
    rows = df.withColumn("_v", array_to_vector(F.transform(vec, lambda x: x.cast("double"))))
    return model.transform(rows).withColumn("p_member", vector_to_array("probability")[1]).drop(
        "_v", "_s", "rawPrediction", "probability", "prediction"
    )


def score_texts(df: DataFrame, key: str, column: str, score: Callable[[list], list[float]]) -> DataFrame:
    """key and score of every row: ``score`` gets the column's values of a batch and gives as many numbers.

    What the function needs (a model) is sent with it once a worker; batches are Arrow's.
    """

    def run(batches):
        for part in batches:
            yield pd.DataFrame({key: part[key], "score": [float(x) for x in score(part[column].tolist())]})

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, column).mapInPandas(run, f"`{key}` {kind}, score double")


def save_forests(models: dict[str, PipelineModel], path: str, spark: SparkSession) -> None:
    """One artifact for each preset below ``path``, and a manifest of their names."""
    for preset, model in models.items():
        model.write().overwrite().save(f"{path}/models/{preset}")
    spark.createDataFrame(
        [(p,) for p in sorted(models)], "preset string"
    ).coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def apply_forest(spark: SparkSession, path: str, preset: str, df: DataFrame, vec: str) -> DataFrame:
    """Probabilities by a stored artifact; an error for a preset that the manifest lacks."""
    known = [r.preset for r in spark.read.schema("preset string").json(f"{path}/manifest").collect()]
    if preset not in known:
        raise ValueError(f"no artifact for {preset}; there are {known}")
    return member_probability(PipelineModel.load(f"{path}/models/{preset}"), df, vec)


def decode(
    prompts: DataFrame,
    successors: dict[str, list[tuple[str, float]]],
    *,
    steps: int = 16,
    temperature: float = 1.0,
    seed: int = 0,
    mode: str = "baseline",
    top_k: int = 20,
    share: float = 0.95,
    strength: float = 0.35,
) -> DataFrame:
    """id and the words drawn step by step from a bounded table of successors, one prompt (id, last) at a time.

    Modes: baseline (all successors), top_k, nucleus (the fewest that hold ``share``), decay (temperatures fall over the
    first twenty lengths) and cheap (log-probabilities less a share of their own scaled values).
    """

    def chances(options: list[tuple[str, float]], length: int) -> np.ndarray:
        lp = np.array([x for _, x in options])
        if mode == "decay":
            lp = lp / (DECAY[length - 1] if 1 <= length <= len(DECAY) else 1.0)
        if mode == "cheap" and np.ptp(lp) >= 1e-8:
            lp = lp - strength * (lp - lp.min()) / (np.ptp(lp) + 1e-8)
        p = np.exp((lp - lp.max()) / temperature)
        p /= p.sum()
        order = np.argsort(-p, kind="stable")
        if mode == "top_k":
            p[order[top_k:]] = 0
        elif mode == "nucleus":
            p[order[np.cumsum(p[order]) - p[order] >= share]] = 0
        elif mode not in ("baseline", "cheap", "decay"):
            raise ValueError(f"no such mode: {mode}")
        return p / p.sum()

    def run(batches):
        for part in batches:
            out = []
            for i, last in zip(part["id"], part["last"], strict=True):
                rng, words, now = np.random.default_rng([seed, int(i)]), [], last
                for step in range(steps):
                    if not (options := successors.get(now)):
                        break
                    now = options[rng.choice(len(options), p=chances(options, step + 1))][0]
                    words.append(now)
                out.append((i, words))
            yield pd.DataFrame(out, columns=["id", "words"])

    return prompts.select("id", "last").mapInPandas(run, "id long, words array<string>")
