"""Streaming ingest: a growing shingle index and per-batch scoring."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gleanspark.operators.shingles import normalized, shingle_hashes


def stream_index(spark: SparkSession, folder: str, schema: str, id_col: str, size: int, out: str, checkpoint: str):
    """Append each new distinct hash of the texts that arrive in ``folder`` to the index in ``out``."""
    texts = spark.readStream.schema(schema).json(folder)
    hashes = shingle_hashes(normalized(texts, id_col), size).select("hash").dropDuplicates(["hash"])
    return hashes.writeStream.format("parquet").option(
        "checkpointLocation", checkpoint
    ).trigger(availableNow=True).start(out)


def score_batches(stream: DataFrame, score: Callable[[DataFrame], DataFrame], out: str, checkpoint: str):
    """Score each micro-batch and append it once: a batch's folder is overwritten if the batch is run again."""

    def one(batch: DataFrame, number: int) -> None:
        score(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(one).option(
        "checkpointLocation", checkpoint
    ).trigger(availableNow=True).start()
