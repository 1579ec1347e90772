"""Correction of a stream of documents against stored model tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from redpen.operators.correct import correct_tokens, doc_summary
from redpen.params import Params


def documents(spark: SparkSession, folder: str, schema: str = "doc_id long, text string") -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def correct_stream(stream: DataFrame, unigrams: DataFrame, bigrams: DataFrame, out: str, checkpoint: str, params: Params = Params()):
    """Each micro-batch is corrected as a batch is; tokens and summaries are appended. A batch that is run again overwrites its own folder."""

    def each(batch: DataFrame, number: int) -> None:
        rows = correct_tokens(batch, unigrams, bigrams, params)
        rows.write.mode("overwrite").parquet(f"{out}/tokens/batch={number}")
        doc_summary(batch.sparkSession.read.parquet(f"{out}/tokens/batch={number}")).write.mode("overwrite").parquet(f"{out}/summaries/batch={number}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
