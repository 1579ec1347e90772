"""Readers and writers: CSV, text, JSON lines, model tables with a manifest, trained pipelines, typo maps."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from redpen.params import Params

METADATA = T.StructType([T.StructField("title", T.StringType()), T.StructField("abstract", T.StringType())])
CASES = T.StructType([T.StructField(c, T.StringType()) for c in ("case_id", "source", "category", "subcategory", "prev", "wrong", "next", "expected", "note", "fragment")])
TRACE = "_type string, token string, position int, protected boolean, gate string, decision string, margin double, error_type string, corrected_token string, doc_id string, total_tokens int, tokens_changed int, edit_rate double"


def exists(spark: SparkSession, path: str) -> bool:
    """Asked of the file system that holds the path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_csv(spark: SparkSession, path: str, schema: T.StructType = METADATA, missing_ok: bool = False) -> DataFrame:
    """All text, quoted line breaks allowed; only the columns of the schema. A missing file is an empty table if that is allowed."""
    if missing_ok and not exists(spark, path):
        return spark.createDataFrame([], schema)
    everything = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    have = {c.lower(): c for c in everything.columns}
    if lacking := [f.name for f in schema if f.name.lower() not in have]:
        raise ValueError(f"columns {lacking} are not among {everything.columns}")
    return everything.select(*[F.col(f"`{have[f.name.lower()]}`").cast(f.dataType).alias(f.name) for f in schema])


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("line")).where("line <> ''")


def read_traces(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Token traces and document summaries of one JSON-lines file."""
    rows = spark.read.schema(TRACE).json(path)
    summary = F.col("_type").eqNullSafe("doc_summary")
    return rows.where(~summary), rows.where(summary)


def truncated(text, most: int = 500):
    return F.substring(text, 1, most)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_lines(df: DataFrame, path: str, column: str = "line") -> None:
    df.select(column).write.mode("overwrite").text(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def report_json(df: DataFrame) -> DataFrame:
    """One JSON column of a report row."""
    return df.select(F.to_json(F.struct(*df.columns), {"pretty": "true"}).alias("value"))


def content_hash(df: DataFrame, digits: int = 64) -> str:
    """SHA-256 over order-free content: per-row hashes are summed, so no rows are gathered."""
    rows = df.select(F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256).alias("h"))
    parts = [F.sum(F.conv(F.substring("h", 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)")).cast("string") for i in range(5)]
    return rows.agg(F.sha2(F.concat_ws("|", F.count("*").cast("string"), *parts), 256).alias("x")).first()["x"][:digits]


def save_model(folder: str, unigrams: DataFrame, bigrams: DataFrame, params: Params = Params(), source: str = "") -> dict:
    """Write the tables and a manifest with their hashes; returns the manifest."""
    spark = unigrams.sparkSession
    unigrams.write.mode("overwrite").parquet(f"{folder}/unigrams")
    bigrams.write.mode("overwrite").parquet(f"{folder}/bigrams")
    u, b = spark.read.parquet(f"{folder}/unigrams"), spark.read.parquet(f"{folder}/bigrams")
    vocab = u.where(F.col("cnt") >= params.min_count).select("word")
    vocab.write.mode("overwrite").parquet(f"{folder}/vocab")
    manifest = {"version": content_hash(vocab, 12), "source": source, "params": params.version, "hashes": {"vocab": content_hash(vocab), "unigrams": content_hash(u), "bigrams": content_hash(b)}}
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/manifest")
    return manifest


def load_model(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, str]:
    """(unigrams, bigrams, version): the manifest's version, else the vocabulary's hash."""
    u, b = spark.read.parquet(f"{folder}/unigrams"), spark.read.parquet(f"{folder}/bigrams")
    if exists(spark, f"{folder}/manifest"):
        return u, b, json.loads(spark.read.text(f"{folder}/manifest").first()["value"])["version"]
    return u, b, content_hash(spark.read.parquet(f"{folder}/vocab"), 12)


def load_pipeline(path: str):
    from pyspark.ml import PipelineModel

    return PipelineModel.load(path)


def typo_map(spark: SparkSession, folder: str) -> DataFrame:
    """(typo, word) of the first file there is of typo_map.json, .tsv and .csv; empty if none."""
    empty = spark.createDataFrame([], "typo string, word string")
    if exists(spark, f"{folder}/typo_map.json"):
        rows = spark.read.option("wholetext", True).text(f"{folder}/typo_map.json")
        return rows.select(F.explode(F.from_json("value", "map<string,string>")).alias("typo", "word")).select(F.lower("typo").alias("typo"), F.lower("word").alias("word"))
    for name, sep in (("typo_map.tsv", "\t"), ("typo_map.csv", ",")):
        if exists(spark, f"{folder}/{name}"):
            return spark.read.schema("typo string, word string").option("sep", sep).csv(f"{folder}/{name}").select(F.lower("typo").alias("typo"), F.lower("word").alias("word"))
    return empty
