"""Naive Bayes over versions of documents, against the form with a row for each document and term."""

import random

from pyspark.sql import functions as F

from redpen.operators import classify


def test_runs_are_classified_as_documents_are(spark):
    rng = random.Random(8)
    text = lambda: [rng.choice("abcdefgh") for _ in range(rng.randrange(7))]
    train = spark.createDataFrame([(i, i % 3, text()) for i in range(60)], "doc_id long, y int, words array<string>").repartition(3)
    tf = classify.terms(train, F.col("words"), ["doc_id", "y"])
    model, prior = classify.naive_bayes(tf, "y")
    new_model, new_prior = classify.naive_bayes_of_words(train, "y")
    assert sorted(model.collect()) == sorted(new_model.collect()) and sorted(prior.collect()) == sorted(new_prior.collect())
    versions = [(i, run, text()) for i in range(40) for run in ("noisy", "safety", "other")]
    texts = spark.createDataFrame(versions, "doc_id long, run string, words array<string>").repartition(4)
    runs = ("noisy", "safety")
    got = classify.predicted_runs(texts, runs, new_model, new_prior, "y").collect()
    assert len(got) == 40
    for run in runs:
        tf = classify.terms(texts.where(F.col("run") == run), F.col("words"), ["doc_id"])
        want = dict(classify.predicted(classify.naive_bayes_scores(tf, model, prior, "y"), "y").collect())
        assert {r["doc_id"]: r[run] for r in got if r[run] is not None} == want


def test_four_runs_leaves_no_files_of_the_corrector(spark, tmp_path):
    import os

    from redpen.operators.tables import shared_folder
    from redpen.plans.queries import QUERIES

    shared = shared_folder(spark).removeprefix("file:")
    texts = [" ".join([("apple", "banana", "cherry")[i % 3], "common"] * 4 + [f"extra{'abcdefg'[i % 7]}"]) for i in range(90)]
    spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(90).select(F.col("id").alias("doc_id"), (F.col("id") % 3 == 0).cast("int").alias("quality")).write.parquet(f"{tmp_path}/labels.parquet")
    before = set(os.listdir(shared))
    rows = QUERIES["four_runs"](spark, str(tmp_path))
    left = set(os.listdir(shared)) - before
    assert not [x for x in left if x.startswith("repair")] and len(left) == 3  # split rows, their versions, counts of classes
    assert rows.count() > 0
