"""Training in blocks of features, against Spark's own classifiers."""

import random

import pytest
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from redpen.operators import classify, descent


@pytest.fixture(scope="module")
def frame(spark):
    rng = random.Random(6)
    rows = []
    for i in range(300):
        y = int(rng.random() < 0.7)
        slots = sorted(rng.sample(range(400), 25) if rng.random() < 0.3 else {min(399, int(rng.expovariate(0.01)) + 20 * y) for _ in range(30)})
        rows.append((i, float(y), Vectors.sparse(400, slots, [rng.random() / 5 for _ in slots]), 1 / (0.6 + y), i % 4 == 0))
    return spark.createDataFrame(rows, ["doc_id", "label", "features", "class_weight", "is_test"]).repartition(5).cache()


@pytest.mark.parametrize("hinge", [False, True])
def test_margins_are_those_of_spark(spark, frame, hinge):
    train = frame.where("NOT is_test")
    n = train.count()
    if hinge:
        model = LinearSVC(weightCol="class_weight", maxIter=30, regParam=0.01).fit(train)
    else:
        model = LogisticRegression(weightCol="class_weight", regParam=1 / n, standardization=False, maxIter=50).fit(train)
    want = {r["doc_id"]: r["z"] for r in model.transform(frame).select("doc_id", vector_to_array("rawPrediction")[1].alias("z")).collect()}
    m = descent.Matrix(frame, "doc_id", "is_test")
    assert m.n_blocks > 1
    got = descent.train(m, m.class_weight * ~m.more["is_test"], 0.01 if hinge else 1 / n, 30 if hinge else 50, hinge)
    for i, z in zip(m.more["doc_id"], got, strict=True):
        assert z == pytest.approx(want[i], rel=1e-4, abs=1e-4)
    m.remove()


def test_scores_without_a_vector_of_features_on_the_driver(spark, frame, monkeypatch):
    train, test = frame.where("NOT is_test"), frame.where("is_test")
    from redpen.operators import evaluate

    want = evaluate.scores(classify.logistic(train).transform(test), "label", "prediction").collect()
    line = classify.linear_svm(frame)[1]
    monkeypatch.setattr(classify, "_logistic", None)
    monkeypatch.setattr(classify, "linear_svm", None)
    assert classify.held_out_scores(frame).collect() == want
    got = classify.svm_calibration(frame)
    assert got.coefficients[0] == pytest.approx(line.coefficients[0], rel=1e-3) and got.intercept == pytest.approx(line.intercept, rel=1e-3, abs=1e-3)


def test_cells_are_the_weights_of_tfidf(spark):
    rows = spark.createDataFrame([(i, f"word{(i * 7 + k * k) % 13:02d}", 1 + k % 3) for i in range(40) for k in range(6)], "doc_id long, term string, tf long").dropDuplicates(["doc_id", "term"]).repartition(3)
    df = classify.doc_frequency(rows, 40)
    vocabulary, size = classify.vocabulary(df)
    terms = {r["slot"]: r["term"] for r in vocabulary.collect()}
    assert size == len(terms) and list(map(terms.get, range(size))) == sorted(terms.values())
    want = {(r["doc_id"], r["term"]): r["weight"] for r in classify.tfidf(rows, df, 40).collect()}
    got = {(r["doc_id"], terms[x["slot"]]): x["w"] for r in classify.tfidf_cells(rows, vocabulary, 40).collect() for x in r["c"]}
    assert got.keys() == want.keys() and all(abs(got[k] - w) < 1e-12 for k, w in want.items())
