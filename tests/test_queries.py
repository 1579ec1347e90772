"""Registered queries on small tables, against brute force."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from redpen.operators import candidates as cand, classify, evaluate
from redpen.plans.queries import QUERIES, predictions


def documents(spark, folder, texts):
    spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_confusion_pairs_finds_neighbours_behind_80_more_frequent_words(spark, tmp_path):
    far = [f"{a}{b}rd" for a in "abcdefghij" for b in "abcdefghik"]
    near = ["sord", "ward", "wore"]
    words = ["word"] * 10 + near * 10 + far * 20
    got = {(r["wrong"], r["k"]) for r in QUERIES["confusion_pairs"](spark, documents(spark, tmp_path, [" ".join(words)])).where("expected = 'word'").collect()}
    assert got == {("sord", 1), ("ward", 2), ("wore", 3)}


def test_deletion_index_holds_all_words_of_count_3(spark, tmp_path):
    counts = {"treatment": 12, "infection": 10, "infections": 9, "patient": 3, "patients": 2, "an": 3}
    sf_dir = documents(spark, tmp_path, [" ".join(w for w, n in counts.items() for _ in range(n))])
    once = lambda w: {w[:i] + w[i + 1 :] for i in range(len(w))}
    keys = {w: {w} | once(w) | {y for x in once(w) for y in once(x)} for w, n in counts.items() if n >= 3}
    n_words, first = Counter(k for x in keys.values() for k in x), {}
    for w in sorted(keys, reverse=True):
        first |= dict.fromkeys(keys[w], w)
    got = {(r["del_key"], r["n_words"], r["first_word"]) for r in QUERIES["deletion_index"](spark, sf_dir).collect()}
    assert got == {(k, n, first[k]) for k, n in n_words.items()}


def test_feature_frame_has_one_feature_a_term(spark):
    names = [f"term {i:05d}" for i in range(2000)]
    rows = [(d, t, float(1 + i)) for d in range(2) for i, t in enumerate(names) if (i + d) % 3]
    weights = spark.createDataFrame(rows, "doc_id long, term string, weight double").repartition(5)
    labels = spark.createDataFrame([(0, 0), (1, 1)], "doc_id long, y int")
    got = {r["doc_id"]: r["features"] for r in classify.feature_frame(weights, labels, "y").collect()}
    for d, x in got.items():
        assert x.size == len(names) and dict(zip(x.indices.tolist(), x.values.tolist(), strict=True)) == {names.index(t): w for e, t, w in rows if e == d}


def test_topic_queries_use_as_many_features_as_terms(spark, tmp_path, monkeypatch):
    texts = [" ".join(f"{'ab'[i % 2]}{chr(97 + (i + k) % 26)}{chr(97 + k % 26)}" for k in range(40)) for i in range(40)]
    sf_dir = documents(spark, tmp_path, texts)
    spark.range(40).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality")).write.parquet(f"{sf_dir}/labels.parquet")
    grams = [Counter({*t.split(), *map(" ".join, zip(t.split(), t.split()[1:], strict=False))}) for t in texts]
    terms = sum(2 <= n <= 0.95 * len(texts) for n in sum(grams, Counter()).values())
    sizes, frame = [], classify.feature_frame

    def only_frame(*args):
        sizes.append(frame(*args).first()["features"].size)
        raise StopIteration

    monkeypatch.setattr(classify, "feature_frame", only_frame)
    for name in ("svm_topic", "logreg_topic"):
        with pytest.raises(StopIteration):
            QUERIES[name](spark, sf_dir)
    assert sizes == [terms, terms]


def test_candidates_of_long_words(spark):
    rng = random.Random(4)
    known = ["".join(rng.choice("abcde") for _ in range(n)) for n in (28, 29, 30, 31, 32, 33, 36, 47, 120)]
    asked, want = [], set()
    for w in known:
        for _ in range(25):
            t = w
            for _ in range(rng.choice([1, 2])):
                i, op = rng.randrange(len(t) - 1), rng.randrange(4)
                t = t[:i] + ("z" + t[i + 1 :], "z" + t[i:], t[i + 1 :], t[i + 1] + t[i] + t[i + 2 :])[op]
            if t not in known:
                asked.append(t)
                want.add((t, w))
    x, y = known[5], len(known[5]) // 5
    astride = x[: y - 1] + x[y] + x[y - 1] + x[y + 1 : 3 * y - 1] + x[3 * y] + x[3 * y - 1] + x[3 * y + 1 :]
    asked += [astride]
    want |= {(astride, x)} if astride != x else set()
    tokens = spark.createDataFrame([(t,) for t in asked], "tok string")
    counts = spark.createDataFrame([(w, 5) for w in known], "word string, cnt long")
    got = cand.candidates(tokens, counts).collect()
    assert {(r["tok"], r["cand"]) for r in got} == want and len(got) == len(want) and {r["dist"] for r in got} == {1, 2}


def test_prob_shift_is_a_shift_of_shares(spark, tmp_path):
    # the runs classify real documents, so there have to be some
    documents(spark, tmp_path, [" ".join([("apple", "banana", "cherry")[i % 3], "common"] * 4 + [f"extra{'abcdefg'[i % 7]}"]) for i in range(90)])
    spark.range(90).select(F.col("id").alias("doc_id"), (F.col("id") % 3 == 0).cast("int").alias("quality")).write.parquet(f"{tmp_path}/labels.parquet")
    runs = predictions(spark, str(tmp_path)).collect()
    got = {r["label"]: r for r in QUERIES["prob_shift"](spark, str(tmp_path)).collect()}
    assert sorted(got) == ["0", "1"]
    for label, r in got.items():
        before, after = (sum(str(x[c]) == label for x in runs) / len(runs) for c in ("noisy", "safety"))
        assert r["before_milli"] == math.floor(before * 1000 + 0.5) and r["after_milli"] == math.floor(after * 1000 + 0.5)
        assert r["delta_milli"] == math.floor((after - before) * 1000 + 0.5)


def test_label_cap_and_bootstrap_take_their_production_sizes(spark, tmp_path):
    sf_dir = documents(spark, tmp_path, ["x" * 80 + " thing shed ble"] * 70)
    assert QUERIES["label_cap"](spark, sf_dir).count() == 70
    spark.range(60).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality")).write.parquet(f"{sf_dir}/labels.parquet")
    want = evaluate.bootstrap(predictions(spark, sf_dir), "truth", "noisy", "restored", 1000).collect()
    assert QUERIES["bootstrap_ci"](spark, sf_dir).collect() == want
