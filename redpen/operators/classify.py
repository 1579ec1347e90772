"""TF-IDF in long form, classifiers, and explanations."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from redpen.operators import descent
from redpen.operators.tables import materialized


def grams(w: Column) -> Column:
    """One- and two-word terms of an array of words."""
    n = F.greatest(F.size(w) - 1, F.lit(0))
    return F.concat(w, F.zip_with(F.slice(w, 1, n), F.slice(w, 2, n), lambda a, b: F.concat_ws(" ", a, b)))


def terms(df: DataFrame, words: Column, keys: list[str]) -> DataFrame:
    """(keys, term, tf): one- and two-word terms of an array of words."""
    rows = df.select(*keys, words.alias("w"))
    return rows.select(*keys, F.explode(grams(F.col("w"))).alias("term")).groupBy(*keys, "term").agg(F.count("*").alias("tf"))


def doc_frequency(tf: DataFrame, n_docs: int | Column, min_df: int = 2, max_df: float = 0.95) -> DataFrame:
    """(term, df, total) of the terms in at least min_df documents and at most that share of them."""
    n = n_docs if isinstance(n_docs, Column) else F.lit(n_docs)
    return tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total")).where((F.col("df") >= min_df) & (F.col("df") <= max_df * n))


def max_features(df: DataFrame, k: int) -> DataFrame:
    """The k terms of highest corpus count."""
    return df.orderBy(F.desc("total"), "term").limit(k)


def tfidf(tf: DataFrame, df: DataFrame, n_docs: int, key: str = "doc_id") -> DataFrame:
    """(key, term, tf, weight): sublinear counts times smoothed inverse document frequency, each document of length one."""
    raw = tf.join(df, "term").select(key, "term", "tf", ((1 + F.log("tf")) * (F.log((F.lit(1.0) + n_docs) / (F.lit(1.0) + F.col("df"))) + 1)).alias("raw"))
    norms = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    return raw.join(norms, key).select(key, "term", "tf", (F.col("raw") / F.col("norm")).alias("weight"))


def naive_bayes(tf: DataFrame, label: str, alpha: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Multinomial model from (doc_id, label, term, tf): (label, term, logp, unseen) and (label, prior)."""
    return _bayes(tf.groupBy(label, "term").agg(F.sum("tf").alias("n")), tf.select("doc_id", label).distinct(), label, alpha)


def naive_bayes_of_words(rows: DataFrame, label: str, alpha: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """The same from (doc_id, label, words), without a row for each document and term; counts of classes are all that is shuffled."""
    counts = rows.select(label, F.explode(grams(F.col("words"))).alias("term")).groupBy(label, "term").agg(F.count("*").alias("n"))
    return _bayes(materialized(counts), rows.where(F.size("words") > 0).select("doc_id", label).distinct(), label, alpha)


def _bayes(counts: DataFrame, documents: DataFrame, label: str, alpha: float) -> tuple[DataFrame, DataFrame]:
    types = counts.select("term").distinct().agg(F.count("*").alias("v"))
    sums = counts.groupBy(label).agg(F.sum("n").alias("total")).crossJoin(F.broadcast(types))  # a row a class
    model = counts.join(F.broadcast(sums), label).select(label, "term", F.log((F.col("n") + alpha) / (F.col("total") + alpha * F.col("v"))).alias("logp"))
    docs = documents.groupBy(label).agg(F.count("*").alias("n_docs"))
    prior = docs.join(F.broadcast(sums), label).select(label, "n_docs", F.log(F.lit(alpha) / (F.col("total") + alpha * F.col("v"))).alias("unseen"))
    return model, prior


def naive_bayes_scores(tf: DataFrame, model: DataFrame, prior: DataFrame, label: str) -> DataFrame:
    """(doc_id, label, score) of every document and class: seen terms by their log probability, others by the class's floor."""
    total = prior.agg(F.sum("n_docs").alias("all_docs"))
    base = tf.groupBy("doc_id").agg(F.sum("tf").alias("length"))
    hits = tf.select("doc_id", "term", "tf").join(model, "term").join(F.broadcast(prior.select(label, "unseen")), label).groupBy("doc_id", label).agg(F.sum(F.col("tf") * (F.col("logp") - F.col("unseen"))).alias("gain"))
    grid = base.crossJoin(F.broadcast(prior)).crossJoin(F.broadcast(total))  # documents by classes
    return grid.join(hits, ["doc_id", label], "left").select("doc_id", label, (F.log(F.col("n_docs") / F.col("all_docs")) + F.col("length") * F.col("unseen") + F.coalesce("gain", F.lit(0.0))).alias("score"))


def predicted(scores: DataFrame, label: str) -> DataFrame:
    best = F.max(F.struct(F.round("score", 6).alias("s"), (-F.col(label)).alias("o"), F.col(label).alias("l")))
    return scores.groupBy("doc_id").agg(best["l"].alias("predicted"))


def predicted_runs(texts: DataFrame, runs: tuple[str, ...], model: DataFrame, prior: DataFrame, label: str) -> DataFrame:
    """(doc_id, a column a run): what naive Bayes makes of versions of documents, (doc_id, run, words); null for a version without words. The versions of a
    document share most terms, so they are counted together and each term is looked up once a document."""
    lengths = texts.groupBy("doc_id").agg(*[F.sum(F.when(F.col("run") == r, F.size("words") + F.greatest(F.size("words") - 1, F.lit(0))).otherwise(0)).alias(f"n_{r}") for r in runs])
    whole = texts.groupBy("doc_id").agg(F.collect_list(F.struct("run", "words")).alias("x"))
    found = F.flatten(F.transform("x", lambda x: F.transform(grams(x["words"]), lambda t: F.struct(x["run"].alias("run"), t.alias("term")))))
    tf = whole.select("doc_id", F.explode(found).alias("t")).groupBy("doc_id", "t.term").agg(*[F.count_if(F.col("t.run") == r).alias(r) for r in runs])
    gain = F.col("logp") - F.col("unseen")
    hits = tf.join(model, "term").join(F.broadcast(prior.select(label, "unseen")), label).groupBy("doc_id", label).agg(*[F.sum(F.col(r) * gain).alias(f"gain_{r}") for r in runs])
    total = prior.agg(F.sum("n_docs").alias("all_docs"))
    grid = lengths.crossJoin(F.broadcast(prior)).crossJoin(F.broadcast(total)).join(hits, ["doc_id", label], "left")  # documents by classes
    score = lambda r: F.log(F.col("n_docs") / F.col("all_docs")) + F.col(f"n_{r}") * F.col("unseen") + F.coalesce(f"gain_{r}", F.lit(0.0))
    best = lambda r: F.max(F.when(F.col(f"n_{r}") > 0, F.struct(F.round(score(r), 6).alias("s"), (-F.col(label)).alias("o"), F.col(label).alias("l"))))["l"]
    return grid.groupBy("doc_id").agg(*[best(r).alias(r) for r in runs])


def contributions(weights: DataFrame, coefficients: DataFrame, k: int = 15) -> DataFrame:
    """(doc_id, term, contribution, rank): the terms that speak most for the class whose coefficients are given."""
    rows = weights.join(coefficients, "term").withColumn("contribution", F.col("weight") * F.col("coefficient"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.round("contribution", 9).desc(), "term"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k).select("doc_id", "term", "contribution", "rank")


def probability_shift(before: DataFrame, after: DataFrame) -> DataFrame:
    """(label, before, after, delta) of two probability tables; a label that one lacks has 0 there."""
    rows = before.select("label", F.col("p").alias("before")).join(after.select("label", F.col("p").alias("after")), "label", "full_outer")
    a, b = F.coalesce("before", F.lit(0.0)), F.coalesce("after", F.lit(0.0))
    return rows.select("label", a.alias("before"), b.alias("after"), (b - a).alias("delta"))


def term_ids(df: DataFrame) -> DataFrame:
    """(term, slot): all terms numbered from 0 in their order. Spark numbers sorted partitions, so no task sees all terms."""
    rows = df.select("term").distinct().orderBy("term").rdd.zipWithIndex().map(lambda x: (x[0][0], x[1]))
    return df.sparkSession.createDataFrame(rows, "term string, slot int").cache()


def vocabulary(df: DataFrame) -> tuple[DataFrame, int]:
    """(term, df, slot) of (term, df): all terms numbered from 0 in their order; and how many there are. Sorted partitions are numbered, so no task sees all terms."""
    rows = materialized(df.select("term", "df").orderBy("term").withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33).cast("int")
    starts, size = [], 0
    for k, n in sorted(tuple(r) for r in rows.groupBy(part.alias("part")).count().collect()):
        starts += [size] * (k + 1 - len(starts))
        size += n
    if not size:
        return rows.select("term", "df", F.lit(0).alias("slot")), 0
    return rows.select("term", "df", (F.element_at(F.array(*map(F.lit, starts)), part + 1) + F.col("at").bitwiseAND((1 << 33) - 1)).cast("int").alias("slot")), size


def tfidf_cells(tf: DataFrame, terms_: DataFrame, n_docs: int, key: str = "doc_id") -> DataFrame:
    """(key, c): the weights of ``tfidf`` as an array of (slot, w) by slot, a row a document, so that no norm is joined to its cells."""
    raw = (1 + F.log("tf")) * (F.log((F.lit(1.0) + n_docs) / (F.lit(1.0) + F.col("df"))) + 1)
    whole = tf.join(terms_, "term").groupBy(key).agg(F.collect_list(F.struct("slot", raw.alias("w"))).alias("c"))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            cells, n = b.column(1).flatten(), b.column(1).value_lengths().to_numpy(zero_copy_only=False)
            slots, w, of = cells.field(0).to_numpy(), cells.field(1).to_numpy(), np.repeat(np.arange(len(n)), n)
            order = np.lexsort((slots, of))
            w = w[order] / np.sqrt(np.bincount(of, w[order] ** 2, len(n)))[of]
            cells = pa.StructArray.from_arrays([pa.array(slots[order], pa.int32()), pa.array(w)], ["slot", "w"])
            yield pa.record_batch([b.column(0), pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), cells)], [key, "c"])

    return whole.mapInArrow(run, T.StructType([whole.schema[key], T.StructField("c", T._parse_datatype_string("array<struct<slot: int, w: double>>"))]))


def feature_frame(weights: DataFrame, labels: DataFrame, label: str, size: int | None = None) -> DataFrame:
    """(doc_id, label, features, weight) for pyspark.ml: weights as a sparse vector, one feature a term; classes weighted alike. The weights are rows
    (doc_id, term, weight), or (doc_id, c) of ``tfidf_cells`` with the number of terms."""
    from pyspark.ml.linalg import SparseVector, VectorUDT

    spark = labels.sparkSession
    if size is None:
        weights = weights.cache()
        ids = term_ids(weights)
        size = ids.count()
        cells = weights.join(ids, "term").select("doc_id", "slot", F.col("weight").alias("w"))
        weights = cells.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("slot", "w"))).alias("c"))
    vector = F.struct(F.lit(0).cast("byte").alias("type"), F.lit(size).alias("size"), F.col("c.slot").alias("indices"), F.col("c.w").alias("values"))
    rows = materialized(weights.join(labels, "doc_id").select("doc_id", F.col(label).alias("label"), vector.alias("features")), made := [])
    if made:  # what is in the files is what a vector is made of
        kind = T.StructType([T.StructField(f.name, VectorUDT() if f.name == "features" else f.dataType) for f in rows.schema])
        rows = spark.read.schema(kind).parquet(made[0])
    else:
        make = F.udf(lambda x: SparseVector(size, x["indices"], x["values"]), VectorUDT())  # at the boundary to ML only
        rows = rows.withColumn("features", make("features"))
    classes = labels.select(label).distinct().count()
    total = labels.count()
    each = rows.groupBy("label").agg((F.lit(float(total)) / (F.lit(classes) * F.count("*"))).alias("class_weight"))
    return rows.join(F.broadcast(each), "label").select("doc_id", F.col("label").cast("double").alias("label"), "features", "class_weight")


def in_blocks(frame: DataFrame, *more: str) -> descent.Matrix | None:
    """The frame in blocks of features, for training beside which the driver holds no vector of all features. None without a folder that Python can open, or with other classes than 0 and 1."""
    if not descent.possible(frame.sparkSession):
        return None
    m = descent.Matrix(frame, *more)
    if m.n and np.isin(m.label, (0, 1)).all():
        return m
    m.remove()
    return None


def held_out_scores(frame: DataFrame, c: float = 1.0) -> DataFrame:
    """One row: accuracy and macro-F1 of the balanced logistic regression of the rows not ``is_test`` on those that are."""
    from redpen.operators import evaluate

    m = in_blocks(frame, "is_test")
    test = m is not None and m.more["is_test"].astype(bool)
    if m is None or len(np.unique(m.label[~test])) < 2:
        return evaluate.scores(logistic(frame.where("NOT is_test"), c).transform(frame.where("is_test")), "label", "prediction")
    margin = descent.train(m, np.where(test, 0.0, m.class_weight), 1 / (c * max(int((~test).sum()), 1)), 50, hinge=False)
    m.remove()
    found, n = np.unique(np.stack([m.label[test], margin[test] > 0], 1), axis=0, return_counts=True)
    cells = [(float(t), float(p), int(k)) for (t, p), k in zip(found, n, strict=True)]
    return evaluate.cell_scores(frame.sparkSession.createDataFrame(cells, "truth double, predicted double, n long"))


def svm_calibration(frame: DataFrame, folds: int = 3):
    """The calibration of ``linear_svm``: a logistic regression on margins of documents that a fold holds out."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    fold = F.pmod(F.xxhash64("doc_id"), F.lit(folds))
    m = in_blocks(frame.withColumn("fold", fold), "fold")
    if m is None or any(len(np.unique(m.label[m.more["fold"] != k])) < 2 for k in range(folds)):
        return linear_svm(frame)[1]
    margin = np.zeros(m.n)
    for k in range(folds):
        held = m.more["fold"] == k
        margin[held] = descent.train(m, np.where(held, 0.0, m.class_weight), 0.01, 30, hinge=True)[held]
    path = m.table(label=m.label, margin=margin)
    calibration = LogisticRegression(featuresCol="m").fit(VectorAssembler(inputCols=["margin"], outputCol="m").transform(frame.sparkSession.read.parquet(path)))
    m.remove()
    return calibration


#: Regularisations that are tried.
C_GRID = (0.1, 1.0, 10.0)


def _logistic(frame: DataFrame, c: float):
    from pyspark.ml.classification import LogisticRegression

    return LogisticRegression(weightCol="class_weight", regParam=1 / (c * max(frame.count(), 1)), standardization=False, maxIter=50).fit(frame)


def grid_search(frame: DataFrame, folds: int = 5, grid: tuple[float, ...] = C_GRID) -> list[tuple[float, float]]:
    """(c, macro-F1) of each regularisation: the mean over folds, dealt by a hash of the document id, of the score on what the fold holds out."""
    from redpen.operators.evaluate import scores

    fold = F.pmod(F.xxhash64("doc_id"), F.lit(folds))
    out = []
    for c in grid:
        held = [scores(_logistic(frame.where(fold != k), c).transform(frame.where(fold == k)), "label", "prediction").first()["f1_macro"] for k in range(folds)]
        known = [x for x in held if x is not None]
        out.append((c, sum(known) / max(len(known), 1)))
    return out


def logistic(frame: DataFrame, c: float = 1.0, folds: int = 0):
    """A balanced logistic regression; with folds, the regularisation of best mean macro-F1 is taken, the first of equals."""
    if folds > 1:
        c = max(grid_search(frame, folds), key=lambda x: (round(x[1], 12), -C_GRID.index(x[0])))[0]
    return _logistic(frame, c)


def leaderboard(results: DataFrame) -> DataFrame:
    """(model, accuracy, f1_macro) from best to worst macro-F1; the first one is the one to deploy."""
    return results.orderBy(F.desc("f1_macro"), "model")


def linear_svm(frame: DataFrame):
    """A linear SVM whose margins are turned into probabilities by a one-dimensional logistic regression on held-out margins."""
    from pyspark.ml.classification import LinearSVC, LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    fold = F.pmod(F.xxhash64("doc_id"), F.lit(3))
    svm = LinearSVC(weightCol="class_weight", maxIter=30, regParam=0.01)
    margins = None
    for k in range(3):
        part = svm.fit(frame.where(fold != k)).transform(frame.where(fold == k)).select("label", vector_to_array("rawPrediction")[1].alias("margin"))
        margins = part if margins is None else margins.unionByName(part)
    calibration = LogisticRegression(featuresCol="m").fit(VectorAssembler(inputCols=["margin"], outputCol="m").transform(margins))
    return svm.fit(frame), calibration
