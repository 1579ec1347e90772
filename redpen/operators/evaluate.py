"""Metrics: confusion counts, macro-F1, deltas, bootstrap intervals, benchmark summaries and tuning."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return df.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def class_report(cells: DataFrame) -> DataFrame:
    """(label, tp, predicted, support, precision, recall, f1) over all labels that are true or predicted; 0 where undefined."""
    t = cells.groupBy(F.col("truth").alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0)).alias("tp"))
    p = cells.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("predicted"))
    x = t.join(p, "label", "full_outer").select("label", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("tp", "predicted", "support")])
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, pr, su = F.col("tp"), F.col("predicted"), F.col("support")
    return x.select("*", ratio(tp, pr).alias("precision"), ratio(tp, su).alias("recall"), ratio(2 * tp, pr + su).alias("f1"))


def scores(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """One row: accuracy and macro-F1."""
    return cell_scores(confusion(df, truth, predicted))


def cell_scores(cells: DataFrame) -> DataFrame:
    """The same of counted (truth, predicted, n)."""
    acc = cells.agg((F.sum(F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"))
    return acc.crossJoin(class_report(cells).agg(F.avg("f1").alias("f1_macro")))


def deltas(original, noisy, restored, safety) -> dict:
    """Recovery, safety drop and error-recovery ratios as columns; null where the noise cost nothing."""
    lost = original - noisy
    return {
        "delta_recovery": restored - noisy, "safety_drop": original - safety, "err_recovery": F.when(lost > 1e-12, (restored - noisy) / lost), "err_alternative": F.when(1 - noisy > 1e-12, (restored - noisy) / (1 - noisy)),
    }


def four_runs(df: DataFrame, truth: str, runs: list[str]) -> DataFrame:
    """One row: f1_macro and accuracy of each run's predictions, side by side. Cells are counted in one pass over the rows."""
    long = df.select(F.col(truth).alias("truth"), F.explode(F.array(*[F.struct(F.lit(r).alias("run"), F.col(r).alias("predicted")) for r in runs])).alias("x")).select("truth", "x.*")
    cells = long.groupBy("run", "truth", "predicted").agg(F.count("*").alias("n"))
    t = cells.groupBy("run", F.col("truth").alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0)).alias("tp"))
    p = cells.groupBy("run", F.col("predicted").alias("label")).agg(F.sum("n").alias("guessed"))
    x = t.join(p, ["run", "label"], "full_outer").na.fill(0, ["support", "tp", "guessed"])
    per = x.groupBy("run").agg(F.avg(2 * F.col("tp") / (F.col("support") + F.col("guessed"))).alias("f1_macro"), (F.sum("tp") / F.sum("support")).alias("accuracy"))
    return per.groupBy().pivot("run", runs).agg(F.first("f1_macro").alias("f1_macro"), F.first("accuracy").alias("accuracy"))


def label_flips(df: DataFrame, a: str, b: str, name: str) -> DataFrame:
    return df.withColumn(name, (~F.col(a).eqNullSafe(F.col(b))).cast("int"))


def bootstrap(df: DataFrame, truth: str, a: str, b: str, n_boot: int = 1000, seed: int = 42) -> DataFrame:
    """One row: mean and 95 % interval of the accuracy and macro-F1 difference of b to a.

    A resample of the rows is a multinomial draw over the cells (truth, a, b), of which there are few, so the cost
    does not depend on the number of rows. The cells are gathered after they are counted.
    """
    import numpy as np

    cells = [tuple(r) for r in df.groupBy(truth, a, b).count().collect()]
    labels = sorted({x for c in cells for x in c[:3] if x is not None})
    counts = np.array([c[3] for c in cells], float)
    t, pa, pb = (np.array([[c[k] == x for x in labels] for c in cells], float) for k in range(3))

    def draw(batches):
        import pandas as pd

        for batch in batches:
            rows = []
            for r in batch["id"]:
                n = np.random.default_rng([seed, int(r)]).multinomial(int(counts.sum()), counts / counts.sum()).astype(float)

                def f1(p, n=n):
                    tp, both = (n[:, None] * t * p).sum(0), (n[:, None] * (t + p)).sum(0)
                    used = both > 0
                    return (2 * tp[used] / both[used]).mean(), tp.sum() / n.sum()

                (fa, aa), (fb, ab) = f1(pa), f1(pb)
                rows.append((fb - fa, ab - aa))
            yield pd.DataFrame(rows, columns=["f1", "acc"])

    got = df.sparkSession.range(n_boot).mapInPandas(draw, "f1 double, acc double")
    out = []
    for c in ("f1", "acc"):
        out += [F.avg(c).alias(f"{c}_mean"), F.percentile(c, F.lit(0.025)).alias(f"{c}_low"), F.percentile(c, F.lit(0.975)).alias(f"{c}_high")]
    return got.agg(*out)


def category_breakdown(cases: DataFrame) -> DataFrame:
    """(category, n_total, n_error, n_negative, error_recall_pct, neg_fpr_pct) of (category, wrong, expected, corrected); null without cases."""
    error, right = F.col("expected") != F.col("wrong"), F.col("corrected") == F.col("expected")
    x = cases.groupBy("category").agg(F.count("*").alias("n_total"), F.count_if(error).alias("n_error"), F.count_if(~error).alias("n_negative"), F.count_if(error & right).alias("hits"), F.count_if(~error & ~right).alias("harmful"))
    return x.select("category", "n_total", "n_error", "n_negative", (100 * F.col("hits") / F.nullif(F.col("n_error"), F.lit(0))).alias("error_recall_pct"), (100 * F.col("harmful") / F.nullif(F.col("n_negative"), F.lit(0))).alias("neg_fpr_pct"))


def intrinsic(cases: DataFrame) -> DataFrame:
    """One row: recall over errors and harmful edits on negatives, by category name."""
    error = ~F.lower("category").isin("negative", "correct", "clean")
    right = F.col("corrected") == F.col("expected")
    return cases.agg(F.count_if(error).alias("total_errors"), F.count_if(~error).alias("total_negatives"), F.count_if(error & right).alias("hits"), F.count_if(~error & ~right).alias("harmful"))


def overall(cases: DataFrame) -> DataFrame:
    """One row over all cases: errors that are put right or not, harmless words that are left alone or not, recall and false positive rate."""
    error, right = F.col("expected") != F.col("wrong"), F.col("corrected") == F.col("expected")
    x = cases.agg(F.count_if(error & right).alias("tp"), F.count_if(error & ~right).alias("fn"), F.count_if(~error & right).alias("tn"), F.count_if(~error & ~right).alias("fp"))
    share = lambda a, b: 100 * F.col(a) / F.nullif(F.col(a) + F.col(b), F.lit(0))
    return x.select("*", share("tp", "fn").alias("recall_pct"), share("fp", "tn").alias("fpr_pct"))


def grid(spark, **values: list) -> DataFrame:
    """All combinations of parameter values, numbered in order."""
    import itertools

    names = list(values)
    rows = [(i, *map(float, x)) for i, x in enumerate(itertools.product(*values.values()))]
    return spark.createDataFrame(rows, "ordinal long, " + ", ".join(f"{n} double" for n in names))


def best_configuration(results: DataFrame) -> DataFrame:
    """The row of highest recall without a harmful edit; the first of equals."""
    return results.where("harmful = 0").orderBy(F.desc("recall"), "ordinal").limit(1)


def golden_difference(current: DataFrame, golden: DataFrame) -> DataFrame:
    """Rows of either side that the other lacks."""
    cols = golden.columns
    sides = [current.select(*cols).exceptAll(golden).withColumn("side", F.lit("current")), golden.exceptAll(current.select(*cols)).withColumn("side", F.lit("golden"))]
    return reduce(DataFrame.unionByName, sides)
