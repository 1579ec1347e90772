"""Benchmark cases mined from the corpus: typos, confusions of real words, harmless words and virus names, each in a context of its own.

Everything random is a hash of the word, so the same corpus gives the same cases in every engine.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from redpen.functions import text as tf
from redpen.lexicons import COVID_18, COVID_VARIANTS, PROTECTED_WORDS
from redpen.operators import noise
from redpen.operators.candidates import neighbours
from redpen.operators.tables import materialized
from redpen.params import Params

TYPOS = ("trans", "rep", "ins", "del", "dist2_del_rep")
COLUMNS = ["category", "subcategory", "prev", "wrong", "next", "expected", "cnt"]


def contexts(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(word, prev) and (word, next): each word's most frequent neighbours, the first in order among equals."""
    most = lambda other: F.min(F.struct((-F.col("cnt")).alias("o"), F.col(other).alias("w")))["w"]
    return pairs.groupBy("word").agg(most("prev").alias("prev")), pairs.groupBy(F.col("prev").alias("word")).agg(most("word").alias("next"))


def in_context(words: DataFrame, pairs: DataFrame) -> DataFrame:
    left, right = contexts(pairs)
    return words.join(left, "word", "left").join(right, "word", "left")


def other_letter(c: Column, u: Column) -> Column:
    """A letter a-z that isn't ``c``."""
    return F.char(F.pmod(F.ascii(c) - 97 + noise.pick(u, F.lit(25)), F.lit(26)) + 97)


def replaced(w: Column, at: Column, u: Column) -> Column:
    return noise.edit(w, F.lit("substitute"), at, other_letter(F.substring(w, at, F.lit(1)), u))


def typo(word: Column, op: Column, u) -> Column:
    """``word`` (letters a-z) after one of TYPOS. ``u`` gives uniform numbers by name."""
    n = F.length(word)
    shorter = noise.edit(word, F.lit("delete"), noise.pick(u("at"), n), F.lit(""))
    return (
        F.when(op == "trans", noise.edit(word, F.lit("transpose"), noise.pick(u("at"), n - 1), F.lit("")))
        .when(op == "rep", replaced(word, noise.pick(u("at"), n), u("let")))
        .when(op == "ins", noise.edit(word, F.lit("insert"), noise.pick(u("at"), n + 1), noise.letter_of(u("let"))))
        .when(op == "del", shorter)
        .otherwise(noise.let(shorter, lambda w: replaced(w, noise.pick(u("at2"), n - 1), u("let"))))
    )


def typo_cases(counts: DataFrame, pairs: DataFrame, least: int = 20, common: int = 50) -> DataFrame:
    """A typo in each word of 4 to 14 letters that is frequent enough: general English if very frequent and so drawn, else non-words; one word in ten stays as it is."""
    words = counts.where((F.col("cnt") >= least) & F.col("word").rlike("^[a-z]{4,14}$") & ~F.col("word").isin(*PROTECTED_WORDS))
    u = lambda k: tf.hash_uniform(F.lit(k), F.col("word"))
    draw = tf.hash_int(F.lit("kind"), F.col("word")) % 10
    op = F.element_at(F.array(*map(F.lit, TYPOS)), noise.pick(u("op"), F.lit(len(TYPOS))))
    rows = words.withColumn("category", F.when(draw == 0, "negative").when((draw <= 2) & (F.col("cnt") >= common), "general-english").otherwise("non-word")).withColumn("op", op)
    rows = rows.withColumn("wrong", F.when(F.col("category") == "negative", F.col("word")).otherwise(typo(F.col("word"), F.col("op"), u)))
    rows = rows.where((F.col("category") == "negative") | (F.col("wrong") != F.col("word")))
    return in_context(rows, pairs).select("category", F.when(F.col("category") == "negative", "do-no-harm").otherwise(F.col("op")).alias("subcategory"), "prev", "wrong", "next", F.col("word").alias("expected"), "cnt")


def confusions(counts: DataFrame, most: int | None = 2500, least: int = 10, per_word: int = 8) -> DataFrame:
    """(expected, wrong, cnt, k): the most frequent words (or all), each with its most frequent neighbours one edit away. Both are words that occur often enough."""
    from pyspark.sql import Window

    usual = counts.where((F.col("cnt") >= least) & (F.length("word") >= 4))
    asked = usual if most is None else usual.orderBy(F.desc("cnt"), "word").limit(most)
    rows = neighbours(asked.select(F.col("word").alias("tok")), usual, Params(min_count=least), within=1)
    rank = F.row_number().over(Window.partitionBy("tok").orderBy(F.desc("cnt"), "cand"))
    near = rows.withColumn("k", rank.cast("long")).where(F.col("k") <= per_word).select(F.col("tok").alias("expected"), F.col("cand").alias("wrong"), "k")
    return near.join(asked.select(F.col("word").alias("expected"), "cnt"), "expected")


def dependency(lo: Column, lw: Column, ro: Column, rw: Column) -> Column:
    """Which side of the context tells the expected word from the wrong one, by counts of pairs (left and right, expected and wrong)."""
    strength = lambda a, b: F.round(F.log10((a + 1) / (b + 1)), 9)
    left, right = strength(lo, lw), strength(ro, rw)
    left_strong, right_strong = (left >= 0.8) & (lo >= 2), (right >= 0.8) & (ro >= 2)
    return F.when(left_strong & right_strong, "both-needed").when(left_strong & (right <= 0.2), "left-only").when(right_strong & (left <= 0.2), "right-only").otherwise("either-side")


def real_word_cases(counts: DataFrame, pairs: DataFrame, **limits: int) -> DataFrame:
    """Confusions in the context of the expected word, by the side that tells the words apart."""
    rows = in_context(confusions(counts, **limits).withColumnRenamed("expected", "word"), pairs).withColumnRenamed("word", "expected")
    for name, a, b in (("lo", "prev", "expected"), ("lw", "prev", "wrong"), ("ro", "expected", "next"), ("rw", "wrong", "next")):
        seen = pairs.select(F.col("prev").alias("a"), F.col("word").alias("b"), F.col("cnt").alias(name))
        rows = rows.join(seen, (F.col(a) == F.col("a")) & (F.col(b) == F.col("b")), "left").drop("a", "b").na.fill(0, [name])
    side = dependency(F.col("lo"), F.col("lw"), F.col("ro"), F.col("rw"))
    return rows.select(F.lit("real-word").alias("category"), side.alias("subcategory"), "prev", "wrong", "next", "expected", "cnt")


def covid_cases(spark: SparkSession) -> DataFrame:
    rows = [("covid-18-variant", v) for v in COVID_18] + [("variant", v) for v in COVID_VARIANTS]
    made = spark.createDataFrame(rows, "subcategory string, wrong string")
    none = F.lit(None).cast("string")
    return made.select(F.lit("covid-normalization").alias("category"), "subcategory", none.alias("prev"), "wrong", none.alias("next"), F.lit("covid-19").alias("expected"), F.lit(0).cast("long").alias("cnt"))


def all_cases(counts: DataFrame, pairs: DataFrame) -> DataFrame:
    """All kinds in one table, each case once, named by what it consists of."""
    kinds = [typo_cases(counts, pairs), real_word_cases(counts, pairs), covid_cases(counts.sparkSession)]
    name = F.concat_ws("|", "category", "subcategory", *[F.coalesce(F.col(c), F.lit("")) for c in ("prev", "wrong", "next", "expected")])
    return reduce(DataFrame.unionByName, [k.select(*COLUMNS) for k in kinds]).dropDuplicates(COLUMNS[:-1]).withColumn("case_id", name)


def hardness(category: Column, subcategory: Column, wrong: Column, expected: Column) -> Column:
    """Points for the kind of a case, and some for the length of both words."""
    points = lambda table: reduce(lambda c, kv: c.when(subcategory == kv[0], kv[1]), list(table.items())[1:], F.when(subcategory == next(iter(table)), next(iter(table.values())))).otherwise(0.0)
    kind = (
        F.when(category == "real-word", 10.0 + points({"both-needed": 3.0, "right-only": 2.0, "left-only": 1.0}))
        .when(category == "non-word", 7.0 + points({"dist2_del_rep": 3.0, "trans": 2.0, "rep": 1.0}))
        .when(category == "covid-normalization", 6.0)
        .when(category == "general-english", 5.0 + points({"dist2_del_rep": 2.0}))
        .otherwise(1.0)
    )
    return kind + 0.12 * F.length(wrong) + 0.05 * F.length(expected)


# fixed values: how many of the hardest cases of each kind are taken, in this order
QUOTA = (
    ("real-word", "both-needed", 35), ("real-word", "right-only", 30), ("real-word", "left-only", 25),
    ("non-word", "dist2_del_rep", 50), ("non-word", "trans", 10), ("non-word", "rep", 10), ("non-word", "ins", 5), ("non-word", "del", 5),
    ("covid-normalization", "covid-18-variant", 10), ("general-english", "dist2_del_rep", 5), ("general-english", "rep", 3), ("general-english", "trans", 2), ("negative", "do-no-harm", 10),
)


def hard_subset(cases: DataFrame, quota=QUOTA, per_pair: int = 2, per_word: int = 2, per_variant: int = 1, must_meet: bool = False) -> DataFrame:
    """The hardest cases of each kind, few of one pair or wrong word in a category, whatever its subcategories.

    The kinds of a category take turns in the order of the quota, each counting what the ones before it took; inside a kind the caps
    are ranks, so no walk along the rows is needed. Equal hardness goes by case id. With ``must_meet`` an unmet quota is an error.
    """
    from pyspark.sql import Window

    rows = materialized(cases.withColumn("hardness", F.round(hardness(F.col("category"), F.col("subcategory"), F.col("wrong"), F.col("expected")), 6)))
    order = [F.desc("hardness"), F.asc("case_id")]
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    out: list[DataFrame] = []
    taken: dict[str, list[DataFrame]] = {}
    for category, subcategory, n in quota:
        pool = rows.where((F.col("category") == category) & (F.col("subcategory") == subcategory))
        before = reduce(DataFrame.unionByName, taken[category]).select("wrong", "expected") if taken.get(category) else None
        caps = (("of_pair", ["wrong", "expected"], per_pair), ("of_word", ["wrong"], min(per_word, per_variant) if category == "covid-normalization" else per_word))
        for name, by, cap in caps:
            pool = pool.withColumn(name, rank(*by))
            if before is not None:
                pool = pool.join(before.groupBy(*by).agg(F.count("*").alias("had")), by, "left").withColumn(name, F.col(name) + F.coalesce("had", F.lit(0))).drop("had")
            pool = pool.where(F.col(name) <= cap).drop(name)
        picked = materialized(pool.withColumn("place", rank("category", "subcategory").cast("long")).where(F.col("place") <= n))
        if must_meet and (got := picked.count()) < n:
            raise RuntimeError(f"{category}, {subcategory}: {got} of {n} cases")
        out.append(picked)
        taken.setdefault(category, []).append(picked)
    return reduce(DataFrame.unionByName, out)
