"""Corpus preparation: filters, weak labels, caps, splits, class statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from redpen.functions import text as tf
from redpen.lexicons import KEYWORDS


def resolve_column(df: DataFrame, names: list[str]) -> str:
    """The first of several accepted column names that a table has, whatever its case."""
    have = {c.lower(): c for c in df.columns}
    for n in names:
        if n.lower() in have:
            return have[n.lower()]
    raise ValueError(f"none of the columns {names} is in {df.columns}")


def length_filter(df: DataFrame, columns: list[str], longer_than: int = 200, tokens_over: int = 3) -> DataFrame:
    """Rows without a null whose joint length and number of tokens are large enough."""
    total = sum((F.length(c) for c in columns[1:]), F.length(columns[0]))
    n = F.size(tf.tokens_whitespace(F.concat_ws(" ", *columns)))
    return df.na.drop(subset=columns).where((total > longer_than) & (n > tokens_over))


def non_blank(df: DataFrame, columns: list[str]) -> DataFrame:
    for c in columns:
        df = df.where(F.trim(F.coalesce(F.col(c), F.lit(""))) != "")
    return df


def is_english(text: Column, least: float = 0.08) -> Column:
    """Without a detector: enough of the words are English function words. Short texts (under 10 characters) are not."""
    words = F.filter(F.split(F.lower(text), "[^a-z]+"), lambda w: w != "")
    common = F.filter(words, lambda w: w.isin("the", "of", "and", "to", "in", "is", "that", "for", "it", "with", "as", "was", "on", "are", "be", "this", "by"))
    return F.coalesce((F.length(F.trim(text)) >= 10) & (F.size(common) > least * F.size(words)), F.lit(False))


def label_scores(title: Column, abstract: Column, keywords: dict[str, list[str]]) -> dict[str, Column]:
    """Two points for a keyword in the title, else one for one in the abstract; substrings count."""
    point = lambda k: F.when(F.contains(title, F.lit(k)), 2).when(F.contains(abstract, F.lit(k)), 1).otherwise(0)
    return {label: sum((point(k) for k in words[1:]), point(words[0])) for label, words in keywords.items()}


def weak_label(title: Column, abstract: Column, keywords: dict[str, list[str]] = KEYWORDS, least: int = 2) -> Column:
    """The label of the highest score; null under the least score or when two labels share it."""
    title, abstract = F.coalesce(title, F.lit("")), F.coalesce(abstract, F.lit(""))
    scores = label_scores(title, abstract, keywords)
    top = F.greatest(*scores.values())
    winners = F.filter(F.array(*[F.when(s == top, F.lit(label)) for label, s in scores.items()]), lambda x: x.isNotNull())
    return F.when((top >= least) & (F.size(winners) == 1), F.element_at(winners, 1))


def cap_per_class(df: DataFrame, label: str, order: str, cap: int) -> DataFrame:
    """The first ``cap`` rows of each class in the order of a column. Spark limits each class before it shuffles."""
    rank = F.row_number().over(Window.partitionBy(label).orderBy(order))
    return df.where(F.col(label).isNotNull()).withColumn("rank", rank).where(F.col("rank") <= cap)


def corpus_lines(df: DataFrame, row_id: str, title: Column, abstract: Column, cap: int | None = None) -> DataFrame:
    """(row_id, field, line): title and abstract as lines of their own, so that no bigram crosses them."""
    both = F.filter(F.array(F.struct(F.lit(0).alias("field"), F.trim(title).alias("line")), F.struct(F.lit(1).alias("field"), F.trim(abstract).alias("line"))), lambda x: x["line"] != "")
    lines = df.select(F.col(row_id).alias("row_id"), F.explode(both).alias("x")).select("row_id", "x.*")
    return lines if cap is None else lines.orderBy("row_id", "field").limit(cap)


def shuffled(df: DataFrame, key: str, seed: int) -> DataFrame:
    """A seeded permutation: order by a hash of seed and key."""
    return df.orderBy(tf.hash_int(F.lit(seed), F.col(key)), key)


def split(df: DataFrame, label: str, key: str, test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """Stratified split: the rows of smallest hash in each class are the test set, rounded half up."""
    w = Window.partitionBy(label)
    rank = F.row_number().over(w.orderBy(tf.hash_int(F.lit(seed), F.col(key)), key))
    n = F.count("*").over(w)
    return df.withColumn("is_test", rank <= F.floor(n * test_share + 0.5))


def class_stats(df: DataFrame, label: str, text: str) -> DataFrame:
    """(label, rows, tokens): rows and tokens of each class; their quotient is the mean length."""
    return df.groupBy(label).agg(F.count("*").alias("n_rows"), F.sum(F.size(tf.tokens_whitespace(F.col(text)))).alias("n_tokens"))


def full_text(title: Column, abstract: Column) -> Column:
    return F.concat(title, F.lit(". "), abstract)


#: fixed values: class names by their ids
LABELS = ("Prevention", "Treatment", "Epidemiology")


def with_label_ids(df: DataFrame, label: str = "label", names: tuple[str, ...] = LABELS) -> DataFrame:
    """Add ``label_id``; rows whose label has none go."""
    ids = df.sparkSession.createDataFrame(list(enumerate(names)), "label_id int, name string")
    return df.join(F.broadcast(ids), F.col(label) == F.col("name")).drop("name")  # a row a class


def seeded_sample(df: DataFrame, key: str, n: int, seed: int = 99) -> DataFrame:
    """The n rows of smallest hash of seed and key."""
    return shuffled(df, key, seed).limit(n)
