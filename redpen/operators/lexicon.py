"""Language-model tables: unigrams, bigrams, vocabulary, totals; and views of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from redpen.lexicons import ACADEMIC_STOP_WORDS

WORD = r"([a-z]+)"


def word_array(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(1))


def unigrams(words: DataFrame, column: str = "words") -> DataFrame:
    """(word, cnt) of an array column."""
    return words.select(F.explode(column).alias("word")).groupBy("word").agg(F.count("*").alias("cnt"))


def bigrams(words: DataFrame, column: str = "words") -> DataFrame:
    """(prev, word, cnt). Pairs are made inside a row, so they never cross a line, and no shuffle orders them."""
    c = F.col(column)
    pairs = F.zip_with(F.slice(c, 1, F.greatest(F.size(c) - 1, F.lit(0))), F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("prev"), b.alias("word")))
    return words.where(F.size(c) > 1).select(F.explode(pairs).alias("p")).select("p.*").groupBy("prev", "word").agg(F.count("*").alias("cnt"))


def vocabulary(counts: DataFrame, min_count: int = 3) -> DataFrame:
    return counts.where(F.col("cnt") >= min_count).select("word")


def totals(counts: DataFrame, pairs: DataFrame, min_count: int = 3) -> DataFrame:
    """One row: tokens, types, vocabulary, bigram types."""
    a = counts.agg(F.greatest(F.coalesce(F.sum("cnt"), F.lit(0)), F.lit(1)).alias("tokens"), F.count("*").alias("types"), F.count_if(F.col("cnt") >= min_count).alias("vocab"))
    return a.crossJoin(pairs.agg(F.count("*").alias("bigram_types")))


def row_totals(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("prev").agg(F.sum("cnt").alias("total"))


def top_terms(counts: DataFrame, n: int = 15) -> DataFrame:
    """The most frequent valid topic terms."""
    ok = F.col("word").rlike(r"^\p{L}+$") & (F.length("word") > 5) & ~F.col("word").isin(*ACADEMIC_STOP_WORDS)
    return counts.where(ok).orderBy(F.desc("cnt"), "word").limit(n)


def top_bigrams(pairs: DataFrame, n: int = 15) -> DataFrame:
    ok = [F.col(c).rlike(r"^\p{L}+$") & (F.length(c) >= 3) & ~F.col(c).isin(*ACADEMIC_STOP_WORDS) for c in ("prev", "word")]
    return pairs.where(ok[0] & ok[1]).orderBy(F.desc("cnt"), "prev", "word").limit(n)


def search_terms(counts: DataFrame, part: str, n: int = 50, by: str = "frequency") -> DataFrame:
    """Terms that contain a string, by frequency or name."""
    order = [F.desc("cnt"), F.col("word")] if by == "frequency" else [F.col("word")]
    return counts.where(F.contains(F.col("word"), F.lit(part.lower()))).orderBy(*order).limit(n)


def top_ngrams_per_class(words: DataFrame, label: str, n: int = 10, stop_words: tuple[str, ...] = (), column: str = "words") -> DataFrame:
    """The n most frequent one- and two-word terms of each class."""
    c = F.filter(F.col(column), lambda w: ~w.isin(*stop_words)) if stop_words else F.col(column)
    rows = words.select(label, c.alias("w"))
    two = F.when(F.size("w") > 1, F.zip_with(F.slice("w", 1, F.size("w") - 1), F.slice("w", 2, F.size("w") - 1), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))
    counts = rows.select(label, F.explode(F.concat("w", two)).alias("term")).groupBy(label, "term").agg(F.count("*").alias("cnt"))
    rank = F.row_number().over(Window.partitionBy(label).orderBy(F.desc("cnt"), "term"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= n)


def common_words(sentences: DataFrame, sentence: str, least: int = 50, shortest: int = 4) -> DataFrame:
    """(word, cnt): lower-case words of nothing but letters a-z that are frequent in sentences."""
    from redpen.functions.text import case_tokens

    words = sentences.select(F.explode(F.transform(case_tokens(F.col(sentence)), F.lower)).alias("word"))
    return words.where(F.col("word").rlike("^[a-z]+$") & (F.length("word") >= shortest)).groupBy("word").agg(F.count("*").alias("cnt")).where(F.col("cnt") >= least)
