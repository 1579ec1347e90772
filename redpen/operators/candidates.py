"""Candidate retrieval: a join on deletion keys, or on parts of long words, then the exact distance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from redpen.functions.distance import deletion_keys, distance_upto_2
from redpen.params import Params


def deletion_index(vocab: DataFrame, max_length: int = 30, word: str = "word") -> DataFrame:
    """(del_key, word)."""
    return vocab.where(F.length(word) <= max_length).select(F.explode(deletion_keys(F.col(word))).alias("del_key"), F.col(word).alias("word"))


PARTS = 5


def _part(word: Column, length: Column, k: Column, shift: Column) -> Column:
    """The k-th of PARTS parts of words of a length, moved by some letters; null where it would begin before the word."""
    start = F.floor(length * k / PARTS).cast("int")
    n = F.floor(length * (k + 1) / PARTS).cast("int") - start
    return F.when(start + shift >= 0, F.struct(length.alias("length"), k.alias("k"), F.substring(word, start + 1 + shift, n).alias("part")))


def long_pairs(asked: DataFrame, known: DataFrame, over: int) -> DataFrame:
    """(tok, cand): known words of more than ``over`` letters that may be within two edits.

    Two edits, swaps included, touch four of a word's five parts at most, so one part stands in the token,
    moved by two letters at most. A word makes 5 keys and a token 125, whatever their lengths.
    """
    parts = F.array(*[F.lit(k) for k in range(PARTS)])
    moves = F.array(*[F.struct(F.lit(more).alias("more"), F.lit(k).alias("k"), F.lit(shift).alias("shift")) for more in range(-2, 3) for k in range(PARTS) for shift in range(-2, 3)])
    index = known.where(F.length("word") > over).select(F.col("word").alias("cand"), F.explode(parts).alias("k")).select("cand", _part(F.col("cand"), F.length("cand"), F.col("k"), F.lit(0)).alias("key"))
    probes = asked.where(F.length("tok") > over - 2).select("tok", F.explode(moves).alias("m")).select("tok", _part(F.col("tok"), F.length("tok") + F.col("m.more"), F.col("m.k"), F.col("m.shift")).alias("key"))
    keys = probes.where("key IS NOT NULL").distinct()
    return keys.join(index, "key").select("tok", "cand").distinct().where(F.levenshtein("tok", "cand", 4) >= 0)


def neighbours(tokens: DataFrame, counts: DataFrame, params: Params = Params(), token: str = "tok", within: int = 2) -> DataFrame:
    """(tok, cand, dist, cnt): for each distinct token all known words within one or two edits.

    The key of a word with one or two letters is shared by many words; the join on keys spreads by key and
    skewed keys are split at run time. Pairs are cut by length before they are made distinct, and by plain
    edit distance before swaps are looked at.
    """
    known = counts.where(F.col("cnt") >= params.min_count)
    index = deletion_index(known, params.max_index_length).withColumnRenamed("word", "cand")
    asked = tokens.select(F.col(token).alias("tok")).distinct()
    keys = asked.where(F.length("tok") <= params.max_index_length + 2).select("tok", F.explode(deletion_keys(F.col("tok"))).alias("del_key"))
    close = F.abs(F.length("tok") - F.length("cand")) <= within
    pairs = keys.join(index, "del_key").where(close & (F.col("tok") != F.col("cand"))).select("tok", "cand").distinct()
    pairs = pairs.unionByName(long_pairs(asked, known, params.max_index_length).where(close & (F.col("tok") != F.col("cand"))))
    near = pairs.withColumn("dist", distance_upto_2(F.col("tok"), F.col("cand"))).where(F.col("dist") <= within)
    return near.join(known.select(F.col("word").alias("cand"), "cnt"), "cand").select("tok", "cand", "dist", "cnt")


def candidates(tokens: DataFrame, counts: DataFrame, params: Params = Params(), token: str = "tok") -> DataFrame:
    """(tok, cand, dist, cnt, rnk): for each distinct token the known words within two edits, most frequent first."""
    rank = F.row_number().over(Window.partitionBy("tok").orderBy(F.desc("cnt"), "dist", F.desc("cand")))
    return neighbours(tokens, counts, params, token).withColumn("rnk", rank).where(F.col("rnk") <= params.max_candidates).select("tok", "cand", "dist", "cnt", "rnk")
