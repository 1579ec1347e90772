"""Log probabilities and the composite candidate score."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from redpen.params import Params


def safe_log(x: Column, tokens: Column) -> Column:
    """ln x, with a floor below what one unseen token would get."""
    return F.when(x > 0, F.log(x)).otherwise(F.log(1 / (tokens + 1)) - 5)


def unigram_logp(cnt: Column, tokens: Column, types: Column, p: Params = Params()) -> Column:
    return F.log((F.coalesce(cnt, F.lit(0)) + p.k_unigram) / (tokens + p.k_unigram * types))


def bigram_logp(prev: Column, cnt: Column, total: Column, alone: Column, types: Column, p: Params = Params()) -> Column:
    """ln P(word | prev): ``alone`` is the word's own log probability, taken without a previous word or a row."""
    seen = F.log((cnt + p.k_bigram) / (total + p.k_bigram * types)) if p.bigram_mode == "addk" else F.log(cnt / total)
    return F.when(prev.isNull() | F.coalesce(total, F.lit(0)).eqNullSafe(0), alone).when(F.coalesce(cnt, F.lit(0)) > 0, seen).otherwise(F.lit(math.log(p.backoff)) + alone)


def zipf(cnt: Column) -> Column:
    return F.log10(F.coalesce(cnt, F.lit(0)) + 1)


def composite(alone: Column, left: Column, right: Column, cnt: Column, dist: Column, p: Params = Params()) -> Column:
    """Without a next word the right term is nothing; without a previous one the left term is the word's own."""
    return p.w_unigram * alone + p.w_left * left + p.w_right * F.coalesce(right, F.lit(0.0)) + p.w_zipf * zipf(cnt) - p.w_distance * dist


def extras(known: Column, dist: Column, length_difference: Column, p: Params = Params()) -> Column:
    """What candidates pay beyond the original: length for all, distance again for unknown words."""
    return F.when(known, 0.0).otherwise(p.w_nonword_distance * dist) + p.w_length * length_difference


def keep_threshold(original: dict[str, Column], best: dict[str, Column], dist: Column, p: Params = Params(), keep_bonus: float = 0.0, margin: float | None = None) -> Column:
    """The score that a candidate for a known word must reach, adapted to both words and their context.

    ``original`` has score, cnt, and left and right, its counts beside the neighbours (null or 0 without); ``best`` the same but the score.
    A frequent original raises the bonus for keeping it and a rare one lowers it; one edit lowers the margin and two raise it. Context that speaks for the
    candidate, and its being the more frequent word, give a discount of 4 at most. The improvement asked for is 1.5 at least. The
    corrector itself uses the fixed margin.
    """
    n = lambda c: F.coalesce(c, F.lit(0))
    z = F.round(zipf(original["cnt"]), 9)
    bonus = keep_bonus + F.when(z >= 5.5, 1.0).when(z >= 4.5, 0.6).when(z <= 2.0, -0.7).when(z <= 2.5, -0.4).otherwise(0.0)
    asked = (p.delta_rw if margin is None else margin) + F.when(dist == 1, -0.4).when(dist == 2, 0.8).otherwise(0.0)
    support, was = n(best["left"]) + n(best["right"]), n(original["left"]) + n(original["right"])
    between = lambda x, most: F.greatest(F.lit(0.0), F.least(F.lit(most), x))
    evidence = F.when(support > 0, between(F.log10((support + 1.0) / (was + 1.0)) * 1.3, 3.0) + F.when(support >= 50, 0.5).otherwise(0.0) + F.when(support >= 200, 0.5).otherwise(0.0)).otherwise(0.0)
    usual = between(F.log10((n(best["cnt"]) + 1.0) / (n(original["cnt"]) + 1.0)) * 0.8, 1.0)
    return F.greatest(original["score"] + bonus + asked - F.least(evidence + usual, F.lit(4.0)), original["score"] + 1.5)
