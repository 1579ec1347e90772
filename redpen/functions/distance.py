"""Edit distance with adjacent swaps, and deletion keys, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _without(w: Column, i: Column) -> Column:
    return F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w)))


def single_deletions(w: Column) -> Column:
    return F.when(F.length(w) > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))), lambda i: _without(w, i))).otherwise(F.array().cast("array<string>"))


def deletion_keys(w: Column) -> Column:
    """The word itself and what is left after one or two deletions. Two words within two edits share a key."""
    once = single_deletions(w)
    twice = F.flatten(F.transform(once, single_deletions))
    return F.array_distinct(F.concat(F.array(w), once, twice))


def swaps(w: Column) -> Column:
    """All words that differ by one swap of neighbours."""
    n = F.length(w)
    swapped = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.lit(1)), F.substring(w, i, F.lit(1)), F.substring(w, i + 2, n)))
    return F.when(n > 1, swapped).otherwise(F.array().cast("array<string>"))


def distance_upto_2(a: Column, b: Column) -> Column:
    """Damerau-Levenshtein distance if it is at most 2, else null.

    A swap counts as two plain edits, so swaps are looked at only where the plain distance is 2 to 4, and
    only if the letters that one word has and the other lacks leave room for it.
    """
    plain = F.levenshtein(a, b)
    apart = F.greatest(F.length(F.call_function("translate", a, b, F.lit(""))), F.length(F.call_function("translate", b, a, F.lit(""))))
    swapped = F.exists(swaps(a), lambda s: s == b)
    swap_and_edit = F.exists(swaps(a), lambda s: F.levenshtein(s, b) == 1) | F.exists(swaps(b), lambda s: F.levenshtein(a, s) == 1)
    two_swaps = F.arrays_overlap(swaps(a), swaps(b))
    return (
        F.when(plain <= 1, plain)
        .when(plain == 2, F.when((apart == 0) & (F.length(a) == F.length(b)) & swapped, 1).otherwise(2))
        .when((plain == 3) & (apart <= 1) & swap_and_edit, 2)
        .when(plain.isin(3, 4) & (apart == 0) & (F.length(a) == F.length(b)) & two_swaps, 2)
    )
