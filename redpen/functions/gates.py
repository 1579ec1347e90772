"""Safety gates and domain rules. Order matters; the first match wins."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from redpen.functions.text import has_letter
from redpen.lexicons import CHANGE_WORDS, COVID_18, PROTECTED_WORDS, VIRUS_AFTER, VIRUS_BEFORE, VIRUS_CONFUSIONS

# fixed values: beginnings of identifiers
IDENTIFIER = r"^(?:[A-Z]{1,3}[0-9]|[A-Z]{1,3}-[0-9]|rs[0-9]+|[A-Z]{1,5}[0-9]{2,}|[a-z]{1,3}[0-9]{2,}|[A-Z]+[0-9]+[A-Za-z]*|[0-9]+[A-Za-z]+[0-9]*)"
SHORT, NUMERIC_SHARE = 3, 0.5


def gate(tok: Column) -> Column:
    """Name of the first gate that protects a token, or null."""
    letters = F.length(F.regexp_replace(tok, r"[^\p{L}]", ""))
    return (
        F.when(tok == "", F.lit(None))
        .when(~has_letter(tok), "non_alpha")
        .when(F.length(tok) <= SHORT, "short_token")
        .when(F.substring_index(tok, "-", 1).rlike("^[A-Z]{2,}$"), "pattern_allcaps")
        .when(F.regexp_replace(tok, r"[+.,;:-]+$", "").rlike(IDENTIFIER), "pattern_biomed_id")
        .when((F.length(tok) - letters) / F.length(tok) > NUMERIC_SHARE, "pattern_numeric_heavy")
    )


# fixed values: virus names that interactive correction may touch, and signs that keep it off
UI_ALLOWED = r"^(?:covid|covid19|covid-?19|sars-?cov-?2|2019-?ncov|ncov)$"
UI_SIGNS = r"[0-9<>=/\\+*%_\x{0370}-\x{03FF}\x{1F00}-\x{1FFF}]"


def ui_gate(tok: Column) -> Column:
    """The gate in front of interactive correction: true for tokens that are left alone."""
    odd = tok.rlike(UI_SIGNS) | (F.length(tok) >= 26)
    return ~has_letter(tok) | (F.length(tok) < 3) | (~F.lower(tok).rlike(UI_ALLOWED) & odd)


def protected_word(low: Column, words: list[str] | None = None) -> Column:
    """Known words that are too short or too common to be corrected."""
    return (F.length(low) <= SHORT) | low.isin(*(words or PROTECTED_WORDS))


def domain_rule(tok: Column, prev: Column, nxt: Column) -> Column:
    """What a domain rule makes of a token between lower-case neighbours, or null."""
    low = F.lower(tok)
    bare = F.translate(low, "(),._/–—-", "")
    return (
        F.when(low.isin(*COVID_18), "covid-19")
        .when(low.startswith("covid") & low.endswith("18"), "covid-19")
        .when(bare.startswith("covid") & F.contains(bare, F.lit("19")) & (low != "covid-19"), "covid-19")
        .when((low == "covid-19") & (tok != "covid-19"), "covid-19")
        .when(low.isin(*VIRUS_CONFUSIONS) & (prev.isin(*VIRUS_BEFORE) | nxt.isin(*VIRUS_AFTER)), "virus")
        .when((low == "significance") & (prev.endswith("ly") | nxt.isin(*CHANGE_WORDS)), "significant")
        .when((low == "lose") & (nxt == "of"), "loss")
        .when((low == "road") & ((prev == "viral") | (nxt == "levels")), "load")
        .when((low == "police") & (nxt == "measures"), "policy")
    )
