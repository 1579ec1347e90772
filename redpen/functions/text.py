"""Text cleaning, normalisation and tokenisation as column expressions. A null text is an empty one unless said otherwise."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from redpen.lexicons import GREEK

#: White space, spelled out so that every engine means the same by it.
WS = r"[ \t\n\r\f\x0B]"
URL = r"http[^ \t\n\r\f\x0B]+|www\.[^ \t\n\r\f\x0B]+"
#: A word with inner hyphens or apostrophes, or a run of other signs.
PIECE = r"([\p{L}\p{N}]+(?:[-'][\p{L}\p{N}]+)*|[^\p{L}\p{N} \t\n\r\f\x0B]+)([ \t\n\r\f\x0B]*)"


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def squeeze(c: Column) -> Column:
    return F.btrim(F.regexp_replace(c, f"{WS}+", " "))


def clean_academic(c: Column) -> Column:
    """Lower case; addresses, tags and numeric citations become spaces; white space is squeezed."""
    c = F.regexp_replace(F.lower(_text(c)), URL, " ")
    c = F.regexp_replace(c, "<.*?>", " ")
    return squeeze(F.regexp_replace(c, r"\[[ \t\n\r\f\x0B]*[0-9]+(?:[ \t\n\r\f\x0B,–-]*[0-9]+)*[ \t\n\r\f\x0B]*\]", " "))


def clean_surface(c: Column) -> Column:
    """As clean_academic, but case is kept, citations stay, and control characters go."""
    c = F.regexp_replace(F.regexp_replace(_text(c), URL, " "), "<.*?>", " ")
    return squeeze(F.regexp_replace(c, r"[\x00-\x1F\x7F]+", " "))


def normalize(c: Column, greek: bool = True) -> Column:
    """Dashes to -, curly apostrophes to ', Greek letters to their names."""
    c = F.translate(_text(c), "‐‑‒–—−’‘", "------''")
    return reduce(lambda t, g: F.replace(t, F.lit(g[0]), F.lit(g[1])), GREEK.items(), c) if greek else c


def canonical_virus_names(c: Column) -> Column:
    c = F.regexp_replace(c, rf"(?i)\b(covid){WS}*[-]?{WS}*(19)\b", "$1-$2")
    return F.regexp_replace(c, rf"(?i)\b(sars){WS}*[-]?{WS}*(cov){WS}*[-]?{WS}*(2)\b", "$1-$2-$3")


def tokens_whitespace(c: Column) -> Column:
    return F.filter(F.split(_text(c), f"{WS}+"), lambda x: x != "")


def _zipped(c: Column, pattern: str) -> Column:
    return F.arrays_zip(F.regexp_extract_all(c, F.lit(pattern), F.lit(1)).alias("text"), F.regexp_extract_all(c, F.lit(pattern), F.lit(2)).alias("ws"))


def pieces(c: Column) -> Column:
    """(text, ws) pieces; put together they give the text back, but for white space in front."""
    c = _text(c)
    return _zipped(c, PIECE)


def piece_texts(c: Column) -> Column:
    """Pieces without the white space behind them."""
    return F.regexp_extract_all(_text(c), F.lit(PIECE), F.lit(1))


def chunks(c: Column) -> Column:
    """(text, ws) of runs without white space."""
    pattern = r"([^ \t\n\r\f\x0B]+)([ \t\n\r\f\x0B]*)"
    c = _text(c)
    return _zipped(c, pattern)


#: A word with inner hyphens or apostrophes, a number, white space, or one other sign. What is none of these is lost.
NOISE_TOKEN = r"([A-Za-z]+(?:[-'][A-Za-z0-9]+)*|\p{Nd}+(?:\.\p{Nd}+)?|[ \t\n\r\f\x0B]+|[^\p{L}\p{N}_ \t\n\r\f\x0B])"


def noise_tokens(c: Column) -> Column:
    return F.regexp_extract_all(_text(c), F.lit(NOISE_TOKEN), F.lit(1))


#: Two tokenisers of the case generators: words and codes of two signs and more with a letter; words and codes joined by - _ or /.
CASE_TOKEN = r"([A-Za-z0-9][A-Za-z0-9_-]*[A-Za-z][A-Za-z0-9_-]*)"
JOINED_TOKEN = r"([A-Za-z0-9]+(?:[-_/][A-Za-z0-9]+)*)"


def case_tokens(c: Column, pattern: str = CASE_TOKEN) -> Column:
    return F.regexp_extract_all(_text(c), F.lit(pattern), F.lit(1))


def fragment(toks: Column, i: Column, instead: Column, left: int = 5, right: int = 5) -> Column:
    """The tokens around place ``i`` (from 0) in lower case, with another word in that place."""
    start = F.greatest(F.lit(0), i - left)
    before, behind = F.slice(toks, start + 1, i - start), F.slice(toks, i + 2, F.lit(right))
    return F.array_join(F.concat(F.transform(before, F.lower), F.array(instead), F.transform(behind, F.lower)), " ")


def tokens_spelling(c: Column) -> Column:
    """Lower-case terms with a letter: words, hyphenated or plus-marked terms; numbers and signs go; n't is not."""
    c = canonical_virus_names(normalize(clean_surface(c)))
    c = F.regexp_replace(F.lower(c), r"n't\b", " not")
    found = F.regexp_extract_all(c, F.lit(r"([a-z0-9]+(?:-[a-z0-9]+)*[+]?)"), F.lit(1))
    return F.filter(found, lambda x: x.rlike("[a-z]"))


def classification_text(c: Column) -> Column:
    """Lower case; everything but letters a-z, digits, white space and - _ / becomes a space."""
    return squeeze(F.regexp_replace(F.lower(_text(c)), r"[^a-z0-9 \t\n\r\f\x0B_/-]", " "))


def noise_text(c: Column) -> Column:
    """Case kept; addresses go, dashes are unified, other signs become spaces."""
    c = F.translate(F.regexp_replace(_text(c), URL, " "), "‐‑‒–—−", "------")
    return squeeze(F.regexp_replace(c, r"[^A-Za-z0-9 \t\n\r\f\x0B-]", " "))


def sentences(c: Column, shortest: int = 20) -> Column:
    return F.filter(F.transform(F.split(_text(c), rf"(?<=[.?!]){WS}+"), lambda s: F.btrim(s)), lambda s: F.length(s) >= shortest)


def match_case(original: Column, new: Column) -> Column:
    """The new word in the original's case: all capitals, or a capital first."""
    upper = (original == F.upper(original)) & (original != F.lower(original)) & (F.length(original) > 1)
    first = F.substring(original, 1, 1)
    return F.when(upper, F.upper(new)).when((first == F.upper(first)) & (first != F.lower(first)), F.concat(F.upper(F.substring(new, 1, 1)), F.substring(new, 2, 10**6))).otherwise(new)


def has_letter(c: Column) -> Column:
    return c.rlike(r"\p{L}")


def hash_uniform(*parts: Column) -> Column:
    """A number in [0, 1) from 32 bits of MD5, the same in every engine."""
    return hash_int(*parts) / F.lit(4294967296.0)


def hash_int(*parts: Column) -> Column:
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("long")
