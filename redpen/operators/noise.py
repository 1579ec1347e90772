"""Seeded noise. Randomness comes from hashes of seed, row and place, so results don't depend on how rows are dealt out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from redpen.functions import text as tf
from redpen.lexicons import CHARACTER_CONFUSIONS, NOISE_LEVELS, NOISE_STOP_WORDS, OCR_PAIRS

LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: Operators of one edit, by equal shares of a uniform number.
OPERATORS = ("transpose", "delete", "insert", "substitute")


def biomedical(tok: Column) -> Column:
    return (tok.rlike("[0-9]") & tok.rlike("[A-Za-z]")) | (F.contains(tok, F.lit("-")) & tok.rlike("[A-Za-z]"))


def eligible(tok: Column) -> Column:
    return tok.rlike("^[A-Za-z]+$") & (F.length(tok) >= 5) & ~F.lower(tok).isin(*NOISE_STOP_WORDS) & ~biomedical(tok)


def case_word(tok: Column) -> Column:
    """Eligible for generated cases: 4 to 14 plain letters."""
    return tok.rlike("^[A-Za-z]{4,14}$")


def pick(u: Column, n: Column) -> Column:
    """A whole number from 1 to n for u in [0, 1)."""
    return F.floor(u * n).cast("int") + 1


def edit(w: Column, op: Column, at: Column, letter: Column) -> Column:
    """One edit of ``w`` at place ``at`` (from 1): the typo operators."""
    n = F.length(w)
    head, tail = F.substring(w, F.lit(1), at - 1), F.substring(w, at + 1, n)
    this, nxt = F.substring(w, at, F.lit(1)), F.substring(w, at + 1, F.lit(1))
    return (
        F.when(op == "delete", F.concat(head, tail))
        .when(op == "insert", F.concat(head, letter, this, tail))
        .when(op == "substitute", F.concat(head, letter, tail))
        .when((op == "transpose") & (at < n), F.concat(head, nxt, this, F.substring(w, at + 2, n)))
        .otherwise(w)
    )


def letter_of(u: Column) -> Column:
    return F.substring(F.lit(LETTERS), pick(u, F.lit(26)), F.lit(1))


def let(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, however often it is mentioned."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def confused(this: Column, u: Column) -> Column:
    """A letter that is easily taken for this one; itself at times, as the table has it."""
    out = letter_of(u)
    for k, others in CHARACTER_CONFUSIONS.items():
        out = F.when(this == k, F.substring(F.lit(others), pick(u, F.lit(len(others))), F.lit(1))).otherwise(out)
    return out


def ocr(w: Column, u: Column) -> Column:
    """One of the pairs that apply, by equal shares, at its first place; null if none applies."""
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in OCR_PAIRS])
    apply = lambda p: let(F.position(p["a"], w), lambda at: F.concat(F.substring(w, F.lit(1), at - 1), p["b"], F.substring(w, at + F.length(p["a"]), F.length(w))))
    return let(F.filter(pairs, lambda p: F.contains(w, p["a"])), lambda some: let(F.get(some, pick(u, F.size(some)) - 1), lambda p: F.when(F.size(some) > 0, apply(p))))


def capital_first(original: Column, new: Column) -> Column:
    return F.when(original.rlike("^[A-Z]"), F.concat(F.upper(F.substring(new, 1, 1)), F.substring(new, 2, 10**6))).otherwise(new)


def one_edit(word: Column, u, p_ocr: float) -> Column:
    """A scan confusion with probability ``p_ocr`` if any applies, else one of four operators; the first capital stays. ``u`` gives uniform numbers by name."""

    def of(w: Column) -> Column:
        n = F.length(w)
        op = F.element_at(F.array(*map(F.lit, OPERATORS)), pick(u("op"), F.lit(4)))
        at = let(op, lambda o: pick(u("at"), F.when(o == "transpose", n - 1).when(o == "insert", n + 1).otherwise(n)))
        typo = let(op, lambda o: let(at, lambda i: edit(w, o, i, F.when(o == "substitute", confused(F.substring(w, i, F.lit(1)), u("let"))).otherwise(letter_of(u("let"))))))
        return F.when(u("ocr") < p_ocr, F.coalesce(ocr(w, u("pair")), typo)).otherwise(typo)

    return capital_first(word, let(F.lower(word), of))


def variant_seeds(df: DataFrame, row_id: str, seed: int, variants: int = 1, levels=NOISE_LEVELS) -> DataFrame:
    """Each row once for each level and variant, with the variant's seed. Levels and variants are literals, so this is no join."""
    each = F.array(*[F.struct(F.lit(n).alias("corruption_level"), F.lit(p).alias("p"), F.lit(m).alias("max_edits"), F.lit(v).cast("long").alias("variant_id")) for n, p, m in levels for v in range(variants)])
    rows = df.select("*", F.explode(each).alias("x")).select(*df.columns, "x.*")
    return rows.withColumn("seed_variant", tf.hash_int(F.lit(seed), F.col(row_id), F.col("corruption_level"), F.col("variant_id")))


def _summed(toks: Column, word: str) -> Column:
    return F.size(F.filter(toks, lambda t: t[word])).cast("long")


def corrupted(rows: DataFrame, row_id: str, text: str = "text", p_ocr: float = 0.35, keys: tuple[str, ...] = (), punctuation: bool = False) -> DataFrame:
    """(row_id, keys, noisy_text, edited_tokens, total_word_tokens) of rows with seed_variant, p and max_edits.

    A word is edited if its uniform number is under p, once to max_edits times by equal shares. With ``punctuation`` a mark of , . ; :
    is dropped with probability p / 12. All of it is a function of the row, so nothing is shuffled.
    """
    u = lambda i, k: tf.hash_uniform(F.col("seed_variant"), i, F.lit(k))
    word = lambda t: t.rlike("^[A-Za-z]+$")
    hit = lambda t, i: eligible(t) & (u(i, "hit") < F.col("p"))
    first = F.transform("toks", lambda t, i: F.struct(t.alias("t"), word(t).alias("word"), hit(t, i).alias("hit")))
    once = F.transform("toks", lambda x, i: F.struct(x["word"].alias("word"), x["hit"].alias("hit"), F.when(x["hit"], one_edit(x["t"], lambda k: u(i, f"a{k}"), p_ocr)).otherwise(x["t"]).alias("t")))
    more = lambda x, i: x["hit"] & (pick(u(i, "edits"), F.col("max_edits")) > 1)
    twice = F.transform("toks", lambda x, i: F.struct(x["word"].alias("word"), x["hit"].alias("hit"), F.when(more(x, i), one_edit(x["t"], lambda k: u(i, f"b{k}"), p_ocr)).otherwise(x["t"]).alias("t")))
    out = rows.select(row_id, *keys, "seed_variant", "p", "max_edits", tf.noise_tokens(F.col(text)).alias("toks")).withColumn("toks", first).withColumn("toks", once).withColumn("toks", twice)
    if punctuation:
        dropped = lambda x, i: x["t"].isin(",", ".", ";", ":") & (u(i, "mark") < F.col("p") / 6) & (u(i, "drop") < 0.5)
        out = out.withColumn("toks", F.transform("toks", lambda x, i: F.struct(x["word"].alias("word"), x["hit"].alias("hit"), F.when(dropped(x, i), "").otherwise(x["t"]).alias("t"))))
    return out.select(row_id, *keys, F.array_join(F.transform("toks", lambda x: x["t"]), "").alias("noisy_text"), _summed(F.col("toks"), "hit").alias("edited_tokens"), _summed(F.col("toks"), "word").alias("total_word_tokens"))


def paper_noise(rows: DataFrame, row_id: str, text: str, seed: int) -> DataFrame:
    """(row_id, noisy_text, edited_tokens, total_word_tokens): a word of length n is hit with probability 0.15 / sqrt(n); half are substitutions by letters
    that look alike, a quarter each deletions (of two letters and more) and insertions. The first capital stays."""

    def noisy(t: Column, i: Column) -> Column:
        u = lambda k: tf.hash_uniform(F.lit(seed), F.col("row_id"), i, F.lit(k))

        def of(w: Column) -> Column:
            n = F.length(w)
            op = F.when(u("op") < 0.5, "substitute").when(u("op") < 0.75, F.when(n > 1, "delete").otherwise("none")).otherwise("insert")
            return let(op, lambda o: let(pick(u("at"), F.when(o == "insert", n + 1).otherwise(n)), lambda at: edit(w, o, at, F.when(o == "substitute", confused(F.substring(w, at, F.lit(1)), u("let"))).otherwise(letter_of(u("let"))))))

        word = t.rlike("^[A-Za-z]+$")
        hit = word & (u("hit") < F.lit(0.15) / F.sqrt(F.length(t)))
        return let(hit, lambda h: F.struct(word.alias("word"), h.alias("hit"), F.when(h, capital_first(t, let(F.lower(t), of))).otherwise(t).alias("t")))

    done = rows.select(F.col(row_id).alias("row_id"), tf.noise_tokens(F.col(text)).alias("toks")).withColumn("toks", F.transform("toks", noisy))
    return done.select("row_id", F.array_join(F.transform("toks", lambda x: x["t"]), "").alias("noisy_text"), _summed(F.col("toks"), "hit").alias("edited_tokens"), _summed(F.col("toks"), "word").alias("total_word_tokens"))
