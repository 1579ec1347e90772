"""Token correction: gates, rules, candidates, scores, margins, and the trace of every decision."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from redpen.functions import text as tf
from redpen.functions.gates import domain_rule, gate, protected_word, ui_gate
from redpen.operators.candidates import candidates
from redpen.operators.lexicon import row_totals
from redpen.operators.score import bigram_logp, composite, extras, unigram_logp
from redpen.params import Params

KEYS = ["tok_l", "prev_l", "next_l"]


def lm_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """Lower-case pieces with a letter, a row a document: what the language model counts."""
    return docs.select(F.filter(F.transform(tf.piece_texts(F.col(text)), F.lower), tf.has_letter).alias("words"))


def tokens(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", mode: str = "pieces") -> DataFrame:
    """(doc_id, pos, tok, ws, prev, next) with neighbours from the same array, so no window is needed."""
    array = tf.pieces(F.col(text)) if mode == "pieces" else F.transform(tf.tokens_whitespace(F.col(text)), lambda t: F.struct(t.alias("text"), F.lit(" ").alias("ws")))
    rows = docs.select(F.col(doc_id).alias("doc_id"), array.alias("a"))
    near = F.transform("a", lambda x, i: F.struct(x["text"].alias("tok"), x["ws"].alias("ws"), F.get(F.col("a"), i - 1)["text"].alias("prev"), F.get(F.col("a"), i + 1)["text"].alias("next")))
    return rows.where(F.size("a") > 0).select("doc_id", F.posexplode(near).alias("pos", "x")).select("doc_id", "pos", "x.*")


def prepared(toks: DataFrame) -> DataFrame:
    """Add lower-case twins, gate and rule."""
    t = toks.select("*", F.lower("tok").alias("tok_l"), F.lower("prev").alias("prev_l"), F.lower("next").alias("next_l"))
    return t.select("*", gate(F.col("tok")).alias("gate0"), domain_rule(F.col("tok"), F.col("prev_l"), F.col("next_l")).alias("rule"))


def scored(work: DataFrame, counts: DataFrame, pairs: DataFrame, params: Params = Params()) -> DataFrame:
    """Distinct (tok_l, prev_l, next_l, known) rows to candidates with scores; the original itself has rank 0.

    Counts and totals of types are looked up by join; each of those tables is a vocabulary, so
    Spark hands it out if it is small, and joins by key if not.
    """
    size = counts.agg(F.greatest(F.sum("cnt"), F.lit(1)).alias("n_tokens"), F.count("*").alias("n_types"))
    totals = row_totals(pairs)
    found = candidates(work.select(F.col("tok_l").alias("tok")), counts, params)
    own = work.select("tok_l").distinct().join(counts.select(F.col("word").alias("tok_l"), "cnt"), "tok_l", "left").select("tok_l", F.col("tok_l").alias("cand"), F.lit(0).alias("dist"), F.coalesce("cnt", F.lit(0)).alias("cnt"), F.lit(0).alias("rnk"))
    options = found.select(F.col("tok").alias("tok_l"), "cand", "dist", "cnt", "rnk").union(own)
    rows = work.join(options, "tok_l")
    rows = rows.join(totals.select(F.col("prev").alias("prev_l"), F.col("total").alias("prev_total")), "prev_l", "left")
    rows = rows.join(totals.select(F.col("prev").alias("cand"), F.col("total").alias("cand_total")), "cand", "left")
    rows = rows.join(counts.select(F.col("word").alias("next_l"), F.col("cnt").alias("next_cnt")), "next_l", "left")
    rows = rows.join(pairs.select(F.col("prev").alias("prev_l"), F.col("word").alias("cand"), F.col("cnt").alias("left_cnt")), ["prev_l", "cand"], "left")
    rows = rows.join(pairs.select(F.col("prev").alias("cand"), F.col("word").alias("next_l"), F.col("cnt").alias("right_cnt")), ["cand", "next_l"], "left")
    rows = rows.crossJoin(F.broadcast(size))  # one row
    n, v = F.col("n_tokens"), F.col("n_types")
    alone, next_alone = unigram_logp(F.col("cnt"), n, v, params), unigram_logp(F.col("next_cnt"), n, v, params)
    left = bigram_logp(F.col("prev_l"), F.col("left_cnt"), F.col("prev_total"), alone, v, params)
    right = F.when(F.col("next_l").isNotNull(), bigram_logp(F.col("cand"), F.col("right_cnt"), F.col("cand_total"), next_alone, v, params))
    pay = F.when(F.col("rnk") == 0, 0.0).otherwise(extras(F.col("known"), F.col("dist"), F.abs(F.length("cand") - F.length("tok_l")), params))
    return rows.select(*KEYS, "known", "cand", "dist", "rnk", (composite(alone, left, right, F.col("cnt"), F.col("dist"), params) - pay).alias("score"), left.alias("left_logp"), "cnt", "left_cnt", "right_cnt")


def decided(scores: DataFrame, params: Params = Params(), trace: bool = False) -> DataFrame:
    """One row for each distinct context: the best option, its margin and the decision. One aggregation picks the best."""
    place = F.struct((-F.round("score", 9)).alias("o"), F.col("rnk").alias("rnk"), F.col("cand").alias("cand"), F.col("dist").alias("dist"), F.col("score").alias("score"))
    # an unknown word's original does not compete
    competes = F.col("known") | (F.col("rnk") > 0)
    listed = F.slice(F.array_sort(F.collect_list(F.when(competes, F.struct("rnk", F.col("cand").alias("word"), "dist", F.round("score", 4).alias("score"))))), 1, params.trace_candidates)
    aggs = [F.min(F.when(competes, place)).alias("best"), F.max(F.when(F.col("rnk") == 0, F.col("score"))).alias("original_score")]
    best = scores.groupBy(*KEYS, "known").agg(*aggs, *([listed.alias("candidates")] if trace else []))
    margin = F.col("best.score") - F.col("original_score")
    threshold = F.when(F.col("known"), F.lit(params.delta_rw)).otherwise(F.lit(params.delta))
    moved = F.coalesce(F.col("best.rnk") > 0, F.lit(False))
    applied = moved & (F.round(margin, 9) >= threshold)
    refused = moved & ~applied
    return best.select(
        *KEYS, "known", F.when(applied, F.col("best.cand")).alias("best_word"), F.when(moved, margin).alias("margin"), F.when(moved, F.col("best.cand")).alias("best_candidate"), F.when(moved, F.col("best.score")).alias("best_score"), "original_score",
        F.when(moved, F.col("best.dist")).alias("edit_distance"), refused.alias("refused"), applied.alias("applied"), threshold.alias("threshold_used"), *(["candidates"] if trace else []),
    )


def decide(tokens_: DataFrame, counts: DataFrame, pairs: DataFrame, params: Params = Params(), trace: bool = False) -> DataFrame:
    """Rows with tok, prev and next, and any other columns, with the decision on each: corrected, error_type, decision, protected, gate, margin and more.

    Only tokens that no gate, rule or protected word settles are scored, and each distinct context once.
    """
    known = counts.where(F.col("cnt") >= params.min_count).select(F.col("word").alias("tok_l"), F.lit(True).alias("in_vocab"))
    toks = prepared(tokens_).join(known, "tok_l", "left").withColumn("known", F.col("in_vocab").isNotNull()).drop("in_vocab")
    settled_first = F.col("rule").isNotNull() | F.col("gate0").isNotNull() | (F.col("tok") == "")
    word_gate = F.col("known") & protected_word(F.col("tok_l"))
    work = toks.where(~settled_first & ~word_gate).select(*KEYS, "known").distinct()
    choice = decided(scored(work, counts, pairs, params), params, trace).drop("known").withColumnsRenamed({k: f"of_{k}" for k in KEYS})
    same = [F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in KEYS]
    rows = toks.join(choice, same[0] & same[1] & same[2], "left")
    by_rule = F.col("rule").isNotNull() & (F.lit(params.rules_before_gates) | F.col("gate0").isNull())
    gated = F.col("gate0").isNotNull() & ~by_rule
    applied = F.coalesce("applied", F.lit(False)) & ~by_rule & ~gated
    refused = F.coalesce("refused", F.lit(False))
    gate_name = F.when(by_rule, F.lit(None)).when(gated, F.col("gate0")).when(F.col("known") & protected_word(F.col("tok_l")), "real_word_protect").when(refused, F.when(F.col("known"), "margin_delta_rw").otherwise("margin_delta"))
    kind = F.when(by_rule, "Real-word error").when(gated, "Correct").when(applied, F.when(F.col("known"), "Real-word error").otherwise("Non-word error")).when(F.col("known") | (F.col("tok") == ""), "Correct").otherwise("Unknown (OOV)")
    return rows.select(
        *tokens_.columns, F.when(by_rule, F.col("rule")).when(applied, F.col("best_word")).otherwise(F.col("tok")).alias("corrected"), kind.alias("error_type"), F.when(by_rule | applied, "apply").otherwise("abstain").alias("decision"),
        gate_name.isNotNull().alias("protected"), gate_name.alias("gate"), "margin", "best_candidate", "best_score", "original_score", "edit_distance", "threshold_used",
        F.when(F.col("known"), "delta_rw").otherwise("delta").alias("threshold_type"), F.lit(params.version).alias("artifact_version"), F.lit("delete_index").alias("retrieval_method"), *(["candidates"] if trace else []),
    )


def correct_tokens(docs: DataFrame, counts: DataFrame, pairs: DataFrame, params: Params = Params(), trace: bool = False, mode: str = "pieces") -> DataFrame:
    """Every token of the documents with its decision. Context is the original text."""
    return decide(tokens(docs, mode=mode), counts, pairs, params, trace)


def alphabetic_neighbours(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, pos, tok, ws, prev, next) as interactive correction sees them: neighbours are the nearest words of nothing but letters, in lower case."""
    rows = tokens(docs, doc_id, text).drop("prev", "next")
    word = F.when(F.col("tok").rlike(r"^\p{L}+$"), F.lower("tok"))
    w = Window.partitionBy("doc_id").orderBy("pos")
    before, behind = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    return rows.select("*", F.last(word, ignorenulls=True).over(before).alias("prev"), F.first(word, ignorenulls=True).over(behind).alias("next"))


def interactive(docs: DataFrame, counts: DataFrame, pairs: DataFrame, params: Params = Params(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, pos, tok, ws, corrected, error_type) as in interactive use: a gate of its own, alphabetic context, and corrections in the original's case."""
    rows = alphabetic_neighbours(docs, doc_id, text)
    left_alone = rows.where(ui_gate(F.col("tok"))).select("doc_id", "pos", "tok", "ws", F.col("tok").alias("corrected"), F.lit("Correct").alias("error_type"))
    tried = decide(rows.where(~ui_gate(F.col("tok"))), counts, pairs, params)
    return tried.select("doc_id", "pos", "tok", "ws", tf.match_case(F.col("tok"), F.col("corrected")).alias("corrected"), "error_type").unionByName(left_alone)


def with_typo_map(rows: DataFrame, typos: DataFrame, counts: DataFrame, params: Params = Params()) -> DataFrame:
    """Decided rows, with unknown words replaced by what a map (typo, word) has for them, if that is a known word."""
    known = counts.where(F.col("cnt") >= params.min_count).select(F.lower("word").alias("known_word"))
    usable = typos.select(F.lower("typo").alias("typo_l"), F.lower("word").alias("known_word")).join(known, "known_word", "left_semi").dropDuplicates(["typo_l"])
    both = rows.join(usable, F.lower("tok") == F.col("typo_l"), "left").join(known.select(F.col("known_word").alias("itself")), F.lower("tok") == F.col("itself"), "left")
    mapped = F.col("typo_l").isNotNull() & F.col("itself").isNull() & (F.col("decision") == "abstain")
    new = {"corrected": tf.match_case(F.col("tok"), F.col("known_word")), "error_type": F.lit("Non-word error"), "decision": F.lit("apply")}
    return both.select(*[F.when(mapped, new[c]).otherwise(F.col(c)).alias(c) if c in new else c for c in rows.columns])


def over_unique_texts(docs: DataFrame, correct, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, corrected_text) by correcting each distinct text once. ``correct`` takes (doc_id, text) and gives (doc_id, corrected_text)."""
    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("h"))
    once = named.where("text IS NOT NULL").groupBy("h", "text").agg(F.min("doc_id").alias("first"))
    done = correct(once.select(F.col("first").alias("doc_id"), "text")).select(F.col("doc_id").alias("first"), "corrected_text")
    return named.join(once, ["h", "text"]).join(done, "first").select("doc_id", "corrected_text")


def tuned(work: DataFrame, counts: DataFrame, pairs: DataFrame, grid: DataFrame, params: Params = Params()) -> DataFrame:
    """(ordinal, KEYS, known, best_word) for each configuration of a small grid (ordinal, delta, delta_rw, w_dist, w_left). Everything but the sums is worked out once, and a context's options meet the
    configurations as one array, so nothing as large as options times configurations is shuffled or sorted."""
    option = F.struct("rnk", "cand", "dist", "score", "left_logp")
    rows = scored(work, counts, pairs, params).groupBy(*KEYS, "known").agg(F.collect_list(option).alias("options")).crossJoin(F.broadcast(grid))
    score = lambda x: x["score"] + (F.col("w_left") - params.w_left) * x["left_logp"] - (F.col("w_dist") - params.w_distance) * x["dist"]
    place = lambda x: F.struct((-F.round(score(x), 9)).alias("o"), x["rnk"].alias("rnk"), x["cand"].alias("cand"), score(x).alias("score"))
    competes = lambda x: F.col("known") | (x["rnk"] > 0)
    own = F.array_max(F.transform(F.filter("options", lambda x: x["rnk"] == 0), score))
    best = rows.select("ordinal", "delta", "delta_rw", *KEYS, "known", F.array_min(F.transform(F.filter("options", competes), place)).alias("best"), own.alias("own"))
    enough = F.round(F.col("best.score") - F.col("own"), 9) >= F.when(F.col("known"), F.col("delta_rw")).otherwise(F.col("delta"))
    return best.select("ordinal", *KEYS, "known", F.when((F.col("best.rnk") > 0) & enough, F.col("best.cand")).alias("best_word"))


def doc_summary(rows: DataFrame) -> DataFrame:
    """(doc_id, total_tokens, tokens_changed, tokens_protected, tokens_abstained, edit_rate)."""
    changed = F.count_if(F.col("decision") == "apply")
    return rows.groupBy("doc_id").agg(
        F.count("*").alias("total_tokens"), changed.alias("tokens_changed"), F.count_if("protected").alias("tokens_protected"), F.count_if((F.col("decision") == "abstain") & ~F.col("protected")).alias("tokens_abstained"),
        F.round(changed / F.count("*"), 6).alias("edit_rate"),
    )


def corrected_text(rows: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """(doc_id, corrected_text): pieces put together again, right-trimmed. Overrides are (doc_id, pos, word)."""
    word = F.col("corrected")
    if overrides is not None:
        rows, word = rows.join(overrides, ["doc_id", "pos"], "left"), F.coalesce("word", "corrected")
    parts = F.array_sort(F.collect_list(F.struct("pos", F.concat(word, "ws").alias("part"))))
    return rows.groupBy("doc_id").agg(F.rtrim(F.array_join(F.transform(parts, lambda p: p["part"]), "")).alias("corrected_text"))


def respaced_text(rows: DataFrame) -> DataFrame:
    """(doc_id, corrected_text): corrected tokens with single spaces; the original spacing is lost."""
    parts = F.array_sort(F.collect_list(F.struct("pos", "corrected")))
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda p: p["corrected"]), " ").alias("corrected_text"))


def ratio_rule(rows: DataFrame, pairs: DataFrame, word: str, instead: str, ratio: int = 20) -> DataFrame:
    """Add ``by_ratio``: ``instead`` for tokens ``word`` whose previous word is followed by it at least ``ratio`` times as often as by ``word``, one added; else null."""
    after = pairs.where(F.col("word").isin(word, instead)).groupBy(F.col("prev").alias("before")).agg(F.sum(F.when(F.col("word") == word, F.col("cnt")).otherwise(0)).alias("was"), F.sum(F.when(F.col("word") == instead, F.col("cnt")).otherwise(0)).alias("new"))
    both = rows.join(after, F.lower("prev") == F.col("before"), "left")
    holds = (F.lower("tok") == word) & (F.col("new") > 0) & (F.col("new") >= ratio * (F.col("was") + 1))
    return both.withColumn("by_ratio", F.when(holds, instead)).drop("before", "was", "new")


def suggestions(words: DataFrame, counts: DataFrame, params: Params = Params(), n: int = 8, shown: int = 5) -> DataFrame:
    """The n best candidates by context-free score, of them those shown: nearest, then most frequent. (tok, cand, dist, cnt, rank)."""
    size = counts.agg(F.sum("cnt").alias("n_tokens"), F.count("*").alias("n_types"))
    rows = candidates(words, counts, params).crossJoin(F.broadcast(size))
    alone = unigram_logp(F.col("cnt"), F.col("n_tokens"), F.col("n_types"), params)
    score = F.round(composite(alone, alone, F.lit(0.0), F.col("cnt"), F.col("dist"), params), 9)
    first = rows.withColumn("r", F.row_number().over(Window.partitionBy("tok").orderBy(score.desc(), "rnk"))).where(F.col("r") <= n)
    rank = F.row_number().over(Window.partitionBy("tok").orderBy("dist", F.desc("cnt"), "cand"))
    return first.withColumn("rank", rank).where(F.col("rank") <= shown).select("tok", "cand", "dist", "cnt", "rank")


def edit_rate_report(summaries: DataFrame, threshold: float) -> DataFrame:
    """One row: documents, alerts above the threshold, and the mean of the rounded rates. Empty documents are not counted."""
    rows = summaries.where(F.col("total_tokens") > 0)
    return rows.agg(F.count("*").alias("total_docs"), F.count_if(F.col("edit_rate") > threshold).alias("alerts"), F.round(F.avg("edit_rate"), 6).alias("mean_edit_rate")).withColumn("threshold", F.lit(threshold))


def cache_hits(rows: DataFrame) -> DataFrame:
    """Flag every occurrence of a token but its first, by document and place."""
    first = Window.partitionBy(F.lower("tok")).orderBy("doc_id", "pos")
    return rows.withColumn("candidate_cache_hit", F.row_number().over(first) > 1)

