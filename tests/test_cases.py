"""Noise, mined cases, thresholds and the interactive corrector, against plain Python on small tables."""

import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from redpen.functions.gates import ui_gate
from redpen.lexicons import CHARACTER_CONFUSIONS, OCR_PAIRS
from redpen.operators import cases, correct, lexicon, noise
from redpen.operators.score import keep_threshold


def uniform(*parts):
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:8], 16) / 2**32


def one_edit(word, u):
    w = word.lower()
    scan = [(a, b) for a, b in OCR_PAIRS if a in w]
    if u("ocr") < 0.35 and scan:
        new = w.replace(*scan[int(u("pair") * len(scan))], 1)
    else:
        op = noise.OPERATORS[int(u("op") * 4)]
        i = int(u("at") * (len(w) - 1 if op == "transpose" else len(w) + 1 if op == "insert" else len(w)))
        if op == "transpose":
            new = w[:i] + w[i + 1] + w[i] + w[i + 2 :]
        elif op == "delete":
            new = w[:i] + w[i + 1 :]
        elif op == "insert":
            new = w[:i] + noise.LETTERS[int(u("let") * 26)] + w[i:]
        else:
            of = CHARACTER_CONFUSIONS.get(w[i], noise.LETTERS)
            new = w[:i] + of[int(u("let") * len(of))] + w[i + 1 :]
    return new[:1].upper() + new[1:] if word[0].isupper() else new


def test_every_edit_of_the_noise(spark):
    words = ["Modern", "clinical", "Window", "fluids", "isolated", "Immune", "tiny", "the", "sars-cov", "Éclair", "12.5", "…", "trials"]
    text = " ".join(words * 20) + "\n"
    rows = noise.variant_seeds(spark.createDataFrame([(1, text)], "id long, text string"), "id", 3, levels=(("all", 0.9, 2),))
    got = noise.corrupted(rows, "id", keys=("seed_variant",)).first()
    seed, out, hits = got["seed_variant"], [], 0
    toks = re.findall(r"[A-Za-z]+(?:[-'][A-Za-z0-9]+)*|\d+(?:\.\d+)?|\s+|[^\w\s]", text)
    for i, t in enumerate(toks):
        if re.fullmatch("[A-Za-z]{5,}", t) and uniform(seed, i, "hit") < 0.9:
            hits += 1
            t = one_edit(t, lambda k, i=i: uniform(seed, i, f"a{k}"))
            if int(uniform(seed, i, "edits") * 2) + 1 > 1:
                t = one_edit(t, lambda k, i=i: uniform(seed, i, f"b{k}"))
        out.append(t)
    assert got["noisy_text"] == "".join(out) and got["edited_tokens"] == hits > 50
    assert got["total_word_tokens"] == sum(t.isalpha() for t in toks)


def test_paper_noise_keeps_words_of_one_letter(spark):
    got = noise.paper_noise(spark.createDataFrame([(i, "A b c d e f " * 20) for i in range(20)], "id long, text string"), "id", "text", 5).collect()
    assert sum(r["edited_tokens"] for r in got) > 100 and all(len(r["noisy_text"].split()) == 120 for r in got)
    assert all(w[0].isupper() for r in got for w in r["noisy_text"].split()[::6])


def test_cases_hold_typos_and_harmless_words(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 15))) for _ in range(150)]
    counts = spark.createDataFrame([(w, 10 + i) for i, w in enumerate(words)], "word string, cnt long")
    pairs = spark.createDataFrame([(rng.choice(words), w, rng.randint(1, 9)) for w in words for _ in range(3)], "prev string, word string, cnt long").groupBy("prev", "word").agg(F.sum("cnt").alias("cnt"))
    got = cases.typo_cases(counts, pairs).collect()
    assert {r["expected"] for r in got} <= {w for i, w in enumerate(words) if i >= 10 and 4 <= len(w) <= 14} and len(got) > 90
    seen = {(r["prev"], r["word"]): r["cnt"] for r in pairs.collect()}
    for r in got:
        w, e = r["wrong"], r["expected"]
        assert {"negative": 0, "trans": 0, "rep": 0, "ins": 1, "del": -1, "dist2_del_rep": -1}[r["subcategory"] if r["category"] != "negative" else "negative"] == len(w) - len(e)
        assert (w == e) == (r["category"] == "negative")
        left = [(-n, p) for (p, x), n in seen.items() if x == e]
        assert r["prev"] == (min(left)[1] if left else None)


def test_hard_subset_is_the_greedy_walk(spark):
    rng = random.Random(2)
    quota = (("real-word", "both-needed", 4), ("real-word", "right-only", 5), ("non-word", "trans", 3), ("covid-normalization", "covid-18-variant", 2))
    rows = [(f"c{i:03d}", c, s, rng.choice(["aa", "bbb", "cccc"]) + rng.choice(["", "", "x"]), rng.choice(["dd", "eee"])) for i in range(120) for c, s, _ in [rng.choice(quota)]]
    got = cases.hard_subset(spark.createDataFrame(rows, "case_id string, category string, subcategory string, wrong string, expected string"), quota).collect()

    def hard(c, s, w, e):
        base = {"real-word": 10 + {"both-needed": 3, "right-only": 2}.get(s, 0), "non-word": 7 + {"trans": 2}.get(s, 0), "covid-normalization": 6}[c]
        return round(base + 0.12 * len(w) + 0.05 * len(e), 6)

    pair, wrong, want = {}, {}, []
    for c, s, n in quota:
        taken = 0
        for i, *_, w, e in sorted((r for r in rows if (r[1], r[2]) == (c, s)), key=lambda r: (-hard(*r[1:]), r[0])):
            if taken < n and pair.get((c, w, e), 0) < 2 and wrong.get((c, w), 0) < (1 if c == "covid-normalization" else 2):
                want.append((c, s, i))
                pair[c, w, e], wrong[c, w], taken = pair.get((c, w, e), 0) + 1, wrong.get((c, w), 0) + 1, taken + 1
    assert sorted((r["category"], r["subcategory"], r["case_id"]) for r in got) == sorted(want)
    with pytest.raises(RuntimeError):
        cases.hard_subset(spark.createDataFrame(rows[:3], "case_id string, category string, subcategory string, wrong string, expected string"), quota, must_meet=True)


def test_adaptive_threshold(spark):
    rng = random.Random(3)
    n = lambda: rng.choice([None, 0, 1, 3, 60, 300, 10**5, 10**6])
    rows = [(rng.uniform(-50, 0), n(), n(), n(), n(), n(), n(), rng.choice([1, 2, 3])) for _ in range(200)]
    names = ("score", "c", "l", "r", "bc", "bl", "br", "dist")
    df = spark.createDataFrame(rows, "score double, " + ", ".join(f"{k} long" for k in names[1:]))
    col = F.col
    got = df.select(*names, keep_threshold({"score": col("score"), "cnt": col("c"), "left": col("l"), "right": col("r")}, {"cnt": col("bc"), "left": col("bl"), "right": col("br")}, col("dist")).alias("t")).collect()
    for r in got:
        c, left, right, bc, bl, br = (r[k] or 0 for k in names[1:7])
        z = math.log10(c + 1)
        need = 5 + (1 if z >= 5.5 else 0.6 if z >= 4.5 else -0.7 if z <= 2 else -0.4 if z <= 2.5 else 0) + {1: -0.4, 2: 0.8}.get(r["dist"], 0)
        off = 0.0
        if bl + br > 0:
            off = max(0, min(3, 1.3 * math.log10((bl + br + 1) / (left + right + 1)))) + 0.5 * (bl + br >= 50) + 0.5 * (bl + br >= 200)
        off += max(0, min(1, 0.8 * math.log10((bc + 1) / (c + 1))))
        assert r["t"] == pytest.approx(max(r["score"] + need - min(off, 4), r["score"] + 1.5))


def test_interactive_gate_and_context(spark):
    toks = ["covid", "Covid-19", "SARS-CoV-2", "2019ncov", "covidien2", "a_b", "x*y", "a\\b", "c+d", "αβγδ", "it", "word", "w" * 26, "--"]
    got = {r[0]: r[1] for r in spark.createDataFrame([(t,) for t in toks], "t string").select("t", ui_gate(F.col("t"))).collect()}
    assert {t for t, left in got.items() if not left} == {"covid", "Covid-19", "SARS-CoV-2", "2019ncov", "word"}
    docs = spark.createDataFrame([(1, "One two-three 4 , Five six")], "doc_id long, text string")
    near = [(r["tok"], r["prev"], r["next"]) for r in correct.alphabetic_neighbours(docs).orderBy("pos").collect()]
    assert near == [("One", None, "five"), ("two-three", "one", "five"), ("4", "one", "five"), (",", "one", "five"), ("Five", "one", "six"), ("six", "five", None)]


def test_typo_map_and_unique_texts(spark):
    counts = spark.createDataFrame([("treatment", 9), ("rare", 1)], "word string, cnt long")
    docs = spark.createDataFrame([(1, "Tretment of xyzzy"), (2, "Tretment of xyzzy"), (3, None)], "doc_id long, text string")
    pairs = lexicon.bigrams(spark.createDataFrame([(["treatment"],)], "words array<string>"))
    plain = correct.correct_tokens(docs, counts.where("cnt > 99"), pairs)
    mapped = correct.with_typo_map(plain, spark.createDataFrame([("tretment", "treatment"), ("xyzzy", "rare")], "typo string, word string"), counts)
    assert {(r["tok"], r["corrected"]) for r in mapped.collect()} == {("Tretment", "Treatment"), ("of", "of"), ("xyzzy", "xyzzy")}
    seen = []

    def once(texts):
        seen.append(texts.count())
        return texts.select("doc_id", F.upper("text").alias("corrected_text"))

    out = correct.over_unique_texts(docs, once).collect()
    assert seen == [1] and sorted((r["doc_id"], r["corrected_text"]) for r in out) == [(1, "TRETMENT OF XYZZY"), (2, "TRETMENT OF XYZZY")]


def test_grid_search_and_leaderboard(spark):
    from pyspark.ml.linalg import Vectors

    from redpen.operators import classify

    rng = random.Random(4)
    rows = [(i, float(i % 2), Vectors.dense([i % 2 + rng.gauss(0, 0.4), rng.gauss(0, 1)]), 1.0) for i in range(60)]
    frame = spark.createDataFrame(rows, ["doc_id", "label", "features", "class_weight"])
    tried = classify.grid_search(frame, 2, (0.1, 10.0))
    assert [c for c, _ in tried] == [0.1, 10.0] and all(0.5 < f <= 1 for _, f in tried)
    board = classify.leaderboard(spark.createDataFrame([("b", 0.9, 0.8), ("a", 0.7, 0.8), ("c", 0.6, 0.9)], "model string, accuracy double, f1_macro double"))
    assert [r["model"] for r in board.collect()] == ["c", "a", "b"]
