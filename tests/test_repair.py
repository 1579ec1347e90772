"""Correction from mapped files: candidates against brute force, decisions against the join form."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from redpen.operators import correct, lexicon, neighbourhoods, repair
from redpen.params import Params
from redpen.plans.queries import QUERIES

SENTENCES = ["the patient received treatment for infection", "the patient received the treatment today, at noon", "severe infection needs treatment", "treatments of patients and patience"]
LONG = "pneumonoultramicroscopicsilicovolcanoconiosis"


def distance(a: str, b: str) -> int:
    """Damerau-Levenshtein distance with edits between swapped letters."""
    far, last = len(a) + len(b), {}
    d = {(i, j): far if min(i, j) < 0 else max(i, j) for i in range(-1, len(a) + 1) for j in range(-1, len(b) + 1)}
    for i, x in enumerate(a, 1):
        at = 0
        for j, y in enumerate(b, 1):
            k, m = last.get(y, 0), at
            at = j if x == y else at
            d[i, j] = min(d[i - 1, j - 1] + (x != y), d[i, j - 1] + 1, d[i - 1, j] + 1, d[k - 1, m - 1] + i - k + j - m - 1)
        last[x] = i
    return d[len(a), len(b)]


@pytest.mark.parametrize("most", [3, 80])
def test_nearest_words(most):
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("abcé") for _ in range(rng.randrange(1, 7))) for _ in range(220)} | {"ab" * 15, "ba" * 15, "ab" * 14 + "a"})
    cnt = np.sort([rng.randrange(1, 30) for _ in words])[::-1]
    c, n = neighbourhoods.codes(words)
    cut = next(i for i in range(60, len(words)) if cnt[i] != cnt[i - 1])
    ids = np.arange(len(words))
    blocks = [neighbourhoods.index(c[s], n[s], ids[s]) for s in (slice(cut), slice(cut, None))]
    many, word, dist = neighbourhoods.ranked(*neighbourhoods.nearest((c, n), ids, (c, n), blocks, most), cnt, len(words), most)
    got = np.split(np.stack([word, dist], 1), np.cumsum(many)[:-1])
    for i, w in enumerate(words):
        want = sorted((-cnt[j], distance(w, x), j) for j, x in enumerate(words) if j != i and distance(w, x) <= 2)[:most]
        assert got[i].tolist() == [[j, d] for _, d, j in want]


@pytest.fixture(scope="module")
def model(spark):
    words = correct.lm_words(spark.createDataFrame([(x,) for x in [*SENTENCES * 5, *[f"a case of {LONG}, rare"] * 4]], "text string"))
    return lexicon.unigrams(words).cache(), lexicon.bigrams(words).cache()


@pytest.mark.parametrize("params", [Params(), Params(bigram_mode="backoff", delta_rw=0.5), Params(rules_before_gates=True, max_candidates=1), Params(min_count=6, delta=1.0)])
def test_decisions_are_those_of_the_join_form(spark, model, params, monkeypatch):
    rng = random.Random(5)
    texts = [None, "", " \n ", "!", "covid-18 COVID19 Covid19, verses infection", f"{LONG[:9]}{LONG[10:]} {LONG}s", "TREATMENT treatment tretment", "naïve patïent", "of the the", "patient"]
    for _ in range(40):
        letters = list(rng.choice(SENTENCES))
        for _ in range(4):
            letters[rng.randrange(len(letters))] = rng.choice("aeist ")
        texts.append("".join(letters))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    monkeypatch.setattr(repair, "TOKENS", 50)  # many parts
    monkeypatch.setattr(repair, "FIRST_BLOCK", 4)
    got = repair.correct_tokens(docs, *model, params)
    want = correct.correct_tokens(docs, *model, params).select(got.columns)
    rows = lambda df: [(*r[:-1], r[-1] and round(r[-1], 8)) for r in df.orderBy("doc_id", "pos").collect()]
    assert rows(got) == rows(want)
    texts = repair.corrected_text(docs, *model, params)
    assert sorted(texts.collect()) == sorted(correct.corrected_text(want).collect())


@pytest.mark.parametrize("name", ["correct_tokens", "corrected_text"])
def test_no_context_is_shuffled(spark, tmp_path, name):
    spark.createDataFrame([(i, x, "en") for i, x in enumerate(SENTENCES * 4)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = QUERIES[name](spark, str(tmp_path))
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()


def test_gated_tokens_have_no_margin(spark, model):
    docs = spark.createDataFrame([(0, "the tretment today"), (1, "the TRETMENT today")], "doc_id long, text string")
    got = {r["tok"]: r["margin"] for r in repair.correct_tokens(docs, *model).where(F.lower("tok") == "tretment").collect()}
    assert got["tretment"] > 0 and got["TRETMENT"] is None
