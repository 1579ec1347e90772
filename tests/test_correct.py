import math

import pytest
from pyspark.sql import functions as F

from redpen.operators import correct, evaluate, lexicon, noise, prepare
from redpen.params import Params
from redpen.sources import io

CORPUS = ["the patient received treatment for infection"] * 8 + ["the patient received the treatment today"] * 6 + ["severe infection needs treatment"] * 5


@pytest.fixture(scope="module")
def model(spark):
    words = correct.lm_words(spark.createDataFrame([(x,) for x in CORPUS], "text string"))
    return lexicon.unigrams(words).cache(), lexicon.bigrams(words).cache()


def run(spark, model, text, params=Params()):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    return {r["tok"]: r for r in correct.correct_tokens(docs, *model, params, trace=True).collect()}


def test_counts(spark, model):
    counts = {r["word"]: r["cnt"] for r in model[0].collect()}
    assert counts["treatment"] == 19 and counts["the"] == 20
    pairs = {(r["prev"], r["word"]): r["cnt"] for r in model[1].collect()}
    assert pairs["the", "patient"] == 14 and ("infection", "the") not in pairs


def test_decisions(spark, model):
    got = run(spark, model, "the patient received treatmnet for COVID-19 zzzzzzz 12 verses infection")
    assert got["treatmnet"]["corrected"] == "treatment" and got["treatmnet"]["error_type"] == "Non-word error" and got["treatmnet"]["edit_distance"] == 1
    assert got["COVID-19"]["gate"] == "pattern_allcaps" and got["12"]["gate"] == "non_alpha"
    assert got["zzzzzzz"]["error_type"] == "Unknown (OOV)" and got["zzzzzzz"]["decision"] == "abstain" and not got["zzzzzzz"]["protected"]
    assert got["verses"]["corrected"] == "virus" and got["patient"]["corrected"] == "patient"
    for r in got.values():
        assert not r["protected"] or r["corrected"] == r["tok"]
        if r["decision"] == "apply" and r["margin"] is not None:
            assert r["margin"] >= r["threshold_used"] - 1e-9


def test_infinite_margins_change_nothing_but_rules(spark, model):
    got = run(spark, model, "treatmnet of verses infection", Params(delta=math.inf, delta_rw=math.inf))
    assert {t for t, r in got.items() if r["decision"] == "apply"} == {"verses"}


def test_rules_before_gates(spark, model):
    assert run(spark, model, "COVID-19", Params(rules_before_gates=True))["COVID-19"]["corrected"] == "covid-19"


def test_text_and_summary(spark, model):
    docs = spark.createDataFrame([(1, "the treatmnet,  today "), (2, ""), (3, None)], "doc_id long, text string")
    rows = correct.correct_tokens(docs, *model)
    assert [r["corrected_text"] for r in correct.corrected_text(rows).collect()] == ["the treatment,  today"]
    s = correct.doc_summary(rows).first()
    assert (s["total_tokens"], s["tokens_changed"], s["edit_rate"]) == (4, 1, 0.25)
    override = spark.createDataFrame([(1, 0, "a")], "doc_id long, pos int, word string")
    assert correct.corrected_text(rows, override).first()["corrected_text"].startswith("a treatment")


def test_partitions_do_not_matter(spark, model):
    docs = spark.createDataFrame([(i, "the patinet received treatmnet") for i in range(6)], "doc_id long, text string")
    a = correct.correct_tokens(docs.repartition(1), *model).orderBy("doc_id", "pos").collect()
    assert a == correct.correct_tokens(docs.repartition(5), *model).orderBy("doc_id", "pos").collect()


def test_weak_label(spark):
    rows = [("vaccine trial", "x"), ("a", "vaccine"), ("drug vaccine", ""), ("drug", "drug therapy"), (None, None)]
    got = spark.createDataFrame(rows, "t string, a string").select(prepare.weak_label(F.col("t"), F.col("a")).alias("l")).collect()
    assert [r["l"] for r in got] == ["Prevention", None, None, "Treatment", None]


def test_metrics(spark):
    rows = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "b")], "t string, p string")
    s = evaluate.scores(rows, "t", "p").first()
    assert s["accuracy"] == 0.5 and abs(s["f1_macro"] - (2 / 3 + 1 / 2 + 0) / 3) < 1e-12
    d = evaluate.deltas(*[F.lit(x) for x in (0.7, 0.7, 0.7, 0.7)])
    assert spark.range(1).select(d["err_recovery"]).first()[0] is None
    same = rows.withColumn("q", F.col("p"))
    b = evaluate.bootstrap(same, "t", "p", "q", 20).first()
    assert b["f1_mean"] == b["acc_high"] == 0


def test_noise_is_seeded_and_counted(spark):
    rows = noise.variant_seeds(spark.createDataFrame([(1, "something remarkable happens everywhere, 12 times")], "id long, text string"), "id", 5)
    heavy = rows.withColumn("p", F.lit(1.0))
    a = noise.corrupted(heavy, "id", keys=("corruption_level",)).orderBy("corruption_level").collect()
    assert a == noise.corrupted(heavy.repartition(3), "id", keys=("corruption_level",)).orderBy("corruption_level").collect()
    assert all(r["edited_tokens"] == 5 and r["total_word_tokens"] == 5 for r in a)
    none = noise.corrupted(rows.withColumn("p", F.lit(0.0)), "id", keys=("corruption_level",)).collect()
    assert all(r["noisy_text"] == "something remarkable happens everywhere, 12 times" for r in none)


def test_io(spark, model, tmp_path):
    m = io.save_model(str(tmp_path / "m"), *model)
    u, _, version = io.load_model(spark, str(tmp_path / "m"))
    assert version == m["version"] and u.count() == model[0].count()
    (tmp_path / "x.csv").write_text('id,Title,abstract\n1,"a ""b""","two\nlines"\n')
    assert [tuple(r) for r in io.read_csv(spark, str(tmp_path / "x.csv")).collect()] == [('a "b"', "two\nlines")]
    assert io.read_csv(spark, str(tmp_path / "none.csv"), missing_ok=True).count() == 0
    with pytest.raises(ValueError):
        io.read_csv(spark, str(tmp_path / "x.csv"), io.CASES)
    (tmp_path / "typo_map.json").write_text('{"Teh": "the"}')
    assert [tuple(r) for r in io.typo_map(spark, str(tmp_path)).collect()] == [("teh", "the")]
    with pytest.raises(ValueError):
        prepare.resolve_column(u, ["nothing"])


def test_stream(spark, model, tmp_path):
    from redpen.streaming.correct import correct_stream, documents

    spark.createDataFrame([(1, "the treatmnet today")], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    correct_stream(documents(spark, str(tmp_path / "in")), *model, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out/summaries")).first()["tokens_changed"] == 1


def test_tuned_takes_options_as_arrays(spark):
    docs = spark.createDataFrame([(1, "the cell count rose and the cell wall held " * 8 + "a cull wall and the cel count")], "doc_id long, text string")
    words = correct.lm_words(docs)
    counts, pairs = lexicon.unigrams(words), lexicon.bigrams(words)
    work = spark.createDataFrame([("cull", "a", "wall", False), ("cel", "the", "count", False), ("wall", "cell", "held", True)], "tok_l string, prev_l string, next_l string, known boolean")
    p = Params()
    out = correct.tuned(work, counts, pairs, evaluate.grid(spark, delta=[p.delta, -1000.0], delta_rw=[p.delta_rw], w_dist=[p.w_distance], w_left=[p.w_left]))
    assert "Aggregate [ordinal" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {(r["ordinal"], r["tok_l"]): r["best_word"] for r in out.collect()}
    want = {r["tok_l"]: r["best_word"] for r in correct.decided(correct.scored(work, counts, pairs)).collect()}
    assert len(got) == 6 and {t: w for (o, t), w in got.items() if o == 0} == want and got[1, "cel"] == "cell"
