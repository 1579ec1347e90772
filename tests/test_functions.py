import random

from pyspark.sql import functions as F

from redpen.functions import text as tf
from redpen.functions.distance import deletion_keys, distance_upto_2
from redpen.functions.gates import domain_rule, gate


def values(spark, rows, column):
    return [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x string").orderBy("i").select(column(F.col("x"))).collect()]


def test_gates(spark):
    want = {
        "": None, "123": "non_alpha", "--": "non_alpha", "PCR": "short_token", "abc": "short_token", "IL-6": "pattern_allcaps", "COVID-19": "pattern_allcaps", "COVID19": "pattern_biomed_id", "rs12345": "pattern_biomed_id", "BRCA1": "pattern_biomed_id",
        "3CLpro": "pattern_biomed_id", "H1N1": "pattern_biomed_id", "covid-00018": "pattern_numeric_heavy", "treatment": None, "Treatment": None, "viral,": None,
    }
    assert values(spark, list(want), gate) == list(want.values())


def test_rules(spark):
    rows = [("covid18", None, None, "covid-19"), ("covid-19", None, None, None), ("Covid-19", None, None, "covid-19"), ("(covid_19),", None, None, "covid-19"), ("verses", "corona", None, "virus"), ("verses", "a", "b", None), ("significance", "highly", None, "significant"), ("road", "viral", None, "load"), ("lose", None, "of", "loss")]
    got = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, p string, n string, want string").orderBy("i").select("want", domain_rule(F.col("t"), F.col("p"), F.col("n")).alias("got")).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]


def damerau(a, b):
    """Unrestricted, by breadth-first search over edits, up to 2."""
    letters = sorted(set(a + b))

    def edits(w):
        out = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + w[i + 1] + w[i] + w[i + 2 :] for i in range(len(w) - 1)}
        return out | {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters} | {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in letters}

    if a == b:
        return 0
    one = edits(a)
    return 1 if b in one else 2 if any(b in edits(x) for x in one) else None


def test_distance_and_keys(spark):
    rng = random.Random(3)
    pairs = [("ca", "abc"), ("abcd", "badc"), ("a", "b"), ("ab", "ba"), ("abcdef", "abdcfe")]
    for _ in range(300):
        a = "".join(rng.choice("abcd") for _ in range(rng.randint(1, 6)))
        pairs.append((a, "".join(rng.choice("abcd") for _ in range(rng.randint(max(1, len(a) - 2), len(a) + 2)))))
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", distance_upto_2(F.col("a"), F.col("b")).alias("d"), F.arrays_overlap(deletion_keys(F.col("a")), deletion_keys(F.col("b"))).alias("k"))
    for r in df.collect():
        want = damerau(r["a"], r["b"])
        assert r["d"] == want, r
        assert want is None or r["k"], r


def test_text(spark):
    assert values(spark, ["See [1, 2] <b>X</b> http://a.b  end", None], tf.clean_academic) == ["see x end", ""]
    assert values(spark, ["α–β’s"], tf.normalize) == ["alpha-beta's"]
    assert values(spark, ["Covid 19 and SARS-CoV 2"], tf.canonical_virus_names) == ["Covid-19 and SARS-CoV-2"]
    assert values(spark, ["CD4+ don't 12 x-ray"], tf.tokens_spelling) == [["cd4+", "do", "not", "x-ray"]]
    text = "Well, it's  a\ttest (really)!\n"
    got = values(spark, [text], tf.pieces)[0]
    assert "".join(p["text"] + p["ws"] for p in got) == text
    cases = spark.createDataFrame([("ABC", "xy"), ("Abc", "xy"), ("abc", "xy")], "a string, b string").select(tf.match_case(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in cases] == ["XY", "Xy", "xy"]
    assert values(spark, ["One two three four five. Six!", ""], tf.sentences) == [["One two three four five."], []]


def test_hash_is_stable(spark):
    import hashlib

    got = spark.range(1).select(tf.hash_int(F.lit(7), F.lit("x"))).first()[0]
    assert got == int(hashlib.md5(b"7|x").hexdigest()[:8], 16)
