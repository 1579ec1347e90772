"""Decontamination, quality rules, segmentation, secrets, personal data: against brute force on small tables."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from redpen.llm import decontaminate, personal, pieces, quality, secrets
from redpen.llm.queries import tokenizer

DOCS = "doc_id long, text string"
ODD = "doc_id long, text string, row string, out int, spans string, n_words string"


def clashing(spark, rows):
    """Documents with columns that are named as the operators' own."""
    return spark.createDataFrame([(*r, "x", 1, "y", "z") for r in rows], ODD)


# -- decontamination


def brute_hits(text, items, window=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    w, hit, found = words(text), set(), set()
    for item, t in items:
        p = words(t)
        m = min(window, len(p))
        wins = {tuple(p[i : i + m]) for i in range(len(p) - m + 1)} if m else set()
        for i in range(len(w) - m + 1 if m else 0):
            if tuple(w[i : i + m]) in wins:
                hit |= set(range(i, i + m))
                if item is not None:
                    found.add(str(item))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("sizes", [(2_000_000, 32_000_000), (40, 32_000_000), (40, 90)])
def test_decontaminate(spark, sizes):
    rng = random.Random(1)
    say = lambda n: " ".join(rng.choice(["a", "B", "c,", "É", "d"]) for _ in range(n))
    items = [(i, say(rng.choice([0, 1, 2, 5, 9, 10, 12, 15]))) for i in range(9)] + [(100, None), (3, say(11)), (None, "a a a")]
    docs = [(i, say(rng.choice([0, 1, 5, 30, 80]))) for i in range(30)] + [(50, None), (50, None), (51, items[4][1] * 3), (None, "x")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.find(clashing(spark, docs), bench, keep=["doc_id", "text"], block_bytes=sizes[0], broadcast_bytes=sizes[1])
    got = found.select("row.doc_id", "row.text", "out.n_words", decontaminate.n_hit().alias("hit"), "out.items").collect()
    assert len(got) == len(docs)
    for r in got:
        assert (r["n_words"], r["hit"], r["items"]) == brute_hits(r["text"], items), r
    kept = decontaminate.clean(clashing(spark, docs), bench)
    assert kept.columns == ["doc_id", "text", "row", "out", "spans", "n_words"]
    assert kept.count() == sum(not brute_hits(t, items)[1] for _, t in docs)
    assert decontaminate.report(spark.createDataFrame([], DOCS), bench).count() == 0
    assert not any(r["contaminated"] for r in decontaminate.report(spark.createDataFrame(docs, DOCS), bench.where("false")).collect())


def test_an_item_without_an_id_is_searched(spark):
    passage = " ".join(f"w{i}" for i in range(12))
    docs = [(1, "before " + passage + " after"), (2, "nothing of it"), (3, "w0 " * 300_000 + passage)]
    got = {r["doc_id"]: r for r in decontaminate.report(spark.createDataFrame(docs, DOCS), spark.createDataFrame([(None, passage)], "item_id long, text string")).collect()}
    assert [got[i]["n_hit"] for i in (1, 2, 3)] == [12, 0, 12] and got[1]["contaminated"] and got[1]["n_items"] == 0


# -- quality


def plain_em(rows, rules, rounds=400):
    """EM a document at a time; what the counted form has to agree with."""
    q, k = [0.9 * 0.5 ** r.count("0") for r in rows], quality.PSEUDO
    for _ in range(rounds):
        prior, table = (sum(q) + 0.9 * k) / (len(rows) + k), []
        for i in range(rules):
            right_good = sum(x for r, x in zip(rows, q, strict=True) if r[i] == "1")
            wrong_good = sum(x for r, x in zip(rows, q, strict=True) if r[i] == "0")
            right_bad = sum(1 - x for r, x in zip(rows, q, strict=True) if r[i] == "0")
            wrong_bad = sum(1 - x for r, x in zip(rows, q, strict=True) if r[i] == "1")
            table.append(((right_good + 0.9 * k) / (right_good + wrong_good + k), (right_bad + 0.3 * k) / (right_bad + wrong_bad + k)))
        for n, r in enumerate(rows):
            good, bad = prior, 1 - prior
            for v, (g, b) in zip(r, table, strict=True):
                good *= {"1": g, "0": 1 - g, "-": 1}[v]
                bad *= {"1": 1 - b, "0": b, "-": 1}[v]
            q[n] = good / (good + bad)
    return dict(zip(rows, q, strict=True)), table


def test_em_agrees_with_a_plain_one(spark):
    rng = random.Random(6)
    rates = [(0.99, 0.9), (0.9, 0.4), (0.6, 0.5), (0.97, 0.1)]
    rows = []
    for _ in range(400):
        good = rng.random() < 0.8
        rows.append("".join("-" if rng.random() < 0.1 else str(int((rng.random() < (g if good else b)) == good)) for g, b in rates))
    want, table = plain_em(rows, 4)
    model = quality.fit(sorted((p, rows.count(p)) for p in set(rows)), 4, rounds=400)
    for got, exact in zip(model.accuracies, table, strict=True):
        assert got == pytest.approx(exact, abs=1e-5)
    df = spark.createDataFrame([(p,) for p in want], "votes string")
    for r in df.select("votes", model.posterior(F.col("votes")).alias("p")).collect():
        assert r["p"] == pytest.approx(want[r["votes"]], abs=1e-5)
    assert quality.fit([], 3).accuracies == [(0.9, pytest.approx(0.3))] * 3


def test_one_bad_vote_is_no_veto(spark):
    got = quality.report(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("not base_failed")
    counts = {(r["kept"], r["bad"]): r["count"] for r in got.groupBy("kept", F.contains("votes", F.lit("0")).alias("bad")).count().collect()}
    assert counts[True, True] >= 10 and counts[False, True] >= 50 and (False, False) not in counts


def test_quality_measures_very_long_texts_whole(spark):
    rows = [(1, "good words are all of these\n" + "x" * 2_000_000), (2, "###  " * 300_000), (3, None)]
    got = {r["doc_id"]: r for r in quality.report(spark.createDataFrame(rows, DOCS)).collect()}
    assert got[1]["word_chars"] == 2_000_022 and got[2]["n_symbols"] == 900_000 and got[2]["base_failed"]


def test_quality_figures():
    text = "a b c d e\n\na b c d e\nx $1 é\n x "
    got = quality.features(text.encode())
    assert (got["n_words"], got["word_chars"], got["n_symbols"], got["n_dup_lines"], got["n_repeat_words"]) == (14, 15, 1, 1, 10)
    rng = random.Random(4)
    for _ in range(200):
        w = [rng.choice([b"a", b"b"]) for _ in range(rng.randint(0, 25))]
        wins = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        covered = {p for i, x in enumerate(wins) if wins.count(x) > 1 for p in range(i, i + 5)}
        assert quality.repeat_words(w) == len(covered)


def test_quality_verdicts(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(500)]
    good = [(i, " ".join(rng.sample(words, 60)) + ".") for i in range(150)]
    noisy = [(1000 + i, " ".join(x + "###" for x in rng.sample(words, 60))) for i in range(12)]
    loud = [(2000 + i, " ".join(x.upper() + "!!" for x in rng.sample(words, 60))) for i in range(12)]
    rows = [*good, *noisy, *loud, (3000, None), (3001, ""), (3002, "too short"), (3002, "too short")]
    got = {r["doc_id"]: r for r in quality.report(clashing(spark, rows)).collect()}
    assert {d for d, r in got.items() if r["kept"]} == {d for d, _ in good}
    assert got[3000]["base_failed"] and got[3000]["n_words"] == 0
    kept = quality.clean(clashing(spark, rows))
    assert kept.count() == len(good) and kept.columns == ["doc_id", "text", "row", "out", "spans", "n_words"]
    assert quality.report(spark.createDataFrame([], DOCS)).count() == 0


def test_quality_agrees_with_labels(spark):
    d = "/root/testdata/sf0.01"
    got = quality.report(spark.read.parquet(f"{d}/documents.parquet")).where("not base_failed").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id")
    right = got.select(F.avg((F.col("kept") == (F.col("quality") == 1)).cast("double"))).first()[0]
    assert right > 0.97


# -- SentencePiece


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary(tokenizer("piece_bpe_32k.model"))


def all_paths(v, chunk):
    out = []

    def rec(at, got, ids):
        if not at:
            out.append((got, ids))
        else:
            for start, s, p in v.arcs(chunk, at):
                rec(start, got + s, p + ids)

    rec(len(chunk), 0, ())
    return sorted(out, key=lambda x: (-x[0], x[1]))


def test_n_best_is_exact(vocabulary):
    seg, rng = pieces.Segmenter(vocabulary, 4), random.Random(1)
    for _ in range(150):
        t = "".join(rng.choice("theandingo  é\n▁x日1") for _ in range(rng.randint(1, 10)))
        got = seg.texts([t])[0].as_py()
        assert [b["score"] for b in got["n_best"]] == [x[0] / pieces.UNIT for x in all_paths(vocabulary, " " + t)[:4]]
        for b in got["n_best"]:
            ids = list(got["ids"])
            for c in reversed(b["changes"]):
                ids[c["start"] : c["end"]] = c["ids"]
            assert b"".join(vocabulary.text[i] for i in ids).decode() == " " + t
        for c in set(pieces._CHUNK.findall(" " + t)):
            assert vocabulary.one(c)[1:] == vocabulary.together([c])[0][1:]


def test_n_best_keeps_the_order_of_ties(vocabulary):
    for chunk in (" " + "a" * 9, " " + "é日" * 3, "  aaaa\n\n"):
        assert vocabulary.n_best(chunk, 6) == all_paths(vocabulary, chunk)[:6]
    # 4 million characters' worth of ties would have no end without a rank for each rest
    many = vocabulary.n_best(" " + "x" * 20_000, 4)
    assert [len(x) for x in many] and [s for s, _ in many] == sorted((s for s, _ in many), reverse=True) and many == sorted(many, key=lambda x: (-x[0], x[1]))


def test_pieces_of_long_chunks_and_empty_tables(spark):
    rows = [(1, "ab" * 500_000), (2, "日" * 50_000 + " \uffff"), (3, "")]
    got = {r["doc_id"]: r for r in pieces.report(spark.createDataFrame(rows, DOCS), tokenizer("piece_bpe_32k.model")).collect()}
    assert all(r["restored"] for r in got.values())
    assert pieces.report(spark.createDataFrame([], DOCS), tokenizer("piece_bpe_32k.model")).count() == 0


def test_pieces_round_trip(spark):
    texts = ["", None, " ", "  two  spaces ", "▁▁ mark", "日本語 🎉\n\ttab", "é" * 300, "x" * 3000, "a b " * 2000, "<s> </s> [INST]", "same", "same"]
    rows = pieces.report(clashing(spark, list(enumerate(texts))), tokenizer("piece_bpe_32k.model")).orderBy("doc_id").collect()
    assert [r["restored"] for r in rows] == [t is not None or None for t in texts]
    assert rows[0]["n_pieces"] == 0 and rows[1]["ids"] is None and rows[10]["ids"] == rows[11]["ids"]
    for r in rows:
        if r["ids"] is not None:
            assert r["n_best_scores"] == sorted(r["n_best_scores"], reverse=True) and r["n_best_scores"][0] == r["score"]


# -- secrets


def brute_secrets(text):
    rx = {"assign": r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]+"}
    ok = {"assign": lambda m: len(m[2]) >= 12, "access": lambda m: len(m[0]) >= 18, "hex": lambda m: len(m[0]) >= 16}
    flags = re.ASCII
    return sorted((m.start(), i, k, m.end()) for i, k in enumerate(rx) for m in re.finditer(rx[k], text or "", flags) if ok[k](m))


def github(body):
    import binascii

    n, out = binascii.crc32(body.encode()), ""
    for _ in range(6):
        n, d = divmod(n, 62)
        out = secrets._BASE62[d] + out
    return f"ghp_{body}{out}"


def test_secrets(spark):
    rng = random.Random(6)
    bits = ["password", "Token", "API_KEY", "apikey", "secret", "paſſword", " = ", ":", "'", '"', "0123456789abcdef", "dead", "beef" * 5, "AKIA", "ABCDEFGHIJKLMNOP1", "x", "é", "\n", "abcDEF123+/=_.-", "g", "日"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(600)] + [None, "", "a" * 50_000, "f" * 50_000, "token=" * 9000, github("a1B2" * 7 + "xy"), github("a1B2" * 7 + "xy")[:-1] + "!"]
    got = {r["doc_id"]: r for r in secrets.report(clashing(spark, list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        want = brute_secrets(t)
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, k, b in want).encode()).hexdigest(), t
        assert (got[i]["n_assign"], got[i]["n_access"], got[i]["n_hex"]) == tuple(sum(x[2] == k for x in want) for k in ("assign", "access", "hex"))
    n = len(texts)
    assert got[n - 2]["spans"] == "github:0:40" and "github" not in got[n - 1]["spans"]
    assert secrets.report(spark.createDataFrame([], DOCS)).count() == 0


# -- personal data


def brute_personal(text):
    rx = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def ok(k, v):
        d = [int(x) for x in re.sub("[^0-9]", "", v)]
        luhn = sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d))) % 10 == 0
        return {"email": True, "ip": k != "ip" or all(int(x) <= 255 for x in v.split(".")), "card": 12 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[k]

    return sorted((m.start(), i, k, m.end()) for i, k in enumerate(rx) for m in re.finditer(rx[k], text or "") if ok(k, m[0]))


def test_personal(spark):
    rng = random.Random(5)
    bits = ["a", "b@", "@", ".", "c.d", "1", "23", "255", "256", ".7", " ", "-", "+", "(", ")", "4111111111111111", "4111 1111 1111 1111", "+1 202 555 0123", "a@b.co", "é", "日", "\x01", "\x02", "_x@d.com", "10.0.0.1", ".5", "%", "\n", "call 202-555-0188", "Mr. John Smith"]
    texts = [None, "", *("".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(500)), "a@b.co " * 800, "1." * 2000, "+" + "1" * 2000]
    got = {r["doc_id"]: r for r in personal.report(clashing(spark, list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        want = brute_personal(t)
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, k, b in want).encode()).hexdigest(), t
        assert [got[i][f"n_{k}"] for k in personal.BASE] == [sum(x[2] == k for x in want) for k in personal.BASE]
    assert personal.report(spark.createDataFrame([], DOCS)).count() == 0


def test_personal_long_runs_take_linear_time(spark):
    texts = ["a" * 300_000, "1." * 150_000, "1 " * 150_000, "@" * 100_000]
    assert personal.report(spark.createDataFrame(list(enumerate(texts)), DOCS)).count() == 4


def test_personal_reliabilities():
    rows = [("email", "111", 80), ("email", "000", 10), ("email", "1-1", 10), ("email", "010", 5)]
    q, rates = personal.reliabilities(rows)
    assert q["email", "111"] > 0.95 > 0.2 > q["email", "000"] and all(a > 0.6 for a, _ in rates)
