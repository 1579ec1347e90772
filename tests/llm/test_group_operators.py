"""Line dedup, near copies, chat formatting, WARC, token ids and the pipeline: against brute force on small tables."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from redpen.llm import chat, components, line_runs, near_copies, token_ids, warc
from redpen.llm.queries import tokenizer

DOCS = "doc_id long, text string"


def clashing(spark, rows):
    return spark.createDataFrame([(*r, 1, "h", "r") for r in rows], "doc_id long, text string, id int, hash string, row string")


# -- line dedup


def brute_lines(docs, least):
    seqs = [[(k, x.strip(line_runs.BLANK)) for k, x in enumerate((t or "").split("\n")) if x.strip(line_runs.BLANK)] for _, t in docs]
    seen, out = {}, {}
    for a, s in enumerate(seqs):
        gone = set()
        for i in range(len(s)):
            best = 0
            for c, j in seen.get(s[i][1], []):
                n = 0
                while i + n < len(s) and j + n < len(seqs[c]) and s[i + n][1] == seqs[c][j + n][1]:
                    n += 1
                best = max(best, n)
            if best and sum(len(x.split()) for _, x in s[i : i + best]) >= least:
                gone |= set(range(s[i][0], s[i + best - 1][0] + 1))
            seen.setdefault(s[i][1], []).append((a, i))
        d, t = docs[a]
        out[d] = None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_line_runs(spark, seed):
    rng = random.Random(seed)
    lines = [" ".join(rng.choice("abcdef") for _ in range(rng.randint(1, 4))) for _ in range(6)] + ["", " "]
    docs = [(i, None if rng.random() < 0.05 else "\n".join(rng.choice(lines) + (" " if rng.random() < 0.1 else "") for _ in range(rng.choice([0, 1, 3, 8, 20, 40])))) for i in range(20)]
    docs += [(100 + k, docs[rng.randrange(20)][1]) for k in range(5)]
    got = {r["doc_id"]: r["text"] for r in line_runs.report(clashing(spark, docs), min_words=7).collect()}
    assert got == brute_lines(docs, 7)


def test_line_runs_edges(spark):
    long = "one two three four five six seven eight nine ten\n" * 30
    docs = [(1, "x\n" + long), (2, "y\n" + long), (2, "y\n" + long), (3, None), (4, ""), (5, long)]
    got = line_runs.report(clashing(spark, docs)).collect()
    assert len(got) == 6
    first = "one two three four five six seven eight nine ten\n"
    assert {r["doc_id"]: r["text"] for r in got} == {1: "x\n" + first, 2: "y\n", 3: None, 4: "", 5: ""}
    kept = line_runs.clean(clashing(spark, docs))
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 2, 3, 4] and kept.columns == ["doc_id", "text", "id", "hash", "row"]
    assert line_runs.report(spark.createDataFrame([], DOCS)).count() == 0


def test_line_runs_of_long_documents(spark):
    rng = random.Random(5)
    many = [f"line {rng.randrange(10**9)}" for _ in range(3000)]
    docs = [(1, "\n".join(many)), (2, "\n".join(many[500:2900])), (3, "\n".join(["own", *many[100:101], "own too", "z" * 1_000_000])), (4, "same\n" * 1500)]
    got = {r["doc_id"]: r for r in line_runs.report(spark.createDataFrame(docs, DOCS)).collect()}
    assert [got[i]["n_deleted"] for i in (1, 2, 3, 4)] == [0, 2400, 1, 1499]
    assert got[3]["text"] == "own\nown too\n" + "z" * 1_000_000 and got[2]["text"] == "" and got[4]["text"] == "same\n"


def test_ranks_are_in_the_order_of_the_suffixes(spark):
    rng = random.Random(7)
    text = ["".join(rng.choice("ab") for _ in range(40)) for _ in range(4)]
    scratch = line_runs.Scratch(spark, "test")
    rows = [(100 * d + p, ord(c)) for d, t in enumerate(text) for p, c in enumerate(t)]
    ranks = line_runs.doubled(spark.createDataFrame(rows, "g long, r long"), scratch)
    for k, table in enumerate(ranks):
        of = {r["g"]: r["r"] for r in table.collect()}
        run = lambda g: text[g // 100][g % 100 : g % 100 + 2**k]  # noqa: B023, E731
        runs = [run(g) for g, _ in rows]
        assert set(of) == {g for g, _ in rows if len(run(g)) == 2**k and runs.count(run(g)) > 1}
        assert [run(g) for g in sorted(of, key=of.get)] == sorted(run(g) for g in of)
    assert len(ranks) > 2


def test_line_runs_deletes_short_runs_by_default(spark):
    licence = "Licensed under the terms of the file"
    docs = [(i, f"own line {i}\n{licence}\nmore of {i}\n\nEnd") for i in range(4)]
    got = {r["doc_id"]: r["text"] for r in line_runs.report(clashing(spark, docs)).collect()}
    assert got == {0: docs[0][1]} | {i: f"own line {i}\nmore of {i}\n" for i in range(1, 4)} == brute_lines(docs, 1)
    assert {r["doc_id"]: r["text"] for r in line_runs.clean(clashing(spark, docs)).collect()} == got


# -- near copies


def brute_classes(docs):
    bags = [near_copies.bag(None if t is None else t.encode()) for _, t in docs]
    of = list(range(len(docs)))

    def root(i):
        while of[i] != i:
            i = of[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if docs[i] == docs[j] or (bags[i] and bags[j] and near_copies.near(bags[i], bags[j])):
                a, b = sorted((root(i), root(j)))
                of[b] = a
    ids = {}
    for i, (d, _) in enumerate(docs):
        ids.setdefault(root(i), []).append(d)
    return [(d, min(ids[root(i)])) for i, (d, _) in enumerate(docs)]


def test_near_copies(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    docs = []
    for g in range(6):
        base = [word() for _ in range(rng.choice([3, 40, 120]))]
        for k in range(12):
            w = list(base)
            for _ in range(rng.choice([0, 1, 2, 4, 6])):
                w[rng.randrange(len(w))] = word()
            docs.append((100 * g + k, " ".join(w)))
    docs += [(900, None), (901, ""), (902, " .,"), (903, "x"), (904, "X."), (905, "a b " * 500)]
    got = near_copies.report(clashing(spark, docs)).collect()
    want = brute_classes(docs)
    assert sorted((r["doc_id"], r["class_id"]) for r in got) == sorted(want)
    sizes = Counter(c for _, c in want)
    assert all(r["class_size"] == sizes[r["class_id"]] for r in got)
    kept = near_copies.clean(clashing(spark, docs))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(sizes)) and kept.columns == ["doc_id", "text", "id", "hash", "row"]


def test_near_copies_edges(spark):
    rows = [(1, "same words here"), (1, "same words here"), (2, "Same words, here"), (None, "other words there"), (3, None), (3, None)]
    assert sorted((r["doc_id"] or 0, r["class_id"] or 0, r["class_size"]) for r in near_copies.report(spark.createDataFrame(rows, DOCS)).collect()) == [(0, 0, 1), (1, 1, 3), (1, 1, 3), (2, 1, 3), (3, 3, 1), (3, 3, 1)]
    assert near_copies.clean(spark.createDataFrame(rows, DOCS)).count() == 3
    assert near_copies.report(spark.createDataFrame([], DOCS)).count() == 0


def test_near_copies_hand_workers_small_batches(spark, monkeypatch):
    name, seen, sign = "spark.sql.execution.arrow.maxBytesPerBatch", [], near_copies.sign

    def measured(rows, *args):
        sizes = rows.select("text").mapInArrow(lambda batches: (b.from_arrays([pa.array([b.nbytes])], names=["n"]) for b in batches), "n long")
        seen.append(max(r["n"] for r in sizes.collect()))
        return sign(rows, *args)

    monkeypatch.setattr(near_copies, "sign", measured)
    text = " ".join(f"w{i}" for i in range(5000))
    rows = spark.range(1000, numPartitions=1).select(F.col("id").alias("doc_id"), F.lit(text).alias("text"), F.lit("en").alias("lang"))
    before = spark.conf.get(name)
    assert near_copies.report(rows).where("class_id = 0 AND class_size = 1000").count() == 1000
    assert max(seen) < 2 * near_copies.BATCH_BYTES and spark.conf.get(name) == before


def test_near_copies_recall_on_a_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    got = {r["doc_id"]: r["class_id"] for r in near_copies.report(spark.createDataFrame(rows, DOCS)).collect()}
    assert sorted(got.items()) == sorted(brute_classes(rows))


def test_near_copies_of_long_texts_and_rows_that_differ_elsewhere(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, long, "a"), (2, long + " more", "b"), (3, "some short text", "c"), (3, "some short text", "d"), (None, None, "e"), (None, None, "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, node string")
    assert {r["doc_id"]: r["class_id"] for r in near_copies.report(df).collect()} == {1: 1, 2: 1, 3: 3, None: None}
    one, two = ([sorted(map(str, near_copies.clean(d).collect())) for d in (df, df.repartition(5))])
    assert one == two and len(one) == 3
    assert near_copies.clean(df.where("false")).count() == 0


def test_rare_shingles_find_every_pair(spark):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for i in range(25):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(60)] = f"x{rng.randrange(9)}"
        texts.append((i, max(1, len(w) - 4), " ".join(w).encode()))
    nodes = spark.createDataFrame([(i, i) for i, _, _ in texts], "id long, comp long")
    table = spark.createDataFrame(texts, "id long, n long, text binary")
    got = {(r["u"], r["v"]) for r in near_copies.sharing_rare(nodes, table).collect()}
    near = {(i, j) for i, _, a in texts for j, _, b in texts if i < j and near_copies.near(near_copies.bag(a), near_copies.bag(b))}
    assert near and near <= got


def test_signature_is_unbiased():
    r = np.random.default_rng(0)
    a = r.integers(0, 9, 300)
    b = np.where(r.random(300) < 0.3, r.integers(0, 9, 300), a)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    got = []
    for k in range(40):
        e = near_copies.mix(np.arange(300, dtype=np.uint64) + np.uint64(1000 * k))
        of, el, w = np.repeat([0, 1], 300), np.concatenate([e, e]), np.concatenate([a, b])
        x = near_copies.bag_min_hash(of[w > 0], el[w > 0], w[w > 0], 2, 128)
        got.append((x[0] == x[1]).mean())
    assert abs(np.mean(got) - want) < 0.02


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + k) for k in range(1, 30)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    got = {r["node"]: r["comp"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    of = {x: x for e in edges for x in e}
    for _ in range(100):
        for u, v in edges:
            of[u] = of[v] = min(of[u], of[v])
    assert got == {x: c for x, c in of.items() if any(x in e and e[0] != e[1] for e in edges)}


# -- chat


def test_chat(spark):
    rng = random.Random(2)
    bits = [*chat.CONTROL, "\\", "\\\\", "n", "\n", "<", "|", "im_start", "|>", "[", "INST]", "/", "é", "日", "", "s>", "\\n", "<\\", "\r"]
    say = lambda: None if rng.random() < 0.05 else "".join(rng.choice(bits) for _ in range(rng.randint(0, 9)))
    rows = [(rng.randint(0, 50), rng.randint(0, 6), rng.choice(["user", "assistant", "assistant", say()]), say(), 1) for _ in range(300)] + [(None, 1, "user", "x", 1), (99, None, "assistant", "q", 1), (99, 0, "assistant", "r", 1), (99, 0, "assistant", "r", 1), (98, 0, "user", "only", 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns int")
    got = {r["conv_id"]: r for r in chat.report(df).collect()}
    by = {}
    for c, t, r, x, _ in rows:
        by.setdefault(c, []).append((-1 if t is None else t, (r or "").encode(), (x or "").encode()))
    assert None in got and set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        loss = b"".join(x for _, r, x in turns if r == b"assistant")
        assert got[c]["n_turns"] == len(turns) and got[c]["loss_sha256"] == hashlib.sha256(loss).hexdigest() and got[c]["loss_chars"] == len(loss.decode())
        assert got[c]["turns_sha256"] == hashlib.sha256(b"".join(r + b"\n" + x + b"\n" for _, r, x in turns)).hexdigest()
    made = chat.examples(df).where("conv_id = 99").orderBy("example").collect()
    assert [r["n_turns"] for r in made] == [1, 2, 3] and all(r["formatted"][r["loss_start"] : r["loss_end"]] in "qr" for r in made)
    assert not chat.examples(df).where("conv_id = 98").first()["trainable"]
    for c in chat.CONTROL[2:]:
        assert chat.examples(df).where(F.contains("formatted", F.lit(c))).count() == 0
    assert chat.report(df.where("false")).count() == 0


# -- WARC


def test_warc(spark, tmp_path):
    big, tricky = "é" * 600, "WARC/1.0\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\n" * 30
    pages = [(1, "http://a.b/c?d#e", big), (2, "http://a.b/c", big), (3, None, big), (4, "x", "small"), (5, "x", "small"), (6, "http://x", tricky), (7, "http://x", tricky), (8, "bad\r\nurl", None), (8, "bad\r\nurl", None), (None, "u", "x" * 2000), (None, "u2", "x" * 2000)]
    df = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, n int").repartition(3)
    got = [tuple(r) for r in warc.report(df).collect()]
    want = []
    for i, _, h in pages:
        data = (h or "").encode()
        same = max((p[0] for p in pages if p[2] == h and p[0] is not None), default=None)
        again = len(data) >= 1000 and same is not None and same != i
        want.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", same if again else None))
    assert sorted(got, key=str) == sorted(want, key=str)
    warc.write(df, str(tmp_path / "w"))
    captures = warc.assemble(warc.read(spark, str(tmp_path / "w"))).collect()
    assert len(captures) == len(pages) and all(c["request"] and c["metadata"] and c["response"] for c in captures)
    assert sum(bytes(c["response"]["payload"]) == tricky.encode() for c in captures if c["response"]["payload"] is not None) == 1
    assert warc.report(df.where("false")).count() == 0


# -- token ids


def test_elias_fano():
    r = np.random.default_rng(1)
    for n, u in ((1, 0), (1, 10**18), (5, 3), (2000, 10), (3000, 10**9), (1500, 2**62)):
        x = np.sort(r.integers(0, u + 1, n).astype(np.uint64))
        e, _ = token_ids.EliasFano.read(memoryview(token_ids.EliasFano.of(x).to_bytes()), 0)
        assert (e.all() == x).all() and [e.select(i) for i in range(n)] == x.tolist()


def test_encoder_is_the_library():
    from tokenizers import Tokenizer

    path = tokenizer("word_bpe_49k.json")
    own, library, rng = token_ids.Encoder(path, 2), Tokenizer.from_file(path), random.Random(3)
    assert own.by_word
    letters = "abcXYZ 's're't 0123.,!?\"'()<>|éÉßÑñ÷×ªµΣσςİ́  日\n\t\r\x0b"
    texts = ["", "<|endoftext|> a", "\x00\x01 a\x0bb\x85c", "ΑΣ Σ", *("".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(1500))]
    for t in texts:
        assert np.frombuffer(own.ids(t), "<u2").tolist() == [*library.encode(t, add_special_tokens=False).ids, 2], t


def test_token_files(spark, tmp_path):
    from tokenizers import Tokenizer

    path = tokenizer("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rows = [(5, "five words are in here"), (-3, None), (7, ""), (7, "again"), (7, "again"), (10**15, "far " * 3000), (None, "no id")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, start string")
    want, at = [], 0
    key = {r: spark.createDataFrame([(r[1] or "",)], "t string").select(F.xxhash64("t")).first()[0] for r in rows}
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, key[r])):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = [tuple(r) for r in token_ids.report(df, path).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    token_ids.write(df, path, 2, str(tmp_path / "f"), block_ids=8)
    assert token_ids.starts(token_ids.read(spark, str(tmp_path / "f"))).agg(F.max(F.col("start") + F.col("n_tokens"))).first()[0] == at
    assert token_ids.report(df.where("false"), path).count() == 0


# -- pipeline


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(9)
    say = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n))
    item, passage = say(30), say(60)
    clean = [(i, say(80)) for i in range(20)]
    docs = [*clean, (100, clean[0][1]), (101, clean[1][1].replace(clean[1][1][:5], "zzzzz", 1)), (102, say(20) + "\n" + passage), (103, say(40) + "\n" + passage), (104, say(30) + " " + item), (105, " ".join(w + "###" for w in say(60).split())), (106, "short"), (107, None)]
    spark.createDataFrame([(d, t, "en", "s", 1) for d, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(out) == {d for d, _ in clean} | {102, 103}
    assert all(r["restored"] for r in out.values()) and out[103]["n_pieces"] < out[102]["n_pieces"]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_copies", "decontaminate", "pieces"]


def test_token_ids_bounds_come_from_select(monkeypatch):
    ids = [bytes(2 * (k % 7)) for k in range(1500)]
    b = token_ids.Block(memoryview(token_ids.Block.pack(0, 0, list(range(1500)), ids, 2)))
    monkeypatch.setattr(token_ids.EliasFano, "all", None)
    starts, ends = b.bounds()
    assert (ends - starts).tolist() == [len(x) // 2 for x in ids] and starts[0] == 0 and (starts[1:] == ends[:-1]).all()
    assert all(len(b.document(i)) == ends[i] - starts[i] for i in (0, 511, 512, 1499))
