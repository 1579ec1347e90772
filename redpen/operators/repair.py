"""Correction of whole documents without a shuffle of their contexts.

What the corrector looks up (words, candidates, counts of pairs) is written into flat files in the folder that driver and executors share. Each task maps
them into memory and decides the contexts of its own documents, so contexts and their candidates are never rows of a table. Decisions are those of
``correct.decide``, which stays for rows of other kinds, traces, and shared folders that are no file system.
"""

from __future__ import annotations

import ctypes
import functools
import math
import os
import shutil
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from redpen.functions import text as tf
from redpen.functions.gates import domain_rule, gate, protected_word
from redpen.lexicons import COVID_18, VIRUS_CONFUSIONS
from redpen.operators import correct, tables
from redpen.operators import neighbourhoods as near
from redpen.operators.candidates import neighbours
from redpen.operators.lexicon import row_totals
from redpen.operators.tables import shared_folder
from redpen.params import Params

GATES = ("non_alpha", "short_token", "pattern_allcaps", "pattern_biomed_id", "pattern_numeric_heavy")
#: Bits of a token's state above the number of its gate.
KNOWN, COMMON, RULED, MOVED, ENOUGH = 8, 16, 32, 64, 128
#: Words whose candidates one task looks for; known words of the first block of the index; tokens, options and pairs that are worked on at once.
ASKED, FIRST_BLOCK, TOKENS, OPTIONS, ROWS = 8192, 1 << 14, 1 << 19, 1 << 18, 1 << 19
#: Below this, a bound in single precision may be wrong.
SLACK = 1e-3
#: Turns the order of unsigned numbers into that of signed ones.
TOP = np.uint64(1 << 63)


def _local(folder: str) -> str | None:
    """The path of a folder that Python can open; None for another store."""
    scheme, colon, rest = folder.partition(":")
    return folder if not colon else "/" + rest.lstrip("/") if scheme == "file" else None


def _parts(folder: str) -> list[str]:
    return [f"{folder}/{x}" for x in sorted(os.listdir(folder)) if x.endswith(".parquet")]


def _batches(folder: str) -> Iterator[pa.RecordBatch]:
    for part in _parts(folder):
        yield from pq.ParquetFile(part).iter_batches(1 << 18)


def _map(path: str, kind) -> np.ndarray:
    return np.asarray(np.memmap(path, kind, "r")) if os.path.getsize(path) else np.zeros(0, kind)


def _strings(path: str) -> pa.Table:
    return pa.ipc.open_file(pa.memory_map(path)).read_all()


def _places(of: pa.Array, words: pa.Table) -> np.ndarray:
    """Row numbers of strings in a table of words; -1 without."""
    return pc.fill_null(pc.index_in(of, value_set=words.column(0)), -1).to_numpy(zero_copy_only=False).astype(np.int64)


def _string(x: pa.Array) -> pa.Array:
    return x.cast(pa.large_string())


def _gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[list[pa.RecordBatch]]:
    """Batches in groups of that many rows and more; a look-up in all words is worth its table then."""
    some, n = [], 0
    for b in batches:
        some.append(b)
        n += b.num_rows
        if n >= rows:
            yield some
            some, n = [], 0
    if n:
        yield some


def _trim() -> None:
    """Give memory that was let go back to the system; the allocators would keep it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


class _Files:
    """Writes arrays one after another into files of a folder."""

    def __init__(self, folder: str, *names: str):
        self.files = {x: open(f"{folder}/{x}", "wb") for x in names}

    def put(self, **arrays: np.ndarray) -> None:
        for name, x in arrays.items():
            x.tofile(self.files[name])

    def close(self) -> None:
        for f in self.files.values():
            f.close()


def _write_words(folder: str) -> None:
    """words (by id), cnt, total (of pairs that it begins), came (of those that it ends) and letters from the sorted table of words."""
    files = _Files(folder, "cnt", "total", "came", "letters")
    with pa.ipc.new_file(f"{folder}/words", pa.schema([("word", pa.large_string())])) as out:
        for b in _batches(f"{folder}/words.parquet"):
            out.write_batch(pa.record_batch([_string(b.column("word"))], ["word"]))
            number = lambda c, b=b: b.column(c).to_numpy(zero_copy_only=False)
            files.put(**{c: number(c).astype(np.int64) for c in ("cnt", "total", "came")}, letters=number("letters").astype(np.int32))
    files.close()


def _write_kinds(folder: str) -> None:
    """kinds (distinct tokens), the id of each one's lower case, and its state; and the ids whose candidates are needed."""
    files, words = _Files(folder, "ids", "state"), _strings(f"{folder}/words")
    open_ids = [np.zeros(0, np.int64)]
    with pa.ipc.new_file(f"{folder}/kinds", pa.schema([("tok", pa.large_string())])) as out:
        for b in _batches(f"{folder}/kinds.parquet"):
            out.write_batch(pa.record_batch([_string(b.column("tok"))], ["tok"]))
            ids, state = _places(_string(b.column("low")), words), b.column("state").to_numpy().astype(np.int16)
            files.put(ids=ids, state=state)
            open_ids.append(np.unique(ids[(state & 7 == 0) & ~((state & KNOWN > 0) & (state & COMMON > 0))]))
    files.close()
    np.unique(np.concatenate(open_ids)).tofile(f"{folder}/asked")


def _write_pairs(folder: str) -> None:
    rows = sum(pq.ParquetFile(x).metadata.num_rows for x in _parts(f"{folder}/pairs.parquet"))
    near.Pairs.write(folder, rows, ((b.column("hash").to_numpy().view(np.uint64) ^ TOP, b.column("cnt").to_numpy().astype(np.int64)) for b in _batches(f"{folder}/pairs.parquet")))
    shutil.rmtree(f"{folder}/pairs.parquet")


def _known_codes(folder: str, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    c, n = near.codes(_strings(f"{folder}/words").column(0).slice(start, end - start).to_pylist())
    return c, n


def _index_block(folder: str, number: int, start: int, end: int, longest: int) -> None:
    c, n = _known_codes(folder, start, end)
    ids = np.arange(start, end)
    key, owner = near.index(c[n <= longest], n[n <= longest], ids[n <= longest])
    for name, x in (("key", key), ("owner", owner), ("codes", c), ("length", n)):
        x.tofile(f"{folder}/index-{number}.{name}.tmp")
        os.replace(f"{folder}/index-{number}.{name}.tmp", f"{folder}/index-{number}.{name}")


def _concatenated(folder: str, name: str, n: int) -> None:
    with open(f"{folder}/{name}", "wb") as out:
        for k in range(n):
            with open(f"{folder}/index-{k}.{name}", "rb") as f:
                shutil.copyfileobj(f, out)
            os.remove(f"{folder}/index-{k}.{name}")


def _find(folder: str, part: int, n_blocks: int, longest: int, most: int) -> None:
    """Candidates of one part of the asked words."""
    asked = _map(f"{folder}/asked", np.int64)[part * ASKED : (part + 1) * ASKED]
    known = _map(f"{folder}/codes", np.uint32).reshape(-1, near.WIDTH), _map(f"{folder}/length", np.int32)
    blocks = ((_map(f"{folder}/index-{k}.key", np.uint64), _map(f"{folder}/index-{k}.owner", np.int32)) for k in range(n_blocks))
    words = _strings(f"{folder}/words").column(0).take(pa.array(asked)).to_pylist()
    c, n = near.codes(words)
    short = np.flatnonzero(n <= longest + 2)
    row, word, dist = near.nearest((c[short], n[short]), asked[short], known, blocks, most)
    long = _map(f"{folder}/long", np.int64).reshape(-1, 3)
    long = long[(long[:, 0] >= asked[0]) & (long[:, 0] <= asked[-1])]
    row, word, dist = np.concatenate([short[row], np.searchsorted(asked, long[:, 0])]), np.concatenate([word, long[:, 1].astype(np.int32)]), np.concatenate([dist, long[:, 2].astype(np.uint8)])
    m, word, dist = near.ranked(row, word, dist, _map(f"{folder}/cnt", np.int64), len(asked), most)
    for name, x in (("n", m.astype(np.uint16)), ("cand", word), ("dist", dist)):
        x.tofile(f"{folder}/index-{part}.{name}.tmp")
        os.replace(f"{folder}/index-{part}.{name}.tmp", f"{folder}/index-{part}.{name}")


def _each(spark: SparkSession, n: int, work) -> None:
    """Run ``work`` on 0 to n - 1, each number in a task of its own."""

    def run(batches):
        for b in batches:
            for k in b.column(0).to_pylist():
                work(k)
        _trim()
        yield from ()

    if n:
        spark.range(0, n, 1, n).mapInArrow(run, "id long").count()


def _package_of_workers(spark: SparkSession) -> None:
    spark.sparkContext.environment.setdefault("PYTHONPATH", os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))


def _prepare(spark: SparkSession, folder: str, store: str, rows: DataFrame, counts: DataFrame, pairs: DataFrame, params: Params) -> dict:
    """Write all files; sizes that the scores need."""
    path = lambda name: f"{store}/{name}.parquet"
    zero = lambda name: F.lit(0).cast("long").alias(name)
    seen = [
        counts.select("word", "cnt", zero("total"), zero("came")), row_totals(pairs).select(F.col("prev").alias("word"), zero("cnt"), "total", zero("came")),
        pairs.groupBy("word").agg(F.sum("cnt").alias("came")).select("word", zero("cnt"), zero("total"), "came"),
    ]
    kinds = rows.select(F.explode("a.text").alias("tok")).distinct().withColumn("low", F.lower("tok"))
    low = F.col("low")
    bare = F.translate(low, "(),._/–—-", "")
    ruled = bare.startswith("covid") | low.isin(*COVID_18, *VIRUS_CONFUSIONS, "significance", "lose", "road", "police")
    known = counts.where(F.col("cnt") >= params.min_count).select(F.col("word").alias("low"), F.lit(KNOWN).alias("known"))
    gate_number = F.coalesce(F.array_position(F.array(*map(F.lit, GATES)), gate(F.col("tok"))).cast("int"), F.lit(0))
    state = gate_number + F.coalesce("known", F.lit(0)) + F.when(protected_word(low), COMMON).otherwise(0) + F.when(ruled, RULED).otherwise(0)
    kinds.join(known, "low", "left").select("tok", "low", state.cast("short").alias("state")).write.parquet(path("kinds"))
    seen.append(spark.read.parquet(path("kinds")).select(F.col("low").alias("word"), zero("cnt"), zero("total"), zero("came")))
    words = functools.reduce(DataFrame.union, seen).groupBy("word").agg(*[F.sum(c).alias(c) for c in ("cnt", "total", "came")], F.length("word").alias("letters"))
    words.orderBy(F.desc("cnt"), F.desc("word")).write.parquet(path("words"))
    _write_words(folder)
    shutil.rmtree(f"{folder}/words.parquet")
    _write_kinds(folder)
    cnt = _map(f"{folder}/cnt", np.int64)
    n_words, n_known = len(cnt), int((cnt >= params.min_count).sum())

    def numbered(batches):
        words = _strings(f"{folder}/words")
        for some in _gathered(batches, ROWS):
            x = pa.Table.from_batches(some)
            key = _places(_string(x.column(0)), words) * n_words + _places(_string(x.column(1)), words)
            yield from pa.table([pa.array((near.Pairs.hashes(key) ^ TOP).view(np.int64)), x.column(2)], ["hash", "cnt"]).to_batches()
        _trim()

    # ordering reads its rows twice, so they are written before
    tables.settled(spark)
    pairs.select("prev", "word", F.col("cnt").cast("long").alias("cnt")).mapInArrow(numbered, "hash long, cnt long").write.parquet(path("numbered"))
    tables.settled(spark)
    spark.read.schema("hash long, cnt long").parquet(path("numbered")).orderBy("hash").write.parquet(path("pairs"))
    shutil.rmtree(f"{folder}/numbered.parquet")
    _write_pairs(folder)

    cuts = [0]  # blocks of known words end where the count changes
    while cuts[-1] < n_known:
        end = min(n_known, max(FIRST_BLOCK, min(4 * cuts[-1], cuts[-1] + 8 * FIRST_BLOCK)))
        cuts.append(int(n_known if end == n_known else np.searchsorted(-cnt, -cnt[end - 1], "right")))
    longest = min(params.max_index_length, near.WIDTH - 2)
    _each(spark, len(cuts) - 1, lambda k: _index_block(folder, k, cuts[k], cuts[k + 1], longest))
    for name in ("codes", "length"):
        _concatenated(folder, name, len(cuts) - 1)
    _long(spark, folder, store, counts, longest, params)
    n_parts = -(-len(_map(f"{folder}/asked", np.int64)) // ASKED)
    n_blocks, most = len(cuts) - 1, params.max_candidates
    _each(spark, n_parts, lambda k: _find(folder, k, n_blocks, longest, most))
    for name in ("n", "cand", "dist"):
        _concatenated(folder, name, n_parts)
    for k in range(n_blocks):
        os.remove(f"{folder}/index-{k}.key")
        os.remove(f"{folder}/index-{k}.owner")
    for name in ("codes", "length"):  # a worker that has searched may have them mapped
        os.truncate(f"{folder}/{name}", 0)
    n_tokens, n_types = counts.agg(F.greatest(F.coalesce(F.sum("cnt"), F.lit(0)), F.lit(1)), F.count("*")).first()
    return {"n": n_tokens, "v": n_types}


def _long(spark: SparkSession, folder: str, store: str, counts: DataFrame, longest: int, params: Params) -> None:
    """(id, id of the candidate, distance) for known words beyond the index; few are."""
    kinds = spark.read.parquet(f"{store}/kinds.parquet").where((F.length("low") > longest - 2) & (F.col("state").bitwiseAND(7) == 0)).select(F.col("low").alias("tok"))
    found = neighbours(kinds, counts.where(F.length("word") > longest), params).select("tok", "cand", F.col("dist").cast("long").alias("dist"))
    found.write.parquet(f"{store}/long.parquet")
    words = _strings(f"{folder}/words")
    out = [np.zeros((0, 3), np.int64)]
    for b in _batches(f"{folder}/long.parquet"):
        out.append(np.stack([_places(_string(b.column(0)), words), _places(_string(b.column(1)), words), b.column(2).to_numpy()], 1))
    shutil.rmtree(f"{folder}/kinds.parquet")
    np.concatenate(out).tofile(f"{folder}/long")


class Model:
    """The files, mapped, and the decision on contexts."""

    def __init__(self, folder: str, size: dict, params: Params):
        self.p, self.v = params, size["v"]
        self.words, self.kinds = _strings(f"{folder}/words"), _strings(f"{folder}/kinds")
        self.cnt, self.total, self.came, self.letters = _map(f"{folder}/cnt", np.int64), _map(f"{folder}/total", np.int64), _map(f"{folder}/came", np.int64), _map(f"{folder}/letters", np.int32)
        self.ids, self.state = _map(f"{folder}/ids", np.int64), _map(f"{folder}/state", np.int16)
        self.asked, self.many = _map(f"{folder}/asked", np.int64), _map(f"{folder}/n", np.uint16)
        self.cand, self.dist = _map(f"{folder}/cand", np.int32), _map(f"{folder}/dist", np.uint8)
        self.start = np.cumsum(self.many, dtype=np.int64) - self.many
        self.pairs = near.Pairs(folder)
        alone = lambda cnt: np.log((cnt + params.k_unigram) / (size["n"] + params.k_unigram * size["v"]))
        self.alone, self.never, self.fall, self.zipf = alone(self.cnt), alone(0), math.log(params.backoff), np.log10(self.cnt + 1)
        self.bounds()

    def follows(self, cnt: np.ndarray, total: np.ndarray) -> np.ndarray:
        return np.log((cnt + self.p.k_bigram) / (total + self.p.k_bigram * self.v)) if self.p.bigram_mode == "addk" else np.log(cnt / total)

    def left(self, prev: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The log probability of words behind others; -1 is one that no table has, -2 none at all."""
        before, out = np.where(prev >= 0, self.total[prev], 0), self.alone[word]
        out[before > 0] += self.fall
        at, seen = self.pairs.counts(np.where(prev >= 0, prev * len(self.cnt) + word, -1))
        out[at] = self.follows(seen, before[at])
        return out

    def right(self, word: np.ndarray, nxt: np.ndarray) -> np.ndarray:
        """The log probability of what follows words."""
        total = self.total[word]
        out = self.unseen(word, nxt)
        at, seen = self.pairs.counts(np.where(nxt >= 0, word * len(self.cnt) + nxt, -1))
        out[at] = self.follows(seen, total[at])
        return out

    def unseen(self, word: np.ndarray, nxt: np.ndarray) -> np.ndarray:
        alone = np.where(nxt >= 0, self.alone[nxt], self.never)
        return np.where(nxt == -2, 0.0, np.where(self.total[word] > 0, self.fall + alone, alone))

    def bounds(self) -> None:
        """By word, in single precision: logarithms for bounds of scores. A pair occurs as often as either word begins or ends pairs, at most."""
        p, add = self.p, (self.p.k_bigram, self.p.k_bigram * self.v) if self.p.bigram_mode == "addk" else (0.0, 0.0)
        with np.errstate(divide="ignore"):
            log = lambda x, k, none: np.where(x > 0, np.log(x + k), none).astype(np.float32)
            self.begins, self.ends, self.per = log(self.total, add[0], -np.inf), log(self.came, add[0], -np.inf), log(self.total, add[1], 0)
        self.plain = (p.w_unigram * self.alone + p.w_zipf * self.zipf).astype(np.float32)
        self.alone32, self.back = self.alone.astype(np.float32), np.where(self.total > 0, self.fall, 0).astype(np.float32)

    def score(self, word: np.ndarray, left: np.ndarray, right: np.ndarray, dist: np.ndarray | float) -> np.ndarray:
        p = self.p
        return p.w_unigram * self.alone[word] + p.w_left * left + p.w_right * right + p.w_zipf * self.zipf[word] - p.w_distance * dist

    def decide(self, prev: np.ndarray, tok: np.ndarray, nxt: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(best word or -1, margin, whether it is enough) of contexts.

        A known word's original competes, so options whose bound is below its score are left out before their pairs are looked up; that changes no decision.
        """
        best, margin, known = np.full(len(tok), -1, np.int64), np.full(len(tok), np.nan), self.cnt[tok] >= self.p.min_count
        own = self.score(tok, self.left(prev, tok), self.right(tok, nxt), 0.0)
        row = np.searchsorted(self.asked, tok)
        many = self.many[row].astype(np.int64)
        ends = np.cumsum(many)
        cuts = np.searchsorted(ends, np.arange(OPTIONS, ends[-1] if len(ends) else 0, OPTIONS)) + 1
        none, letters = np.float32(-np.inf), self.letters[tok]
        fee = np.where(known, 0, self.p.w_nonword_distance).astype(np.float32)
        least = np.where(known, own - SLACK, -np.inf).astype(np.float32)
        pick = lambda x, at, other: np.where(at >= 0, x[at], other)
        before = pick(self.begins, prev, none), pick(self.per, prev, np.float32(0)), pick(self.back, prev, np.float32(0))
        after = pick(self.ends, nxt, none), np.where(nxt == -2, 0, pick(self.alone, nxt, self.never)).astype(np.float32)
        for some in np.split(np.arange(len(tok)), cuts):
            m = many[some]
            each = lambda x, some=some, m=m: np.repeat(x[some], m)
            at = np.repeat(self.start[row[some]] - np.cumsum(m) + m, m) + np.arange(m.sum())
            word, dist = self.cand[at], self.dist[at]
            pay = np.float32(self.p.w_length) * np.abs(self.letters[word] - each(letters)) + dist * each(fee)
            total = self.plain[word] - np.float32(self.p.w_distance) * dist - pay
            last = each(nxt) == -2
            right = np.maximum(np.minimum(self.begins[word], each(after[0])) - self.per[word], each(after[1]) + np.where(last, np.float32(0), self.back[word]))
            total += np.float32(self.p.w_right) * np.where(last, np.float32(0), right)
            total += np.float32(self.p.w_left) * np.maximum(np.minimum(each(before[0]), self.ends[word]) - each(before[1]), self.alone32[word] + each(before[2]))
            fit = np.flatnonzero(total >= each(least))
            of, word, dist, right = np.repeat(some, m)[fit], word[fit].astype(np.int64), dist[fit].astype(np.float64), right[fit]
            pay = np.where(known[of], 0.0, self.p.w_nonword_distance * dist) + self.p.w_length * np.abs(self.letters[word] - self.letters[tok[of]])
            left = self.left(prev[of], word)
            fit = self.score(word, left, np.where(nxt[of] == -2, 0, right), dist) - pay >= least[of]
            of, word, dist, pay, left = (x[fit] for x in (of, word, dist, pay, left))
            if not len(of):
                continue
            score = self.score(word, left, self.right(word, nxt[of]), dist) - pay
            first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            place = np.rint(score * 1e9)
            top = np.maximum.reduceat(place, first)
            hits = np.flatnonzero(place == np.repeat(top, np.diff(np.append(first, len(of)))))
            hit = hits[np.searchsorted(hits, first)]  # the first of equals
            at = of[first]
            moved = ~known[at] | (top > np.rint(own[at] * 1e9))
            best[at[moved]] = word[hit[moved]]
            margin[at[moved]] = (score[hit] - own[at])[moved]
        with np.errstate(invalid="ignore"):
            enough = np.rint(margin * 1e9) / 1e9 >= np.where(known, self.p.delta_rw, self.p.delta)
        return best, margin, enough

    def tokens(self, lists: pa.ListArray) -> pa.ListArray:
        """(state, best, margin) of each token of documents."""
        ends = lists.offsets.to_numpy().astype(np.int64)
        flat = lists.values.slice(ends[0], ends[-1] - ends[0])
        ends = ends - ends[0]
        coded = flat.dictionary_encode()
        kind = _places(_string(coded.dictionary), self.kinds)[coded.indices.to_numpy()]
        ids, state = self.ids[kind], self.state[kind].copy()
        prev, nxt = np.concatenate([[-2], ids[:-1]]), np.concatenate([ids[1:], [-2]])
        prev[ends[:-1][ends[:-1] < len(ids)]] = -2
        nxt[ends[1:][ends[1:] > 0] - 1] = -2
        todo = np.flatnonzero((state & 7 == 0) & ~((state & KNOWN > 0) & (state & COMMON > 0)))
        n = len(self.cnt) + 2
        pair, of_pair = np.unique((prev[todo] + 2) * n + ids[todo], return_inverse=True)
        whole, of_whole = np.unique(of_pair * n + nxt[todo] + 2, return_inverse=True)
        before = pair[whole // n]
        best, margin, enough = self.decide(before // n - 2, before % n, whole % n - 2)
        best, margin, enough = best[of_whole], margin[of_whole], enough[of_whole]
        moved = best >= 0
        state[todo] |= np.where(moved, MOVED, 0).astype(np.int16) | np.where(moved & enough, ENOUGH, 0).astype(np.int16)
        word, by = np.full(len(ids), -1, np.int64), np.full(len(ids), np.nan)
        word[todo[moved & enough]] = best[moved & enough]
        by[todo[moved]] = margin[moved]
        chosen = self.words.column(0).take(pa.array(word, mask=word < 0)).combine_chunks().cast(pa.string())
        rows = pa.StructArray.from_arrays([pa.array(state), chosen, pa.array(by, mask=np.isnan(by))], ["state", "best", "margin"])
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), rows)


@functools.lru_cache(1)
def _model(folder: str, n: int, v: int, params: Params) -> Model:
    return Model(folder, {"n": n, "v": v}, params)


def remove(spark: SparkSession, made: list[str]) -> None:
    """Delete tables, and the corrector's files once nothing is corrected by them. They are made empty before, as a worker that waits for its next task may
    have them mapped, and deleting alone would not give their disk back."""
    for path in made:
        for name, _, files in os.walk(_local(path) or ""):
            for x in files:
                os.truncate(f"{name}/{x}", 0)
    tables.remove(spark, made)


def documents(docs: DataFrame, counts: DataFrame, pairs: DataFrame, params: Params = Params(), doc_id: str = "doc_id", text: str = "text", made: list[str] | None = None) -> DataFrame | None:
    """(doc_id, a): an array of a document's tokens with their decisions. None if Python can't open the shared folder. The folder of the files is added to ``made``."""
    spark = docs.sparkSession
    shared = shared_folder(spark)
    if not shared or not _local(shared):
        return None
    _package_of_workers(spark)
    store = f"{shared}/repair-{uuid.uuid4().hex}"
    folder = _local(store)
    if made is not None:
        made.append(store)
    rows = docs.select(F.col(doc_id).alias("doc_id"), tf.pieces(F.col(text)).alias("a")).where(F.size("a") > 0)
    rows.write.parquet(f"{store}/tokens.parquet")
    rows = spark.read.schema(rows.schema).parquet(f"{store}/tokens.parquet")
    size = _prepare(spark, folder, store, rows, counts, pairs, params)

    def run(batches):
        model = _model(folder, size["n"], size["v"], params)
        for batch in batches:
            n = batch.column(0).flatten()[1].value_lengths().to_numpy(zero_copy_only=False)
            number = np.cumsum(n) // TOKENS
            for part in np.split(np.arange(len(n)), np.flatnonzero(np.diff(number)) + 1):
                if len(part):
                    some = batch.slice(part[0], len(part))
                    lists = some.column(0).flatten()[1]
                    ends = lists.offsets
                    texts = pa.ListArray.from_arrays(ends, lists.values.flatten()[0])
                    yield pa.record_batch([some.column(0), model.tokens(texts)], ["row", "out"])
        _trim()

    carried = rows.select(F.struct("doc_id", "a").alias("row"))
    out = T._parse_datatype_string("array<struct<state: smallint, best: string, margin: double>>")
    found = carried.mapInArrow(run, T.StructType([carried.schema["row"], T.StructField("out", out)]))
    near_by = lambda i: F.lower(F.get(F.col("row.a"), i)["text"])

    def decided(x, i):
        return F.struct(i.alias("pos"), x["text"].alias("tok"), x["ws"].alias("ws"), F.get(F.col("out"), i).alias("o"), F.when(F.get(F.col("out"), i)["state"].bitwiseAND(RULED) > 0, domain_rule(x["text"], near_by(i - 1), near_by(i + 1))).alias("rule"))

    return found.select("row.doc_id", F.transform("row.a", decided).alias("a"))


def _decision(x: Column, params: Params) -> list[Column]:
    """What becomes of a token, from its struct."""
    state, rule = x["o"]["state"], x["rule"]
    bit = lambda b: state.bitwiseAND(b) > 0
    gate0 = F.get(F.array(*map(F.lit, GATES)), state.bitwiseAND(7) - 1)
    is_gated = state.bitwiseAND(7) > 0
    by_rule = rule.isNotNull() & (F.lit(params.rules_before_gates) | ~is_gated)
    gated = is_gated & ~by_rule
    tried = rule.isNull() & ~is_gated
    moved, applied = tried & bit(MOVED), tried & bit(ENOUGH)
    gate_name = F.when(by_rule, F.lit(None)).when(gated, gate0).when(bit(KNOWN) & bit(COMMON), "real_word_protect").when(moved & ~applied, F.when(bit(KNOWN), "margin_delta_rw").otherwise("margin_delta"))
    kind = F.when(by_rule, "Real-word error").when(gated, "Correct").when(applied, F.when(bit(KNOWN), "Real-word error").otherwise("Non-word error")).when(bit(KNOWN), "Correct").otherwise("Unknown (OOV)")
    return [
        F.when(by_rule, rule).when(applied, x["o"]["best"]).otherwise(x["tok"]).alias("corrected"), kind.alias("error_type"), F.when(by_rule | applied, "apply").otherwise("abstain").alias("decision"),
        gate_name.isNotNull().alias("protected"), gate_name.alias("gate"), F.when(moved, x["o"]["margin"]).alias("margin"),
    ]


def correct_tokens(docs: DataFrame, counts: DataFrame, pairs: DataFrame, params: Params = Params(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, pos, tok, ws, corrected, error_type, decision, protected, gate, margin) of every token of the documents. Context is the original text."""
    rows = documents(docs, counts, pairs, params, doc_id, text)
    if rows is None:
        rows = correct.decide(correct.tokens(docs, doc_id, text), counts, pairs, params)
        return rows.select("doc_id", "pos", "tok", "ws", "corrected", "error_type", "decision", "protected", "gate", "margin")
    return rows.select("doc_id", F.explode("a").alias("x")).select("doc_id", "x.pos", "x.tok", "x.ws", *_decision(F.col("x"), params))


def corrected_text(docs: DataFrame, counts: DataFrame, pairs: DataFrame, params: Params = Params(), doc_id: str = "doc_id", text: str = "text", made: list[str] | None = None) -> DataFrame:
    """(doc_id, corrected_text): the documents put together again, right-trimmed; those without tokens are left out. What the rows are read from is added to ``made``."""
    rows = documents(docs, counts, pairs, params, doc_id, text, made)
    if rows is None:
        return correct.corrected_text(correct_tokens(docs, counts, pairs, params, doc_id, text))
    parts = F.transform("a", lambda x: F.concat(_decision(x, params)[0], x["ws"]))
    return rows.select("doc_id", F.rtrim(F.array_join(parts, "")).alias("corrected_text"))
