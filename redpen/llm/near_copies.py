"""Near copies by BagMinHash signatures of word-shingle multisets.

A text is the multiset of its 5-word shingles (of all its words, if it has fewer). The weight axis
of a shingle is cut into dyadic blocks [0,1), [1,2), [2,4), [4,8), ...; each block has a Poisson process
whose rate is its width. A point has a time, one of the signature's registers, and a place in its block, found by
halving the block with random bits; it counts if that place is under the shingle's weight. A
register holds its earliest point. A process stops once its next point is later than all the registers, so a text costs
about its number of shingles plus m log m points, whatever the weights. Two signatures agree in a
register with the probability of the weighted Jaccard similarity.

Texts of equal words are one node. Nodes that share a band of registers are candidates; candidate
pairs are verified by the exact multiset overlap. A bucket compares all its nodes with its most central
one, that which shares most buckets with others; so groups of true copies take a star of comparisons. Buckets whose nodes are then not all in
one component are searched by an exact prefix join, which finds every near pair that is left. All links between
candidates hold, and no pair is dropped.

Words are as in decontamination: lower-cased runs of digits, letters a-z and code points from U+0080 on.
Documents without words (null or empty texts too) are alone in their class, but rows of equal id and text are copies. Class ids are the
smallest document ids of a class, null coming first. Very long texts are taken whole, a few at a time. An empty table
gives no rows. A caller's other columns may have any names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from redpen.llm.common import Scratch, kept, slices, small_batches, trimmed
from redpen.llm.components import components
from redpen.llm.decontaminate import words

SHINGLE = 5
BANDS, ROWS = 24, 4
#: A pair is near if PARTS times its common weight is at least PARTS - 1 times its joint weight.
PARTS = 5
#: With c common of a + b shingles this is WHOLE * c >= SHARE * (a + b).
WHOLE, SHARE = 2 * PARTS - 1, PARTS - 1
#: Texts, and bytes of text, that are signed at once in a worker.
AT_ONCE, BYTES_AT_ONCE = 400, 1_000_000
#: Bytes that a worker is handed at once; it signs or compares them in smaller parts.
BATCH_BYTES = 4_000_000
#: Lengths within this ratio are one class in the prefix join.
LENGTHS = 1.05
CACHE_WORDS = 300_000

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of the splitmix64 generator."""
    with np.errstate(over="ignore"):
        x = x + _A
        x = (x ^ (x >> np.uint64(30))) * _B
        x = (x ^ (x >> np.uint64(27))) * _C
        return x ^ (x >> np.uint64(31))


def bag_min_hash(of: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, m: int) -> np.ndarray:
    """Registers (n x m) of ``n`` multisets given as rows (multiset, element hash, whole weight)."""
    registers = np.full(n * m, np.inf)
    parts = []
    for j in range(int(weight.max(initial=0)).bit_length() + 1):
        low = 0 if j == 0 else 1 << (j - 1)
        in_block = np.flatnonzero(weight > low)
        if len(in_block):
            with np.errstate(over="ignore"):
                seed = mix(element[in_block] ^ mix(np.full(1, j, np.uint64)))
            parts.append((of[in_block], seed, np.full(len(in_block), max(low, 1), np.float64), np.minimum(weight[in_block] - low, max(low, 1)).astype(np.float64)))
    if not parts:
        return registers.reshape(n, m)
    who, seed, rate, inside = (np.concatenate(x) for x in zip(*parts, strict=True))
    time, step = np.zeros(len(who)), 0
    while len(who):
        ahead = 1 if len(who) > 2000 else 32  # points later than need be do no harm
        t = np.arange(step, step + ahead, dtype=np.uint64)
        with np.errstate(over="ignore"):
            first = mix(seed[:, None] + t[None, :] * _C)
            second = mix(first)
        gaps = -np.log(((first >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53) / (rate[:, None] * m)
        times = time[:, None] + np.cumsum(gaps, axis=1)
        # the high bits halve the block down to a place, the low bits choose the register
        counts = ((second >> np.uint64(24)).astype(np.float64) / 2.0**40) * rate[:, None] < inside[:, None]
        place = who[:, None] * m + ((second & np.uint64(0xFFFFFF)) % np.uint64(m)).astype(np.int64)
        np.minimum.at(registers, place[counts], times[counts])
        time, step = times[:, -1], step + ahead
        some, back = np.unique(who, return_inverse=True)
        latest = registers.reshape(n, m)[some].max(axis=1)
        alive = time <= latest[back]
        who, seed, rate, inside, time = who[alive], seed[alive], rate[alive], inside[alive], time[alive]
    return registers.reshape(n, m)


class Signer:
    """Band hashes, word digest and number of shingles of texts."""

    def __init__(self, bands: int, rows: int):
        self.bands, self.rows = bands, rows
        self.words: dict[bytes, int] = {}
        self.powers = [mix(np.array([k + 1], np.uint64))[0] | np.uint64(1) for k in range(SHINGLE)]

    def word_ids(self, w: list[bytes]) -> list[int]:
        known = self.words
        try:
            return [known[x] for x in w]
        except KeyError:
            if len(known) > CACHE_WORDS:
                known.clear()
            for x in set(w).difference(known):
                known[x] = xxhash.xxh3_64_intdigest(x)
            return [known[x] for x in w]

    def shingles(self, w: list[bytes]) -> np.ndarray:
        ids = np.array(self.word_ids(w), np.uint64)
        n = max(1, len(ids) - SHINGLE + 1)
        with np.errstate(over="ignore"):
            out = np.full(n, np.uint64(min(len(ids), SHINGLE)))
            for k in range(min(SHINGLE, len(ids))):
                out += mix(ids[k : k + n]) * self.powers[k]
        return mix(out)

    def sign(self, texts: list[bytes | None]) -> tuple[list, list, list]:
        split = [words(t) for t in texts]
        some = [i for i, w in enumerate(split) if w]
        digests: list = [None] * len(texts)
        counts = [0] * len(texts)
        bands: list = [None] * len(texts)
        of, element, weight = [], [], []
        for row, i in enumerate(some):
            digests[i] = xxhash.xxh3_128_digest(b" ".join(split[i]))
            every = self.shingles(split[i])
            counts[i] = len(every)
            distinct, n = np.unique(every, return_counts=True)
            of.append(np.full(len(distinct), row, np.int64))
            element.append(distinct)
            weight.append(n)
        if some:
            registers = bag_min_hash(np.concatenate(of), np.concatenate(element), np.concatenate(weight), len(some), self.bands * self.rows)
            bits = registers.astype(np.float32).view(np.uint32).astype(np.uint64).reshape(len(some), self.bands, self.rows)
            hashes = np.broadcast_to(mix(np.arange(self.bands, dtype=np.uint64)), bits.shape[:2])
            for r in range(self.rows):
                hashes = mix(hashes ^ bits[:, :, r])
            for i, row in zip(some, hashes.view(np.int64), strict=True):
                bands[i] = row
        return digests, counts, bands


def sign(rows: DataFrame, bands: int, registers: int) -> DataFrame:
    """(doc_id, h1, h2, node, n, bands) of rows (doc_id, h1, h2, alone, text). Rows without words get a node of their own, their id and text, and no bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("near_copies")
        signer = Signer(bands, registers)
        for batch in trimmed(batches):
            for part in slices(batch, 4, AT_ONCE, BYTES_AT_ONCE):
                digests, counts, hashes = signer.sign(part.column(4).to_pylist())
                nodes = [a if d is None else d for d, a in zip(digests, part.column(3).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(nodes, pa.binary()), pa.array(counts, pa.int64()), pa.array(hashes, pa.list_(pa.int64()))], names=["doc_id", "h1", "h2", "node", "n", "bands"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, h1 long, h2 long, node binary, n long, bands array<long>")


def hashes(docs: DataFrame) -> tuple[Column, Column]:
    """128 bits of a whole row, but for columns that can't be hashed (maps). Rows alike in this are taken for one row that is repeated."""
    cols = [F.col(f"`{f.name}`") for f in docs.schema if not any(x in f.dataType.simpleString() for x in ("map<", "variant"))]
    return F.xxhash64(F.lit(1), F.struct(*cols)), F.xxhash64(F.lit(2), F.struct(*cols))


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, h1, h2, alone, text): what is signed of each row."""
    col, name = F.col(f"`{text}`").cast("string"), F.col(f"`{doc_id}`")
    h1, h2 = hashes(docs)
    null = F.struct(name, col)
    alone = F.unhex(F.concat(F.lit("00"), F.lpad(F.hex(F.xxhash64(F.lit(3), null)), 16, "0"), F.lpad(F.hex(F.xxhash64(F.lit(4), null)), 16, "0")))
    return docs.select(name.alias("doc_id"), h1.alias("h1"), h2.alias("h2"), alone.alias("alone"), col.cast("binary").alias("text"))


def bag(text: bytes | None) -> Counter:
    w = words(text)
    return Counter(zip(*(w[i:] for i in range(SHINGLE)), strict=False)) if len(w) >= SHINGLE else Counter([tuple(w)] if w else [])


def near(a: Counter, b: Counter) -> bool:
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    common = sum(min(n, large[x]) for x, n in small.items() if x in large)
    return WHOLE * common >= SHARE * (a.total() + b.total())


def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those (u, v) pairs whose texts are near. Several rows of one v follow each other, so its shingles are made once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("near_copies")
        last, bag_v = None, Counter()
        for batch in trimmed(batches):
            us, vs, ok = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
            for v, a, b in zip(vs, batch.column(2), batch.column(3), strict=True):
                if v != last:
                    last, bag_v = v, bag(b.as_py())
                ok.append(near(bag(a.as_py()), bag_v))
            yield pa.RecordBatch.from_arrays([pa.array([u for u, y in zip(us, ok, strict=True) if y], pa.int64()), pa.array([v for v, y in zip(vs, ok, strict=True) if y], pa.int64())], names=["u", "v"])

    # lengths first: they rule out pairs before any text is moved
    sizes = texts.select("id", "n")
    one = pairs.join(sizes.select(F.col("id").alias("u"), F.col("n").alias("n_u")), "u").join(sizes.select(F.col("id").alias("v"), F.col("n").alias("n_v")), "v")
    alike = one.where(F.least("n_u", "n_v") * PARTS >= F.greatest("n_u", "n_v") * (PARTS - 1)).select("u", "v")
    with_u = alike.join(texts.select(F.col("id").alias("u"), F.col("text").alias("text_u")), "u")
    return with_u.join(texts.select(F.col("id").alias("v"), F.col("text").alias("text_v")), "v").select("u", "v", "text_u", "text_v").mapInArrow(run, "u long, v long")


def buckets(nodes: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(bucket, id) of the buckets with two nodes or more, and (bucket, head): the node of each that shares most buckets with others."""
    exploded = nodes.select("id", F.explode("bands").alias("bucket"))
    sizes = exploded.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    members = scratch.table(exploded.join(sizes, "bucket").select("bucket", "id", "size"), "members")
    central = members.groupBy("id").agg(F.sum("size").alias("central"))
    heads = members.join(central, "id").groupBy("bucket").agg(F.max(F.struct("central", (-F.col("id")).alias("less"))).alias("most"))
    return members.select("bucket", "id"), heads.select("bucket", (-F.col("most.less")).alias("head"))


def still_apart(members: DataFrame, of: DataFrame) -> DataFrame:
    """(id, comp): the nodes of buckets whose nodes are in different components."""
    labelled = members.join(of.withColumnRenamed("node", "id"), "id", "left").select("bucket", "id", F.coalesce("comp", "id").alias("comp"))
    apart = labelled.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("bucket")
    return labelled.join(apart, "bucket", "left_semi").select("id", "comp").distinct()


def shingle_keys(rest: DataFrame, texts: DataFrame) -> DataFrame:
    """(id, comp, n, keys): the shingles of each node, the second of a kind as a key of its own and so on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("near_copies")
        signer = Signer(BANDS, ROWS)
        for batch in trimmed(batches):
            for part in slices(batch, 3, AT_ONCE, BYTES_AT_ONCE):
                out = []
                for text in part.column(3).to_pylist():
                    distinct, counts = np.unique(signer.shingles(words(text)), return_counts=True)
                    again = np.repeat(distinct, counts)
                    nth = np.arange(len(again)) - np.repeat(np.cumsum(counts) - counts, counts)
                    with np.errstate(over="ignore"):
                        out.append(mix(again + nth.astype(np.uint64) * _B).view(np.int64))
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(out, pa.list_(pa.int64()))], names=["id", "comp", "n", "keys"])

    return rest.join(texts, "id").select("id", "comp", "n", "text").mapInArrow(run, "id long, comp long, n long, keys array<long>")


def length_class(n: Column) -> Column:
    return F.floor(F.log(n) / F.log(F.lit(LENGTHS))).cast("int")


def sharing_rare(rest: DataFrame, texts: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(u, v), u the smaller id: all pairs of (id, comp) nodes of different components that can be near, and few others.

    Put the shingles of each node in one order: first those that occur in no other component, then by rarity.
    With c common shingles, near means WHOLE * c >= SHARE * (n_u + n_v). If the first common one is the i-th of u
    and the j-th of v (from 0), c is at most n_u - i and n_v - j. So i is at most a fifth of n_u, for the shorter text v
    j is at most a ninth of n_v, and i bounds how long v can be. A node with many shingles of its own thus has no
    shared one to be joined on, and classes of length in the key keep the others of a frequent shingle apart.
    """
    scratch = scratch or Scratch(rest.sparkSession, "near-copies")
    toks = scratch.table(shingle_keys(rest, texts), "tokens")
    each = toks.select("id", "comp", "n", F.explode("keys").alias("key"))
    seen = each.groupBy("key").agg(F.count("*").alias("many"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key", "many")
    shared = each.join(seen, "key").groupBy("id", "comp", "n").agg(F.array_sort(F.collect_list(F.struct("many", "key"))).alias("x"))
    own = F.col("n") - F.size("x")
    first = F.greatest(F.lit(0), F.floor(F.col("n") / PARTS) - own + 1).cast("int")
    placed = shared.select("id", "comp", "n", own.alias("own"), F.posexplode(F.slice("x", F.lit(1), first)).alias("p", "t"))
    prefix = scratch.table(placed.select("id", "comp", "n", (F.col("own") + F.col("p")).alias("i"), "t.key"), "prefix")

    shorter = prefix.where(WHOLE * (F.col("n") - F.col("i")) >= 2 * SHARE * F.col("n")).select("key", length_class(F.col("n")).alias("cls"), F.col("id").alias("v"), F.col("comp").alias("comp_v"), F.col("n").alias("n_v"), F.col("i").alias("j"))
    lo, hi = F.ceil(F.col("n") * (PARTS - 1) / PARTS), F.least(F.col("n"), F.floor((F.col("n") - F.col("i")) * WHOLE / SHARE) - F.col("n"))
    longer = prefix.where(lo <= hi).select("key", F.explode(F.sequence(length_class(lo), length_class(hi))).alias("cls"), F.col("id").alias("u"), F.col("comp").alias("comp_u"), F.col("n").alias("n_u"), "i")
    both = longer.join(shorter, ["key", "cls"]).where(
        (F.col("comp_u") != F.col("comp_v")) & ((F.col("n_v") < F.col("n_u")) | ((F.col("n_v") == F.col("n_u")) & (F.col("v") < F.col("u"))))
        & (PARTS * F.col("n_v") >= (PARTS - 1) * F.col("n_u")) & (WHOLE * F.least(F.col("n_u") - F.col("i"), F.col("n_v") - F.col("j")) >= SHARE * (F.col("n_u") + F.col("n_v")))
    )
    return both.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row a document: doc_id, h1 and h2 (its row's hash), class_id, class_size, and ``first``, true for the row kept of a class and rows like it."""
    with small_batches(docs.sparkSession, BATCH_BYTES):
        return _classes(docs, doc_id, text, bands, rows)


def _classes(docs: DataFrame, doc_id: str, text: str, bands: int, rows: int) -> DataFrame:
    scratch = Scratch(docs.sparkSession, "near-copies")
    given = keyed(docs, doc_id, text)
    signed = scratch.table(sign(given, bands, rows), "signed")
    at = F.struct("doc_id", "h1", "h2")
    nodes = signed.groupBy("node").agg(F.min(at).alias("at"), F.count("*").alias("rows"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    nodes = scratch.table(nodes.withColumn("id", F.monotonically_increasing_id()), "nodes")
    members, heads = buckets(nodes, scratch)

    # the texts of all nodes that share a bucket, one a node
    wanted = nodes.join(members.select("id").distinct(), "id", "left_semi").select("id", "n", "at.h1", "at.h2")
    texts = scratch.table(given.select("h1", "h2", "text").join(wanted, ["h1", "h2"]).select("id", "n", "text").dropDuplicates(["id"]), "texts")
    star = members.join(heads, "bucket").where("id <> head").select(F.col("id").alias("u"), F.col("head").alias("v")).distinct()
    of = components(verify(star, texts), scratch)
    rest = scratch.table(still_apart(members, of), "rest")
    if rest.take(1):
        linked = verify(sharing_rare(rest, texts, scratch), texts)
        of = components(of.where("node <> comp").select(F.col("node").alias("u"), F.col("comp").alias("v")).union(linked), scratch)

    rows_ = F.when(F.col("n") > 0, F.col("rows")).otherwise(1)  # without words it is alone
    per_node = nodes.join(of.withColumnRenamed("node", "id"), "id", "left").select("node", "at", rows_.alias("rows"), F.coalesce("comp", "id").alias("comp"))
    sizes = per_node.groupBy("comp").agg(F.min("at").alias("kept"), F.sum("rows").alias("class_size"))
    per_node = scratch.table(per_node.join(sizes, "comp").select("node", "kept", "class_size"), "classes")
    scratch.drop("members", "texts", "rest", "tokens", "prefix", "edges", "nodes")
    labelled = signed.select("doc_id", "h1", "h2", "node").join(per_node, "node")
    return labelled.select("doc_id", "h1", "h2", F.col("kept.doc_id").alias("class_id"), "class_size", (at == F.col("kept")).alias("first"))


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document with its class and the class's size."""
    return classes(docs, doc_id, text).select("doc_id", "class_id", "class_size")


def clean(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each class, with all its columns: the one of the smallest id, and among rows of that id the one whose row has the smallest hash."""
    gone = classes(docs, doc_id, text).where(~F.col("first")).select("h1", "h2").distinct()
    h1, h2 = hashes(docs)
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), h1.alias("h1"), h2.alias("h2"))
    return whole.join(gone, ["h1", "h2"], "left_anti").dropDuplicates(["h1", "h2"]).select("row.*")
