"""Token ids as binary files with Elias-Fano document boundaries.

A file is a row of blocks. A block holds documents in ascending order of their ids (null first):
a header, the document ids and the document ends as two Elias-Fano lists, and all token ids as one
array of 16-bit or 32-bit integers, whichever holds the vocabulary. An Elias-Fano list keeps the low
bits of each number packed and the high bits as unary gaps in a bitmap; a position sample every 512
ones lets select return any offset without a table of 64-bit offsets.

Spark writes the files itself (text rows are bytes to it), so they are committed like any table
and survive lost executors. A null text is an empty one: its only id is the end id. Repeated rows
are repeated in the files; an empty table makes no blocks and no rows.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from redpen.llm.common import checkpoint, kept, shared_dir

MAGIC = b"EFTOKEN1"
#: magic, writing task, number in the task, rows, null ids among them, token ids, width, base of the document ids
HEADER = struct.Struct("<8sIIIIQIq")
SAMPLE = 512
BLOCK_IDS, FILE_BLOCKS = 2_000_000, 16
CACHE_WORDS = 500_000


class EliasFano:
    """A list of ``n`` non-decreasing numbers below 2 ** 64."""

    HEAD = struct.Struct("<IIQQ")

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, sample: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.sample = n, low_bits, low, high, sample

    @classmethod
    def of(cls, numbers: np.ndarray) -> EliasFano:
        x = np.asarray(numbers, dtype=np.uint64)
        n = len(x)
        low_bits = max(0, (int(x[-1]) // n).bit_length() - 1) if n else 0
        places = (x >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(places[-1]) + 1 if n else 0, np.uint8)
        bits[places] = 1
        if low_bits:
            shifts = np.arange(low_bits, dtype=np.uint64)
            low = np.packbits(((x[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        else:
            low = np.zeros(0, np.uint8)
        return cls(n, low_bits, low, np.packbits(bits, bitorder="little"), places[::SAMPLE].astype("<u4"))

    def to_bytes(self) -> bytes:
        return self.HEAD.pack(self.n, self.low_bits, len(self.low), len(self.high)) + self.sample.tobytes() + self.low.tobytes() + self.high.tobytes()

    @classmethod
    def read(cls, data: memoryview, at: int) -> tuple[EliasFano, int]:
        n, low_bits, n_low, n_high = cls.HEAD.unpack_from(data, at)
        at += cls.HEAD.size
        samples = -(-n // SAMPLE)
        sample = np.frombuffer(data, "<u4", samples, at)
        low = np.frombuffer(data, np.uint8, n_low, at + 4 * samples)
        high = np.frombuffer(data, np.uint8, n_high, at + 4 * samples + n_low)
        return cls(n, low_bits, low, high, sample), at + 4 * samples + n_low + n_high

    def _low(self, i: int) -> int:
        if not self.low_bits:
            return 0
        first = i * self.low_bits
        piece = int.from_bytes(self.low[first >> 3 : (first + self.low_bits + 7) >> 3].tobytes(), "little")
        return (piece >> (first & 7)) & ((1 << self.low_bits) - 1)

    def select(self, i: int) -> int:
        """The ``i``-th number: the place of the i-th one in the bitmap gives its high bits."""
        place, left = int(self.sample[i // SAMPLE]), i % SAMPLE
        byte = place >> 3
        if left:
            left += int(self.high[byte] & ((1 << (place & 7)) - 1)).bit_count()
            while (ones := int(self.high[byte]).bit_count()) <= left:
                left -= ones
                byte += 1
            bits = int(self.high[byte])
            for _ in range(left):
                bits &= bits - 1
            place = 8 * byte + (bits & -bits).bit_length() - 1
        return (place - i) << self.low_bits | self._low(i)

    def all(self) -> np.ndarray:
        places = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        x = (places - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)
        if self.low_bits and self.n:
            bits = np.unpackbits(self.low, bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits)
            x |= (bits.astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        return x


class Block:
    """A block, with random access to any document's ids."""

    def __init__(self, data: memoryview, at: int = 0):
        magic, self.task, self.number, self.rows, self.nulls, self.n_ids, self.width, self.base = HEADER.unpack_from(data, at)
        if magic != MAGIC:
            raise ValueError("not a block of token ids")
        self._names, at = EliasFano.read(data, at + HEADER.size)
        self.ends, at = EliasFano.read(data, at)
        self.ids = np.frombuffer(data, f"<u{self.width}", self.n_ids, at)
        self.end = at + self.n_ids * self.width

    def names(self) -> list[int | None]:
        base = np.uint64(self.base % 2**64)
        return [None] * self.nulls + (self._names.all() + base).astype(np.int64).tolist()

    def bounds(self) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of all documents, each end by select."""
        ends = np.array([self.ends.select(i) for i in range(self.rows)], np.int64)
        return np.concatenate([[0], ends[:-1]]).astype(np.int64), ends

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.ends.select(i - 1) if i else 0 : self.ends.select(i)]

    @staticmethod
    def pack(task: int, number: int, names: list[int | None], ids: list[bytes], width: int) -> bytes:
        known = [x for x in names if x is not None]
        base = known[0] if known else 0
        ends = np.cumsum([len(x) // width for x in ids], dtype=np.uint64)
        shifted = np.array(known, np.int64).astype(np.uint64) - np.uint64(base % 2**64)
        head = HEADER.pack(MAGIC, task, number, len(names), len(names) - len(known), int(ends[-1]), width, base)
        return b"".join([head, EliasFano.of(shifted).to_bytes(), EliasFano.of(ends).to_bytes(), *ids])


class _Known(dict):
    """Answers already given, a bounded number of them."""

    def __init__(self, ask):
        super().__init__()
        self.ask = ask

    def __missing__(self, key: str) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
        got = self[key] = self.ask(key)
        return got


class Encoder:
    """Ids of whole texts, as a tokenizer file of the tokenizers library gives them.

    For the word-level layout below, a word's ids depend on the word alone, so the library's model is
    asked once for each distinct word and the rest is look-up. Whatever is outside plain Latin letters and ASCII,
    and every other layout, goes through the library's whole encoder.
    """

    #: fixed values: the normaliser and the splitting pattern of the layout that is looked up by word
    NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
    PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
    OTHER = re.compile("[^\t\n\r -~À-ÖØ-öø-ÿ]")
    WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\\sa-z0-9ß-öø-ÿ]+")

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}, {}]
        self.by_word = (spec.get("normalizer") or {}).get("normalizers") == self.NORMALIZER and steps[0].get("pattern") == {"Regex": self.PATTERN} and steps[0].get("invert") is True and steps[1].get("type") == "ByteLevel" and not steps[1].get("add_prefix_space") and spec.get("post_processor") is None
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.width = 2 if max(self.tokenizer.get_vocab_size(True) - 1, end_id) < 65536 else 4
        self.end = end_id.to_bytes(self.width, "little")
        self.words, self.chunks = _Known(self.word), _Known(self.whole)
        hidden = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b)]
        self.visible = {b: chr(256 + i) for i, b in enumerate(hidden)}

    def pack(self, ids: list[int]) -> bytes:
        return np.array(ids, f"<u{self.width}").tobytes()

    def whole(self, text: str) -> bytes:
        return self.pack(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def word(self, word: str) -> bytes:
        return self.pack([t.id for t in self.tokenizer.model.tokenize(word.encode().decode("latin-1").translate(self.visible))])

    def plain(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, self.WORDS.findall(text.lower())))

    def ids(self, text: str | None) -> bytes:
        text = text or ""
        if not self.by_word or any(x in text for x in self.special):
            return self.whole(text) + self.end
        if not self.OTHER.search(text):
            return self.plain(text) + self.end
        other = self.OTHER.search
        parts = [self.chunks[p] if other(p) else self.plain(p) for p in re.split("[\t\n\r ]+", text) if p]
        return b"".join(parts) + self.end


def encoder(path: str, end_id: int) -> Encoder:
    """One a Python worker, which serves many tasks."""
    mine = kept("token_ids")
    if (path, end_id) not in mine:
        mine[path, end_id] = Encoder(path, end_id)
    return mine[path, end_id]


def write(docs: DataFrame, tokenizer: str, end_id: int, folder: str, doc_id: str = "doc_id", text: str = "text", block_ids: int = BLOCK_IDS) -> None:
    """Write all documents' ids under ``folder``, in ascending order of document id.

    Texts are dealt out by range of (id, hash of the text), so that many rows of one id are split too.
    """
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), t.alias("text"), F.xxhash64(t).alias("tie"))
    rows = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, end_id)
        task, number, names, ids, n = TaskContext.get().partitionId(), 0, [], [], 0

        def block() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"value": pa.array([Block.pack(task, number, names, ids, enc.width)], pa.binary())})

        for batch in batches:
            for name, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                names.append(name)
                ids.append(enc.ids(x))
                n += len(ids[-1]) // enc.width
                if n >= block_ids:
                    yield block()
                    number, names, ids, n = number + 1, [], [], 0
        if names:
            yield block()

    blocks = rows.select("doc_id", "text").mapInArrow(run, "value binary")
    blocks.select(F.col("value").cast("string")).write.option("lineSep", "\n").option("maxRecordsPerFile", FILE_BLOCKS).text(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """One row a document: task and number of its block, its place and start in the block, n_tokens, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                data, at = memoryview(content.as_buffer()), 0
                while at < len(data):
                    b = Block(data, at)
                    at = b.end + 1
                    starts, ends = b.bounds()
                    wide = b.ids.astype("<u4")
                    crcs = [zlib.crc32(wide[s:e]) for s, e in zip(starts, ends, strict=True)]
                    yield pa.RecordBatch.from_pydict({"task": pa.array([b.task] * b.rows, pa.int64()), "number": pa.array([b.number] * b.rows, pa.int64()), "doc_id": pa.array(b.names(), pa.int64()), "at": pa.array(starts, pa.int64()), "n_tokens": pa.array(ends - starts, pa.int64()), "ids_crc32": pa.array(crcs, pa.int64())})

    files = spark.read.format("binaryFile").load(folder).where("length > 0").select("content")
    return files.mapInArrow(run, "task long, number long, doc_id long, at long, n_tokens long, ids_crc32 long")


def starts(documents: DataFrame) -> DataFrame:
    """Add ``start``: the ids of all documents before. Blocks are summed by writing task, so one task sees a row for each of those."""
    per_block = documents.groupBy("task", "number").agg(F.sum("n_tokens").alias("n"))
    per_task = per_block.groupBy("task").agg(F.sum("n").alias("n_task"))
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy("task").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    per_task = per_task.select("task", F.coalesce(F.sum("n_task").over(before), F.lit(0)).alias("of_task"))
    offsets = per_block.join(per_task, "task").select("task", "number", (F.col("of_task") + F.coalesce(F.sum("n").over(within), F.lit(0))).alias("of_block"))
    return documents.join(offsets, ["task", "number"]).withColumn("start", F.col("of_block") + F.col("at"))


def report(docs: DataFrame, tokenizer: str, end_id: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the files into the shared folder, read them back, and describe each document by what they hold."""
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/token-ids-{uuid.uuid4().hex}"
    write(docs, tokenizer, end_id, folder, doc_id, text)
    found = checkpoint(read(spark, folder))
    return starts(found).select("doc_id", "start", "n_tokens", "ids_crc32")


