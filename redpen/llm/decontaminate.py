"""Benchmark decontamination by Wu-Manber search over words.

A pattern is a window of consecutive words of a benchmark item. Patterns of one length form one
searcher. Its symbols are words: a block of the last few words of the current window looks up how
far the search may shift; a shift of nothing leads to the bucket of patterns with that suffix, which
is narrowed by the first words and ends in a direct comparison of all words.

Null and empty texts have no words and no hits. Repeated documents each get a row. Items without
words match nothing. Item ids are compared as strings. An item with a null id is searched like any other, and
its hits count; only the list of items has no name for it. Rows of one item id are one item. Very long documents and items are searched whole; an empty
benchmark hits nothing. A caller's other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F

from redpen.llm.common import ROW, checkpoint, per_text

WINDOW = 10
#: Text bytes of one block of benchmark items, for which tables are built at once in a Python worker.
BLOCK_BYTES = 2_000_000
#: Text bytes that are broadcast at once. A larger benchmark takes several passes over the documents.
BROADCAST_BYTES = 32_000_000
#: Document bytes that are searched with one block's tables before those of the next block are built.
CHUNK_BYTES = 48_000_000

_WORD_BYTES = bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
_FOLD = bytes(c if c in _WORD_BYTES else c + 32 if 0x41 <= c <= 0x5A else 32 for c in range(256))


def words(text: bytes | None) -> list[bytes]:
    """Lower-cased (A-Z) runs of digits, a-z and any code points from U+0080 on."""
    return text.translate(_FOLD).split() if text else []


class WuManber:
    """Patterns of one length ``m`` over a sequence of words."""

    def __init__(self, patterns: dict[tuple, int], m: int):
        self.m = m
        self.block = b = 3 if m >= 6 else min(2, m)
        self.far = m - b + 1
        self.shift: dict = {}
        self.bucket: dict = {}
        for pattern, number in patterns.items():
            for end in range(b, m + 1):
                key, step = pattern[end - b : end], m - end
                if step < self.shift.get(key, self.far):
                    self.shift[key] = step
            self.bucket.setdefault(pattern[m - b :], {}).setdefault(pattern[:b], {})[pattern] = number

    def find(self, text: list[bytes]) -> Iterator[tuple[int, int]]:
        """(start, pattern number) of every occurrence, from left to right."""
        m, b, far, shift = self.m, self.block, self.far, self.shift.get
        end, n = m, len(text)
        while end <= n:
            key = tuple(text[end - b : end])
            step = shift(key, far)
            if step:
                end += step
                continue
            start = end - m
            near = self.bucket[key].get(tuple(text[start : start + b]))
            if near is not None:
                number = near.get(tuple(text[start:end]))
                if number is not None:
                    yield start, number
            end += 1


class Searcher:
    """All windows of a block of items."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int):
        by_length: dict[int, dict[tuple, int]] = {}
        self.items: list[set[str]] = []
        seen: dict[tuple, int] = {}
        for item, text in items:
            w = words(text)
            m = min(window, len(w))
            for i in range(len(w) - m + 1 if m else 0):
                pattern = tuple(w[i : i + m])
                number = seen.setdefault(pattern, len(self.items))
                if number == len(self.items):
                    self.items.append(set())
                    by_length.setdefault(m, {})[pattern] = number
                if item is not None:
                    self.items[number].add(item)
        self.by_length = [WuManber(p, m) for m, p in sorted(by_length.items())]

    def search(self, text: list[bytes], spans: list, items: set) -> None:
        found = set()
        for one in self.by_length:
            for start, number in one.find(text):
                spans.append((start, start + one.m))
                found.add(number)
        for number in found:
            items |= self.items[number]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [tuple(x) for x in out]


def blocks(benchmark: DataFrame, item_id: str, text: str, size: int) -> Iterator[list[tuple[str | None, bytes]]]:
    """Items in blocks of about ``size`` bytes of text, streamed through the driver."""
    block, n = [], 0
    for item, words_ in benchmark.select(F.col(f"`{item_id}`").cast("string"), F.col(f"`{text}`").cast("string").cast("binary")).toLocalIterator():
        block.append((item, bytes(words_ or b"")))
        n += len(words_ or b"")
        if n >= size:
            yield block
            block, n = [], 0
    if block:
        yield block


def find(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, keep: list[str] | None = None, block_bytes: int = BLOCK_BYTES, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``row`` (the document's columns, or ``keep``) and ``out``: n_words, spans of hit words (merged, end exclusive), items (sorted as strings)."""
    sc = docs.sparkSession.sparkContext
    schema = "n_words long, spans array<struct<start: int, end: int>>, items array<string>"
    names = docs.columns if keep is None else keep
    result: DataFrame | None = None
    group, n = [], 0

    def scan(df: DataFrame, searched, again: bool) -> DataFrame:
        def make():
            tables: dict[int, Searcher] = {}

            def table(i: int) -> Searcher:
                if i not in tables:
                    tables.clear()
                    tables[i] = Searcher(searched.value[i], window)
                return tables[i]

            def work(texts: list) -> list:
                out, at = [], 0
                while at < len(texts):
                    size, chunk = 0, []
                    while at < len(texts) and (not chunk or size < CHUNK_BYTES):
                        chunk.append((words(texts[at]), [], set()))
                        size += len(texts[at] or b"")
                        at += 1
                    for i in range(len(searched.value)):
                        one = table(i)
                        for w, spans, items in chunk:
                            one.search(w, spans, items)
                    out += [{"n_words": len(w), "spans": [{"start": a, "end": b} for a, b in merged(spans)], "items": sorted(items)} for w, spans, items in chunk]
                return out

            return work

        return per_text(df, text, schema, make, names)

    def add(result: DataFrame | None, group: list) -> DataFrame:
        searched = sc.broadcast(group)
        if result is None:
            return scan(docs, searched, False)
        # a benchmark beyond the broadcast bound: the rows found so far are written, and searched again for the next group
        done = checkpoint(result.select(F.struct(F.col(f"{ROW}.*"), F.col("out").alias("__found")).alias("__carried"), F.col(f"{ROW}.`{text}`").alias("__text")))
        again = per_text_carried(done, searched)
        return again

    def per_text_carried(done: DataFrame, searched) -> DataFrame:
        found = scan_named(done, searched)
        prior = F.col(f"{ROW}.__carried.__found")
        return found.select(
            F.struct(*[F.col(f"{ROW}.__carried.`{c}`").alias(c) for c in carried_names]).alias(ROW),
            F.struct(F.col("out.n_words").alias("n_words"), F.concat(prior["spans"], F.col("out.spans")).alias("spans"), F.array_sort(F.array_union(prior["items"], F.col("out.items"))).alias("items")).alias("out"),
        )

    def scan_named(done: DataFrame, searched) -> DataFrame:
        nonlocal text, names
        kept, text, names = (text, names), "__text", ["__carried"]
        try:
            return scan(done, searched, True)
        finally:
            text, names = kept

    for block in blocks(benchmark, item_id, item_text, block_bytes):
        size = sum(len(t) for _, t in block)
        if group and n + size > broadcast_bytes:
            if result is None and text not in names:
                names = [*names, text]
            carried_names = names
            result = add(result, group)
            group, n = [], 0
        group.append(block)
        n += size
    carried_names = names
    result = add(result, group)
    return result


def n_hit(spans: str = "out.spans"):
    """Number of hit words; spans found in several passes may overlap, so they are merged here."""
    merged_spans = F.aggregate(
        F.array_sort(F.col(spans)),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("upto")),
        lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], a["upto"]))).alias("n"), F.greatest(a["upto"], s["end"]).alias("upto")),
    )
    return merged_spans["n"]


def report(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """One row a document: words, hit words, the items with occurring windows and their digest."""
    found = find(docs, benchmark, keep=[doc_id])
    return found.select(
        F.col(f"{ROW}.`{doc_id}`").alias("doc_id"), F.col("out.n_words").alias("n_words"), n_hit().alias("n_hit"), F.size("out.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("out.items", ","), 256).alias("items_sha256"), (F.size("out.spans") > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The documents without any hit word, with all their columns."""
    return find(docs, benchmark, text).where(F.size("out.spans") == 0).select(f"{ROW}.*")
