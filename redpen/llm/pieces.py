"""SentencePiece encoding and decoding with exact N-best segmentations.

A text is a lattice: its characters are the places, and every vocabulary piece that matches between
two places is an arc with the piece's log probability. Forward Viterbi scores are the best
score from the start to each place. Backward A-star walks from the end; a partial path is worth what it
has gathered plus the forward score of the place it has reached, which is exact, so complete paths
leave the queue in order of score.

No piece holds a space after another character, so the lattice is a chain of lattices of
space-led chunks. Each distinct chunk is scored once while it is known: the forward pass gives its
best path and the gap to its second best. The N best segmentations of a text can differ from the best one only
in its N - 1 chunks of smallest gap, so A-star runs on those and their lists are merged.

Scores: the scores of a unigram model file, or, for a file of merges whose scores are
ranks, probabilities by Zipf's law over the ranks. They are whole numbers of millionths, so sums and
ties are exact; equal scores are ordered by the ids.

A character without a piece becomes its UTF-8 bytes' pieces. U+2581 in a text is such a character, so decoding
restores every text. Null texts give null ids; empty ones none. Chunks of any length take time and memory in proportion to it. Repeated rows
are encoded each; an empty table gives no rows. A caller's other columns may have any names.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from redpen.llm.common import ROW, kept, slices

N_BEST = 4
CACHE_CHUNKS = 600_000
#: Texts that are worked on at once in a worker.
AT_ONCE, BYTES_AT_ONCE = 1200, 4_000_000
UNIT = 1_000_000
#: Successors that the automaton notes beyond its own.
EXTRA_STEPS = 300_000
NONE = -(2**62)
#: Gap of a chunk that has one segmentation only.
NO_SECOND = 2**62
_CHUNK = re.compile(" *[^ ]+| +")
_BYTE = re.compile("<0x([0-9A-F]{2})>")
N_BEST_TYPE = pa.list_(pa.struct([("score", pa.float64()), ("changes", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("ids", pa.list_(pa.int32()))])))]))
SCHEMA = "ids array<int>, restored boolean, score double, n_best array<struct<score: double, changes: array<struct<start: int, end: int, ids: array<int>>>>>"


class Vocabulary:
    def __init__(self, path: str, scores: str = "zipf"):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.byte_ids, self.text, normal = [0] * 256, [b""] * n, []
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(_BYTE.fullmatch(piece)[1], 16)
                self.byte_ids[value], self.text[i] = i, bytes([value])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                piece = piece.replace("▁", " ")
                self.text[i] = piece.encode()
                normal.append((i, piece))
        if scores == "zipf":
            whole = sum(1 / (r + 1) for r in range(len(normal)))
            score = [-np.log((r + 1) * whole) for r in range(len(normal))]
        else:
            score = [model.get_score(i) for i, _ in normal]
        self.pieces = {p: (i, round(float(s) * UNIT)) for (i, p), s in zip(normal, score, strict=True)}
        self.byte_score = min(s for _, s in self.pieces.values()) - UNIT
        self.longest = max(len(p) for p in self.pieces)
        self.single = frozenset(p for p in self.pieces if len(p) == 1)
        self.automaton()

        self.joined = np.frombuffer(b"".join(self.text), np.uint8)
        self.sizes = np.array([len(t) for t in self.text], np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes

    def decode(self, lists: pa.ListArray) -> list[str | None]:
        """The texts of lists of ids; null for null, U+FFFD for bytes that are no UTF-8. Ids outside the vocabulary, and null ones, stand for nothing."""
        ids = lists.flatten().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        ids[(ids < 0) | (ids >= len(self.text))] = 0
        sizes = self.sizes[ids]
        to = np.cumsum(sizes)
        data = self.joined[np.arange(int(to[-1]) if len(to) else 0) + np.repeat(self.begins[ids] - (to - sizes), sizes)].tobytes()
        out: list[str | None] = []
        at = done = 0
        for n in pc.list_value_length(lists).to_pylist():
            if n is None:
                out.append(None)
                continue
            at += n
            end = int(to[at - 1]) if at else 0
            out.append(data[done:end].decode("utf-8", "replace").removeprefix(" "))
            done = end
        return out

    def arcs(self, chunk: str, end: int) -> Iterator[tuple[int, int, tuple[int, ...]]]:
        """(start, score, ids) of the arcs that end at ``end``, longest first."""
        for start in range(max(0, end - self.longest), end):
            if (found := self.pieces.get(chunk[start:end])) is not None:
                yield start, found[1], (found[0],)
            elif start == end - 1:
                data = chunk[start:end].encode()
                yield start, len(data) * self.byte_score, tuple(self.byte_ids[b] for b in data)

    def forward(self, chunk: str) -> list[int]:
        best = [0] + [NONE] * len(chunk)
        for end in range(1, len(chunk) + 1):
            best[end] = max(best[start] + s for start, s, _ in self.arcs(chunk, end))
        return best

    def one(self, chunk: str) -> tuple[list[int], int, int]:
        """(ids of the best path, its score, gap to the second best) of one chunk. Of equal paths to a place the one with the longest last piece is taken."""
        n = len(chunk)
        best, second, via = [0] + [NONE] * n, [NONE] * (n + 1), [(0, ())] * (n + 1)
        for end in range(1, n + 1):
            for start, s, ids in self.arcs(chunk, end):
                x = best[start] + s
                if x > best[end]:
                    second[end] = max(best[end], second[start] + s)
                    best[end], via[end] = x, (start, ids)
                else:
                    second[end] = max(second[end], x)
        out: list[int] = []
        at = n
        while at:
            at, ids = via[at]
            out += reversed(ids)
        return out[::-1], best[n], best[n] - second[n] if second[n] > NONE // 2 else NO_SECOND

    def automaton(self) -> None:
        """Aho-Corasick over the pieces: ``after`` has each state's successors, ``found`` the (length, score, id) of the pieces that end there, longest first."""
        self.after: list[dict[str, int]] = [{}]
        self.found: list[tuple] = [()]
        for piece, (i, score) in self.pieces.items():
            state = 0
            for c in piece:
                if (state_ := self.after[state].get(c)) is None:
                    state_ = self.after[state][c] = len(self.after)
                    self.after.append({})
                    self.found.append(())
                state = state_
            self.found[state] = ((len(piece), score, i),)
        self.fail, self.extra = [0] * len(self.after), 0
        level = list(self.after[0].values())
        while level:
            deeper = []
            for state in level:
                for c, child in self.after[state].items():
                    back = self.fail[state]
                    while back and c not in self.after[back]:
                        back = self.fail[back]
                    self.fail[child] = self.after[back].get(c, 0)
                    self.found[child] += self.found[self.fail[child]]
                    deeper.append(child)
            level = deeper

    def step(self, state: int, c: str) -> int:
        """The state after a character without a successor of its own; a bounded number of them are noted for the next time."""
        back = state
        while back and c not in self.after[back]:
            back = self.fail[back]
        to = self.after[back].get(c, 0)
        if to and self.extra < EXTRA_STEPS:
            self.after[state][c] = to
            self.extra += 1
        return to

    def together(self, chunks: list[str]) -> list[tuple[list[int], int, int]]:
        """As ``one``, for many chunks: in their order, each goes on from where it parts from the one before."""
        after, found, single, step = self.after, self.found, self.single, self.step
        best, second, size_of, piece_at, states = [0], [NONE], [0], [0], [0]
        out: dict[str, tuple[list[int], int, int]] = {}
        last = ""
        for chunk in sorted(set(chunks)):
            k = 0
            for a, b in zip(last, chunk, strict=False):
                if a != b:
                    break
                k += 1
            last = chunk
            del best[k + 1 :], second[k + 1 :], size_of[k + 1 :], piece_at[k + 1 :], states[k + 1 :]
            state = states[k]
            for c in chunk[k:]:
                state = after[state].get(c) or step(state, c)
                top = next_ = NONE
                by = piece = 0
                for size, score, i in found[state]:
                    x = best[-size] + score
                    if x > top:
                        next_ = second[-size] + score
                        if top > next_:
                            next_ = top
                        top, by, piece = x, size, i
                    elif x > next_:
                        next_ = x
                if c not in single:  # its bytes
                    lone = len(c.encode()) * self.byte_score
                    x, y = best[-1] + lone, second[-1] + lone
                    if x > top:
                        top, next_, by, piece = x, max(top, y), 1, -1
                    else:
                        next_ = max(next_, x)
                best.append(top)
                second.append(next_)
                size_of.append(by)
                piece_at.append(piece)
                states.append(state)
            at, ids = len(chunk), []
            while at:
                if (i := piece_at[at]) >= 0:
                    ids.append(i)
                else:
                    ids += [self.byte_ids[b] for b in reversed(chunk[at - 1].encode())]
                at -= size_of[at]
            ids.reverse()
            out[chunk] = (ids, best[-1], best[-1] - second[-1] if second[-1] > NONE // 2 else NO_SECOND)
        return list(map(out.__getitem__, chunks))

    def n_best(self, chunk: str, n: int) -> list[tuple[int, tuple[int, ...]]]:
        """The ``n`` best (score, ids) of a chunk in order of score and then ids, by backward A-star.

        Among paths of equal worth the one nearest to the end goes first, so when a place comes up all paths to it of that
        worth are in the queue, and they leave it in order of their ids. Only the first n from a place can be among the n best of all. Two
        paths from a place differ in the first piece, or in the rank of the same rest, so no path is written out before the end.
        """
        ahead = self.forward(chunk)
        # minus worth, minus place, first piece, where it ends, rank of the rest there, gathered score
        queue: list = [(-ahead[-1], -len(chunk), (), 0, 0, 0)]
        left: dict[int, list] = {}
        out: list = []
        while queue and len(out) < n:
            _, at, piece, to, rank, got = heapq.heappop(queue)
            at = -at
            ranked = left.setdefault(at, [])
            if len(ranked) == n:
                continue
            ranked.append((piece, to, rank))
            if at:
                for start, s, first in self.arcs(chunk, at):
                    heapq.heappush(queue, (-(got + s + ahead[start]), -start, first, at, len(ranked) - 1, got + s))
                continue
            ids: list[int] = []
            while piece:
                ids += piece
                piece, to, rank = left[to][rank]
            out.append((got, tuple(ids)))
        return out


class Segmenter:
    """Whole texts. What is known of a chunk is its place in flat arrays: where its ids begin, how many, its score and its gap."""

    def __init__(self, vocabulary: Vocabulary, n: int):
        self.v, self.n = vocabulary, n
        self.lists: dict[str, list] = {}
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.begins, self.scores, self.gaps = array("i"), array("q", [0]), array("q"), array("q")

    def learn(self, chunks: set[str]) -> None:
        if len(self.known) > CACHE_CHUNKS:
            self.forget()
        new = list(chunks.difference(self.known))
        for c, (ids, score, gap) in zip(new, self.v.together(new), strict=True):
            self.known[c] = len(self.scores)
            self.ids.extend(ids)
            self.begins.append(len(self.ids))
            self.scores.append(score)
            self.gaps.append(gap)

    def best_of(self, chunk: str) -> list[tuple[int, tuple[int, ...]]]:
        if chunk not in self.lists:
            if len(self.lists) > CACHE_CHUNKS // 20:
                self.lists.clear()
            self.lists[chunk] = self.v.n_best(chunk, self.n)
        return self.lists[chunk]

    def n_best(self, chunks: list[str], score: int, gaps: np.ndarray, scores: np.ndarray, begins: np.ndarray, places: np.ndarray) -> list[dict]:
        """The n best segmentations of a text, as changes to the best one. Of equal gaps the first ones count."""
        near = np.sort(np.argsort(gaps, kind="stable")[: self.n - 1]) if len(gaps) <= 64 else self.smallest(gaps)
        paths: list[tuple[int, tuple]] = [(score, ())]
        kept = [int(i) for i in near if gaps[i] < NO_SECOND]
        size = {i: int(begins[places[i] + 1] - begins[places[i]]) for i in kept}
        for i in kept:
            at = int(begins[places[i]])
            best = tuple(self.ids[at : at + size[i]])
            choices = [(got - int(scores[i]), None if ids == best else (i, ids)) for got, ids in self.best_of(chunks[i])]
            merged = [(s + lost, path if c is None else (*path, c)) for s, path in paths for lost, c in choices]
            paths = sorted(merged, key=lambda x: (-x[0], x[1]))[: self.n]
        lengths = begins[places + 1] - begins[places] if kept else None
        start = {i: int(lengths[:i].sum()) for i in kept}
        return [{"score": s / UNIT, "changes": [{"start": start[i], "end": start[i] + size[i], "ids": list(ids)} for i, ids in path]} for s, path in paths]

    def smallest(self, gaps: np.ndarray) -> np.ndarray:
        """Places of the n - 1 smallest, the first ones among equals, in order of place."""
        if self.n < 2:
            return np.zeros(0, np.int64)
        last = np.partition(gaps, self.n - 2)[self.n - 2]
        under, equal = np.flatnonzero(gaps < last), np.flatnonzero(gaps == last)
        return np.sort(np.concatenate([under, equal[: self.n - 1 - len(under)]]))

    def texts(self, texts: list[str | None]) -> pa.StructArray:
        cut = [_CHUNK.findall(" " + t) if t else [] for t in texts]
        self.learn({c for x in cut for c in x})
        places = np.fromiter(map(self.known.__getitem__, chain.from_iterable(cut)), np.int64)
        begins, gaps, scores = np.array(self.begins), np.array(self.gaps)[places], np.array(self.scores)[places]
        sizes = begins[places + 1] - begins[places]
        to = np.cumsum(sizes)
        flat = np.frombuffer(self.ids, "<i4") if len(self.ids) else np.zeros(0, "<i4")
        values = pa.array(flat[np.arange(int(to[-1]) if len(to) else 0) + np.repeat(begins[places] - (to - sizes), sizes)], pa.int32())
        del flat  # else the array can't grow
        ends, n_best, totals, at = [0], [], [], 0
        for t, chunks in zip(texts, cut, strict=True):
            here = slice(at, at + len(chunks))
            at += len(chunks)
            ends.append(int(to[at - 1]) if at else 0)
            score = int(scores[here].sum())
            totals.append(None if t is None else score / UNIT)
            n_best.append(None if t is None else self.n_best(chunks, score, gaps[here], scores[here], begins, places[here]))
        missing = pa.array([t is None for t in texts])
        ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values, mask=missing)
        back = [None if t is None else t == d for t, d in zip(texts, self.v.decode(ids), strict=True)]
        columns = {"ids": ids, "restored": pa.array(back, pa.bool_()), "score": pa.array(totals, pa.float64()), "n_best": pa.array(n_best, N_BEST_TYPE)}
        return pa.StructArray.from_arrays(list(columns.values()), fields=[pa.field(k, v.type) for k, v in columns.items()])


def segmenter(path: str, n: int, scores: str) -> Segmenter:
    """One a Python worker, which serves many tasks."""
    mine, key = kept("pieces"), (path, n, scores)
    if key not in mine:
        mine[key] = Segmenter(Vocabulary(path, scores), n)
    return mine[key]


def encode(docs: DataFrame, model: str, n: int = N_BEST, scores: str = "zipf", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``row`` and ``out``: the best ids, whether they decode to the text, their log probability, and the ``n`` best segmentations as changes to the best one."""

    names = docs.columns if keep is None else keep
    carried = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias(ROW), F.col(f"`{text}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = segmenter(model, n, scores)
        for batch in batches:
            for part in slices(batch, 1, AT_ONCE, BYTES_AT_ONCE):
                yield pa.RecordBatch.from_arrays([part.column(0), work.texts(part.column(1).to_pylist())], names=[ROW, "out"])

    return carried.mapInArrow(run, T.StructType([carried.schema[ROW], T.StructField("out", T._parse_datatype_string(SCHEMA))]))


def decode(df: DataFrame, model: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the text that an array of ids stands for; null for null, and U+FFFD for bytes that are no UTF-8."""
    schema = T.StructType([T.StructField(ROW, df.select(F.struct("*").alias(ROW)).schema[ROW].dataType), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = segmenter(model, N_BEST, "zipf").v
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(at, AT_ONCE)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(v.decode(part.column(1)), pa.string())], names=[ROW, "text"])

    done = df.select(F.struct("*").alias(ROW), F.col(ids).alias("ids")).mapInArrow(run, schema)
    return done.select(f"{ROW}.*", F.col("text").alias(out))


def report(docs: DataFrame, model: str, n: int = N_BEST, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: ids, their number and log probability, the scores of the n best segmentations, and whether decoding restores the text."""
    found = encode(docs, model, n, text=text, keep=[doc_id]).select(F.col(f"{ROW}.`{doc_id}`").alias("doc_id"), "out.*")
    return found.select("doc_id", "ids", F.size("ids").cast("long").alias("n_pieces"), "score", F.transform("n_best", lambda b: b["score"]).alias("n_best_scores"), "n_best", "restored")
