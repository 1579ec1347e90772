"""Secret scan: Aho-Corasick prefilter, anchored patterns at its hits, checksums inside the match.

Base kinds keep every match of their pattern that passes the length rule, leftmost and
non-overlapping within a kind. Further kinds have a structure that can be checked: a CRC-32 in the
last six base-62 digits (GitHub and npm tokens), a decodable header (JSON web tokens), or the
armour of a private key. Spans are in code points, end exclusive.

A null text is an empty one. Empty texts have no spans. Equal rows get equal spans; an empty table gives no rows. Very long texts, and matches as long as they, are
scanned whole in time in proportion to them. A caller's other columns may have any names.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Callable
from dataclasses import dataclass
from itertools import chain

import ahocorasick
from pyspark.sql import DataFrame, functions as F

from redpen.llm.common import ROW, per_text

_CONT = bytes(range(0x80, 0xC0))
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_HEX = bytes(104 if c in b"0123456789abcdef" else 46 for c in range(256))
_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def crc_ok(match: re.Match) -> bool:
    """The last six characters are the CRC-32 of the thirty before them, in base 62."""
    body, said = match[1][:30], match[1][30:].decode()
    n, digits = binascii.crc32(body), ""
    for _ in range(6):
        n, d = divmod(n, 62)
        digits = _BASE62[d] + digits
    return digits == said


def header_ok(match: re.Match) -> bool:
    try:
        head = match[1]
        return "alg" in json.loads(base64.urlsafe_b64decode(head + b"=" * (-len(head) % 4)))
    except (ValueError, TypeError):
        return False


@dataclass(frozen=True)
class Kind:
    """keywords: what the prefilter looks for in the lower-cased text, and how far before a keyword a match may start (0)."""

    name: str
    keywords: tuple[str, ...]
    pattern: re.Pattern
    valid: Callable[[re.Match], bool]


BASE = (
    Kind("assign", ("password", "passwd", "secret", "token", "apikey", "api_key"), re.compile(rb"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 12),
    Kind("access", ("akia",), re.compile(rb"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18),
    Kind("hex", ("h" * 16,), re.compile(rb"[0-9a-f]+"), lambda m: len(m[0]) >= 16),
)
MORE = (
    Kind("github", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), re.compile(rb"gh[pousr]_([A-Za-z0-9]{36})(?![A-Za-z0-9])"), crc_ok),
    Kind("npm", ("npm_",), re.compile(rb"npm_([A-Za-z0-9]{36})(?![A-Za-z0-9])"), crc_ok),
    Kind("jwt", ("eyj",), re.compile(rb"(eyJ[A-Za-z0-9_-]{8,})\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"), header_ok),
    Kind("private_key", ("-----begin",), re.compile(rb"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"), lambda m: True),
)
KINDS = BASE + MORE
SCHEMA = "array<struct<kind: string, start: long, end: long, base: boolean>>"


class Scanner:
    def __init__(self) -> None:
        self.text, self.hexes = ahocorasick.Automaton(), ahocorasick.Automaton()
        for rank, kind in enumerate(KINDS):
            for word in kind.keywords:
                (self.hexes if kind.name == "hex" else self.text).add_word(word, (rank, len(word)))
        self.text.make_automaton()
        self.hexes.make_automaton()

    def matches(self, text: bytes) -> list[tuple[int, int, int]]:
        """(start, rank of the kind, end) in bytes."""
        out, upto = [], [0] * len(KINDS)
        # no keyword of a kind ends inside another, so hits come in the order of their starts too, and none has to be kept
        for end, (rank, n) in chain(self.text.iter(text.translate(_LOWER).decode("latin-1")), self.hexes.iter(text.translate(_HEX).decode("latin-1"))):
            start = end + 1 - n
            if start < upto[rank]:
                continue
            if m := KINDS[rank].pattern.match(text, start):
                upto[rank] = m.end()
                if KINDS[rank].valid(m):
                    out.append((start, rank, m.end()))
        return sorted(out)

    def spans(self, text: bytes | None) -> list[dict]:
        if not text or not (found := self.matches(text)):
            return []
        place, at, points = {}, 0, 0
        for x in sorted({y for start, _, end in found for y in (start, end)}):
            piece = text[at:x]
            points += len(piece.translate(None, _CONT))
            place[x], at = points, x
        return [{"kind": KINDS[r].name, "start": place[a], "end": place[b], "base": r < len(BASE)} for a, r, b in found]


def find(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``row`` and ``out.spans``: the secrets of each whole text, by start and then kind."""

    def make():
        scanner = Scanner()
        return lambda texts: [{"spans": scanner.spans(t)} for t in texts]

    return per_text(docs, text, f"spans {SCHEMA}", make, keep)


def joined(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def report(docs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """One row a document: counts of the base kinds, a digest of their spans, and all spans."""
    spans = F.col("out.spans")
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
    return find(docs, keep=[doc_id]).select(
        F.col(f"{ROW}.`{doc_id}`").alias("doc_id"), *[count(k.name).alias(f"n_{k.name}") for k in BASE],
        F.sha2(joined(F.filter(spans, lambda s: s["base"])), 256).alias("base_sha256"), joined(spans).alias("spans"),
    )
