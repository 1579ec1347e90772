"""Quality rules by weak supervision.

Each rule votes good (1) or bad (0) or abstains (-). Expectation-maximisation over the counts of
vote patterns, which are at most 3 to the number of rules whatever the input, estimates how often
each rule votes what on good and on bad documents, and how common good ones are. A document's
posterior probability of being good decides; no rule has a veto but the two base rules. Documents that fail those
teach the model nothing. The priors weigh as much as three documents, so what the corpus says of a rule counts.

A null text has no words, so it fails the base rules, as an empty one does. Very long texts are measured whole. Repeated rows get equal verdicts, and ties
(a posterior of exactly one half) are kept. With no rows there is nothing to fit, and the priors stand. A caller's other columns may have any names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from redpen.llm.common import ROW, checkpoint, per_text

SYMBOLS = b"#*$%&|<>"
MIN_WORDS, MAX_REPEATED, THRESHOLD = 10, 20, 0.5
#: Weight of the priors, in documents.
PSEUDO = 3.0
_CONT = bytes(range(0x80, 0xC0))
_SPACE = bytes([0x20, *range(0x09, 0x0E)])
_LEAD = bytes(range(0xC0, 0x100))  # code points from U+0080 on, taken as letters
_MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_UPPER, _LOWER, _DIGIT = bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58))

#: name, measured share, bad from here on, good up to here; between the two the rule abstains.
RULES = (
    ("symbols", "symbols a word", 0.10, 0.03),
    ("repeats", "words in repeated 5-word windows", 0.10, 0.02),
    ("short", "10 / words", 0.5001, 0.25),
    ("duplicate_lines", "lines equal to an earlier one", 0.50, 0.25),
    ("shouting", "capitals among letters A-Z a-z", 0.30, 0.12),
    ("exclamations", "exclamation marks a word", 0.20, 0.05),
    ("stutter", "words equal to the one before", 0.20, 0.05),
    ("digits", "digits among characters", 0.40, 0.20),
    ("long_words", "mean characters a word / 12", 1.20, 0.85),
    ("few_letters", "characters that are no letters", 0.33, 0.20),
    ("doubled_marks", "doubled marks a word", 0.20, 0.05),
    ("bare_marks", "words of nothing but marks", 0.15, 0.03),
)
_DOUBLED = (b"!!", b"##", b"**", b"%%", b"$$", b"&&", b"||", b"??")
FEATURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, votes string"


def features(text: bytes | None) -> dict:
    text = text or b""
    w = text.split()
    n = len(w)
    lines = [x for x in text.split(b"\n") if x.strip()]
    drop = lambda these: len(text) - len(text.translate(None, these))
    chars = len(text) - drop(_CONT + _SPACE)
    symbols, upper, lower, high = drop(SYMBOLS), drop(_UPPER), drop(_LOWER), drop(_LEAD)
    dup, repeated = len(lines) - len(set(lines)), repeat_words(w)
    d = max(n, 1)
    shares = (symbols / d, repeated / d, 10 / d if n else math.inf, dup / max(len(lines), 1), upper / max(upper + lower, 1), text.count(b"!") / d, sum(map(bytes.__eq__, w, w[1:])) / d, drop(_DIGIT) / max(chars, 1), chars / d / 12, 1 - (upper + lower + high) / max(chars, 1), sum(map(text.count, _DOUBLED)) / d, (n - len(text.translate(None, _MARKS).split())) / d)
    votes = "".join("0" if x >= rule[2] else "1" if x <= rule[3] else "-" for x, rule in zip(shares, RULES, strict=True))
    return {"n_words": n, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup, "n_repeat_words": repeated, "votes": votes}


def repeat_words(w: list[bytes], k: int = 5) -> int:
    """Words that lie in a window of ``k`` words found twice or more, the first one included."""
    windows = list(zip(*(w[i:] for i in range(k)), strict=False))
    if len(set(windows)) == len(windows):
        return 0
    seen: dict[tuple, int] = {}
    for x in windows:
        seen[x] = seen.get(x, 0) + 1
    covered = upto = 0
    for i, x in enumerate(windows):
        if seen[x] > 1:
            covered += i + k - max(i, upto)
            upto = i + k
    return covered


@dataclass
class VoteModel:
    """log odds of good: ``prior`` and, for each rule, what a bad and a good vote add."""

    prior: float
    weights: list[tuple[float, float]] = field(default_factory=list)
    accuracies: list[tuple[float, float]] = field(default_factory=list)

    def posterior(self, votes):
        """Column of the probability that a document with these votes is good."""
        odds = F.lit(self.prior)
        for i, (bad, good) in enumerate(self.weights):
            v = F.substring(votes, i + 1, 1)
            odds = odds + F.when(v == "0", bad).when(v == "1", good).otherwise(0.0)
        return 1 / (1 + F.exp(-odds))


def fit(patterns: list[tuple[str, int]], rules: int = len(RULES), rounds: int = 200, pseudo: float = PSEUDO) -> VoteModel:
    """EM over vote patterns and their counts. At the start each bad vote halves the odds that a document is good.

    A priori nine in ten documents are good, and a rule is right on nine in ten good and three in ten bad documents; this weighs as much as ``pseudo`` documents.
    """
    q = {p: 0.9 * 0.5 ** p.count("0") for p, _ in patterns}
    prior, weights, accuracy = 0.9, [], []
    for _ in range(rounds):
        good = sum(n * q[p] for p, n in patterns)
        bad = sum(n * (1 - q[p]) for p, n in patterns)
        prior = (good + 0.9 * pseudo) / (good + bad + pseudo)
        weights, accuracy = [], []
        for i in range(rules):
            votes = {(v, y): sum(n * (q[p] if y else 1 - q[p]) for p, n in patterns if p[i] == v) for v in "01" for y in (0, 1)}
            on_good = (votes["1", 1] + 0.9 * pseudo) / (votes["0", 1] + votes["1", 1] + pseudo)
            on_bad = (votes["0", 0] + 0.3 * pseudo) / (votes["0", 0] + votes["1", 0] + pseudo)
            weights.append((math.log((1 - on_good) / on_bad), math.log(on_good / (1 - on_bad))))
            accuracy.append((on_good, on_bad))
        odds0 = math.log(prior / (1 - prior))
        new = {}
        for p, _n in patterns:
            odds = odds0 + sum(w[int(v)] for v, w in zip(p, weights, strict=True) if v != "-")
            new[p] = 1 / (1 + math.exp(-max(-500, min(500, odds))))
        done = max((abs(new[p] - q[p]) for p in q), default=0) < 1e-9
        q = new
        if done:
            break
    return VoteModel(math.log(prior / (1 - prior)), weights, accuracy)


def measure(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``row`` and ``out``: the base figures and the rules' votes over each whole text."""

    def make():
        return lambda texts: [features(t) for t in texts]

    return per_text(docs, text, FEATURES, make, keep)


def fit_votes(measured: DataFrame) -> VoteModel:
    """At most 3 ** 12 pattern counts, over all rows that pass the base rules, come to the driver."""
    counts = measured.where(~base_failed()).groupBy(F.col("out.votes").alias("votes")).count().collect()
    return fit(sorted((r["votes"], r["count"]) for r in counts))


def base_failed():
    return (F.col("out.n_words") < MIN_WORDS) | (100 * F.col("out.n_repeat_words") > MAX_REPEATED * F.col("out.n_words"))


def report(docs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """One row a document: base figures, votes, posterior and verdict."""
    measured = checkpoint(measure(docs, keep=[doc_id]))
    good = fit_votes(measured).posterior(F.col("out.votes"))
    return measured.select(
        F.col(f"{ROW}.`{doc_id}`").alias("doc_id"), *[F.col(f"out.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        base_failed().alias("base_failed"), (~base_failed() & (good >= THRESHOLD)).alias("kept"), F.col("out.votes").alias("votes"), F.round(good, 6).alias("p_good"),
    )


def clean(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents that are kept, with all their columns. Two passes over the input; only vote counts are gathered between them."""
    good = fit_votes(measure(docs, text, [])).posterior(F.col("out.votes"))
    return measure(docs, text).where(~base_failed() & (good >= THRESHOLD)).select(f"{ROW}.*")
