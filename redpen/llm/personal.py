"""Personal data by weak supervision, in DataFrame functions only.

Candidates are the matches of each kind's pattern. Three labelers vote on each one, or abstain: a regular-expression
labeler (a stricter form), a gazetteer labeler (known endings, prefixes and names) and a context labeler (cue
words in the 40 characters before). Expectation-maximisation over the counts of vote patterns, of which there are
at most ``len(KINDS) * 27 * 8`` for any input, estimates the labelers' reliabilities and each kind's share
of true ones. A logistic classifier is then trained on those posteriors, from votes, kind and form, and decides
about the kinds that the base does not fix. Spans of base kinds always stay.

Positions are found by putting a mark on both sides of each match and adding up lengths. The mark is U+0001; one that the text
has itself is read as U+0002, which no pattern tells apart. Patterns are written so that they take time in proportion to the text.

Null texts are empty ones. Empty texts have no spans. Equal rows get equal spans. With no candidates the classifier is not trained and adds nothing.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from redpen.llm.common import checkpoint

MARK, OTHER = "\x01", "\x02"
CONTEXT = 40
THRESHOLD = 0.5
BLOCK = 256

#: fixed values: gazetteers
ENDINGS = ("com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "uk", "eu", "it", "nl", "ch", "at", "us", "ca")
MAILBOXES = ("noreply", "no-reply", "donotreply", "postmaster", "mailer-daemon")
NAMES = ("anna", "maria", "peter", "john", "james", "mary", "robert", "michael", "david", "sarah", "laura", "thomas", "paul", "julia", "marie", "pierre", "jean", "claire", "carlos", "jose", "ana", "luis", "hans", "klaus", "petra", "emma", "lukas", "sophie", "linda", "susan")
CUES = {
    "email": r"e-?mail|mailto|contact|write|reach|correo|courriel|kontakt|schreib",
    "ip": r"\bip\b|address|host|server|login|from|client|adresse",
    "card": r"card|visa|master|amex|payment|pay|karte|carte|tarjeta|kredit",
    "phone": r"phone|call|tel|mobile|fax|contact|whatsapp|anruf|appel|llam",
    "phone_local": r"phone|call|tel|mobile|fax|contact|whatsapp|anruf|appel|llam",
    "ssn": r"ssn|social security|\bss#|tax id",
    "name": r"name|contact|signed|sincerely|regards|author|dear",
}
AGAINST = r"version|release|isbn|issn|order|invoice|serial|build|ratio|page|section|score|total|ref"


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    needs: str  # a text without it has no match
    base: bool


KINDS = (
    # at a run's start, or where the last match has ended: elsewhere in a run a match would have started before
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", True),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", ".", True),
    Kind("card", r"(?<![0-9])[0-9](?:[ -]?[0-9])++", "", True),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", "+", True),
    Kind("phone_local", r"(?<![0-9+().-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])", "", False),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-", False),
    Kind("name", r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sra)\.? [A-Z][a-z]{1,20}+(?: [A-Z][a-z]{1,20}+)?(?![A-Za-z])", "", False),
)
BASE = tuple(k.name for k in KINDS if k.base)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Every second digit from the right is doubled, and the digits of all are summed."""
    n = F.length(number)
    def add(total, i):
        d = F.substring(number, i, F.lit(1)).cast("int")
        twice = F.when((n - i) % 2 == 1, d * 2).otherwise(d)
        return total + F.when(twice > 9, twice - 9).otherwise(twice)
    return F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), add) % 10 == 0


def valid(kind: str, v: Column) -> Column:
    d = digits(v)
    if kind == "ip":
        return F.forall(F.split(v, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.substring(F.ltrim(p, F.lit("0")), 1, 3).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.when(F.length(d).between(12, 19), luhn(F.substring(d, 1, 19))).otherwise(False)
    if kind == "phone":
        return F.length(d).between(9, 15)
    return F.lit(True)


def vote(yes: Column, no: Column) -> Column:
    return F.when(no, "0").when(yes, "1").otherwise("-")


def votes(kind: str, v: Column, before: Column) -> Column:
    """Three characters: what the regular-expression, gazetteer and context labelers say (1, 0, or - to abstain)."""
    none, d, low = F.lit(False), digits(v), F.lower(v)
    strict = {
        "email": (v.rlike(r"^[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9][A-Za-z0-9-]*\.)+[A-Za-z]{2,24}$"), v.rlike(r"\.\.|^[.]|[.]@|\.[0-9]+$")),
        "ip": (v.rlike(r"^[1-9][0-9]{0,2}(?:\.[0-9]{1,3}){3}$"), v.rlike(r"(?:^|\.)0[0-9]")),
        "card": (d.rlike("^[3-6]"), d.rlike("^0")),
        "phone": (d.rlike("^[1-9]"), d.rlike("^0")),
        "phone_local": (d.rlike("^[2-9][0-9]{2}[2-9]"), d.rlike("^[01]")),
        "ssn": (~v.rlike("^(?:000|666|9)|-00-|0000$"), v.rlike("^(?:000|666|9)|-00-|0000$")),
        "name": (v.rlike(r"^\S+ \S+ \S+$"), none),
    }[kind]
    last = F.substring_index(low, ".", -1)
    known = {
        "email": (last.isin(*ENDINGS), F.substring_index(low, "@", 1).isin(*MAILBOXES)),
        "ip": (~v.rlike(r"^(?:0|10|127|255)\.|^192\.168\."), v.rlike(r"^(?:0|127|255)\.")),
        "card": (d.rlike("^(?:4|5[1-5]|3[47]|6011|65)"), none),
        "phone": (d.rlike("^(?:1|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|7|8[1246]|9[0-58])"), none),
        "phone_local": (none, d.rlike("^(?:555|000|999)")),
        "ssn": (none, v.isin("123-45-6789", "078-05-1120")),
        "name": (F.exists(F.split(low, " "), lambda w: w.isin(*NAMES)), none),
    }[kind]
    near = F.lower(before)
    context = (near.rlike(CUES[kind]), ~near.rlike(CUES[kind]) & near.rlike(AGAINST))
    return F.concat(vote(*strict), vote(*known), vote(*context))


def form(v: Column) -> Column:
    """Three bits of form: has separators, is long, has a letter."""
    bit = lambda c: F.when(c, "1").otherwise("0")
    return F.concat(bit(v.rlike("[ ().-]")), bit(F.length(v) > 16), bit(v.rlike("[A-Za-z]")))


def _parts(text: Column, kind: Kind) -> Column:
    """What stands before, in and between the matches, alternately."""
    cut = F.split(F.regexp_replace(text, kind.pattern, f"{MARK}$0{MARK}"), MARK, -1)
    return F.when(F.contains(text, F.lit(kind.needs)), cut).otherwise(F.array(text)) if kind.needs else cut


def _offsets(lengths: Column) -> Column:
    """Start of every part: running sums in blocks, so that many matches don't take quadratic time."""
    zero = F.lit(0).cast("long")
    running = lambda xs, start: F.aggregate(xs, F.array(start), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / BLOCK).cast("int")), lambda b: F.slice(lengths, b * BLOCK + 1, F.lit(BLOCK)))
    sums = running(F.transform(blocks, lambda b: F.aggregate(b, zero, lambda a, x: a + x)), zero)
    return F.flatten(F.zip_with(blocks, F.slice(sums, 1, F.size(sums) - 1), lambda b, start: F.slice(running(b, start), F.lit(1), F.size(b))))


def _judged(k: Kind, rank: int) -> Column:
    """The matches of one kind that hold, with votes and form; null without matches."""
    parts, offsets = F.col(f"p_{k.name}"), F.col(f"o_{k.name}")
    places = F.sequence(F.lit(2), F.size(parts), F.lit(2))
    raw = F.transform(places, lambda i: F.struct(F.element_at(offsets, i).alias("start"), F.element_at(parts, i).alias("value"), F.right(F.element_at(parts, i - 1), F.lit(CONTEXT)).alias("before")))
    good = F.filter(raw, lambda x: valid(k.name, x["value"]))
    judged = F.transform(
        good,
        lambda x: F.struct(
            x["start"].alias("start"), F.lit(rank).alias("rank"), (x["start"] + F.length(x["value"])).alias("end"), F.lit(k.name).alias("kind"), votes(k.name, x["value"], x["before"]).alias("votes"), form(x["value"]).alias("form")
        ),
    )
    return F.when(F.size(offsets) > 2, judged)


def candidates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, found): per document its candidates that hold by kind, with votes and form, by start and then kind."""
    clean = F.translate(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")), MARK, OTHER)
    marked = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), clean.alias("text")).select("doc_id", *[_parts(F.col("text"), k).alias(f"p_{k.name}") for k in KINDS])
    # Each step refers to the one before more than once, so that the optimizer keeps them apart and nothing is computed again for each match.
    sized = marked.select("*", *[F.when(F.size(f"p_{k.name}") > 1, F.transform(f"p_{k.name}", lambda p: F.length(p).cast("long"))).alias(f"l_{k.name}") for k in KINDS])
    placed = sized.select("*", *[F.when(F.size(f"l_{k.name}") > 1, _offsets(F.col(f"l_{k.name}"))).alias(f"o_{k.name}") for k in KINDS])
    found = [_judged(k, rank) for rank, k in enumerate(KINDS)]
    empty = F.array().cast("array<struct<start: bigint, rank: int, end: bigint, kind: string, votes: string, form: string>>")
    return placed.select("doc_id", F.array_sort(F.concat(*[F.coalesce(f, empty) for f in found])).alias("found"))


@dataclass
class SpanModel:
    bias: float
    weights: dict[str, float]
    reliabilities: list[tuple[float, float]]

    def probability(self, s: Column) -> Column:
        odds = F.lit(self.bias)
        for name, w in self.weights.items():
            what, _, value = name.partition("=")
            if what == "kind":
                hit = s["kind"] == value
            else:
                hit = F.substring(s[what[:-1]], int(what[-1]) + 1, 1) == value
            odds = odds + F.when(hit, w).otherwise(0.0)
        return 1 / (1 + F.exp(-odds))


def reliabilities(rows: list[tuple[str, str, float]], rounds: int = 100) -> tuple[dict, list[tuple[float, float]]]:
    """EM over (kind, votes, count): posterior of each (kind, votes), and each labeler's rates of 1 on true and of 0 on false candidates."""
    q = {(k, v): 0.5 + 0.45 * (v.count("1") - v.count("0")) / 3 for k, v, _ in rows}
    rates: list[tuple[float, float]] = []
    for _ in range(rounds):
        shares, rates = {}, []
        for kind in {k for k, _, _ in rows}:
            n = sum(c for k, _, c in rows if k == kind)
            shares[kind] = (sum(c * q[k, v] for k, v, c in rows if k == kind) + 2) / (n + 4)
        for j in range(3):
            count = {(x, y): sum(c * (q[k, v] if y else 1 - q[k, v]) for k, v, c in rows if v[j] == x) for x in "01" for y in (0, 1)}
            # prior counts of a labeler that is right four times in five
            yes, no = (count["1", 1] + 8) / (count["1", 1] + count["0", 1] + 10), (count["0", 0] + 8) / (count["1", 0] + count["0", 0] + 10)
            rates.append((min(max(yes, 0.55), 0.999), min(max(no, 0.55), 0.999)))
        new = {}
        for key in q:
            odds = math.log(shares[key[0]] / (1 - shares[key[0]]))
            for (yes, no), x in zip(rates, key[1], strict=True):
                odds += math.log(yes / (1 - no)) if x == "1" else math.log((1 - yes) / no) if x == "0" else 0.0
            new[key] = 1 / (1 + math.exp(-odds))
        done = max((abs(new[k] - q[k]) for k in q), default=0) < 1e-9
        q = new
        if done:
            break
    return q, rates


def train(counts: list[tuple[str, str, str, int]], rounds: int = 300) -> SpanModel:
    """A logistic classifier on the posteriors, from the counts of (kind, votes, form)."""
    merged: dict[tuple[str, str], float] = {}
    for k, v, _, n in counts:
        merged[k, v] = merged.get((k, v), 0) + n
    q, rates = reliabilities([(k, v, n) for (k, v), n in sorted(merged.items())])
    names = [f"kind={k.name}" for k in KINDS] + [f"votes{j}={x}" for j in range(3) for x in "01"] + [f"form{j}=1" for j in range(3)]
    rows = []
    total = sum(n for *_, n in counts) or 1
    for k, v, f, n in sorted(counts):
        on = [f"kind={k}"] + [f"votes{j}={v[j]}" for j in range(3) if v[j] != "-"] + [f"form{j}=1" for j in range(3) if f[j] == "1"]
        rows.append(([names.index(x) for x in on], q[k, v], n / total))
    bias, w = 0.0, [0.0] * len(names)
    for _ in range(rounds if rows else 0):
        g0, g = 0.0, [1e-3 * x for x in w]
        for on, y, n in rows:
            p = 1 / (1 + math.exp(-max(-50.0, min(50.0, bias + sum(w[i] for i in on)))))
            g0 += n * (p - y)
            for i in on:
                g[i] += n * (p - y)
        bias -= 2.0 * g0
        w = [x - 2.0 * d for x, d in zip(w, g, strict=True)]
    return SpanModel(bias if rows else -50.0, dict(zip(names, w, strict=True)), rates)


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, spans): kind, start, end (code points, end exclusive), base, probability; base spans, and others that the classifier takes."""
    found = checkpoint(candidates(docs, doc_id, text))
    counts = found.select(F.explode("found").alias("s")).groupBy("s.kind", "s.votes", "s.form").count().collect()
    model = train([tuple(r) for r in counts])
    judged = F.transform("found", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].isin(*BASE).alias("base"), F.round(model.probability(s), 6).alias("probability")))
    return found.select("doc_id", judged.alias("judged")).select("doc_id", F.filter("judged", lambda s: s["base"] | (s["probability"] >= THRESHOLD)).alias("spans"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: counts of the base kinds, a digest of their spans, and all spans."""
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return find(docs, doc_id, text).select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in BASE], F.sha2(joined(F.filter("spans", lambda s: s["base"])), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans")
    )
