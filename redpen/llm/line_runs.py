"""Line dedup: maximal runs of lines that occur earlier in the corpus are deleted.

All documents, in order of id, are one sequence of line ids (128-bit hashes of their lines, trimmed, without blank ones)
with a gap behind each document. Its suffix array is made by prefix doubling: the rank of the run of 2 ** (k + 1) lines from a
place follows from the ranks of the runs of 2 ** k lines from there and from behind those, in their order. A place whose run
occurs nowhere else is out, and so are the lines that occur once.

Places of one rank are an interval of the suffix array whose longest common prefix is at least that many lines. From the longest runs down, the places of an
interval that also share the next half as many lines are an interval inside it, and move on to that; its earliest place stays behind and leaves a
witness. In the end every place has the length of its deepest interval with an earlier place, which is the longest run
from it that occurs earlier.

Every such run is deleted, however short; a caller may ask for at least ``min_words`` words. Blank lines inside go with it. First occurrences stay, overlaps of a
run with itself count. Rows of equal id and text are one document and get equal results. Null texts have no lines
and stay null; empty ones too. Null ids come first. Texts without a deleted run stay as they are, byte for byte. An empty table gives no
rows. Very long lines are hashed whole, and a document's places are rows of their own, so neither needs memory. A caller's other columns may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from redpen.llm.common import ROW, Scratch

MIN_WORDS = 1
BLANK = " \t\r\x0b\x0c"
_NO_ID = -(2**63)


def key(docs: DataFrame, doc_id: str, text: str) -> tuple[Column, Column]:
    """What names a document, neither of them null: its id, and a hash of its text that tells a missing id from the least one."""
    name = F.col(f"`{doc_id}`").cast("long")
    return F.coalesce(name, F.lit(_NO_ID)), F.xxhash64(name.isNull(), F.col(f"`{text}`").cast("string"))


def filled(x: Column) -> Column:
    return F.btrim(x, F.lit(BLANK)) != ""


def lines_of(docs: DataFrame, doc_id: str, text: str, count_words: bool = False) -> DataFrame:
    """(d, t, p, h1, h2, words): every line that isn't blank, numbered from 0."""
    d, t = key(docs, doc_id, text)
    every = docs.select(d.alias("d"), t.alias("t"), F.posexplode(F.filter(F.split(F.col(f"`{text}`").cast("string"), "\n", -1), filled)).alias("p", "x"))
    x = F.btrim("x", F.lit(BLANK))
    words = F.size(F.split(x, f"[{BLANK}]+")) if count_words else F.lit(0)
    return every.select("d", "t", "p", F.xxhash64(x).alias("h1"), F.xxhash64(F.lit(1), x).alias("h2"), words.alias("words"))


def ranked(classes: DataFrame, by: list[str]) -> DataFrame:
    """Number classes in the order of ``by``: larger keys get larger ranks."""
    return classes.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("r", F.monotonically_increasing_id())


def places_of(docs: DataFrame, scratch: Scratch, doc_id: str, text: str, count_words: bool) -> DataFrame:
    """(g, r, d, t, p, words): the lines that occur twice or more, with their place in the whole sequence and their rank."""
    lines = scratch.table(lines_of(docs, doc_id, text, count_words), "lines")
    again = scratch.table(ranked(lines.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").drop("n"), ["h1", "h2"]), "again")
    found = scratch.table(lines.join(again, ["h1", "h2"]).select("d", "t", "p", "r", "words").dropDuplicates(["d", "t", "p"]), "found")
    scratch.drop("lines", "again")
    # documents in order, numbered without gaps: parts in order, and rows in order in each
    of_doc = found.groupBy("d", "t").agg(F.max("p").alias("last")).repartitionByRange("d", "t").sortWithinPartitions("d", "t")
    of_doc = scratch.table(of_doc.withColumn("m", F.monotonically_increasing_id()), "documents")
    part = F.shiftright("m", 33)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = of_doc.groupBy(part.alias("part")).agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    span = (of_doc.agg(F.max("last")).first()[0] or 0) + 2
    numbered = of_doc.withColumn("part", part).join(parts, "part").select("d", "t", ((F.col("ahead") + F.col("m").bitwiseAND(F.lit(2**33 - 1))) * F.lit(span).cast("long")).alias("base"))
    out = scratch.table(found.join(numbered, ["d", "t"]).select((F.col("base") + F.col("p")).alias("g"), "r", "d", "t", "p", "words"), "places")
    scratch.drop("found", "documents")
    return out


def doubled(first: DataFrame, scratch: Scratch) -> list[DataFrame]:
    """Tables (g, r), the k-th with the ranks of the runs of 2 ** k lines that occur twice or more."""
    ranks = [first]
    while not ranks[-1].isEmpty():
        here = ranks[-1]
        behind = here.select((F.col("g") - (1 << (len(ranks) - 1))).alias("g"), F.col("r").alias("r2"))
        pairs = scratch.table(here.select("g", F.col("r").alias("r1")).join(behind, "g"), "pairs")
        classes = scratch.table(ranked(pairs.groupBy("r1", "r2").agg(F.count("*").alias("n")).where("n > 1").drop("n"), ["r1", "r2"]), "classes")
        ranks.append(scratch.table(pairs.join(classes, ["r1", "r2"]).select("g", "r"), f"ranks-{len(ranks)}"))
    scratch.drop("pairs", "classes")
    return ranks[:-1]


def earlier_runs(ranks: list[DataFrame], scratch: Scratch) -> DataFrame | None:
    """(g, l): for each place with any, the length of its longest run that occurs from an earlier place too."""
    states: DataFrame | None = None
    for k in reversed(range(len(ranks))):
        at = ranks[k].select(F.col("g").alias("at"), "r")
        entering = ranks[k] if states is None else ranks[k].join(ranks[k + 1].select("g"), "g", "left_anti")
        looked = entering.select("g", F.lit(0).alias("l"), F.lit(-1).cast("long").alias("c"), F.lit(True).alias("seeks"), "r")
        if states is not None:
            looked = looked.unionByName(states.withColumn("at", F.col("g") + F.col("l")).join(at, "at", "left").drop("at"))
        looked = scratch.table(looked, "looked")
        # intervals inside intervals: c, the earliest place, names the interval of depth l
        inside = looked.where("r IS NOT NULL").groupBy("l", "c", "r").agg(F.count("*").alias("n"), F.min("g").alias("head")).where("n > 1").drop("n")
        inside = scratch.table(inside, "intervals")
        deeper = lambda seeks: F.struct((F.col("l") + (1 << k)).alias("l"), F.col("head").alias("c"), F.lit(seeks).alias("seeks"))  # noqa: B023, E731
        same = F.struct("l", "c", "seeks")
        after = F.when(F.col("head").isNull(), F.array(same)).when(F.col("g") == F.col("head"), F.array(same, deeper(False))).when(F.col("seeks"), F.array(deeper(True))).otherwise(F.array())
        states = scratch.table(looked.join(inside, ["l", "c", "r"], "left").select("g", F.explode(after).alias("s")).select("g", "s.*"), "states")
    scratch.drop("looked", "intervals")
    return None if states is None else states.where("seeks AND l > 0").select("g", "l")


def deletions(docs: DataFrame, scratch: Scratch, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame | None:
    """(d, t, gone): for each document that loses lines, the ranges of those that aren't blank, in order, end exclusive. None if nothing goes."""
    places = places_of(docs, scratch, doc_id, text, min_words > 1)
    ranks = doubled(places.select("g", "r"), scratch)
    runs = earlier_runs(ranks, scratch)
    if runs is None:
        return None
    in_doc = Window.partitionBy("d", "t").orderBy("p")
    if min_words > 1:
        # a run's lines all occur in places, so their words are a difference of sums
        upto = places.select("g", F.sum("words").over(in_doc.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"), "words")
        last = upto.select((F.col("g")).alias("last"), F.col("upto").alias("upto_last"))
        words = F.col("upto_last") - F.col("upto") + F.col("words")
        runs = runs.withColumn("last", F.col("g") + F.col("l") - 1).join(upto, "g").join(last, "last").where(words >= min_words).select("g", "l")
    ends = runs.join(places.select("g", "d", "t", "p"), "g").select("d", "t", "p", (F.col("p") + F.col("l")).alias("e"))
    starts_anew = F.coalesce(F.col("p") >= F.max("e").over(in_doc.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    islands = ends.withColumn("anew", starts_anew).withColumn("island", F.sum(F.col("anew").cast("int")).over(in_doc))
    merged = islands.groupBy("d", "t", "island").agg(F.min("p").alias("start"), F.max("e").alias("end"))
    gone = scratch.table(merged.groupBy("d", "t").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("gone")), "gone")
    scratch.drop("places", "states", *[f"ranks-{k}" for k in range(1, len(ranks) + 1)])
    return gone


def cleaned(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``row`` (the document's columns, with its text cleaned), and ``gone``, its deleted ranges of lines, blank ones counted (null where nothing is deleted)."""
    gone = deletions(docs, Scratch(docs.sparkSession, "line-runs"), doc_id, text, min_words)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(ROW)
    if gone is None:
        return docs.select(whole, F.lit(None).cast("array<struct<start: int, end: int>>").alias("gone"))
    d, t = key(docs, doc_id, text)
    both = docs.select(whole, d.alias("d"), t.alias("t")).join(gone, ["d", "t"], "left")
    lines = F.split(F.col(f"{ROW}.`{text}`").cast("string"), "\n", -1)
    both = both.withColumn("lines", F.when(F.col("gone").isNotNull(), lines))
    both = both.withColumn("at", F.filter(F.transform("lines", lambda x, i: F.when(filled(x), i)), lambda i: i.isNotNull()))
    both = both.withColumn("gone", F.transform("gone", lambda g: F.struct(F.get("at", g["start"]).alias("start"), (F.get("at", g["end"] - 1) + 1).alias("end"))))
    starts = F.concat(F.array(F.lit(0)), F.transform("gone", lambda g: g["end"]))
    ends = F.concat(F.transform("gone", lambda g: g["start"]), F.array(F.size("lines")))
    stay = F.flatten(F.zip_with(starts, ends, lambda a, b: F.slice(F.col("lines"), a + 1, b - a)))
    new = F.when(F.col("gone").isNull(), F.col(f"{ROW}.`{text}`")).otherwise(F.array_join(stay, "\n"))
    parts = [new.alias(c) if c == text else F.col(f"{ROW}.`{c}`").alias(c) for c in docs.columns]
    return both.select(F.struct(*parts).alias(ROW), "gone")


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """One row a document: how many lines go, which, and the text that stays."""
    out = cleaned(docs, doc_id, text, min_words)
    n = F.coalesce(F.aggregate("gone", F.lit(0), lambda a, g: a + g["end"] - g["start"]), F.lit(0)).cast("long")
    return out.select(F.col(f"{ROW}.`{doc_id}`").alias("doc_id"), n.alias("n_deleted"), "gone", F.col(f"{ROW}.`{text}`").alias("text"))


def clean(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """The documents with cleaned texts; those of which nothing but blanks is left are dropped."""
    out = cleaned(docs, doc_id, text, min_words)
    return out.where(F.col("gone").isNull() | (F.btrim(F.col(f"{ROW}.`{text}`"), F.lit(BLANK + "\n")) != "")).select(f"{ROW}.*")
