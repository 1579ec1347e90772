"""WARC archives: write captures, read records, and put transactions together again.

Each page becomes three records: a request, a response (or a revisit) and a metadata record, the
first and the last naming the middle one in WARC-Concurrent-To. Of pages whose payloads are equal and at
least 1000 bytes long, the one of the largest id keeps its payload; the others refer to it.

Spark's text writer ends every record with the two line breaks that the format asks for, and
compresses files with gzip, so archives are committed like any table. The reader cuts files at the version line and mends a
cut inside a payload by the record's Content-Length, a record at a time.

A null payload is an empty one; a null address is an empty header; line breaks in an address are
percent-encoded. Equal rows make equal records, which come back as as many captures. A page without an id keeps null.
Rows of one id with equal payloads can't be told apart: if that id is the largest, all of them are responses. A record that is
cut off at the end of a file is left out. An empty table makes no records. Each record is held whole, however long. Other columns play no part, whatever their names.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from redpen.llm.common import shared_dir

SMALLEST_REVISIT = 1000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
RECORD = (
    "type string, record_id string, concurrent_to array<string>, target_uri string, date string, refers_to string, "
    "declared_digest string, payload_bytes long, payload_digest string, fields map<string,string>, payload binary"
)


def _uuid(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("\x1f", *parts))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12)), F.lit(">"))


def _record(kind: str, headers: list[tuple[str, Column]], block: Column) -> Column:
    lines = [F.lit(f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Date: {DATE}\r\n")]
    for name, value in [*headers, ("Content-Length", F.octet_length(block).cast("string"))]:
        lines += [F.lit(f"{name}: "), value, F.lit("\r\n")]
    return F.concat(*lines, F.lit("\r\n"), block)


def records(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One column ``record`` of whole WARC records, three a page."""
    payload = F.coalesce(F.col(f"`{html}`").cast("string"), F.lit(""))
    address = F.replace(F.replace(F.coalesce(F.col(f"`{url}`").cast("string"), F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    rows = pages.select(F.col(f"`{page_id}`").cast("long").alias("page_id"), address.alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"digest": F.sha1(F.col("payload").cast("binary")), "n": F.octet_length("payload")})
    groups = rows.where(F.col("n") >= SMALLEST_REVISIT).groupBy("digest", "n").agg(F.max("page_id").alias("first_id"), F.max_by("url", F.struct("page_id", "url")).alias("first_url"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    rows = rows.join(groups, ["digest", "n"], "left")
    name = lambda p, u: _uuid(F.coalesce(p.cast("string"), F.lit("")), u, F.col("digest"))
    rows = rows.withColumns({"again": F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id")), "id": name(F.col("page_id"), F.col("url"))})
    digest = F.concat(F.lit("sha1:"), F.col("digest"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit("\r\n\r\n"))
    uri = ("WARC-Target-URI", F.col("url"))
    mine = [("WARC-Record-ID", F.col("id")), uri, ("WARC-Payload-Digest", digest), ("Content-Type", F.lit("application/http; msgtype=response"))]
    response = _record("response", mine, F.concat(http, F.col("payload")))
    revisit = _record("revisit", [*mine, ("WARC-Profile", F.lit(PROFILE)), ("WARC-Refers-To", name(F.col("first_id"), F.col("first_url")))], http)
    other = lambda kind, mime: [("WARC-Record-ID", _uuid(F.lit(kind), F.col("id"))), uri, ("WARC-Concurrent-To", F.col("id")), ("Content-Type", F.lit(mime))]
    path = F.regexp_replace(F.regexp_replace("url", "^[A-Za-z]+://[^/?#]*", ""), "#.*$", "")
    host = F.regexp_extract("url", "^[A-Za-z]+://([^/?#]*)", 1)
    get = F.concat(F.lit("GET "), F.when(path == "", "/").otherwise(path), F.lit(" HTTP/1.1\r\nHost: "), host, F.lit("\r\n\r\n"))
    fields = F.concat(
        F.lit("page-id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit("\r\npayload-bytes: "), F.col("n").cast("string"),
        F.when(F.col("again"), F.concat(F.lit("\r\nrefers-to-page-id: "), F.col("first_id").cast("string"))).otherwise(F.lit("")), F.lit("\r\n"),
    )
    three = F.array(_record("request", other("request", "application/http; msgtype=request"), get), F.when(F.col("again"), revisit).otherwise(response), _record("metadata", other("metadata", "application/warc-fields"), fields))
    return rows.select(F.explode(three).alias("record"))


def write(pages: DataFrame, folder: str, **columns: str) -> None:
    records(pages, **columns).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(folder)


def parse(content: bytes, payload: bool) -> dict:
    """A record, from behind its version line on."""
    head, _, block = content.partition(b"\r\n\r\n")
    headers: dict[str, list[str]] = {}
    for line in head.split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if colon:
            headers.setdefault(name.strip().lower().decode("latin-1"), []).append(value.strip().decode("utf-8", "replace"))
    one = lambda name: headers.get(name, [None])[0]
    block = block[: int(one("content-length") or 0)]
    out = {
        "type": one("warc-type"), "record_id": one("warc-record-id"), "concurrent_to": headers.get("warc-concurrent-to", []), "target_uri": one("warc-target-uri"),
        "date": one("warc-date"), "refers_to": one("warc-refers-to"), "declared_digest": one("warc-payload-digest"), "payload_bytes": None, "payload_digest": None, "fields": None, "payload": None,
    }
    kind = one("content-type") or ""
    if kind.startswith("application/warc-fields"):
        lines = (x.partition(b":") for x in block.split(b"\r\n") if b":" in x)
        out["fields"] = [(k.strip().decode("utf-8", "replace"), v.strip().decode("utf-8", "replace")) for k, _, v in lines]
    elif out["type"] != "revisit":
        body = block.partition(b"\r\n\r\n")[2] if kind.startswith("application/http") else block
        out |= {"payload_bytes": len(body), "payload_digest": hashlib.sha1(body).hexdigest(), "payload": body if payload else None}
    return out


def _whole(content: bytes) -> bool:
    head, gap, block = content.partition(b"\r\n\r\n")
    if not gap:
        return False
    for line in head.split(b"\r\n"):
        if line[:15].lower() == b"content-length:":
            return len(block) >= int(line[15:])
    return True


def read(spark: SparkSession, folder: str, payload: bool = True) -> DataFrame:
    """One row a record. The payload itself may be left out; its length and SHA-1 are always taken."""
    cut = b"WARC/1."
    schema = T._parse_datatype_string(RECORD)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, kept, out, size = None, b"", [], 0

        def batch_of(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(rows, schema=arrow)

        for batch in batches:
            for file, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if file != path:
                    path, kept = file, b""
                kept = kept + cut + piece if kept else piece
                if kept[1:3] != b"\r\n":  # what stands before the first version line
                    kept = b""
                elif _whole(kept[3:]):
                    out.append(parse(kept[3:], payload))
                    size += len(kept) if payload else 1000
                    kept = b""
                if size > 16_000_000:
                    yield batch_of(out)
                    out, size = [], 0
        yield batch_of(out)

    lines = spark.read.option("lineSep", cut.decode()).text(folder).select(F.col("_metadata.file_path").alias("path"), F.col("value").cast("binary").alias("value"))
    return lines.mapInArrow(run, schema)


def assemble(found: DataFrame) -> DataFrame:
    """One nested row a capture: the response or revisit with the request and the metadata that name it as concurrent.

    Requests and metadata without a response make a capture without one. Records that occur n times make n captures.
    """
    whole = F.struct(*[F.col(c) for c in found.columns])
    main = F.col("type").isin("response", "revisit", "resource")
    keys = F.when(main | (F.size("concurrent_to") == 0), F.array("record_id")).otherwise(F.col("concurrent_to"))
    of = lambda kind: F.array_sort(F.collect_list(F.when(kind, F.struct(F.col("r.record_id").alias("by"), F.col("r").alias("r")))), lambda a, b: F.when(a["by"] < b["by"], -1).when(a["by"] > b["by"], 1).otherwise(0))
    kind = F.col("r.type")
    keyed = found.where(main | F.col("type").isin("request", "metadata")).select(F.explode(keys).alias("key"), whole.alias("r"))
    groups = keyed.groupBy("key").agg(of(kind.isin("response", "revisit", "resource")).alias("response"), of(kind == "request").alias("request"), of(kind == "metadata").alias("metadata"))
    nth = lambda c: F.coalesce(F.get(F.col(c), F.col("i"))["r"], F.get(F.col(c), F.lit(0))["r"])
    last = F.greatest(F.size("response"), F.lit(1)) - 1
    return groups.select("key", "request", "response", "metadata", F.explode(F.sequence(F.lit(0), last)).alias("i")).select(
        F.col("key").alias("capture_id"), nth("request").alias("request"), F.get(F.col("response"), F.col("i"))["r"].alias("response"), nth("metadata").alias("metadata")
    )


def report(pages: DataFrame, **columns: str) -> DataFrame:
    """Write the archives into the shared folder, read them back, and describe each page by its capture."""
    spark = pages.sparkSession
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(pages, folder, **columns)
    captures = assemble(read(spark, folder, payload=False))
    field = lambda name: F.get(F.map_values(F.map_filter("metadata.fields", lambda k, _: k == name)), F.lit(0))
    number = lambda name: F.when(field(name) != "", field(name)).cast("long")
    return captures.select(
        number("page-id").alias("page_id"), F.coalesce("response.payload_bytes", number("payload-bytes")).alias("payload_bytes"),
        F.coalesce("response.payload_digest", F.regexp_replace("response.declared_digest", "^sha1:", "")).alias("payload_digest"),
        F.col("response.type").alias("record_type"), number("refers-to-page-id").alias("refers_to"),
    )
