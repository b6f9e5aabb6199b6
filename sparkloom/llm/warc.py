"""WARC archives: writing, reading and transaction assembly."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .scratch import materialize, new_path, temporary

#: Equal payloads of at least so many bytes are stored once; the others revisit it.
REVISIT_BYTES = 100
#: Archives are read as streams of records, so their size bounds no memory, only how far reading is spread.
RECORDS_PER_FILE = 6000
END = "\r\n\r\n"
#: What parts two records: the end of one and the version line of the next.
BETWEEN = END + "WARC/1."
#: Bytes of records that leave a reader together.
BATCH_BYTES = 8_000_000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD = (
    "record_type string, record_id string, concurrent_to string, refers_to string, target_uri string, date string, "
    "payload_digest string, fields map<string,string>, payload binary"
)


def _record_id(kind: str, row: int) -> str:
    return f"<urn:uuid:{kind}-{row:016x}>"


def _head(kind: str, record_id: str, length: int, more: list[tuple[str, str | None]]) -> str:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id}", f"WARC-Date: {DATE}"]
    lines += [f"{k}: {v}" for k, v in more if v is not None]
    return "\r\n".join([*lines, f"Content-Length: {length}"]) + END


def _header_safe(url: str | None) -> str | None:
    """Line ends can't stand in a header: such urls are percent-encoded there."""
    return url.replace("\r", "%0D").replace("\n", "%0A") if url is not None else None


def _compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.to_pydict()
        out: list[str] = []
        for page, url, html, row, first_row, digest, size in zip(*[rows[c] for c in ("page_id", "url", "html", "row", "first_row", "digest", "size")], strict=True):
            uri = _header_safe(url)
            revisit = first_row is not None and first_row != row
            main = _record_id("c", row)
            host = uri.split("://", 1)[-1].split("/", 1)[0] if uri else ""
            ask = f"GET {uri or '/'} HTTP/1.1\r\nHost: {host}{END}"
            out.append(_head("request", _record_id("a", row), len(ask.encode()), [("WARC-Target-URI", uri), ("WARC-Concurrent-To", main), ("Content-Type", "application/http; msgtype=request")]) + ask)
            http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}{END}"
            body = http if revisit else http + (html or "")
            out.append(
                _head(
                    "revisit" if revisit else "response",
                    main,
                    len(body.encode()),
                    [
                        ("WARC-Target-URI", uri),
                        ("WARC-Payload-Digest", f"sha256:{digest}"),
                        ("WARC-Refers-To", _record_id("c", first_row) if revisit else None),
                        ("WARC-Profile", PROFILE if revisit else None),
                        ("Content-Type", "application/http; msgtype=response"),
                    ],
                )
                + body
            )
            notes = f"page-id: {'' if page is None else page}\r\npayload-bytes: {size}\r\n"
            out.append(_head("metadata", _record_id("e", row), len(notes.encode()), [("WARC-Target-URI", uri), ("WARC-Concurrent-To", main), ("Content-Type", "application/warc-fields")]) + notes)
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", records_per_file: int = RECORDS_PER_FILE) -> None:
    """A request, a response or revisit, and a metadata record for each page, as gzipped WARC/1.1 under ``path``.

    Spark's text writer commits the files, with the two line ends that close a
    WARC record as its line separator; so any file system will do and a lost
    executor leaves no half archive.  Of equal payloads of ``REVISIT_BYTES`` or
    more, that of the smallest page id is the response.
    """
    rows = pages.select(
        F.col(id_col).cast("bigint").alias("page_id"),
        F.col(url_col).alias("url"),
        F.coalesce(F.col(html_col), F.lit("")).alias("html"),
        F.monotonically_increasing_id().alias("row"),
    ).withColumns({"digest": F.sha2("html", 256), "size": F.octet_length("html").cast("bigint")})
    with temporary(pages.sparkSession) as write:
        # Numbered once and written, so that a lost task can't number its rows otherwise.
        rows = write(rows, "warc-rows")
        order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "row")
        firsts = write(
            rows.filter(F.col("size") >= REVISIT_BYTES).groupBy("digest").agg(F.min(order).alias("f"), F.count(F.lit(1)).alias("n")).filter("n > 1")
            .select("digest", F.col("f.row").alias("first_row")),
            "warc-firsts",
        )
        kind = "page_id bigint, url string, html string, row bigint, first_row bigint, digest string, size bigint"
        records = rows.join(firsts, "digest", "left").select(*[x.split()[0] for x in kind.split(", ")]).mapInArrow(_compose, "value string")
        records.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def _header(block: bytes) -> dict[str, str]:
    out = {}
    for line in block.split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if colon:
            out[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    return out


def record_of(data: bytes) -> tuple[dict[str, object] | None, int]:
    """The record that ``data``, from after its version line's "WARC/1." on, begins with, and how many of its bytes are missing.

    (None, 0) for a record without a readable length: it is left out.
    """
    head_bytes, _, body = data.partition(b"\r\n\r\n")
    head = _header(head_bytes)
    length = head.get("content-length", "")
    if not length.isdigit():
        return None, 0
    if len(body) < int(length):
        return None, int(length) - len(body)
    body = body[: int(length)]
    kind = head.get("warc-type", "")
    fields: dict[str, str] = {}
    payload: bytes | None = None
    if kind == "metadata":
        fields = _header(body)
    elif "application/http" in head.get("content-type", ""):
        http, _, rest = body.partition(b"\r\n\r\n")
        fields, payload = _header(http), rest if kind == "response" else None
    else:
        payload = body
    return {
        "record_type": kind,
        "record_id": head.get("warc-record-id"),
        "concurrent_to": head.get("warc-concurrent-to"),
        "refers_to": head.get("warc-refers-to"),
        "target_uri": head.get("warc-target-uri"),
        "date": head.get("warc-date"),
        "payload_digest": head.get("warc-payload-digest"),
        "fields": list(fields.items()),
        "payload": payload,
    }, 0


def parse_records(parts: Iterator[tuple[str, bytes]]) -> Iterator[dict[str, object]]:
    """Records from (file, part) in the files' order, the files cut at ``BETWEEN``.

    A payload may hold what looks like the start of a record: parts are put
    together again as long as the record's length asks for more.  A record that
    its file does not hold whole, or without a readable length, is left out.
    """
    now, held, missing = None, bytearray(), 0
    for file, part in parts:
        if file != now:
            now, missing = file, 0
            part = part.removeprefix(b"WARC/1.")
        if missing:
            held += BETWEEN.encode() + part
            missing -= len(BETWEEN) + len(part)
            if missing > 0:
                continue
        else:
            held = bytearray(part)
        record, missing = record_of(bytes(held))
        if record:
            yield record


_SCHEMA = pa.schema(
    [(n, pa.string()) for n in ("record_type", "record_id", "concurrent_to", "refers_to", "target_uri", "date", "payload_digest")]
    + [("fields", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())]
)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def parts() -> Iterator[tuple[str, bytes]]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield batch.column(0)[k].as_py(), batch.column(1)[k].as_py()

    rows: list[dict[str, object]] = []
    size = 0
    for record in parse_records(parts()):
        rows.append(record)
        size += len(record["payload"] or b"") + 1000
        if size > BATCH_BYTES:
            yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)
            rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record of the archives under ``path``, plain or gzipped (also record by record).

    Spark's text reader streams the files and cuts them between records, so no
    task holds more than a batch of records.  Large plain files are read in
    several pieces; a payload that holds a whole record of its own may then be
    cut where two pieces meet.
    """
    lines = spark.read.option("lineSep", BETWEEN).option("recursiveFileLookup", "true").text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("value")).mapInArrow(_parse, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row for each capture: (capture_id, target_uri, date, request, response, metadata).

    A response or revisit record opens a capture; requests and metadata belong
    to the capture whose record id they name in WARC-Concurrent-To, whatever
    file or order they came in.  The records meet by one aggregation on that id.
    Requests or metadata without their response give a row with a null
    ``response``; a record without any id is left to itself under a null id and
    dropped; records repeated under one id give one capture.
    """
    main = F.col("record_type").isin("response", "revisit", "resource")
    keyed = records.filter(F.col("record_type").isin("request", "response", "revisit", "resource", "metadata")).withColumn(
        "capture_id", F.when(main, F.col("record_id")).otherwise(F.coalesce("concurrent_to", "record_id"))
    )
    body = F.struct("record_type", "record_id", "refers_to", "payload_digest", "fields", "payload")
    side = F.struct("record_id", "fields")
    return (
        keyed.filter("capture_id is not null")
        .groupBy("capture_id")
        .agg(
            F.first(F.when(main, F.col("target_uri")), True).alias("target_uri"),
            F.first(F.when(main, F.col("date")), True).alias("date"),
            F.first(F.when(F.col("record_type") == "request", side), True).alias("request"),
            F.first(F.when(main, body), True).alias("response"),
            F.first(F.when(F.col("record_type") == "metadata", side), True).alias("metadata"),
        )
    )


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write the pages to archives in the shared folder, read them back and assemble: one row for each page.

    Null html is an empty payload, null url an archive record without target,
    null page id one without a page id; repeated pages keep a capture each (all
    but one of them revisits, if long enough); an empty table gives an empty result.
    """
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_warc(pages, path, id_col, url_col, html_col)
    return assemble(read_warc(spark, path))


def page_digests(captures: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of assembled captures.

    What a revisit stands for is looked up by the record id it refers to; where
    the archives do not hold that record, bytes and page are null and the digest
    is the one of its header.
    """
    payload = F.col("response.payload")
    page = F.nullif(F.col("metadata.fields")["page-id"], F.lit("")).cast("bigint")
    light = materialize(
        captures.select(
            "capture_id",
            page.alias("page_id"),
            F.col("response.record_type").alias("record_type"),
            F.col("response.refers_to").alias("refers"),
            F.octet_length(payload).cast("bigint").alias("bytes"),
            F.sha2(payload, 256).alias("sha"),
            F.regexp_replace("response.payload_digest", "^sha256:", "").alias("said"),
        ),
        "warc-captures",
    )
    revisits = light.filter("record_type = 'revisit'").select("page_id", "record_type", "refers", "said")
    seen = light.filter("record_type = 'response'").select(F.col("capture_id").alias("refers"), F.col("page_id").alias("refers_to"), "bytes", "sha")
    found = revisits.join(seen.hint("merge"), "refers", "left").select(
        "page_id", F.col("bytes").alias("payload_bytes"), F.coalesce("sha", "said").alias("payload_digest"), "record_type", "refers_to"
    )
    own = light.filter("not record_type <=> 'revisit'").select(
        "page_id", F.col("bytes").alias("payload_bytes"), F.col("sha").alias("payload_digest"), "record_type", F.lit(None).cast("bigint").alias("refers_to")
    )
    return own.unionAll(found)


WARC_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id > first THEN first END AS refers_to
FROM f
"""
