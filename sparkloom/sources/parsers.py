"""Files to documents: listing, HTML, Markdown, page-broken text, DOCX, and tables in them."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .shared import bound_batches


@dataclass
class Parsed:
    text: str = ""
    title: str | None = None
    blocks: list[tuple[str, str]] = field(default_factory=list)
    tables: list[dict] = field(default_factory=list)
    links: list[str] = field(default_factory=list)
    meta: dict[str, str] = field(default_factory=dict)


def list_files(spark: SparkSession, path: str, extensions: tuple[str, ...] = ()) -> DataFrame:
    """(source_id, name, extension, size, modified, content, uri) under any file system that Spark reads.

    ``uri`` is the encoded path, by which Spark leaves out files without opening them; filters on other columns come after the bytes are read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    ext = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    out = files.select(F.col("path").alias("source_id"), name.alias("name"), ext.alias("extension"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content", F.col("_metadata.file_path").alias("uri"))
    return out.filter(F.col("extension").isin(*[e.lower() for e in extensions])) if extensions else out


def _only(files: DataFrame, listed: DataFrame) -> DataFrame:
    """``files`` without those that ``listed`` does not name: only their bytes are read.  The names pass the driver, which lists all files anyway."""
    return files.filter(F.col("uri").isin(*[r[0] for r in listed.select("uri").distinct().collect()]))


def fetch(files: DataFrame, source_id: str) -> DataFrame:
    """The one listed file of this id, with its content; a missing one is an error."""
    found = files.filter(F.col("source_id") == source_id)
    named = found.select("uri").limit(1).collect()
    if not named:
        raise FileNotFoundError(source_id)
    return found.filter(F.col("uri") == named[0][0])


def fetch_many(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted(source_id)`` with found, size, modified and content; files that are not there are marked and the others still come."""
    ids = wanted.select("source_id")
    asked = _only(files, files.select("source_id", "uri").join(ids, "source_id", "left_semi"))
    held = asked.select("source_id", F.lit(True).alias("found"), "size", "modified", "content")
    return ids.join(held, "source_id", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def list_objects(objects: DataFrame, prefix: str, after: str | None = None, limit: int = 1000, extensions: tuple[str, ...] = ()) -> DataFrame:
    """A page of the keys that begin with ``prefix``, in key order, after the last key of the page before."""
    page = objects.filter(F.col("key").startswith(prefix))
    if after is not None:
        page = page.filter(F.col("key") > after)
    if extensions:
        page = page.filter(F.lower(F.regexp_extract("key", r"\.([A-Za-z0-9]+)$", 1)).isin(*[e.lower() for e in extensions]))
    return page.orderBy("key").limit(limit)


def put_objects(objects: DataFrame, store: str) -> None:
    """Add ``objects(key, content)`` to the store; a key that is put again has its latest content.

    Objects are rows of a Parquet table in buckets of their keys' hash, so that
    millions of small ones do not become millions of files.
    """
    stamped = objects.select("key", F.col("content").cast("binary").alias("content"), F.current_timestamp().alias("at"), F.pmod(F.xxhash64("key"), F.lit(64)).alias("bucket"))
    stamped.repartition("bucket").write.mode("append").partitionBy("bucket").parquet(store)


def objects_of(spark: SparkSession, store: str) -> DataFrame:
    """(key, content): the latest content of each key."""
    rows = spark.read.schema("key string, content binary, at timestamp, bucket int").parquet(store)
    return rows.groupBy("key").agg(F.max_by("content", "at").alias("content"))


def copy_objects(spark: SparkSession, store: str, prefix: str, to: str) -> None:
    """Put the objects under ``prefix`` once more, under ``to`` in place of it."""
    moved = objects_of(spark, store).filter(F.col("key").startswith(prefix))
    put_objects(moved.select(F.concat(F.lit(to), F.substr("key", F.lit(len(prefix) + 1))).alias("key"), "content"), store)


_TEXT = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "blockquote"}


class _Html(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out = Parsed()
        self.open: list[tuple[str, list[str]]] = []
        self.hidden = 0
        self.in_title = False
        self.seen: list[str] = []
        self.table: dict | None = None
        self.row: list[tuple[str, str]] = []
        self.cell: list[str] | None = None
        self.groups: dict[str, list[str]] = {"text": [], "code": []}

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ("script", "style"):
            self.hidden += 1
        elif tag == "title":
            self.in_title = True
        elif tag == "a":
            href = dict(attrs).get("href") or ""
            if href and not href.startswith("#"):
                self.out.links.append(href)
        elif tag == "table":
            self.table = {"rows": [], "head": None, "in_head": False, "caption": None}
        elif tag == "thead" and self.table:
            self.table["in_head"] = True
        elif tag == "tr":
            self.row = []
        elif tag in ("td", "th", "caption"):
            self.cell = []
        if tag in _TEXT or tag == "pre":
            self.open.append((tag, []))

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        elif tag == "title":
            self.in_title = False
        elif tag in ("td", "th") and self.cell is not None:
            self.row.append((tag, " ".join("".join(self.cell).split())))
            self.cell = None
        elif tag == "caption" and self.table and self.cell is not None:
            self.table["caption"], self.cell = "".join(self.cell).strip(), None
        elif tag == "thead" and self.table:
            self.table["in_head"] = False
        elif tag == "tr" and self.table and self.row:
            if not self.table["in_head"]:
                self.table["rows"].append(self.row)
            elif self.table["head"] is None:  # further rows of the head are no data
                self.table["head"] = self.row
        elif tag == "table" and self.table:
            self._close_table(self.table)
            self.table = None
        if any(t == tag for t, _ in self.open):
            while True:
                name, parts = self.open.pop()
                body = "".join(parts) if name == "pre" else " ".join("".join(parts).split())
                if body.strip():
                    self.groups["code" if name == "pre" else "text"].append(body)
                if name == tag:
                    break

    def _close_table(self, table: dict) -> None:
        """Headers: the head's row, else the first row of header cells only, else the first row."""
        rows, head = table["rows"], table["head"]
        if head is None and rows:
            head = rows.pop(next((k for k, r in enumerate(rows) if all(t == "th" for t, _ in r)), 0))
        if head is not None:
            self.out.tables.append({"headers": [c for _, c in head], "rows": [[c for _, c in r] for r in rows], "caption": table["caption"]})

    def handle_data(self, data: str) -> None:
        if self.in_title:
            self.out.title = (self.out.title or "") + data
            return
        if self.hidden:
            return
        if self.cell is not None:
            self.cell.append(data)
        for _, parts in self.open[-1:]:
            parts.append(data)
        if data.strip():
            self.seen.append(data.strip())


def parse_html(content: bytes) -> Parsed:
    """Title, text blocks in document order, then code, tables and links; body text one line for each text node."""
    p = _Html()
    p.feed(content.decode("utf-8", "replace"))
    p.close()
    out = p.out
    out.title = out.title.strip() if out.title else None
    out.blocks = [("text", x) for x in p.groups["text"]] + [("code", x) for x in p.groups["code"]]
    out.text = "\n".join(p.seen)
    return out


def front_matter(text: str) -> tuple[dict[str, str], str]:
    """Leading '---' key: value lines; anything else leaves the text alone."""
    m = re.match(r"---[ \t]*\n(.*?)\n---[ \t]*(?:\n|$)", text, re.DOTALL)
    if not m:
        return {}, text
    pairs = [line.split(":", 1) for line in m.group(1).splitlines() if line.strip()]
    if any(len(p) != 2 or not p[0].strip() for p in pairs):
        return {}, text
    return {k.strip(): v.strip().strip("\"'") for k, v in pairs}, text[m.end() :]


def parse_markdown(content: bytes) -> Parsed:
    meta, text = front_matter(content.decode("utf-8", "replace"))
    out = Parsed(text=text, meta=meta)
    held: list[str] = []
    code: list[str] | None = None

    def close() -> None:
        body = " ".join(x.strip() for x in held).strip()
        if body:
            out.blocks.append(("text", body))
        held.clear()

    lines = text.splitlines()
    k = 0
    while k < len(lines):
        line = lines[k]
        if line.strip().startswith("```"):
            if code is None:
                close()
                code = []
            else:
                out.blocks.append(("code", "\n".join(code)))
                code = None
        elif code is not None:
            code.append(line)
        elif m := re.match(r"(#{1,6})\s+(.+)", line):
            close()
            out.blocks.append(("heading", m.group(2).strip()))
            if len(m.group(1)) == 1 and out.title is None:
                out.title = m.group(2).strip()
        elif "|" in line and k + 1 < len(lines) and re.match(r"^\s*\|?[\s:|-]*-[\s:|-]*$", lines[k + 1]) and "|" in lines[k + 1]:
            close()
            cells = lambda x: [c.strip() for c in x.strip().strip("|").split("|")]
            head = cells(line)
            k += 2
            rows = []
            while k < len(lines) and "|" in lines[k]:
                rows.append(cells(lines[k]))
                k += 1
            out.tables.append({"headers": head, "rows": rows, "caption": None})
            continue
        elif line.strip():
            held.append(line)
        else:
            close()
        k += 1
    close()
    if code:
        out.blocks.append(("code", "\n".join(code)))
    return out


def parse_pages(content: bytes, max_pages: int | None = None) -> Parsed:
    """Extracted page text with form feeds between pages: a block for each page that is not blank."""
    pages = content.decode("utf-8", "replace").split("\f")[:max_pages]
    bodies = [p.strip() for p in pages if p.strip()]
    return Parsed("\n\n".join(bodies), None, [("text", b) for b in bodies], meta={"page_count": str(len(bodies))})


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def parse_docx(content: bytes) -> Parsed:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    text = lambda e: "".join(t.text or "" for t in e.iter(f"{_W}t"))
    out = Parsed()
    body = root.find(f"{_W}body")
    for e in body if body is not None else ():
        if e.tag == f"{_W}p" and text(e).strip():
            out.blocks.append(("text", text(e).strip()))
        elif e.tag == f"{_W}tbl":
            rows = [[text(c).strip() for c in r.iter(f"{_W}tc")] for r in e.iter(f"{_W}tr")]
            if rows:
                out.tables.append({"headers": rows[0], "rows": rows[1:], "caption": None})
    out.text = "\n".join(b for _, b in out.blocks)
    return out


def parse_text(content: bytes) -> Parsed:
    text = content.decode("utf-8", "replace")
    return Parsed(text, None, [("text", text)] if text.strip() else [])


#: The extension point: extension -> parser; others are read as text.
PARSERS: dict[str, Callable[[bytes], Parsed]] = {
    "html": parse_html,
    "htm": parse_html,
    "md": parse_markdown,
    "markdown": parse_markdown,
    "pdf": parse_pages,
    "docx": parse_docx,
    "txt": parse_text,
}


def table_text(headers: list[str], rows: list[list[str]], caption: str | None = None) -> str:
    head = " | ".join(headers)
    return "\n".join([*([caption] if caption else []), head, "-" * len(head), *[" | ".join(r) for r in rows]])


_PARSED = "text string, title string, blocks array<struct<kind:string,body:string>>, tables array<struct<headers:array<string>,rows:array<array<string>>,caption:string>>, links array<string>, meta map<string,string>"
_ARROW = pa.schema(
    [
        ("text", pa.string()),
        ("title", pa.string()),
        ("blocks", pa.list_(pa.struct([("kind", pa.string()), ("body", pa.string())]))),
        ("tables", pa.list_(pa.struct([("headers", pa.list_(pa.string())), ("rows", pa.list_(pa.list_(pa.string()))), ("caption", pa.string())]))),
        ("links", pa.list_(pa.string())),
        ("meta", pa.map_(pa.string(), pa.string())),
    ]
)


#: Bytes that a worker parses at a time.
PARSE_BYTES = 1_000_000


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows in order, so many at a time that their contents (column 1) have at most ``PARSE_BYTES``; a longer one alone."""
    at, held = 0, 0
    for row, size in enumerate(pc.binary_length(batch.column(1)).to_pylist()):
        if row > at and held + (size or 0) > PARSE_BYTES:
            yield batch.slice(at, row - at)
            at, held = row, 0
        held += size or 0
    if at < batch.num_rows:
        yield batch.slice(at)


def parse(files: DataFrame, id_col: Column, content: Column, extension: Column) -> DataFrame:
    """(source_id, text, title, blocks, tables, links, meta): the parser of each row's extension; NULs go.

    A worker parses ``PARSE_BYTES`` at a time, or one row, so its memory is that of the longest file and not of a batch.
    """
    bound_batches(files.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in _slices(whole)):
            found = [PARSERS.get(e or "", parse_text)(c or b"") for c, e in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            rows = [
                {"text": p.text.replace("\0", ""), "title": p.title, "blocks": [{"kind": k, "body": b.replace("\0", "")} for k, b in p.blocks], "tables": p.tables, "links": p.links, "meta": list(p.meta.items())}
                for p in found
            ]
            out = pa.RecordBatch.from_pylist(rows, schema=_ARROW)
            yield pa.RecordBatch.from_arrays([batch.column(0), *out.columns], names=["source_id", *_ARROW.names])

    part = files.select(id_col.alias("source_id"), content.cast("binary").alias("content"), extension.alias("extension"))
    return part.mapInArrow(work, f"source_id {part.schema['source_id'].dataType.simpleString()}, {_PARSED}")
