"""Parsers on composed files, the object store, and the extension points for jobs, access rows and reports."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import filters as fl
from ..operators import chunking, reporting
from ..sources import parsers
from ..sources.tables import DOCUMENTS_SQL as D, EVENTS_SQL as E, documents, event_stream, events, read
from ..streaming import jobs
from .catalog import query
from .pipelines import _scratch
from .retrieval import MEMBER, OWNER, _access_sql


def _turn() -> tuple[Column, Column]:
    """A turn's number as text, and its role: what the composed files hold."""
    return F.col("turn").cast("string"), F.col("role")


def composed(spark: SparkSession, sf_dir: str, content: Column, extension: str) -> DataFrame:
    """A file for each conversation turn, parsed."""
    rows = read(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("key"), content.alias("content"))
    out = parsers.parse(rows, F.to_json("key"), F.col("content"), F.lit(extension))
    key = F.from_json("source_id", "conv_id bigint, turn bigint")
    return out.withColumns({"conv_id": key["conv_id"], "turn": key["turn"]})


@query(
    "s08_html_tables",
    """SELECT conv_id, turn, 'cap' AS caption, CASE turn % 3 WHEN 0 THEN 'a,b' WHEN 1 THEN 'c,d' ELSE role || ',' || turn END AS headers,
    CASE turn % 3 WHEN 0 THEN role || ',' || turn || ';x,y' WHEN 1 THEN role || ',' || turn || ';x,y' ELSE 'x,y' END AS cells FROM conversations""",
)
def s08(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers from the head, from the first row of header cells only, or from the first row."""
    turn, role = _turn()
    row = F.concat(F.lit("<tr><td>"), role, F.lit("</td><td>"), turn, F.lit("</td></tr>"))
    last = F.lit("<tr><td>x</td><td>y</td></tr></table>")
    start = F.lit("<table><caption>cap</caption>")
    headed = F.concat(start, F.lit("<thead><tr><td>a</td><td>b</td></tr><tr><th>skip</th></tr></thead><tbody>"), row, F.lit("</tbody>"), last)
    celled = F.concat(start, row, F.lit("<tr><th>c</th><th>d</th></tr>"), last)
    kind = F.col("turn") % 3
    parsed = composed(spark, sf_dir, F.when(kind == 0, headed).when(kind == 1, celled).otherwise(F.concat(start, row, last)), "html")
    t = parsed.select("conv_id", "turn", F.explode("tables").alias("t"))
    cells = F.array_join(F.transform("t.rows", lambda r: F.array_join(r, ",")), ";")
    return t.select("conv_id", "turn", "t.caption", F.array_join("t.headers", ",").alias("headers"), cells.alias("cells"))


@query("s09_html_body_text", "SELECT conv_id, turn, role || chr(10) || 'bold' || chr(10) || turn || ' end' AS body FROM conversations")
def s09(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn, role = _turn()
    page = F.concat(F.lit("<body><script>x()</script><p> "), role, F.lit(" <b>bold</b></p>\n<style>p{}</style><div>"), turn, F.lit(" end</div></body>"))
    return composed(spark, sf_dir, page, "htm").select("conv_id", "turn", F.col("text").alias("body"))


@query(
    "s10_s11_markdown",
    """SELECT conv_id, turn, 'Title ' || turn AS title, CASE WHEN turn % 2 = 0 THEN role END AS author,
    'heading:Title ' || turn || ';text:one ' || role || ' two;code:x = ' || turn AS blocks, 'k,v;' || role || ',' || turn AS cells FROM conversations""",
)
def s10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Front matter, where there is some, headings, paragraphs, code and tables."""
    turn, role = _turn()
    matter = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("---\nauthor: "), role, F.lit("\n---\n"))).otherwise("---\nno pairs\n---x\n\n")
    body = F.concat(F.lit("# Title "), turn, F.lit("\none "), role, F.lit("\ntwo\n\n```\nx = "), turn, F.lit("\n```\n| k | v |\n|---|---|\n| "), role, F.lit(" | "), turn, F.lit(" |\n"))
    parsed = composed(spark, sf_dir, F.concat(matter, body), "md")
    own = F.filter("blocks", lambda b: ~b["body"].startswith("---"))
    grid = F.transform("tables", lambda t: F.concat_ws(";", F.array_join(t["headers"], ","), F.array_join(F.transform(t["rows"], lambda r: F.array_join(r, ",")), ";")))
    return parsed.select(
        "conv_id", "turn", "title", F.col("meta")["author"].alias("author"), F.array_join(F.transform(own, lambda b: F.concat(b["kind"], F.lit(":"), b["body"])), ";").alias("blocks"), F.array_join(grid, "").alias("cells")
    )


@query("s13_docx", "SELECT conv_id, turn, 'Hello ' || role || chr(10) || 'turn ' || turn AS body, 'h' AS headers, role AS cells FROM conversations")
def s13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word files of a paragraph in two runs, another one, and a table."""
    turn, role = _turn()
    space = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"

    @F.pandas_udf("binary")
    def zipped(xml: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(x: str) -> bytes:
            buffer = io.BytesIO()
            with zipfile.ZipFile(buffer, "w") as z:
                z.writestr("word/document.xml", x)
            return buffer.getvalue()

        for part in xml:
            yield part.map(one)

    run = lambda c: F.concat(F.lit("<w:r><w:t>"), c, F.lit("</w:t></w:r>"))
    cell = lambda c: F.concat(F.lit("<w:tr><w:tc><w:p>"), run(c), F.lit("</w:p></w:tc></w:tr>"))
    xml = F.concat(
        F.lit(f'<w:document xmlns:w="{space}"><w:body><w:p>'), run(F.lit("Hello ")), run(role), F.lit("</w:p><w:p>"), run(F.concat(F.lit("turn "), turn)), F.lit("</w:p><w:tbl>"), cell(F.lit("h")), cell(role), F.lit("</w:tbl></w:body></w:document>")
    )
    parsed = composed(spark, sf_dir, zipped(xml), "docx")
    t = F.get("tables", F.lit(0))
    return parsed.select("conv_id", "turn", F.col("text").alias("body"), F.array_join(t["headers"], ",").alias("headers"), F.array_join(F.flatten(t["rows"]), ",").alias("cells"))


@query("c13_markdown_tables", "SELECT conv_id, turn, CASE WHEN turn % 3 <> 2 THEN 'a | b' || chr(10) || role || ' | ' || turn END AS content FROM conversations WHERE turn % 3 <> 2")
def c13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three piped lines with a rule make a table; fewer, or none, do not and leave no table chunk."""
    turn, role = _turn()
    table = F.concat(F.lit("| a | b |\n|---|---|\n| "), role, F.lit(" | "), turn, F.lit(" |"))
    rows = read(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("key"), F.when(F.col("turn") % 3 == 2, "| a | b |\nno rule").otherwise(table).alias("text"))
    found = chunking.chunk(rows, "mixed", id_col="key").filter("kind = 'table' and content like 'a | b%'")
    return found.select("doc_id.conv_id", "doc_id.turn", "content")


@query("c20_strategy_names", "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'qa' WHEN 1 THEN 'semantic' WHEN 2 THEN 'tabular' WHEN 3 THEN 'auto' ELSE 'recursive' END AS strategy FROM events")
def c20(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.element_at(F.array(*map(F.lit, (" FAQ", "Sentence", "csv", "odd", "recursive"))), (F.col("event_id") % 5 + 1).cast("int"))
    name = F.lower(F.trim(raw))
    known = [x for k, v in chunking.ALIASES.items() for x in (F.lit(k), F.lit(v))]
    named = F.coalesce(F.element_at(F.create_map(*known), name), name)
    return read(spark, sf_dir, "events").select("event_id", F.when(named.isin(*chunking.STRATEGIES), named).otherwise("auto").alias("strategy"))


@query("c18_c19_auto_by_file", "SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'table' ELSE 'text' END AS kind FROM conversations")
def c18(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The extension takes part in the choice: rows of a csv file are a table, the same lines without it are text."""
    turn, role = _turn()
    text = F.concat(F.lit("a,b\n"), role, F.lit(","), turn)
    rows = read(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("key"), text.alias("text"), F.when(F.col("turn") % 3 == 0, "CSV").otherwise("txt").alias("ext"))
    chunks = chunking.chunk(rows, "auto", id_col="key", extension=F.col("ext"))
    headed = F.col("content").startswith("a | b")
    return chunks.select("doc_id.conv_id", "doc_id.turn", F.when(headed, "table").otherwise("text").alias("kind"))


@query("f24_request_filter", f"WITH {D} SELECT doc_id FROM d WHERE lang IN ('en', 'de') AND list_has_any(allowed_groups, ['g1'])")
def f24(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A caller's filter; the tenant in it is not the caller's choice and is left out."""
    d = documents(spark, sf_dir)
    asked = fl.parse_request({"lang": ["en", "de"], "allowed_groups": "g1", "tenant_id": "t9"})
    return asked.apply(d).select("doc_id")


@query("f25_request_bounds", "SELECT doc_id, octet_length(encode(text)) BETWEEN 1 AND 2000 AND (doc_id % 7 = 0 OR doc_id % 120 BETWEEN 1 AND 100) AND doc_id % 11 / 10.0 <= 1 AS valid FROM documents")
def f25(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    valid = fl.within_bounds(F.col("text"), F.when(i % 7 != 0, i % 120), F.lit(None).cast("int"), (i % 11) / 10.0)
    return read(spark, sf_dir, "documents").select("doc_id", valid.alias("valid"))


# --- objects -------------------------------------------------------------------------------------


def _store(spark: SparkSession, sf_dir: str) -> str:
    """Nations as objects, some put twice, and the first region's copied."""
    path = _scratch(spark, "objects")
    n = read(spark, sf_dir, "nation")
    key = F.concat(F.lit("in/"), F.col("n_regionkey").cast("string"), F.lit("/"), F.lower("n_name"), F.when(F.col("n_nationkey") % 2 == 0, ".txt").otherwise(".bin"))
    parsers.put_objects(n.select(key.alias("key"), F.col("n_name").alias("content")), path)
    parsers.put_objects(n.filter("n_nationkey % 5 = 0").select(key.alias("key"), F.lit("again").alias("content")), path)
    parsers.copy_objects(spark, path, "in/0/", "out/")
    return path


_OBJECTS = """o AS (SELECT 'in/' || n_regionkey || '/' || lower(n_name) || CASE WHEN n_nationkey % 2 = 0 THEN '.txt' ELSE '.bin' END AS key,
  CASE WHEN n_nationkey % 5 = 0 THEN 'again' ELSE n_name END AS content FROM nation), a AS (SELECT * FROM o UNION ALL SELECT 'out/' || substr(key, 6), content FROM o WHERE starts_with(key, 'in/0/'))"""


@query("k15_put_and_copy", f"WITH {_OBJECTS} SELECT key, content FROM a")
def k15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsers.objects_of(spark, _store(spark, sf_dir)).select("key", F.col("content").cast("string").alias("content"))


@query("s03_s17_list_by_prefix", f"WITH {_OBJECTS} SELECT key FROM a WHERE starts_with(key, 'in/') AND ends_with(key, '.txt') ORDER BY key LIMIT 4 OFFSET 4")
def s17(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of a prefix."""
    objects = parsers.objects_of(spark, _store(spark, sf_dir))
    first = parsers.list_objects(objects, "in/", None, 4, ("TXT",))
    last = first.agg(F.max("key")).first()[0]  # the page's marker
    return parsers.list_objects(objects, "in/", last, 4, ("txt",)).select("key")


@query("s02_s18_fetch", f"WITH {_OBJECTS}, w(key) AS (SELECT DISTINCT key FROM a WHERE starts_with(key, 'out/') UNION ALL SELECT 'out/none.txt') SELECT w.key, content, a.key IS NOT NULL AS found FROM w LEFT JOIN a ON a.key = w.key")
def s02(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wanted keys with their content; one that is not there is marked."""
    objects = parsers.objects_of(spark, _store(spark, sf_dir)).withColumn("found", F.lit(True))
    wanted = objects.filter(F.col("key").startswith("out/")).select("key").unionAll(spark.createDataFrame([("out/none.txt",)], "key string"))
    return wanted.join(objects, "key", "left").select("key", F.col("content").cast("string").alias("content"), F.coalesce("found", F.lit(False)).alias("found"))


# --- extension points ----------------------------------------------------------------------------


@query("u03_job_handlers", "SELECT CASE WHEN event_type IN ('click', 'error') THEN event_type ELSE 'dead' END AS handled, count(*) AS n, sum(CASE WHEN event_type = 'error' THEN 2 ELSE 1 END)::BIGINT AS weight FROM events GROUP BY 1")
def u03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two kinds of events have handlers; the others are dead letters."""
    path = _scratch(spark, "jobs")
    handlers = {"click": lambda b: b.select("event_id", F.lit(1).alias("weight")), "error": lambda b: b.select("event_id", F.lit(2).alias("weight"))}
    jobs.run_handlers(event_stream(spark, sf_dir), "event_type", handlers, path, _scratch(spark, "state")).awaitTermination()
    parts = [spark.read.parquet(f"{path}/{k}").select(F.lit(k).alias("handled"), "weight") for k in handlers]
    dead = spark.read.parquet(f"{path}/dead").select(F.lit("dead").alias("handled"), F.lit(1).alias("weight"))
    rows = parts[0].unionAll(parts[1]).unionAll(dead)
    return rows.groupBy("handled").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight"))


_TURNS = """r AS (SELECT conv_id, turn, 't' || (conv_id % 4) AS tenant_id, CASE role WHEN 'user' THEN 'private' WHEN 'system' THEN 'tenant' ELSE 'group' END AS visibility, 'u' || (conv_id % 7) AS owner_id,
  CASE WHEN turn % 2 = 0 THEN ['g1'] ELSE [] END::VARCHAR[] AS allowed_groups, []::VARCHAR[] AS allowed_users, []::VARCHAR[] AS denied_users, []::VARCHAR[] AS denied_groups FROM conversations)"""


@query("u04_acl_rows", f"WITH {_TURNS} SELECT conv_id, turn, {_access_sql(MEMBER, True)} AS member, {_access_sql(OWNER, True)} AS owner FROM r")
def u04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns under the access rules."""
    role = F.col("role")
    rows = fl.acl_rows(
        read(spark, sf_dir, "conversations"),
        {
            "tenant_id": F.concat(F.lit("t"), (F.col("conv_id") % 4).cast("string")),
            "visibility": F.when(role == "user", "private").when(role == "system", "tenant").otherwise("group"),
            "owner_id": F.concat(F.lit("u"), (F.col("conv_id") % 7).cast("string")),
            "allowed_groups": F.when(F.col("turn") % 2 == 0, F.array(F.lit("g1"))),
        },
    )
    return rows.select("conv_id", "turn", fl.acl_can_access(MEMBER).alias("member"), fl.acl_can_access(OWNER).alias("owner"))


@query("u05_reporters", f"WITH {E}, m AS (SELECT model, count(*) AS n FROM e GROUP BY 1) SELECT 'csv' AS report, model || ':' || n AS line FROM m UNION ALL SELECT 'json', model || ':' || n FROM m UNION ALL SELECT 'markdown', '| ' || model || ' | ' || n || ' |' FROM m")
def u05(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One frame of metrics through three reporters, read back."""
    path = _scratch(spark, "reports")
    metrics = events(spark, sf_dir).groupBy("model").agg(F.count(F.lit(1)).alias("n"))
    reporting.report(metrics, path, ["json", "csv", "markdown"])
    line = F.concat("model", F.lit(":"), F.col("n").cast("string")).alias("line")
    both = [(k, spark.read.schema("model string, n bigint").option("header", True).format(k).load(f"{path}/{k}").select(line)) for k in ("csv", "json")]
    both.append(("markdown", spark.read.text(f"{path}/markdown").select(F.col("value").alias("line"))))
    parts = [frame.select(F.lit(k).alias("report"), "line") for k, frame in both]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])
