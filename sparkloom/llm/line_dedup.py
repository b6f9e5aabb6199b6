"""Cross-site line dedup: HyperLogLog spread with exact counts near the threshold [native]."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, functions as F

from .removal import filter_of, survives
from .scratch import materialize, temporary

MIN_SITES = 5
LG_K = 12
#: Boilerplate lines that are looked up in place, 8 bytes each in a constant of the plan; more of them meet the lines by a join.
IN_PLACE = 50_000
SPACE = " \t\n\x0b\f\r"


def _trimmed(line: Column) -> Column:
    return F.trim(line, F.lit(SPACE))


def _hashes(line: Column) -> tuple[Column, Column]:
    body = _trimmed(line)
    return F.xxhash64(body), F.xxhash64(F.lit("line"), body)


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_spread(
    docs: DataFrame,
    min_sites: int = MIN_SITES,
    lg_k: int = LG_K,
    text_col: str = "text",
    site_col: str = "source",
) -> DataFrame:
    """The boilerplate lines (h1, h2), written to the shared folder.

    One HyperLogLog sketch of sites for each line hash, merged by aggregation:
    a line met a billion times arrives as one sketch per map task.  Estimates
    within a tenth, and at least one, of the threshold are replaced by exact
    distinct counts over those lines only.
    """
    cells = docs.select(F.coalesce(F.col(site_col).cast("string"), F.lit("\x00")).alias("site"), F.explode(_lines(F.col(text_col))).alias("__line"))
    h1, h2 = _hashes(F.col("__line"))
    low = min(min_sites - 1, int(min_sites * 0.9))
    high = max(min_sites + 1, -int(-min_sites * 1.1 // 1))
    with temporary(docs.sparkSession) as write:
        seen = write(cells.filter(_trimmed(F.col("__line")) != "").select("site", h1.alias("h1"), h2.alias("h2")), "line-seen")
        spread = write(
            seen.groupBy("h1", "h2").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", lg_k)).alias("sites")).filter(F.col("sites") >= low),
            "line-spread",
        )
        exact = (
            seen.join(spread.filter(F.col("sites") <= high).select("h1", "h2"), ["h1", "h2"])
            .groupBy("h1", "h2")
            .agg(F.countDistinct("site").alias("sites"))
            .filter(F.col("sites") >= min_sites)
        )
        wide = spread.filter(F.col("sites") > high)
        return materialize(exact.select("h1", "h2").unionAll(wide.select("h1", "h2")), "line-boilerplate")


def _in_place(clean: DataFrame, bad: DataFrame, keys: int) -> DataFrame:
    """Each line is looked up in a table of slots, a constant of the plan: at most ``IN_PLACE`` numbers."""
    slots = 1 << max(4, keys.bit_length())
    table: list[list[int]] = [[] for _ in range(slots)]
    for r in bad.collect():
        table[r["h1"] % slots].append(r["h2"])
    constant = F.from_json(F.lit(json.dumps(table)), "array<array<bigint>>")

    def stays(line: Column) -> Column:
        h1, h2 = _hashes(line)
        return (_trimmed(line) == "") | ~F.array_contains(F.get(constant, F.pmod(h1, F.lit(slots)).cast("int")), h2)

    lines = _lines(F.col("text"))
    kept = clean.select("doc_id", "text", F.filter(lines, stays).alias("__kept"))
    return kept.select(
        "doc_id",
        F.size(lines).cast("bigint").alias("n_lines"),
        (F.size(lines) - F.size("__kept")).cast("bigint").alias("n_removed"),
        F.array_join("__kept", "\n").alias("clean_text"),
    )


def _by_position(clean: DataFrame, bad: DataFrame) -> DataFrame:
    """Lines meet the boilerplate by a join; texts that hold such a line then meet its positions."""
    key = F.xxhash64("doc_id", "text")
    at = clean.select("doc_id", key.alias("__row"), F.posexplode(_lines(F.col("text"))).alias("pos", "__line"))
    h1, h2 = _hashes(F.col("__line"))
    at = at.filter(_trimmed(F.col("__line")) != "").select("doc_id", "__row", "pos", h1.alias("h1"), h2.alias("h2"))
    gone = materialize(at.join(bad.hint("merge"), ["h1", "h2"], "left_semi").groupBy("__row", "doc_id").agg(F.collect_set("pos").alias("__gone")), "line-gone")
    keyed = survives(clean.withColumn("__row", key), "__row", *filter_of(gone, "__row", materialize, "line-filter"))
    marks = gone.withColumnsRenamed({"__row": "__key", "doc_id": "__id"}).hint("merge")
    touched = keyed.filter("__alive").join(marks, (F.col("__row") == F.col("__key")) & F.col("doc_id").eqNullSafe(F.col("__id")), "left").drop("__key", "__id")
    whole = keyed.filter("not __alive").withColumn("__gone", F.lit(None).cast("array<int>"))
    lines = _lines(F.col("text"))
    kept = F.filter(lines, lambda x, i: ~F.array_contains(F.col("__gone"), i))

    def shown(rows: DataFrame) -> DataFrame:
        return rows.select(
            "doc_id",
            F.size(lines).cast("bigint").alias("n_lines"),
            F.when(F.col("__gone").isNull(), 0).otherwise(F.size("__gone")).cast("bigint").alias("n_removed"),
            F.when(F.col("__gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("clean_text"),
        )

    return shown(touched).unionAll(shown(whole))


def remove_boilerplate(
    docs: DataFrame,
    min_sites: int = MIN_SITES,
    lg_k: int = LG_K,
    id_col: str = "doc_id",
    text_col: str = "text",
    site_col: str = "source",
    in_place: int = IN_PLACE,
) -> DataFrame:
    """(doc_id, n_lines, n_removed, clean_text), one row for each input row.

    Lines are split at ``\\n`` and compared after trimming white space; blank
    lines are never boilerplate.  Lines on ``min_sites`` or more sites go, the
    others stay as they are and in order.  Up to ``in_place`` boilerplate lines
    are looked up where the texts are read, and no text is shuffled; more of
    them meet the lines by a join, with the same result.

    A null site counts as one site of its own; a null text is empty; repeated
    rows each get the same result; an empty table gives an empty result; other
    columns are ignored, whatever their names.
    """
    clean = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(site_col).alias("source"))
    bad = line_spread(clean, min_sites, lg_k)
    keys = bad.count()
    return _in_place(clean, bad, keys) if keys <= in_place else _by_position(clean, bad)


LINE_SQL = rf"""
WITH l AS (
  SELECT doc_id, coalesce(source, chr(1)) AS site, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
t AS (SELECT *, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS k FROM l),
b AS (SELECT k FROM t WHERE k <> '' GROUP BY k HAVING count(DISTINCT site) >= {MIN_SITES})
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (bad) AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT bad), '')) AS clean_sha256
FROM (SELECT t.*, k <> '' AND k IN (SELECT k FROM b) AS bad FROM t) GROUP BY doc_id
"""
