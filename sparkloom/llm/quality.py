"""Quality rules with adaptive thresholds from mergeable quantile sketches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .scratch import Write, materialize, temporary

WINDOW = 5
#: A sketch bucket spans this ratio: quantiles are right to 2 %.
GAMMA = 1.02
#: Groups with fewer rows use the sketch of their language, then that of all rows.
MIN_ROWS = 50
#: Quantiles of a group's sketch: its spread below and above the median.
LOW, HIGH = 0.1, 0.9
#: metric: (spreads from the median that are still allowed, limit where no level of grouping has any spread), the latter per mille
METRICS = {
    "symbols": (4.0, 100),
    "dup_lines": (4.0, 300),
    "repeats": (4.0, 100),
    "word_size": (6.0, 12000),
}
#: Metrics whose junk a base rule fails at any limit.
BASE_RULED = {"repeats"}
#: Metrics that are parts of a whole: a limit of 1,000 fails nothing.
SHARES = {"dup_lines", "repeats"}


def _repeated_words(ids: np.ndarray) -> int:
    """Words covered by windows whose exact id sequence is met twice or more."""
    n = len(ids) - WINDOW + 1
    if n < 2:
        return 0
    h = ids[:n].astype(np.uint64)
    for j in range(1, WINDOW):
        h = h * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
        h += ids[j : j + n].astype(np.uint64)
    order = np.argsort(h, kind="stable")
    g = h[order]
    twin = np.flatnonzero(g[1:] == g[:-1])
    if not len(twin):
        return 0
    a, b = order[twin], order[twin + 1]
    same = np.ones(len(twin), bool)
    for j in range(WINDOW):
        same &= ids[a + j] == ids[b + j]
    starts = np.concatenate([a[same], b[same]])
    edge = np.zeros(len(ids) + 1, np.int32)
    flags = np.zeros(n, bool)
    flags[starts] = True
    at = np.flatnonzero(flags)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    return int(np.count_nonzero(np.cumsum(edge)[:-1] > 0))


class _Ids(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self)
        return value


SIGNALS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]


def _signals(batches: Iterator[pa.RecordBatch], text_at: int, keep_text: bool) -> Iterator[pa.RecordBatch]:
    drop = bytes(i for i in range(256) if 0x80 <= i < 0xC0)  # continuation bytes: what is left counts code points
    other = bytes(i for i in range(256) if i not in b"#*$%&|<>")
    for batch in batches:
        out: list[tuple[int, ...]] = []
        for text in batch.column(text_at).cast(pa.binary()).to_pylist():
            text = text or b""
            words = text.split()
            n = len(words)
            cache = _Ids()
            ids = np.fromiter(map(cache.__getitem__, words), dtype=np.int64, count=n)
            lines = [x for x in text.split(b"\n") if x and not x.isspace()]
            chars = sum(map(len, words)) if text.isascii() else len(b"".join(words).translate(None, drop))
            out.append((n, chars, len(text.translate(None, other)), len(lines), len(lines) - len(set(lines)), _repeated_words(ids)))
        cols = np.array(out, dtype=np.int64).reshape(-1, len(SIGNALS)).T
        kept = [i for i in range(batch.num_columns) if keep_text or i != text_at]
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(i) for i in kept], *[pa.array(c) for c in cols]], names=[*[batch.schema.names[i] for i in kept], *SIGNALS]
        )


def _with_signals(rows: DataFrame, text_col: str, keep_text: bool) -> DataFrame:
    """``rows``, with or without the text, and the signals; texts stay in their task."""
    at = rows.columns.index(text_col)
    fields = [f for f in rows.schema.fields if keep_text or f.name != text_col]
    schema = StructType([*fields, *[StructField(c, LongType()) for c in SIGNALS]])
    return rows.mapInArrow(lambda batches: _signals(batches, at, keep_text), schema)


def _groups(group_cols: tuple[str, ...]) -> list[Column]:
    return [F.coalesce(F.col(g).cast("string"), F.lit("\x01none")).alias(f"g{i}") for i, g in enumerate(group_cols)]


def signals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_cols: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """(doc_id, groups..., n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words)."""
    return _with_signals(docs.select(F.col(id_col).alias("doc_id"), *_groups(group_cols), F.col(text_col).alias("text")), "text", False)


def _per_mille() -> dict[str, Column]:
    words = F.greatest("n_words", F.lit(1).cast("bigint"))
    return {
        "symbols": F.floor(F.col("n_symbols") * 1000 / words),
        "dup_lines": F.floor(F.col("n_dup_lines") * 1000 / F.greatest("n_lines", F.lit(1).cast("bigint"))),
        "repeats": F.floor(F.col("n_repeat_words") * 1000 / words),
        "word_size": F.floor(F.col("word_chars") * 1000 / words),
    }


def _bucket(value: Column) -> Column:
    return F.when(value < 1, F.lit(-1)).otherwise(F.ceil(F.log(value.cast("double")) / F.lit(float(np.log(GAMMA))))).cast("int")


def thresholds(rows: DataFrame, groups: list[str], write: Write = materialize) -> DataFrame:
    """(groups..., metric, size, p10, p50, p90) for each grouping level, from bucket counts.

    The sketch is a logarithmic histogram: counts by bucket, merged by addition
    within tasks, across tasks and from sources up to languages and to all rows.
    """
    levels = [groups[:k] for k in range(len(groups), -1, -1)]
    stacked = rows.select(
        *groups,
        F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), _bucket(v).alias("bucket")) for m, v in _per_mille().items()])).alias("x"),
    ).select(*groups, "x.metric", "x.bucket")
    finest = write(stacked.groupBy(*groups, "metric", "bucket").agg(F.count(F.lit(1)).alias("n")), "quality-sketch")
    out = None
    for level in levels:
        cells = finest.groupBy(*level, "metric", "bucket").agg(F.sum("n").alias("n"))
        lists = cells.groupBy(*level, "metric").agg(
            F.sum("n").alias("size"),
            F.array_sort(F.collect_list(F.struct("bucket", "n"))).alias("cells"),  # at most some hundred buckets
        )

        def quantile(q: float) -> Column:
            rank = F.ceil(F.col("size") * F.lit(q))
            step = F.aggregate(
                "cells",
                F.struct(F.lit(0).cast("bigint").alias("seen"), F.lit(None).cast("int").alias("at")),
                lambda a, x: F.struct(
                    (a["seen"] + x["n"]).alias("seen"), F.when(a["at"].isNull() & (a["seen"] + x["n"] >= rank), x["bucket"]).otherwise(a["at"]).alias("at")
                ),
                lambda a: a["at"],
            )
            return F.when(step < 0, F.lit(0.0)).otherwise(F.pow(F.lit(GAMMA), step.cast("double")))

        found = lists.select(
            *[F.col(g) if g in level else F.lit(None).cast("string").alias(g) for g in groups],
            "metric",
            "size",
            quantile(LOW).alias("p10"),
            quantile(0.5).alias("p50"),
            quantile(HIGH).alias("p90"),
            F.lit(len(level)).alias("level"),
        )
        out = found if out is None else out.unionAll(found)
    return out


def limits(rows: DataFrame, groups: list[str], min_rows: int = MIN_ROWS) -> DataFrame:
    """(groups..., limit of each metric), one row for each group, written to the shared folder.

    ``rows`` has the groups and the signals.  Small groups have no sketch of
    their own and take the limit of the next wider one; ``least`` and
    ``greatest`` skip its nulls.
    """
    with temporary(rows.sparkSession) as write:
        sketch = write(thresholds(rows, groups, write), "quality-quantiles")
        out = sketch.filter(F.col("level") == len(groups)).select(*groups).distinct()
        for k in range(len(groups), -1, -1):
            wide = sketch.filter((F.col("level") == k) & (F.col("size") >= (min_rows if k else 0)))
            parts = {"m": F.col("p50"), "a": F.col("p90") - F.col("p50"), "b": F.col("p50") - F.col("p10")}
            wide = wide.groupBy(*groups[:k]).agg(*[F.max(F.when(F.col("metric") == m, v)).alias(f"{n}{k}_{m}") for m in METRICS for n, v in parts.items()])
            out = out.join(wide, groups[:k], "left") if k else out.join(F.broadcast(wide), how="left")  # the last has one row

        def reach(m: str, k: int, side: str) -> Column:
            """The median and so many spreads: the widest one of this level and the wider ones."""
            spread, constant = METRICS[m]
            width = F.greatest(*[F.col(f"{side}{j}_{m}") for j in range(k + 1)]) if k else F.col(f"{side}0_{m}")
            found = F.when(width > 0, F.col(f"m{k}_{m}") + spread * width).otherwise(F.greatest(F.lit(float(constant)), f"m{k}_{m}"))
            return F.when(F.col(f"m{k}_{m}").isNotNull(), F.least(found, F.lit(1000.0)) if m in SHARES else found)

        def limit(m: str) -> Column:
            other = "a" if m in BASE_RULED else "b"
            found = F.least(reach(m, 0, "a"), reach(m, 0, other))
            for k in range(1, len(groups) + 1):
                found = F.least(reach(m, k, "a"), F.greatest(reach(m, k, other), found))
            return found.alias(f"limit_{m}")

        return materialize(out.select(*groups, *[limit(m) for m in METRICS]), "quality-limits")


def _judged(rows: DataFrame, found: DataFrame, groups: list[str]) -> DataFrame:
    """``rows`` with (base_failed, kept, reasons).  The limits are as many rows as there are groups; Spark broadcasts them by their size."""
    values = _per_mille()
    reasons = F.filter(F.array(*[F.when(values[m] > F.col(f"limit_{m}"), F.lit(m)) for m in METRICS]), lambda x: x.isNotNull())
    base = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    return rows.join(found, groups, "left").withColumns(
        {"base_failed": base, "kept": ~base & (F.size(reasons) == 0), "reasons": F.array_join(reasons, ",")}
    )


def quality_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    group_cols: tuple[str, ...] = ("lang", "source"),
    min_rows: int = MIN_ROWS,
) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, reasons).

    Base rules fail texts of under 10 words or with over 20 % of words in
    repeated windows.  Then each metric of a row is held against the limit of
    its language and source: median + 4 (word size: 6) x spread.  The spread is
    90th percentile - median, at least that of the language and that of all
    rows; only where all three are zero, as for symbols in a corpus that has
    next to none, a constant takes its place.  The limit of small groups is that
    of the language, then that of all rows.  Only what stands far out of its own
    group's distribution goes, so clean documents stay.

    Where over a tenth of a group is junk, its 90th percentile is junk as well.
    So for metrics that no base rule bounds, this limit holds only as far as the
    spread below the median (median - 10th percentile, likewise at least the
    wider groups') bears it out, or the limit of the language, and that one's
    likewise as far as the limit of all rows.  A source that is regularly high
    in a metric keeps its own limit; the tail of one that is mostly low does not
    set it.

    Null text is empty (and fails the base rules); null groups form one of their
    own; repeated rows are judged alike; an empty table gives an empty result;
    other columns are ignored, whatever their names.
    """
    rows = materialize(signals(docs, id_col, text_col, group_cols), "quality-signals")
    groups = [f"g{i}" for i in range(len(group_cols))]
    return _judged(rows, limits(rows, groups, min_rows), groups).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "reasons"
    )


def keep_good(docs: DataFrame, text_col: str = "text", group_cols: tuple[str, ...] = ("lang", "source"), min_rows: int = MIN_ROWS) -> DataFrame:
    """The rows of ``docs`` that ``quality_rules`` keeps, with all their columns.

    Each text is read once for the sketches and once to be judged where it
    lies, so rows are decided one by one and no text is shuffled.
    """
    groups = [f"g{i}" for i in range(len(group_cols))]
    found = limits(_with_signals(docs.select(*_groups(group_cols), F.col(text_col).alias("text")), "text", False), groups, min_rows)
    names = [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)], *_groups(group_cols))
    good = _judged(_with_signals(rows, names[docs.columns.index(text_col)], True), found, groups).filter("kept")
    return good.select(*[F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True)])


def quality_sql(table: str = "documents") -> str:
    """DuckDB SQL of the registered query."""
    metric_rows = {
        "symbols": "floor(n_symbols * 1000 / greatest(n_words, 1))",
        "dup_lines": "floor(n_dup_lines * 1000 / greatest(n_lines, 1))",
        "repeats": "floor(n_repeat_words * 1000 / greatest(n_words, 1))",
        "word_size": "floor(word_chars * 1000 / greatest(n_words, 1))",
    }
    union = " UNION ALL ".join(f"SELECT row_no, lang, source, '{m}' AS metric, {e} AS v FROM s" for m, e in metric_rows.items())
    spread, constant = ("CASE metric " + " ".join(f"WHEN '{m}' THEN {float(x[i])}::DOUBLE" for m, x in METRICS.items()) + " END" for i in (0, 1))
    ruled, shares = (", ".join(f"'{m}'" for m in sorted(names)) for names in (BASE_RULED, SHARES))

    def reach(k: int, side: str) -> str:
        width = f"greatest({', '.join(f't{j}.{side}' for j in range(k + 1))})" if k else f"t0.{side}"
        found = f"CASE WHEN {width} > 0 THEN t{k}.p50 + ({spread.replace('metric', 'm.metric')}) * {width} ELSE greatest({constant.replace('metric', 'm.metric')}, t{k}.p50) END"
        return f"CASE WHEN t{k}.p50 IS NOT NULL THEN CASE WHEN m.metric IN ({shares}) THEN least({found}, 1000.0) ELSE {found} END END"

    def other(k: int) -> str:
        return f"CASE WHEN m.metric IN ({ruled}) THEN {reach(k, 'a')} ELSE {reach(k, 'b')} END"

    limit = f"least({reach(0, 'a')}, {other(0)})"
    for k in (1, 2):  # nulls of small groups are skipped
        limit = f"least({reach(k, 'a')}, greatest({other(k)}, {limit}))"

    def level(name: str, keys: str, at_least: int) -> str:
        group = f"{keys}, " if keys else ""
        return f"""{name} AS (
  SELECT {group}metric, p50, p90 - p50 AS a, p50 - p10 AS b FROM (
    SELECT {group}metric, max(size) AS size,
      max(CASE WHEN run >= ceil(size * 0.1::DOUBLE) AND run - n < ceil(size * 0.1::DOUBLE) THEN q END) AS p10,
      max(CASE WHEN run >= ceil(size * 0.5::DOUBLE) AND run - n < ceil(size * 0.5::DOUBLE) THEN q END) AS p50,
      max(CASE WHEN run >= ceil(size * 0.9::DOUBLE) AND run - n < ceil(size * 0.9::DOUBLE) THEN q END) AS p90 FROM (
      SELECT {group}metric, n, CASE WHEN bucket < 0 THEN 0.0 ELSE pow({GAMMA!r}::DOUBLE, bucket::DOUBLE) END AS q,
        sum(n) OVER (PARTITION BY {group}metric ORDER BY bucket) AS run, sum(n) OVER (PARTITION BY {group}metric) AS size FROM (
        SELECT {group}metric, bucket, count(*) AS n FROM b GROUP BY ALL))
    GROUP BY ALL) WHERE size >= {at_least})"""

    return rf"""
WITH x AS (SELECT row_number() OVER () AS row_no, doc_id, coalesce(lang, chr(1) || 'none') AS lang, coalesce(source, chr(1) || 'none') AS source, coalesce(text, '') AS text FROM {table}),
w AS (SELECT row_no, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM x),
k AS (SELECT row_no, i, [w[i], w[i+1], w[i+2], w[i+3], w[i+4]] AS win FROM (SELECT row_no, w, unnest(range(1, len(w) - 3)) AS i FROM w)),
r AS (SELECT row_no, i FROM (SELECT row_no, i, count(*) OVER (PARTITION BY row_no, win) AS c FROM k) WHERE c > 1),
rw AS (SELECT row_no, count(DISTINCT i + j) AS n FROM r, (SELECT unnest(range(5)) AS j) GROUP BY 1),
ln AS (SELECT row_no, count(*) AS lines, count(*) - count(DISTINCT line) AS dup FROM (SELECT row_no, unnest(string_split(text, chr(10))) AS line FROM x)
       WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1),
s AS (SELECT x.row_no, doc_id, lang, source, len(w.w) AS n_words, length(array_to_string(w.w, '')) AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(lines, 0) AS n_lines, coalesce(dup, 0) AS n_dup_lines, coalesce(rw.n, 0) AS n_repeat_words
      FROM x JOIN w USING (row_no) LEFT JOIN ln USING (row_no) LEFT JOIN rw USING (row_no)),
m AS ({union}),
b AS (SELECT *, CASE WHEN v < 1 THEN -1 ELSE ceil(ln(v) / {float(np.log(GAMMA))!r}::DOUBLE) END AS bucket FROM m),
{level("t2", "lang, source", MIN_ROWS)},
{level("t1", "lang", MIN_ROWS)},
{level("t0", "", 0)},
bad AS (SELECT row_no, count(*) FILTER (v > {limit}) AS n FROM m
        LEFT JOIN t2 ON m.lang = t2.lang AND m.source = t2.source AND m.metric = t2.metric
        LEFT JOIN t1 ON m.lang = t1.lang AND m.metric = t1.metric LEFT JOIN t0 ON m.metric = t0.metric GROUP BY 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND bad.n = 0 AS kept
FROM s JOIN bad USING (row_no)
"""
