"""Texts in order without those that contain, or are contained in, an earlier one."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Classes of contained texts: least length, letters of an anchor, anchors that one window holds.  A text's first window lies within
#: any text that contains it, so the window's least anchor is one of that text's anchors too.
CLASSES = ((1, 1, 1), (8, 4, 5), (32, 8, 25))
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _hashes(points: np.ndarray, size: int) -> np.ndarray:
    h = np.full(max(0, len(points) - size + 1), size, np.uint64)
    for j in range(size):
        h = (h ^ points[j : j + len(h)]) * _ODD
        h ^= h >> np.uint64(31)
    return h


def _anchors(points: np.ndarray, size: int, window: int) -> np.ndarray:
    """The least hash of each window of ``window`` neighbours, each once: rolling minima by doubling."""
    low = _hashes(points, size)
    span = 1
    while span < window and len(low) > 1:
        step = min(span, window - span)
        low = np.minimum(low[:-step], low[step:])
        span += step
    return np.unique(low)


def _anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, id, text) to rows (key, id, class, anchor, inner): anchors a text holds, and the one it is looked for by."""
    names = ["key", "id", "class", "anchor", "inner"]
    for batch in batches:
        for r in range(batch.num_rows):
            points = np.frombuffer(batch.column(2)[r].as_py().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
            own = max(k for k, (least, _, _) in enumerate(CLASSES) if len(points) >= least)
            parts = [(k, _anchors(points, size, window), False) for k, (least, size, window) in enumerate(CLASSES) if len(points) > least]
            _, size, window = CLASSES[own]
            parts.append((own, _anchors(points[: size + window - 1], size, window), True))
            kinds = np.concatenate([np.full(len(a), k, np.int32) for k, a, _ in parts])
            inner = np.concatenate([np.full(len(a), i) for _, a, i in parts])
            anchor = np.concatenate([a for _, a, _ in parts]).view(np.int64)
            owner = pa.array(np.full(len(anchor), r))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(owner), batch.column(1).take(owner), pa.array(kinds), pa.array(anchor), pa.array(inner)], names=names)


def related(texts: DataFrame) -> DataFrame:
    """(key, low, high): pairs of ids of one key, one of whose distinct texts contains the other.

    Candidates meet through anchors: a text is looked for by the least hash of
    its first window, and every text offers the least hashes of all its
    windows, about a third to a twelfth as many as it has letters.  Pairs of
    candidates are then compared letter by letter.
    """
    kind = texts.schema["key"].dataType.simpleString()
    rows = texts.select("key", "id", "text").mapInArrow(_anchored, f"key {kind}, id bigint, class int, anchor bigint, inner boolean")
    inside = rows.filter("inner").select("key", "class", "anchor", F.col("id").alias("a"))
    around = rows.filter("not inner").select("key", "class", "anchor", F.col("id").alias("b"))
    met = inside.join(around, ["key", "class", "anchor"]).filter("a <> b").select("key", "a", "b").distinct()
    part, whole = (texts.select("key", F.col("id").alias(i), F.col("text").alias(t)) for i, t in (("a", "part"), ("b", "whole")))
    found = met.join(part, ["key", "a"]).join(whole, ["key", "b"]).filter(F.contains(F.col("whole"), F.col("part")))
    return found.select("key", F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high"))


def _resolved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs in order of (key, high, low) to the dropped ids: those related to an earlier one that stays."""
    key, dropped = None, set()
    for batch in batches:
        out_key, out_id = [], []
        for k, low, high in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if k != key:
                key, dropped = k, set()
            if low not in dropped and high not in dropped:
                dropped.add(high)
                out_key.append(k)
                out_id.append(high)
        yield pa.RecordBatch.from_arrays([pa.array(out_key, batch.schema.field(0).type), pa.array(out_id, pa.int64())], names=["key", "id"])


def first_texts(texts: DataFrame) -> DataFrame:
    """``texts(key, id, text)``, trimmed, without empty ones and those that contain, or lie in, an earlier one that stays; ids give the order in a key.

    Equal texts are settled by an aggregation; only related ids, not texts, are
    folded in order.  Null texts and keys are left out.
    """
    kind = texts.schema["key"].dataType.simpleString()
    rows = texts.select("key", F.col("id").cast("bigint").alias("id"), F.trim("text").alias("text")).filter("key is not null and text <> ''")
    first = rows.groupBy("key", F.xxhash64("text", F.length("text")).alias("h"), "text").agg(F.min("id").alias("id")).select("key", "id", "text")
    pairs = related(first)
    dropped = pairs.repartition("key").sortWithinPartitions("key", "high", "low").mapInArrow(_resolved, f"key {kind}, id bigint")
    return first.join(dropped, ["key", "id"], "left_anti")
