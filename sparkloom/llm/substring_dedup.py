"""Repeated passages by super-k-mer partitioning."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from .removal import filter_of, survives
from .scratch import materialize, temporary
from .words import WordHashes, hash_words, small_batches, texts_of, window_hashes

WINDOW = 13
#: Words of a minimiser.
MINIMISER = 3
#: Text bytes for each bucket, on average; buckets grow with the input.
BUCKET_BYTES = 5_000_000
#: Words that a map task combines before it sends on.
CHUNK_WORDS = 300_000
#: Stands for a null id: after all others.
LAST = (1 << 63) - 1


class _Exact(dict):
    """word -> number, the same for equal words only."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self)
        return value

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.int32, count=len(words))


_BASE = np.uint64(0xD6E8FEB86659FD93)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _powers(n: int, _kept: list[np.ndarray] = [np.ones(1, np.uint64)] * 2) -> list[np.ndarray]:  # noqa: B006  kept by the worker
    """Powers of the base and of its inverse, modulo 2**64."""
    if len(_kept[0]) < n:
        for k, x in enumerate((_BASE, _BASE_INVERSE)):
            steps = np.full(n + n // 4, x, np.uint64)
            steps[0] = 1
            _kept[k] = np.cumprod(steps)
    return _kept


def _window_keys(ids: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """A rolling 64-bit hash of the windows that start at ``at``; only those in one array can be compared."""
    power, inverse = _powers(len(ids) + 1)
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(32)
    total = np.zeros(len(ids) + 1, np.uint64)
    np.cumsum(mixed * power[: len(ids)], out=total[1:])
    return (total[at + size] - total[at]) * inverse[at]


def _first_of_window(docs: np.ndarray, ids: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """For each window (document, start in ``ids``) the smallest document that holds the same words.

    Sorting brings equal hashes together; neighbours are then compared word by
    word, so equal hashes of different words part.
    """
    if not len(at):
        return docs
    keys = _window_keys(ids, at, size)
    order = np.argsort(keys)
    h = keys[order]
    new = np.ones(len(order), bool)
    twin = np.flatnonzero(h[1:] == h[:-1])
    if len(twin):
        a, b = at[order[twin]], at[order[twin + 1]]
        same = np.ones(len(twin), bool)
        for j in range(size):
            same &= ids[a + j] == ids[b + j]
        new[twin[same] + 1] = False
    first = np.minimum.reduceat(docs[order], np.flatnonzero(new))[np.cumsum(new) - 1]
    out = np.empty_like(docs)
    out[order] = first
    return out


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    return edge[::2], edge[1::2] - edge[::2]


def _minimisers(grams: np.ndarray, span: int) -> np.ndarray:
    """Position of the smallest of each ``span`` consecutive gram hashes, the leftmost of equals."""
    n = len(grams) - span + 1
    best, where = grams[:n].copy(), np.arange(n)
    for j in range(1, span):
        less = grams[j : j + n] < best
        best[less] = grams[j : j + n][less]
        where[less] = np.flatnonzero(less) + j
    return where


#: Of each super-k-mer in a parcel: document, row key, start, windows.
_META = ("<i8", "<i4", "<i4", "<i4")


class _Cutter:
    """Cuts texts into super-k-mers; a chunk of documents at a time."""

    def __init__(self, buckets: int, size: int, minimiser: int) -> None:
        self.buckets, self.size, self.minimiser = buckets, size, minimiser
        self.cache = WordHashes()
        self.zip = zstandard.ZstdCompressor(level=3)

    def cut(self, rows: list[tuple[int, int, list[bytes]]]) -> Iterator[tuple]:
        """rows: (document, row key, words).  Yields (bucket, document, row key, start, windows, packed or None)."""
        size = self.size
        exact = _Exact()
        lengths = np.array([len(r[2]) for r in rows])
        ids = np.concatenate([exact.numbers(r[2]) for r in rows])
        hashes = hash_words(list(exact), self.cache)[ids]
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        owner = np.repeat(np.arange(len(rows)), lengths)
        n = len(ids) - size + 1
        whole = owner[:n] == owner[size - 1 : size - 1 + n]
        at = np.flatnonzero(whole)
        docs = np.array([r[0] for r in rows], dtype=np.int64)
        mine = docs[owner[at]]
        later = mine > _first_of_window(mine, ids, at, size)
        gone = np.zeros(len(hashes) + 1, bool)
        gone[at[later]] = True
        # Known already here: a smaller document of this chunk has the window.
        starts, counts = _runs(gone)
        for s, n in zip(starts, counts, strict=True):
            k = owner[s]  # no run crosses a document's end: its last words start no window
            yield (-1 - (rows[k][0] % self.buckets), rows[k][0], rows[k][1], int(s - offsets[k]), int(n), None)
        left = np.zeros(len(hashes) + 1, bool)
        left[at[~later]] = True
        grams = window_hashes(hashes, self.minimiser)
        where = _minimisers(grams, size - self.minimiser + 1) if len(grams) else np.empty(0, np.int64)
        todo = np.flatnonzero(left[: len(where)]) if len(where) else np.empty(0, np.int64)
        if not len(todo):
            return
        change = np.ones(len(todo), bool)
        change[1:] = (todo[1:] != todo[:-1] + 1) | (where[todo[1:]] != where[todo[:-1]]) | (owner[todo[1:]] != owner[todo[:-1]])
        heads = np.flatnonzero(change)
        ends = np.append(heads[1:], len(todo))
        bucket = (grams[where[todo[heads]]] >> np.uint64(11)) % np.uint64(self.buckets)
        parcels: dict[int, list[tuple[int, int, int, int, bytes]]] = {}
        for s, n, b in zip(todo[heads].tolist(), (ends - heads).tolist(), bucket.tolist(), strict=True):
            k = owner[s]
            start = s - int(offsets[k])
            parcels.setdefault(b, []).append((rows[k][0], rows[k][1], start, n, b" ".join(rows[k][2][start : start + n + size - 1])))
        for b, items in parcels.items():
            columns = list(zip(*items, strict=True))
            meta = b"".join([np.array(c, kind).tobytes() for c, kind in zip(columns, _META, strict=False)])
            yield (b, None, None, None, len(items), self.zip.compress(meta + b"\n".join(columns[4])))


_CUT = pa.schema([("bucket", pa.int64()), ("doc", pa.int64()), ("row", pa.int64()), ("start", pa.int64()), ("n", pa.int64()), ("packed", pa.binary())])
_FLAG = pa.schema([("doc", pa.int64()), ("row", pa.int64()), ("start", pa.int64()), ("n", pa.int64())])


def _columns(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def _mark_bucket(table: pa.Table, size: int) -> pa.Table:
    """Windows of one bucket whose words also start in a smaller document, as runs; runs known already pass through."""
    packed, held = table.column("packed").to_pylist(), table.column("n").to_pylist()
    passed = table.filter(pa.compute.is_null(table.column("packed"))).select(_FLAG.names)
    unzip = zstandard.ZstdDecompressor()
    exact = _Exact()
    parts = {k: [] for k in ("doc", "row", "start", "n", "ids")}
    for blob, k in zip(packed, held, strict=True):
        if blob is None:
            continue
        data, at = unzip.decompress(blob), 0
        for name, kind in zip(("doc", "row", "start", "n"), _META, strict=True):
            parts[name].append(np.frombuffer(data, kind, k, at).astype(np.int64))
            at += k * np.dtype(kind).itemsize
        texts = data[at:].split(b"\n")
        parts["ids"].append(exact.numbers(b" ".join(texts).split(b" ")))
    if not parts["doc"]:
        return passed.cast(_FLAG)
    doc, row, start, n, ids = (np.concatenate(parts[k]) for k in ("doc", "row", "start", "n", "ids"))
    begin = np.concatenate([[0], np.cumsum(n + size - 1)])[:-1]
    kmer = np.repeat(np.arange(len(n)), n)
    inside = np.arange(len(kmer)) - np.repeat(np.cumsum(n) - n, n)
    at = begin[kmer] + inside
    later = doc[kmer] > _first_of_window(doc[kmer], ids, at, size)
    cut = later.copy()
    cut[1:] &= ~(later[1:] & later[:-1] & (kmer[1:] == kmer[:-1]))  # the first of each run
    heads = np.flatnonzero(cut)
    length = np.add.reduceat(later.astype(np.int64), heads) if len(heads) else np.empty(0, np.int64)
    found = pa.table([doc[kmer[heads]], row[kmer[heads]], start[kmer[heads]] + inside[heads], length], schema=_FLAG)
    return pa.concat_tables([passed.cast(_FLAG), found])


def repeated_windows(docs: DataFrame, size: int = WINDOW, minimiser: int = MINIMISER, bucket_bytes: int = BUCKET_BYTES, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """(doc, row, start, n): runs of windows of ``docs(doc, row, text)`` that also start in a smaller document.

    Map tasks compare the documents of a chunk with each other first, so that a
    passage of a third of all documents leaves each chunk once.  What is left
    travels as super-k-mers: consecutive windows with one minimiser are one
    packed string in that minimiser's bucket, and equal windows have equal
    minimisers.  There sorting finds each window's smallest document exactly.
    """
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, math.ceil(total / bucket_bytes))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = _Cutter(buckets, size, minimiser)
        rows: list[tuple[int, int, list[bytes]]] = []
        words = 0
        for batch in small_batches(batches):
            doc, row = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for d, r, text in zip(doc, row, texts_of(batch, "text"), strict=True):
                w = (text or b"").split()
                if len(w) < size:
                    continue
                rows.append((d, r, w))
                words += len(w)
                if words >= chunk_words:
                    if out := list(cutter.cut(rows)):
                        yield _columns(out, _CUT)
                    rows, words = [], 0
        if rows and (out := list(cutter.cut(rows))):
            yield _columns(out, _CUT)

    cuts = docs.select("doc", "row", "text").mapInArrow(cut, "bucket bigint, doc bigint, row bigint, start bigint, n bigint, packed binary")
    return cuts.groupBy("bucket").applyInArrow(lambda t: _mark_bucket(t, size), "doc bigint, row bigint, start bigint, n bigint")


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = WINDOW,
    minimiser: int = MINIMISER,
    digests: bool = False,
    bucket_bytes: int = BUCKET_BYTES,
    chunk_words: int = CHUNK_WORDS,
) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text or with ``digests`` kept_sha256), one row for each input row.

    Removes every word that is covered by a window of ``size`` words which also
    starts in a document with a smaller id.  Null text has no words; a null id
    counts as larger than all others and keeps its own row; rows with one id
    are no smaller than each other, so repeated rows fare alike (rows of one id
    are told apart by a 32-bit hash of the text); texts shorter
    than a window stay whole; an empty table gives an empty result.
    """
    part = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(id_col).cast("bigint"), F.lit(LAST)).alias("doc"),
        F.hash(F.col(text_col)).cast("bigint").alias("row"),
        F.col(text_col).alias("text"),
    )
    with temporary(docs.sparkSession) as write:
        runs = write(repeated_windows(part, size, minimiser, bucket_bytes, chunk_words), "repeat-runs")
        # As long as a text has windows at most.
        spans = runs.groupBy("doc", "row").agg(F.collect_set(F.struct(F.col("start").cast("int").alias("start"), F.col("n").cast("int").alias("n"))).alias("spans"))
        spans = materialize(spans, "repeat-spans")
    # Texts without repeats stay in their task: the filter is sized by their count, and what it lets through by chance joins nothing.
    fitted = filter_of(spans.withColumn("key", F.xxhash64("doc", "row")), "key", materialize, "repeat-filter")
    keyed = survives(part.withColumn("key", F.xxhash64("doc", "row")), "key", *fitted)

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            n_words, n_removed, kept = [], [], []
            for text, spans in zip(texts_of(batch, "text"), batch.column(2).to_pylist(), strict=True):
                words = (text or b"").split()
                n_words.append(len(words))
                if spans:
                    edge = np.zeros(len(words) + 1, np.int32)
                    for s in spans:
                        edge[s["start"]] += 1
                        edge[s["start"] + s["n"] + size - 1] -= 1
                    gone = np.cumsum(edge)[:-1] > 0
                    words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                n_removed.append(n_words[-1] - len(words))
                body = b" ".join(words)
                kept.append(hashlib.sha256(body).hexdigest() if digests else body.decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept"],
            )

    kind = part.schema["doc_id"].dataType.simpleString()
    touched = keyed.filter("__alive").join(spans, ["doc", "row"], "left").select("doc_id", "text", "spans")
    whole = keyed.filter("not __alive").select("doc_id", "text", F.lit(None).cast(spans.schema["spans"].dataType).alias("spans"))
    out = touched.unionAll(whole).mapInArrow(strip, f"doc_id {kind}, n_words bigint, n_removed bigint, kept string")
    return out.withColumnRenamed("kept", "kept_sha256" if digests else "kept_text")


#: On whole tables this takes DuckDB one row for each window.
REPEAT_SQL = r"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
k AS (SELECT r, doc_id, i, sha256(array_to_string(w[i:i+12], ' ')) AS h FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM w)),
m AS (SELECT r, i FROM (SELECT r, doc_id, i, min(doc_id) OVER (PARTITION BY h) AS f FROM k) WHERE f < doc_id),
g AS (SELECT DISTINCT r, i + j AS p FROM m, (SELECT unnest(range(13)) AS j)),
a AS (SELECT r, list(p) AS gone FROM g GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed,
       sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i)) END, ' ')) AS kept_sha256
FROM w LEFT JOIN a USING (r)
"""
