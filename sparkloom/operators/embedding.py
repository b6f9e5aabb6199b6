"""Text embeddings learned from co-occurrence, and batched encoding with retries."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .search import STOP_WORDS

#: Words that get a vector, the most frequent ones: bounds the model to 5 MB of vectors and a pass to 12 MB.
MOST_WORDS, LEAST_DOCUMENTS = 20_000, 2
DIMS, EXTRA, ROUNDS = 64, 8, 3
#: Words to each side that count as context, and the power that flattens frequent contexts.
SPAN, FLAT = 4, 0.75
#: Pairs that a task holds before it counts them, 32 MB of keys.
HELD_PAIRS = 1 << 22
Encode = Callable[[list[str | None]], np.ndarray]
_TERMS, _STOP = re.compile(r"[^\W_]+|[^\w\s]+"), frozenset(STOP_WORDS)


# --- batches and retries -------------------------------------------------------------------------


def with_retries(encode: Encode, texts: list[str | None], attempts: int, wait: float, pause: Callable[[float], None] = time.sleep) -> np.ndarray:
    """``encode(texts)``; after a failure again, after waits that double, ``attempts`` times in all.  The last failure is raised."""
    for k in range(attempts):
        try:
            found = encode(texts)
            if len(found) != len(texts):
                raise ValueError(f"{len(texts)} texts gave {len(found)} vectors")
            return found
        except Exception:
            if k + 1 == attempts:
                raise
            pause(wait * 2**k)
    raise ValueError("attempts must be positive")


def embed(docs: DataFrame, encode: Encode, text_col: str = "text", most: int = 32, attempts: int = 3, wait: float = 0.1) -> DataFrame:
    """``docs`` with an ``embedding`` in place of its text: texts go to ``encode`` at most ``most`` at a time, each group with retries.

    ``encode`` is called in the tasks: a model, or a client of a service.
    """
    others = [c for c in docs.columns if c != text_col]
    schema = docs.select(*others).withColumn("embedding", F.lit(None).cast("array<float>")).schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                part = batch.slice(at, most)
                vectors = with_retries(encode, part.column(len(others)).to_pylist(), attempts, wait)
                flat = pa.array(np.asarray(vectors, np.float32).ravel())
                offsets = pa.array(np.arange(len(vectors) + 1, dtype=np.int32) * (len(flat) // max(1, len(vectors))))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(others))), pa.ListArray.from_arrays(offsets, flat)], names=[*others, "embedding"])

    return docs.select(*others, text_col).mapInArrow(work, schema)


# --- the model -----------------------------------------------------------------------------------


def terms(text: str | None) -> list[str]:
    """Lower-case runs of letters and digits without stop words, and runs of marks: these tell prose from tables, code and shouting."""
    return [w for w in _TERMS.findall((text or "").lower()) if w not in _STOP]


@dataclass(frozen=True)
class WordVectors:
    """A text's vector is the sum of its words', each by its rarity, of unit length; unknown words count nothing, a text without known words is all zeros."""

    places: dict[str, int]
    rarity: np.ndarray
    vectors: np.ndarray

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros((len(texts), self.vectors.shape[1]))
        for row, text in enumerate(texts):
            found = [self.places[w] for w in terms(text) if w in self.places]
            if found:
                places, n = np.unique(found, return_counts=True)
                total = (n * self.rarity[places]) @ self.vectors[places]
                out[row] = total / (np.linalg.norm(total) or 1.0)
        return out


def vocabulary(docs: DataFrame, most: int = MOST_WORDS, text_col: str = "text") -> tuple[list[str], np.ndarray]:
    """The words of most documents, equal ones by name, and each one's rarity ln(1 + documents / its documents)."""

    @F.arrow_udf("array<string>")
    def distinct_terms(texts: pa.Array) -> pa.Array:
        return pa.array([sorted(set(terms(t))) for t in texts.to_pylist()], pa.list_(pa.string()))

    words = docs.select(F.explode(distinct_terms(text_col)).alias("word"))
    found = words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LEAST_DOCUMENTS).orderBy(F.desc("n"), "word").limit(most).collect()
    n = docs.count()
    return [r["word"] for r in found], np.log1p(n / np.array([r["n"] for r in found] or [1], float))


def _pairs(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ordered pairs of known words at most ``SPAN`` places apart."""
    left, right = [], []
    for gap in range(1, SPAN + 1):
        a, b = ids[:-gap], ids[gap:]
        known = (a >= 0) & (b >= 0)
        left += [a[known], b[known]]
        right += [b[known], a[known]]
    return np.concatenate(left), np.concatenate(right)


def co_occurrence(docs: DataFrame, words: list[str], text_col: str = "text") -> DataFrame:
    """(word, context, n): counted in the tasks, then added up."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast({w: i for i, w in enumerate(words)})  # at most MOST_WORDS

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, size = shared.value, len(shared.value)
        keys: list[np.ndarray] = []
        held = 0

        def counts() -> Iterator[pa.RecordBatch]:
            found, n = np.unique(np.concatenate(keys), return_counts=True)
            for at in range(0, len(found), 1 << 18):
                part = found[at : at + (1 << 18)]
                yield pa.RecordBatch.from_arrays([pa.array((part // size).astype(np.int32)), pa.array((part % size).astype(np.int32)), pa.array(n[at : at + (1 << 18)].astype(np.int64))], names=["word", "context", "n"])

        for batch in batches:
            for row in range(batch.num_rows):
                kept = terms(batch.column(0)[row].as_py())
                ids = np.fromiter((places.get(w, -1) for w in kept), np.int64, len(kept))
                if len(ids) > 1:
                    a, b = _pairs(ids)
                    keys.append(a * size + b)
                    held += len(a)
                if held >= HELD_PAIRS:
                    yield from counts()
                    keys, held = [], 0
        if held:
            yield from counts()

    counted = docs.select(text_col).mapInArrow(work, "word int, context int, n bigint")
    return counted.groupBy("word", "context").agg(F.sum("n").alias("n"))


def information(pairs: DataFrame) -> DataFrame:
    """(word, contexts, values): positive mutual information, one row for each word, at most ``MOST_WORDS`` contexts."""
    sums = pairs.groupBy("word").agg(F.sum("n").cast("double").alias("total"))
    flat = sums.select(F.col("word").alias("context"), F.pow("total", F.lit(FLAT)).alias("flat"))
    whole = flat.agg(F.sum("flat").alias("whole"))
    # Sums are one row a word, at most MOST_WORDS, and one row.
    met = pairs.join(F.broadcast(sums), "word").join(F.broadcast(flat), "context").join(F.broadcast(whole))
    value: Column = F.log(F.col("n") * F.col("whole") / (F.col("total") * F.col("flat")))
    cells = met.select("word", F.struct("context", value.alias("value")).alias("cell")).filter("cell.value > 0")
    rows = cells.groupBy("word").agg(F.sort_array(F.collect_list("cell")).alias("cells"))
    return rows.select("word", F.col("cells.context").alias("contexts"), F.col("cells.value").alias("values"))


def _times(rows: DataFrame, matrix: np.ndarray) -> np.ndarray:
    """The rows' matrix times ``matrix`` (words x a few dozen): one pass; each task multiplies the rows it holds."""
    shared = rows.sparkSession.sparkContext.broadcast(matrix)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            contexts, values = batch.column(1), batch.column(2)
            out = [values[r].values.to_numpy() @ m[contexts[r].values.to_numpy()] for r in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.float64()))], names=["word", "product"])

    found = rows.mapInArrow(work, "word int, product array<double>").toArrow()  # at most MOST_WORDS rows
    shared.unpersist()
    out = np.zeros_like(matrix)
    if found.num_rows:
        out[found.column("word").to_numpy()] = found.column("product").combine_chunks().flatten().to_numpy().reshape(found.num_rows, -1)
    return out


def factors(rows: DataFrame, size: int, dims: int = DIMS, seed: int = 5) -> np.ndarray:
    """Word vectors: the randomised decomposition of the (symmetrised) matrix of ``rows``; a pass over the rows for each round."""
    rank = min(size, dims + EXTRA)
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, rank)))[0]
    for _ in range(ROUNDS):
        basis = np.linalg.qr(_times(rows, basis))[0]
    small = basis.T @ _times(rows, basis)
    values, turn = np.linalg.eigh((small + small.T) / 2)
    best = np.argsort(-values)[: min(dims, rank)]
    vectors = basis @ turn[:, best] * np.sqrt(np.maximum(values[best], 0))
    return np.pad(vectors, ((0, 0), (0, dims - vectors.shape[1])))


def fit_word_vectors(docs: DataFrame, path: str, text_col: str = "text", most: int = MOST_WORDS, dims: int = DIMS) -> None:
    """Learn from every text of ``docs`` and store the model under ``path``: one row for each word."""
    spark = docs.sparkSession
    words, rarity = vocabulary(docs, most, text_col)
    information(co_occurrence(docs, words, text_col)).write.parquet(f"{path}/information")
    rows = spark.read.parquet(f"{path}/information")
    vectors = factors(rows, len(words), dims) if words else np.zeros((0, dims))
    table = [(i, w, float(r), [float(x) for x in v]) for i, (w, r, v) in enumerate(zip(words, rarity, vectors, strict=False))]
    spark.createDataFrame(table, "place int, word string, rarity double, vector array<float>").write.parquet(f"{path}/words")


def load_word_vectors(spark: SparkSession, path: str, dims: int = DIMS) -> WordVectors:
    """The stored model; its size is bounded by ``MOST_WORDS``."""
    table = spark.read.parquet(f"{path}/words").orderBy("place").collect()
    vectors = np.array([r["vector"] for r in table]) if table else np.zeros((0, dims))
    return WordVectors({r["word"]: r["place"] for r in table}, np.array([r["rarity"] for r in table]), vectors)
