"""Approximate vector search: an inverted file with product-quantised codes, pruned lists and exact re-ranking.

Layout under ``path``::

    codes/list=<n>/      id, part, code            one byte for each ``SUB`` dimensions
    vectors/list=<n>/    id, embedding             sorted by id, read for short lists only
    lists                list, centre, parts       at most MOST_LISTS rows
    codebooks            sub, words                one row a subspace
    settings             probes, kind              one row

A search finds the lists nearest to each request, reads the codes of these
lists (a partition filter), scores them approximately, and reads the vectors of
the best few candidates alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..sources.shared import drop
from .search import QUERY_BLOCK, dot_columns, top_k

#: Vectors that centres, codebooks and the number of probes are fitted to, and lists at most.
FIT_ROWS, MOST_LISTS = 20_000, 4096
#: Dimensions that one byte of a code stands for, and code words of a subspace.
SUB, WORDS = 2, 256
#: Vectors of a list that one task scores: longer lists are split into parts.
PART_ROWS = 65_536
#: Sample requests that the number of probes is fitted to, the part of their neighbours that probed lists must hold, and how many neighbours.
FIT_REQUESTS, RECALL, NEIGHBOURS = 256, 0.97, 10
#: Candidates that are re-ranked exactly, as a multiple of the hits asked for.
SHORTLIST = 8
#: Short lists up to so many ids become literals of the scan's filter.
MOST_LITERALS = 10_000


def _lloyd(rows: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    """k-means on a bounded sample; centres without rows keep their place."""
    rng = np.random.default_rng(seed)
    centres = rows[rng.choice(len(rows), min(k, len(rows)), replace=False)]
    for _ in range(rounds):
        near = _nearest(rows, centres)
        n = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, rows)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def _gaps(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances less each row's own square."""
    return (centres**2).sum(1) - 2 * rows @ centres.T


def _nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([_gaps(rows[at : at + 4096], centres).argmin(1) for at in range(0, len(rows), 4096)] or [np.empty(0, np.int64)])


def _grid(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


@dataclass(frozen=True)
class Quantiser:
    """Centres of lists, and code words of the residuals' subspaces (the last one may be narrower)."""

    centres: np.ndarray
    words: tuple[np.ndarray, ...]

    @property
    def width(self) -> int:
        return self.centres.shape[1]

    def spans(self) -> list[slice]:
        return [slice(j, min(j + SUB, self.width)) for j in range(0, self.width, SUB)]

    def encode(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(list, code) of each row."""
        near = _nearest(rows, self.centres)
        rest = rows - self.centres[near]
        return near, np.stack([_nearest(rest[:, s], w).astype(np.uint8) for s, w in zip(self.spans(), self.words, strict=True)], axis=1)

    def decode(self, codes: np.ndarray, list_no: int) -> np.ndarray:
        return np.concatenate([w[codes[:, j]] for j, w in enumerate(self.words)], axis=1) + self.centres[list_no]


def _probes(centres: np.ndarray, sample: np.ndarray, seed: int) -> int:
    """Lists that must be probed so that they hold ``RECALL`` of the sample's own neighbours."""
    asked = sample[np.random.default_rng(seed).choice(len(sample), min(FIT_REQUESTS, len(sample)), replace=False)]
    scores = asked @ sample.T
    k = min(NEIGHBOURS, len(sample))
    best = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    places = _gaps(asked, centres).argsort(1).argsort(1)  # place of each list in a request's order
    needed = np.sort(np.take_along_axis(places, _nearest(sample, centres)[best], axis=1).ravel())
    return int(needed[min(len(needed) - 1, int(np.ceil(RECALL * len(needed))))]) + 1


def index_vectors(corpus: DataFrame, path: str, lists: int | None = None, seed: int = 7) -> None:
    """An index under ``path`` of every vector of ``corpus(id, embedding)``.

    Centres, code words and the number of lists to probe are fitted to a sample
    of at most some ``FIT_ROWS`` vectors; every vector is encoded and stored.
    Null vectors and those of another length than most are left out.
    """
    spark = corpus.sparkSession
    sizes = corpus.filter("embedding is not null").groupBy(F.size("embedding").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).limit(1).collect()
    width, n = (sizes[0]["width"], sizes[0]["count"]) if sizes else (0, 0)
    rows = corpus.filter(F.size("embedding") == width).select(F.col("id").cast("bigint").alias("id"), "embedding")
    drawn = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) < int(min(1.0, FIT_ROWS / max(1, n)) * (1 << 30))
    sample = _grid(rows.filter(drawn).select("embedding").toArrow().column(0), width) if n and width else np.zeros((0, max(1, width)))
    if not len(sample):
        sample = np.zeros((1, max(1, width)))
    lists = min(lists or max(1, min(MOST_LISTS, int(n**0.5))), len(sample))
    centres = _lloyd(sample, lists, seed)
    rest = sample - centres[_nearest(sample, centres)]
    model = Quantiser(centres, ())
    model = Quantiser(centres, tuple(_lloyd(rest[:, s], WORDS, seed + i) for i, s in enumerate(model.spans())))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near, codes = model.encode(_grid(batch.column(1), model.width))
                packed = pa.array([c.tobytes() for c in codes], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near, pa.int32()), packed], names=["id", "embedding", "list", "code"])

    kind = rows.schema["embedding"].dataType.simpleString()
    rows.mapInArrow(work, f"id bigint, embedding {kind}, list int, code binary").write.parquet(f"{path}/encoded")
    encoded = spark.read.parquet(f"{path}/encoded")
    counts = {r["list"]: r["count"] for r in encoded.groupBy("list").count().collect()}  # at most MOST_LISTS
    parts = {i: max(1, -(-counts.get(i, 0) // PART_ROWS)) for i in range(len(centres))}
    split = F.create_map(*[F.lit(x) for pair in parts.items() for x in pair])
    dealt = encoded.withColumn("part", F.pmod(F.xxhash64("id"), split[F.col("list")]).cast("int")).repartition("list", "part")
    dealt.select("id", "part", "code", "list").write.partitionBy("list").parquet(f"{path}/codes")
    dealt.select("id", "embedding", "list").sortWithinPartitions("list", "id").write.partitionBy("list").parquet(f"{path}/vectors")
    drop(spark, f"{path}/encoded")
    spark.createDataFrame([(i, [float(x) for x in c], parts[i]) for i, c in enumerate(centres)], "list int, centre array<double>, parts int").write.parquet(f"{path}/lists")
    words = [(j, [[float(x) for x in w] for w in table]) for j, table in enumerate(model.words)]
    spark.createDataFrame(words, "sub int, words array<array<double>>").write.parquet(f"{path}/codebooks")
    spark.createDataFrame([(_probes(centres, sample, seed), kind)], "probes int, kind string").write.parquet(f"{path}/settings")


def _load(spark: SparkSession, path: str) -> tuple[Quantiser, list[int], int, str]:
    found = sorted(spark.read.parquet(f"{path}/lists").collect())  # at most MOST_LISTS
    words = sorted((r["sub"], r["words"]) for r in spark.read.parquet(f"{path}/codebooks").collect())
    model = Quantiser(np.array([r["centre"] for r in found]), tuple(np.array(w) for _, w in words))
    settings = spark.read.parquet(f"{path}/settings").first()
    return model, [r["parts"] for r in found], settings["probes"], settings["kind"]


def candidates(spark: SparkSession, path: str, queries: DataFrame, short: int, probes: int | None = None) -> DataFrame:
    """(query_id, list, id, score): the best ``short`` of each request by their codes, from the lists nearest to it.

    Only codes of probed lists are read.  A list is scored part by part, and
    requests to it in blocks, so neither a long list nor a popular one is one task.
    """
    model, parts, fitted, _ = _load(spark, path)
    probes = min(len(parts), probes or fitted)
    width = model.width
    usable = queries.filter(F.size("embedding") == width).select(F.col("query_id").cast("bigint").alias("query_id"), "embedding")
    n = usable.count()
    blocks = max(1, -(-n * probes // (len(parts) * QUERY_BLOCK)))
    pieces = np.array(parts)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            best = np.argpartition(_gaps(_grid(batch.column(1), width), model.centres), probes - 1, axis=1)[:, :probes].ravel()
            owner = np.repeat(np.arange(batch.num_rows), probes)
            each = pieces[best]
            part = np.concatenate([np.arange(p) for p in each]) if len(each) else each
            owner, best = np.repeat(owner, each), np.repeat(best, each)
            columns = [pa.array(best, pa.int32()), pa.array(part, pa.int32()), batch.column(0).take(pa.array(owner)), batch.column(1).take(pa.array(owner))]
            yield pa.RecordBatch.from_arrays(columns, names=["list", "part", "query_id", "embedding"])

    kind = queries.schema["embedding"].dataType.simpleString()
    probing = usable.mapInArrow(near, f"list int, part int, query_id bigint, embedding {kind}").withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
    probed = sorted(r["list"] for r in probing.select("list").distinct().collect())  # at most MOST_LISTS
    codes = spark.read.schema("id bigint, part int, code binary, list int").parquet(f"{path}/codes").filter(F.col("list").isin(*probed))
    codes = codes.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))))

    def score(stored: pa.Table, asked: pa.Table) -> pa.Table:
        schema = pa.schema([("query_id", pa.int64()), ("list", pa.int32()), ("id", pa.int64()), ("score", pa.float64())])
        if not stored.num_rows or not asked.num_rows:
            return schema.empty_table()
        list_no = stored.column("list")[0].as_py()
        code = np.frombuffer(b"".join(stored.column("code").to_pylist()), np.uint8).reshape(stored.num_rows, -1)
        rough = model.decode(code, list_no)
        ids, names, wanted = stored.column("id").to_numpy(), asked.column("query_id").to_numpy(), _grid(asked.column("embedding"), width)
        found = []
        for at in range(0, len(names), 256):
            scores = wanted[at : at + 256] @ rough.T
            k = min(short, scores.shape[1])
            best = np.argpartition(-scores, k - 1, axis=1)[:, :k]
            owner = np.repeat(names[at : at + 256], k)
            found.append(pa.table([owner, np.full(len(owner), list_no, np.int32), ids[best.ravel()], np.take_along_axis(scores, best, axis=1).ravel()], schema=schema))
        return pa.concat_tables(found)

    keys = ["list", "part", "block"]
    met = codes.groupBy(*keys).cogroup(probing.groupBy(*keys)).applyInArrow(score, "query_id bigint, list int, id bigint, score double")
    return top_k(met, short).drop("rank")


def search_index(spark: SparkSession, path: str, queries: DataFrame, k: int, probes: int | None = None, shortlist: int | None = None) -> DataFrame:
    """(query_id, id, score, rank): nearly the best ``k`` by dot product, with exact scores.

    ``probes`` lists are looked into, by default as many as the index found
    necessary on its sample; ``shortlist`` candidates of each request (eight
    times ``k``) are re-ranked.  Requests of another length than the index's
    vectors have no hits.
    """
    short = max(k, shortlist or SHORTLIST * k)
    found = candidates(spark, path, queries, short, probes)
    kind = spark.read.parquet(f"{path}/settings").first()["kind"]
    vectors = spark.read.schema(f"id bigint, embedding {kind}, list int").parquet(f"{path}/vectors").withColumnRenamed("embedding", "stored")
    if queries.limit(MOST_LITERALS // short + 1).count() * short <= MOST_LITERALS:
        named = found.select("query_id", "list", "id").collect()  # at most MOST_LITERALS
        rows = spark.createDataFrame([tuple(r) for r in named], "query_id bigint, list int, id bigint")
        vectors = vectors.filter(F.col("list").isin(*sorted({r["list"] for r in named})) & F.col("id").isin(*sorted({r["id"] for r in named})))
        found = F.broadcast(rows)
    asked = queries.select(F.col("query_id").cast("bigint").alias("query_id"), "embedding")
    met = vectors.join(found.select("query_id", "list", "id"), ["list", "id"]).join(asked, "query_id")
    exact: Column = F.round(dot_columns("embedding", "stored"), 9)
    return top_k(met.select("query_id", "id", exact.alias("score")), k)
