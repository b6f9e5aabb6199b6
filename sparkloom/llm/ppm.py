"""Language-model scoring by prediction by partial matching over bytes."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from .scratch import materialize, temporary
from .words import WordHashes, hash_words, lowered, texts_of

#: Bytes of context of the longest trie path.
ORDER = 4
#: Text bytes in a block of documents, on average.
BLOCK_BYTES = 12_000_000
#: Symbols: byte values, then the end of a text.
END = 256
SYMBOLS = 257
#: Bytes of text whose windows are worked out at a time; a worker holds some thirty times as much.
SLICE_BYTES = 1_000_000
#: A symbol takes 9 bits of a window code; the missing bytes before a text are zeros.
BITS = 9
_HALF = 0.5

MASK = (1 << BITS) - 1
#: Key of the end token among words.
END_WORD = np.int64(-1)


def windows(texts: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Codes of (context, symbol) for each byte and end, and the texts' lengths in codes."""
    pad = b"\0" * order
    raw = np.frombuffer(pad + (b"\1" + pad).join(texts) + b"\1", np.uint8).astype(np.uint64)
    # The byte after each text becomes the end symbol; padding belongs to no text.
    lengths = np.array([len(t) + 1 for t in texts])
    ends = np.cumsum(lengths + order) - 1
    raw[ends] = END
    codes = np.zeros(len(raw) - order, np.uint64)
    for j in range(order + 1):
        codes = (codes << np.uint64(BITS)) | raw[j : len(raw) - order + j]
    keep = np.ones(len(codes), bool)
    for k in range(order):
        keep[(ends[:-1] + 1 + k) - order] = False
    return codes[keep].view(np.int64), lengths


def _slices(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    start = held = 0
    for k, t in enumerate(texts):
        held += len(t)
        if held >= SLICE_BYTES or k + 1 == len(texts):
            yield start, k + 1
            start, held = k + 1, 0


def _summed(keys: list[np.ndarray], weights: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with the sums of their weights."""
    k, w = np.concatenate(keys), np.concatenate(weights)
    if not len(k):
        return k, w
    order = np.argsort(k)
    k = k[order]
    start = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    return k[start], np.add.reduceat(w[order], start)


class _Places:
    """Open addressing: where each of some distinct keys stands."""

    def __init__(self, keys: np.ndarray) -> None:
        self.bits = max(4, int(4 * max(1, len(keys))).bit_length())
        self.keys = keys
        self.table = np.zeros(1 << self.bits, np.int32)
        taken = np.zeros(1 << self.bits, bool)
        slot, pending = self._slot(keys), np.arange(len(keys))
        while len(pending):
            free = pending[~taken[slot[pending]]]
            self.table[slot[free]] = free
            taken[slot[free]] = True
            pending = pending[self.table[slot[pending]] != pending]
            slot[pending] = (slot[pending] + 1) & (len(self.table) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def of(self, wanted: np.ndarray) -> np.ndarray:
        """Places of keys that are all there."""
        slot = self._slot(wanted)
        found = self.table[slot]
        left = np.flatnonzero(self.keys[found] != wanted)
        while len(left):
            slot[left] = (slot[left] + 1) & (len(self.table) - 1)
            found[left] = self.table[slot[left]]
            left = left[self.keys[found[left]] != wanted[left]]
        return found


def _pack(blocks: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (block, doc_id, train, text) to one row for each batch and block, lower-cased texts compressed together."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            block = batch.column(0).to_numpy(zero_copy_only=False)
            order = np.argsort(block, kind="stable")
            cut = np.flatnonzero(np.concatenate([[True], block[order][1:] != block[order][:-1]])) if len(order) else np.empty(0, np.int64)
            if not len(cut):
                continue
            offsets = pa.array(np.append(cut, len(order)), pa.int32())
            texts = [lowered(t or b"") for t in texts_of(batch, "text")]
            blobs = [pack.compress(b"".join([texts[i] for i in order[a:b]])) for a, b in zip(cut, np.append(cut[1:], len(order)), strict=True)]
            sizes = pa.array([len(texts[i]) for i in order], pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, x) for x in (batch.column(1).take(pa.array(order)), batch.column(2).take(pa.array(order)), sizes)]
            yield pa.RecordBatch.from_arrays([pa.array(block[order][cut]), *lists, pa.array(blobs, pa.binary())], names=["block", "doc_id", "train", "sizes", "packed"])

    return work


def _unpacked(table: pa.Table) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """Slices of a block: texts, and which of them are for training."""
    unzip = zstandard.ZstdDecompressor()
    for train, sizes, blob in zip(table.column("train"), table.column("sizes"), table.column("packed"), strict=True):
        data = unzip.decompress(blob.as_py())
        used = train.values.to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes.values.to_numpy(zero_copy_only=False)).tolist()
        texts = [data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        for a, b in _slices(texts):
            yield texts[a:b], used[a:b]


_STATS = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("key", pa.int64()), ("n", pa.int64())])


def _block_stats(table: pa.Table, order: int) -> Iterator[pa.Table]:
    """(block, kind, key, count in training texts) for each distinct window (kind 0) and word (kind 1) of a block."""
    block = table.column("block")[0].as_py()
    cache = WordHashes()
    keys: tuple[list[np.ndarray], ...] = ([], [])
    counts: tuple[list[np.ndarray], ...] = ([], [])
    for texts, used in _unpacked(table):
        for flag in (0, 1):
            part = [t for t, u in zip(texts, used, strict=True) if u == flag]
            if not part:
                continue
            words = hash_words([w for t in part for w in t.split()], cache).view(np.int64)
            for kind, found in enumerate((windows(part, order)[0], np.append(words, np.full(len(part), END_WORD)))):
                k, n = np.unique(found, return_counts=True)
                keys[kind].append(k)
                counts[kind].append(n * flag)
    for kind in (0, 1):
        k, n = _summed(keys[kind], counts[kind])
        yield pa.table([np.full(len(k), block), np.full(len(k), kind, np.int32), k, n], schema=_STATS)


def _level(codes: np.ndarray, n: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """At context length ``depth``: each window's place among the symbols, their counts, their context, and totals and
    distinct symbols of each context.  Contexts and symbols without training counts stay, with zeros."""
    part = codes & ((1 << (BITS * (depth + 1))) - 1)
    symbols, at = np.unique(part, return_inverse=True)
    count = np.bincount(at, weights=n, minlength=len(symbols)).astype(np.int64)
    context, of = np.unique(symbols >> BITS, return_inverse=True)
    total = np.bincount(of, weights=count, minlength=len(context))
    distinct = np.bincount(of[count > 0], minlength=len(context)).astype(np.float64)
    return at, symbols, count, of, total, distinct


def code_lengths(codes: np.ndarray, n: np.ndarray, low: dict[str, np.ndarray], order: int) -> np.ndarray:
    """log10 probability of each window's symbol after its context.

    ``codes`` are all windows of one subtree of the trie (one byte before the
    symbol), ``n`` their training counts; ``low`` has the counts at context
    lengths 0 and 1.  Escapes follow method C: a context met ``t`` times with
    ``d`` distinct symbols gives ``d / (t + d)`` to the next shorter one.  There
    the symbols that the longer context has seen are excluded, from the total
    and from the distinct symbols.
    """
    out = np.zeros(len(codes))
    open_ = np.ones(len(codes), bool)  # no probability yet
    entered = np.zeros(len(codes), bool)  # some longer context was met
    barred_total = np.zeros(len(codes))  # of the symbols excluded, their count in this context
    barred = np.zeros(len(codes))
    for depth in range(order, -1, -1):
        if depth >= 2:
            at, symbols, count, of, total, distinct = _level(codes, n, depth)
            c, t, d = count[at].astype(float), total[of[at]], distinct[of[at]]
            seen_in = np.bincount(of, weights=np.where(count > 0, _counts_below(symbols, depth, codes, n, low), 0), minlength=len(total))[of[at]]
        else:
            part = codes & ((1 << (BITS * (depth + 1))) - 1)
            c, t, d, seen_in = (low[f"{x}{depth}"][part if x == "c" else part >> BITS] for x in ("c", "t", "d", "s"))
        met = t > 0
        here = open_ & met
        free_total, free = t - np.where(entered, barred_total, 0), d - np.where(entered, barred, 0)
        whole = free_total + free
        hit = here & (c > 0)
        out[hit] += np.log10(c[hit] / whole[hit])
        open_ &= ~hit
        miss = here & (c <= 0) & (whole > 0)
        out[miss] += np.log10(free[miss] / whole[miss])
        entered |= here
        barred_total = np.where(met, seen_in, barred_total)
        barred = np.where(met, d, barred)
    rest = SYMBOLS - np.where(entered, barred, 0)
    out[open_] -= np.log10(rest[open_])
    return out


def _counts_below(symbols: np.ndarray, depth: int, codes: np.ndarray, n: np.ndarray, low: dict[str, np.ndarray]) -> np.ndarray:
    """The count of each (context, symbol) in the context without its first byte."""
    shorter = symbols & ((1 << (BITS * depth)) - 1)
    if depth - 1 < 2:
        return low[f"c{depth - 1}"][shorter]
    part = codes & ((1 << (BITS * depth)) - 1)
    keys, at = np.unique(part, return_inverse=True)
    count = np.bincount(at, weights=n, minlength=len(keys))
    return count[np.searchsorted(keys, shorter)]


def low_orders(pairs: np.ndarray, n: np.ndarray) -> dict[str, np.ndarray]:
    """Dense counts at context lengths 0 and 1 from (byte, symbol) codes: at most 257 x 512 numbers."""
    c1 = np.zeros(1 << (2 * BITS))
    c1[pairs] = n
    grid = c1.reshape(1 << BITS, 1 << BITS)
    c0 = grid.sum(0)
    return {
        "c1": c1,
        "t1": grid.sum(1),
        "d1": (grid > 0).sum(1).astype(float),
        "s1": ((grid > 0) * c0).sum(1),
        "c0": c0,
        "t0": np.array([c0.sum()]),
        "d0": np.array([float((c0 > 0).sum())]),
        "s0": np.array([0.0]),
    }


def is_held_out(id_col: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 1


def ppm_scores(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    held_out: Column | None = None,
    order: int = ORDER,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte), one row for each input row.

    The model is pretrained on all texts that are not held out (A-Z lower-cased)
    and is nowhere whole: documents are dealt into blocks of bounded size, a
    block asks for its distinct windows and words, counts are summed by key, the
    trie is worked out subtree by subtree (contexts that share their last two
    bytes), and each block gets back the code lengths of its own windows only.
    So neither driver nor any task holds the vocabulary, and what moves grows
    with the input.  The subtrees share a table of 512 x 512 low-order counts.

    ``score`` is the log10 probability of the bytes of the whole lower-cased
    text and its end.  Words are told apart by 64-bit hashes.  Null text is
    empty (one token, the end); a null id counts as an empty string for the
    split; repeated rows count each time; an empty table gives an empty result;
    without any training text all contexts are new and each symbol costs
    log10(257).
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    held = is_held_out(F.col(id_col)) if held_out is None else held_out
    total = docs.agg(F.sum(F.octet_length(F.col(text_col)) + 40)).first()[0] or 0
    blocks = max(1, math.ceil(total / block_bytes))
    rows = docs.select(
        F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(blocks)).alias("block"),
        F.col(id_col).alias("doc_id"),
        (~held).cast("int").alias("train"),
        F.col(text_col).alias("text"),
    )
    # Texts are dealt twice, packed, and never written out.
    dealt = rows.mapInArrow(_pack(blocks), f"block bigint, doc_id array<{kind}>, train array<int>, sizes array<int>, packed binary")

    def stats(table: pa.Table) -> pa.Table:
        return pa.concat_tables(_block_stats(table, order))

    asked = materialize(dealt.groupBy("block").applyInArrow(stats, "block bigint, kind int, key bigint, n bigint"), "ppm-asked")
    with temporary(spark) as write:
        grams = asked.filter("kind = 0").groupBy("key").agg(F.sum("n").alias("n"))
        grams = write(grams, "ppm-grams")
        pair = F.col("key").bitwiseAND(F.lit((1 << (2 * BITS)) - 1))
        low_rows = grams.groupBy(pair.alias("pair")).agg(F.sum("n").alias("n")).filter("n > 0").collect()  # at most 2**18 rows
        low = low_orders(np.array([r[0] for r in low_rows], np.int64), np.array([r[1] for r in low_rows], float))
        shared = spark.sparkContext.broadcast(low)

        def subtree(table: pa.Table) -> pa.Table:
            codes, n = table.column("key").to_numpy(), table.column("n").to_numpy()
            return pa.table([codes, code_lengths(codes, n.astype(float), shared.value, order)], names=["key", "cost"])

        root = F.call_function("shiftright", F.col("key"), F.lit(BITS)).bitwiseAND(F.lit((1 << (2 * BITS)) - 1))
        costs = grams.withColumn("root", root).groupBy("root").applyInArrow(subtree, "key bigint, cost double")
        costs = costs.select("key", "cost", F.lit(0).alias("kind"))
        counts = asked.filter("kind = 1").groupBy("key").agg(F.sum("n").alias("n"))
        counts = write(counts, "ppm-words")
        tokens, vocabulary = counts.filter("n > 0").agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
        model = materialize(costs.unionByName(counts.select("key", F.col("n").cast("double").alias("cost"), F.lit(1).alias("kind"))), "ppm-model")
    answered = asked.select("block", "kind", "key").join(model, ["kind", "key"]).select("block", "kind", "key", "cost")

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        cache = WordHashes()
        k = right.column("kind").to_numpy()
        key, cost = right.column("key").to_numpy(), right.column("cost").to_numpy()
        grams, terms = _Places(key[k == 0]), _Places(key[k == 1])
        gram_cost, word_n = cost[k == 0], cost[k == 1]
        word_cost = np.log10((word_n + _HALF) / (tokens + _HALF * (vocabulary + 1)))
        known = (word_n > 0).astype(np.int64)
        cols: list[list] = [[], [], [], [], []]
        for texts, _ in _unpacked(left):
            codes, lengths = windows(texts, order)
            split = [t.split() for t in texts]
            n = np.array([len(t) + 1 for t in split])
            ends = np.cumsum(n) - 1
            keys = np.full(int(n.sum()), END_WORD)
            inner = np.ones(len(keys), bool)
            inner[ends] = False
            keys[inner] = hash_words([w for t in split for w in t], cache).view(np.int64)
            at, starts = terms.of(keys), ends + 1 - n
            cols[0].append(np.add.reduceat(gram_cost[grams.of(codes)], np.cumsum(lengths) - lengths))
            cols[1].append(n)
            cols[2].append(np.add.reduceat(known[at], starts))
            cols[3].append(np.add.reduceat(word_cost[at], starts))
            cols[4].append(lengths)
        s, n, known_n, base, size = (np.concatenate(c) for c in cols)
        ids, train = (pa.concat_arrays([c.flatten() for c in left.column(x).chunks]) for x in ("doc_id", "train"))
        return pa.table(
            [ids, pa.array(train.to_numpy(zero_copy_only=False) == 0), n, known_n, np.full(len(n), tokens), base, s, -s / math.log10(2) / size],
            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"],
        )

    return (
        dealt.groupBy("block")
        .cogroup(answered.groupBy("block"))
        .applyInArrow(
            score,
            f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, bits_per_byte double",
        )
    )
