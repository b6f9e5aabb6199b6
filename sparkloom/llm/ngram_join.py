"""N-gram Jaccard join: size-aware heavy-light set similarity join."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from .components import connected_components
from .removal import filter_of, survives, without
from .scratch import Write, materialize, temporary
from .words import WordHashes, hash_words, lowered, small_batches, texts_of, window_hashes

SHINGLE = 5
#: Jaccard similarity of at least 75 / 100.
NUM, DEN = 75, 100
#: Counters of the frequency sketch: fixed, whatever the corpus.
SLOTS = 1 << 21
CHUNKS = 16
#: Smallest shingle hashes that are kept to estimate how many distinct ones there are.
SMALLEST = 4096
#: Rounds in which sets try the best member of their lists' largest component, before all pairs across components are tried.
PROBES = 1
#: Bytes of inverted lists for each bucket, on average, and entries of one list in a bucket before the list is dealt over several.
BUCKET_BYTES, HOT_LIST = 8_000_000, 100_000
#: Members that are compared with one copy of an anchor, and entries of a list that meet each other in one task.
ANCHOR_MEMBERS, BLOCK = 200, 1000
#: Texts that a worker takes apart at a time, and list entries that it packs together.
TEXTS, PACKED = 2000, 500_000
LAST = (1 << 63) - 1


def least_overlap(a: int, b: int) -> int:
    """Shared shingles that two sets of these sizes need."""
    return -(-NUM * (a + b) // (NUM + DEN))


def least_share(size: int) -> int:
    """Shared shingles that a set needs with any partner."""
    return -(-NUM * size // DEN)


def prefix_length(size: int) -> int:
    return size - least_share(size) + 1


def subset_cost(size: int) -> int:
    return sum(math.comb(size, k) for k in range(least_share(size), size + 1))


def boundary(mean_list: float) -> int:
    """Largest size for which enumerating subsets costs no more than scanning the lists of its prefix."""
    size = 1
    while subset_cost(size + 1) <= prefix_length(size + 1) * mean_list:
        size += 1
    return size


def shingles(text: bytes | None, cache: WordHashes) -> np.ndarray:
    """Sorted distinct shingle hashes; the whole sequence where words are fewer."""
    words = lowered(text or b"").split()
    if not words:
        return np.empty(0, np.uint64)
    ids = hash_words(words, cache)
    return np.unique(window_hashes(ids, min(SHINGLE, len(ids))))


def set_id(shingle_set: np.ndarray) -> int:
    value = xxhash.xxh3_64_intdigest(shingle_set.tobytes())
    return value - (1 << 64) if value >> 63 else value


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kind 0: (doc, row, set id, size).  Kind 1: (chunk of the sketch, packed counts).  Kind 2: (smallest hashes)."""
    cache = WordHashes()
    counts = np.zeros(SLOTS, np.uint32)
    least = np.empty(0, np.uint64)
    names = ["kind", "doc", "row", "sid", "size", "packed"]
    for batch in small_batches(batches, TEXTS):
        sids, sizes, fresh, low, held = [], [], [], [least], 0
        seen: set[int] = set()
        edge = least[-1] if len(least) == SMALLEST else ~np.uint64(0)
        for text in texts_of(batch, "text"):
            found = shingles(text, cache)
            sid = set_id(found) if len(found) else None
            sids.append(sid)
            sizes.append(len(found))
            if sid is not None and sid not in seen:
                seen.add(sid)
                low.append(found[: min(SMALLEST, np.searchsorted(found, edge))])
                held += len(low[-1])
                if held > 50 * SMALLEST:
                    low, held = [np.unique(np.concatenate(low))[:SMALLEST]], 0
                    edge = low[0][-1] if len(low[0]) == SMALLEST else edge
                fresh.append((found & np.uint64(SLOTS - 1)).astype(np.int32))
        least = np.unique(np.concatenate(low))[:SMALLEST]
        if fresh:
            counts += np.bincount(np.concatenate(fresh), minlength=SLOTS).astype(np.uint32)
        n = len(sids)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.zeros(n, np.int32)), batch.column(0), batch.column(1), pa.array(sids, pa.int64()), pa.array(sizes, pa.int64()), pa.nulls(n, pa.binary())],
            names=names,
        )
    if counts.any():
        task = TaskContext.get().partitionId() if TaskContext.get() else 0
        parts = [zstandard.compress(x.tobytes(), 1) for x in [*counts.reshape(CHUNKS, -1), least]]
        n = len(parts)
        kind = np.where(np.arange(n) < CHUNKS, 1, 2).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [pa.array(kind), pa.array(np.arange(n)), pa.array(np.full(n, task % 128)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array(parts, pa.binary())],
            names=names,
        )


def _joined(table: pa.Table) -> pa.Table:
    """Counts of one chunk added up (kind 1), or smallest hashes merged (kind 2): one row of bounded size."""
    parts = [zstandard.decompress(x.as_py()) for x in table.column("packed")]
    if table.column("kind")[0].as_py() == 1:
        out = np.zeros(SLOTS // CHUNKS, np.uint32)
        for x in parts:
            out += np.frombuffer(x, np.uint32)
    else:
        out = np.unique(np.concatenate([np.frombuffer(x, np.uint64) for x in parts]))[:SMALLEST]
    return table.select(["kind", "doc"]).slice(0, 1).append_column("packed", pa.array([zstandard.compress(out.tobytes(), 1)], pa.binary()))


def _distinct(least: np.ndarray) -> float:
    """Distinct hashes, from the smallest ones of all."""
    return float(len(least)) if len(least) < SMALLEST else (SMALLEST - 1) / (float(least[-1]) / 2.0**64)


def _slots(found: np.ndarray) -> np.ndarray:
    return (found & np.uint64(SLOTS - 1)).astype(np.int64)


def _order(found: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The set in the global order: rare shingles first, then by hash."""
    rank = counts[_slots(found)].astype(np.uint64)
    return found[np.argsort((rank << np.uint64(48)) | (found >> np.uint64(16)), kind="stable")]


def _subset_keys(found: np.ndarray, parts: np.ndarray) -> list[tuple[int, int, int]]:
    """(key, subset size, parts) of each subset that could be the overlap with a partner.

    A subset is in no more sets than its rarest shingle, so its list needs no more parts.
    """
    out = []
    for k in range(least_share(len(found)), len(found) + 1):
        for pick in combinations(range(len(found)), k):
            out.append((xxhash.xxh3_64_intdigest(found[list(pick)].tobytes(), seed=k), k, int(parts[list(pick)].min())))
    return out


_BUCKETS = pa.schema([("bucket", pa.int64()), ("packed", pa.binary())])
_FOUND = pa.schema([("kind", pa.int32()), ("x", pa.int64()), ("y", pa.int64()), ("size", pa.int32()), ("pos", pa.int32())])
#: key, set id, size, position in the set's order, subset size or 0, parts of the list
_ENTRY = np.dtype([("key", "<u8"), ("sid", "<i8"), ("size", "<i4"), ("pos", "<i4"), ("subset", "<i4"), ("parts", "<i4")])


def _within(a: np.ndarray, b: np.ndarray, pos_a: np.ndarray, pos_b: np.ndarray) -> np.ndarray:
    """Pairs whose sizes and positions still allow the overlap they need."""
    need = -(-NUM * (a + b) // (NUM + DEN))
    return (np.minimum(a, b) >= need) & (np.minimum(a - pos_a, b - pos_b) >= need)


def _need(a: Column, b: Column) -> Column:
    return F.floor((NUM * (a + b) + (NUM + DEN - 1)) / (NUM + DEN))


def _may_link(a: str, b: str) -> Column:
    """The same over columns of two entries of one list."""
    need = _need(F.col(f"{a}.size"), F.col(f"{b}.size"))
    return (F.least(F.col(f"{a}.size") - F.col(f"{a}.pos"), F.col(f"{b}.size") - F.col(f"{b}.pos")) >= need) & (F.least(f"{a}.size", f"{b}.size") >= need)


def _scan(table: pa.Table) -> pa.Table:
    """The lists of one bucket.  Kind 0: an entry (key, set id) of a list that several sets share.
    Kind 1: a pair to verify, an anchor and a member.  Kind 2: a link by a shared subset.
    Kind 3: the smallest set of one part of a subset's list (key, set id, size, subset size)."""
    unzip = zstandard.ZstdDecompressor()
    parts = [np.frombuffer(unzip.decompress(x.as_py()), _ENTRY) for x in table.column("packed")]
    e = np.concatenate(parts)
    e = e[np.lexsort((e["sid"], e["size"], e["key"]))] if len(e) else e
    keep = np.ones(len(e), bool)
    keep[1:] = (e["key"][1:] != e["key"][:-1]) | (e["sid"][1:] != e["sid"][:-1])
    e = e[keep]
    new = np.ones(len(e), bool)
    new[1:] = e["key"][1:] != e["key"][:-1]
    start = np.flatnonzero(new)
    length = np.diff(np.append(start, len(e)))
    first = np.repeat(start, length)
    shared = np.repeat(length > 1, length)
    light = e["subset"] > 0
    rest = np.flatnonzero(shared & ~new)
    lead = first[rest]
    total = e["size"][rest] + e["size"][lead]
    # Sorted by size, the first member is the smallest: whoever links to another through this subset links to it.
    linked = light[rest] & (e["subset"][rest] * (NUM + DEN) >= NUM * total)
    a, b = lead[linked], rest[linked]
    out = [(2, e["sid"][a], e["sid"][b], e["size"][b], e["pos"][b])]
    dealt = start[light[start] & (e["parts"][start] > 1)]
    out.append((3, e["key"][dealt].view(np.int64), e["sid"][dealt], e["size"][dealt], e["subset"][dealt]))
    heavy = np.flatnonzero((shared | (e["parts"] > 1)) & ~light)
    out.append((0, e["key"][heavy].view(np.int64), e["sid"][heavy], e["size"][heavy], e["pos"][heavy]))
    # Anchors: in each list and band of sizes, the set that has the fewest rarer shingles, hence the most in common with
    # the others; the same set in most lists of a group.  Partners are at most one band apart.
    heavy = np.flatnonzero(shared & ~light)
    if len(heavy):
        band = np.floor(np.log(e["size"][heavy]) / math.log(DEN / NUM)).astype(np.int64)
        row = np.lexsort((e["sid"][heavy], e["pos"][heavy], band, e["key"][heavy]))
        heavy, band = heavy[row], band[row]
        key = e["key"][heavy]
        head = np.ones(len(heavy), bool)
        head[1:] = (key[1:] != key[:-1]) | (band[1:] != band[:-1])
        run = np.cumsum(head) - 1
        heads = np.flatnonzero(head)
        below = np.zeros(len(heads), bool)
        below[1:] = (key[heads[1:]] == key[heads[:-1]]) & (band[heads[1:]] == band[heads[:-1]] + 1)
        own = np.flatnonzero(~head)
        lower = np.flatnonzero(below[run])
        a = np.concatenate([heavy[heads[run[own]]], heavy[heads[run[lower] - 1]]])
        b = np.concatenate([heavy[own], heavy[lower]])
        fit = _within(e["size"][a], e["size"][b], e["pos"][a], e["pos"][b])
        pairs = np.unique(np.stack([e["sid"][a[fit]], e["sid"][b[fit]]], 1), axis=0)
        none = np.zeros(len(pairs), np.int32)
        out.append((1, pairs[:, 0], pairs[:, 1], none, none))
    return pa.concat_tables([pa.table([np.full(len(x), k, np.int32), x, y, s, p], schema=_FOUND) for k, x, y, s, p in out])


def _open_lists(entries: DataFrame, labels: DataFrame, write: Write) -> DataFrame:
    """Entries (key, sid, size, pos, component) of lists that may still link several components.

    A list's entry stays only if its position allows the overlap with the
    smallest partner that the list offers: outliers of a group of near copies
    have many rare shingles before the shared ones and go here.
    """
    lists = entries.join(labels.hint("merge"), entries["sid"] == labels["node"], "left").select("key", "sid", "size", "pos", F.coalesce("component", "sid").alias("component"))
    lists = write(lists, "join-lists")
    ends = (F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("size").alias("least"))
    for _ in range(2):
        mixed = lists.groupBy("key").agg(*ends).filter("lo <> hi").select("key", "least")
        partner = F.greatest(F.col("least"), F.ceil(F.col("size") * NUM / DEN))
        lists = lists.join(mixed.hint("merge"), "key").filter(F.col("size") - F.col("pos") >= _need(F.col("size"), partner)).drop("least")
    return write(lists, "join-open")


def _probe(lists: DataFrame) -> DataFrame:
    """Pairs (a, b): the set of each list's largest component that has the fewest rarer shingles, with the list's other sets."""
    held = lists.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("pos", "sid", "size")).alias("best"))
    top = held.groupBy("key").agg(F.max(F.struct("n", "component", "best")).alias("t")).select(F.col("key").alias("of"), "t.component", "t.best.*")
    met = lists.alias("e").join(top.alias("t").hint("merge"), (F.col("e.key") == F.col("of")) & (F.col("e.component") != F.col("t.component")) & _may_link("e", "t"))
    return met.select(F.col("t.sid").alias("a"), F.col("e.sid").alias("b"))


def _across(lists: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets in one list and different components; a long list's pairs are dealt over tasks in blocks."""
    blocks = lists.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    e = lists.join(blocks.hint("merge"), "key").withColumn("mine", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    names = ["key", "sid", "size", "pos", "component"]
    left = e.select(*names, F.col("mine").alias("i"), every.alias("j")).alias("l")
    right = e.select(*names, F.col("mine").alias("j"), every.alias("i")).alias("r")
    same = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in ("key", "i", "j")]
    other = (F.col("l.sid") < F.col("r.sid")) & (F.col("l.component") != F.col("r.component"))
    met = left.join(right.hint("merge"), same[0] & same[1] & same[2] & other & _may_link("l", "r"))
    return met.select(F.col("l.sid").alias("a"), F.col("r.sid").alias("b"))


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by anchor and salt, the anchor's own text first; yields the pairs that are similar."""
    cache = WordHashes()
    at, base = None, np.empty(0, np.uint64)
    for batch in batches:
        a_col, salt, b_col = (batch.column(i).to_pylist() for i in range(3))
        a_out, b_out = [], []
        for a, s, b, text in zip(a_col, salt, b_col, texts_of(batch, "text"), strict=True):
            if (a, s) != at:
                at, base = (a, s), np.empty(0, np.uint64)
            found = shingles(text, cache)
            if a == b:
                base = found
                continue
            both = np.concatenate([base, found])
            both.sort()
            common = int(np.count_nonzero(both[1:] == both[:-1]))
            if common and common * DEN >= NUM * (len(both) - common):
                a_out.append(a)
                b_out.append(b)
        yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], names=["src", "dst"])


def _similar(pairs: DataFrame, sets: DataFrame, docs: DataFrame, parts: int, write: Write) -> DataFrame:
    """Those of ``pairs(a, b)`` of set ids that are similar.  ``sets(sid, doc, row)`` names a document of each set.

    Only the texts of sets in a pair are shuffled.  Members come to their anchor
    in streams sorted by anchor; an anchor of many members is repeated, with a
    part of its members each.  Pairs and sets grow with the input, so these
    joins are never broadcast.
    """
    counts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / ANCHOR_MEMBERS).cast("int").alias("parts"))
    counts = write(counts, "join-anchors")
    members = pairs.join(counts.hint("merge"), "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("salt"), "b")
    anchors = counts.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"), F.col("a").alias("b"))
    wanted = members.unionAll(anchors).join(sets.select(F.col("sid").alias("b"), "doc", "row").hint("merge"), "b")
    wanted = write(wanted, "join-wanted")
    key = F.xxhash64("doc", "row")
    named = write(wanted.select(key.alias("h")).distinct(), "join-named")
    alive = survives(docs.withColumn("h", key), "h", *filter_of(named, "h", write, "join-filter")).filter("__alive").select("doc", "row", "text")
    rows = alive.dropDuplicates(["doc", "row"]).join(wanted.hint("merge"), ["doc", "row"]).select("a", "salt", "b", "text")
    near = rows.repartition(parts, "a", "salt").sortWithinPartitions("a", "salt", F.col("a") != F.col("b"))
    return write(near.mapInArrow(_verify, "src bigint, dst bigint"), "join-similar")


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(
        F.coalesce(F.col(id_col).cast("bigint"), F.lit(LAST)).alias("doc"), F.xxhash64(F.col(text_col)).alias("row"), F.col(text_col).alias("text")
    )


def _classes(part: DataFrame, bucket_bytes: int, hot_list: int, write: Write) -> tuple[DataFrame, DataFrame]:
    """(doc, row, sid, size) of each row of ``part(doc, row, text)``, and (sid, first) with the first (doc, row) of each
    set's component, for sets that are linked or that several rows hold."""
    spark = part.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    seen = write(part.mapInArrow(_members, "kind int, doc bigint, row bigint, sid bigint, size bigint, packed binary"), "join-members")
    members = seen.filter("kind = 0").select("doc", "row", "sid", "size")
    sets = write(
        members.filter("sid is not null")
        .groupBy("sid")
        .agg(F.min(F.struct("doc", "row")).alias("d"), F.first("size").alias("size"), F.count(F.lit(1)).alias("n"))
        .select("sid", "d.doc", "d.row", "size", "n"),
        "join-sets",
    )
    sketch = (
        seen.filter("kind > 0").select("kind", "doc", "row", "packed")
        .groupBy("kind", "doc", "row").applyInArrow(_joined, "kind int, doc bigint, packed binary")
        .groupBy("kind", "doc").applyInArrow(_joined, "kind int, doc bigint, packed binary")
    )
    totals = np.zeros((CHUNKS, SLOTS // CHUNKS), np.uint32)
    distinct = 1.0
    for r in sketch.collect():  # CHUNKS + 1 rows of bounded size
        if r["kind"] == 2:
            distinct = max(1.0, _distinct(np.frombuffer(zstandard.decompress(bytes(r["packed"])), np.uint64)))
        else:
            totals[r["doc"]] = np.frombuffer(zstandard.decompress(bytes(r["packed"])), np.uint32)
    mean = float(totals.mean())
    ranks, lists = np.empty(totals.shape, np.uint16), np.empty(totals.shape, np.uint16)
    for k, counts in enumerate(totals):  # chunk by chunk, so that the driver holds no wide copies of all counters
        flat = counts.astype(float)
        # Up to 1,024 as they are, beyond that in steps of an eighth: 16 bits hold any count.
        ranks[k] = np.where(flat <= 1024, flat, 1024 + 8 * np.log2(np.maximum(flat, 1) / 1024))
        # A shingle is in no more sets than its counter says; what a counter holds on average comes from all the others.
        lists[k] = np.minimum(1000, 1 + np.maximum(0, flat - mean) // hot_list)
    ranks, lists = ranks.ravel(), lists.ravel()
    del totals
    held = sets.agg(F.sum("size")).first()[0] or 0
    light = boundary(max(2.0, held / distinct))
    buckets = max(1, math.ceil(held / 4 * _ENTRY.itemsize / bucket_bytes))
    order = spark.sparkContext.broadcast((ranks, lists))  # 4 * SLOTS bytes

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        pack = zstandard.ZstdCompressor(level=1)
        rank, parts = order.value
        out: list[np.ndarray] = []
        size_out = 0

        def packed() -> pa.RecordBatch:
            e = np.concatenate(out)
            # A list that may be long is dealt over several buckets by set.
            part_no = (e["sid"].view(np.uint64) >> np.uint64(7)) % e["parts"].astype(np.uint64)
            bucket = (((e["key"] >> np.uint64(20)) + part_no * np.uint64(0x9E3779B1)) % np.uint64(buckets)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            e, bucket = e[by], bucket[by]
            cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            blobs = [pack.compress(e[a:b].tobytes()) for a, b in zip(cut, np.append(cut[1:], len(e)), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(bucket[cut]), pa.array(blobs, pa.binary())], schema=_BUCKETS)

        for batch in small_batches(batches, TEXTS):
            seen: set[int] = set()
            for text in texts_of(batch, "text"):
                found = shingles(text, cache)
                size = len(found)
                sid = set_id(found) if size else None
                if sid is None or sid in seen:
                    continue
                seen.add(sid)
                if size <= light:
                    rows = _subset_keys(found, parts[_slots(found)])
                    e = np.zeros(len(rows), _ENTRY)
                    e["key"], e["subset"], e["parts"] = zip(*rows, strict=True)
                    e["sid"], e["size"] = sid, size
                    out.append(e)
                    size_out += len(e)
                if size * DEN > light * NUM:  # may have a partner beyond the boundary
                    n = prefix_length(size)
                    e = np.zeros(n, _ENTRY)
                    e["key"], e["pos"] = _order(found, rank)[:n], np.arange(n)
                    e["sid"], e["size"], e["parts"] = sid, size, parts[_slots(e["key"])]
                    out.append(e)
                    size_out += n
                if size_out >= PACKED:
                    yield packed()
                    out, size_out = [], 0
        if out:
            yield packed()

    posted = part.select("text").mapInArrow(post, "bucket bigint, packed binary")
    found = write(posted.groupBy("bucket").applyInArrow(_scan, "kind int, x bigint, y bigint, size int, pos int"), "join-found")
    by_subset = found.filter("kind = 2").select(F.col("x").alias("src"), F.col("y").alias("dst"))
    # The parts of a subset's list meet in the smallest set of all.
    firsts = found.filter("kind = 3").select(F.col("x").alias("key"), F.col("y").alias("sid"), "size", F.col("pos").alias("subset"))
    least = firsts.groupBy("key").agg(F.min(F.struct("size", "sid")).alias("least"))
    enough = F.col("subset") * (NUM + DEN) >= NUM * (F.col("size") + F.col("least.size"))
    by_part = firsts.join(least.hint("merge"), "key").filter(enough & (F.col("sid") != F.col("least.sid"))).select(F.col("least.sid").alias("src"), F.col("sid").alias("dst"))
    pairs = write(found.filter("kind = 1").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "join-pairs")
    links = write(_similar(pairs, sets, part, tasks, write).unionAll(by_subset).unionAll(by_part), "join-links")
    entries = found.filter("kind = 0").select(F.col("x").alias("key"), F.col("y").alias("sid"), "size", "pos")
    tried = pairs.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"))
    labels = connected_components(links, "join", write)
    for turn in range(PROBES + 1):
        open_lists = _open_lists(entries, labels, write)
        entries = open_lists.select("key", "sid", "size", "pos")
        fresh = _probe(open_lists) if turn < PROBES else _across(open_lists)
        fresh = fresh.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"), "a", "b").dropDuplicates(["x", "y"])
        fresh = write(fresh.join(tried.hint("merge"), ["x", "y"], "left_anti"), "join-fresh")
        if not fresh.limit(1).count():
            continue
        tried = tried.unionAll(fresh.select("x", "y"))
        links = write(links.unionAll(_similar(fresh.select("a", "b"), sets, part, tasks, write)), "join-links")
        labels = connected_components(links, "join", write)
    named = sets.join(labels.hint("merge"), sets["sid"] == labels["node"], "left").filter("component is not null or n > 1")
    named = write(named.select("sid", F.struct("doc", "row").alias("at"), F.coalesce("component", "sid").alias("component")), "join-named")
    first = write(named.groupBy("component").agg(F.min("at").alias("first")), "join-lowest")
    return members, named.join(first.hint("merge"), "component").select("sid", "first")


def similarity_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES, hot_list: int = HOT_LIST
) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row for each input row.

    Equal sets become one node.  Small sets enumerate the subsets that could be
    an overlap: a shared subset of the needed size is a link, without a look at
    the texts.  Large sets post the shortest prefix, rare shingles first, that
    any partner must meet, and its inverted lists are scanned.  The size at
    which the one takes over from the other is where their costs cross.  The
    order comes from a sketch of fixed size, so passages that many documents
    share stay out of the prefixes; any order gives the same links.

    Lists are not multiplied out: first each list's members are verified against
    the set of their size band that has the fewest rarer shingles, then those
    still outside against the best set of the list's largest component; then
    all pairs across components whose positions still allow a link.  Pairs
    inside a component are not needed for the components, and no other pair is
    left out.  Lists that may be longer than ``hot_list`` are dealt over buckets.

    Null or empty texts have no shingles and are their own component; texts of
    under five words are one shingle; a null id sorts last, so it names a
    component (as null) only where all ids are null; repeated rows fall into one
    component; an empty table gives an empty result; other columns are ignored,
    whatever their names.
    """
    with temporary(docs.sparkSession) as write:
        members, classes = _classes(_rows(docs, id_col, text_col), bucket_bytes, hot_list, write)
        out = members.join(classes.hint("merge"), "sid", "left")
        out = materialize(out.select("doc", "size", F.coalesce("first.doc", "doc").alias("low")), "join-result")
    kind = docs.schema[id_col].dataType
    return out.select(
        F.nullif("doc", F.lit(LAST)).cast(kind).alias("doc_id"),
        F.col("size").alias("n_shingles"),
        F.nullif("low", F.lit(LAST)).cast(kind).alias("component_id"),
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """The rows of ``docs``, one of each component: that of the smallest id.

    Decided row by row: of rows that carry the smallest id one stays, the one
    with the smallest hash of its text; of rows equal in id and text any one.
    Rows without shingles are linked with nothing and all stay.  All columns are
    kept; only removed rows meet a shuffle.
    """
    with temporary(docs.sparkSession) as write:
        members, classes = _classes(_rows(docs, id_col, text_col), bucket_bytes, HOT_LIST, write)
        rows = members.join(classes.hint("merge"), "sid").select("doc", "row", F.struct("doc", "row").eqNullSafe(F.col("first")).alias("stays"))
        counted = rows.groupBy("doc", "row").agg(F.bool_or("stays").alias("once"), F.count(F.lit(1)).alias("n")).filter("not once or n > 1")
        kind = docs.schema[id_col].dataType
        gone = materialize(counted.select(F.nullif("doc", F.lit(LAST)).cast(kind).alias("id"), F.col("row").alias("key"), "once"), "join-gone")
    return without(docs, id_col, F.xxhash64(F.col(text_col)), gone, materialize)
