"""Prefix trie of conversations in preorder-interval encoding."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .scratch import Write, materialize, temporary

#: Rows of one key that meet in one group: longer conversations and chains are cut into chunks of so many steps.
CHUNK = 4096
#: Keys with at least this part of all rows: at most so many, so they may be broadcast.
HEAVY = 4096
#: Ids that one task joins into one string before the strings of a node are hashed in order.
PIECE = 1 << 15
_MASK = 0xFFFFFFFF
_NODE = ["depth", "p1", "p2"]


def _chunk(order: str) -> Column:
    return F.floor(F.col(order) / CHUNK).cast("bigint")


def running(rows: DataFrame, group: str | None, order: str, sums: list[str], write: Write, tag: str) -> DataFrame:
    """``rows`` with inclusive running ``sums`` over ``order``, whole numbers that follow each other without gaps in a group.

    Distributed: sums run inside chunks of ``CHUNK`` steps, the totals of full
    chunks (one row for each) are summed up in a second, much smaller pass, and
    only chunks after the first one are joined to their offset.
    """
    keys = [group] if group else []
    inside = W.partitionBy(*keys, "__chunk").orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    local = write(rows.withColumn("__chunk", _chunk(order)).withColumns({s: F.sum(s).over(inside) for s in sums}), tag)
    before = W.partitionBy(*keys).orderBy("__chunk").rowsBetween(W.unboundedPreceding, W.currentRow)
    full = local.filter(F.col(order) % CHUNK == CHUNK - 1).select(*keys, (F.col("__chunk") + 1).alias("__chunk"), *[F.col(s).alias(f"__{s}") for s in sums])
    offsets = full.select(*keys, "__chunk", *[F.sum(f"__{s}").over(before).alias(f"__{s}") for s in sums])
    later = local.filter("__chunk > 0").join(offsets, [*keys, "__chunk"], "left")
    added = later.withColumns({s: F.col(s) + F.coalesce(f"__{s}", F.lit(0)) for s in sums}).select(local.columns)
    return local.filter("__chunk = 0").unionAll(added).drop("__chunk")


def meet(rows: DataFrame, facts: DataFrame, keys: list[str], weight: Column, total: int) -> DataFrame:
    """Inner join of ``rows`` and ``facts(keys, ...)``, one fact for each key, ``weight`` an upper bound of the key's rows.

    A key with ``total / HEAVY`` rows or more is one of at most ``HEAVY`` such
    keys (weights add up to ``total``), so these are broadcast; what is left has
    no hot key.
    """
    heavy = F.broadcast(facts.filter(weight * HEAVY >= total))
    hot = rows.join(heavy, keys)
    rest = rows.join(F.broadcast(facts.filter(weight * HEAVY >= total).select(keys)), keys, "left_anti")
    return hot.unionByName(rest.join(facts.filter(weight * HEAVY < total).hint("merge"), keys))


def digested(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, k1, k2, chars): a turn's role and text as 128 bits, and the text's code points.  Rows without a conv_id belong nowhere."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    return conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        "turn",
        F.xxhash64(role, text).alias("k1"),
        F.xxhash64(F.lit(0x9E3779B9), text, role).alias("k2"),
        F.length(text).cast("bigint").alias("chars"),
    )


def sorted_turns(turns: DataFrame, write: Write) -> tuple[DataFrame, DataFrame]:
    """(rows, runs): turns with their place ``at`` in a global order, and (conv_id, block, start, n, before) of each conversation's runs.

    Order: conv_id, turn (null first), then the turn's hashes, which settles
    ties and leaves only repeated rows without order.  A conversation that
    spans several blocks has a run in each.
    """
    order = ["conv_id", "turn", "k1", "k2"]
    laid = turns.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    rows = write(laid.drop("turn"), "trie-turns").withColumn("block", F.shiftright("at", 33))
    runs = rows.groupBy("conv_id", "block").agg(F.min("at").alias("start"), F.count(F.lit(1)).alias("n"))
    order_of_runs = W.partitionBy("conv_id").orderBy("block")
    before = F.sum("n").over(order_of_runs.rowsBetween(W.unboundedPreceding, -1))
    whole = F.sum("n").over(W.partitionBy("conv_id"))
    return rows, write(runs.select("*", F.coalesce(before, F.lit(0)).alias("before"), whole.alias("n_own")), "trie-runs")


def rebuilt(conversations: DataFrame, group: int, heads: int, write: Write) -> tuple[DataFrame, DataFrame]:
    """(turns, members): every conversation with its first turns taken from the first one of its hundred.

    Of conversation c the first h = crc32(c) mod ``heads`` turns are those of
    c - c mod ``group``, its own follow after its first h.  ``turns`` is
    (conv_id, pos from 1, last, k1, k2, chars), ``members`` (conv_id, n_turns).
    """
    rows, runs = sorted_turns(digested(conversations), write)
    own_head = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(heads))
    near = (F.col("at") - F.col("start") + F.col("before") + 1).alias("pos")
    first = rows.filter(F.col("conv_id") % group == 0).join(runs.filter((F.col("conv_id") % group == 0) & (F.col("before") < heads)), ["conv_id", "block"])
    given = first.select("conv_id", near, "k1", "k2", "chars").filter(F.col("pos") < heads)  # fewer than ``heads`` rows a donor
    donors = given.groupBy(F.col("conv_id").alias("donor")).agg(F.sort_array(F.collect_list(F.struct("pos", "k1", "k2", "chars"))).alias("given"))
    members = runs.filter("before = 0").select("conv_id", "n_own", own_head.alias("h"), (F.col("conv_id") - F.col("conv_id") % group).alias("donor"))
    members = members.join(donors, "donor", "left").withColumn("given", F.slice(F.coalesce("given", F.array()), F.lit(1), F.col("h").cast("int")))
    taken = F.size("given").cast("bigint")
    members = write(members.select("conv_id", "n_own", "h", "given", taken.alias("taken"), (taken + F.greatest(F.col("n_own") - F.col("h"), F.lit(0))).alias("n_turns")), "trie-members")
    heads_part = members.select("conv_id", "n_turns", F.explode("given").alias("g")).select(
        "conv_id", F.col("g.pos").alias("pos"), (F.col("g.pos") == F.col("n_turns")).alias("last"), "g.k1", "g.k2", "g.chars"
    )
    placed = runs.select("conv_id", "block", "start", "before").join(members.select("conv_id", "h", "taken", "n_turns"), "conv_id")
    kept = rows.join(placed, ["conv_id", "block"]).select("*", near).filter("pos > h")
    moved = F.col("pos") - F.col("h") + F.col("taken")
    own = kept.select("conv_id", moved.alias("pos"), (moved == F.col("n_turns")).alias("last"), "k1", "k2", "chars")
    return heads_part.unionByName(own), members.select("conv_id", "n_turns")


def _halves(name: str, value: Column) -> dict[str, Column]:
    return {f"{name}_hi": F.shiftrightunsigned(value, 32), f"{name}_lo": value.bitwiseAND(F.lit(_MASK).cast("bigint"))}


def _whole(hi: Column, lo: Column) -> Column:
    """The sum's low 64 bits from the sums of halves."""
    return F.shiftleft(hi + F.shiftright(lo, 32), 32).bitwiseOR(lo.bitwiseAND(F.lit(_MASK).cast("bigint")))


def _paths(turns: DataFrame, write: Write) -> DataFrame:
    """(conv_id, depth, last, chars, p1, p2, q1, q2): the node that a conversation's first ``depth`` turns lead to, and that node's parent.

    A sequence is named by the sum of 128-bit hashes of its (position, turn)
    pairs: a sum can run over a conversation of any length in chunks, which a
    chain of hashes can't.
    """
    named = turns.select(
        "conv_id",
        F.col("pos").alias("depth"),
        "last",
        "chars",
        F.xxhash64("pos", "k1", "k2").alias("a"),
        F.xxhash64(F.lit(7), "k2", "k1", "pos").alias("b"),
    )
    parts = _halves("a", F.col("a")) | _halves("b", F.col("b"))
    sums = running(named.withColumns(parts), "conv_id", "depth", list(parts), write, "trie-paths")
    own = _halves("a", F.col("a")) | _halves("b", F.col("b"))
    return sums.select(
        "conv_id", "depth", "last", "chars",
        *[_whole(F.col(f"{x}_hi"), F.col(f"{x}_lo")).alias(p) for x, p in (("a", "p1"), ("b", "p2"))],
        *[_whole(F.col(f"{x}_hi") - own[f"{x}_hi"], F.col(f"{x}_lo") - own[f"{x}_lo"]).alias(q) for x, q in (("a", "q1"), ("b", "q2"))],
    )


def _nodes(paths: DataFrame, members: DataFrame, write: Write) -> DataFrame:
    """(depth, p1, p2, conv_id, n_convs, chars, n_children, parent_conv_id, splits): distinct nodes; ``splits``: the parent has other children too."""
    inner = paths.groupBy(*_NODE).agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("chars").alias("chars"), F.min("q1").alias("q1"), F.min("q2").alias("q2")
    )
    zero = F.lit(0).cast("bigint")
    root = members.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).filter("n_convs > 0")
    nodes = write(inner.unionByName(root.select(*[zero.alias(c) for c in (*_NODE, "chars", "q1", "q2")], "conv_id", "n_convs")), "trie-nodes")
    up = [(F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2")]
    kids = nodes.filter("depth > 0").select(up).groupBy(*_NODE).agg(F.count(F.lit(1)).alias("n_children"))
    counted = write(nodes.join(kids.hint("merge"), _NODE, "left").fillna(0, ["n_children"]), "trie-counted")
    facts = counted.filter("n_children > 0").select(
        F.col("depth").alias("up_depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("n_siblings")
    )
    below = counted.filter("depth > 0").withColumn("up_depth", F.col("depth") - 1)
    met = meet(below, facts, ["up_depth", "q1", "q2"], F.col("n_siblings"), nodes.count())
    columns = [*_NODE, "conv_id", "n_convs", "chars", "n_children", "parent_conv_id", "splits"]
    top = counted.filter("depth = 0").withColumns({"parent_conv_id": F.lit(None).cast("bigint"), "splits": F.lit(False)})
    return met.withColumn("splits", F.col("n_siblings") > 1).select(columns).unionByName(top.select(columns))


def _ranked(paths: DataFrame, nodes: DataFrame, ends: DataFrame, write: Write) -> DataFrame:
    """(conv_id, n_turns, rank): one conversation of each distinct sequence, in lexicographic order of sequences, prefixes first.

    Two sequences part below a node with several children, so only the nodes
    that such a node leads to are compared.  A path has at most sqrt(2 x turns)
    of them, however long it is: k branches off one path need k conversations
    of lengths 1, 2, ..., k at least.  Siblings are in order of their hashes.
    """
    reps = write(ends.groupBy(*_NODE).agg(F.min("conv_id").alias("conv_id")), "trie-sequences").select("conv_id", F.col("depth").alias("n_turns"))
    forks = nodes.filter("splits").select(*_NODE, "n_convs")
    steps = _on_chunks(paths.select("conv_id", *_NODE), reps)
    parted = meet(steps, forks, _NODE, F.col("n_convs"), paths.count())
    keys = parted.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(*_NODE))).alias("key"))
    keyed = reps.join(keys, "conv_id", "left").select("conv_id", "n_turns", F.coalesce("key", F.array().cast(keys.schema["key"].dataType)).alias("key"))
    laid = keyed.repartitionByRange("key", "n_turns").sortWithinPartitions("key", "n_turns")
    rows = write(laid.select("conv_id", "n_turns", F.monotonically_increasing_id().alias("at")), "trie-order").withColumn("block", F.shiftright("at", 33))
    blocks = rows.groupBy("block").agg(F.min("at").alias("start"), F.count(F.lit(1)).alias("n"))  # as many rows as partitions were written
    blocks = blocks.select("block", "start", F.coalesce(F.sum("n").over(W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return rows.join(F.broadcast(blocks), "block").select("conv_id", "n_turns", (F.col("at") - F.col("start") + F.col("before")).alias("rank"))


def _on_chunks(steps: DataFrame, facts: DataFrame) -> DataFrame:
    """Steps (conv_id, depth, ...) of the conversations in ``facts(conv_id, n_turns, ...)``, joined chunk by chunk."""
    dealt = facts.withColumn("__chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), _chunk("n_turns"))))
    return steps.withColumn("__chunk", _chunk("depth")).join(dealt, ["conv_id", "__chunk"]).drop("__chunk")


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (depth, p1, p2, conv_id) in order to rows (depth, p1, p2, first id, joined ids) of at most ``PIECE`` ids."""
    names = [*_NODE, "first", "ids"]
    node, held = None, []

    def flush() -> list:
        return [*node, held[0], ",".join(map(str, held))]

    for batch in batches:
        done = []
        for d, p1, p2, c in zip(*(column.to_pylist() for column in batch.columns), strict=True):
            if held and ((d, p1, p2) != node or len(held) >= PIECE):
                done.append(flush())
                held = []
            node = (d, p1, p2)
            held.append(c)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string() if i == 4 else pa.int64()) for i, x in enumerate(zip(*done, strict=True))], names=names)
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in flush()], names=names)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in order to one digest for each node."""
    names = [*_NODE, "ends_sha256"]
    node, state = None, hashlib.sha256()
    for batch in batches:
        done = []
        for d, p1, p2, ids in zip(*(column.to_pylist() for column in batch.columns), strict=True):
            if (d, p1, p2) == node:
                state.update(b",")
            else:
                if node is not None:
                    done.append([*node, state.hexdigest()])
                node, state = (d, p1, p2), hashlib.sha256()
            state.update(ids.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], names=names)
    if node is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*node, state.hexdigest())], names=names)


def _end_digests(ends: DataFrame) -> DataFrame:
    """(depth, p1, p2, ends_sha256).  Ids of a node are joined in pieces by any number of tasks; one only hashes the pieces, one after the other."""
    order = [*_NODE, "conv_id"]
    laid = ends.select(order).repartitionByRange(*order).sortWithinPartitions(*order)
    pieces = laid.mapInArrow(_joined, "depth bigint, p1 bigint, p2 bigint, first bigint, ids string")
    return (
        pieces.repartition(*_NODE).sortWithinPartitions(*_NODE, "first").drop("first").mapInArrow(_hashed, "depth bigint, p1 bigint, p2 bigint, ends_sha256 string")
    )


def prefix_trie(turns: DataFrame, members: DataFrame, write: Write) -> DataFrame:
    """One row for each distinct sequence of first turns; see ``conversation_trie``."""
    paths = _paths(turns, write)
    nodes = write(_nodes(paths, members, write), "trie-linked")
    zero = F.lit(0).cast("bigint")
    ends = write(
        paths.filter("last").select(*_NODE, "conv_id").unionByName(members.filter("n_turns = 0").select(*[zero.alias(c) for c in _NODE], "conv_id")), "trie-ends"
    )
    ranked = write(_ranked(paths, nodes, ends, write), "trie-ranked")
    spans = _on_chunks(paths.select("conv_id", *_NODE), ranked).groupBy(*_NODE).agg(F.min("rank").alias("first"), F.max("rank").alias("final"))
    whole = ranked.agg(F.min("rank").alias("first"), F.max("rank").alias("final")).filter("first is not null")
    spans = spans.unionByName(whole.select(*[zero.alias(c) for c in _NODE], "first", "final"))
    saving = ((F.col("n_convs") - 1) * F.col("chars")).alias("saving")
    valued = nodes.join(spans.hint("merge"), _NODE).select("*", saving, saving.alias("chain"), (F.col("n_children") == 0).cast("bigint").alias("leaf"))
    # Nodes that a rank is the first to reach are one downward chain: ``chain`` sums savings along it.
    chained = running(valued, "first", "depth", ["chain"], write, "trie-chains")
    per_rank = chained.groupBy(F.col("first").alias("rank")).agg(
        F.sum("saving").alias("saved"), F.sum("leaf").alias("leaves"), F.count(F.lit(1)).alias("nodes"),
        F.sum("saving").alias("own_saved"), F.sum("leaf").alias("own_leaves"), F.count(F.lit(1)).alias("own_nodes"),
        F.min("depth").alias("low"), F.max("depth").alias("n_turns"),
    )
    sums = write(running(per_rank, None, "rank", ["saved", "leaves", "nodes"], write, "trie-sums"), "trie-prefix-sums")
    dealt = sums.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), _chunk("n_turns"))))
    before = dealt.select(
        F.col("rank").alias("first"), "chunk", "low", *[(F.col(c) - F.col(f"own_{c}")).alias(f"{c}_before") for c in ("saved", "leaves", "nodes")]
    )
    until = dealt.select(F.col("rank").alias("final"), "chunk", *[F.col(c).alias(f"{c}_until") for c in ("saved", "leaves", "nodes")])
    found = chained.withColumn("chunk", _chunk("depth")).join(before, ["first", "chunk"]).join(until, ["final", "chunk"])
    digests = write(_end_digests(ends), "trie-digests")
    return found.join(digests, _NODE, "left").select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        (F.col("leaves_until") - F.col("leaves_before")).alias("n_leaves"),
        (F.col("saved_until") - F.col("saved_before") - F.col("chain") + F.col("saving")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
        (F.col("nodes_before") + F.col("depth") - F.col("low")).alias("preorder"),
        (F.col("nodes_until") - 1).alias("subtree_end"),
    )


def conversation_trie(conversations: DataFrame, group: int = 100, heads: int = 6) -> DataFrame:
    """The prefix trie of the rebuilt conversations, one row for each node.

    Nodes get preorder positions; a subtree is the interval from a node's
    position to its ``subtree_end``, so leaves and savings of a subtree are
    differences of prefix sums that run over the positions in chunks.

    Returns conv_id (smallest member), depth, parent_conv_id (null at the root),
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256, preorder and
    subtree_end.  Null roles and texts are empty; a null turn comes first; turns
    of equal number are in order of their hashes; repeated rows are turns of
    their own; rows without a conv_id belong to no conversation; a conversation
    whose turns were all replaced by none ends at the root; an empty table has
    no node, not even a root; other columns are ignored, whatever their names.
    Sequences are told apart by 128 bits.
    """
    with temporary(conversations.sparkSession) as write:
        turns, members = rebuilt(conversations, group, heads, write)
        return materialize(prefix_trie(turns, members, write), "trie")


#: crc32 of an id's digits bit by bit; subtrees through each node's ancestors.
TRIE_SQL = """
WITH RECURSIVE ids AS (SELECT conv_id, count(*) AS n FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1),
bits AS (
  SELECT conv_id, CAST(conv_id AS VARCHAR) AS s, 0 AS i, 4294967295::BIGINT AS crc FROM ids
  UNION ALL
  SELECT conv_id, s, i + 1, xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384::BIGINT ELSE 0 END)
  FROM (SELECT *, CASE WHEN i % 8 = 0 THEN xor(crc, ascii(substr(s, i // 8 + 1, 1))::BIGINT) ELSE crc END AS c FROM bits WHERE i < 8 * length(s))
),
h AS (SELECT conv_id, xor(crc, 4294967295::BIGINT) % 6 AS h FROM bits WHERE i = 8 * length(s)),
o AS (
  SELECT conv_id, md5(length(r) || ':' || r || t) AS k, length(t) AS chars,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r, t) AS pos
  FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations WHERE conv_id IS NOT NULL)
),
f AS (SELECT h.conv_id, h.h, h.conv_id - h.conv_id % 100 AS donor, least(h.h, coalesce(ids.n, 0)) AS taken
      FROM h LEFT JOIN ids ON ids.conv_id = h.conv_id - h.conv_id % 100),
t AS (
  SELECT f.conv_id, o.pos, o.k, o.chars FROM f JOIN o ON o.conv_id = f.donor AND o.pos <= f.h
  UNION ALL
  SELECT f.conv_id, f.taken + o.pos - f.h, o.k, o.chars FROM f JOIN o ON o.conv_id = f.conv_id AND o.pos > f.h
),
l AS (
  SELECT f.conv_id, coalesce(list(t.k ORDER BY t.pos) FILTER (t.k IS NOT NULL), []) AS ks, coalesce(list(t.chars ORDER BY t.pos) FILTER (t.k IS NOT NULL), []) AS cs
  FROM f LEFT JOIN t ON t.conv_id = f.conv_id GROUP BY 1
),
p AS (
  SELECT conv_id, d, len(ks) AS n, array_to_string(ks[1:d], '') AS path, array_to_string(ks[1:d - 1], '') AS up, CASE WHEN d > 0 THEN cs[d] ELSE 0 END AS chars
  FROM l, unnest(range(0, len(ks) + 1)) AS u(d)
),
n AS (
  SELECT path, d, CASE WHEN d > 0 THEN any_value(up) END AS up, min(conv_id) AS conv_id, count(*) AS n_convs, max(chars) AS chars,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (d = n), '')) AS ends_sha256
  FROM p GROUP BY 1, 2
),
k AS (SELECT up AS path, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1),
m AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM n LEFT JOIN k ON k.path = n.path),
s AS (
  SELECT left(path, 32 * a) AS path, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * chars) AS saved_tokens
  FROM m, unnest(range(0, d + 1)) AS u(a) GROUP BY 1
)
SELECT m.conv_id, m.d::BIGINT AS depth, u.conv_id AS parent_conv_id, m.n_convs, m.n_children, s.n_leaves::BIGINT AS n_leaves,
       s.saved_tokens::BIGINT AS saved_tokens, m.ends_sha256
FROM m JOIN s ON s.path = m.path LEFT JOIN m AS u ON u.path = m.up
"""
