"""Connected components with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .scratch import Write, materialize


def _jump(labels: DataFrame, tag: str, write: Write) -> DataFrame:
    """Follow label -> label of label until nothing changes (doubling steps)."""
    while True:
        parent = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        stepped = write(
            labels.join(parent.hint("merge"), "label", "left").select(
                "node", F.coalesce("up", "label").alias("label"), (F.coalesce("up", "label") != F.col("label")).alias("moved")
            ),
            tag,
        )
        moved = stepped.filter("moved").limit(1).count()
        labels = stepped.select("node", "label")
        if not moved:
            return labels


def connected_components(edges: DataFrame, tag: str = "components", write: Write = materialize) -> DataFrame:
    """(node, component) for undirected ``edges(src, dst)``; component is the smallest node.

    Each round hooks every node to its smallest neighbour (one aggregation that
    combines map-side, so a hub with a third of all edges is no hot group),
    shortens the chains by pointer jumping and contracts the edges.  Labels and
    edges are reread tables, so that joins on a hub's key are ordinary
    two-exchange joins which AQE can split.  Null ends and loops link nothing;
    repeated edges count once; no edges give an empty table.  Tables are written
    with ``write``.
    """
    work = write(
        edges.select("src", "dst").filter("src is not null and dst is not null and src <> dst").distinct(), f"{tag}-edges"
    )
    total: DataFrame | None = None
    while work.limit(1).count():
        both = work.select(F.col("src").alias("node"), F.col("dst").alias("other")).union(work.select("dst", "src"))
        hooked = write(
            both.groupBy("node").agg(F.min("other").alias("low")).select("node", F.least("node", "low").alias("label")),
            f"{tag}-hook",
        )
        labels = _jump(hooked, f"{tag}-jump", write)
        at_src = labels.select(F.col("node").alias("src"), F.col("label").alias("a"))
        at_dst = labels.select(F.col("node").alias("dst"), F.col("label").alias("b"))
        work = write(
            work.join(at_src.hint("merge"), "src").join(at_dst.hint("merge"), "dst").filter("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct(),
            f"{tag}-edges",
        )
        if total is None:
            total = labels
        else:
            onward = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
            total = write(
                total.join(onward.hint("merge"), "label", "left").select("node", F.coalesce("up", "label").alias("label")), f"{tag}-labels"
            )
    if total is None:
        total = work.select(F.col("src").alias("node"), F.col("dst").alias("label"))
    return total.select("node", F.col("label").alias("component"))
