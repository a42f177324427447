"""Groups of records linked directly or through others.

Method: minimum labels travel along the links, accelerated by pointer jumping, every round written to the shared
folder, until no label changes. In a round every node takes the least label among its own and its neighbours', labels
are followed twice (label of the label), and the links are rewritten to join labels instead of nodes; links within one
label vanish and equal ones fall together, so the work shrinks from round to round. The least id of a component is
never replaced, so it ends as the label of all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.positions import with_positions
from lodestone.operators.rows import lookup_join
from lodestone.scratch import Scratch


def star_links(members: DataFrame, key: list[str], node: str, scratch: Scratch) -> DataFrame:
    """``a, b``: each node that shares a key with others, linked to the least of them; no pairs within a key.

    Nodes or keys that are null link nothing. Any number of nodes may share one key.
    """
    rows = members.where(f"{node} is not null and " + " and ".join(f"{k} is not null" for k in key))
    rows = scratch.write(rows.select(F.to_json(F.array(*(F.col(k).cast("string") for k in key))).alias("key") if len(key) > 1 else F.col(key[0]).alias("key"), F.col(node).alias("b")).distinct(), f"star-{'-'.join(key)}")
    least = rows.groupBy("key").agg(F.min("b").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "a")
    return lookup_join(rows, least, "key", rows=rows.count()).where("a <> b").select("a", "b")


def connected_components(links: DataFrame) -> DataFrame:
    """``node bigint, component bigint``: every node of a link, with the least node it is linked to in any number of steps.

    ``links``: ``a bigint, b bigint``, in any direction and number; those with a null end or from a node to itself
    are ignored, so a node that occurs only there isn't in the result. An empty table gives an empty one. Nodes with
    any number of links are fine: their minima combine before the shuffle, and labels are looked up by
    :func:`lodestone.operators.rows.lookup_join`. ``links`` is read once, before the function returns.
    """
    spark = links.sparkSession
    scratch = Scratch(spark, "components")
    rows = links.where("a is not null and b is not null and a <> b")
    edges = scratch.write(rows.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges0")
    labels, level = None, 0
    while n := edges.count():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label"))
        step = scratch.write(least, f"step{level}-0")
        nodes = step.count()
        for jump in (1, 2):
            follow = step.select(F.col("node").alias("label"), F.col("label").alias("next"))
            step = scratch.write(lookup_join(step, follow, "label", rows=nodes).select("node", F.col("next").alias("label")), f"step{level}-{jump}")
        if labels is None:
            labels = step
        else:
            follow = step.select(F.col("node").alias("label"), F.col("label").alias("next"))
            moved = lookup_join(labels, follow, "label", "left", rows=labels.count())
            labels = scratch.write(moved.select("node", F.coalesce("next", "label").alias("label")), f"labels{level}")
        ends = edges
        for end in ("a", "b"):
            to = step.select(F.col("node").alias(end), F.col("label").alias("__label"))
            ends = lookup_join(ends, to, end, rows=n).select(F.col("__label").alias(end), "b" if end == "a" else "a")
        ends = ends.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        level += 1
        edges = scratch.write(ends, f"edges{level}")
        scratch.drop(f"edges{level - 1}", f"step{level - 1}-0", f"step{level - 1}-1")
        if level > 2:
            scratch.drop(f"labels{level - 2}", f"step{level - 1}-2")
    if labels is None:
        return spark.createDataFrame([], "node bigint, component bigint")
    return labels.select("node", F.col("label").alias("component"))


def numbered_components(nodes: DataFrame, components: DataFrame) -> DataFrame:
    """``node, component, number, name``: components numbered from 0 in the order of their first appearance by rising
    node, with names from ``g00000`` upward; a node of no link is a component of its own.

    ``nodes``: ``node bigint``, all of them; null ones are ignored and repeated ones count once. ``components``: the
    result of :func:`connected_components` over some of them.
    """
    rows = nodes.where("node is not null").select("node").distinct().join(components.select("node", "component"), "node", "left")
    rows = Scratch(nodes.sparkSession, "numbers").write(rows.select("node", F.coalesce("component", "node").alias("component")), "rows")
    # A component is named by its least node, which is where it appears first.
    numbers = with_positions(rows.where("node = component").select("component"), ["component"], "number")
    return lookup_join(rows, numbers, "component").select("node", "component", "number", F.format_string("g%05d", "number").alias("name"))
