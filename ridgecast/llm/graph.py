"""Candidate pairs out of blocks, and connected components, on narrow tables of ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgecast.session import cut_lineage, forget


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that edges (a, b) reach, for every node with an edge.

    Alternates the published large-star and small-star steps, each an aggregation and a join, until the
    edges stay as they are; the rounds grow with the logarithm of the component size. Loops and
    repeated edges are ignored, nulls join nothing.
    """
    larger, smaller = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    now = cut_lineage(edges.filter("a != b").select(larger, smaller).distinct())
    seen = _mark(now)
    while seen[0]:
        both = now.union(now.select("v", "u")).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        stars = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = stars.groupBy("u").agg(F.min("v").alias("m"))
        found = stars.join(low, "u")
        new = found.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", "m")).distinct()
        before, now = now, cut_lineage(new)
        last, seen = seen, _mark(now)
        if seen == last:
            break
        forget(before)
    roots = now.select("v").distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("v", "v"))


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def ranked(blocks: DataFrame) -> DataFrame:
    """The blocks (key, node, ...) of two nodes or more, with ``rank``: how many rows the node's blocks have together.

    A node that resembles many others meets many, so the highest rank of a block is a good one to try first.
    """
    sizes = blocks.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    known = blocks.join(sizes, "key")
    return known.join(known.groupBy("node").agg(F.sum("m").alias("rank")), "node").drop("m")


def _closest(led: DataFrame) -> DataFrame:
    """Of rows (node, a), one a block, each node with the one other node that it meets most often."""
    met = led.filter("a != node").groupBy("node", "a").agg(F.count(F.lit(1)).alias("times"))
    return met.groupBy("node").agg(F.max_by("a", F.struct("times", "a")).alias("a")).select("a", F.col("node").alias("b"))


def leader_pairs(blocks: DataFrame) -> DataFrame:
    """Each node of ``ranked`` blocks with the node that leads most of its blocks: a pair a node at most."""
    first = blocks.groupBy("key").agg(F.max_by("node", F.struct("rank", "node")).alias("a"))
    return _closest(blocks.join(first, "key").select("node", "a"))


def open_blocks(blocks: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, node, c, top): rows of blocks that hold several components of ``labels`` (node, component), and the largest there."""
    known = blocks.join(labels, "node", "left").select(*blocks.columns, F.coalesce("component", "node").alias("c"))
    sizes = known.groupBy("key", "c").agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.groupBy("key").agg(F.max_by("c", F.struct("n", "c")).alias("top"), F.count(F.lit(1)).alias("parts"))
    return known.join(largest.filter("parts > 1").drop("parts"), "key")


def top_pairs(rows: DataFrame) -> DataFrame:
    """Of ``open_blocks`` each node outside the largest component with one node inside it, seldom its leader."""
    inside = rows.filter("c = top").groupBy("key").agg(F.min("node").alias("a"))
    return _closest(rows.filter("c != top").join(inside, "key").select("node", "a"))


def hooked(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (node, component) after links (a, b), each the only one of its b: what b belonged to goes to a's component.

    Nodes of one component are linked; those of two may be, as a component that others went to can go on itself.
    """
    own, other = (labels.select(F.col("node").alias(m), F.col("component").alias(f"{m}_c")) for m in "ab")
    ends = links.join(own, "a", "left").join(other, "b", "left").select(F.coalesce("b_c", "b").alias("component"), F.coalesce("a_c", "a").alias("to"))
    moved = ends.filter("component != to").groupBy("component").agg(F.min("to").alias("to"))
    alone = moved.select(F.col("component").alias("node"), "component").join(labels.select("node"), "node", "left_anti")
    every = labels.union(alone).join(moved, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    above = moved.select(F.col("component"), F.col("to").alias("over"))  # one step further, where a's component goes on
    return every.join(above, "component", "left").select("node", F.coalesce("over", "component").alias("component"))


def near(percent: int, x: str, y: str) -> str:
    """SQL: whether two sets can have that Jaccard similarity, by size and by a lower bound of their difference.

    A side has ``n`` elements, of which ``alone`` are no other set's, and ``bits``: per bit the parity of how many
    of its other elements fall there. Sets differ in at least as many elements as parities. Null bits bound nothing.
    """
    odd = " + ".join(f"bit_count({x}bits[{i}] ^ {y}bits[{i}])" for i in range(16))
    return (
        f"100 * least({x}n, {y}n) >= {percent} * greatest({x}n, {y}n) and coalesce("
        f"({100 + percent}) * ({x}alone + {y}alone + {odd}) <= {100 - percent} * ({x}n + {y}n), true)"
    )


def cross_pairs(rows: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Of ``open_blocks`` the pairs (a < b) of one block, not yet in one component, that ``near`` leaves.

    Nodes outside the largest component meet the rest, so a block with one very large component makes rows in
    proportion to it. ``nodes``: (node, n, alone, bits). Where blocks have ``left``, the number of the node's elements
    from the key on in an order that all nodes share, a pair is only made if these suffice; where nodes have ``keys``,
    all keys of the node, a pair is made at its least common key alone.
    """
    full = cut_lineage(rows.join(nodes, "node"))
    names = ["node", "c", "n", "alone", "bits", *({"left", "keys"} & {*rows.columns, *nodes.columns})]
    x = full.filter("c != top").select("key", *[F.col(m).alias(f"x_{m}") for m in names])
    y = full.select("key", *[F.col(m).alias(f"y_{m}") for m in names])
    # a pair whose both nodes are outside the largest component would come twice
    once = "x_c != y_c and (x_node < y_node or y_c = top)"
    x = x.join(full.select("key", "top").distinct(), "key")
    first = f"{100 + percent} * least(x_left, y_left) >= {percent} * (x_n + y_n)" if "left" in rows.columns else "true"
    least = "array_min(array_intersect(x_keys, y_keys)) = key" if "keys" in nodes.columns else "true"
    pairs = x.join(y, "key").filter(f"{once} and {first} and {near(percent, 'x_', 'y_')} and {least}")
    return pairs.select(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b")).distinct()
