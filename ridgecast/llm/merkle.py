"""Merkle dataset manifest (12): each row's witness, grown while leaves are appended in order.

A tree takes leaves as a stream. Its open subtrees carry the partial witnesses of their leaves; when a sibling
subtree is complete, each side's root is put to the witnesses of the other side. Aligned blocks of leaves are such
streams, one after another in many tasks; their roots are appended to the next level as leaves are, until one is left.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridgecast.llm import tables
from ridgecast.llm.placed import numbered
from ridgecast.session import cut_lineage

#: A block has 2 ** HEIGHT leaves.
HEIGHT = 10
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
NO_GROUP, GROUP = "0", "1"  # a null group stands before all others


def field(value: Column) -> Column:
    """``-`` for null, else the value's UTF-8 length, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def join(*nodes: str) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


class Tree:
    """Open subtrees of a stream of leaves: (height, root, first leaf), high ones first, and what each leaf's witness is so far."""

    def __init__(self) -> None:
        self.open: list[tuple[int, str, int]] = []
        self.witness: list[list[str]] = []

    def append(self, node: str) -> None:
        first, height = len(self.witness), 0
        self.witness.append([])
        while self.open and self.open[-1][0] == height:
            node, first = self._complete(node, first)
            height += 1
        self.open.append((height, node, first))

    def _complete(self, node: str, first: int) -> tuple[str, int]:
        _, other, start = self.open.pop()
        for k in range(start, first):
            self.witness[k].append(node)
        for k in range(first, len(self.witness)):
            self.witness[k].append(other)
        return join(other, node), start

    def finish(self, height: int) -> str:
        """The root at a height: a node that stays alone in its run becomes its own hash."""
        level, node, first = self.open.pop()
        while level < height:
            if self.open and self.open[-1][0] == level:
                node, first = self._complete(node, first)
            else:
                node = join(node)
            level += 1
        return node


def levels(size: int) -> int:
    return max(0, size - 1).bit_length()


def fold(node: str, nth: int, size: int, witness: list[str]) -> str:
    """The root of ``size`` leaves that a leaf at place ``nth`` and its siblings, lowest first, lead to."""
    rest = iter(witness)
    while size > 1:
        if nth % 2:
            node = join(next(rest), node)
        else:
            node = join(node, next(rest)) if nth + 1 < size else join(node)
        nth, size = nth // 2, (size + 1) // 2
    return node


def _blocks(nodes: DataFrame) -> DataFrame:
    """Rows (grp, nth, size, node, ...) with their block, its root ``top`` and their siblings inside it, 32 bytes each."""
    source = nodes.withColumn("block", F.shiftright("nth", HEIGHT))
    schema = T.StructType([*source.schema, T.StructField("top", T.StringType()), T.StructField("siblings", T.BinaryType())])
    out, spot = tables.arrow(schema), {c: k for k, c in enumerate(source.columns)}
    dealt = source.repartition(tables.partitions(nodes.sparkSession), "grp", "block").sortWithinPartitions("grp", "block", "nth")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        for _, leaves in groupby(rows, key=lambda r: (r[spot["grp"]], r[spot["block"]])):
            block, tree = list(leaves), Tree()
            for row in block:
                tree.append(row[spot["node"]])
            top = tree.finish(min(HEIGHT, levels(block[0][spot["size"]])))
            columns = [*zip(*block), [top] * len(block), [bytes.fromhex("".join(w)) for w in tree.witness]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out, strict=True)], schema=out)

    return dealt.mapInArrow(work, schema)


def witnessed(nodes: DataFrame) -> DataFrame:
    """Rows (grp, nth, size, node, ...) with ``top``, the root of their group, and ``siblings`` up to it.

    Each round works on one row a block of the round before; witnesses are then put together from the top down, so
    the leaves are joined once.
    """
    rounds = [cut_lineage(_blocks(nodes))]
    while (rounds[-1].agg(F.max("size")).first()[0] or 0) > 1 << HEIGHT:
        heads = rounds[-1].filter(F.col("nth") % (1 << HEIGHT) == 0)
        above = heads.select("grp", F.col("block").alias("nth"), F.shiftright(F.col("size") + ((1 << HEIGHT) - 1), HEIGHT).alias("size"), F.col("top").alias("node"))
        rounds.append(cut_lineage(_blocks(above)))
    whole = rounds.pop()
    while rounds:
        upper = whole.select("grp", F.col("nth").alias("block"), F.col("top").alias("_top"), F.col("siblings").alias("_more"))
        lower = rounds.pop()
        kept = [c for c in lower.columns if c not in ("top", "siblings")]
        joined = lower.join(tables.maybe_broadcast(cut_lineage(upper), 1024), ["grp", "block"])
        whole = joined.select(*kept, F.col("_top").alias("top"), F.concat("siblings", "_more").alias("siblings"))
    return whole.drop("block")


def manifest(docs: DataFrame, group: str = "lang", order: str = "doc_id", fields: tuple[str, ...] = FIELDS, carried: tuple[str, ...] = ()) -> DataFrame:
    """(order, leaf, subroot, root, nth, size, group_nth, group_size, siblings, carried columns) of every row.

    The siblings stand in path order, 32 bytes each. A group's leaves ascend by ``order`` (nulls first; equal ones by
    leaf, then as they stand), groups by name, null first. Equal rows are leaves each; no rows give no manifest. Columns
    outside ``fields`` and ``carried`` are not read, so their names never matter.
    """
    grp = F.coalesce(F.concat(F.lit(GROUP), docs[group].cast("string")), F.lit(NO_GROUP)).alias("grp")
    extra = [docs[c].alias(f"_carried{k}") for k, c in enumerate(carried)]
    leaves = docs.select(docs[order].alias("_key"), grp, leaf(*(docs[f] for f in fields)).alias("node"), *extra)
    inner = cut_lineage(witnessed(numbered(leaves, "grp", ["_key", "node"])))
    subroots = inner.filter("nth = 0").select(F.lit("").alias("all"), F.col("grp").alias("name"), F.col("top").alias("node"))
    ranked = numbered(subroots, "all", ["name"])
    outer = witnessed(ranked.select(F.col("all").alias("grp"), "nth", "size", "node", "name"))
    over = outer.select(F.col("name").alias("grp"), F.col("nth").alias("group_nth"), F.col("size").alias("group_size"), F.col("top").alias("root"), F.col("siblings").alias("_more"))
    whole = inner.join(tables.maybe_broadcast(cut_lineage(over), 1024), "grp")
    kept = [F.col(f"_carried{k}").alias(c) for k, c in enumerate(carried)]
    return whole.select(F.col("_key").alias(order), F.col("node").alias("leaf"), F.col("top").alias("subroot"), "root", "nth", "size", "group_nth",
                        "group_size", F.concat("siblings", "_more").alias("siblings"), *kept)


def folded(rows: DataFrame, node: str = "leaf", name: str = "folded_root") -> DataFrame:
    """Rows of a manifest with the root that the hash in column ``node`` leads to along their siblings."""
    spot = [rows.columns.index(c) for c in (node, "nth", "size", "group_nth", "group_size", "siblings")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roots = []
            for start, nth, size, group_nth, group_size, text in zip(*(batch.column(k).to_pylist() for k in spot), strict=True):
                path = [text[k : k + 32].hex() for k in range(0, len(text), 32)]
                inside = sum(1 for k in range(levels(size)) if (nth >> k) % 2 or (nth >> k) + 1 < -(-size >> k))
                roots.append(fold(fold(start, nth, size, path[:inside]), group_nth, group_size, path[inside:]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(roots, pa.string())], names=[*batch.schema.names, name])

    return rows.mapInArrow(work, T.StructType([*rows.schema, T.StructField(name, T.StringType())]))
