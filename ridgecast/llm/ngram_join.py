"""N-gram Jaccard join (1): a grouped prefix join of documents over distinct word shingles.

Shingles are ordered by how many documents have them, rarest first. Those of one document alone
come first and can meet nothing, so most documents drop out before any join. The rest are collapsed
into groups of equal size and prefix; group pairs that share a prefix shingle are filtered, expanded
and verified on the whole shared shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgecast.llm import exchange
from ridgecast.llm.graph import components, cross_pairs, leader_pairs, near, open_blocks, ranked, top_pairs
from ridgecast.llm.text import chunks, mix, shingle_sets
from ridgecast.session import cut_lineage

WORDS = 5
#: Two sets link when 100 * intersection >= PERCENT * union.
PERCENT = 75
_OTHER = np.uint64(0xA5A5A5A5A5A5A5A5)


def _signed(x: np.uint64) -> int:
    return int(np.uint64(x).astype(np.int64))


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, n_shingles, print_a, print_b): the size and a 128-bit print of each document's set."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, texts in chunks(batches):
            sets = list(shingle_sets(texts, words))
            yield pa.RecordBatch.from_arrays([
                piece.column(0),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([_signed(mix(s).sum(dtype=np.uint64)) for s in sets], pa.int64()),
                pa.array([_signed(mix(s ^ _OTHER).sum(dtype=np.uint64)) for s in sets], pa.int64()),
            ], names=["doc_id", "n_shingles", "print_a", "print_b"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(work, "doc_id bigint, n_shingles bigint, print_a bigint, print_b bigint")


def _packed_shingles(docs: DataFrame, words: int) -> DataFrame:
    n = exchange.buckets(docs)

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        met: set[tuple[int, int]] = set()  # equal sets of a task send their shingles once
        for piece, texts in chunks(batches):
            owners, prints = [], []
            for doc, s in zip(piece.column(0).to_pylist(), shingle_sets(texts, words), strict=True):
                key = (len(s), _signed(mix(s).sum(dtype=np.uint64)))
                if len(s) and key not in met:
                    met.add(key)
                    owners.append(np.full(len(s), doc, np.int64))
                    prints.append(s)
            if owners:
                yield np.concatenate(owners), np.concatenate(prints)

    ordered = docs.filter("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    # by doc_id, so that of equal sets the one with the smallest id is met first
    ordered = ordered.sortWithinPartitions("doc_id")
    return ordered.mapInArrow(lambda batches: exchange.by_print(entries(batches), n), exchange.PACKED)


def _needed(n: str) -> str:
    """Least intersection of a set of n with any set it links to."""
    return f"(({PERCENT} * {n} + 99) div 100)"


def candidates(docs: DataFrame, sizes: DataFrame, words: int) -> DataFrame:
    """(doc, n, alone, bits, prefix, tokens): sets that can link at all, with their shared shingles, rarest first.

    ``sizes`` (doc, n) names the documents wanted. Shingles of one document alone are not in ``tokens``;
    they stand first in the order, so what is left of the prefix is the head of ``tokens``.
    """
    n_buckets = exchange.buckets(docs)

    def pack_sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = ((np.asarray(b.column(0)), np.asarray(b.column(1)), np.full(b.num_rows, -1)) for b in batches)
        return exchange.by_owner(sizes, n_buckets)

    entries = exchange.shared(_packed_shingles(docs, words)).union(sizes.select("doc", "n").mapInArrow(pack_sizes, exchange.PACKED))

    # a document's size is the token with count -1; one without it is an equal set's further copy
    with_size = exchange.gathered(entries).filter("array_contains(counts, -1)")
    with_size = with_size.selectExpr("owner as doc", "tokens[array_position(counts, -1) - 1] as n", "tokens", "counts", "bits")
    enough = with_size.filter(f"size(tokens) - 1 >= {_needed('n')}")
    order = "array_sort(filter(arrays_zip(counts, tokens), x -> x.counts > 0))"
    found = enough.selectExpr("doc", "n", "n - size(tokens) + 1 as alone", "bits", f"transform({order}, x -> x.tokens) as tokens")
    prefix = f"slice(tokens, 1, cast(size(tokens) - {_needed('n')} + 1 as int)) as prefix"
    return found.selectExpr("doc", "n", "alone", "bits", prefix, "tokens")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) whose sets are similar enough, by their whole shared shingles."""
    sizes = ["n", "alone", "bits"]
    x, y = (sets.select(F.col("doc").alias(m), *[F.col(c).alias(f"{m}_{c}") for c in sizes]) for m in "ab")
    near_pairs = pairs.join(x, "a").join(y, "b").filter(near(PERCENT, "a_", "b_")).select("a", "b", "a_n", "b_n")
    left, right = (sets.select(F.col("doc").alias(m), F.col("tokens").alias(f"{m}_tokens")) for m in "ab")
    both = near_pairs.join(left, "a").join(right, "b").withColumn("i", F.size(F.array_intersect("a_tokens", "b_tokens")))
    return both.filter(f"100 * i >= {PERCENT} * (a_n + b_n - i)").select("a", "b")


def linked(sets: DataFrame) -> DataFrame:
    """(node, component) of the documents in ``sets`` that link to another one.

    First each document is tried with one leader, then with one of the largest component it may belong to, and
    at last with all that share a prefix shingle and still are in another component; so no link between two
    components is left untried, and none within one is needed.
    """
    group = ["n", "prefix"]
    groups = sets.groupBy(*group).agg(F.min("doc").alias("gid"))
    members = cut_lineage(sets.join(groups, group).select("doc", "gid"))
    heads = sets.join(members.filter("doc = gid"), "doc").select("gid", "n", "alone", F.posexplode("prefix").alias("nth", "key"))
    heads = cut_lineage(heads.select("gid", "key", (F.col("n") - F.col("alone") - F.col("nth")).alias("left")))
    stars = leader_pairs(ranked(heads.select("key", F.col("gid").alias("node")))).union(members.filter("doc != gid").select("gid", "doc"))
    labels = cut_lineage(components(cut_lineage(verified(stars, sets))))
    # members of one group and component stand together as a part, named by its first
    component = F.coalesce("component", "doc").alias("component")
    parts = cut_lineage(members.join(labels.withColumnRenamed("node", "doc"), "doc", "left").select("doc", "gid", component))
    part_of = parts.groupBy("gid", "component").agg(F.min("doc").alias("node"), F.count(F.lit(1)).alias("members"))
    part_of = cut_lineage(part_of)
    blocks = heads.join(part_of, "gid").select("key", "node", "left")
    tried = cut_lineage(top_pairs(open_blocks(blocks, part_of.select("node", "component"))))
    labels = cut_lineage(components(labels.toDF("a", "b").union(cut_lineage(verified(tried, sets)))))
    # group pairs are filtered by size, those of one member each also by their parities; then members meet
    facts = sets.select(F.col("doc").alias("node"), "n", "alone", "bits").join(part_of.select("node", "members"), "node")
    facts = facts.select("node", "n", "alone", F.when(F.col("members") == 1, F.col("bits")).alias("bits"))
    pairs = cross_pairs(open_blocks(blocks, labels), facts, PERCENT)
    inside = parts.join(part_of, ["gid", "component"]).select("node", "doc")
    expanded = pairs.join(inside.toDF("a", "x"), "a").join(inside.toDF("b", "y"), "b")
    expanded = expanded.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    more = cut_lineage(verified(expanded, sets))
    return components(labels.toDF("a", "b").union(more)) if more.take(1) else labels


def jaccard_components(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row; component_id is the smallest doc_id reachable by links.

    Equal sets are one set from the start. Null or empty texts have no shingles and stay alone, as does a
    null doc_id (its component is null). doc_id is the key: repeated rows give the same result twice.
    Other columns are never read. Sets are compared by 64-bit prints of shingles.
    """
    docs = docs.select("doc_id", "text")
    prints = cut_lineage(fingerprints(docs, words))
    equal = ["n_shingles", "print_a", "print_b"]
    classes = cut_lineage(prints.filter("n_shingles > 0 and doc_id is not null").groupBy(*equal).agg(F.min("doc_id").alias("doc")))
    sets = cut_lineage(candidates(docs, classes.select("doc", F.col("n_shingles").alias("n")), words))
    labels = linked(sets)
    of_class = classes.join(labels.withColumnRenamed("node", "doc"), "doc", "left").select(*equal, F.coalesce("component", "doc").alias("class"))
    known = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("class"))
    return prints.join(of_class, equal, "left").select("doc_id", "n_shingles", F.coalesce(known, "doc_id").alias("component_id"))


def stage(docs: DataFrame) -> DataFrame:
    """One document of each component, its first by doc_id, in the columns of the input."""
    away = jaccard_components(docs).filter("component_id != doc_id").select("doc_id").distinct()
    return docs.join(cut_lineage(away), "doc_id", "left_anti").select(*docs.columns)
