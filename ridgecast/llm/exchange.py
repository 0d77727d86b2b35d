"""Fingerprints that several owners share, found by shuffling packed arrays instead of one row each.

A task collects (owner, fingerprint) entries and deals them into buckets by fingerprint, one row per
bucket with two packed columns. A bucket's rows then meet in one task, which is many times smaller than
the input however often one fingerprint occurs, because equal entries of a task were joined before.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ridgecast.llm import tables
from ridgecast.llm.text import mix

#: Entries that a task gathers before it deals them out: each takes some hundred bytes of the worker then.
HELD = 1 << 18
PACKED = "bucket int, owners binary, prints binary, counts binary"
_PACKED = pa.schema([("bucket", pa.int32()), ("owners", pa.binary()), ("prints", pa.binary()), ("counts", pa.binary())])


def buckets(df: DataFrame, to_a_partition: int = 4) -> int:
    return to_a_partition * tables.partitions(df.sparkSession)


def pack_ids(a: np.ndarray) -> bytes:
    """Whole numbers as differences in the narrowest type that holds them all."""
    d = np.diff(a)
    low, high = (int(d.min()), int(d.max())) if len(d) else (0, 0)
    width = next(w for w in (1, 2, 4, 8) if -(1 << 8 * w - 1) <= low and high < 1 << 8 * w - 1)
    return bytes([width]) + a[:1].tobytes() + d.astype(f"<i{width}").tobytes()


def unpack_ids(raw: bytes) -> np.ndarray:
    """What ``pack_ids`` packed."""
    out = np.frombuffer(raw, "<i8", 1, 1)
    return np.concatenate((out, np.frombuffer(raw, f"<i{raw[0]}", -1, 9))).cumsum()


def place(values: np.ndarray, n: int) -> np.ndarray:
    return (((values >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int32)


def _rows(bucket: np.ndarray, owners: np.ndarray, prints: np.ndarray, counts: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    order = np.argsort(bucket, kind="stable")
    bucket, owners, prints = bucket[order], owners[order], prints[order]
    counts = None if counts is None else counts[order]
    edges = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True])))
    for part in range(0, len(edges) - 1, 512):
        rows = [(int(bucket[a]), pack_ids(owners[a:b]), prints[a:b].tobytes(), b"" if counts is None else counts[a:b].tobytes())
                for a, b in zip(edges[part : part + 512].tolist(), edges[part + 1 : part + 513].tolist())]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _PACKED.types, strict=True)], schema=_PACKED)


def by_print(entries: Iterable[tuple[np.ndarray, np.ndarray]], n: int) -> Iterator[pa.RecordBatch]:
    """Packs (owners, 64-bit fingerprints); of a print its bucket and 32 more bits are sent."""
    for owners, prints in _held(entries):
        if len(owners):
            yield from _rows(place(prints, n), owners, prints.astype(np.uint32), None)


def by_owner(entries: Iterable[tuple[np.ndarray, np.ndarray, np.ndarray]], n: int) -> Iterator[pa.RecordBatch]:
    for owners, tokens, counts in _held(entries):
        if len(owners):
            yield from _rows(place(mix(owners.astype(np.uint64)), n), owners, tokens.astype(np.int64), counts.astype(np.int32))


def _held(entries: Iterable[tuple[np.ndarray, ...]]) -> Iterator[tuple[np.ndarray, ...]]:
    held: list[tuple[np.ndarray, ...]] = []
    size = 0
    for entry in entries:
        held.append(entry)
        size += len(entry[0])
        if size >= HELD:
            yield tuple(map(np.concatenate, zip(*held)))
            held, size = [], 0
    if held:
        yield tuple(map(np.concatenate, zip(*held)))


def _buckets(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
    for bucket, group in groupby(rows, key=lambda r: r[0]):
        _, owners, prints, counts = zip(*group)
        yield (bucket, np.concatenate([unpack_ids(o) for o in owners]), np.concatenate([np.frombuffer(p, kind) for p in prints]),
               np.frombuffer(b"".join(counts), np.int32))


def met(packed: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return packed.repartition(tables.partitions(packed.sparkSession), "bucket").sortWithinPartitions("bucket").mapInArrow(work, schema)


def shared(packed: DataFrame, repeats: bool = False) -> DataFrame:
    """Entries whose fingerprint has two or more owners, packed again by owner, with its number of entries.

    ``repeats``: tasks may have sent the same entry, which counts once.
    """
    n = buckets(packed)

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for bucket, owners, prints, _ in _buckets(batches, "<u4"):
            order = np.argsort(prints, kind="stable")
            prints, owners = prints[order], owners[order]
            starts = np.flatnonzero(np.concatenate(([True], prints[1:] != prints[:-1])))
            sizes = np.diff(np.append(starts, len(prints)))
            several = np.minimum.reduceat(owners, starts) != np.maximum.reduceat(owners, starts)
            keep = np.repeat(several, sizes)
            prints, owners, sizes = prints[keep], owners[keep], sizes[several]
            if repeats:
                order = np.lexsort((owners, prints))
                prints, owners = prints[order], owners[order]
                new = np.append(True, (prints[1:] != prints[:-1]) | (owners[1:] != owners[:-1]))[: len(prints)]
                prints, owners = prints[new], owners[new]
                sizes = np.unique(prints, return_counts=True)[1]
            yield owners, (np.int64(bucket) << np.int64(32)) + prints.astype(np.int64), np.repeat(sizes, sizes)

    return met(packed, lambda batches: by_owner(entries(batches), n), PACKED)


def gathered(packed: DataFrame) -> DataFrame:
    """Rows (owner, tokens, counts, bits) of entries packed by owner, in no order within a row.

    ``bits`` are 1024 parities: per bit whether an odd number of tokens with a positive count falls there.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, owners, tokens, counts in _buckets(batches, "<i8"):
            order = np.argsort(owners, kind="stable")
            owners = owners[order]
            starts = np.flatnonzero(np.concatenate(([True], owners[1:] != owners[:-1])))
            tokens, counts = tokens[order], counts[order]
            offsets = pa.array(np.append(starts, len(owners)), pa.int32())
            bits = np.stack([np.bitwise_xor.reduceat(w, starts) for w in parities(np.where(counts > 0, tokens, -1))], 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(owners[starts]), pa.ListArray.from_arrays(offsets, tokens), pa.ListArray.from_arrays(offsets, counts),
                 pa.ListArray.from_arrays(pa.array(np.arange(len(starts) + 1) * 16, pa.int32()), bits.ravel())],
                names=["owner", "tokens", "counts", "bits"],
            )

    return met(packed, work, "owner bigint, tokens array<bigint>, counts array<int>, bits array<bigint>")


def ranked_nodes(packed: DataFrame) -> DataFrame:
    """Rows (node, rank, keys) of distinct entries packed by owner; ``rank`` is the sum of its counts, see ``graph.ranked``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, owners, tokens, counts in _buckets(batches, "<i8"):
            order = np.argsort(owners, kind="stable")
            owners, tokens = owners[order], tokens[order]
            starts = np.flatnonzero(np.append(True, owners[1:] != owners[:-1]))
            keys = pa.ListArray.from_arrays(pa.array(np.append(starts, len(owners)), pa.int32()), tokens)
            rank = np.add.reduceat(counts[order].astype(np.int64), starts)
            yield pa.RecordBatch.from_arrays([pa.array(owners[starts]), pa.array(rank), keys], names=["node", "rank", "keys"])

    return met(packed, work, "node bigint, rank bigint, keys array<bigint>")


def parities(tokens: np.ndarray) -> Iterator[np.ndarray]:
    """Sixteen words for each token from 0 up, with its one bit set in one of them; none for negative tokens."""
    place = mix(tokens.astype(np.uint64))
    bit = np.left_shift(np.uint64(1), place & np.uint64(63)).astype(np.int64)
    word = np.where(tokens >= 0, (place >> np.uint64(6)) & np.uint64(15), 16)
    for w in range(16):
        yield np.where(word == w, bit, 0)
