"""Line dedup (6): fuzzy lines by MinHash, checked exactly, one line of each component stays.

Equal lines count as one from the start. Bands that several different lines share come from the packed
exchange, so no line text is shuffled before two lines are known to be candidates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgecast.llm import exchange, tables
from ridgecast.llm.graph import components, cross_pairs, hooked, leader_pairs, open_blocks, top_pairs
from ridgecast.llm.text import chunks, mix, with_columns
from ridgecast.session import cut_lineage, forget

CHARS = 5
#: Two lines link when 100 * shared shingles >= PERCENT * all shingles of both.
PERCENT = 80
#: Each band joins ROWS of HASHES minima, all used about equally often. Lines that are not alike seldom meet in a band
#: of seven, and a pair at the threshold meets in some band with a chance of 0.996, one at 0.85 with 0.9998.
BANDS, ROWS, HASHES = 32, 7, 84
#: Characters of lines that a task works on at once: each takes some hundred bytes of the worker then.
PIECE = 1 << 17
BLANK = " \t\n\x0b\x0c\r"
HAS_WORD = r"[^\x20\x09-\x0D]"

_draw = np.random.default_rng(71)
_A = _draw.integers(0, 2**31, HASHES, np.uint32) * np.uint32(2) + np.uint32(1)
_B = _draw.integers(0, 2**32, HASHES, np.uint32)
_PLACE = _draw.integers(0, 2**63, 16, np.uint64) * np.uint64(2) + np.uint64(1)

_SEEDS = np.arange(1, BANDS + 1, dtype=np.uint64) * _PLACE[15]
_CHOSEN: list[np.ndarray] = []
while len(_CHOSEN) < BANDS:
    _CHOSEN += np.split(_draw.permutation(HASHES)[: HASHES // ROWS * ROWS], HASHES // ROWS)
_CHOSEN = _CHOSEN[:BANDS]


def line_key(line: bytes) -> int:
    """What Spark's ``xxhash64`` gives for the line as a string."""
    return xxhash.xxh64_intdigest(line, 42) - (1 << 64) * (xxhash.xxh64_intdigest(line, 42) >> 63)


def shingle_hashes(lines: list[str], k: int = CHARS) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all shingles of all lines, and where each line starts; a shorter line is one shingle."""
    raw = [x.encode("utf-32-le", "surrogatepass") for x in lines]
    lengths = np.array([len(r) // 4 for r in raw], np.int64)
    padded = np.maximum(lengths, k)
    points = np.zeros(int(padded.sum()), np.uint64)
    edges = np.append(0, np.cumsum(padded))
    if (lengths == padded).all():
        points[:] = np.frombuffer(b"".join(raw), "<u4")
    else:
        points[:] = np.frombuffer(b"".join(r.ljust(4 * k, b"\0") for r in raw), "<u4")
    h = points[: len(points) - k + 1] * _PLACE[0]
    for j in range(1, k):
        h += points[j : len(points) - k + 1 + j] * _PLACE[j]
    inside = np.ones(len(h), bool)
    for j in range(1, k):
        inside[edges[1:-1] - j] = False
    return mix(h[inside]), np.append(0, np.cumsum(padded - k + 1)[:-1])


def band_prints(lines: list[str], k: int = CHARS) -> np.ndarray:
    """One 64-bit print per line and band."""
    h, starts = shingle_hashes(lines, k)
    h = (h >> np.uint64(32)).astype(np.uint32)
    least = np.empty((HASHES, len(lines)), np.uint64)
    scratch = np.empty_like(h)
    for k in range(HASHES):
        np.multiply(h, _A[k], out=scratch)
        scratch += _B[k]
        least[k] = np.minimum.reduceat(scratch, starts)
    out = np.empty((len(lines), BANDS), np.uint64)
    for band, chosen in enumerate(_CHOSEN):
        out[:, band] = mix((least[chosen] * _PLACE[:ROWS, None]).sum(0) + _SEEDS[band])
    return out


def _packed_bands(docs: DataFrame) -> DataFrame:
    n = exchange.buckets(docs)

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        met: set[int] = set()
        for _, texts in chunks(batches, PIECE):
            new: dict[int, str] = {}
            for text in texts:
                for line in (text or "").split("\n"):
                    if line.strip(BLANK):
                        key = line_key(line.encode("utf-8", "surrogatepass"))
                        if key not in met:
                            new[key] = line
            if len(met) < 200_000:  # a further copy is only further work
                met.update(new)
            if new:
                keys = np.array(list(new), np.int64)
                yield np.repeat(keys, BANDS), band_prints(list(new.values())).ravel()

    return docs.select("text").mapInArrow(lambda batches: exchange.by_print(entries(batches), n), exchange.PACKED)


#: A row's id and a 128-bit print of its text: what two rows of one id and other texts are told apart by.
ROW = ["doc_id", "_p", "_q"]


def with_prints(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"_p": F.xxhash64("text"), "_q": F.xxhash64(F.lit(7), "text")})


def lines(docs: DataFrame) -> DataFrame:
    """(ROW, line_no, line, key) of every line with a word; rows without an id have no lines."""
    split = with_prints(docs.filter("doc_id is not null")).select(*ROW, F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return split.filter(F.col("line").rlike(HAS_WORD)).withColumn("key", F.xxhash64("line"))


def shingle_prints(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A whole number from 0 up for each distinct shingle of each line, and where each line starts."""
    h, starts = shingle_hashes(lines)
    h >>= np.uint64(1)
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(h)]):
        h[a:b].sort()
    new = np.append(True, h[1:] != h[:-1])
    new[starts] = True
    return h[new].astype(np.int64), (np.cumsum(new) - 1)[starts]


def described(texts: DataFrame) -> DataFrame:
    """Lines (key, line) with the size ``n`` of their shingle set and its parities, see ``graph.near``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, found in chunks(batches, PIECE, "line"):
            prints, starts = shingle_prints(found)
            n = np.diff(np.append(starts, len(prints)))
            bits = np.stack([np.bitwise_xor.reduceat(w, starts) for w in exchange.parities(prints)], 1)
            bits = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * 16, pa.int32()), bits.ravel())
            yield with_columns(piece, {"n": n, "alone": np.zeros(len(found), np.int64), "bits": bits}, out_schema)

    _, schema = tables.appended(texts, "n bigint, alone bigint, bits array<bigint>")
    out_schema = tables.arrow(schema)
    return texts.mapInArrow(work, schema)


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) of line keys whose sets of character shingles are similar enough, counted over all of both lines."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, left in chunks(batches, PIECE, "line_a"):
            a, b = (piece.column(k).to_pylist() for k in (0, 1))
            found = dict(zip(a, left, strict=True)) | dict(zip(b, piece.column(3).to_pylist(), strict=True))
            prints, starts = shingle_prints(list(found.values()))
            sets = dict(zip(found, np.split(prints, starts[1:])))
            same = []
            for x, y in zip(a, b):
                s, t = sets[x], sets[y]
                both = len(np.intersect1d(s, t, assume_unique=True))
                same.append(100 * both >= PERCENT * (len(s) + len(t) - both))
            yield piece.select(["a", "b"]).filter(pa.array(same, pa.bool_()))

    lines_of = (texts.select(F.col("key").alias(m), F.col("line").alias(f"line_{m}")) for m in "ab")
    rows = pairs.join(next(lines_of), "a").join(next(lines_of), "b")
    return rows.select("a", "b", "line_a", "line_b").mapInArrow(work, "a bigint, b bigint")


def line_components(docs: DataFrame) -> DataFrame:
    """(key, component) of the lines that link to a different one.

    Each line is tried with the leader of most of its bands, then with one line of the largest group that it meets there.
    Lines that resemble the one they were tried with are of its group; then lines of one band and different groups are
    tried, those of the largest group only with the rest. All links that hold go into one union of components.
    """
    nodes = cut_lineage(exchange.ranked_nodes(exchange.shared(_packed_bands(docs), repeats=True)))
    blocks = nodes.select(F.explode("keys").alias("key"), "node", "rank")
    found = lines(docs).join(tables.maybe_broadcast(nodes.select(F.col("node").alias("key")), 48), "key", "left_semi")
    texts = cut_lineage(described(found.groupBy("key").agg(F.first("line").alias("line"))))
    led = cut_lineage(verified(leader_pairs(blocks), texts))
    labels = cut_lineage(hooked(led.select(F.col("b").alias("node"), F.col("a").alias("component")).limit(0), led))
    tried = cut_lineage(verified(cut_lineage(top_pairs(open_blocks(blocks, labels))), texts))
    groups = cut_lineage(hooked(labels, tried))
    facts = texts.select(F.col("key").alias("node"), "n", "alone", "bits").join(nodes.select("node", "keys"), "node")
    more = cut_lineage(verified(cross_pairs(open_blocks(blocks, groups), facts, PERCENT), texts))
    joined = cut_lineage(components(led.union(tried).union(more)).toDF("key", "component"))
    forget(nodes, texts, led, labels, tried, groups, more)
    return joined


def removed_lines(docs: DataFrame) -> DataFrame:
    """(ROW, gone): the numbers of the lines that repeat an earlier line of their component."""
    tables.bound_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    labels = line_components(docs)
    place = lines(docs).select(*ROW, "line_no", "key")
    grouped = place.join(tables.maybe_broadcast(labels, 48), "key", "left").select(*ROW, "line_no", F.coalesce("component", "key").alias("g"))
    grouped = cut_lineage(grouped)
    spot = F.struct(*ROW, "line_no")
    first = cut_lineage(grouped.groupBy("g").agg(F.min(spot).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"))
    later = grouped.join(tables.maybe_broadcast(first, 96), "g").filter(spot != F.col("first"))
    gone = cut_lineage(later.groupBy(*ROW).agg(F.collect_set("line_no").alias("gone")))
    forget(labels, grouped, first)
    return gone


MADE = "n_lines bigint, n_removed bigint"


def line_dedup(docs: DataFrame) -> DataFrame:
    """Every document without the lines that repeat an earlier one, and ``n_lines`` (with a word) and ``n_removed``.

    Order is by doc_id, then line. Blank lines stay. A document may end up empty; no row is dropped. Null
    texts and rows without a doc_id pass unchanged and take part in nothing. Rows that repeat one doc_id and text
    count as one occurrence; rows of one doc_id and other texts are documents of their own, in the order of their
    prints. Input columns named as a made column are replaced.
    """
    gone = removed_lines(docs)
    size = gone.agg(F.sum(F.size("gone") + 8)).first()[0] or 0
    held = F.broadcast(gone) if 16 * size <= tables.BROADCAST_BYTES else gone
    source, schema = tables.appended(docs, MADE)
    tail = "_" * max(map(len, docs.columns))  # no input column has such names
    mark, p, q = f"gone{tail}", f"p{tail}", f"q{tail}"
    marked = source.withColumns({p: F.xxhash64("text"), q: F.xxhash64(F.lit(7), "text")})
    names = {"gone": mark, "_p": p, "_q": q}
    joined = marked.join(held.withColumnsRenamed(names), ["doc_id", p, q], "left").select(*source.columns, mark)
    out_schema = tables.arrow(schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, texts in chunks(batches):
            kept, total, removed = [], [], []
            for text, marks in zip(texts, piece.column(piece.schema.get_field_index(mark)).to_pylist(), strict=True):
                parts = (text or "").split("\n")
                total.append(sum(1 for p in parts if p.strip(BLANK)))
                removed.append(len(marks or ()))
                away = set(marks or ())
                kept.append(text if not away else "\n".join(p for k, p in enumerate(parts) if k not in away))
            yield with_columns(piece, {"text": kept, "n_lines": total, "n_removed": removed}, out_schema)

    return joined.mapInArrow(cut, schema)


def stage(docs: DataFrame) -> DataFrame:
    """``line_dedup`` for a pipeline: the same rows and columns, texts without repeated lines."""
    return line_dedup(docs).select(*docs.columns)
