"""Best-fit packing (5): best-fit decreasing over piece lengths, laid out by Spark.

Lengths are whole numbers up to the capacity, so equal pieces are interchangeable. The plan is
made once over the counts per length, whose size the capacity bounds; it treats equal pieces
and equal bins together and gives exactly what best-fit decreasing gives piece by piece.
"""

from __future__ import annotations

import base64
import re
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridgecast.llm import tables
from ridgecast.llm.text import chunks
from ridgecast.session import cut_lineage

CAPACITY = 2048
#: Fixed value: the separating id behind each document.
END_ID = 0
#: How the vocabulary's pattern ends: white space before a word gives its last character to what follows.
ENDING, PLAIN_ENDING = r"|\s+(?!\S)|\s+", r"|\s+"
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"  # what \s is to the pattern
#: The last but one character of white space before a word: no piece of the pattern goes beyond it.
LAST_BUT_ONE = re.compile(f"[{_SPACE}](?=[{_SPACE}][^{_SPACE}])")
#: A text with more such places than one in so many characters is not cut there.
CUT_EVERY = 250
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


class Encoder:
    """Ids of a byte-level BPE vocabulary given as a tokenizer file and as ranks: same ids, the ranks sooner.

    The pattern looks ahead only behind white space. In a text cut before the last character of each longer run of it, the
    pattern finds the same pieces without looking ahead, and far sooner.
    """

    _loaded: dict[str, Encoder] = {}

    def __init__(self, path: str, ranks_path: str) -> None:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
        pattern = public_tokenizers.PATTERN
        self.ranks = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.plain = None
        if pattern.endswith(ENDING):
            pattern = pattern.removesuffix(ENDING) + PLAIN_ENDING
            self.plain = tiktoken.Encoding("plain", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    @classmethod
    def get(cls, path: str, ranks_path: str) -> Encoder:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path, ranks_path)
        return cls._loaded[path]

    def __call__(self, text: str) -> bytes:
        """Ids as 32-bit words; a text that holds a special token's string goes to the tokenizer itself."""
        if any(s in text for s in self.special):
            return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()
        return array("I", self._ordinary(text)).tobytes()

    def _ordinary(self, text: str) -> list[int]:
        most = len(text) // CUT_EVERY
        cuts = [m.end() for m in islice(LAST_BUT_ONE.finditer(text), most + 1)]
        if self.plain is None or len(cuts) > most:
            return self.ranks.encode_ordinary(text)
        if not cuts:
            return self.plain.encode_ordinary(text)
        return [i for a, b in zip([0, *cuts], [*cuts, len(text)]) for i in self.plain.encode_ordinary(text[a:b])]


def pieces(docs: DataFrame, tokenizer: str, ranks: str, capacity: int = CAPACITY) -> DataFrame:
    """Each document's ids and the end id, cut into pieces of ``capacity``; only the first may be shorter."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder.get(tokenizer, ranks)
        end = array("I", [END_ID]).tobytes()
        for piece, texts in chunks(batches):
            rows: list[tuple] = []
            for doc_id, text in zip(piece.column(0).to_pylist(), texts, strict=True):
                ids = encode(text or "") + end
                n = len(ids) // 4
                first = n % capacity or capacity
                edges = [0, *range(first, n + 1, capacity)]
                rows += [(doc_id, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(edges, edges[1:]))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), out.types, strict=True)], schema=out)

    out = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(cut, PIECES)


class Tightest:
    """Segment tree over remaining capacities: the smallest one of at least r that open bins have."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.size)

    def add(self, remaining: int, bins: int) -> None:
        i = remaining + self.size
        while i:
            self.tree[i] += bins
            i //= 2

    def find(self, least: int) -> int | None:
        i = least + self.size
        if self.tree[i]:
            return least
        while i > 1:
            if i % 2 == 0 and self.tree[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.tree[2 * i] else 2 * i + 1
                return i - self.size
            i //= 2
        return None


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, pieces, pieces to a bin, first bin, offset in the bin) of best-fit decreasing.

    Bins stand in runs of consecutive numbers with equal room. A piece goes to the tightest open
    bin; while that bin has room for more of its length it stays the tightest, so each bin of
    a run takes all it can before the next one does.
    """
    room: dict[int, list[tuple[int, int]]] = {}
    open_bins = Tightest(capacity)
    rows = []
    new_bin = 0

    def put(remaining: int, start: int, bins: int) -> None:
        if remaining and bins:
            room.setdefault(remaining, []).append((start, bins))
            open_bins.add(remaining, bins)

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            remaining = open_bins.find(length)
            if remaining is None:
                remaining = capacity
                start, bins = new_bin, -(-left // (capacity // length))
                new_bin += bins
            else:
                start, bins = room[remaining].pop()
                open_bins.add(remaining, -bins)
            each = remaining // length
            used = min(bins, -(-left // each))
            take = min(left, used * each)
            rows.append((length, rank, take, each, start, capacity - remaining))
            full = take // each
            put(remaining - each * length, start, full)
            if used > full:
                put(remaining - (take - full * each) * length, start + full, 1)
            put(remaining, start + used, bins - used)
            left -= take
            rank += take
    return rows


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to stored pieces (rows with ``length`` from 1 to ``capacity``).

    Ranks within a length are counted in salted groups, whose sizes are summed first, so a length that
    a third of all pieces have is no single task's work. No pieces give no rows.
    """
    spark = parts.sparkSession
    salts = 4 * tables.partitions(spark)
    salted = parts.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    sizes = salted.groupBy("length", "salt").count()
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # at most `capacity` rows
    plan: dict[int, list[tuple]] = {}
    for row in plan_bins(counts, capacity):
        plan.setdefault(row[0], []).append(row[1:])
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = salted.withColumn("nth", F.row_number().over(within) - 1).join(base, ["length", "salt"])
    ranked = ranked.select(*parts.columns, (F.col("base") + F.col("nth")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = {length: [r[0] for r in rows] for length, rows in plan.items()}
        for batch in batches:
            at = {n: k for k, n in enumerate(batch.schema.names)}
            sequence, offset = [], []
            for length, rank in zip(batch.column(at["length"]).to_pylist(), batch.column(at["rank"]).to_pylist(), strict=True):
                first, _, each, start, used = plan[length][bisect_right(starts[length], rank) - 1]
                nth = rank - first
                sequence.append(start + nth // each)
                offset.append(used + nth % each * length)
            columns = [batch.column(at[c]) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], names=[*names, "sequence_id", "offset"])

    names = parts.columns
    return ranked.mapInArrow(place, f"{PIECES}, sequence_id bigint, offset bigint")


def best_fit_packing(docs: DataFrame, tokenizer: str, ranks: str, capacity: int = CAPACITY) -> DataFrame:
    """Packs all documents (null text: empty) into sequences of at most ``capacity`` ids.

    ``tokenizer`` and ``ranks`` are two files of one byte-level BPE vocabulary. Only (doc_id, text) is
    read; other columns never matter. An empty text is a piece of one id. Repeated rows are packed
    each; a null doc_id stays null. Texts are encoded in one narrow pass and only the short rows of
    pieces are stored, ranked and shuffled.
    """
    return pack(cut_lineage(pieces(docs, tokenizer, ranks, capacity)), capacity)
