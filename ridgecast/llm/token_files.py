"""Token-ID files (13): ids of whole documents, compressed shard by shard with a Re-Pair grammar.

A shard holds whole documents in ascending doc_id order. Pairs of neighbouring ids that occur more than once become
nonterminals, round by round, until no pair does; the file keeps the rules and how many ids each symbol stands for, so any
stretch of ids is decoded without the rest of its shard.
"""

from __future__ import annotations

import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridgecast.llm import tables
from ridgecast.llm.packing import END_ID, Encoder
from ridgecast.llm.text import chunks
from ridgecast.session import cut_lineage, stored_folder

#: A shard ends with the document that brings it to so many ids; a file holds so many shards.
SHARD_IDS, FILE_SHARDS = 1 << 20, 16
#: Pairs are replaced until none occurs so often.
LEAST = 2
#: A round takes pairs that occur at least so often as this share of its most frequent pair.
ROUND_SHARE = 0.1
#: A table of so many bits of a hash leaves out pairs that occur once; one too many is only further work.
HASH_BITS = 20
#: So often all pairs left are looked at together; what is left then is looked at one by one.
PASSES = 4
#: Every so many symbols the file has the number of ids before them.
STEP = 256
#: So many symbols are expanded at once.
STRETCH = 1 << 14
MAGIC = b"RPG1"
#: start in the partition, documents, ids, symbols, rules, first nonterminal, bytes of a symbol
HEADER = struct.Struct("<4sQQQQIIB")


def _hashes(codes: np.ndarray) -> np.ndarray:
    """A place below 2**HASH_BITS for each code."""
    if codes.dtype == np.uint32:
        return (codes * np.uint32(0x9E3779B1)) >> np.uint32(32 - HASH_BITS)
    return (codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - HASH_BITS)


def _places(codes: np.ndarray, chosen: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Where each code, all of them among the sorted ``chosen`` or nearly so, would stand there; ``slots`` is scratch."""
    numbers = np.arange(len(chosen), dtype=slots.dtype)
    at = _hashes(chosen)
    slots[at] = numbers
    which = slots[_hashes(codes)]
    if (slots[at] != numbers).any():  # codes that share a place
        other = np.flatnonzero(chosen[which] != codes)
        which[other] = np.minimum(np.searchsorted(chosen, codes[other]), len(chosen) - 1)
    return which


def _frequent(codes: np.ndarray, shift: int, least: int, top: int) -> tuple[np.ndarray, np.ndarray]:
    """(chosen, often): codes of frequent pairs, taken most frequent first, of which none ends with a symbol that another
    begins with, and all codes that occur ``least`` times or more; both ascending. Symbols are below ``top``.

    Occurrences of such pairs never overlap, so to replace them in one round is to replace them one after another.
    """
    order = np.sort(codes)
    new = np.ones(len(order), bool)
    np.not_equal(order[1:], order[:-1], out=new[1:])
    starts = np.flatnonzero(new).astype(np.int32 if len(order) < 1 << 31 else np.int64)
    counts = np.diff(starts, append=starts.dtype.type(len(order)))
    several = np.flatnonzero(counts >= least)
    counts, often = counts[several], order[starts[several]]
    if not len(often):
        return often, often
    now = np.flatnonzero(counts >= max(least, ROUND_SHARE * int(counts.max())))
    now = often[now[np.argsort(-counts[now], kind="stable")]]
    roles = bytearray(top)  # 1 begins a chosen pair, 2 ends one
    seen = np.frombuffer(roles, np.uint8)
    lefts, rights = (now >> now.dtype.type(shift)).astype(np.intp), (now & now.dtype.type((1 << shift) - 1)).astype(np.intp)
    chosen = np.zeros(len(now), bool)
    rest = np.arange(len(now))
    begins, ends = np.full(top, len(now)), np.full(top, len(now))  # the first pair left that begins or ends with a symbol
    for _ in range(PASSES):
        rest = rest[(seen[lefts[rest]] & 2) + (seen[rights[rest]] & 1) == 0]
        left, right = lefts[rest], rights[rest]
        begins[left[::-1]] = ends[right[::-1]] = rest[::-1]
        taken = rest <= np.minimum(begins[right], ends[left])  # nothing before it is against it
        begins[left] = ends[right] = len(now)
        seen[left[taken]] |= 1
        seen[right[taken]] |= 2
        chosen[rest[taken]] = True
        rest = rest[~taken]
    for k, a, b in zip(rest.tolist(), lefts[rest].tolist(), rights[rest].tolist()):
        if not (roles[a] & 2 or roles[b] & 1 or (a == b and roles[a])):
            roles[a] |= 1
            roles[b] |= 2
            chosen[k] = True
    return np.sort(now[chosen]), often


def compress(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(symbols, rules, first nonterminal) of ids; rule k is the pair that nonterminal ``first + k`` stands for.

    A pair that occurs once never occurs more often later, as a replacement only makes pairs of its new symbol; so each
    round counts the places that may still be of a frequent pair, which soon are few.
    """
    first = top = int(ids.max()) + 1 if len(ids) else 0
    symbols = ids.astype(np.uint32)
    rules = [np.zeros((0, 2), np.uint32)]
    open_ = np.ones(len(symbols), bool)  # places whose pair may be a frequent one
    open_[-1:] = False
    marks, slots = np.zeros(1 << HASH_BITS, np.uint8), np.zeros(1 << HASH_BITS, np.int32)  # of all codes of one place together
    while (places := np.flatnonzero(open_)).size:
        shift, kind = (16, np.uint32) if top <= 1 << 16 else (32, np.uint64)
        if 3 * len(places) > len(symbols):  # sooner put together whole
            codes = symbols[:-1].astype(kind)
            codes <<= kind(shift)
            codes |= symbols[1:]
            codes = codes.take(places, mode="clip")
        else:
            codes = (symbols.take(places).astype(kind) << kind(shift)) | symbols.take(places + 1).astype(kind)
        chosen, often = _frequent(codes, shift, LEAST, top)
        if not len(chosen):
            break
        known, picked, hashed = _hashes(often), _hashes(chosen), _hashes(codes)
        marks[known], marks[picked] = 1, 2
        mark = marks.take(hashed, mode="clip")  # without looking for places beyond the end
        marks[known] = 0
        open_[places] = mark != 0
        near = np.flatnonzero(mark == 2)
        which = _places(codes.take(near), chosen, slots)
        if not (found := chosen[which] == codes.take(near)).all():
            near, which = near[found], which[found]
        at = places.take(near)
        fresh = np.append(True, at[1:] != at[:-1] + 1)
        if not fresh.all():  # in a run of one symbol every second pair counts
            runs = np.flatnonzero(fresh)
            even = (np.arange(len(at)) - np.repeat(runs, np.diff(np.append(runs, len(at))))) % 2 == 0
            at, which = at[even], which[even]
        stay = np.ones(len(symbols), bool)
        stay[at + 1] = False
        symbols[at] = top + which
        kept = np.flatnonzero(stay)
        symbols, open_ = symbols.take(kept, mode="clip"), open_.take(kept, mode="clip")
        at -= np.arange(len(at))
        open_[at] = True
        open_[at[at > 0] - 1] = True
        open_[-1] = False
        rules.append(np.stack([chosen >> kind(shift), chosen & kind((1 << shift) - 1)], 1).astype(np.uint32))
        top += len(chosen)
    return symbols, np.concatenate(rules), first


def expansion_lengths(rules: np.ndarray, first: int) -> np.ndarray:
    """How many ids each nonterminal stands for; a rule only names ids and earlier nonterminals."""
    out = np.ones(first + len(rules), np.uint64)
    latest = np.maximum.accumulate(rules.max(1)) if len(rules) else rules
    low = 0
    while low < len(rules):  # as many rules at once as name none of each other
        high = int(np.searchsorted(latest, first + low))
        out[first + low : first + high] = out[rules[low:high, 0]] + out[rules[low:high, 1]]
        low = high
    return out[first:]


def _all_lengths(lengths: np.ndarray, first: int) -> np.ndarray:
    """How many ids each symbol stands for: one for an id, and ``lengths`` for the nonterminals."""
    return np.concatenate((np.ones(first, np.int64), lengths.astype(np.int64)))


def expand(symbols: np.ndarray, rules: np.ndarray, first: int, lengths: np.ndarray | None = None) -> np.ndarray:
    """All ids that symbols stand for, one level of the grammar at a time; ``lengths`` are ``_all_lengths``."""
    lengths = _all_lengths(expansion_lengths(rules, first), first) if lengths is None else lengths
    lefts, rights = rules[:, 0], rules[:, 1]
    ends = np.cumsum(lengths[symbols])
    out = np.empty(int(ends[-1]) if len(ends) else 0, symbols.dtype)
    place = ends - lengths[symbols]
    while len(symbols):
        out[place] = symbols  # a nonterminal's place is written again below
        inner = np.flatnonzero(symbols >= first)
        at, rule = place[inner], symbols[inner] - first
        left, right = lefts[rule], rights[rule]
        symbols = np.concatenate((left, right))
        place = np.concatenate((at, at + lengths[left]))
    return out


def write_shard(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, start: int) -> bytes:
    """One shard: header, documents (id, whether there is one, length), rules, expansion lengths, places, symbols."""
    symbols, rules, first = compress(ids)
    lengths_of = expansion_lengths(rules, first)
    size = np.ones(len(symbols), np.uint64)
    inner = symbols >= first
    size[inner] = lengths_of[symbols[inner] - first]
    before = np.cumsum(size) - size
    width = 2 if first + len(rules) <= 1 << 16 else 4
    return b"".join((
        HEADER.pack(MAGIC, start, len(doc_ids), len(ids), len(symbols), len(rules), first, width),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array([d is not None for d in doc_ids], np.uint8).tobytes(),
        np.array(lengths, "<u8").tobytes(), rules.astype("<u4").tobytes(), lengths_of.astype("<u8").tobytes(),
        before[::STEP].astype("<u8").tobytes(), symbols.astype(f"<u{width}").tobytes(),
    ))


class Shard:
    """A shard in the bytes of a file, read in place."""

    def __init__(self, data: bytes, at: int = 0) -> None:
        magic, self.start, docs, self.n_ids, symbols, rules, self.first, width = HEADER.unpack_from(data, at)
        if magic != MAGIC:
            raise ValueError(f"no shard at byte {at}")
        at += HEADER.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        numbers, there = take("<i8", docs), take("u1", docs)
        self.doc_ids = [n if t else None for n, t in zip(numbers.tolist(), there.tolist())]
        self.ends = np.cumsum(take("<u8", docs)).astype(np.int64)
        self.rules = take("<u4", 2 * rules).reshape(-1, 2)
        self.lengths = _all_lengths(take("<u8", rules), self.first)
        self.before = take("<u8", -(-symbols // STEP))
        self.symbols = take(f"<u{width}", symbols)
        self.end = at

    def ids(self, start: int, n: int) -> np.ndarray:
        """``n`` ids from place ``start`` of the shard; symbols before and behind the stretch are not expanded."""
        if n <= 0:
            return np.zeros(0, np.uint32)
        if n == self.n_ids:
            parts = [self.symbols[k : k + STRETCH].astype(np.uint32) for k in range(0, len(self.symbols), STRETCH)]
            return np.concatenate([expand(p, self.rules, self.first, self.lengths) for p in parts])
        low = int(np.searchsorted(self.before, start, "right")) - 1
        high = int(np.searchsorted(self.before, start + n, "left"))
        symbols = self.symbols[low * STEP : high * STEP].astype(np.uint32)
        size = self.lengths[symbols]
        ends = int(self.before[low]) + np.cumsum(size)
        a, b = np.searchsorted(ends, start, "right"), np.searchsorted(ends, start + n, "left") + 1
        skip = start - int(ends[a] - size[a])
        return expand(symbols[a:b], self.rules, self.first, self.lengths)[skip : skip + n]

    def document(self, k: int) -> np.ndarray:
        start = int(self.ends[k - 1]) if k else 0
        return self.ids(start, int(self.ends[k]) - start)


def shards(data: bytes) -> Iterator[Shard]:
    """The shards of a file; each is followed by one line break."""
    at = 0
    while at < len(data):
        shard = Shard(data, at)
        yield shard
        at = shard.end + 1


def write_token_files(docs: DataFrame, tokenizer: str, ranks: str, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Writes the ids of (doc_id, text), ascending by doc_id, as files of shards; gives the files' (path, content).

    ``tokenizer`` and ``ranks`` are two files of one byte-level BPE vocabulary; a null text is empty, and every
    document ends with id 0. Rows are dealt by ranges of doc_id (nulls first), their text's print and their place in the
    input, so repeated ids spread over tasks too and keep together in the files. A document is never cut: a shard
    holds one at least, so a very long text makes a long shard. Only (doc_id, text) is read. No rows give one empty file.
    """
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("print"), F.monotonically_increasing_id().alias("place"))
    keys = ["doc_id", "print", "place"]
    ordered = source.repartitionByRange(tables.partitions(spark), *keys).sortWithinPartitions(*keys).select("doc_id", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder.get(tokenizer, ranks)
        end = array("I", [END_ID]).tobytes()
        names, lengths, parts = [], [], []
        start = held = 0

        def shard() -> pa.RecordBatch:
            content = write_shard(names, lengths, np.frombuffer(b"".join(parts), np.uint32), start)
            return pa.RecordBatch.from_arrays([pa.array([content], pa.binary())], names=["value"])

        for piece, texts in chunks(batches):
            for doc_id, text in zip(piece.column(0).to_pylist(), texts, strict=True):
                ids = encode(text or "") + end
                names.append(doc_id)
                lengths.append(len(ids) // 4)
                parts.append(ids)
                held += lengths[-1]
                if held >= shard_ids:
                    yield shard()
                    start += held
                    names, lengths, parts, held = [], [], [], 0
        if names:
            yield shard()

    folder = stored_folder(spark)
    # the cast and the writer leave the bytes as they are; a line break follows each shard
    raw = ordered.mapInArrow(work, "value binary").select(F.col("value").cast("string").alias("value"))
    raw.write.option("maxRecordsPerFile", FILE_SHARDS).text(folder)
    return spark.read.format("binaryFile").load(folder).select("path", "content")


def read_token_files(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, decoded from its shard alone.

    A file's name tells which part of the order it belongs to; what stands before that part is summed over
    one row a part, as many as the job that wrote the files had tasks.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                part = batch.column(0)[k].as_py()
                for shard in shards(batch.column(1)[k].as_py()):
                    starts = np.append(0, shard.ends[:-1])
                    ids = memoryview(shard.ids(0, shard.n_ids).astype("<u4").tobytes())  # all documents are wanted, so all symbols at once
                    crc = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(starts.tolist(), shard.ends.tolist())]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([part] * len(crc), pa.int64()), pa.array(shard.doc_ids, pa.int64()), pa.array(starts + shard.start),
                         pa.array(shard.ends - starts), pa.array(crc, pa.int64())], names=["part", "doc_id", "start", "n_tokens", "ids_crc32"])

    parts = files.select(F.regexp_extract("path", r"part-(\d+)", 1).cast("bigint").alias("part"), "content")
    rows = cut_lineage(parts.mapInArrow(work, "part bigint, doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"))
    sizes = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    joined = rows.join(tables.maybe_broadcast(base, 16), "part")
    return joined.select("doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")
