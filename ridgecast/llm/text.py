"""Words, fingerprints and document chunks for tasks that work on Arrow batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that part words: white space, or everything but digits, a-z and non-ASCII bytes.
SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
NOT_WORD = np.array([b < 0x30 or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F for b in range(256)])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)

_draw = np.random.default_rng(20240229)
_BYTE = _draw.integers(1, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _draw.integers(1, 2**63, 64, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_U = np.uint64


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values (finaliser of the public SplitMix64 generator)."""
    h = h ^ (h >> _U(30))
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


@lru_cache(maxsize=4)
def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    size = 1 << max(16, int(n).bit_length())
    make = _powers if size <= 1 << 22 else _powers.__wrapped__
    return make(size, _BASE)[:n], make(size, pow(_BASE, -1, 2**64))[:n]


def joined(texts: list[str | None], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, each followed by a line break, and where each starts (one more at the end)."""
    raw = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
    bounds = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(r) + 1 for r in raw], out=bounds[1:])
    buf = np.frombuffer(b"\n".join(raw) + b"\n" if raw else b"", np.uint8)
    return (LOWER[buf] if lower else buf), bounds


def word_spans(buf: np.ndarray, parting: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word; the buffer ends with a parting byte."""
    inside = ~parting[buf]
    turns = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        turns = np.concatenate(([0], turns))
    return turns[0::2], turns[1::2]


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit fingerprint of each byte span; equal bytes give equal values wherever they stand."""
    up, down = powers(len(buf) + 1)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * up[: len(buf)], out=total[1:])
    h = (total[ends] - total[starts]) * down[starts]
    return mix(h + (ends - starts).astype(np.uint64) * _PLACE[63])


def run_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Fingerprints of all runs of k words, by their first word."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = words[:n] * _PLACE[0]
    for j in range(1, k):
        h += words[j : j + n] * _PLACE[j]
    return mix(h + _U(k * int(_PLACE[62]) % 2**64))


def shingle_sets(texts: list[str | None], k: int = 5, lower: bool = True) -> Iterator[np.ndarray]:
    """Per text its sorted distinct k-word shingles; fewer words form one shingle, none an empty set."""
    buf, bounds = joined(texts, lower)
    starts, ends = word_spans(buf, SPACE)
    words = span_hashes(buf, starts, ends)
    runs = run_hashes(words, k)
    first = np.searchsorted(starts, bounds)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= k:
            yield np.unique(runs[a : b - k + 1])
        else:
            yield run_hashes(words[a:b], b - a) if b > a else np.zeros(0, np.uint64)


def chunks(batches: Iterable[pa.RecordBatch], limit: int = 1 << 18, text: str = "text") -> Iterator[tuple[pa.RecordBatch, list]]:
    """Slices of the batches, with their texts, of about ``limit`` bytes of text each (one row at least)."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0)).astype(np.int64)
        total = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            base = total[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(total, base + limit, "right")))
            piece = batch.slice(at, end - at)
            yield piece, piece.column(piece.schema.get_field_index(text)).to_pylist()
            at = end


def with_columns(batch: pa.RecordBatch, values: dict[str, object], schema: pa.Schema) -> pa.RecordBatch:
    """The batch with columns put in (or replaced), in the order and types of ``schema``."""
    columns = [
        pa.array(values[f.name], f.type) if f.name in values else batch.column(batch.schema.get_field_index(f.name)).cast(f.type)
        for f in schema
    ]
    return pa.RecordBatch.from_arrays(columns, schema=schema)
