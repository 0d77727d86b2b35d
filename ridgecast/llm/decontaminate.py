"""Benchmark decontamination (4): a generalised suffix automaton of test items reads the documents' words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgecast.llm import tables
from ridgecast.llm.text import NOT_WORD, chunks, joined, run_hashes, span_hashes, with_columns, word_spans

WINDOW = 10
#: Test items are read in groups of about so many bytes; each group gets its own pass.
GROUP_BYTES = 16 * 1024 * 1024


class Automaton:
    """Suffix automaton of several word sequences; a state's strings end at the same places."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]

    def _state(self, length: int, link: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _divide(self, p: int, w: int, length: int) -> int:
        """The state for the strings of at most ``length`` words behind p by w, divided off if needed."""
        q = self.next[p][w]
        if self.length[q] == length:
            return q
        twin = self._state(length, self.link[q], dict(self.next[q]))
        self.link[q] = twin
        while p != -1 and self.next[p].get(w) == q:
            self.next[p][w] = twin
            p = self.link[p]
        return twin

    def add(self, words: list[int]) -> None:
        last = 0
        for w in words:
            p = last
            if w in self.next[p]:
                last = self._divide(p, w, self.length[p] + 1)
                continue
            last = self._state(self.length[p] + 1, 0, {})
            while p != -1 and w not in self.next[p]:
                self.next[p][w] = last
                p = self.link[p]
            if p != -1:
                self.link[last] = self._divide(p, w, self.length[p] + 1)

    def read(self, words: list[int]) -> Iterator[tuple[int, int]]:
        """After each word: the state and length of the longest match that ends there."""
        v = length = 0
        for w in words:
            while v and w not in self.next[v]:
                v = self.link[v]
                length = self.length[v]
            if w in self.next[v]:
                v = self.next[v][w]
                length += 1
            yield v, length


class Items:
    """Finds windows of test items, and whole items shorter than a window, in word sequences."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW) -> None:
        self.window = window
        ids, texts = [i for i, _ in items], [t for _, t in items]
        buf, bounds = joined(texts, lower=True)
        starts, ends = word_spans(buf, NOT_WORD)
        hashes = span_hashes(buf, starts, ends)
        self.vocabulary, numbers = np.unique(hashes, return_inverse=True)
        first = np.searchsorted(starts, bounds).tolist()
        sequences = [numbers[a:b].tolist() for a, b in zip(first, first[1:])]
        pairs = [run_hashes(hashes[a:b], 2) for a, b in zip(first, first[1:])]
        self.pairs = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.uint64)
        lengths = [min(window, len(s)) for s in sequences if s]
        self.shortest = min(lengths, default=window)
        self.automaton = a = Automaton()
        for s in sequences:
            a.add(s)
        self.inside: dict[int, set[str]] = {}  # state of a window -> items
        self.whole: dict[int, list[tuple[int, str]]] = {}  # state of a short item -> its length and name
        for name, s in zip(ids, sequences, strict=True):
            if 0 < len(s) < window:
                v = 0
                for w in s:
                    v = a.next[v][w]
                self.whole.setdefault(v, []).append((len(s), name))
            for v, length in a.read(s):
                if length >= window:
                    self.inside.setdefault(self._window_state(v), set()).add(name)
        self.above = [False] * len(a.link)
        for v in sorted(range(1, len(a.link)), key=a.length.__getitem__):
            self.above[v] = v in self.whole or self.above[a.link[v]]

    def _window_state(self, v: int) -> int:
        a = self.automaton
        while a.length[a.link[v]] >= self.window:
            v = a.link[v]
        return v

    def find(self, words: list[int]) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit runs [from, to) of words, in order of their end, and the items found."""
        runs: list[tuple[int, int]] = []
        found: set[str] = set()
        a, window = self.automaton, self.window
        for i, (v, length) in enumerate(a.read(words), 1):
            hit = 0
            if length >= window:
                hit = window
                found |= self.inside.get(self._window_state(v), set())
            if self.above[v]:
                u = v
                while u > 0:
                    for m, name in self.whole.get(u, ()):
                        if m <= length:
                            hit = max(hit, m)
                            found.add(name)
                    u = a.link[u]
            if hit:
                begin = i - hit
                while runs and runs[-1][1] >= begin:
                    begin = min(begin, runs.pop()[0])
                runs.append((begin, i))
        return runs, found

    def scan(self, texts: list[str | None]) -> Iterator[tuple[int, list[tuple[int, int, int, int]], set[str]]]:
        """Per text: words, hit runs as (first word, last word + 1, first byte, last byte + 1), items.

        Only stretches whose neighbouring words stand next to each other in some item reach the automaton.
        """
        buf, bounds = joined(texts, lower=True)
        starts, ends = word_spans(buf, NOT_WORD)
        hashes = span_hashes(buf, starts, ends)
        first = np.searchsorted(starts, bounds)
        stretches: list[tuple[int, int]] = []
        if len(hashes) and len(self.vocabulary):
            place = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
            known = self.vocabulary[place] == hashes
            opens = np.zeros(len(hashes) + 1, bool)  # a stretch can't go on from the word before
            opens[first] = True
            pair = run_hashes(hashes, 2)
            if len(self.pairs) and len(pair):
                at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
                opens[1:-1] |= self.pairs[at] != pair
            elif len(pair):
                opens[1:-1] = True
            opens[:-1] |= ~known
            opens[1:] |= ~known
            cuts = np.flatnonzero(opens)
            if not opens[0]:
                cuts = np.append(0, cuts)
            long = np.flatnonzero(np.diff(cuts) >= self.shortest)
            stretches = [(int(cuts[k]), int(cuts[k + 1])) for k in long if known[cuts[k]]]
        k = 0
        for row, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
            runs: list[tuple[int, int, int, int]] = []
            items: set[str] = set()
            while k < len(stretches) and stretches[k][0] < b:
                lo, hi = stretches[k]
                found_runs, found = self.find(place[lo:hi].tolist())
                items |= found
                base = bounds[row]
                runs += [(lo + x - a, lo + y - a, int(starts[lo + x] - base), int(ends[lo + y - 1] - base)) for x, y in found_runs]
                k += 1
            yield b - a, runs, items


MADE = "n_words bigint, hit_words array<bigint>, hit_bytes array<bigint>, hit_items array<string>"


def find_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Documents with ``n_words``, hit runs (flat lists of start and end, in words and in bytes) and items found.

    Words are runs of digits, letters a-z (A-Z lower-cased) and non-ASCII bytes. A word inside any
    occurrence of ``window`` consecutive words of an item, or of a whole shorter item, is hit. Items
    travel to the tasks in groups of ``group_bytes``, one narrow pass for each; documents are never
    shuffled. Null or empty texts have no words, items without words match nothing, an item id of
    null hits but is not named, and no items at all hit nothing.
    """
    source, schema = tables.appended(docs, MADE)
    out_schema = tables.arrow(schema)
    total = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_groups = tables.groups_for(total, group_bytes)
    name = F.col("item_id").cast("string")
    result = source.select("*", F.lit(0).cast("bigint").alias("n_words"), *[F.array().cast(t).alias(c) for c, t in
                           (("hit_words", "array<bigint>"), ("hit_bytes", "array<bigint>"), ("hit_items", "array<string>"))])
    for g in range(n_groups):
        rows = benchmark.filter(F.pmod(F.xxhash64("text"), F.lit(n_groups)) == g).select(name.alias("i"), "text").collect()
        items = [(r.i, r.text) for r in rows]

        def scan(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            finder = Items(items, window)
            for piece, texts in chunks(batches):
                old = [piece.column(piece.schema.get_field_index(c)).to_pylist() for c in ("hit_words", "hit_bytes", "hit_items")]
                made = {"n_words": [], "hit_words": [], "hit_bytes": [], "hit_items": []}
                for (n, runs, found), w, b, i in zip(finder.scan(texts), *old, strict=True):
                    made["n_words"].append(n)
                    made["hit_words"].append(merged(w, [r[:2] for r in runs]))
                    made["hit_bytes"].append(merged(b, [r[2:] for r in runs]))
                    made["hit_items"].append(sorted({*i, *(f for f in found if f is not None)}))
                yield with_columns(piece, made, out_schema)

        result = result.mapInArrow(scan, schema)
    return result


def merged(flat: list[int], runs: list[tuple[int, int]]) -> list[int]:
    """Union of half-open runs, as a flat list; runs that touch are joined."""
    out: list[int] = []
    for a, b in sorted([*zip(flat[::2], flat[1::2]), *runs]):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_coverage: float = 0.5) -> DataFrame:
    """``find_hits`` with ``n_hit``, ``contaminated``, ``dropped`` (over ``max_coverage`` of the words hit) and a cleaned text.

    From other contaminated documents the hit spans are cut, from the first to the last byte of each run.
    """
    hits = find_hits(docs, benchmark, window)
    source, schema = tables.appended(hits, "n_hit bigint, contaminated boolean, dropped boolean")
    out_schema = tables.arrow(schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, texts in chunks(batches):
            words, spans, n_words = (piece.column(piece.schema.get_field_index(c)).to_pylist() for c in ("hit_words", "hit_bytes", "n_words"))
            n_hit = [sum(w[1::2]) - sum(w[::2]) for w in words]
            cleaned = [t if not s else without(t, s) for t, s in zip(texts, spans, strict=True)]
            yield with_columns(piece, {
                "text": cleaned, "n_hit": n_hit, "contaminated": [n > 0 for n in n_hit],
                "dropped": [h > max_coverage * n for h, n in zip(n_hit, n_words, strict=True)],
            }, out_schema)

    return source.mapInArrow(cut, schema)


def without(text: str, spans: list[int]) -> str:
    raw = text.encode("utf-8", "surrogatepass")
    edges = [0, *spans, len(raw)]
    return b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2])).decode("utf-8", "surrogatepass")


def stage(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents that are not dropped, with hit spans cut, in the columns of the input."""
    return decontaminate(docs, benchmark).filter("not dropped").select(*[F.col(c) for c in docs.columns])
