"""Quality rules (9): lines are cleaned first, then documents that lost too much are rejected."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgecast.llm import tables
from ridgecast.llm.text import SPACE, chunks, joined, run_hashes, span_hashes, with_columns, word_spans

#: Phrases of page furniture, and signs that part the entries of a navigation bar.
BOILERPLATE = (
    "accept cookies", "all rights reserved", "back to top", "click here", "cookie policy", "enable javascript", "privacy policy",
    "read more", "share this", "sign in", "sign up", "skip to content", "subscribe to our newsletter", "terms of service", "terms of use",
)
#: Words of page furniture that say nothing on their own; they count neither for nor against a phrase.
FILLER = frozenset("a an and by c continue copyright for go of on or our please the this to us we you your".split())
NAVIGATION = "|»›>·•"
BLANK = " \t\n\x0b\x0c\r"
MADE = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, "
    "n_lines_removed bigint, chars_kept bigint, kept boolean"
)

_phrases = re.compile(r"\b(?:" + "|".join(r"\s+".join(map(re.escape, x.split())) for x in BOILERPLATE) + r")\b", re.IGNORECASE)
_bars = re.compile(rf"[{re.escape(NAVIGATION)}]")
_plain = re.compile(r"[^\W_]+")
#: Vowel signs and other combining marks, and the joiners, belong to the letter before them.
_marks = "".join(chr(c) for r in (range(0x300, 0x20000), range(0xE0100, 0xE01F0)) for c in r if unicodedata.category(chr(c))[0] == "M")
_marked = re.compile(rf"[^\W_]+[{_marks}\u200c\u200d]*")


def line_fails(line: str, min_plain: float = 0.5, max_phrase: int = 12, min_bars: int = 3) -> bool:
    """Whether a line with a word is page furniture.

    Punctuation: less than ``min_plain`` of its non-blank characters are letters, marks of letters or digits.
    Navigation: ``min_bars`` or more bars, with at most three words to a bar on average.
    Boilerplate: a line of at most ``max_phrase`` words in which stock phrases, as whole words, have more words than
    all that is neither a phrase, nor a filler, nor a number.
    """
    words = line.split()
    solid = sum(map(len, words))
    if sum(map(len, (_plain if line.isascii() else _marked).findall(line))) < min_plain * solid:
        return True
    bars = len(_bars.findall(line))
    if bars >= min_bars and len(words) <= 4 * (bars + 1):
        return True
    if len(words) > max_phrase or not (found := _phrases.findall(line)):
        return False
    rest = _plain.findall(_phrases.sub(" ", line).lower())
    return sum(len(x.split()) for x in found) > sum(not w.isdecimal() and w not in FILLER for w in rest)


def clean_lines(text: str) -> tuple[str, int, int, int]:
    """Text without failing lines; lines removed; non-blank characters before and after."""
    before = after = removed = 0
    kept = []
    for line in text.split("\n"):
        solid = len(line) - sum(map(line.count, BLANK))
        before += solid
        if solid and line_fails(line):
            removed += 1
        else:
            after += solid
            kept.append(line)
    return ("\n".join(kept) if removed else text), removed, before, after


def base_counts(texts: list[str | None]) -> dict[str, list]:
    buf, bounds = joined(texts)
    starts, ends = word_spans(buf, SPACE)
    first = np.searchsorted(starts, bounds)
    runs = run_hashes(span_hashes(buf, starts, ends), 5)

    def per_text(flags: np.ndarray) -> list[int]:
        total = np.zeros(len(buf) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return (total[bounds[1:]] - total[bounds[:-1]]).tolist()

    repeated = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        n = 0
        if b - a > 5:
            order = np.argsort(runs[a : b - 4], kind="stable")
            sorted_runs = runs[a : b - 4][order]
            same = sorted_runs[1:] == sorted_runs[:-1]
            if same.any():
                twice = order[np.append(same, False) | np.append(False, same)]
                turn = np.zeros(b - a + 1, np.int64)
                np.add.at(turn, twice, 1)
                np.add.at(turn, twice + 5, -1)
                n = int((np.cumsum(turn) > 0).sum())
        repeated.append(n)
    dup = []
    for t in texts:
        lines = [x for x in (t or "").split("\n") if x.strip(BLANK)]
        dup.append(len(lines) - len(set(lines)))
    return {
        "n_words": np.diff(first).tolist(),
        "word_chars": per_text(~SPACE[buf] & ((buf & 0xC0) != 0x80)),
        "n_symbols": per_text(np.isin(buf, np.frombuffer(b"#*$%&|<>", np.uint8))),
        "n_dup_lines": dup,
        "n_repeat_words": repeated,
    }


def quality_rules(docs: DataFrame, min_words: int = 10, max_repeat_percent: int = 20, min_kept: float = 0.5) -> DataFrame:
    """Every document with its cleaned text, base counts and verdict ``kept``.

    One narrow pass, nothing is shuffled. A null text stays null, has no words and fails the
    base rules, as an empty one does. Repeated rows are judged each on their own. Input columns
    that are named as a made column are replaced; all others pass through unchanged.
    """
    source, schema = tables.appended(docs, MADE)
    out_schema = tables.arrow(schema)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, texts in chunks(batches):
            made = base_counts(texts)
            failed = [n < min_words or 100 * r > max_repeat_percent * n for n, r in zip(made["n_words"], made["n_repeat_words"], strict=True)]
            cleaned = [clean_lines(t or "") for t in texts]
            yield with_columns(piece, made | {
                "text": [None if t is None else c[0] for t, c in zip(texts, cleaned, strict=True)],
                "base_failed": failed,
                "n_lines_removed": [c[1] for c in cleaned],
                "chars_kept": [c[3] for c in cleaned],
                "kept": [not f and c[3] >= min_kept * c[2] for f, c in zip(failed, cleaned, strict=True)],
            }, out_schema)

    return source.mapInArrow(judge, schema)


def stage(docs: DataFrame) -> DataFrame:
    """Documents that are kept, with their cleaned text, in the columns of the input."""
    return quality_rules(docs).filter("kept").select(*[F.col(c) for c in docs.columns])
