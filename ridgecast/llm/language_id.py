"""Language ID (7): interpolated Kneser-Ney character models, one per language, in sorted arrays of n-gram codes.

A model is fitted on a bounded sample of labelled rows; every document is scored on its whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridgecast.llm.text import chunks

#: Labelled documents per language that the models and their calibration see at most.
SAMPLE = 500
ORDER = 4
#: Calibration documents of a language may exceed the rejection limit in so many of 1000 cases.
REJECTED = 1
_LETTER = np.array([chr(c).isalpha() for c in range(0x10000)])
_U = np.uint64


def symbols(text: str) -> np.ndarray:
    """Lower-case letters as 16-bit symbols; each stretch of anything else is one blank (symbol 32)."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    low = points & 0xFFFF
    letter = _LETTER[low]
    for k in np.flatnonzero(points > 0xFFFF):
        letter[k] = chr(points[k]).isalpha()
    kept = letter | np.append(True, letter[:-1])
    return np.where(letter, low, 32)[kept].astype(np.uint64)


def grams(s: np.ndarray) -> np.ndarray:
    """The 4-gram that ends at each symbol, the last symbol lowest; blanks stand before the text."""
    padded = np.concatenate((np.full(ORDER - 1, 32, np.uint64), s))
    n = len(s)
    return padded[:n] << _U(48) | padded[1 : n + 1] << _U(32) | padded[2 : n + 2] << _U(16) | padded[3:]


class Table:
    """Values per code and language; codes that are absent give the default."""

    def __init__(self, parts: list[tuple[np.ndarray, np.ndarray]], default: float) -> None:
        self.codes = np.unique(np.concatenate([c for c, _ in parts]))
        self.values = np.full((len(self.codes) + 1, len(parts)), default, np.float64)
        for k, (codes, values) in enumerate(parts):
            self.values[np.searchsorted(self.codes, codes), k] = values

    def __getitem__(self, codes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        return self.values[np.where(self.codes[at] == codes, at, len(self.codes))]


def _smoothed(codes: np.ndarray, counts: np.ndarray) -> tuple[tuple, tuple]:
    """Discounted share of each n-gram in its history, and the weight each history leaves to the shorter one."""
    ones, twos = (counts == 1).sum(), (counts == 2).sum()
    discount = ones / (ones + 2 * twos) if ones else 0.5
    history, at = np.unique(codes >> _U(16), return_inverse=True)
    total, kinds = np.bincount(at, counts), np.bincount(at)
    return (codes, np.maximum(counts - discount, 0) / total[at]), (history, discount * kinds / total)


class Models:
    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> None:
        self.languages = sorted(counts)
        if not counts:
            return
        shares: list[list] = [[] for _ in range(ORDER)]
        weights: list[list] = [[] for _ in range(ORDER)]
        for name in self.languages:
            codes, seen = counts[name]
            for k in range(ORDER):
                share, weight = _smoothed(codes, seen.astype(float))
                shares[k].append(share)
                weights[k].append(weight)
                # a shorter n-gram counts the symbols it follows
                codes, seen = np.unique(codes & _U((1 << 16 * (ORDER - 1 - k)) - 1), return_counts=True)
        self.shares = [Table(s, 0.0) for s in shares]
        self.weights = [Table(w, 1.0) for w in weights]
        self.alphabet = len(self.shares[-1].codes) + 1
        self.scale, self.limits = 1.0, np.full(len(self.languages), np.inf)

    def log_shares(self, codes: np.ndarray) -> np.ndarray:
        p = np.full((len(codes), len(self.languages)), 1.0 / self.alphabet)
        for k in reversed(range(ORDER)):
            own = codes & _U((1 << 16 * (ORDER - k)) - 1)
            p = self.shares[k][own] + self.weights[k][own >> _U(16)] * p
        return np.log(p)

    def entropies(self, texts: list[str | None]) -> np.ndarray:
        """Cross-entropy per symbol of each text under each language; not a number without letters."""
        each = [symbols(t) if t else np.zeros(0, np.uint64) for t in texts]
        lettered = [bool((s != 32).any()) for s in each]
        out = np.full((len(texts), len(self.languages)), np.nan)
        used = [s for s, ok in zip(each, lettered) if ok]
        if used and self.languages:
            kinds, at = np.unique(np.concatenate([grams(s) for s in used]), return_inverse=True)
            logs = self.log_shares(kinds)
            sizes = np.array([len(s) for s in used])
            starts = np.cumsum(sizes) - sizes
            for k in range(len(self.languages)):
                out[lettered, k] = -np.add.reduceat(logs[at, k], starts) / sizes
        return out

    def calibrate(self, texts: list[str], names: list[str]) -> None:
        """Chooses the scale of the scores by likelihood, and per language the entropy beyond which a text is rejected."""
        e = self.entropies(texts)
        ok = ~np.isnan(e[:, 0]) & np.isin(names, self.languages)
        if not ok.any():
            return
        e, own = e[ok], np.searchsorted(self.languages, np.array(names)[ok])
        losses = {scale: -np.log(self._softmax(e, scale)[np.arange(len(e)), own] + 1e-12).mean() for scale in 2.0 ** np.arange(0, 7)}
        self.scale = min(losses, key=losses.get)
        for k in range(len(self.languages)):
            mine = e[own == k, k]
            if len(mine):
                self.limits[k] = np.quantile(mine, 1 - REJECTED / 1000) + 2 * mine.std() + 0.1

    @staticmethod
    def _softmax(e: np.ndarray, scale: float) -> np.ndarray:
        z = np.exp(-scale * (e - e.min(1, keepdims=True)))
        return z / z.sum(1, keepdims=True)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        e = self.entropies(texts)
        names, scores, taken = ["und"] * len(texts), [0.0] * len(texts), [False] * len(texts)
        rows = np.flatnonzero(~np.isnan(e[:, 0])) if len(self.languages) else []
        if len(rows):
            best = e[rows].argmin(1)
            share = self._softmax(e[rows], self.scale).max(1)
            for r, b, s in zip(rows.tolist(), best.tolist(), share.tolist(), strict=True):
                names[r], scores[r], taken[r] = self.languages[b], s, bool(e[r, b] <= self.limits[b])
        return names, scores, taken


def fold(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string")) % 5


def fitted(docs: DataFrame, sample: int = SAMPLE) -> Models:
    """Models from at most ``sample`` labelled documents per language of folds 1 to 4, chosen by the hash of their id.

    Fold 1 calibrates, folds 2 to 4 are counted in Spark.
    """
    labelled = docs.filter((fold() != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = labelled.groupBy("lang").count()
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    likely = labelled.join(F.broadcast(sizes), "lang").filter(drawn * F.col("count") <= F.lit(2.0 * sample * (1 << 30)))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(drawn, "doc_id"))
    chosen = likely.select("lang", "text", fold().alias("fold"), nth.alias("nth")).filter(F.col("nth") <= sample).drop("nth").persist()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, texts in chunks(batches):
            names = np.array(piece.column(0).to_pylist())
            for name in np.unique(names):
                codes, seen = np.unique(np.concatenate([grams(symbols(t)) for t, n in zip(texts, names) if n == name]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([str(name)] * len(codes)), pa.array(codes.astype(np.int64)), pa.array(seen)], names=["lang", "code", "n"])

    counted = chosen.filter("fold != 1").select("lang", "text").mapInArrow(count, "lang string, code bigint, n bigint")
    rows = counted.groupBy("lang", "code").agg(F.sum("n").alias("n")).toPandas()
    models = Models({name: (part["code"].to_numpy(np.int64).astype(np.uint64), part["n"].to_numpy()) for name, part in
                     rows.sort_values("code").groupby("lang")})
    check = chosen.filter("fold = 1").select("text", "lang").toPandas()
    if len(models.languages):
        models.calibrate(check["text"].tolist(), check["lang"].tolist())
    chosen.unpersist()
    return models


def identify(docs: DataFrame, models: Models) -> DataFrame:
    """(doc_id, lang_pred, score, accepted) for every row, from its text alone.

    The language of the lowest cross-entropy per symbol wins; ``score`` is its calibrated share and ``accepted``
    whether the entropy is as low as in calibration texts. Null texts and texts without a letter are ``und`` with
    score 0, as are all when nothing was learned. Rows are independent; one narrow pass.
    """
    sent = docs.sparkSession.sparkContext.broadcast(models)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, texts in chunks(batches, 1 << 19):
            names, scores, taken = sent.value.predict(texts)
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(taken, pa.bool_())],
                                             names=["doc_id", "lang_pred", "score", "accepted"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(work, "doc_id bigint, lang_pred string, score double, accepted boolean")
