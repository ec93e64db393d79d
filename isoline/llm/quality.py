"""Quality classifier: a generalised additive model with pairwise interactions.

Features of a text are binned; cyclic boosting visits the features in turn and fits a shallow tree (at most four leaves) to the current residuals of
each, which adds to that feature's lookup table. The pairs of features with the largest remaining gain then get two-dimensional tables by the same
boosting with one cut on either axis. A score is the logistic of an intercept plus one table entry for each feature and pair.
"""

from __future__ import annotations

from collections import Counter
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isoline.llm.common import crc_remainder, rows_of, text_or_empty, written

FEATURES = ("log_bytes", "log_words", "word_bytes", "long_word", "upper", "digit", "space", "line_end", "high_bytes", "stop_marks", "exclamation", "bar", "symbols", "byte_entropy", "distinct_words", "top_word", "word_pairs_again", "lines_again", "line_words", "short_words", "upper_words", "marked_words", "longest_run")
#: Rows with labels that the model is fitted on at most.
TRAIN_ROWS = 20_000
THRESHOLD, HELD_OUT_MODULUS, HELD_OUT = 0.7, 4, 2
_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_DIGITS = np.zeros(256, bool)
_DIGITS[48:58] = True
_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".,;:?'\"()-"]] = True
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_OTHER = ~(_LETTERS | _DIGITS | _ENDS | _SPACE)


def features(text: str) -> list[float]:
    """The FEATURES of a whole text; an empty text has zeros."""
    raw = text.encode("utf-8", "surrogatepass")
    if not raw:
        return [0.0] * len(FEATURES)
    counts, n = np.bincount(np.frombuffer(raw, np.uint8), minlength=256), len(raw)
    words, lines = raw.split(), raw.split(b"\n")
    m = max(1, len(words))
    often, p = Counter(words), counts[counts > 0] / n
    pairs = len(set(zip(words, words[1:]))) if len(words) > 1 else 1
    lengths = list(map(len, words)) or [0]
    filled = [x for x in lines if x.strip()] or [b""]
    ends = sum(1 for w in words if _OTHER[w[-1]])
    return [
        np.log1p(n), np.log1p(len(words)), sum(lengths) / m, float(np.log1p(max(lengths))), counts[65:91].sum() / n, counts[_DIGITS].sum() / n, counts[_SPACE].sum() / n, counts[10] / n,
        counts[128:].sum() / n, counts[_ENDS].sum() / n, counts[33] / n, counts[124] / n, counts[_OTHER].sum() / n, float(-(p * np.log2(p)).sum()), len(often) / m,
        max(often.values(), default=0) / m, 1 - pairs / max(1, len(words) - 1), 1 - len(set(filled)) / len(filled), float(np.log1p(m / len(filled))), sum(1 for x in lengths if x <= 3) / m,
        sum(1 for w in words if len(w) > 1 and w.isupper()) / m, ends / m, float(np.log1p(counts.max() / n)),
    ]


class PairwiseGam:
    """fit(x, y) with y in {0, 1}; score(x) in 0 .. 1. Without rows of both classes the score is the (smoothed) share of ones."""

    def __init__(self, bins: int = 32, rounds: int = 150, pair_rounds: int = 60, pairs: int = 8, rate: float = 0.15, ridge: float = 2.0):
        self.bins, self.rounds, self.pair_rounds, self.n_pairs, self.rate, self.ridge = bins, rounds, pair_rounds, pairs, rate, ridge
        self.edges: list[np.ndarray] = []
        self.tables: list[np.ndarray] = []
        self.pairs: list[tuple[int, int, np.ndarray]] = []
        self.intercept = 0.0

    def _binned(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(self.edges)]

    def _gain(self, g, h):
        return g * g / (h + self.ridge)

    def _cut(self, g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
        """Best single cut of a row of bins: (gain, first bin on the right)."""
        gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        if not len(gl):
            return 0.0, 0
        gain = self._gain(gl, hl) + self._gain(g.sum() - gl, h.sum() - hl) - self._gain(g.sum(), h.sum())
        k = int(np.argmax(gain))
        return float(gain[k]), k + 1

    def _tree(self, g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
        gain, k = self._cut(g, h) if depth else (0.0, 0)
        if gain <= 1e-9:
            return np.full(len(g), g.sum() / (h.sum() + self.ridge))
        return np.concatenate([self._tree(g[:k], h[:k], depth - 1), self._tree(g[k:], h[k:], depth - 1)])

    def _quarters(self, g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
        """Best pair of cuts, one on either axis: (gain, table of four constants)."""
        gc, hc = (np.cumsum(np.cumsum(np.pad(t, ((1, 0), (1, 0))), 0), 1) for t in (g, h))
        a, b = g.shape
        best = (0.0, np.zeros_like(g))
        for i in range(1, a):
            j = np.arange(1, b)
            parts = [(gc[i, j], hc[i, j]), (gc[i, b] - gc[i, j], hc[i, b] - hc[i, j]), (gc[a, j] - gc[i, j], hc[a, j] - hc[i, j]), (gc[a, b] - gc[i, b] - gc[a, j] + gc[i, j], hc[a, b] - hc[i, b] - hc[a, j] + hc[i, j])]
            gain = sum(self._gain(*q) for q in parts)
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                v = [q[0][k] / (q[1][k] + self.ridge) for q in parts]
                t = np.empty_like(g)
                t[:i, : k + 1], t[:i, k + 1 :], t[i:, : k + 1], t[i:, k + 1 :] = v
                best = (float(gain[k]), t)
        return best

    def fit(self, x: np.ndarray, y: np.ndarray) -> PairwiseGam:
        ones = float(y.sum())
        share = (ones + 1) / (len(y) + 2)
        self.intercept = float(np.log(share / (1 - share)))
        n = x.shape[1]
        self.edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, self.bins + 1)[1:-1])) if len(x) else np.empty(0) for k in range(n)]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        if not 0 < ones < len(y):
            return self
        cells, f = self._binned(x), np.full(len(y), self.intercept)

        def residuals():
            p = 1 / (1 + np.exp(-f))
            return y - p, p * (1 - p)

        for _ in range(self.rounds):
            for k, t in enumerate(self.tables):
                g, h = residuals()
                step = self.rate * self._tree(np.bincount(cells[k], g, len(t)), np.bincount(cells[k], h, len(t)))
                t += step
                f += step[cells[k]]
        coarse = [c * 8 // max(8, len(t)) for c, t in zip(cells, self.tables, strict=True)]
        g, h = residuals()
        ranked = sorted(((self._quarters(*(np.bincount(coarse[i] * 8 + coarse[j], v, 64).reshape(8, 8) for v in (g, h)))[0], i, j) for i, j in combinations(range(n), 2)), reverse=True)
        self.pairs = [(i, j, np.zeros((8, 8))) for _, i, j in ranked[: self.n_pairs]]
        for _ in range(self.pair_rounds):
            for i, j, t in self.pairs:
                g, h = residuals()
                cell = coarse[i] * 8 + coarse[j]
                step = self.rate * self._quarters(np.bincount(cell, g, 64).reshape(8, 8), np.bincount(cell, h, 64).reshape(8, 8))[1]
                t += step
                f += step.ravel()[cell]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        cells, f = self._binned(x), np.full(len(x), self.intercept)
        for c, t in zip(cells, self.tables, strict=True):
            f += t[c]
        for i, j, t in self.pairs:
            f += t[cells[i] * 8 // max(8, len(self.tables[i])), cells[j] * 8 // max(8, len(self.tables[j]))]
        return 1 / (1 + np.exp(-f))


def _matrix(texts: list[str]) -> np.ndarray:
    return np.array([features(t) for t in texts], dtype=np.float64).reshape(len(texts), len(FEATURES))


def _featurise(batches):
    for b in rows_of(batches, 1000):
        x = _matrix(b.column(1).to_pylist())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))], names=["doc_id", "x"])


def feature_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return written(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(_featurise, "doc_id bigint, x array<double>"), "quality-features")


def _chosen(labels: DataFrame, train_rows: int) -> DataFrame:
    """(doc_id, y) of at most train_rows usable labels by the hash of their doc_id; a share of them by hash is taken where they lie, so the sort is of little more than that."""
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (crc_remainder("doc_id", HELD_OUT_MODULUS) != HELD_OUT)).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("y"))
    share = min(1.0, 1.2 * (train_rows + 100) / max(1, usable.count()))
    some = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < int(share * (1 << 40)))
    return some.orderBy(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)), "doc_id", "y").limit(train_rows)


def fit_quality(table: DataFrame, labels: DataFrame, *, train_rows: int = TRAIN_ROWS) -> PairwiseGam:
    """A model fitted on at most train_rows labelled rows outside the held-out part, chosen by the hash of their doc_id. Labels other than 0 and 1, and null ids, are not used."""
    rows = table.join(F.broadcast(_chosen(labels, train_rows)), "doc_id")  # train_rows ids at most
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "y", "x").limit(train_rows).toPandas()  # more only where documents repeat an id
    x = np.array(rows["x"].tolist(), dtype=np.float64).reshape(len(rows), len(FEATURES))
    return PairwiseGam().fit(x, rows["y"].to_numpy(dtype=np.float64))


def fit_labelled(docs: DataFrame, labels: DataFrame, *, train_rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text") -> PairwiseGam:
    """fit_quality with the features of labelled documents only."""
    some = F.broadcast(_chosen(labels, train_rows).select(F.col("doc_id").alias("__labelled")))
    return fit_quality(feature_table(docs.join(some, F.col(id_col) == F.col("__labelled"), "left_semi"), id_col, text_col), labels, train_rows=train_rows)


def _score(model: PairwiseGam):
    def run(batches):
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(x))], names=["doc_id", "score"])

    return run


def classify(docs: DataFrame, labels: DataFrame, *, train_rows: int = TRAIN_ROWS, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, held_out, score (higher: label 1 likelier), predicted (1 if score >= threshold).

    Only the text decides a score. Null texts score as empty ones; null ids are never held out and never trained on; repeated rows score alike; without
    labels every score is 0.5; an empty table gives no rows; other columns are not read.
    """
    table = feature_table(docs, id_col, text_col)
    model = fit_quality(table, labels, train_rows=train_rows)
    scored = table.mapInArrow(_score(model), "doc_id bigint, score double")
    return scored.select("doc_id", (crc_remainder("doc_id", HELD_OUT_MODULUS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def score_column(model: PairwiseGam, text: Column) -> Column:
    """The score of a text column, for filters that keep a table's own columns."""

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(_matrix(list(texts))))

    return F.pandas_udf(run, "double")(F.coalesce(text, F.lit("")))
