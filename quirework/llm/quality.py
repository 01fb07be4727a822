"""Quality classifier: a generalised additive model with pairwise interactions.

Every text becomes a short vector of surface features. Cyclic boosting visits the features one after another and adds
a shrunken, shallow tree over that feature's bins to its lookup table; then it does the same over the strongest pairs
of features. A score is the sigmoid of a sum of table entries, so scoring a batch is a few vectorised look-ups.

Defined results: a null text counts as empty; an empty text has the features of no words and gets a score; repeated rows
get equal scores; an empty table gives no rows; without usable labels every score is 0.5; very long texts are worked through whole, in batches of
bounded size; of features and cuts with equal gains the first is taken. Only the id and the text of documents are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, id_crc, mix64, small_batches, text_bytes, word_hashes, word_spans

FEATURES = (
    "log_words", "word_length", "upper_share", "digit_share", "symbol_share", "stop_share", "wide_share", "distinct_words",
    "repeated_next", "top_word", "distinct_triples", "repeated_lines", "line_words", "capital_starts", "symbol_words",
)
BINS = 32

_KIND = np.zeros(256, np.uint8)  # 0 blank or control, 1 lower, 2 upper, 3 digit, 4 stops, 5 symbols, 6 beyond ASCII
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 1, 2, 3, 6
_KIND[33:127][_KIND[33:127] == 0] = 5
_KIND[[ord(c) for c in ".,;:'\"-?()"]] = 4


def features(texts: pa.Array) -> np.ndarray:
    """One row of FEATURES for each text."""
    raw, offsets = text_bytes(texts)
    n = len(offsets) - 1
    out = np.zeros((n, len(FEATURES)))
    if not len(raw):
        return out
    kind = _KIND[raw]
    counts = np.array([sum((np.bincount(kind[low : min(low + (1 << 20), b)], minlength=7)[1:] for low in range(a, b, 1 << 20)), np.zeros(6)) for a, b in zip(offsets[:-1], offsets[1:], strict=True)])
    s, e, at = word_spans(raw, offsets)
    h = word_hashes(LOWER[raw], s, e)
    last = kind[e - 1] if len(e) else kind[:0]
    starts = kind[s] == 2 if len(s) else np.zeros(0, bool)
    odd = (last == 5) | (kind[s] == 5) if len(s) else starts
    line = np.searchsorted(np.flatnonzero(raw == 10), s)
    with np.errstate(over="ignore"):
        triple = mix64(h[2:] + h[1:-1] * np.uint64(3) + h[:-2] * np.uint64(5)) if len(h) > 2 else h[:0]
    visible = np.maximum(counts.sum(1), 1)
    letters = np.maximum(counts[:, 0] + counts[:, 1], 1)
    for i in range(n):
        a, b = at[i], at[i + 1]
        words = b - a
        if not words:
            continue
        own = h[a:b]
        kinds, times = np.unique(own, return_counts=True)
        first = np.flatnonzero(np.diff(line[a:b], prepend=-1))
        with np.errstate(over="ignore"):
            lines = np.add.reduceat(mix64(own + np.arange(words, dtype=np.uint64) - np.repeat(first, np.diff(np.append(first, words))).astype(np.uint64)), first)
        _, which, copies = np.unique(lines, return_inverse=True, return_counts=True)
        long = np.diff(np.append(first, words))
        out[i] = (
            np.log1p(words), (e[a:b] - s[a:b]).mean(), counts[i, 1] / letters[i], counts[i, 2] / visible[i], counts[i, 4] / visible[i],
            counts[i, 3] / words, counts[i, 5] / visible[i], len(kinds) / words, (own[1:] == own[:-1]).sum() / words, times.max() / words,
            len(np.unique(triple[a : b - 2])) / max(words - 2, 1) if words > 2 else 1.0, long[copies[which] > 1].sum() / words,
            np.log1p(words / len(first)), starts[a:b].sum() / words, odd[a:b].sum() / words,
        )
    return out


@dataclass
class AdditiveModel:
    """Lookup tables: `edges` of the bins of each feature, a row of `main` each, and a square table for each pair."""

    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    main: np.ndarray = field(default_factory=lambda: np.zeros((0, BINS)))
    pairs: list[tuple[int, int]] = field(default_factory=list)
    joint: np.ndarray = field(default_factory=lambda: np.zeros((0, BINS, BINS)))

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(edge, x[:, j], "right") for j, edge in enumerate(self.edges)], 1) if self.edges else np.zeros((len(x), 0), int)

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        total = np.full(len(x), self.base)
        for j in range(b.shape[1]):
            total += self.main[j, b[:, j]]
        for k, (i, j) in enumerate(self.pairs):
            total += self.joint[k, b[:, i], b[:, j]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _best_split(g: np.ndarray, h: np.ndarray, penalty: float) -> tuple[float, int]:
    """Gain and place of the best cut of a histogram of gradients and curvatures (cut k: bins below k go left)."""
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    right_g, right_h = g.sum() - left_g, h.sum() - left_h
    gain = np.where((left_h > 1e-9) & (right_h > 1e-9), left_g**2 / (left_h + penalty) + right_g**2 / (right_h + penalty) - g.sum() ** 2 / (h.sum() + penalty), 0)
    k = int(np.argmax(gain)) if len(gain) else 0
    return (float(gain[k]), k + 1) if len(gain) else (0.0, 0)


def _line_tree(g: np.ndarray, h: np.ndarray, depth: int, penalty: float) -> np.ndarray:
    """Leaf values, by bin, of a shallow tree over one feature."""
    gain, k = _best_split(g, h, penalty) if depth else (0.0, 0)
    if gain <= 1e-12:
        return np.full(len(g), g.sum() / (h.sum() + penalty))
    return np.concatenate([_line_tree(g[:k], h[:k], depth - 1, penalty), _line_tree(g[k:], h[k:], depth - 1, penalty)])


def _cross_tree(g: np.ndarray, h: np.ndarray, penalty: float) -> tuple[float, np.ndarray]:
    """Gain and cell values of a tree that cuts one feature, then the other on either side."""
    best, value = 0.0, np.zeros_like(g)
    for turn in (False, True):
        gg, hh = (g.T, h.T) if turn else (g, h)
        gain, k = _best_split(gg.sum(1), hh.sum(1), penalty)
        if not k:
            continue
        cells = np.empty_like(gg)
        for part in (slice(0, k), slice(k, None)):
            pg, ph = gg[part].sum(0), hh[part].sum(0)
            more, cut = _best_split(pg, ph, penalty)
            gain += more
            for side in (slice(0, cut), slice(cut, None)):
                cells[part, side] = pg[side].sum() / (ph[side].sum() + penalty)
        if gain > best:
            best, value = gain, cells.T if turn else cells
    return best, value


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 120, pair_rounds: int = 40, n_pairs: int = 6, rate: float = 0.15, penalty: float = 2.0) -> AdditiveModel:
    """Cyclic boosting on a bounded sample."""
    if not len(y):
        return AdditiveModel()
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    quantiles = np.linspace(0, 1, BINS + 1)[1:-1]
    model = AdditiveModel(float(np.log(share / (1 - share))), [np.unique(np.quantile(column, quantiles)) for column in x.T], np.zeros((x.shape[1], BINS)))
    b = model.bins(x)
    total = np.full(len(y), model.base)

    def pull() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(rounds):
        for j in range(x.shape[1]):
            g, h = pull()
            step = rate * _line_tree(np.bincount(b[:, j], g, BINS), np.bincount(b[:, j], h, BINS), 2, penalty)
            model.main[j] += step
            total += step[b[:, j]]
    cells = {(i, j): b[:, i] * BINS + b[:, j] for i in range(x.shape[1]) for j in range(i)}
    square = lambda v, cell: np.bincount(cell, v, BINS * BINS).reshape(BINS, BINS)
    g, h = pull()
    gains = {pair: _cross_tree(square(g, cell), square(h, cell), penalty)[0] for pair, cell in cells.items()}
    model.pairs = sorted(gains, key=lambda pair: (-gains[pair], pair))[:n_pairs]
    model.joint = np.zeros((len(model.pairs), BINS, BINS))
    for _ in range(pair_rounds):
        for k, pair in enumerate(model.pairs):
            g, h = pull()
            step = rate * _cross_tree(square(g, cells[pair]), square(h, cells[pair]), penalty)[1]
            model.joint[k] += step
            total += step.ravel()[cells[pair]]
    return model


def feature_column(text: str = "text"):
    @F.arrow_udf("array<double>")
    def of(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            x = np.concatenate([features(p) for p in slices(part)]) if len(part) else np.zeros((0, len(FEATURES)))
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(FEATURES)), pa.array(x.ravel()))

    return of(F.col(text))


def slices(part: pa.Array, most: int = 1 << 20) -> Iterator[pa.Array]:
    """Pieces of about `most` bytes of whole texts."""
    _, offsets = text_bytes(part)
    at = 0
    while at < len(part):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield part.slice(at, to - at)
        at = to


def train(docs: DataFrame, labels: DataFrame, train_rows: int = 20_000) -> AdditiveModel:
    """Fit on at most `train_rows` labelled documents, chosen by a hash of the id; held-out ids are never read.

    The bound makes the sample fit for a broadcast and for the driver. Documents with several labels count by the mean.
    """
    small_batches(docs.sparkSession)
    chosen = (
        labels.where(F.col("quality").isNotNull() & (id_crc() % 5 != 0)).groupBy("doc_id").agg(F.avg("quality").alias("_label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    )
    rows = (
        docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "_label", feature_column().alias("x"))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "x").limit(train_rows).toPandas()
    )
    x = np.array(rows["x"].tolist(), float).reshape(len(rows), len(FEATURES))
    return fit(x, (rows["_label"].to_numpy(float) >= 0.5).astype(float))


def score_column(model: AdditiveModel, text: str = "text"):
    """The model's score of each whole text, as a column; the model's tables have a fixed size."""

    @F.arrow_udf("double")
    def score(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            yield pa.array(np.concatenate([model.score(features(p)) for p in slices(part)]) if len(part) else np.zeros(0))

    return score(F.col(text))


def accepted(docs: DataFrame, labels: DataFrame, least: float = 0.3, train_rows: int = 20_000) -> DataFrame:
    """The rows of docs whose score reaches `least`, with all their columns."""
    return docs.where(score_column(train(docs, labels, train_rows)) >= least)


def classify(docs: DataFrame, labels: DataFrame, least: float = 0.3, train_rows: int = 20_000) -> DataFrame:
    """doc_id, held_out, score and predicted (1 where the score reaches `least`) of every row of docs."""
    return docs.select("doc_id", "text").withColumn("score", score_column(train(docs, labels, train_rows))).select(
        "doc_id", F.coalesce(id_crc() % 5 == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted")
    )
