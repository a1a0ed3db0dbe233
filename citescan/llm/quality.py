"""Quality scores: a generalised additive model with pairwise interactions.

A text is described by counts of its words and bytes. The model adds up one lookup
table for each feature and a few tables for pairs of features; the tables are
learnt by boosting, feature after feature in cycles, with shallow trees over
binned values, so each step moves one table a little. Pairs are chosen by what
they would still explain. Scoring a batch is a search for each feature's bin and
an addition of table entries, for all rows at once.

Features come from the text alone. The model is fitted on a bounded sample of the
labelled rows, ``MAX_ROWS`` of them by a hash of doc_id; every row is scored.
"""

from __future__ import annotations

import dataclasses
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citescan.llm import words as W
from citescan.llm.sliced import sliced

MAX_ROWS = 20_000
BINS, PAIR_BINS = 32, 8
ROUNDS, PAIR_ROUNDS, PAIRS = 400, 100, 6
RATE, LEAVES, LEAST_HESSIAN = 0.1, 3, 2.0

FEATURES = (
    "log_words", "word_bytes", "longest_word", "distinct_words", "top_word", "repeated_word", "distinct_trigrams",
    "upper", "digits", "bangs", "bars", "symbols", "stops", "non_ascii", "spaces", "lines_per_word", "symbol_endings", "sentence_words",
)
_CLASS = np.zeros((256, 9), np.int32)  # of bytes: upper, lower, digit, bang, bar, other symbols, stops, beyond ASCII, white space
for _i, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b"!", b"|", b"#$%&*+/<=>@[\\]^_`{}~", b".,;:?", bytes(range(128, 256)), b" \t\n\v\f\r")):
    _CLASS[list(_chars), _i] = 1
_SYMBOL = (_CLASS[:, 3] + _CLASS[:, 4] + _CLASS[:, 5]) > 0


def features(texts: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text; a null text is empty."""
    h, at, first, last, data, bounds = W.words(texts, want_bytes=True)
    out = np.zeros((len(texts), len(FEATURES)))
    length = last - first
    ends_in_symbol = _SYMBOL[data[last - 1]] if len(last) else np.zeros(0, bool)
    for i in range(len(texts)):
        a, b = at[i], at[i + 1]
        n, raw = int(b - a), data[bounds[i] : bounds[i + 1]]
        if n == 0:
            continue
        counts = np.bincount(raw, minlength=256) @ _CLASS
        upper, lower, digits, bangs, bars, symbols, stops, beyond, spaces = counts / len(raw)
        own = h[a:b]
        _, times = np.unique(own, return_counts=True)
        lines = int((raw == 10).sum())
        out[i] = (
            np.log1p(n), length[a:b].mean(), np.log1p(length[a:b].max()), len(times) / n**0.75, times.max() / n,
            (own[1:] == own[:-1]).mean() if n > 1 else 0.0, len(W.shingles(own, 3)) / max(1, n - 2),
            upper / max(1e-9, upper + lower), digits, bangs, bars, symbols, stops, beyond, spaces, lines / n, ends_in_symbol[a:b].mean(),
            n / (1 + int(np.isin(raw, (46, 33, 63)).sum())),
        )
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _tree(grad: np.ndarray, hess: np.ndarray, leaves: int) -> np.ndarray:
    """A step for each bin from sums of gradients and hessians: a tree over the ordered bins that splits where it gains most."""
    parts = [(0, len(grad))]
    g, h = np.concatenate([[0], np.cumsum(grad)]), np.concatenate([[0], np.cumsum(hess)])

    def worth(a, b):
        return (g[b] - g[a]) ** 2 / (h[b] - h[a] + 1.0)

    while len(parts) < leaves:
        best = (1e-9, None)
        for a, b in parts:
            cut = np.arange(a + 1, b)
            if not len(cut):
                continue
            fits = (h[cut] - h[a] >= LEAST_HESSIAN) & (h[b] - h[cut] >= LEAST_HESSIAN)
            gain = np.where(fits, worth(a, cut) + worth(cut, b) - worth(a, b), 0)
            if gain.max() > best[0]:
                best = (gain.max(), (a, b, int(cut[gain.argmax()])))
        if best[1] is None:
            break
        a, b, c = best[1]
        parts = [p for p in parts if p != (a, b)] + [(a, c), (c, b)]
    step = np.zeros(len(grad))
    for a, b in parts:
        step[a:b] = (g[b] - g[a]) / (h[b] - h[a] + 1.0)
    return step


def _quadrants(grad: np.ndarray, hess: np.ndarray) -> tuple[float, np.ndarray]:
    """The best cut of a pair's table into four, as what it gains and its steps."""
    g, h = (np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for x in (grad, hess))
    n, m = grad.shape
    best = (0.0, np.zeros((n, m)))
    for i in range(1, n):
        for j in range(1, m):
            areas = ((0, i, 0, j), (0, i, j, m), (i, n, 0, j), (i, n, j, m))
            sums = [[x[b, d] - x[a, d] - x[b, c] + x[a, c] for x in (g, h)] for a, b, c, d in areas]
            gain = sum(s * s / (w + 1.0) for s, w in sums)
            if gain > best[0] and all(w >= LEAST_HESSIAN or s == 0 for s, w in sums):
                step = np.zeros((n, m))
                for (a, b, c, d), (s, w) in zip(areas, sums, strict=True):
                    step[a:b, c:d] = s / (w + 1.0)
                best = (gain, step)
    return best


@dataclasses.dataclass
class Model:
    base: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    pair_cuts: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for f, (cut, table) in enumerate(zip(self.cuts, self.tables, strict=True)):
            total += table[np.searchsorted(cut, x[:, f])]
        for f, g, table in self.pairs:
            total += table[np.searchsorted(self.pair_cuts[f], x[:, f]), np.searchsorted(self.pair_cuts[g], x[:, g])]
        return _sigmoid(total)


def _cuts(x: np.ndarray, bins: int) -> list[np.ndarray]:
    return [np.unique(np.quantile(x[:, f], np.arange(1, bins) / bins)) if len(x) else np.zeros(0) for f in range(x.shape[1])]


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """The model of rows ``x`` with labels 0 and 1; without both labels it is a constant."""
    share = (y.sum() + 1) / (len(y) + 2)
    model = Model(float(np.log(share / (1 - share))), _cuts(x, BINS), [], _cuts(x, PAIR_BINS), [])
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    if len(np.unique(y)) < 2:
        return model
    total = np.full(len(y), model.base)
    binned = [np.searchsorted(c, x[:, f]) for f, c in enumerate(model.cuts)]

    def sums(at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        p = _sigmoid(total)
        return np.bincount(at, y - p, n), np.bincount(at, p * (1 - p), n)

    for _ in range(ROUNDS):
        for f, at in enumerate(binned):
            step = RATE * _tree(*sums(at, len(model.tables[f])), LEAVES)
            model.tables[f] += step
            total += step[at]
    coarse = [np.searchsorted(c, x[:, f]) for f, c in enumerate(model.pair_cuts)]
    size = [len(c) + 1 for c in model.pair_cuts]

    def pair_sums(f: int, g: int) -> tuple[np.ndarray, np.ndarray]:
        return tuple(s.reshape(size[f], size[g]) for s in sums(coarse[f] * size[g] + coarse[g], size[f] * size[g]))  # type: ignore[return-value]

    ranked = sorted(((_quadrants(*pair_sums(f, g))[0], f, g) for f in range(len(size)) for g in range(f)), reverse=True)
    model.pairs = [(f, g, np.zeros((size[f], size[g]))) for gain, f, g in ranked[:PAIRS] if gain > 0]
    for _ in range(PAIR_ROUNDS):
        for f, g, table in model.pairs:
            step = RATE * _quadrants(*pair_sums(f, g))[1]
            table += step
            total += step[coarse[f], coarse[g]]
    return model


def held_out(doc_id, folds: int = 5):
    """Whether crc32 of the id's text leaves 0; such rows' labels are never learnt. A null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(True))


def _featured(rows: DataFrame) -> DataFrame:
    """rows (…, text) → the other columns and x."""
    keep = [f for f in rows.schema.fields if f.name != "text"]
    at = rows.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            x = features(batch.column(at))
            lists = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(f.name) for f in keep] + [lists], names=[f.name for f in keep] + ["x"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep)
    return rows.mapInArrow(run, f"{kinds}, x array<double>")


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_ROWS) -> Model:
    """A model of labels outside the held-out fold; at most ``max_rows`` of them.

    A doc_id with several labels counts with the smallest, one with several texts with
    the text of the least hash; rows without label or text row are left out.
    """
    known = labels.filter(F.col(label).isin(0, 1)).filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min(label).alias("y"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    rows = rows.groupBy("doc_id", "y").agg(F.min(F.struct(F.xxhash64("text"), "text"))["text"].alias("text"))
    got = _featured(rows).select("doc_id", "y", "x").toPandas().sort_values("doc_id")
    x = np.array(got["x"].tolist(), dtype=float).reshape(len(got), len(FEATURES))
    return fit(x, got["y"].to_numpy(dtype=float))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score`` (0 to 1, higher: better); a column of that name is replaced. Null and empty texts get a score too."""
    kept = [f for f in docs.schema.fields if f.name != "score"]
    at = docs.columns.index("text")
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            columns = [batch.column(f.name) for f in kept]
            score = held.value.score(features(batch.column(at)))
            yield pa.RecordBatch.from_arrays([*columns, pa.array(score)], names=[*(f.name for f in kept), "score"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return docs.mapInArrow(run, f"{kinds}, score double")


def fold_of(doc_id: int, folds: int = 5) -> int:
    """The fold of one id, as ``held_out`` counts."""
    return zlib.crc32(str(doc_id).encode()) % folds
