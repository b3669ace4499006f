"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature is cut into quantile bins. Boosting visits the features in turn, fits a
tree of at most four leaves over one feature's bins to the current residual and adds a
small step of it to that feature's lookup table. The pairs of features that explain
most of what is left then get two-dimensional tables from four-leaf trees. A document's
score is the logistic of the sum of its bins' entries, so the scoring is a few vector
additions and each entry can be read.

The model is fitted on the driver to at most ``max_labelled`` labelled documents (a
documented sample); every document is scored, over its whole text. Defined results:
null and empty texts are scored as texts without words; without labels, or with one
class only, the score is the (smoothed) share of label 1; repeated rows are scored
alike; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm import textstats
from kinfold.llm.common import held_out, texts

MAX_LABELLED = 20_000


@dataclass
class Additive:
    intercept: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for j, (cuts, entries) in enumerate(zip(self.edges, self.tables)):
            total += entries[np.searchsorted(cuts, x[:, j], side="right")]
        coarse = [np.searchsorted(cuts, x[:, j], side="right") for j, cuts in enumerate(self.pair_edges)]
        for (a, b), entries in zip(self.pairs, self.pair_tables):
            total += entries[coarse[a], coarse[b]]
        return 1.0 / (1.0 + np.exp(-np.clip(total, -30, 30)))


def quantile_cuts(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1]))


def leaf_steps(grad: np.ndarray, hess: np.ndarray, leaves: int, ridge: float) -> np.ndarray:
    """Newton steps of the best tree of ``leaves`` leaves over ordered bins, grown greedily."""
    g, h = np.concatenate([[0], np.cumsum(grad)]), np.concatenate([[0], np.cumsum(hess)])
    worth = lambda a, b: (g[b] - g[a]) ** 2 / (h[b] - h[a] + ridge)
    parts = [(0, len(grad))]
    while len(parts) < leaves:
        best = (1e-9, None, None)
        for part in parts:
            a, b = part
            cuts = np.arange(a + 1, b)
            if len(cuts):
                gain = worth(a, cuts) + worth(cuts, b) - worth(a, b)
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], part, int(cuts[k]))
        if best[1] is None:
            break
        parts.remove(best[1])
        parts += [(best[1][0], best[2]), (best[2], best[1][1])]
    steps = np.zeros(len(grad))
    for a, b in parts:
        steps[a:b] = (g[b] - g[a]) / (h[b] - h[a] + ridge)
    return steps


def quadrant_steps(grad: np.ndarray, hess: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """Gain and Newton steps of the best cut of a two-dimensional table into four quadrants."""
    g, h = grad.cumsum(0).cumsum(1), hess.cumsum(0).cumsum(1)
    gl, gt, hl, ht = g[:, -1:], g[-1:, :], h[:, -1:], h[-1:, :]
    parts = ((g, h), (gl - g, hl - h), (gt - g, ht - h), (g[-1, -1] - gl - gt + g, h[-1, -1] - hl - ht + h))
    gain = sum(a**2 / (b + ridge) for a, b in parts)
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    steps = np.empty_like(grad)
    for (a, b), (rows, cols) in zip(parts, ((slice(0, i + 1), slice(0, j + 1)), (slice(0, i + 1), slice(j + 1, None)), (slice(i + 1, None), slice(0, j + 1)), (slice(i + 1, None), slice(j + 1, None)))):
        steps[rows, cols] = a[i, j] / (b[i, j] + ridge)
    return float(gain[i, j]), steps


def fit(x: np.ndarray, y: np.ndarray, bins: int = 32, coarse: int = 8, rounds: int = 150, n_pairs: int = 6, rate: float = 0.1, ridge: float = 2.0) -> Additive:
    rows, width = x.shape if x.ndim == 2 else (0, 0)
    share = (y.sum() + 1) / (rows + 2)
    model = Additive(float(np.log(share / (1 - share))), [], [])
    if rows == 0 or y.min() == y.max():
        return model
    model.edges = [quantile_cuts(x[:, j], bins) for j in range(width)]
    model.pair_edges = [quantile_cuts(x[:, j], coarse) for j in range(width)]
    model.tables = [np.zeros(len(c) + 1) for c in model.edges]
    at = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(model.edges)]
    total = np.full(rows, model.intercept)

    def residual():
        p = 1 / (1 + np.exp(-total))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(rounds):
        for j in range(width):
            g, h = residual()
            size = len(model.tables[j])
            step = rate * leaf_steps(np.bincount(at[j], g, size), np.bincount(at[j], h, size), 4, ridge)
            model.tables[j] += step
            total += step[at[j]]
    low = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(model.pair_edges)]

    def grids(a: int, b: int):
        g, h = residual()
        shape = (len(model.pair_edges[a]) + 1, len(model.pair_edges[b]) + 1)
        cell = low[a] * shape[1] + low[b]
        return (np.bincount(cell, v, shape[0] * shape[1]).reshape(shape) for v in (g, h))

    gains = sorted(((-quadrant_steps(*grids(a, b), ridge)[0], a, b) for a, b in combinations(range(width), 2)))
    model.pairs = [(a, b) for _, a, b in gains[:n_pairs]]
    model.pair_tables = [np.zeros((len(model.pair_edges[a]) + 1, len(model.pair_edges[b]) + 1)) for a, b in model.pairs]
    for _ in range(rounds // 3):
        for k, (a, b) in enumerate(model.pairs):
            step = rate * quadrant_steps(*grids(a, b), ridge)[1]
            model.pair_tables[k] += step
            total += step[low[a], low[b]]
    return model


def scorer(model: Additive):
    def run(batches):
        for batch in batches:
            x = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in textstats.FEATURES]) if batch.num_rows else np.zeros((0, len(textstats.FEATURES)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(x), pa.float64())], ["doc_id", "score"])

    return run


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality", mod: int = 3, remainder: int = 1, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    rows = textstats.training_rows(docs, labels, label, mod, remainder, max_labelled)
    model = fit(rows[textstats.FEATURES].to_numpy(dtype=float), rows["label"].to_numpy(dtype=float))
    stats = textstats.with_ratios(textstats.text_counts(texts(docs))).select("doc_id", *textstats.FEATURES)
    scored = stats.mapInArrow(scorer(model), "doc_id long, score double")
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id"), mod, remainder).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
