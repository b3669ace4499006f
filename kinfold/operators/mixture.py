"""Flat Bernoulli mixtures by expectation-maximisation, with the number of classes by BIC."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from kinfold.functions.schema import ID, STRATUM, choose
from kinfold.operators import prep
from kinfold.operators.patterns import Patterns, assigner, compress, together

PRIORS = ("flat", "empirical_bayes")
TINY = 1e-10


def bic(log_likelihood: float, k: int, d: int, n: int) -> float:
    return -2 * log_likelihood + (k * d + k - 1) * np.log(n)


def empirical_bayes(means, concentration: float = 10.0, floor: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    means = np.asarray(means, dtype=float)
    return concentration * means + floor, concentration * (1 - means) + floor


def item_priors(p: Patterns, prior: str, alpha: float, beta: float, concentration: float, floor: float) -> tuple[np.ndarray, np.ndarray]:
    if p.n_records == 0:
        raise ValueError("no records")
    if choose(prior, PRIORS, "prior") == "empirical_bayes":
        return empirical_bayes(p.item_means(), concentration, floor)
    return np.full(len(p.items), float(alpha)), np.full(len(p.items), float(beta))


@dataclass
class Mixture:
    k: int
    theta: np.ndarray
    pi: np.ndarray
    log_likelihood: float
    bic: float
    n_iter: int
    converged: bool

    def terms(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return natural(self.theta, self.pi)


def natural(theta: np.ndarray, pi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """log_pi (one group), log odds and base of the parameters."""
    return np.log(pi)[None, :], np.log(theta) - np.log1p(-theta), np.log1p(-theta).sum(1)


def m_step(by_class: np.ndarray, by_item: np.ndarray, a: np.ndarray, b: np.ndarray, dirichlet: float) -> tuple[np.ndarray, np.ndarray]:
    eps = np.finfo(float).eps
    pi = np.maximum(by_class + dirichlet - 1, eps)
    theta = (by_item + a - 1) / (np.maximum(by_class, eps)[:, None] + a + b - 2)
    return np.clip(theta, TINY, 1 - TINY), pi / pi.sum()


def single_run(p: Patterns, k: int, a, b, dirichlet: float, max_iter: int, tol: float, rng):
    """For ``together``; returns a Mixture."""
    d = len(p.items)
    theta, pi = np.clip(rng.random((k, d)) * 0.6 + 0.2, 0.01, 0.99), np.full(k, 1 / k)
    before, converged, step = -np.inf, False, 0
    for step in range(1, max_iter + 1):
        e = yield natural(theta, pi)
        if abs(e.total - before) < tol:
            converged = True
            break
        before = e.total
        theta, pi = m_step(e.by_group.sum(0), e.by_item, a, b, dirichlet)
    if not converged:
        e = yield natural(theta, pi)
    return Mixture(k, theta, pi, e.total, bic(e.total, k, d, p.n_records), step, converged)


def fits(
    p: Patterns,
    ks,
    prior: str = "flat",
    alpha_prior: float = 1.0,
    beta_prior: float = 1.0,
    concentration: float = 10.0,
    floor: float = 1.0,
    dirichlet_prior: float = 1.0,
    max_iter: int = 200,
    tol: float = 1e-6,
    n_init: int = 5,
    seed: int = 0,
) -> dict[int, Mixture]:
    """For each k the best of ``n_init`` runs; classes in descending order of ``pi * sum(theta)``."""
    for k in ks:
        if not 1 <= k <= p.n_records:
            raise ValueError(f"k must be between 1 and the number of records, {p.n_records}; got {k}")
    a, b = item_priors(p, prior, alpha_prior, beta_prior, concentration, floor)
    starts = [(k, i) for k in ks for i in range(n_init)]
    runs = together(p, (single_run(p, k, a, b, dirichlet_prior, max_iter, tol, np.random.default_rng([seed, k, i])) for k, i in starts))
    found = {}
    for k in ks:
        best = found[k] = max((m for m in runs if m.k == k), key=lambda m: m.log_likelihood)
        order = np.argsort(-best.pi * best.theta.sum(1), kind="stable")
        best.theta, best.pi = best.theta[order], best.pi[order]
    return found


def fit(p: Patterns, k: int, **arguments) -> Mixture:
    """``fits`` of one number of classes."""
    return fits(p, [k], **arguments)[k]


@dataclass
class Selection:
    by_k: dict[int, Mixture]
    best_k: int

    @property
    def best(self) -> Mixture:
        return self.by_k[self.best_k]

    def table(self) -> pd.DataFrame:
        """k and bic, the best first."""
        return pd.DataFrame({"k": list(self.by_k), "bic": [m.bic for m in self.by_k.values()]}).sort_values(["bic", "k"], ignore_index=True)


def select_k(p: Patterns, ks, **arguments) -> Selection:
    ks = [k for k in ks if k <= max(1, p.n_records - 1)]
    if not ks:
        raise ValueError("no number of classes to try")
    found = fits(p, list(dict.fromkeys(ks)), **arguments)
    return Selection(found, min(found, key=lambda k: (found[k].bic, k)))


@dataclass
class Clustering:
    selection: Selection
    items: list[str]
    profiles: pd.DataFrame  # cluster, proportion (percent), item, theta
    assignments: DataFrame  # id, cluster, probability
    n_records: int


def profiles(items: list[str], m: Mixture) -> pd.DataFrame:
    """One row for each class and item."""
    k, d = m.theta.shape
    return pd.DataFrame(
        {
            "cluster": np.repeat(np.arange(1, k + 1), d),
            "proportion": np.repeat(np.round(100 * m.pi, 1), d),
            "item": items * k,
            "theta": np.round(m.theta, 4).ravel(),
        }
    )


def cluster(trans: DataFrame, ks=range(2, 9), **arguments) -> Clustering:
    """Selection, profiles and assignments of records given as transactions."""
    trans = trans.persist()  # the assignments read it again
    p = compress(trans)
    found = select_k(p, ks, **arguments)
    where = assigner(trans, p.items, p.groups, None, *found.best.terms(), [ID])
    return Clustering(found, p.items, profiles(p.items, found.best), where, p.n_records)


def bernoulli_clustering(events: DataFrame, ks=range(2, 9), min_items: int = 2, group=None, timing: str = "all", window: int = 0, exclusive=None, **arguments) -> Clustering:
    return cluster(prep.transactions(events, group, min_items, timing, window, exclusive), ks, **arguments)


def stratified_clustering(events: DataFrame, exclusive=None, **arguments) -> dict[str, Clustering]:
    """One clustering a group; each compresses its own patterns."""
    from kinfold.operators.strata import stratify

    return stratify(bernoulli_clustering, events, exclusive=exclusive, **arguments)


def high_items(c: Clustering, threshold: float) -> dict[str, float]:
    best = c.profiles.groupby("item")["theta"].max()
    return {i: float(v) for i, v in best.items() if v >= threshold}


def compare_clusterings(a: Clustering, b: Clustering, threshold: float = 0.3, labels: tuple[str, str] = ("A", "B")) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Items at ``threshold`` in some class of both, and each class's items that only its side has."""
    tops = [high_items(c, threshold) for c in (a, b)]
    both = sorted(tops[0].keys() & tops[1].keys())
    shared = pd.DataFrame({"item": both, "theta_a": [tops[0][i] for i in both], "theta_b": [tops[1][i] for i in both]})
    rows = []
    for label, c, other in ((labels[0], a, tops[1]), (labels[1], b, tops[0])):
        for k, t in c.profiles.groupby("cluster"):
            own = sorted(i for i, v in zip(t["item"], t["theta"]) if v >= threshold and i not in other)
            if own:
                rows.append((label, int(k), float(t["proportion"].iloc[0]), ", ".join(own)))
    return shared, pd.DataFrame(rows, columns=["group", "cluster", "proportion", "items"])


def clustering_summary(c: Clustering, threshold: float = 0.3) -> str:
    best = c.selection.best
    lines = [f"{c.n_records} records, {len(c.items)} items, {best.k} classes (BIC {best.bic:.1f})"]
    for k, t in c.profiles.groupby("cluster"):
        top = t[t["theta"] >= threshold].sort_values(["theta", "item"], ascending=[False, True])
        lines.append(f"  class {k} ({t['proportion'].iloc[0]:.1f} %): " + ", ".join(f"{i} {v:.2f}" for i, v in zip(top["item"], top["theta"])))
    return "\n".join(lines)
