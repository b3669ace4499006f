"""Posterior draws of a Bernoulli mixture, by Gibbs sampling or a mean-field fit.

Given the classes of records, weights and profiles are Dirichlet and Beta, so Gibbs
sampling has the exact posterior in the limit; the classes of all records of a pattern
are drawn at once as a multinomial split of its count. Chains are Spark tasks over the
pattern table. The mean-field fit has Dirichlet and Beta factors in closed form; its
intervals are known to be too narrow.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.functions import special
from kinfold.operators import prep
from kinfold.operators.mixture import TINY, item_priors, natural
from kinfold.operators.patterns import Patterns, compress


@dataclass
class Posterior:
    pi: np.ndarray  # draws x K
    theta: np.ndarray  # draws x K x D
    pi_ci: np.ndarray  # K x 2
    theta_ci: np.ndarray  # K x D x 2
    responsibilities: np.ndarray  # patterns x K, means over draws
    items: list[str]
    patterns: Patterns

    @property
    def assignments(self) -> np.ndarray:
        return self.responsibilities.argmax(1) + 1

    def table(self, group: str = "all") -> pd.DataFrame:
        """Long form: group, k, cluster, item and means with intervals."""
        s, k, d = self.theta.shape
        each = np.repeat(np.arange(k), d)
        return pd.DataFrame(
            {
                "group": group,
                "k": k,
                "cluster": each + 1,
                "item": self.items * k,
                "pi_mean": self.pi.mean(0)[each],
                "pi_ci_low": self.pi_ci[each, 0],
                "pi_ci_high": self.pi_ci[each, 1],
                "theta_mean": self.theta.mean(0).ravel(),
                "theta_ci_low": self.theta_ci[..., 0].ravel(),
                "theta_ci_high": self.theta_ci[..., 1].ravel(),
            }
        )


def align(pi: np.ndarray, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes of each draw in descending order of activity, ``pi * sum(theta)``."""
    order = np.argsort(-pi * theta.sum(2), axis=1, kind="stable")
    rows = np.arange(len(pi))[:, None]
    return pi[rows, order], theta[rows, order]


def intervals(draws: np.ndarray, level: float) -> np.ndarray:
    """Interpolated quantiles over the first axis, as a last axis of two."""
    return np.moveaxis(np.quantile(draws, [(1 - level) / 2, (1 + level) / 2], axis=0), 0, -1)


def mean_responsibilities(p: Patterns, pi: np.ndarray, theta: np.ndarray) -> np.ndarray:
    out = np.zeros((len(p.x), pi.shape[1]))
    for w, t in zip(pi, theta):
        out += p.responsibilities(*natural(np.clip(t, TINY, 1 - TINY), np.maximum(w, TINY)))
    return out / len(pi)


def finish(p: Patterns, pi: np.ndarray, theta: np.ndarray, level: float) -> Posterior:
    pi, theta = align(pi, theta)
    return Posterior(pi, theta, intervals(pi, level), intervals(theta, level), mean_responsibilities(p, pi, theta), p.items, p)


def gibbs_chain(p: Patterns, k: int, a, b, dirichlet: float, n_samples: int, seed) -> tuple[np.ndarray, np.ndarray]:
    """``n_samples`` draws after half as many of warm-up."""
    rng = np.random.default_rng(seed)
    theta, pi = np.clip(rng.random((k, len(p.items))) * 0.6 + 0.2, 0.01, 0.99), np.full(k, 1 / k)
    kept_pi, kept_theta = [], []
    n = p.n.astype(np.int64)
    for step in range(n_samples // 2 + n_samples):
        r = p.responsibilities(*natural(theta, pi))
        split = rng.multinomial(n, r / r.sum(1, keepdims=True))
        by_class, by_item = split.sum(0), split.T @ p.x
        pi = np.maximum(rng.dirichlet(by_class + dirichlet), TINY)
        theta = np.clip(rng.beta(by_item + a, by_class[:, None] - by_item + b), TINY, 1 - TINY)
        if step >= n_samples // 2:
            kept_pi.append(pi)
            kept_theta.append(theta)
    return np.array(kept_pi), np.array(kept_theta)


def check(p: Patterns, k: int) -> None:
    if not 1 <= k <= p.n_records:
        raise ValueError(f"k must be between 1 and the number of records, {p.n_records}; got {k}")
    if p.x is None:
        raise ValueError("too many distinct patterns for sampling; use a subsample")


def fit_gibbs(
    p: Patterns,
    k: int,
    prior: str = "flat",
    alpha_prior: float = 1.0,
    beta_prior: float = 1.0,
    concentration: float = 10.0,
    floor: float = 1.0,
    dirichlet: float = 1.0,
    n_samples: int = 1000,
    n_chains: int = 2,
    level: float = 0.95,
    seed: int = 0,
    spark: SparkSession | None = None,
) -> Posterior:
    check(p, k)
    a, b = item_priors(p, prior, alpha_prior, beta_prior, concentration, floor)
    if spark is None:
        chains = [gibbs_chain(p, k, a, b, dirichlet, n_samples, [seed, c]) for c in range(n_chains)]
    else:
        light = Patterns(p.items, p.groups, p.n_by_group, x=p.x, g=p.g, n=p.n)

        def run(frames):
            for f in frames:
                for c in f["id"]:
                    pi, theta = gibbs_chain(light, k, a, b, dirichlet, n_samples, [seed, int(c)])
                    yield pd.DataFrame({"chain": [int(c)], "pi": [pi.ravel()], "theta": [theta.ravel()]})

        rows = spark.range(0, n_chains, 1, n_chains).mapInPandas(run, "chain long, pi array<double>, theta array<double>").orderBy("chain").collect()
        chains = [(np.array(r.pi).reshape(n_samples, k), np.array(r.theta).reshape(n_samples, k, len(p.items))) for r in rows]
    return finish(p, np.concatenate([c[0] for c in chains]), np.concatenate([c[1] for c in chains]), level)


def fit_vi(
    p: Patterns,
    k: int,
    prior: str = "flat",
    alpha_prior: float = 1.0,
    beta_prior: float = 1.0,
    concentration: float = 10.0,
    floor: float = 1.0,
    dirichlet: float = 1.0,
    max_iter: int = 2000,
    tol: float = 1e-8,
    n_samples: int = 500,
    level: float = 0.95,
    seed: int = 0,
) -> Posterior:
    check(p, k)
    a0, b0 = item_priors(p, prior, alpha_prior, beta_prior, concentration, floor)
    rng = np.random.default_rng([seed, k])
    theta = np.clip(rng.random((k, len(p.items))) * 0.6 + 0.2, 0.01, 0.99)
    terms, before = natural(theta, np.full(k, 1 / k)), -np.inf
    for _ in range(max_iter):
        e = p.expect(*terms)
        weight = dirichlet + e.by_group.sum(0)
        a, b = a0 + e.by_item, b0 + e.by_group.sum(0)[:, None] - e.by_item
        both = special.digamma(a + b)
        yes, no = special.digamma(a) - both, special.digamma(b) - both
        terms = (special.digamma(weight) - special.digamma(weight.sum()))[None, :], yes - no, no.sum(1)
        if abs(e.total - before) < tol * (1 + abs(e.total)):
            break
        before = e.total
    draws = rng.dirichlet(weight, n_samples), rng.beta(a, b, (n_samples, *a.shape))
    return finish(p, np.maximum(draws[0], TINY), np.clip(draws[1], TINY, 1 - TINY), level)


def patterns_of(events: DataFrame, group=None, min_items: int = 2, timing: str = "all", window: int = 0, subsample: int | None = None, seed: int = 0) -> Patterns:
    trans = prep.transactions(events, group, min_items, timing, window)
    if subsample is not None:
        trans = trans.orderBy(F.xxhash64(F.lit(seed), F.col("id").cast("string")), "id").limit(subsample)
    return compress(trans)


def clustering_gibbs(events: DataFrame, k: int, group=None, min_items: int = 2, timing: str = "all", window: int = 0, **arguments) -> Posterior:
    return fit_gibbs(patterns_of(events, group, min_items, timing, window), k, spark=events.sparkSession, **arguments)


def clustering_vi(events: DataFrame, k: int, group=None, min_items: int = 2, timing: str = "all", window: int = 0, subsample: int | None = None, seed: int = 0, **arguments) -> Posterior:
    return fit_vi(patterns_of(events, group, min_items, timing, window, subsample, seed), k, seed=seed, **arguments)


def posterior_summary(post: Posterior, top: int = 5) -> str:
    lines = [f"{len(post.pi)} draws, {post.pi.shape[1]} classes"]
    mean = post.theta.mean(0)
    for k in range(post.pi.shape[1]):
        lines.append(f"  class {k + 1}: pi {post.pi[:, k].mean():.3f} [{post.pi_ci[k, 0]:.3f}, {post.pi_ci[k, 1]:.3f}]")
        for i in np.argsort(-mean[k], kind="stable")[:top]:
            lines.append(f"    {post.items[i]} {mean[k, i]:.3f} [{post.theta_ci[k, i, 0]:.3f}, {post.theta_ci[k, i, 1]:.3f}]")
    return "\n".join(lines)
