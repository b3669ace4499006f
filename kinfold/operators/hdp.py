"""Hierarchical Dirichlet process mixtures of Bernoulli profiles over groups of records.

Truncated stick-breaking, fitted by coordinate ascent: expected counts over the patterns,
then the items' Betas, the global sticks from pooled counts and each group's sticks
around the global weights. A run stops after five small changes of the bound in a row.
The pooled counts are an approximation, so the bound may fall now and then.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.functions import special
from kinfold.functions.schema import GROUP, ID, require
from kinfold.operators import prep
from kinfold.operators.mixture import item_priors
from kinfold.operators.patterns import Patterns, assigner, compress, together

LAST = 1e-6
PATIENCE = 5


def neg_kl_beta(a, b, a0, b0) -> np.ndarray:
    """Minus the divergence of Beta(a, b) from Beta(a0, b0)."""
    both = special.digamma(np.add(a, b))
    return special.log_beta(a, b) - special.log_beta(a0, b0) + (a0 - a) * (special.digamma(a) - both) + (b0 - b) * (special.digamma(b) - both)


def stick_logs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Expected log weights along the last axis."""
    both = special.digamma(a + b)
    stay = special.digamma(b) - both
    before = np.cumsum(stay, axis=-1) - stay
    return special.digamma(a) - both + before


def stick_means(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Mean weights along the last axis; the last takes what is left."""
    v = a / (a + b)
    left = np.cumprod(1 - v, axis=-1)
    left = np.concatenate([np.ones((*left.shape[:-1], 1)), left[..., :-1]], axis=-1)
    out = v * left
    out[..., -1] = left[..., -1]
    return out


def effective_k(weights, threshold: float = 0.95) -> int:
    """The fewest weights that make up ``threshold``."""
    total = np.cumsum(np.sort(np.asarray(weights))[::-1])
    return int(min(len(total), np.searchsorted(total, threshold - 1e-12) + 1))


def tails(counts: np.ndarray) -> np.ndarray:
    """Sums of all later entries along the last axis."""
    return np.cumsum(counts[..., ::-1], axis=-1)[..., ::-1] - counts


@dataclass
class Hdp:
    a: np.ndarray
    b: np.ndarray
    beta_mean: np.ndarray
    pi_mean: np.ndarray  # groups x K
    log_pi: np.ndarray
    elbo: float
    n_iter: int
    converged: bool
    effective_k: int

    @property
    def theta(self) -> np.ndarray:
        return self.a / (self.a + self.b)

    def terms(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return expected_terms(self.log_pi, self.a, self.b)


def expected_terms(log_pi, a, b) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    both = special.digamma(a + b)
    yes, no = special.digamma(a) - both, special.digamma(b) - both
    return log_pi, yes - no, no.sum(1)


def run_cavi(p: Patterns, means: np.ndarray, k: int, alpha: float, gamma: float, a0, b0, max_iter: int, tol: float, rng):
    """For ``together``; returns an Hdp."""
    j, d = len(p.groups), len(p.items)
    theta = np.clip(means * (0.5 + rng.random((k, d))), 0.01, 0.99)
    log_pi = np.log(rng.dirichlet(np.full(k, 10.0), size=j))
    e = yield log_pi, np.log(theta) - np.log1p(-theta), np.log1p(-theta).sum(1)
    before, calm, converged, step, bound = -np.inf, 0, False, 0, -np.inf
    for step in range(1, max_iter + 1):
        if step > 1:
            e = yield expected_terms(log_pi, a, b)
        pooled = e.by_group.sum(0)
        if step > 1:  # of the parameters that the counts were taken with
            data = e.total + float(neg_kl_beta(a, b, a0, b0).sum())
            sticks = float(neg_kl_beta(ga[:-1], gb[:-1], 1.0, gamma).sum())
            mine = alpha * beta_mean[:-1], np.maximum(alpha * tails(beta_mean)[:-1], LAST)
            sticks += float(neg_kl_beta(pa[:, :-1], pb[:, :-1], np.maximum(mine[0], LAST), mine[1]).sum())
            bound = data + sticks
            calm = calm + 1 if abs(bound - before) < tol * (1 + abs(before)) else 0
            before = bound
            if calm >= PATIENCE:
                converged = True
                break
        a, b = a0 + e.by_item, b0 + pooled[:, None] - e.by_item
        a, b = np.maximum(a, LAST), np.maximum(b, LAST)
        ga, gb = 1 + pooled, gamma + tails(pooled)
        gb[-1] = LAST
        beta_mean = stick_means(ga, gb)
        pa = np.maximum(alpha * beta_mean + e.by_group, LAST)
        pb = np.maximum(alpha * tails(beta_mean) + tails(e.by_group), LAST)
        log_pi = stick_logs(pa, pb)
    pi_mean = stick_means(pa, pb)
    order = np.argsort(-beta_mean, kind="stable")
    return Hdp(a[order], b[order], beta_mean[order], pi_mean[:, order], log_pi[:, order], bound, step, converged, 0)


def fit(
    p: Patterns,
    k_max: int = 20,
    alpha: float = 1.0,
    gamma: float = 1.0,
    prior: str = "flat",
    alpha_prior: float = 1.0,
    beta_prior: float = 1.0,
    concentration: float = 10.0,
    floor: float = 1.0,
    max_iter: int = 300,
    tol: float = 1e-5,
    n_init: int = 3,
    threshold: float = 0.95,
    seed: int = 0,
) -> Hdp:
    """The run with the best bound."""
    if (p.n_by_group == 0).any():
        raise ValueError("a group has no records")
    if p.n_records < k_max:
        warnings.warn(f"{p.n_records} records for up to {k_max} components", stacklevel=2)
    a0, b0 = item_priors(p, prior, alpha_prior, beta_prior, concentration, floor)
    means = p.item_means()
    runs = together(p, (run_cavi(p, means, k_max, alpha, gamma, a0, b0, max_iter, tol, np.random.default_rng([seed, i])) for i in range(n_init)))
    finite = [r for r in runs if np.isfinite(r.elbo)]
    if not finite:
        raise ArithmeticError("no run has a finite bound")
    best = max(finite, key=lambda r: r.elbo)
    best.effective_k = effective_k(best.beta_mean, threshold)
    return best


@dataclass
class HdpClustering:
    model: Hdp
    items: list[str]
    groups: list
    profiles: pd.DataFrame  # cluster, beta_weight, item, theta
    group_profiles: pd.DataFrame  # group, cluster, pi
    assignments: DataFrame  # id, group, cluster, probability
    n_by_group: dict


def hdp_clustering(events: DataFrame, group_by: str = GROUP, min_items: int = 2, timing: str = "all", window: int = 0, exclusive=None, **arguments) -> HdpClustering:
    """Records are made within each group, so an id in two groups is two records."""
    require(events, group_by)
    named = events if group_by == GROUP else events.drop(GROUP).withColumnRenamed(group_by, GROUP)
    keyed = prep.strata(named, exclusive).drop(GROUP).withColumnRenamed("stratum", GROUP)
    records = prep.transactions(keyed, min_items=0, timing=timing, window=window, keys=(GROUP,)).persist()  # read again for the groups and the assignments
    trans = records.filter(F.size("items") >= min_items)
    p = compress(trans, GROUP)
    missing = {r[0] for r in (records if timing == "all" else keyed).select(GROUP).distinct().collect()} - set(p.groups)
    if missing:
        raise ValueError(f"groups without records of {min_items} items: {', '.join(sorted(missing))}")
    m = fit(p, **arguments)
    k, d = m.theta.shape
    profiles = pd.DataFrame({"cluster": np.repeat(np.arange(1, k + 1), d), "beta_weight": np.repeat(np.round(m.beta_mean, 4), d), "item": p.items * k, "theta": np.round(m.theta, 4).ravel()})
    by_group = pd.DataFrame({"group": np.repeat(p.groups, k), "cluster": list(range(1, k + 1)) * len(p.groups), "pi": np.round(m.pi_mean, 4).ravel()})
    where = assigner(trans, p.items, p.groups, GROUP, *m.terms(), [ID, GROUP])
    return HdpClustering(m, p.items, p.groups, profiles, by_group, where, dict(zip(p.groups, p.n_by_group.astype(int).tolist())))


def categories(weights: DataFrame, presence: float = 0.05, beta: float = 0.01, ratio: float = 2.0, floor: float = 1e-8) -> DataFrame:
    """cluster, beta_weight, category from a long table (cluster, beta_weight, group, pi)."""
    there = F.col("pi") > presence
    per = weights.groupBy("cluster", "beta_weight").agg(
        F.count_if(there).alias("k"),
        F.count("*").alias("all"),
        F.array_join(F.array_sort(F.collect_list(F.when(there, F.lower(F.col("group").cast("string"))))), "_and_").alias("names"),
        F.max("pi").alias("top"),
        F.min("pi").alias("low"),
    )
    even = F.col("top") / F.greatest(F.col("low"), F.lit(floor)) < ratio
    kind = (
        F.when(F.col("beta_weight") <= beta, "negligible")
        .when((F.col("k") == F.col("all")) & even, "universal")
        .when(F.col("k") == F.col("all"), "both_present_but_unequal")
        .when(F.col("k") == 0, "negligible")
        .otherwise(F.concat(F.lit("group_"), "names", F.lit("_only")))
    )
    return per.select("cluster", "beta_weight", kind.alias("category"))


def categorize(c: HdpClustering, **arguments) -> pd.DataFrame:
    """One row a component, with its category; the rule is ``categories``."""
    spark = c.assignments.sparkSession
    rows = [(k + 1, float(c.model.beta_mean[k]), str(g), float(c.model.pi_mean[j, k])) for k in range(len(c.model.beta_mean)) for j, g in enumerate(c.groups)]
    table = spark.createDataFrame(rows, "cluster int, beta_weight double, `group` string, pi double")
    return categories(table, **arguments).orderBy("cluster").toPandas()


def hdp_summary(c: HdpClustering, threshold: float = 0.15, beta: float = 0.01, top: int = 8) -> str:
    """Active components with the likeliest items and their central 95 % intervals."""
    kinds = categorize(c)
    lines = [f"{sum(c.n_by_group.values())} records, effective K {c.model.effective_k}, bound {c.model.elbo:.1f}"]
    lines += [f"  {kind}: {n}" for kind, n in sorted(kinds["category"].value_counts().items())]
    for k, weight in enumerate(c.model.beta_mean):
        if weight <= beta:
            continue
        lines.append(f"  component {k + 1} (beta {weight:.3f}, {kinds['category'][k]})")
        theta = c.model.theta[k]
        for i in np.argsort(-theta, kind="stable")[:top]:
            if theta[i] >= threshold:
                low, high = (special.beta_quantile(q, c.model.a[k, i], c.model.b[k, i]) for q in (0.025, 0.975))
                lines.append(f"    {c.items[i]} {theta[i]:.3f} [{low:.3f}, {high:.3f}]")
    return "\n".join(lines)
