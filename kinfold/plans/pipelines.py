"""Three pipelines from a path or an event table to a result: rules, networks, mixtures."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.functions import schema
from kinfold.functions.schema import GROUP, STRATUM
from kinfold.operators import graph, mixture, network, prep
from kinfold.operators import strata as by_group
from kinfold.operators.mining import association_rules, frequent_itemsets
from kinfold.operators.validate import validate_rules
from kinfold.sources.io import read_events


def loaded(source, group_col: str) -> DataFrame:
    """The event columns of a path or table; a null id or item raises when it is read, a missing column at once."""
    df = read_events(SparkSession.getActiveSession() or SparkSession.builder.getOrCreate(), source) if isinstance(source, str) else source
    return schema.events(df, group_col)


@dataclass
class FullResult:
    itemsets: DataFrame
    rules: DataFrame
    stratified: dict[str, DataFrame] | None = None
    comparison: dict[tuple[str, str], DataFrame] | None = None


def full_pipeline(
    source,
    group_col: str | None = GROUP,
    min_support: float = 0.005,
    min_confidence: float = 0.1,
    min_count: int | None = 30,
    max_length: int = 4,
    test: str = "fisher",
    correction: str = "bh",
    alpha: float = 0.05,
    timing: str = "all",
    window: int = 0,
    exclusive=None,
) -> FullResult:
    """Itemsets and validated rules of all records, by group, and compared between groups.

    Exclusive items are left out within groups, not for all records together.
    """
    events = loaded(source, group_col or GROUP)
    trans = prep.transactions(events, timing=timing, window=window).persist()
    rules = association_rules(trans, min_support, min_confidence, min_count, max_length)
    out = FullResult(frequent_itemsets(trans, min_support, min_count, max_length), validate_rules(rules, events, test, correction, alpha))
    if group_col is not None:
        found, _ = by_group.stratified_rules(events, min_support, min_confidence, min_count, max_length, test, correction, timing, window, exclusive, alpha)
        found = found.persist()
        names = [str(g) for g in by_group.groups(events)]
        out.stratified = {g: found.filter(F.col(STRATUM) == g).drop(STRATUM) for g in names}
        have = {r[0] for r in found.select(STRATUM).distinct().collect()}
        pairs = [(a, b) for a, b in combinations(names, 2) if a in have and b in have]
        out.comparison = {(a, b): by_group.compare_strata(out.stratified[a], out.stratified[b], (a, b), exclusive) for a, b in pairs}
    return out


@dataclass
class NetworkResult:
    network: network.Network
    communities: graph.Communities
    metrics: pd.DataFrame
    stratified: dict[str, "NetworkResult"] | None = None
    comparison: dict[tuple[str, str], network.NetworkComparison] | None = None


def described(net: network.Network, method: str, max_iter: int = 100, seed: int = 0) -> NetworkResult:
    g = graph.collect_graph(net.edges)
    prevalence = {r.item: r.prevalence for r in net.nodes.select("item", "prevalence").collect()}
    return NetworkResult(net, graph.detect_communities(g, method, max_iter, seed), graph.network_metrics(g, prevalence))


def stratified_networks(events: DataFrame, exclusive=None, method: str = "louvain", timing: str = "all", window: int = 0, **arguments) -> dict[str, NetworkResult]:
    """All groups' pairs in one job; communities for each."""
    from pyspark.sql import Window as W

    keyed = prep.strata(events, exclusive)
    if timing != "all":
        by = W.partitionBy(STRATUM, "id")
        spans = keyed.withColumns({"span": F.max("year").over(by) - F.min("year").over(by), "k": F.size(F.collect_set("item").over(by))})
        keyed = spans.filter((F.col("k") >= 2) & prep.span_test(timing, window)).drop("span", "k")
    net = network.build_network(keyed, keys=(STRATUM,), **arguments)
    whole = network.Network(net.edges.persist(), net.nodes.persist(), net.n_records, net.keys)
    only = lambda df, g: df.filter(F.col(STRATUM) == g).drop(STRATUM)
    return {str(g): described(network.Network(only(whole.edges, str(g)), only(whole.nodes, str(g)), only(whole.n_records, str(g))), method) for g in by_group.groups(events)}


def network_pipeline(source, group_col: str | None = GROUP, method: str = "louvain", exclusive=None, timing: str = "all", window: int = 0, **arguments) -> NetworkResult:
    events = loaded(source, group_col or GROUP)
    out = described(network.build_network(events, timing=timing, window=window, **arguments), method)
    if group_col is not None:
        found = stratified_networks(events, exclusive, method, timing, window, **arguments)
        out.stratified = found
        spark = events.sparkSession
        table = lambda r: spark.createDataFrame(r.communities.table.values.tolist(), "item string, community long")
        pairs = [(a, b) for a, b in combinations(found, 2) if len(found[a].metrics) and len(found[b].metrics)]
        out.comparison = {(a, b): network.compare_networks(found[a].network, found[b].network, table(found[a]), table(found[b])) for a, b in pairs}
    return out


@dataclass
class ClusteringResult:
    clustering: mixture.Clustering
    stratified: dict[str, mixture.Clustering] | None = None
    comparison: dict[tuple[str, str], tuple[pd.DataFrame, pd.DataFrame]] | None = None


def clustering_pipeline(source, group_col: str | None = GROUP, threshold: float = 0.3, exclusive=None, **arguments) -> ClusteringResult:
    events = loaded(source, group_col or GROUP)
    out = ClusteringResult(mixture.bernoulli_clustering(events, **arguments))
    if group_col is not None:
        out.stratified = mixture.stratified_clustering(events, exclusive, **arguments)
        out.comparison = {(a, b): mixture.compare_clusterings(out.stratified[a], out.stratified[b], threshold, (a, b)) for a, b in combinations(out.stratified, 2)}
    return out
