"""Pairwise associations, the co-occurrence network and comparisons of networks."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.functions import stats
from kinfold.functions.schema import ID, ITEM
from kinfold.operators.prep import filter_by_timing, filter_group


@dataclass(frozen=True)
class Network:
    """Edges and vertices of one network, or of one for each combination of ``keys``."""

    edges: DataFrame  # keys, item_a, item_b, weight and the pair's statistics; item_a < item_b
    nodes: DataFrame  # keys, item, n, prevalence
    n_records: DataFrame  # keys, n_records
    keys: tuple[str, ...] = ()


def records(events: DataFrame, group=None, timing: str = "all", window: int = 0, exclusive=None) -> DataFrame:
    """The population of a network: rows of the group, then of the records of that timing."""
    return filter_by_timing(filter_group(events, group, exclusive), timing, window)


def pair_counts(events: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """keys, item_a, item_b, n11, n_a, n_b, n for all pairs that meet in a record.

    One shuffle on the record gathers its items; pairs are made within the row, so the
    only other shuffle is of pair counts, combined on the map side.
    """
    keys = list(keys)
    baskets = events.groupBy(*keys, ID).agg(F.array_sort(F.collect_set(ITEM)).alias("items"))
    n = baskets.groupBy(*keys).agg(F.count("*").alias("n"))
    single = baskets.select(*keys, F.explode("items").alias(ITEM)).groupBy(*keys, ITEM).agg(F.count("*").alias("k"))
    opened = baskets.filter(F.size("items") > 1).select(*keys, "items", F.posexplode("items").alias("at", "item_a"))
    after = F.slice("items", F.col("at") + 2, F.greatest(F.size("items") - F.col("at") - 1, F.lit(0)))
    pairs = opened.select(*keys, "item_a", F.explode(after).alias("item_b"))
    pairs = pairs.groupBy(*keys, "item_a", "item_b").agg(F.count("*").alias("n11"))
    for side in "ab":
        margin = single.select(*keys, F.col(ITEM).alias(f"item_{side}"), F.col("k").alias(f"n_{side}"))
        pairs = pairs.join(margin, [*keys, f"item_{side}"])
    pairs = pairs.join(n, keys) if keys else pairs.join(F.broadcast(n))
    return pairs.select(*keys, "item_a", "item_b", "n11", "n_a", "n_b", "n")


def pairwise_associations(
    events: DataFrame,
    group=None,
    test: str = "fisher",
    correction: str = "bh",
    timing: str = "all",
    window: int = 0,
    exclusive=None,
    keys: Sequence[str] = (),
) -> DataFrame:
    """keys, item_a, item_b, observed, expected, lift, phi, odds_ratio, p_value, n_a, n_b, p_adjusted.

    The family of the correction is all pairs that were observed. Lift, phi and odds
    ratio have four places and the expectation two, p-values all.
    """
    pairs = pair_counts(records(events, group, timing, window, exclusive), keys)
    n11, n_a, n_b, n = (F.col(c) for c in ("n11", "n_a", "n_b", "n"))
    four = stats.cells(n11, n_a, n_b, n)
    out = pairs.select(
        *keys,
        "item_a",
        "item_b",
        n11.alias("observed"),
        F.bround(stats.expected(n_a, n_b, n), 2).alias("expected"),
        F.bround(stats.lift(n11, n_a, n_b, n), 4).alias("lift"),
        F.bround(stats.phi(*four), 4).alias("phi"),
        F.bround(stats.odds_ratio(*four), 4).alias("odds_ratio"),
        stats.p_value(n11, n_a, n_b, n, test).alias("p_value"),
        "n_a",
        "n_b",
    )
    return stats.adjust(out, correction, keys=keys)


def build_network(
    events: DataFrame,
    weight: str = "lift",
    min_count: int = 30,
    alpha: float = 0.05,
    group=None,
    test: str = "fisher",
    correction: str = "bh",
    timing: str = "all",
    window: int = 0,
    exclusive=None,
    keys: Sequence[str] = (),
) -> Network:
    """Edges with ``observed >= min_count``, ``p_adjusted < alpha`` and lift over 1, and the items they touch."""
    keys = tuple(keys)
    rows = records(events, group, timing, window, exclusive)
    pairs = pairwise_associations(rows, test=test, correction=correction, keys=keys)
    value = F.greatest(F.col("phi"), F.lit(0.001)) if weight == "phi" else F.col("lift")
    edges = pairs.filter((F.col("observed") >= min_count) & (F.col("p_adjusted") < alpha) & (F.col("lift") > 1)).withColumn("weight", value)
    n = rows.groupBy(*keys).agg(F.count_distinct(ID).alias("n_records"))
    counts = rows.groupBy(*keys, ITEM).agg(F.count_distinct(ID).alias("n"))
    nodes = endpoints(edges, keys).join(counts, [*keys, ITEM])
    nodes = nodes.join(n, list(keys)) if keys else nodes.join(F.broadcast(n))
    return Network(edges, nodes.select(*keys, ITEM, "n", (F.col("n") / F.col("n_records")).alias("prevalence")), n, keys)


def endpoints(edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return edges.select(*keys, F.col("item_a").alias(ITEM)).union(edges.select(*keys, F.col("item_b").alias(ITEM))).distinct()


def ends(edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Each edge from both of its ends: keys, item, other, weight."""
    one = edges.select(*keys, F.col("item_a").alias(ITEM), F.col("item_b").alias("other"), "weight")
    return one.union(edges.select(*keys, F.col("item_b").alias(ITEM), F.col("item_a").alias("other"), "weight"))


def degree_strength(edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return ends(edges, keys).groupBy(*keys, ITEM).agg(F.count("*").alias("degree"), F.sum("weight").alias("strength"))


def clustering_coefficient(edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """keys, item, triangles, clustering: the share of an item's pairs of neighbours that are joined."""
    keys = list(keys)
    e = edges.select(*keys, "item_a", "item_b")
    ab, bc, ac = (e.toDF(*keys, x, y) for x, y in (("x", "y"), ("y", "z"), ("x", "z")))
    corners = ab.join(bc, [*keys, "y"]).join(ac, [*keys, "x", "z"])
    each = corners.select(*keys, F.explode(F.array("x", "y", "z")).alias(ITEM)).groupBy(*keys, ITEM).agg(F.count("*").alias("triangles"))
    out = degree_strength(edges, keys).join(each, [*keys, ITEM], "left")
    t = F.coalesce("triangles", F.lit(0))
    k = F.col("degree")
    return out.select(*keys, ITEM, t.alias("triangles"), F.when(k < 2, 0.0).otherwise(F.try_divide(2.0 * t, k * (k - 1))).alias("clustering"))


def modularity(edges: DataFrame, parts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """keys, modularity of a partition (keys, item, community)."""
    keys = list(keys)
    both = ends(edges, keys)
    strength = both.groupBy(*keys, ITEM).agg(F.sum("weight").alias("s")).join(parts, [*keys, ITEM])
    per = strength.groupBy(*keys, "community").agg(F.sum("s").alias("d"))
    mine = parts.select(*keys, F.col(ITEM).alias("item_a"), F.col("community").alias("ca"))
    other = parts.select(*keys, F.col(ITEM).alias("item_b"), F.col("community").alias("community"))
    inner = edges.join(mine, [*keys, "item_a"]).join(other, [*keys, "item_b"]).filter(F.col("ca") == F.col("community"))
    inner = inner.groupBy(*keys, "community").agg(F.sum("weight").alias("l"))
    total = both.groupBy(*keys).agg(F.sum("weight").alias("m2"))
    joined = per.join(inner, [*keys, "community"], "left")
    joined = joined.join(total, keys) if keys else joined.join(F.broadcast(total))
    share = F.try_divide(2 * F.coalesce("l", F.lit(0.0)), F.col("m2")) - F.pow(F.try_divide(F.col("d"), F.col("m2")), F.lit(2.0))
    return joined.groupBy(*keys).agg(F.coalesce(F.sum(share), F.lit(0.0)).alias("modularity"))


@dataclass(frozen=True)
class NetworkComparison:
    shared: DataFrame
    only_a: DataFrame
    only_b: DataFrame
    ari: float | None


def shared_edges(a: DataFrame, b: DataFrame) -> DataFrame:
    mine = a.select("item_a", "item_b", F.col("weight").alias("weight_a"))
    return mine.join(b.select("item_a", "item_b", F.col("weight").alias("weight_b")), ["item_a", "item_b"])


def only_edges(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("item_a", "item_b", "weight").join(b.select("item_a", "item_b"), ["item_a", "item_b"], "left_anti")


def compare_networks(a: Network, b: Network, parts_a: DataFrame | None = None, parts_b: DataFrame | None = None) -> NetworkComparison:
    """Shared edges, edges of one only, and the agreement of the communities of shared items (None under two)."""
    ari = None
    if parts_a is not None and parts_b is not None:
        both = parts_a.select(ITEM, F.col("community").alias("a")).join(parts_b.select(ITEM, F.col("community").alias("b")), ITEM)
        row = adjusted_rand(both, "a", "b").first()
        ari = row.ari if row is not None and row.n >= 2 else None
    order = ["item_a", "item_b"]
    return NetworkComparison(shared_edges(a.edges, b.edges).orderBy(order), only_edges(a.edges, b.edges).orderBy(order), only_edges(b.edges, a.edges).orderBy(order), ari)


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """n and ari of two labellings: 0 below two rows, 1 where no other value is possible."""
    two = lambda c: F.col(c) * (F.col(c) - 1) / 2.0
    cell = df.groupBy(a, b).agg(F.count("*").alias("k"))
    inner = cell.agg(F.sum(two("k")).alias("s"), F.sum("k").alias("n"))
    rows = cell.groupBy(a).agg(F.sum("k").alias("k")).agg(F.sum(two("k")).alias("sa"))
    cols = cell.groupBy(b).agg(F.sum("k").alias("k")).agg(F.sum(two("k")).alias("sb"))
    one = inner.join(F.broadcast(rows)).join(F.broadcast(cols))
    chance = F.try_divide(F.col("sa") * F.col("sb"), two("n"))
    span = (F.col("sa") + F.col("sb")) / 2 - chance
    value = F.when(F.coalesce("n", F.lit(0)) < 2, 0.0).when(F.abs(span) < 1e-12, 1.0).otherwise(F.try_divide(F.col("s") - chance, span))
    return one.select(F.coalesce("n", F.lit(0)).alias("n"), value.alias("ari"))
