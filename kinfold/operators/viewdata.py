"""The data behind each chart: the same selection, order and values, as tables.

Functions on edges, rules and transactions return DataFrames; those on fitted models
return pandas tables, which are of the models' size.
"""

from __future__ import annotations

import colorsys

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.functions import stats
from kinfold.functions.schema import GROUP, ID, ITEM
from kinfold.operators import graph, hdp, mixture, network, prep


def require_nonempty(table, what: str):
    if len(table) == 0:
        raise ValueError(f"no {what} to show")
    return table


def min_max(values, low: float, high: float) -> np.ndarray:
    """Scaled to [low, high]; constants to the middle."""
    v = np.asarray(values, dtype=float)
    if not len(v) or v.max() == v.min():
        return np.full(len(v), (low + high) / 2)
    return low + (v - v.min()) / (v.max() - v.min()) * (high - low)


def filter_and_order(theta: np.ndarray, items: list[str], threshold: float) -> list[int]:
    """Items with a probability of ``threshold`` in some class, by their likeliest class, then falling."""
    top, best = theta.max(0), theta.argmax(0)
    return sorted((i for i in range(len(items)) if top[i] >= threshold), key=lambda i: (best[i], -top[i], i))


def seriation(matrix: np.ndarray) -> list[int]:
    """From the first item on, always the most similar of those left."""
    left, order = set(range(1, len(matrix))), [0] if len(matrix) else []
    while left:
        order.append(max(sorted(left), key=lambda j: matrix[order[-1], j]))
        left.remove(order[-1])
    return order


def circle(items: list[str]) -> pd.DataFrame:
    angle = 2 * np.pi * np.arange(len(items)) / max(1, len(items))
    return pd.DataFrame({"item": items, "x": np.cos(angle), "y": np.sin(angle)})


def spring(g: graph.Graph, rounds: int = 100, seed: int = 0) -> pd.DataFrame:
    """A force-directed layout: edges pull, all vertices push."""
    n = len(g.items)
    place = np.random.default_rng(seed).uniform(-1, 1, (n, 2))
    pull = np.zeros((n, n))
    for i, near in enumerate(g.neighbours):
        for j, w in near.items():
            pull[i, j] = w
    pull /= max(1e-9, pull.max(initial=0))
    k = 1 / np.sqrt(max(1, n))
    for step in range(rounds):
        apart = place[:, None] - place[None]
        far = np.sqrt((apart**2).sum(-1)) + 1e-6
        move = (apart / far[..., None] * (k * k / far - pull * far * far / k)[..., None]).sum(1)
        size = np.sqrt((move**2).sum(1, keepdims=True)) + 1e-9
        place += move / size * np.minimum(size, 0.1 * (1 - step / rounds))
    return pd.DataFrame({"item": g.items, "x": place[:, 0], "y": place[:, 1]})


def shell(g: graph.Graph) -> pd.DataFrame:
    """Circles around the item of highest degree: each a step further along the edges."""
    depth = {}
    order = sorted(range(len(g.items)), key=lambda i: (-len(g.neighbours[i]), g.items[i]))
    for start in order:
        if start in depth:
            continue
        depth[start], ring = 0 if not depth else 1, [start]
        while ring:
            ring = sorted({j for i in ring for j in g.neighbours[i] if j not in depth} - set(depth))
            for j in ring:
                depth[j] = 1 + min(depth[i] for i in g.neighbours[j] if i in depth)
    x, y = np.zeros(len(g.items)), np.zeros(len(g.items))
    for level in set(depth.values()):
        on = [i for i in range(len(g.items)) if depth[i] == level]
        for k, i in enumerate(on):
            angle = 2 * np.pi * k / len(on)
            x[i], y[i] = level * np.cos(angle), level * np.sin(angle)
    return pd.DataFrame({"item": g.items, "x": x, "y": y})


def stress(g: graph.Graph, rounds: int = 60) -> pd.DataFrame:
    """Places whose distances follow the numbers of edges between items, by stress majorisation from a circle."""
    n = len(g.items)
    far = np.full((n, n), float(max(1, n)))
    for i in range(n):
        far[i, i], ring, seen, step = 0.0, [i], {i}, 0
        while ring:
            step += 1
            ring = list({k for j in ring for k in g.neighbours[j]} - seen)
            seen.update(ring)
            far[i, ring] = step
    place = circle(g.items)[["x", "y"]].to_numpy(dtype=float)
    with np.errstate(divide="ignore"):
        weight = np.where(far > 0, far**-2.0, 0.0)
    total = weight.sum(1, keepdims=True)
    for _ in range(rounds if n > 1 else 0):
        apart = place[:, None] - place[None]
        size = np.maximum(np.sqrt((apart**2).sum(-1)), 1e-9)
        place = (weight[..., None] * (place[None] + (far / size)[..., None] * apart)).sum(1) / total
    return pd.DataFrame({"item": g.items, "x": place[:, 0], "y": place[:, 1]})


def layout(g: graph.Graph, kind: str = "stress", seed: int = 0) -> pd.DataFrame:
    """item, x, y by ``stress``, ``spring``, ``shell`` or ``circle``; another name gives ``stress``."""
    made = {"spring": lambda: spring(g, seed=seed), "shell": lambda: shell(g), "circle": lambda: circle(g.items)}
    return made.get(kind, lambda: stress(g))()


def categorical_colors(n: int) -> list[str]:
    """``n`` different colours as #rrggbb: hues in golden steps around the circle."""
    out = []
    for k in range(n):
        r, g, b = colorsys.hls_to_rgb((0.6 + 0.6180339887 * k) % 1.0, 0.45 + 0.1 * (k % 3), 0.65)
        out.append("#" + "".join(f"{round(255 * v):02x}" for v in (r, g, b)))
    return out


# Rules


def arm_scatter(rules: DataFrame, x: str = "support", y: str = "confidence", colour: str = "lift", top_n: int = 10) -> DataFrame:
    """x, y, colour, n, significant, and a label for the ``top_n`` by colour."""
    from pyspark.sql import Window as W

    name = F.concat(stats.format_itemset(F.col("lhs")), F.lit(" => "), F.col("rhs"))
    marked = F.col("significant") if "significant" in rules.columns else F.lit(None).cast("boolean")
    out = rules.select(F.col(x).alias("x"), F.col(y).alias("y"), F.col(colour).alias("colour"), "n", marked.alias("significant"), name.alias("rule"))
    place = F.row_number().over(W.orderBy(F.desc("colour"), "rule"))
    return out.withColumn("label", F.when(place <= top_n, F.col("rule")))


def arm_comparison(comparison: DataFrame, labels: tuple[str, str] = ("a", "b"), metric: str = "lift", top_n: int = 20) -> DataFrame:
    """Top rules by the larger of both groups' metric; a missing one is 0 and flagged."""
    cols = [f"group_{x.lower()}_{metric}" for x in labels]
    zero = [F.coalesce(c, F.lit(0.0)) for c in cols]
    out = comparison.select("rule_key", *(z.alias(c) for z, c in zip(zero, cols)), *(F.col(c).isNull().alias(f"{c}_missing") for c in cols), "category")
    return out.orderBy(F.desc(F.greatest(*(F.col(c) for c in cols))), "rule_key").limit(top_n)


def arm_matrix(rules: DataFrame, metric: str = "lift") -> DataFrame:
    """item_a, item_b, value: the larger metric of both directions of rules with one item each side."""
    single = rules.filter(F.size("lhs") == 1)
    a, b = F.col("lhs")[0], F.col("rhs")
    best = single.groupBy(F.least(a, b).alias("item_a"), F.greatest(a, b).alias("item_b")).agg(F.max(metric).alias("value"))
    return best.union(best.select("item_b", "item_a", "value")).orderBy("item_a", "item_b")


# Networks


def network_nodes(net: network.Network, communities: pd.DataFrame, kind: str = "stress", seed: int = 0) -> pd.DataFrame:
    """item, x, y, size (by prevalence, 15 to 50), community."""
    g = graph.collect_graph(net.edges)
    prevalence = net.nodes.toPandas().set_index("item")["prevalence"]
    out = require_nonempty(layout(g, kind, seed), "network").merge(communities, on="item")
    return out.assign(size=min_max([prevalence[i] for i in out["item"]], 15, 50))


def network_lines(net: network.Network) -> pd.DataFrame:
    """item_a, item_b, weight, width (0.5 to 5)."""
    out = net.edges.select("item_a", "item_b", "weight").orderBy("item_a", "item_b").toPandas()
    return out.assign(width=min_max(out["weight"], 0.5, 5))


def network_comparison(nets: dict[str, network.Network], communities: dict[str, pd.DataFrame]) -> pd.DataFrame:
    return pd.concat([network_nodes(n, communities[k]).assign(group=k) for k, n in nets.items()], ignore_index=True)


def community_heatmap(net: network.Network, communities: pd.DataFrame) -> tuple[pd.DataFrame, list[int]]:
    """Weights as a square table ordered by community and item, and where the blocks end."""
    order = communities.sort_values(["community", "item"], ignore_index=True)
    rows = net.edges.select("item_a", "item_b", "weight").collect()
    square = pd.DataFrame(0.0, index=order["item"], columns=order["item"])
    for a, b, w in rows:
        square.loc[a, b] = square.loc[b, a] = w
    return square, order.groupby("community").size().cumsum().tolist()


def centrality_bars(metrics: pd.DataFrame, metric: str = "strength", top_n: int = 15) -> pd.DataFrame:
    return metrics[["item", metric]].sort_values([metric, "item"], ascending=[False, True], ignore_index=True).head(top_n)


def centrality_comparison(metrics: dict[str, pd.DataFrame], metric: str = "strength", top_n: int = 10) -> pd.DataFrame:
    return pd.concat([centrality_bars(m, metric, top_n).assign(group=k) for k, m in metrics.items()], ignore_index=True)


def stratified_network(a: network.Network, b: network.Network) -> tuple[DataFrame, DataFrame]:
    """Edges of both with ``side`` (shared, a, b), and items with the larger prevalence."""
    pick = lambda n, s: n.edges.select("item_a", "item_b", F.col("weight").alias(f"weight_{s}"))
    edges = pick(a, "a").join(pick(b, "b"), ["item_a", "item_b"], "full_outer")
    side = F.when(F.col("weight_a").isNull(), "b").when(F.col("weight_b").isNull(), "a").otherwise("shared")
    nodes = a.nodes.select(ITEM, "prevalence").union(b.nodes.select(ITEM, "prevalence")).groupBy(ITEM).agg(F.max("prevalence").alias("prevalence"))
    return edges.withColumn("side", side), nodes


# Mixtures


def class_probabilities(c: mixture.Clustering, threshold: float = 0.05) -> pd.DataFrame:
    """cluster, item, theta for items at ``threshold`` in some class, in chart order."""
    theta = c.selection.best.theta
    order = filter_and_order(theta, c.items, threshold)
    return pd.DataFrame([(k + 1, c.items[i], float(theta[k, i])) for i in order for k in range(len(theta))], columns=["cluster", "item", "theta"])


def bic_elbow(s: mixture.Selection) -> pd.DataFrame:
    t = s.table().sort_values("k", ignore_index=True)
    return t.assign(best=t["k"] == s.best_k)


def class_profiles(c: mixture.Clustering, top_n: int = 10) -> pd.DataFrame:
    t = c.profiles.sort_values(["cluster", "theta", "item"], ascending=[True, False, True])
    return t.groupby("cluster").head(top_n).reset_index(drop=True)


def clustering_comparison(found: dict[str, mixture.Clustering], threshold: float = 0.1) -> pd.DataFrame:
    return pd.concat([class_probabilities(c, threshold).assign(group=k) for k, c in found.items()], ignore_index=True)


def top_items(c: hdp.HdpClustering, k: int, n: int) -> str:
    theta = c.model.theta[k]
    return ", ".join(c.items[i] for i in np.argsort(-theta, kind="stable")[:n])


def hdp_stick_weights(c: hdp.HdpClustering, beta: float = 0.01, n: int = 2) -> pd.DataFrame:
    """Active components: cluster, beta_weight, pi of each group, category, the likeliest items."""
    kinds = hdp.categorize(c)["category"]
    rows = [
        {"cluster": k + 1, "beta_weight": w, **{f"pi_{g}": c.model.pi_mean[j, k] for j, g in enumerate(c.groups)}, "category": kinds[k], "items": top_items(c, k, n)}
        for k, w in enumerate(c.model.beta_mean)
        if w > beta
    ]
    return pd.DataFrame(rows)


def hdp_class_profiles(c: hdp.HdpClustering, beta: float = 0.01, threshold: float = 0.05, annotate: float = 0.15) -> pd.DataFrame:
    live = [k for k, w in enumerate(c.model.beta_mean) if w > beta]
    theta = c.model.theta[live]
    order = filter_and_order(theta, c.items, threshold) if live else []
    rows = [(live[k] + 1, c.items[i], float(theta[k, i]), bool(theta[k, i] >= annotate)) for i in order for k in range(len(live))]
    return pd.DataFrame(rows, columns=["cluster", "item", "theta", "annotated"])


def hdp_sharing(c: hdp.HdpClustering, beta: float = 0.01, n: int = 3) -> pd.DataFrame:
    t = hdp_stick_weights(c, beta, n)
    return t.melt(["cluster", "beta_weight", "category", "items"], [f"pi_{g}" for g in c.groups], "group", "pi").assign(group=lambda x: x["group"].str[3:])


def hdp_butterfly(c: hdp.HdpClustering, beta: float = 0.01) -> pd.DataFrame:
    """For two groups: the first group's weights to the left (negative), the second's to the right."""
    if len(c.groups) != 2:
        raise ValueError(f"exactly two groups are needed; there are {len(c.groups)}")
    rows = [(k + 1, -c.model.pi_mean[0, k], c.model.pi_mean[1, k], top_items(c, k, 2)) for k, w in enumerate(c.model.beta_mean) if w >= beta]
    return pd.DataFrame(rows, columns=["cluster", "left", "right", "items"])


# Overview


def upset(trans: DataFrame, min_count: int = 5, top_n: int = 30) -> tuple[DataFrame, DataFrame]:
    """The most frequent exact combinations, and the sizes of the items' sets."""
    best = prep.intersections(trans, min_count).withColumn("combination", F.array_join("items", " + "))
    return best.orderBy(F.desc("n"), "combination").limit(top_n), prep.item_counts(trans).orderBy(F.desc("n"), ITEM)


def record_heatmap(trans: DataFrame, at_most: int = 200, seed: int = 0) -> DataFrame:
    """id, items, n_items of a seeded sample of records, the longest first."""
    picked = trans.orderBy(F.xxhash64(F.lit(seed), F.col(ID).cast("string")), ID).limit(at_most)
    return picked.select(ID, "items", F.size("items").alias("n_items")).orderBy(F.desc("n_items"), ID)


def item_prevalence(events: DataFrame, top_n: int = 30, groups: list[str] | None = None) -> DataFrame:
    """item, overall and a column for each of the two lowest groups: percent of records with the item."""
    if groups is None:
        groups = [r[0] for r in events.select(GROUP).distinct().filter(F.col(GROUP).isNotNull()).orderBy(GROUP).limit(2).collect()]
    rows = events.select(ID, GROUP, ITEM)
    total = rows.agg(F.count_distinct(ID).alias("all"), *(F.count_distinct(F.when(F.col(GROUP) == g, F.col(ID))).alias(f"all_{i}") for i, g in enumerate(groups)))
    per = rows.groupBy(ITEM).agg(F.count_distinct(ID).alias("k"), *(F.count_distinct(F.when(F.col(GROUP) == g, F.col(ID))).alias(f"k_{i}") for i, g in enumerate(groups)))
    joined = per.join(F.broadcast(total))
    out = joined.select(ITEM, (100.0 * F.col("k") / F.col("all")).alias("overall"), *(F.try_divide(100.0 * F.col(f"k_{i}"), F.col(f"all_{i}")).alias(f"group_{g}") for i, g in enumerate(groups)))
    return out.orderBy(F.desc("overall"), ITEM).limit(top_n)


def phi_pairs(trans: DataFrame) -> DataFrame:
    """item_a, item_b, phi for all pairs of items of the records, unmet pairs included."""
    single = prep.item_counts(trans)
    n = trans.agg(F.count("*").alias("total"))
    a = single.select(F.col(ITEM).alias("item_a"), F.col("n").alias("n_a"))
    b = single.select(F.col(ITEM).alias("item_b"), F.col("n").alias("n_b"))
    met = network.pair_counts(prep.long_form(trans)).select("item_a", "item_b", "n11")
    pairs = a.join(b, F.col("item_a") < F.col("item_b")).join(F.broadcast(n)).join(met, ["item_a", "item_b"], "left").na.fill(0, ["n11"])
    return pairs.select("item_a", "item_b", stats.phi(*stats.cells(F.col("n11"), F.col("n_a"), F.col("n_b"), F.col("total"))).alias("phi"))


def phi_heatmap(trans: DataFrame, annotate: float = 0.02) -> tuple[pd.DataFrame, pd.DataFrame]:
    """The square phi table in seriation order, and which cells are annotated."""
    items = prep.item_index(trans)
    at = {x: i for i, x in enumerate(items)}
    square = np.eye(len(items))
    for a, b, v in phi_pairs(trans).collect():
        square[at[a], at[b]] = square[at[b], at[a]] = v
    order = seriation(square)
    names = [items[i] for i in order]
    out = pd.DataFrame(square[np.ix_(order, order)], index=names, columns=names)
    return out, (out.abs() > annotate) & ~np.eye(len(items), dtype=bool)
