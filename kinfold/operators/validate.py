"""Tests of mined rules and itemsets against a population of records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.functions import stats
from kinfold.functions.lineage import checkpointed
from kinfold.functions.schema import CORRECTIONS, ID, ITEM, TESTS, choose
from kinfold.operators.network import pair_counts

ADDED = ("item_pair", "observed", "expected", "odds_ratio", "p_value", "p_adjusted", "significant")


def item_pairs(rules: DataFrame):
    """The pairs of a row in order: each left item with the right one, or all pairs of an itemset."""
    pair = lambda x, y: F.struct(F.least(x, y).alias("item_a"), F.greatest(x, y).alias("item_b"))
    if "rhs" in rules.columns:
        return F.transform("lhs", lambda x: pair(x, F.col("rhs")))
    rest = lambda i: F.slice("items", i + 2, F.greatest(F.size("items") - i - 1, F.lit(0)))
    return F.flatten(F.transform("items", lambda x, i: F.transform(rest(i), lambda y: pair(x, y))))


def pair_tests(pairs: DataFrame, events: DataFrame, test: str, correction: str, keys: Sequence[str]) -> DataFrame:
    """Counts over all records of ``events`` and adjusted p-values for distinct pairs."""
    keys = list(keys)
    n = events.groupBy(*keys).agg(F.count_distinct(ID).alias("n"))
    wanted = pairs.select(*keys, "item_a", "item_b").distinct()
    used = wanted.select(*keys, F.col("item_a").alias(ITEM)).union(wanted.select(*keys, F.col("item_b").alias(ITEM))).distinct()
    few = events.select(*keys, ID, ITEM).join(used, [*keys, ITEM], "left_semi")
    single = few.groupBy(*keys, ITEM).agg(F.count_distinct(ID).alias("k"))
    met = pair_counts(few, keys).select(*keys, "item_a", "item_b", "n11")
    out = wanted.join(met, [*keys, "item_a", "item_b"], "left").na.fill(0, ["n11"])
    for side in "ab":
        margin = single.select(*keys, F.col(ITEM).alias(f"item_{side}"), F.col("k").alias(f"n_{side}"))
        out = out.join(margin, [*keys, f"item_{side}"], "left").na.fill(0, [f"n_{side}"])
    out = out.join(n, keys) if keys else out.join(F.broadcast(n))
    n11, n_a, n_b, total = (F.col(c) for c in ("n11", "n_a", "n_b", "n"))
    out = out.withColumn("p_value", stats.p_value(n11, n_a, n_b, total, test))
    out = out.withColumn("expected", stats.expected(n_a, n_b, total)).withColumn("odds_ratio", stats.odds_ratio(*stats.cells(n11, n_a, n_b, total)))
    return stats.adjust(out, correction, keys=keys)


def validate_rules(rules: DataFrame, events: DataFrame, test: str = "fisher", correction: str = "bh", alpha: float = 0.05, keys: Sequence[str] = ()) -> DataFrame:
    """Adds to each rule or itemset the statistics of its pair with the largest adjusted p-value.

    The first such pair counts, in the order of the left side. Single-item records are part
    of the population. The family of the correction is the distinct pairs of the rules.
    """
    choose(test, TESTS, "test")
    choose(correction, CORRECTIONS, "correction")
    keys = list(keys)
    rules = checkpointed(rules)  # mined once, though joined twice
    names = [c for c in ("lhs", "rhs", "items") if c in rules.columns]
    own = [*keys, *names]
    pairs = rules.select(*own, F.posexplode(item_pairs(rules)).alias("at", "pair")).select(*own, "at", "pair.item_a", "pair.item_b")
    tested = checkpointed(pair_tests(pairs, events, test, correction, keys))
    joined = pairs.join(tested, [*keys, "item_a", "item_b"])
    label = F.concat(F.col("item_a"), F.lit(" + "), F.col("item_b"))
    values = F.struct("n11", "expected", "odds_ratio", "p_value", "p_adjusted")
    worst = joined.groupBy(*own).agg(
        F.max_by(values, F.struct("p_adjusted", (-F.col("at")).alias("at"))).alias("w"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", label.alias("label")))), lambda x: x["label"]), "; ").alias("item_pair"),
    )
    return rules.join(worst, own).select(
        *rules.columns,
        "item_pair",
        F.col("w.n11").alias("observed"),
        F.bround("w.expected", 1).alias("expected"),
        F.bround("w.odds_ratio", 3).alias("odds_ratio"),
        F.col("w.p_value").alias("p_value"),
        F.col("w.p_adjusted").alias("p_adjusted"),
        (F.col("w.p_adjusted") < alpha).alias("significant"),
    )


def top_rules(rules: DataFrame, top_n: int = 20) -> DataFrame:
    """The ``top_n`` rules by lift, with printable sides."""
    shown = rules.withColumn("rule", F.concat(stats.format_itemset(F.col("lhs")), F.lit(" => "), F.col("rhs")))
    return shown.orderBy(F.desc("lift"), "rule").limit(top_n)


def results_summary(rules: DataFrame, top_n: int = 20) -> str:
    """A printable table of the rules with the highest lift."""
    rows = top_rules(rules, top_n).collect()
    lines = [f"Top {len(rows)} rules by lift"]
    for k, r in enumerate(rows, 1):
        mark = f"  p_adj={r.p_adjusted:.3g}" if "p_adjusted" in rules.columns and r.p_adjusted is not None else ""
        lines.append(f"{k:3d}. {r.rule}  support={r.support:.4f} confidence={r.confidence:.3f} lift={r.lift:.2f} n={r.n}{mark}")
    return "\n".join(lines)
