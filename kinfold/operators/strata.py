"""Analyses by group and comparisons of rules between groups.

``stratify`` runs any analysis once for each group. The analyses of this package do
better with ``keys=("stratum",)`` on ``prep.strata(events)``: all groups in one job.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.functions.schema import GROUP, STRATUM, exclusive_table
from kinfold.operators import mining, prep, validate


def groups(events: DataFrame, group_col: str = GROUP) -> list:
    return [r[0] for r in events.select(group_col).distinct().filter(F.col(group_col).isNotNull()).orderBy(group_col).collect()]


def stratify(analysis: Callable, events: DataFrame, group_col: str = GROUP, **arguments) -> dict:
    """{group: analysis(events, group=group, ...)} in ascending order; the filter is on ``group_col`` too."""
    named = events if group_col == GROUP else events.drop(GROUP).withColumnRenamed(group_col, GROUP)
    return {g: analysis(named, group=g, **arguments) for g in groups(events, group_col)}


def stratified_rules(
    events: DataFrame,
    min_support: float = 0.005,
    min_confidence: float = 0.1,
    min_count: int | None = 30,
    max_length: int = 4,
    test: str = "fisher",
    correction: str = "bh",
    timing: str = "all",
    window: int = 0,
    exclusive=None,
    alpha: float = 0.05,
) -> tuple[DataFrame, DataFrame]:
    """(validated rules, itemsets) of all groups with their ``stratum``, in one job.

    Mining keeps to the timing; the tests are against each group's whole population.
    """
    keyed = prep.strata(events, exclusive)
    trans = prep.transactions(keyed, timing=timing, window=window, keys=(STRATUM,))
    rules = mining.association_rules(trans, min_support, min_confidence, min_count, max_length, (STRATUM,))
    sets = mining.frequent_itemsets(trans, min_support, min_count, max_length, (STRATUM,))
    return validate.validate_rules(rules, keyed, test, correction, alpha, (STRATUM,)), sets


def rule_key():
    return F.concat(F.array_join(F.array_sort("lhs"), " + "), F.lit(" => "), F.col("rhs"))


METRICS = ("support", "lift", "n", "p_adjusted", "significant")


def compare_strata(a: DataFrame, b: DataFrame, labels: tuple[str, str] = ("A", "B"), exclusive=None) -> DataFrame:
    """rule_key, lhs, rhs, each side's metrics (null where it lacks the rule) and a category.

    ``group_specific_item`` if any item is exclusive to a group, else ``universal`` if
    both have the rule, else ``group_<label>_only``. A key found twice counts with its
    largest lift. Items are compared as arrays; keys are never split.
    """
    low = [x.lower() for x in labels]
    if low[0] == low[1]:
        raise ValueError("labels differ in case only")

    def side(rules: DataFrame, label: str) -> DataFrame:
        kinds = {"p_adjusted": "double", "significant": "boolean"}
        full = rules.withColumns({c: F.lit(None).cast(t) for c, t in kinds.items() if c not in rules.columns})
        best = full.withColumn("rule_key", rule_key()).groupBy("rule_key").agg(F.max_by(F.struct("lhs", "rhs", *METRICS), "lift").alias("r"))
        return best.select("rule_key", *(F.col(f"r.{c}").alias(f"{label}_{c}") for c in ("lhs", "rhs")), *(F.col(f"r.{m}").alias(f"group_{label}_{m}") for m in METRICS))

    joined = side(a, low[0]).join(side(b, low[1]), "rule_key", "full_outer")
    lhs, rhs = (F.coalesce(f"{low[0]}_{c}", f"{low[1]}_{c}") for c in ("lhs", "rhs"))
    joined = joined.withColumns({"lhs": F.array_sort(lhs), "rhs": rhs})
    table = exclusive_table(a.sparkSession, exclusive)
    if table is None:
        special = F.lit(False)
    else:
        names = table.agg(F.collect_set("item").alias("special_items"))
        joined = joined.join(F.broadcast(names))
        special = F.arrays_overlap(F.concat("lhs", F.array("rhs")), "special_items")
    has = [F.col(f"group_{x}_lift").isNotNull() for x in low]
    category = F.when(special, "group_specific_item").when(has[0] & has[1], "universal").when(has[0], f"group_{low[0]}_only").otherwise(f"group_{low[1]}_only")
    return joined.select("rule_key", "lhs", "rhs", *(f"group_{x}_{m}" for x in low for m in METRICS), category.alias("category")).orderBy("rule_key")
