"""Frequent itemsets and association rules, level by level.

A level holds, for each record, its frequent itemsets so far with the frequent items that
follow the last one; the next level adds one of these. Counting combines on the map side.
Thresholds are whole counts, so no rounding can raise them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.functions.lineage import checkpointed
from kinfold.functions.schema import ITEM
from kinfold.operators.prep import long_form


def totals(trans: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """keys, n_txns; one row a stratum (a constant ``_one`` to join by where there are no keys)."""
    return trans.groupBy(*keys).agg(F.count("*").alias("n_txns"))


def with_totals(df: DataFrame, sums: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(sums, list(keys)) if keys else df.join(F.broadcast(sums))


def itemset_counts(trans: DataFrame, min_support: float = 0.005, min_count: int | None = None, max_length: int = 4, keys: Sequence[str] = ()) -> DataFrame:
    """keys, items, n, length, n_txns for all frequent sets of 1 to ``max_length`` items."""
    keys = list(keys)
    floor = F.lit(min_count) if min_count is not None else F.ceil(F.lit(float(min_support)) * F.col("n_txns") - 1e-9)
    sums = totals(trans, keys)

    def frequent(occurrences: DataFrame) -> DataFrame:
        counts = occurrences.groupBy(*keys, "items").agg(F.count("*").alias("n"))
        return with_totals(counts, sums, keys).filter(F.col("n") >= F.greatest(floor, F.lit(1)))

    # Frequent sets are few; written, no level counts or plans the ones before it again.
    singles = checkpointed(frequent(long_form(trans, keys).select(*keys, F.array(ITEM).alias("items"))))
    found = singles
    kept = singles.select(*keys, F.col("items")[0].alias(ITEM))
    rows = long_form(trans, [*keys]).select(*keys, ITEM, "id").join(kept, [*keys, ITEM], "left_semi")
    rest = rows.groupBy(*keys, "id").agg(F.array_sort(F.collect_set(ITEM)).alias("rest"))
    rest = rest.persist()  # every level starts from it
    level = rest.select(*keys, F.array().cast(trans.schema["items"].dataType).alias("items"), "rest")
    level = grow(level, keys)
    for length in range(2, max_length + 1):
        level = grow(level, keys)
        counts = checkpointed(frequent(level))
        found = found.unionByName(counts)
        if length < max_length:
            level = level.join(counts.select(*keys, "items"), [*keys, "items"], "left_semi")
    return found.withColumn("length", F.size("items"))


def grow(level: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each set with one of the items that follow it."""
    opened = level.select(*keys, "items", "rest", F.posexplode("rest").alias("at", "next"))
    after = F.slice("rest", F.col("at") + 2, F.greatest(F.size("rest") - F.col("at") - 1, F.lit(0)))
    return opened.select(*keys, F.concat("items", F.array("next")).alias("items"), after.alias("rest"))


def frequent_itemsets(trans: DataFrame, min_support: float = 0.005, min_count: int | None = None, max_length: int = 4, keys: Sequence[str] = ()) -> DataFrame:
    """keys, items, support, n, length for sets of two items or more."""
    found = itemset_counts(trans, min_support, min_count, max_length, keys).filter("length >= 2")
    return found.select(*keys, "items", (F.col("n") / F.col("n_txns")).alias("support"), "n", "length")


def association_rules(
    trans: DataFrame,
    min_support: float = 0.005,
    min_confidence: float = 0.1,
    min_count: int | None = None,
    max_length: int = 4,
    keys: Sequence[str] = (),
) -> DataFrame:
    """keys, lhs, rhs, support, confidence, coverage, lift, n, length; one item on the right."""
    keys = list(keys)
    sets = itemset_counts(trans, min_support, min_count, max_length, keys)
    whole = sets.filter("length >= 2").withColumn("rhs", F.explode("items")).withColumn("lhs", F.array_remove("items", F.col("rhs")))
    left = sets.select(*keys, F.col("items").alias("lhs"), F.col("n").alias("n_lhs"))
    right = sets.filter("length = 1").select(*keys, F.col("items")[0].alias("rhs"), F.col("n").alias("n_rhs"))
    rules = whole.join(left, [*keys, "lhs"]).join(right, [*keys, "rhs"])
    confidence = F.col("n") / F.col("n_lhs")
    return rules.filter(confidence >= min_confidence).select(
        *keys,
        "lhs",
        "rhs",
        (F.col("n") / F.col("n_txns")).alias("support"),
        confidence.alias("confidence"),
        (F.col("n_lhs") / F.col("n_txns")).alias("coverage"),
        (confidence / (F.col("n_rhs") / F.col("n_txns"))).alias("lift"),
        "n",
        "length",
    )


def fp_growth_itemsets(trans: DataFrame, min_count: int, max_length: int = 4) -> DataFrame:
    """items, n, length by Spark ML's FP-growth, for long records; half a count below avoids its rounding up."""
    from pyspark.ml.fpm import FPGrowth

    n = trans.count()
    if n == 0:
        return trans.select("items", F.lit(0).cast("long").alias("n"), F.lit(0).alias("length")).limit(0)
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, max(0.0, (min_count - 0.5) / n))).fit(trans)
    found = model.freqItemsets.select(F.array_sort("items").alias("items"), F.col("freq").alias("n"), F.size("items").alias("length"))
    return found.filter((F.col("length") >= 2) & (F.col("length") <= max_length) & (F.col("n") >= min_count))
