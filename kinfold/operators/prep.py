"""Record summaries, group and timing filters, and transactions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.functions.schema import GROUP, ID, ITEM, STRATUM, TIMINGS, YEAR, choose, exclusive_table, require


def record_summary(events: DataFrame) -> DataFrame:
    """id, group (the smallest), n_items (rows, not distinct items), items (distinct, ascending)."""
    return events.groupBy(ID).agg(
        F.min(GROUP).alias(GROUP),
        F.count("*").alias("n_items"),
        F.array_sort(F.collect_set(ITEM)).alias("items"),
    )


def filter_group(events: DataFrame, group=None, exclusive=None) -> DataFrame:
    """Rows of one group without the items exclusive to any other; all rows if ``group`` is None."""
    if group is None:
        return events
    kept = events.filter(F.col(GROUP) == F.lit(group))
    table = exclusive_table(events.sparkSession, exclusive)
    if table is None:
        return kept
    foreign = table.filter(F.col("xgroup") != F.lit(str(group))).select(ITEM).distinct()
    return kept.join(foreign, ITEM, "left_anti").select(events.columns)


def strata(events: DataFrame, exclusive=None) -> DataFrame:
    """Adds ``stratum``, the group; rows of items exclusive to another group are gone, and rows without a group."""
    out = events.filter(F.col(GROUP).isNotNull()).withColumn(STRATUM, F.col(GROUP).cast("string"))
    table = exclusive_table(events.sparkSession, exclusive)
    if table is None:
        return out
    barred = table.select(F.col(ITEM).alias("_item"), "xgroup").distinct()
    return out.join(barred, (out[ITEM] == barred["_item"]) & (out[STRATUM] != barred["xgroup"]), "left_anti")


def span_test(timing: str, window: int):
    """Whether a record's years are near together, or far apart."""
    return F.col("span") <= window if timing == "concurrent" else F.col("span") > window


def filter_by_timing(events: DataFrame, timing: str = "all", window: int = 0) -> DataFrame:
    """Rows of records with two or more distinct items whose years span at most (concurrent) or more than ``window``."""
    choose(timing, TIMINGS, "timing")
    if timing == "all":
        return events
    require(events, YEAR)
    records = events.groupBy(ID).agg((F.max(YEAR) - F.min(YEAR)).alias("span"), F.count_distinct(ITEM).alias("k"))
    kept = records.filter((F.col("k") >= 2) & span_test(timing, window)).select(ID)
    return events.join(kept, ID, "left_semi")


def transactions(
    events: DataFrame,
    group=None,
    min_items: int = 2,
    timing: str = "all",
    window: int = 0,
    exclusive=None,
    keys: Sequence[str] = (),
) -> DataFrame:
    """keys, id, items (distinct, ascending): one row a record with ``min_items`` distinct items or more.

    The span of years is over all of the record's remaining rows. One aggregation does it
    all: the filters are on its result.
    """
    choose(timing, TIMINGS, "timing")
    rows = filter_group(events, group, exclusive)
    aggs = [F.array_sort(F.collect_set(ITEM)).alias("items")]
    if timing != "all":
        require(events, YEAR)
        aggs.append((F.max(YEAR) - F.min(YEAR)).alias("span"))
    out = rows.groupBy(*keys, ID).agg(*aggs).filter(F.size("items") >= min_items)
    if timing != "all":
        out = out.filter(span_test(timing, window))
    return out.select(*keys, ID, "items")


def long_form(trans: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """keys, id, item."""
    return trans.select(*keys, ID, F.explode("items").alias(ITEM))


def one_hot(trans: DataFrame, items: list[str] | None = None) -> DataFrame:
    """id and a boolean column for each item, ascending; for the edge of the API."""
    rows = long_form(trans)
    if items is None:
        items = [r[0] for r in rows.select(ITEM).distinct().orderBy(ITEM).collect()]
    wide = rows.groupBy(ID).pivot(ITEM, items).agg(F.lit(True))
    return wide.select(ID, *(F.coalesce(F.col(f"`{i}`"), F.lit(False)).alias(i) for i in items))


def item_index(trans: DataFrame) -> list[str]:
    """All items in ascending order: the columns of the binary matrix."""
    return [r[0] for r in long_form(trans).select(ITEM).distinct().orderBy(ITEM).collect()]


def intersections(trans: DataFrame, min_count: int = 5) -> DataFrame:
    """items, n: exact combinations of items in ``min_count`` records or more."""
    return trans.groupBy("items").agg(F.count("*").alias("n")).filter(F.col("n") >= min_count)


def item_counts(trans: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return long_form(trans, keys).groupBy(*keys, ITEM).agg(F.count("*").alias("n"))
