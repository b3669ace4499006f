"""Column names of the event table, argument checks and the words used in reports.

An event table is long: one row for each (record, item occurrence). Times are integer
years. Strata are values of the group column; analyses take ``keys``, the columns that
tell strata apart, so that all strata run in one job.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ID, ITEM, GROUP, YEAR = "id", "item", "group", "year"
STRATUM = "stratum"
TIMINGS = ("all", "concurrent", "sequential")
TESTS = ("fisher", "chisq")
CORRECTIONS = ("bh", "bonferroni", "holm")


@dataclass(frozen=True)
class Vocabulary:
    """Nouns for titles and reports; labels only."""

    item: str = "Item"
    items: str = "Items"
    record: str = "Record"
    records: str = "Records"
    group: str = "Group"

    @property
    def item_lc(self) -> str:
        return self.item.lower()

    @property
    def record_lc(self) -> str:
        return self.record.lower()


def choose(value: str, allowed: tuple[str, ...], what: str) -> str:
    if value not in allowed:
        raise ValueError(f"{what} must be one of {', '.join(allowed)}; got {value!r}")
    return value


def require(df: DataFrame, *columns: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {', '.join(missing)}")


def events(df: DataFrame, group_col: str = GROUP, id_col: str = ID, item_col: str = ITEM, year_col: str = YEAR) -> DataFrame:
    """The event columns under their own names; a null id or item raises when it is read."""
    require(df, id_col, item_col)
    present = [(id_col, ID), (item_col, ITEM)]
    present += [(c, name) for c, name in ((group_col, GROUP), (year_col, YEAR)) if c in df.columns]
    out = df.select(*(F.col(c).alias(name) for c, name in present))
    return out.withColumns({c: not_null(c) for c in (ID, ITEM)})


def not_null(name: str) -> Column:
    return F.when(F.col(name).isNull(), F.raise_error(F.lit(f"null {name} in the event table"))).otherwise(F.col(name))


def exclusive_table(spark, exclusive) -> DataFrame | None:
    """(xgroup, item) from a mapping of groups to their items, or such a DataFrame as it is."""
    if exclusive is None or isinstance(exclusive, DataFrame):
        return exclusive
    rows = [(str(g), str(i)) for g, items in exclusive.items() for i in sorted(items)]
    return spark.createDataFrame(rows, "xgroup string, item string")
