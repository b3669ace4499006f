"""Association statistics of 2x2 tables as column expressions, exact tests and corrections.

A table is four columns ``n11 n10 n01 n00``; a pair is ``n11`` with the margins ``n_a``
and ``n_b`` of ``n`` records.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from kinfold.functions import special
from kinfold.functions.schema import CORRECTIONS, TESTS, choose


def cells(n11: Column, n_a: Column, n_b: Column, n: Column) -> tuple[Column, Column, Column, Column]:
    return n11, n_a - n11, n_b - n11, n - n_a - n_b + n11


def contingency(trans: DataFrame, a: str, b: str) -> DataFrame:
    """One row: n11, n10, n01, n00 of two items over the records' item lists."""
    has = {k: F.array_contains("items", F.lit(v)) for k, v in (("a", a), ("b", b))}
    count = lambda x, y: F.count_if((has["a"] == x) & (has["b"] == y))
    return trans.agg(count(True, True).alias("n11"), count(True, False).alias("n10"), count(False, True).alias("n01"), count(False, False).alias("n00"))


def odds_ratio(n11: Column, n10: Column, n01: Column, n00: Column, correction: str = "haldane") -> Column:
    """ad/bc. Haldane adds a half to each cell if one is zero; ``none`` gives infinity or NaN."""
    choose(correction, ("haldane", "none"), "correction")
    parts = [c.cast("double") for c in (n11, n10, n01, n00)]
    if correction == "haldane":
        zero = (n11 == 0) | (n10 == 0) | (n01 == 0) | (n00 == 0)
        a, b, c, d = (p + F.when(zero, 0.5).otherwise(0.0) for p in parts)
        return (a * d) / (b * c)
    a, b, c, d = parts
    top, low = a * d, b * c
    return F.when(low != 0, F.try_divide(top, low)).when(top == 0, F.lit(float("nan"))).otherwise(F.lit(float("inf")))


def phi(n11: Column, n10: Column, n01: Column, n00: Column) -> Column:
    a, b, c, d = (x.cast("double") for x in (n11, n10, n01, n00))
    low = F.sqrt((a + b) * (c + d)) * F.sqrt((a + c) * (b + d))
    return F.when(low == 0, 0.0).otherwise(F.try_divide(a * d - b * c, low))


def expected(n_a: Column, n_b: Column, n: Column) -> Column:
    return F.try_divide(n_a.cast("double") * n_b, n.cast("double"))


def lift(n11: Column, n_a: Column, n_b: Column, n: Column) -> Column:
    e = expected(n_a, n_b, n)
    return F.when(e > 0, F.try_divide(n11.cast("double"), e)).otherwise(0.0)


def chi_square(n11: Column, n10: Column, n01: Column, n00: Column) -> Column:
    """Pearson's statistic without continuity correction; 0 where a margin is empty."""
    a, b, c, d = (x.cast("double") for x in (n11, n10, n01, n00))
    low = (a + b) * (c + d) * (a + c) * (b + d)
    return F.when(low == 0, 0.0).otherwise(F.try_divide((a + b + c + d) * F.pow(a * d - b * c, F.lit(2.0)), low))


@pandas_udf(DoubleType())
def fisher_right(n11: pd.Series, n_a: pd.Series, n_b: pd.Series, n: pd.Series) -> pd.Series:
    """Right tail of Fisher's exact test, a batch of pairs at once."""
    return pd.Series(special.fisher_right(n11, n_a, n_b, n))


@pandas_udf(DoubleType())
def chi_square_p(statistic: pd.Series) -> pd.Series:
    return pd.Series(special.chi_square_p(statistic))


def p_value(n11: Column, n_a: Column, n_b: Column, n: Column, test: str = "fisher") -> Column:
    if choose(test, TESTS, "test") == "fisher":
        return fisher_right(n11, n_a, n_b, n)
    return chi_square_p(chi_square(*cells(n11, n_a, n_b, n)))


def test_association(table: DataFrame, test: str = "fisher") -> DataFrame:
    """Adds observed, expected, odds_ratio, p_value and test to rows of n11, n10, n01, n00."""
    a, b, c, d = (F.col(x) for x in ("n11", "n10", "n01", "n00"))
    n_a, n_b, n = a + b, a + c, a + b + c + d
    return table.withColumns(
        {
            "observed": a,
            "expected": expected(n_a, n_b, n),
            "odds_ratio": odds_ratio(a, b, c, d),
            "p_value": p_value(a, n_a, n_b, n, test),
            "test": F.lit(test),
        }
    )


def adjust(df: DataFrame, method: str = "bh", p: str = "p_value", keys: Sequence[str] = (), out: str = "p_adjusted") -> DataFrame:
    """Adds the adjusted p-value; each combination of ``keys`` is a family of its own.

    Ties share their value. A family is a table of item pairs, whose number does not
    grow with the records.
    """
    choose(method, CORRECTIONS, "correction")
    family = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    m = F.count(p).over(family)
    if method == "bonferroni":
        return df.withColumn(out, F.least(F.lit(1.0), F.col(p) * m))
    rising = family.orderBy(F.asc(p)).rangeBetween(W.unboundedPreceding, 0)
    if method == "holm":
        stepped = df.withColumn("_step", (m - F.rank().over(family.orderBy(F.asc(p))) + 1) * F.col(p))
        return stepped.withColumn(out, F.least(F.lit(1.0), F.max("_step").over(rising))).drop("_step")
    stepped = df.withColumn("_step", F.col(p) * m / F.count(p).over(rising))
    falling = family.orderBy(F.desc(p)).rangeBetween(W.unboundedPreceding, 0)
    return stepped.withColumn(out, F.least(F.lit(1.0), F.min("_step").over(falling))).drop("_step")


def stars(p: Column) -> Column:
    """***, ** and * below 0.001, 0.01 and 0.05, else ns."""
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("ns")


def format_itemset(items: Column) -> Column:
    return F.array_join(F.array_sort(items), " + ")
