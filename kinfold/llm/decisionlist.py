"""Quality rules: a learned decision list, emitted as one ordered Spark expression.

Sequential covering: a rule is a conjunction of thresholds on a document's statistics.
It is grown on two thirds of the labelled rows by information gain until it covers no
good document (or no threshold helps), pruned from its end on the other third, and kept
if it is precise there. What it covers leaves the rows, and the next rule is sought.
The list becomes ``CASE WHEN rule 1 ... ELSE keep``, so it runs in Catalyst and can be
read and edited.

Learned from at most ``max_labelled`` labelled rows; statistics and verdicts cover all
rows and whole texts. Defined results: null and empty texts have no words and fail the
base rule; without labels, or with one class, the list is empty and the base rule
decides; repeated rows get the same verdict; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.llm import textstats
from kinfold.llm.common import texts

MAX_LABELLED = 20_000


@dataclass(frozen=True)
class Threshold:
    feature: str
    above: bool
    value: float

    def covers(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] > self.value if self.above else x[self.feature] <= self.value

    def column(self) -> Column:
        return F.col(self.feature) > F.lit(self.value) if self.above else F.col(self.feature) <= F.lit(self.value)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.value:.6g}"


Rule = tuple[Threshold, ...]


def covered(rule: Rule, x: dict[str, np.ndarray], rows: int) -> np.ndarray:
    hit = np.ones(rows, dtype=bool)
    for t in rule:
        hit &= t.covers(x)
    return hit


def best_threshold(x: dict[str, np.ndarray], bad: np.ndarray, inside: np.ndarray, cuts: dict[str, np.ndarray]) -> Threshold | None:
    """The threshold of the largest information gain on the rows inside the rule so far."""
    p0, n0 = int((bad & inside).sum()), int((~bad & inside).sum())
    before = np.log2((p0 + 1e-9) / (p0 + n0 + 1e-9))
    best, found = 1e-6, None
    for name, values in x.items():
        edges = cuts[name]
        if not len(edges):
            continue
        at = np.searchsorted(edges, values[inside], side="left")
        p_low = np.cumsum(np.bincount(at[bad[inside]], minlength=len(edges) + 1))[:-1]
        n_low = np.cumsum(np.bincount(at[~bad[inside]], minlength=len(edges) + 1))[:-1]
        for above, p, n in ((False, p_low, n_low), (True, p0 - p_low, n0 - n_low)):
            gain = p * (np.log2((p + 1e-9) / (p + n + 1e-9)) - before)
            k = int(np.argmax(gain))
            if gain[k] > best:
                best, found = float(gain[k]), Threshold(name, above, float(edges[k]))
    return found


def learn(x: dict[str, np.ndarray], bad: np.ndarray, max_rules: int = 12, max_terms: int = 4, precision: float = 0.95, least: int = 5) -> list[Rule]:
    rows = len(bad)
    if rows == 0 or bad.all() or not bad.any():
        return []
    fold = np.arange(rows) % 3
    left = np.ones(rows, dtype=bool)
    cuts = {}
    for c, v in x.items():
        seen = np.unique(np.quantile(v, np.linspace(0, 1, 257)))
        cuts[c] = (seen[1:] + seen[:-1]) / 2
    rules: list[Rule] = []
    while len(rules) < max_rules:
        grow, check = left & (fold < 2), left & (fold == 2)
        rule: Rule = ()
        while len(rule) < max_terms:
            inside = grow & covered(rule, x, rows)
            if not (~bad & inside).any():
                break
            term = best_threshold(x, bad, inside, cuts)
            if term is None:
                break
            rule += (term,)
        if not rule:
            break

        def worth(r: Rule) -> tuple[float, int]:
            hit = check & covered(r, x, rows)
            p, n = int((hit & bad).sum()), int((hit & ~bad).sum())
            return ((p - n) / (p + n) if p + n else -1.0, p)

        rule = max((rule[:k] for k in range(len(rule), 0, -1)), key=worth)
        hit = left & covered(rule, x, rows)
        p, n = int((hit & bad).sum()), int((hit & ~bad).sum())
        score, p_check = worth(rule)
        if p < least or p / (p + n) < precision or score < 2 * precision - 1 or p_check < 1:
            break
        rules.append(rule)
        left &= ~hit
        if not (left & bad).any():
            break
    return rules


def expression(rules: list[Rule], keep: Column | None = None) -> Column:
    """Number of the first rule that a row meets, as one CASE; 0 where none does."""
    out = None
    for k, rule in enumerate(rules, 1):
        test = rule[0].column()
        for t in rule[1:]:
            test = test & t.column()
        out = F.when(test, F.lit(k)) if out is None else out.when(test, F.lit(k))
    return F.lit(0) if out is None else out.otherwise(F.lit(0))


def describe(rules: list[Rule]) -> list[str]:
    return [" AND ".join(map(str, r)) for r in rules]


def quality_rules(docs: DataFrame, labels: DataFrame, label: str = "quality", mod: int = 3, remainder: int = 1, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """doc_id, the base statistics, base_failed, kept, and the number of the rule that fired."""
    rows = textstats.training_rows(docs, labels, label, mod, remainder, max_labelled)
    x = {c: rows[c].to_numpy(dtype=float) for c in textstats.FEATURES}
    rules = learn(x, rows["label"].to_numpy() == 0)
    stats = textstats.with_ratios(textstats.text_counts(texts(docs)))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return stats.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & (expression(rules) == 0)).alias("kept"),
        expression(rules).alias("rule"),
    )
