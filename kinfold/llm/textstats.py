"""Counts and ratios of whole texts, and bounded labelled samples of them.

The counts come from one Arrow pass over (doc_id, text); the ratios are Spark
expressions over the counts. Words are runs outside space and \\x09-\\x0D.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm.common import bounded_batches, held_out, texts

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
COUNTS = (
    "n_words word_chars n_symbols n_dup_lines n_repeat_words n_lines n_upper n_digits n_bangs n_stops n_pipes n_distinct n_bytes n_wide"
).split()


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that the text has twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    often = Counter(windows)
    at = np.flatnonzero(np.fromiter((often[w] > 1 for w in windows), dtype=bool, count=len(windows)))
    hit = np.zeros(len(words), dtype=bool)
    for k in range(3):
        hit[at + k] = True
    return int(hit.sum())


def counts(text: str) -> tuple[int, ...]:
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    seen = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return (
        len(words),
        len(text) - int(seen[32] + seen[9:14].sum()),
        int(sum(seen[ord(c)] for c in SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        int(seen[65:91].sum()),
        int(seen[48:58].sum()),
        int(seen[33]),
        int(seen[44] + seen[46]),
        int(seen[124]),
        len(set(words)),
        len(raw),
        int(seen[128:].sum()),
    )


def _stats(batches):
    for batch in batches:
        rows = [counts(t or "") for t in batch.column("text").to_pylist()]
        columns = list(zip(*rows)) if rows else [()] * len(COUNTS)
        kept = [batch.column(k) for k, name in enumerate(batch.schema.names) if name != "text"]
        names = [name for name in batch.schema.names if name != "text"]
        yield pa.RecordBatch.from_arrays([*kept, *(pa.array(c, pa.int64()) for c in columns)], [*names, *COUNTS])


def text_counts(rows: DataFrame) -> DataFrame:
    """COUNTS beside what (doc_id, text, ...) has besides the text."""
    bounded_batches(rows.sparkSession)
    kept = ", ".join(f"{n} {t}" for n, t in rows.dtypes if n != "text")
    return rows.mapInArrow(_stats, f"{kept}, " + ", ".join(f"{c} long" for c in COUNTS))


#: Name and SQL of each ratio, over COUNTS.
RATIOS = {
    "log_words": "log1p(cast(n_words as double))",
    **{
        name: f"{top} / greatest({of}, 1)"
        for name, top, of in (
            ("word_length", "word_chars", "n_words"),
            ("symbol_share", "n_symbols", "word_chars"),
            ("dup_line_share", "n_dup_lines", "n_lines"),
            ("repeat_share", "n_repeat_words", "n_words"),
            ("upper_share", "n_upper", "word_chars"),
            ("digit_share", "n_digits", "word_chars"),
            ("bangs_a_word", "n_bangs", "n_words"),
            ("stops_a_word", "n_stops", "n_words"),
            ("pipes_a_word", "n_pipes", "n_words"),
            ("distinct_share", "n_distinct", "n_words"),
            ("wide_share", "n_wide", "n_bytes"),
            ("words_a_line", "n_words", "n_lines"),
        )
    },
}
FEATURES = list(RATIOS)


def with_ratios(stats: DataFrame) -> DataFrame:
    return stats.withColumns({name: F.expr(sql) for name, sql in RATIOS.items()})


def labelled(docs: DataFrame, labels: DataFrame, label: str, mod: int, remainder: int, at_most: int) -> DataFrame:
    """(doc_id, text, label) of ``at_most`` labelled rows outside the held-out fold, in hash order.

    The bound is on what is learned from, never on what is scored. A label given twice
    counts once (the larger), and so does an id (its smallest text); null labels are left out.
    """
    picked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    picked = picked.filter(F.col("label").isNotNull() & ~held_out(F.col("doc_id"), mod, remainder))
    order = F.md5(F.col("doc_id").cast("string").cast("binary"))
    picked = picked.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(order, "doc_id").limit(at_most)
    found = texts(docs).join(F.broadcast(picked), "doc_id")
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label"))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, mod: int, remainder: int, at_most: int) -> pd.DataFrame:
    """FEATURES and ``label`` of the labelled sample on the driver, at most ``at_most`` rows."""
    stats = with_ratios(text_counts(labelled(docs, labels, label, mod, remainder, at_most)))
    rows = stats.select("doc_id", "label", *FEATURES).toPandas()
    return rows.sort_values(["doc_id", *FEATURES]).reset_index(drop=True)
