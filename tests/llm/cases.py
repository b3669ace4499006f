"""Small tables with the awkward rows every operator must take."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, hub string, gram string, size int, key string, class string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "ly"]) for _ in range(n))


def documents(spark, seed: int = 1, extra: list | None = None):
    """Prose, copies, near copies, nulls, empty and blank texts, a long text, repeated rows and shared passages."""
    rng = random.Random(seed)
    base = prose(rng, 60)
    passage = prose(rng, 30)
    rows = [(k, prose(rng, rng.randint(1, 80))) for k in range(12)]
    rows += [(20, base), (21, base), (22, base + " omega"), (23, "psi " + base), (24, base.upper())]
    rows += [(30 + k, f"{prose(rng, 15)} {passage} {prose(rng, 15)}") for k in range(4)]
    rows += [(40, None), (41, ""), (42, " \n\t "), (43, "word"), (44, "word"), (None, base), (45, prose(rng, 4000)), (46, "ab" * 300)]
    rows += [(20, base), (50, "naïve Ünïcode 文字 ✓ " * 8), (51, "x" * 99), (52, "x" * 100), (53, "x" * 101)]
    rows += extra or []
    rng.shuffle(rows)
    full = [(i, t, "en", None if (i or 0) % 5 == 4 else f"src{(i or 0) % 3}", None, "h", "g", 7, "k", "c") for i, t in rows]
    return spark.createDataFrame(full, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def pairs(df) -> list:
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]
