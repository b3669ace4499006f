"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Beside queries over the test tables it runs the published workload shape: records with
blocks of three of 60 items (each kept with 0.85) and a stray item in a third of them,
in two groups, at 10 thousand and 190 thousand records.
"""

from __future__ import annotations

import json
import os
import time

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession

from kinfold.functions.schema import GROUP
from kinfold.operators import hdp, mixture, network, prep
from kinfold.operators.patterns import compress
from kinfold.plans import catalog

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = (
    "record_summary transactions_long frequent_itemsets association_rules validated_rules pairwise_associations "
    "pairwise_by_group network_edges node_clustering compare_strata item_prevalence em_profiles hdp_clusters"
).split()


def blocks(spark: SparkSession, records: int, items: int = 60, seed: int = 42):
    """The event table of the workload shape."""
    rng = np.random.default_rng(seed)
    first = 3 * rng.integers(0, items // 3, records)
    keep = rng.random((records, 3)) < 0.85
    row, col = np.nonzero(keep)
    noise = np.flatnonzero(rng.random(records) < 0.3)
    ids = np.concatenate([row, noise])
    which = np.concatenate([first[row] + col, rng.integers(0, items, len(noise))])
    frame = pd.DataFrame({"id": ids, "item": [f"I{i:02d}" for i in which], "group": np.where(ids % 2, "A", "B")})
    return spark.createDataFrame(frame)


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took: dict[str, float] = {}

    def timed(name, run):
        began = time.perf_counter()
        run()
        took[name] = round(time.perf_counter() - began, 3)

    found = catalog.queries()
    found["item_prevalence"](spark, SF_DIR).count()  # starts the workers
    for name in HEADLINE:
        timed(name, lambda: found[name](spark, SF_DIR).write.format("noop").mode("overwrite").save())
    for label, records, k_max, runs in (("10k", 10_000, 10, 1), ("190k", 190_000, 20, 3)):
        events = blocks(spark, records).persist()
        events.count()
        timed(f"pairs_{label}", lambda: network.pairwise_associations(events).collect())
        timed(f"hdp_{label}", lambda: hdp.fit(compress(prep.transactions(events, keys=(GROUP,)), GROUP), k_max=k_max, n_init=runs, prior="empirical_bayes"))
        if label == "190k":
            timed("em_190k", lambda: mixture.select_k(compress(prep.transactions(events)), range(2, 7), n_init=5))
        events.unpersist()
    sf = SF_DIR.rstrip("/").rpartition("sf")[2]
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))


if __name__ == "__main__":
    main()
