"""Records as a weighted table of distinct item sets, the input of the mixture models.

A likelihood depends on a record's items (and group) only, so counting equal sets loses
nothing. ``Patterns.expect`` is the one pass the models make over the data: given log
weights of components by group and log odds of items, it returns expected counts.
``together`` lets runs (restarts, numbers of classes) share each pass. Patterns are held
as blocks of bits. With up to ``max_local`` patterns a pass runs in numpy on the driver;
beyond, it is a job over the cached blocks, which returns only sums of the size of the models.
"""

from __future__ import annotations

from collections.abc import Generator, Iterable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.functions.special import log_sum_exp

MAX_LOCAL = 200_000
BLOCK = "rows int, bits binary, g binary, n binary"
Terms = tuple[np.ndarray, np.ndarray, np.ndarray]  # log_pi (groups x K), log_odds (K x D), base (K)


@dataclass
class Expected:
    by_group: np.ndarray  # groups x K
    by_item: np.ndarray  # K x D
    total: float  # sum of log normalisers


@dataclass
class Patterns:
    items: list[str]
    groups: list
    n_by_group: np.ndarray
    table: DataFrame | None = None  # BLOCK
    x: np.ndarray | None = None
    g: np.ndarray | None = None
    n: np.ndarray | None = None
    cells: int = field(default=4_000_000)

    @property
    def n_records(self) -> int:
        return int(self.n_by_group.sum())

    def item_means(self) -> np.ndarray:
        zero = np.zeros((len(self.groups), 1))
        counts = self.expect(zero, np.zeros((1, len(self.items))), np.zeros(1)).by_item[0]
        return counts / max(1, self.n_records)

    def responsibilities(self, log_pi: np.ndarray, log_odds: np.ndarray, base: np.ndarray) -> np.ndarray:
        """Of the local patterns: R[p, k]."""
        z = self.x @ log_odds.T + base + log_pi[self.g]
        return np.exp(z - log_sum_exp(z, 1)[:, None])

    def expect(self, log_pi: np.ndarray, log_odds: np.ndarray, base: np.ndarray) -> Expected:
        """Sums over records of R = softmax(log_pi[group] + base + items . log_odds)."""
        return self.expect_all([(log_pi, log_odds, base)])[0]

    def expect_all(self, models: list[Terms]) -> list[Expected]:
        """``expect`` of several models, in one pass."""
        width = len(self.items)
        if self.x is not None:
            step = max(1, self.cells // max(1, sum(len(m[2]) for m in models)))
            parts = [sums(self.x[a : a + step], self.g[a : a + step], self.n[a : a + step], models) for a in range(0, max(1, len(self.x)), step)]
            flat = sum(parts)
        else:

            def run(batches):
                import pyarrow as pa
                from pyspark import TaskContext

                total = 0
                for batch in batches:
                    for block in batch.to_pylist():
                        total = total + sums(*opened(block, width), models)
                if not isinstance(total, int):
                    yield pa.RecordBatch.from_pydict({"at": pa.array([TaskContext.get().partitionId()], pa.int32()), "v": [total.tobytes()]})

            found = self.table.mapInArrow(run, "at int, v binary").collect()
            flat = sum(np.frombuffer(r["v"]) for r in sorted(found, key=lambda r: r["at"]))
        out, at = [], 0
        for log_pi, log_odds, _ in models:
            ends = np.cumsum([at, log_pi.size, log_odds.size, 1])
            out.append(Expected(flat[ends[0] : ends[1]].reshape(log_pi.shape), flat[ends[1] : ends[2]].reshape(log_odds.shape), float(flat[ends[2]])))
            at = ends[3]
        return out


def sums(x, g, n, models: list[Terms]) -> np.ndarray:
    """For each model by_group, by_item and total, one after another."""
    z = x @ np.concatenate([m[1] for m in models]).T
    r, out, at = np.empty_like(z), [], 0
    for log_pi, _, base in models:
        part = slice(at, at := at + len(base))
        mine = z[:, part] + base + log_pi[g]
        norm = log_sum_exp(mine, 1) if len(mine) else np.zeros(0)
        r[:, part] = np.exp(mine - norm[:, None]) * n[:, None]
        out.append([part, np.stack([np.bincount(g, c, len(log_pi)) for c in r[:, part].T], axis=1), (norm * n).sum()])
    by_item = r.T @ x
    return np.concatenate([v for part, by_group, total in out for v in (by_group.ravel(), by_item[part].ravel(), [total])])


def together(p: Patterns, runs: Iterable[Generator[Terms, Expected, object]]) -> list:
    """The results of runs that yield their terms and are sent what to expect; a pass serves all that go on."""
    runs = list(runs)
    out: list = [None] * len(runs)
    asked = {i: next(r) for i, r in enumerate(runs)}
    while asked:
        for i, e in zip(list(asked), p.expect_all(list(asked.values()))):
            try:
                asked[i] = runs[i].send(e)
            except StopIteration as end:
                out[i] = end.value
                del asked[i]
    return out


def opened(block: dict, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """x, g and n of a block."""
    bits = np.frombuffer(block["bits"], np.uint8).reshape(block["rows"], -1)
    return np.unpackbits(bits, axis=1, count=width).astype(float), np.frombuffer(block["g"], np.int64), np.frombuffer(block["n"])


def packer(items: list[str], groups: list):
    """Of batches of group, items and n: blocks of bits in the order of ``items``."""
    at, number = {x: i for i, x in enumerate(items)}, {x: i for i, x in enumerate(groups)}

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            lists, g = batch.column("items"), batch.column("group").dictionary_encode()
            size = len(batch)
            x = np.zeros((size, len(items)), bool)
            names = lists.flatten().dictionary_encode()
            x[np.repeat(np.arange(size), lists.value_lengths().to_numpy(zero_copy_only=False)), np.array([at[v] for v in names.dictionary.to_pylist()], int)[names.indices.to_numpy(zero_copy_only=False)]] = True
            mine = np.array([number[v] for v in g.dictionary.to_pylist()], np.int64)[g.indices.to_numpy(zero_copy_only=False)]
            n = batch.column("n").to_numpy(zero_copy_only=False).astype(float)
            yield pa.RecordBatch.from_pydict({"rows": pa.array([size], pa.int32()), "bits": [np.packbits(x, axis=1).tobytes()], "g": [mine.tobytes()], "n": [n.tobytes()]})

    return run


def in_order(x: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Places of the patterns by group, then by their lists of items."""
    row, col = np.nonzero(x)
    k = np.bincount(row, minlength=len(x))
    keys = np.zeros((len(x), 1 + k.max(initial=0)), ">u4")
    keys[:, 0] = g
    keys[row, 1 + np.arange(len(row)) - np.repeat(np.cumsum(k) - k, k)] = col + 1
    return np.argsort(keys.view(f"S{keys.shape[1] * 4}").ravel(), kind="stable")


def compress(trans: DataFrame, group: str | None = None, max_local: int = MAX_LOCAL) -> Patterns:
    """Patterns of a table with ``items`` (arrays) and, optionally, a column of groups; the table is read once."""
    named = trans.select("items", (F.col(group) if group else F.lit("all")).alias("group"))
    counted = named.groupBy("group", "items").agg(F.count("*").alias("n")).persist()
    by_group = {r["group"]: r["n"] for r in counted.groupBy("group").agg(F.sum("n").alias("n")).collect()}
    items = [r[0] for r in counted.select(F.explode("items").alias("i")).distinct().orderBy("i").collect()]
    groups = sorted(by_group)
    out = Patterns(items, groups, np.array([by_group[k] for k in groups], dtype=float))
    tasks = 2 * trans.sparkSession.sparkContext.defaultParallelism  # each pass starts as many
    table = counted.select("group", "items", "n").coalesce(tasks).mapInArrow(packer(items, groups), BLOCK).persist()
    n_patterns = table.agg(F.sum("rows")).first()[0] or 0
    counted.unpersist()
    if n_patterns > max_local:
        out.table = table
        return out
    blocks = [opened(r.asDict(), len(items)) for r in table.collect()]
    table.unpersist()
    x, g, n = (np.concatenate(v) for v in zip(*blocks)) if blocks else (np.zeros((0, len(items))), np.zeros(0, np.int64), np.zeros(0))
    order = in_order(x, g)
    out.x, out.g, out.n = x[order], g[order], n[order]
    return out


def of_matrix(x, group=None) -> Patterns:
    """Patterns of a 0/1 matrix and group numbers, without Spark."""
    x = np.asarray(x, dtype=float)
    if x.ndim != 2 or not len(x):
        raise ValueError("no records")
    g = np.zeros(len(x), dtype=int) if group is None else np.asarray(group, dtype=int)
    both, n = np.unique(np.column_stack([g, x]), axis=0, return_counts=True)
    groups = list(range(int(g.max()) + 1))
    counts = np.bincount(g, minlength=len(groups)).astype(float)
    return Patterns([str(i) for i in range(x.shape[1])], groups, counts, x=both[:, 1:], g=both[:, 0].astype(int), n=n.astype(float))


def assigner(trans: DataFrame, items: list[str], groups: list, group: str | None, log_pi: np.ndarray, log_odds: np.ndarray, base: np.ndarray, keep: list[str]) -> DataFrame:
    """``keep`` columns, cluster (from 1) and its probability for each record, scored where the record is."""
    at = {x: i for i, x in enumerate(items)}
    number = {x: i for i, x in enumerate(groups)}

    def run(frames):
        for f in frames:
            x = np.zeros((len(f), len(items)))
            for i, names in enumerate(f["items"]):
                x[i, [at[v] for v in names if v in at]] = 1
            g = np.array([number[v] for v in f[group]], dtype=int) if group else np.zeros(len(f), dtype=int)
            z = x @ log_odds.T + base + log_pi[g]
            r = np.exp(z - log_sum_exp(z, 1)[:, None]) if len(z) else z
            yield f[keep].assign(cluster=(r.argmax(1) + 1).astype(np.int32) if len(r) else np.zeros(0, np.int32), probability=r.max(1) if len(r) else np.zeros(0))

    kinds = dict(trans.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", cluster int, probability double"
    return trans.mapInPandas(run, schema)
