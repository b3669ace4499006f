"""Mixtures over all items of records, however many items there are.

``patterns`` holds a model on the driver, as items by classes, and records as rows of bits;
neither goes with vocabularies of texts. Here items stay on the executors, in blocks of
columns: for each column the numbers of the records that have it. A pass takes the records'
responsibilities, takes each column's step and its share of the records' log weights, sums
the shares by ranges of records and returns the new responsibilities. Only those (classes
by records) and sums of the classes' size are on the driver and broadcast.

Items of exactly the same records are one column that counts as often: from the first step
on they have the same parameters anyway. Nothing is left out, by frequency or otherwise.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Generator, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.functions import special
from kinfold.operators import hdp, mixture

LOCAL_CELLS = 4_000_000
CHUNK_CELLS, BLOCK_CELLS, RANGE = 2_000_000, 2_000_000, 1 << 15
BATCH = {"maxRecordsPerBatch": "1000", "maxBytesPerBatch": str(4 << 20)}  # as in ``llm``; by default all of a task's blocks are one batch
BLOCK = "seeds binary, counts binary, times binary, docs binary, names array<string>, place binary"
HALVES = np.uint64(30), np.uint64(27), np.uint64(31)


def lists_of(lengths: np.ndarray, values: np.ndarray):
    """An Arrow array of binaries with so many of the 32-bit ``values`` each."""
    import pyarrow as pa

    ends = np.concatenate([[0], np.cumsum(lengths * 4)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(values, np.int32))])


def values_of(column) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and values of such an array."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    return np.diff(ends).astype(np.int64) // 4, np.frombuffer(data.tobytes(), np.int32)


def chunked(batches, cells: int, width):
    """Tables of so many batches that ``width`` of them adds up to ``cells``."""
    import pyarrow as pa

    held, size = [], 0
    for batch in batches:
        if len(batch):
            held.append(batch)
            size += width(batch)
        if size >= cells:
            yield pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def give_back() -> None:
    """Memory of arrays that are gone, as workers are used again."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def only(column):
    """The one chunk of a combined column."""
    return column.chunk(0) if column.num_chunks else column.combine_chunks()


def invert(batches):
    """Of batches of group and items: for each chunk of records a row without item, of the records' groups, and a row an item."""
    import pyarrow as pa
    from pyspark import TaskContext

    part = TaskContext.get().partitionId() << 32
    names = ("item", "part", "docs", "groups")
    for k, table in enumerate(chunked(batches, CHUNK_CELLS, lambda b: len(b.column("items").flatten()))):
        lists, group = only(table.column("items")), only(table.column("group")).dictionary_encode()
        number = group.indices.to_numpy(zero_copy_only=False).astype(np.int32)
        kinds = pa.string(), pa.int64(), pa.binary(), pa.list_(pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(([None], [part + k], [number.tobytes()], [group.dictionary.to_pylist()]), kinds)], names)
        flat = lists.flatten().dictionary_encode()
        of = flat.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(of, kind="stable")
        docs = np.repeat(np.arange(len(lists), dtype=np.int32), lists.value_lengths().to_numpy(zero_copy_only=False))[order]
        counts = np.bincount(of, minlength=len(flat.dictionary))
        whole = pa.RecordBatch.from_arrays([flat.dictionary, pa.array(np.full(len(counts), part + k)), lists_of(counts, docs), pa.nulls(len(counts), kinds[3])], names)
        for at in range(0, len(counts), 20_000):
            yield whole.slice(at, 20_000)
        del table, lists, flat, of, order, docs, whole
        give_back()


def joiner(start: dict[int, int]):
    """Of batches sorted by item and part: one row an item, with the numbers of all its records."""

    def run(batches):
        import pyarrow as pa

        name, kept = None, []
        for batch in batches:
            if not len(batch):
                continue
            lengths, docs = values_of(batch.column("docs"))
            docs = docs + np.repeat(np.array([start[p] for p in batch.column("part").to_pylist()], np.int32), lengths)
            ids = batch.column("item").dictionary_encode().indices.to_numpy(zero_copy_only=False)
            first = np.concatenate([[0], np.nonzero(np.diff(ids))[0] + 1])
            items, sizes = batch.column("item").take(pa.array(first)), np.add.reduceat(lengths, first)
            if name is not None and items[0].as_py() != name:
                yield pa.RecordBatch.from_pydict({"item": [name], "docs": [np.concatenate(kept).tobytes()]})
                kept = []
            last = len(docs) - sizes[-1]
            if len(items) > 1:
                head = np.concatenate([*kept, docs[:last]])
                sizes[0] += sum(map(len, kept))
                yield pa.RecordBatch.from_arrays([items.slice(0, len(items) - 1), lists_of(sizes[:-1], head)], ["item", "docs"])
                kept = []
            name, kept = items[-1].as_py(), [*kept, docs[last:]]
        if name is not None:
            yield pa.RecordBatch.from_pydict({"item": [name], "docs": [np.concatenate(kept).tobytes()]})
        give_back()

    return run


def pack(batches):
    """Of batches of h, item, seed and docs, sorted by h and item: blocks of columns."""
    import pyarrow as pa

    for table in chunked(batches, BLOCK_CELLS, lambda b: len(values_of(b.column("docs"))[1])):
        lengths, docs = values_of(only(table.column("docs")))
        h, seeds = (table.column(c).to_numpy() for c in ("h", "seed"))
        ends = np.cumsum(lengths)
        begins = ends - lengths
        same = np.zeros(len(h), bool)
        same[1:] = (h[1:] == h[:-1]) & (lengths[1:] == lengths[:-1]) & (docs[begins[1:]] == docs[begins[:-1]])
        for i in np.nonzero(same & (lengths > 1))[0]:
            same[i] = np.array_equal(docs[begins[i] : ends[i]], docs[begins[i - 1] : ends[i - 1]])
        new = ~same
        place = (np.cumsum(new) - 1).astype(np.int32)
        block = {"seeds": seeds[new], "counts": lengths[new], "times": np.bincount(place).astype(float), "docs": docs[np.repeat(new, lengths)], "place": place}
        yield pa.RecordBatch.from_pydict({k: [v.tobytes()] for k, v in block.items()} | {"names": pa.array([table.column("item").to_pylist()], pa.list_(pa.string()))}).select([c.split()[0] for c in BLOCK.split(", ")])
        del table, docs, block
        give_back()


def opened(block: dict) -> tuple[np.ndarray, ...]:
    """seeds, counts, times and docs of a block."""
    kinds = ("seeds", np.uint64), ("counts", np.int64), ("times", float), ("docs", np.int32)
    return tuple(np.frombuffer(block[name], kind) for name, kind in kinds)


@dataclass
class Wide:
    groups: list
    g: np.ndarray  # group number of each record
    n_items: int
    table: DataFrame  # BLOCK
    held: list | None  # the opened blocks of small inputs

    @property
    def n_records(self) -> int:
        return len(self.g)


def gather(records: DataFrame, group: str | None = None, local_cells: int = LOCAL_CELLS) -> Wide:
    """Columns of a table with ``items`` (arrays of distinct items) and, optionally, a column of groups; it is read once."""
    spark = records.sparkSession
    for name, value in BATCH.items():
        spark.conf.set(f"spark.sql.execution.arrow.{name}", value)
    named = records.select((F.col(group).cast("string") if group else F.lit("all")).alias("group"), "items")
    index = named.mapInArrow(invert, "item string, part long, docs binary, groups array<string>").persist()
    heads = sorted(index.filter("item is null").select("part", "docs", "groups").collect(), key=lambda r: r["part"])
    groups = sorted({x for r in heads for x in r["groups"]})
    codes = [np.searchsorted(groups, r["groups"])[np.frombuffer(r["docs"], np.int32)] for r in heads]
    g = np.concatenate(codes) if codes else np.zeros(0, np.int64)
    start = {r["part"]: int(at) for r, at in zip(heads, np.cumsum([0, *map(len, codes)]))}
    tasks = spark.sparkContext.defaultParallelism
    rows = index.filter("item is not null").select("item", "part", "docs").repartition(tasks, "item").sortWithinPartitions("item", "part")
    each = rows.mapInArrow(joiner(start), "item string, docs binary").select(F.xxhash64("docs").alias("h"), "item", F.xxhash64("item").alias("seed"), "docs")
    table = each.repartition(tasks, "h").sortWithinPartitions("h", "item").mapInArrow(pack, BLOCK).persist()
    sizes = table.select(F.size("names").alias("n"), (F.length("docs") / 4).cast("long").alias("cells")).agg(F.sum("n"), F.sum("cells")).first()
    index.unpersist()
    held = None
    if (sizes[1] or 0) <= local_cells:
        held = [opened(r.asDict()) for r in table.select("seeds", "counts", "times", "docs").collect()]
    return Wide(groups, g, sizes[0] or 0, table, held)


def uniform(seeds: np.ndarray, *numbers: int) -> np.ndarray:
    """A number from 0 to 1 for each seed, the same wherever the column lies (SplitMix64)."""
    with np.errstate(over="ignore"):
        x = seeds.copy()
        for v in numbers:
            x += np.uint64(0x9E3779B97F4A7C15) * np.uint64(v + 1)
            x = (x ^ (x >> HALVES[0])) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> HALVES[1])) * np.uint64(0x94D049BB133111EB)
            x ^= x >> HALVES[2]
    return (x >> np.uint64(11)) * 2.0**-53


def gammas(x) -> tuple[np.ndarray, np.ndarray]:
    """Log gamma and digamma, by a shift of 8 and the asymptotic series."""
    product, slope, y = 1.0, 0.0, np.asarray(x, float)
    for _ in range(8):
        slope, product, y = slope * y + product, product * y, y + 1
    f, logs = 1 / (y * y), np.log(y)
    high = (y - 0.5) * logs - y + 0.9189385332046727 + (1 / 12 - f * (1 / 360 - f * (1 / 1260 - f * (1 / 1680 - f / 1188)))) / y
    psi = logs - 0.5 / y - f * (1 / 12 - f * (1 / 120 - f * (1 / 252 - f * (1 / 240 - f / 132))))
    return high - np.log(product), psi - slope / product


@dataclass
class Start:
    """Thetas about the items' means: of rare items, starts with no regard to them would put all records in one class."""

    seed: int
    run: int

    def __call__(self, k, found, means, seeds):
        theta = np.clip(means * (0.5 + uniform(seeds, self.seed, self.run, k)), 0.01, 0.99)
        no = np.log1p(-theta)
        return np.log(theta) - no, no, np.zeros_like(no)


@dataclass
class Betas:
    """The step of a Dirichlet process: expected logs, and minus the divergence from the prior."""

    a0: float
    b0: float
    pooled: np.ndarray

    def ends(self, k, found):
        return np.maximum(self.a0 + found, hdp.LAST), np.maximum(self.b0 + self.pooled[k] - found, hdp.LAST)

    def __call__(self, k, found, means, seeds):
        a, b = self.ends(k, found)
        (la, pa), (lb, pb) = gammas(a), gammas(b)
        ls, ps = gammas(self.a0 + self.b0 + self.pooled[k])
        yes, no = pa - ps, pb - ps
        prior = float(special.log_beta(self.a0, self.b0))
        return yes - no, no, la + lb - ls - prior + (self.a0 - a) * yes + (self.b0 - b) * no

    def theta(self, k, found):
        a, b = self.ends(k, found)
        return a / (a + b)


@dataclass
class Likeliest:
    """The step of a mixture by expectation-maximisation."""

    a: float
    b: float
    by_class: np.ndarray

    def __call__(self, k, found, means, seeds):
        whole = np.maximum(self.by_class[k], np.finfo(float).eps)
        theta = np.clip((found + self.a - 1) / (whole + self.a + self.b - 2), mixture.TINY, 1 - mixture.TINY)
        no = np.log1p(-theta)
        return np.log(theta) - no, no, np.zeros_like(no)


Asked = tuple[np.ndarray, Start | Betas | Likeliest]  # log_pi (groups x K), rule


@dataclass
class Seen:
    by_group: np.ndarray  # groups x K
    total: float  # sum of log normalisers
    bound: float  # what the rule adds to the bound
    before: np.ndarray | None  # the responsibilities that the step was taken with


def counts_of(r: np.ndarray, docs: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The sum of a class's responsibilities over each column's records."""
    return np.add.reduceat(r[docs], np.cumsum(counts) - counts)


def shares(block, asked: list[Asked], before: list, z: np.ndarray) -> np.ndarray:
    """Adds a block's columns' part to log weights (all runs' classes x records); returns each run's bound.

    A class that no record is in has equal parameters for all columns, which are taken once.
    """
    seeds, counts, times, docs = block
    n = z.shape[1]
    docs, means, sizes = docs.astype(np.intp), counts / n, None
    bounds, at = np.zeros(len(asked)), 0
    for i, ((log_pi, rule), r) in enumerate(zip(asked, before)):
        for k in range(log_pi.shape[1]):
            if r is not None and not r[k].any():
                odds, base, bound = (v[0] for v in rule(k, np.zeros(1), means[:1], seeds[:1]))
                sizes = np.bincount(docs, np.repeat(times, counts), n) if sizes is None else sizes
                z[at] += odds * sizes
                z[at] += base * times.sum()
                bounds[i] += bound * times.sum()
            else:
                odds, base, bound = rule(k, None if r is None else counts_of(r[k], docs, counts), means, seeds)
                z[at] += np.bincount(docs, np.repeat(odds * times, counts), n)
                z[at] += base @ times
                bounds[i] += bound @ times
            at += 1
    return bounds


def shared_out(z: np.ndarray, g: np.ndarray, asked: list[Asked]) -> tuple[np.ndarray, np.ndarray]:
    """Responsibilities; and for each run by_group and total, one after another."""
    r, out, at = np.empty_like(z), [], 0
    for log_pi, _ in asked:
        part = slice(at, at := at + log_pi.shape[1])
        mine = z[part] + log_pi.T[:, g]
        norm = special.log_sum_exp(mine, 0)
        r[part] = np.exp(mine - norm)
        out += [np.stack([np.bincount(g, c, len(log_pi)) for c in r[part]], axis=1).ravel(), [norm.sum()]]
    return r, np.concatenate(out)


def one_pass(p: Wide, asked: list[Asked], before: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Responsibilities, sums and bounds."""
    n, width = p.n_records, sum(m[0].shape[1] for m in asked)
    if p.held is not None:

        def part(block):
            z = np.zeros((width, n))
            return z, shares(block, asked, before, z)

        z, bounds = np.zeros((width, n)), np.zeros(len(asked))
        with ThreadPoolExecutor(4) as pool:
            for mine, more in pool.map(part, p.held):
                z += mine
                bounds += more
        return *shared_out(z, p.g, asked), bounds
    sc = p.table.sparkSession.sparkContext
    gc.collect()
    sc._jvm.System.gc()  # Spark deletes the shuffle files of earlier passes only when their plans are collected
    sent = sc.broadcast((asked, before, p.g))

    def run(batches):
        import pyarrow as pa

        asked, before, _ = sent.value
        z, bounds = np.zeros((width, n)), np.zeros(len(asked))
        for batch in batches:
            for at in range(len(batch)):
                bounds += shares(opened(batch.slice(at, 1).to_pylist()[0]), asked, before, z)
        yield pa.RecordBatch.from_pydict({"at": pa.array([-1], pa.int32()), "v": [bounds.tobytes()]})
        for at in range(0, n, RANGE):
            yield pa.RecordBatch.from_pydict({"at": pa.array([at], pa.int32()), "v": [z[:, at : at + RANGE].tobytes()]})

    def added(table):
        import pyarrow as pa

        at, v = table.column("at")[0].as_py(), 0
        for x in sorted(table.column("v").to_pylist()):  # in an order that does not depend on the tasks
            v = v + np.frombuffer(x)
        sums = np.zeros(0)
        if at >= 0:
            asked, _, g = sent.value
            mine = g[at : at + RANGE]
            v, sums = shared_out(v.reshape(-1, len(mine)), mine, asked)
        return pa.table({"at": pa.array([at], pa.int32()), "v": [v.tobytes()], "sums": [sums.tobytes()]})

    rows = p.table.select("seeds", "counts", "times", "docs").mapInArrow(run, "at int, v binary")
    found = sorted(rows.groupBy("at").applyInArrow(added, "at int, v binary, sums binary").collect(), key=lambda r: r["at"])
    sent.destroy()
    r = np.empty((width, n))
    for row in found[1:]:
        part = r[:, row["at"] : row["at"] + RANGE]
        part[:] = np.frombuffer(row["v"]).reshape(part.shape)
    return r, sum(np.frombuffer(row["sums"]) for row in found[1:]), np.frombuffer(found[0]["v"])


def together(p: Wide, runs: Iterable[Generator[Asked, Seen, object]]) -> list:
    """The results of runs that yield what to ask and are sent what was seen; a pass serves all that go on."""
    runs = list(runs)
    out: list = [None] * len(runs)
    asked = {i: next(r) for i, r in enumerate(runs)}
    held: dict = dict.fromkeys(asked)
    while asked:
        r, sums, bounds = one_pass(p, list(asked.values()), [held[i] for i in asked])
        row = at = 0
        for place, (i, (log_pi, _)) in enumerate(list(asked.items())):
            j, k = log_pi.shape
            seen = Seen(sums[at : at + j * k].reshape(j, k), float(sums[at + j * k]), float(bounds[place]), held[i])
            held[i] = r[row : row + k].copy()
            row, at = row + k, at + j * k + 1
            try:
                asked[i] = runs[i].send(seen)
            except StopIteration as end:
                out[i] = end.value
                del asked[i], held[i]
    return out


@dataclass
class WideHdp:
    beta_mean: np.ndarray
    pi_mean: np.ndarray  # groups x K
    elbo: float
    n_iter: int
    converged: bool
    order: np.ndarray  # of the classes as fitted
    rule: Betas
    before: np.ndarray


def run_cavi(groups: int, k: int, alpha: float, gamma: float, a0: float, b0: float, max_iter: int, tol: float, seed: int, run: int):
    """As ``hdp.run_cavi``."""
    log_pi = np.log(np.random.default_rng([seed, run]).dirichlet(np.full(k, 10.0), size=groups))
    e = yield log_pi, Start(seed, run)
    last, calm, converged, step = -np.inf, 0, False, 0
    for step in range(1, max_iter + 1):
        pooled = e.by_group.sum(0)
        rule = Betas(a0, b0, pooled)
        ga, gb = 1 + pooled, gamma + hdp.tails(pooled)
        gb[-1] = hdp.LAST
        beta_mean = hdp.stick_means(ga, gb)
        mine = np.maximum(alpha * beta_mean, hdp.LAST), np.maximum(alpha * hdp.tails(beta_mean), hdp.LAST)
        pa = np.maximum(alpha * beta_mean + e.by_group, hdp.LAST)
        pb = np.maximum(alpha * hdp.tails(beta_mean) + hdp.tails(e.by_group), hdp.LAST)
        e = yield hdp.stick_logs(pa, pb), rule
        sticks = float(hdp.neg_kl_beta(ga[:-1], gb[:-1], 1.0, gamma).sum()) + float(hdp.neg_kl_beta(pa[:, :-1], pb[:, :-1], mine[0][:-1], mine[1][:-1]).sum())
        bound = e.total + e.bound + sticks
        calm = calm + 1 if abs(bound - last) < tol * (1 + abs(last)) else 0
        last = bound
        if calm >= hdp.PATIENCE:
            converged = True
            break
    order = np.argsort(-beta_mean, kind="stable")
    return WideHdp(beta_mean[order], hdp.stick_means(pa, pb)[:, order], last, step, converged, order, rule, e.before)


def fit_hdp(p: Wide, k_max: int = 20, alpha: float = 1.0, gamma: float = 1.0, alpha_prior: float = 1.0, beta_prior: float = 1.0, max_iter: int = 300, tol: float = 1e-5, n_init: int = 3, seed: int = 0) -> WideHdp:
    """``hdp.fit`` under flat priors."""
    if not p.n_records:
        raise ValueError("no records")
    runs = together(p, (run_cavi(len(p.groups), k_max, alpha, gamma, alpha_prior, beta_prior, max_iter, tol, seed, i) for i in range(n_init)))
    finite = [r for r in runs if np.isfinite(r.elbo)]
    if not finite:
        raise ArithmeticError("no run has a finite bound")
    return max(finite, key=lambda r: r.elbo)


def weights(p: Wide, m: WideHdp) -> DataFrame:
    """cluster, beta_weight, group, pi: the table that ``hdp.categories`` reads."""
    rows = [(k + 1, float(m.beta_mean[k]), str(g), float(m.pi_mean[j, k])) for k in range(len(m.beta_mean)) for j, g in enumerate(p.groups)]
    return p.table.sparkSession.createDataFrame(rows, "cluster long, beta_weight double, `group` string, pi double")


def profiles(p: Wide, m: WideHdp) -> DataFrame:
    """cluster, beta_weight, item, theta: a row for each component and item, made where the items are."""
    sent = p.table.sparkSession.sparkContext.broadcast((m.before, m.rule, m.order, np.round(m.beta_mean, 4)))

    def run(batches):
        import pyarrow as pa

        before, rule, order, beta = sent.value
        for batch in batches:
            for i in range(len(batch)):
                block = {c: batch.column(c)[i].as_py() for c in ("seeds", "counts", "times", "docs", "place")}
                _, counts, _, docs = opened(block)
                names, place = batch.column("names")[i].values, np.frombuffer(block["place"], np.int32)
                for at, k in enumerate(order):
                    theta = np.round(rule.theta(k, counts_of(before[k], docs, counts)), 4)[place]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(place), at + 1)), pa.array(np.full(len(place), beta[at])), names, pa.array(theta)], ["cluster", "beta_weight", "item", "theta"])

    return p.table.mapInArrow(run, "cluster long, beta_weight double, item string, theta double")


def single_run(p: Wide, k: int, a: float, b: float, dirichlet: float, max_iter: int, tol: float, seed: int, run: int):
    """As ``mixture.single_run``; returns the numbers of classes, log likelihood and BIC."""
    e = yield np.log(np.full((1, k), 1 / k)), Start(seed, run)
    for _ in range(max_iter):
        last, by_class = e.total, e.by_group.sum(0)
        pi = np.maximum(by_class + dirichlet - 1, np.finfo(float).eps)
        e = yield np.log(pi / pi.sum())[None, :], Likeliest(a, b, by_class)
        if abs(e.total - last) < tol:
            break
    return k, e.total, mixture.bic(e.total, k, p.n_items, p.n_records)


def select_k(p: Wide, ks, alpha_prior: float = 1.0, beta_prior: float = 1.0, dirichlet_prior: float = 1.0, max_iter: int = 200, tol: float = 1e-6, n_init: int = 5, seed: int = 0) -> pd.DataFrame:
    """k and bic of the best of ``n_init`` runs, the best first; flat priors."""
    ks = [k for k in dict.fromkeys(ks) if 1 <= k <= max(1, p.n_records - 1)]
    if not ks or not p.n_records:
        raise ValueError("no number of classes to try")
    runs = together(p, (single_run(p, k, alpha_prior, beta_prior, dirichlet_prior, max_iter, tol, seed, i) for k in ks for i in range(n_init)))
    best = {k: max((r for r in runs if r[0] == k), key=lambda r: r[1]) for k in ks}
    return pd.DataFrame({"k": ks, "bic": [best[k][2] for k in ks]}).sort_values(["bic", "k"], ignore_index=True)
