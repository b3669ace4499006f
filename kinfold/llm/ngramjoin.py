"""N-gram Jaccard join by prefix trees, and the classes of documents it links.

1. Equal sets meet first: a set's digest is its class, so copies cost one row each.
2. A global order tells n-grams that a count sketch over all documents shows to be
   frequent from others, which differ by hash. Two sets that reach the threshold share an
   n-gram among the first ``n - ceil(threshold * n) + 1`` of each, rare ones first, and ``k``
   of them among the first ``k - 1`` more. These prefixes meet by n-gram; runs of sizes too
   far apart to link are told apart, and n-grams that no two sets share there are gone, as
   are sets with fewer than ``k`` left, ``k`` being a tenth of the smallest size that may link.
   Counts by n-gram and class of size do this, so a frequent n-gram is summed up before it
   is shuffled, and no task gets all rows of one. Maps of at most 2**26 bits tell tasks which
   n-grams and texts need not be sent on; beyond what they can hold, more is sent than needed.
3. Each remaining run gathers at its smallest class. There the whole sets form a prefix
   tree in the global order, frequent n-grams first, so that near copies share long paths.
   The tree is walked once, with the overlaps of all sets so far at every node; a subtree is
   left when none of them can reach the threshold in what is left of it.
4. A group above ``group_rows`` sets or ``group_grams`` n-grams is cut into blocks, each with
   the group's smallest class. Sets that a block links to it are one component; only those
   left over are compared with the other blocks. A group of near copies so costs in
   proportion to its size. ``jaccard_links`` wants all pairs and compares all blocks.
5. Links become classes by large-star and small-star steps.

No pair is dropped for size: the prefix rule, the length rule and the tree's bound only
skip pairs that cannot link. n-grams and sets are told by hashes of 64 and 128 bits.

Defined results: null, empty and blank texts have an empty set, link with nothing and are
their own class; fewer words than n make one n-gram; repeated rows are one class; a null
id counts as larger than any; an empty table gives no rows; other columns are ignored, and
kept by ``keep_first``, where of a class the row with the smallest id stays, of rows with
that id the first in the files, and every row without words.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinfold.llm.common import ROW, bounded_batches, discard, hash_map, in_map, materialize, release, texts, tidy, with_rows

SKETCH_BITS = 20
SKETCH_ROWS = 256
SKETCH_SALTS = 8
MAP_BITS = 26
BROADCAST_PLACES = 500_000  # of about 40 bytes each; with more, sets and places meet by shuffle
GROUP_ROWS = 250
REST_TIMES = 4
GROUP_GRAMS = 500_000
SLACK = 10  # longer prefixes by a tenth of the set
FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_WORDS: dict[bytes, int] = {}
MEMO = 100_000


def word_hashes(words: list[bytes]) -> np.ndarray:
    try:
        return np.fromiter(map(_WORDS.__getitem__, words), dtype=np.uint64, count=len(words))
    except KeyError:
        if len(_WORDS) > MEMO:
            _WORDS.clear()
        for w in words:
            if w not in _WORDS:
                _WORDS[w] = xxhash.xxh64_intdigest(w)
        return np.fromiter(map(_WORDS.__getitem__, words), dtype=np.uint64, count=len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def ngrams(text: str, n: int) -> np.ndarray:
    """Ascending distinct hashes of the n-word shingles of ``text``."""
    words = text.encode("utf-8", "surrogatepass").translate(FOLD).split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    one = word_hashes(words)
    n = min(n, len(one))
    out = np.full(len(one) - n + 1, n, dtype=np.uint64)
    for k in range(n):
        out = mixed(out + one[k : len(one) - n + 1 + k])
    return np.unique(out)


def digest(grams: np.ndarray) -> bytes:
    """The class of a set."""
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest()


def _sketch(n: int):
    def run(batches):
        seen = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
        for batch in batches:
            for text in batch.column("text").to_pylist():
                np.add.at(seen, ngrams(text, n) >> np.uint64(64 - SKETCH_BITS), 1)
        _WORDS.clear()  # workers live on, and later stages need the memory
        tidy()
        rows = seen.reshape(SKETCH_ROWS, -1)
        salt = TaskContext.get().partitionId() % SKETCH_SALTS
        columns = [pa.array(range(SKETCH_ROWS), pa.int32()), pa.array([salt] * SKETCH_ROWS, pa.int32()), pa.array([r.tobytes() for r in rows], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["part", "salt", "counts"])

    return run


def _add(table: pa.Table) -> pa.Table:
    total = np.zeros((1 << SKETCH_BITS) // SKETCH_ROWS, dtype=np.int64)
    for b in table.column("counts"):
        total += np.frombuffer(b.as_buffer(), dtype=np.int64)
    first = {c: [table.column(c)[0].as_py()] for c in ("part", "salt")}
    return pa.table({"part": pa.array(first["part"], pa.int32()), "salt": pa.array(first["salt"], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})


def frequency_levels(rows: DataFrame, n: int) -> np.ndarray:
    """For each of 2**20 ranges of hashes, how far beyond the mean its n-grams are counted, in powers of two.

    Added up in two steps, so that no task gets a table from each task of the corpus.
    """
    kind = "part int, salt int, counts binary"
    some = rows.select("text").mapInArrow(_sketch(n), kind).groupBy("part", "salt").applyInArrow(_add, kind)
    found = {r.part: np.frombuffer(r.counts, dtype=np.int64) for r in some.groupBy("part").applyInArrow(_add, kind).collect()}
    if not found:
        return np.zeros(1 << SKETCH_BITS, dtype=np.uint8)
    counts = np.concatenate([found[k] for k in range(SKETCH_ROWS)])
    return np.floor(np.log2(np.maximum(1.0, counts / (2 * counts.mean() + 8)))).astype(np.uint8)


def core(size: int, percent: int) -> int:
    """Length of the prefix in which linked sets share an n-gram."""
    return size - (percent * size + 99) // 100 + 1


def _prefixes(n: int, percent: int, levels: np.ndarray):
    kinds = [pa.int64(), pa.binary(), pa.list_(pa.int64())]
    own = ["doc_id", *ROW]

    def run(batches):
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                grams = ngrams(text, n)
                size = len(grams)
                if not size:
                    rows.append((0, None, []))
                    continue
                level = levels[grams >> np.uint64(64 - SKETCH_BITS)]
                first = grams[np.argsort(level, kind="stable")[: core(size, percent) + size // SLACK]]
                rows.append((size, digest(grams), first.view(np.int64)))
            columns = list(zip(*rows)) or [()] * 3
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), *(pa.array(c, t) for c, t in zip(columns, kinds))], [*own, "n_shingles", "class", "prefix"])
        _WORDS.clear()
        tidy()

    return run


def _sets(n: int, bits: np.ndarray):
    """(row, grams): the sets of the rows that may be wanted."""

    def run(batches):
        for batch in batches:
            some = in_map(bits, batch.column("h").to_numpy(zero_copy_only=False))
            batch = batch.filter(pa.array(some, pa.bool_()))
            grams = [ngrams(t, n).view(np.int64) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ROW), pa.array(grams, pa.list_(pa.int64()))], [*ROW, "grams"])
        _WORDS.clear()
        tidy()

    return run


def _live_only(bits: np.ndarray):
    """The prefixes without n-grams that no other set has there; ``at`` keeps their places."""

    def run(batches):
        for batch in batches:
            cut, at = [], []
            for prefix in batch.column("prefix"):
                values = prefix.values.to_numpy(zero_copy_only=False) if prefix.values is not None else np.empty(0, dtype=np.int64)
                here = np.flatnonzero(in_map(bits, values))
                cut.append(values[here])
                at.append(here.astype(np.int32))
            own = [c for c in batch.schema.names if c != "prefix"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), pa.array(cut, pa.list_(pa.int64())), pa.array(at, pa.list_(pa.int32()))], [*own, "prefix", "at"])
        tidy()

    return run


def ranked(sets: list[np.ndarray], levels: np.ndarray) -> tuple[np.ndarray, int]:
    """All n-grams of ``sets`` as places in the global order, frequent first, and how many places there are.

    Numbers of 32 bits, and no copy is kept longer than needed: this is the peak of a group's memory.
    """
    flat = np.concatenate(sets).view(np.uint64)
    by_value = np.argsort(flat)
    flat = flat[by_value]
    new = np.ones(len(flat), dtype=bool)
    new[1:] = flat[1:] != flat[:-1]
    number = np.cumsum(new, dtype=np.int32)
    number -= 1
    level = levels[flat[new] >> np.uint64(64 - SKETCH_BITS)].astype(np.int16)
    del flat
    rank = np.empty(len(level), dtype=np.int32)
    rank[np.argsort(-level, kind="stable")] = np.arange(len(level), dtype=np.int32)
    out = np.empty(len(number), dtype=np.int32)
    out[by_value] = rank[number]
    return out, len(level)


class PrefixTree:
    """Sets as paths in one order; neighbours in sorted order share the path up to ``shared``."""

    def __init__(self, sets: list[np.ndarray], levels: np.ndarray):
        self.sizes = np.array([len(s) for s in sets])
        ranks, width = ranked(sets, levels)
        paths = np.split(ranks, np.cumsum(self.sizes)[:-1])
        for path in paths:
            path.sort()
        self.order = sorted(range(len(paths)), key=lambda i: paths[i].astype(">u4").tobytes())
        self.paths = [paths[i] for i in self.order]
        self.sizes = self.sizes[self.order]
        self.shared = [0] * (len(paths) + 1)
        for k in range(1, len(paths)):
            a, b = self.paths[k - 1], self.paths[k]
            m = min(len(a), len(b))
            differ = np.flatnonzero(a[:m] != b[:m])
            self.shared[k] = int(differ[0]) if len(differ) else m
        # For each n-gram the sets that have it.
        flat = np.concatenate(self.paths)
        by_rank = np.argsort(flat, kind="stable")
        self.owners = np.repeat(np.arange(len(paths), dtype=np.int32), self.sizes)[by_rank]
        self.heads = np.concatenate([[0], np.cumsum(np.bincount(flat, minlength=width))])

    def overlaps(self, grams: np.ndarray) -> np.ndarray:
        """How many of ``grams`` each set has."""
        begin = self.heads[grams]
        many = self.heads[grams + 1] - begin
        at = np.repeat(begin - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        return np.bincount(self.owners[at], minlength=len(self.paths))

    def links(self, percent: int):
        """Yields each set with those linked to it, by their numbers in ``order``.

        At a node the overlaps of its path with all sets are known, from the node above and the
        owners of the n-grams between; what the next path shares is kept. A set whose path has
        too little left for any other is left there, and so are all below the same node.
        """
        m = len(self.paths)
        stack = [(0, np.zeros(m, dtype=np.int64))]
        for x, path in enumerate(self.paths):
            while stack[-1][0] > self.shared[x]:
                stack.pop()
            depth, have = stack[-1]
            need = -(-percent * (self.sizes + len(path)) // (100 + percent))
            stays, step = self.shared[x + 1], 16
            while True:
                may = have + np.minimum(len(path) - depth, self.sizes - have) >= need
                may[x] = False
                if depth == len(path) or not may.any():
                    break
                to = min(len(path), depth + step)
                if depth < stays < to:
                    to = stays
                have = have + self.overlaps(path[depth:to])
                depth, step = to, 2 * step
                if depth <= stays:
                    stack.append((depth, have))
            if depth == len(path) and may.any():
                yield x, np.flatnonzero(may)


LINKS = "a binary, b binary, hub long, rest boolean"


def _join_group(percent: int, levels: np.ndarray, every: bool = False):
    """Links of a group: all of them with ``every``, else those that join its components.

    Without ``every`` also a row with ``rest`` for each class that is not in the component of the
    group's smallest, for groups of several blocks.
    """
    kinds = [("a", pa.binary()), ("b", pa.binary()), ("hub", pa.int64()), ("rest", pa.bool_())]

    def run(table: pa.Table) -> pa.Table:
        seen: dict[bytes, np.ndarray] = {}
        for batch in table.select(["class", "grams"]).to_batches():
            grams = batch.column("grams")
            values, ends = grams.values.to_numpy(zero_copy_only=False), grams.offsets.to_numpy()
            for k, c in enumerate(batch.column("class").to_pylist()):
                if c not in seen:
                    seen[c] = values[ends[k] : ends[k + 1]]
        classes = sorted(seen)
        tree = PrefixTree([seen[c] for c in classes], levels) if len(classes) > 1 else None
        names = [classes[i] for i in tree.order] if tree else classes
        hub = table.column("hub")[0].as_py()
        rows: list[tuple] = []
        if every:
            for x, linked in tree.links(percent) if tree else ():
                rows += [(min(names[x], names[y]), max(names[x], names[y]), hub, False) for y in linked[linked < x].tolist()]
        else:
            root = np.arange(len(names))
            for x, linked in tree.links(percent) if tree else ():
                met = np.unique(np.append(root[linked], root[x]))
                if len(met) > 1:
                    root[np.isin(root, met)] = met[0]
            rows += [(names[r], names[i], hub, False) for i, r in enumerate(root.tolist()) if i != r]
            if table.column("whole")[0].as_py() is False:
                centre = [i for i, c in enumerate(names) if short_of(c) == hub]
                inside = np.isin(root, root[centre])
                rows += [(names[i], names[i], hub, True) for i in np.flatnonzero(~inside).tolist()]
        return pa.table({name: pa.array([r[k] for r in rows], kind) for k, (name, kind) in enumerate(kinds)})

    return run


def components(links: DataFrame, tag: str = "stars") -> DataFrame:
    """(node, root): each linked node and the smallest node of its component.

    Alternating large-star and small-star steps; every step is written to the shared
    folder, and a node's neighbours are only ever reduced to their minimum.
    """
    edges = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()
    edges = materialize(edges, tag)
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("m").alias("a"), F.col("v").alias("b"))
        large = large.unionAll(low.select(F.col("m").alias("a"), F.col("u").alias("b"))).filter("a <> b").distinct()
        down = large.select(F.col("b").alias("u"), F.col("a").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("k"))
        small = down.join(least, "u").filter("v <> m").select(F.col("m").alias("a"), F.col("v").alias("b"))
        after = small.unionAll(least.select(F.col("m").alias("a"), F.col("u").alias("b"))).filter("a <> b")
        after = materialize(after.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), tag)
        both_ends = after.select(F.col("a").alias("x")).distinct().join(after.select(F.col("b").alias("x")).distinct(), "x", "left_semi")
        twice = after.groupBy("b").count().filter("count > 1")
        discard(edges)
        edges = after
        if both_ends.isEmpty() and twice.isEmpty():
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))


def short(name: str):
    """60 bits of a class, to gather by; classes that share them only meet needlessly."""
    return F.conv(F.substring(F.hex(name), 1, 15), 16, 10).cast("long")


def short_of(name: bytes) -> int:
    return int(name.hex()[:15], 16)


def map_of(hashes: DataFrame) -> np.ndarray:
    """A map of eight bits or more for each hash, up to ``MAP_BITS``."""
    rows = hashes.count()
    return hash_map(hashes, min(MAP_BITS, max(16, (8 * rows).bit_length())), rows)


def _combined(batches):
    """(gram, band, least, most): for each n-gram and band of a batch the smallest and largest class."""
    names = ["gram", "band", "least", "most"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64()]
    for batch in batches:
        grams = batch.column("prefix")
        many = grams.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        gram = grams.flatten().to_numpy(zero_copy_only=False)
        band, cid = (np.repeat(batch.column(c).to_numpy(zero_copy_only=False), many) for c in ("band", "cid"))
        order = np.lexsort((cid, band, gram))
        gram, band, cid = gram[order], band[order], cid[order]
        new = np.ones(len(gram), dtype=bool)
        new[1:] = (gram[1:] != gram[:-1]) | (band[1:] != band[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(gram)) - 1 if len(first) else first
        columns = (gram[first], band[first], cid[first], cid[last])
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)
    tidy()


def runs(sets: DataFrame) -> DataFrame:
    """gram, band, hub: for each n-gram and class of sizes that several classes have within reach, their smallest class.

    Sizes that may link are in the same or neighbouring bands. Tasks send a frequent n-gram
    once a batch, and an n-gram has few bands, so neither it nor the window over them is large.
    """
    sent = sets.select("cid", "band", "prefix").mapInArrow(_combined, "gram long, band int, least long, most long").repartition("gram")
    counted = sent.groupBy("gram", "band").agg(F.min("least").alias("least"), F.max("most").alias("most"))
    by_band = W.partitionBy("gram").orderBy("band")
    again = F.coalesce(F.lag("band").over(by_band) < F.col("band") - 1, F.lit(True)).cast("int")
    near = by_band.rangeBetween(-1, 1)
    numbered = counted.withColumns({"again": again, "several": F.min("least").over(near) < F.max("most").over(near)})
    numbered = numbered.withColumn("run", F.sum("again").over(by_band.rowsBetween(W.unboundedPreceding, 0)))
    run = W.partitionBy("gram", "run")
    return numbered.select("gram", "band", F.min("least").over(run).alias("hub"), "several").filter("several").select("gram", "band", "hub")


def group_members(heads: DataFrame, percent: int) -> DataFrame:
    """(hub, cid, size): the groups in which each class's set must be compared. Copies in ``heads`` add nothing."""
    spark = heads.sparkSession
    head = F.expr(f"n_shingles - ({percent} * n_shingles + 99) div 100 + 1")
    # A band is as wide as a link's sizes may be apart, so links are within a band or between neighbours.
    width = max(1e-6, math.log(100 / percent) * (1 + 1e-9))
    band = F.floor(F.log(F.col("n_shingles").cast("double")) / F.lit(width)).cast("int")
    slim = heads.select(short("class").alias("cid"), F.col("n_shingles").cast("int").alias("size"), band.alias("band"), head.cast("int").alias("head"), "prefix")
    found = materialize(runs(slim).select("gram", "band"), "livegrams")
    release(spark)
    left = slim.mapInArrow(_live_only(map_of(found.select("gram"))), "cid long, size int, band int, head int, prefix array<long>, at array<int>")
    grams = left.select("cid", "size", "band", "head", F.explode(F.arrays_zip("prefix", "at")).alias("g"))
    grams = grams.select(F.col("g.prefix").alias("gram"), "cid", "size", "band", (F.col("g.at") < F.col("head")).alias("core"))
    kept = grams.join(found, ["gram", "band"]).groupBy("cid", "size", "band").agg(F.collect_set(F.struct("gram", "core")).alias("grams"))
    least = F.expr(f"1 + ({percent} * size + 99) div 100 div {SLACK}")
    kept = kept.filter(F.size("grams") >= least).select("cid", "size", "band", F.expr("transform(filter(grams, g -> g.core), g -> g.gram)").alias("prefix"))
    live = materialize(kept, "shared")
    discard(found)
    hubs = runs(live)
    each = live.select("cid", "size", "band", F.explode("prefix").alias("gram"))
    members = materialize(each.join(hubs, ["gram", "band"]).select("hub", "cid", "size").distinct(), "members")
    discard(live)
    return members


def blocks_of(members: DataFrame, group_rows: int, group_grams: int) -> DataFrame:
    """hub, blocks: into how many blocks a group is cut."""
    blocks = F.greatest(F.ceil(F.count("*") / group_rows), F.ceil(F.sum("size") / group_grams)).cast("int")
    return members.groupBy("hub").agg(blocks.alias("blocks"))


def dealt(members: DataFrame, blocks: DataFrame) -> DataFrame:
    """``members`` with ``own``, their block. ``blocks`` has the groups of several: few, so that Spark need not move the members."""
    few = materialize(blocks.filter("blocks > 1"), "blocks", 4)
    joined = members.join(few, "hub", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    return joined.withColumn("own", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))


def stars(members: DataFrame, group_rows: int, group_grams: int) -> DataFrame:
    """cid, hub, i, j, whole: each block of a group with the group's smallest class."""
    rows = dealt(members, blocks_of(members, group_rows, group_grams))
    whole = (F.col("blocks") == 1).alias("whole")
    blocks = rows.select("cid", "hub", F.col("own").alias("i"), F.lit(0).alias("j"), whole)
    centre = rows.filter("cid = hub and blocks > 1").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).filter("i <> own")
    return blocks.unionAll(centre.select("cid", "hub", "i", F.lit(0).alias("j"), whole))


def block_pairs(members: DataFrame, group_rows: int, group_grams: int) -> DataFrame:
    """cid, hub, i, j, whole: every two blocks of a group."""
    rows = dealt(members, blocks_of(members, group_rows, group_grams))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.select("cid", "hub", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.lit(True).alias("whole"))


def rest_pairs(members: DataFrame, rest: DataFrame, rest_rows: int, group_grams: int) -> DataFrame:
    """cid, hub, i, j, whole: the blocks of a group's left-over classes, each with every block of the group."""
    left = members.join(rest, ["hub", "cid"], "left_semi")
    here = materialize(members.join(rest.select("hub").distinct(), "hub", "left_semi"), "rest")
    few, all_of = (materialize(blocks_of(df, rest_rows, group_grams), "blocks", 4) for df in (left, here))
    others = lambda df: df.select("hub", F.col("blocks").alias("others"))
    own = dealt(left, few).join(others(all_of), "hub").withColumn("j", F.explode(F.sequence(F.lit(0), F.col("others") - 1)))
    other = dealt(here, all_of).join(others(few), "hub").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("others") - 1)))
    names = ["cid", "hub", "i", "j"]
    both = own.withColumn("i", F.col("own")).select(*names).unionAll(other.withColumn("j", F.col("own")).select(*names))
    return both.distinct().withColumn("whole", F.lit(True))


def joined(rows: DataFrame, one: DataFrame, places: DataFrame, n: int, percent: int, levels: np.ndarray, every: bool) -> DataFrame:
    """What ``_join_group`` finds when the sets of the classes gather at their places."""
    lists = places.groupBy("cid").agg(F.collect_list(F.struct("hub", "i", "j", "whole")).alias("places"))
    wanted = one.withColumn("cid", short("class")).join(lists, "cid").select(*(F.col(f"first.{c}").alias(c) for c in ROW), "class", "places")
    wanted = materialize(wanted, "wanted")
    h = F.xxhash64(*ROW).alias("h")
    # Tasks know from a map of the wanted rows which texts need not be sent; the join drops what it lets through.
    bits = map_of(wanted.select(h))
    sets = rows.select("text", *ROW, h).mapInArrow(_sets(n, bits), ", ".join(f"{c} long" for c in ROW) + ", grams array<long>")
    few = (wanted.agg(F.sum(F.size("places"))).first()[0] or 0) <= BROADCAST_PLACES
    sent = sets.join(F.broadcast(wanted) if few else wanted, ROW).select("class", "grams", F.explode("places").alias("p")).select("p.hub", "p.i", "p.j", "p.whole", "class", "grams")
    found = materialize(sent.groupBy("hub", "i", "j").applyInArrow(_join_group(percent, levels, every), LINKS), "links")
    discard(wanted)
    return found


def _linked(rows: DataFrame, n: int, percent: int, group_rows: int, group_grams: int, every: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Each row's doc_id, place, n_shingles and class; each class's first place; and links of classes."""
    spark = rows.sparkSession
    bounded_batches(spark)
    levels = frequency_levels(rows, n)
    place = ", ".join(f"{c} long" for c in ROW)
    heads = materialize(rows.mapInArrow(_prefixes(n, percent, levels), f"doc_id long, {place}, n_shingles long, class binary, prefix array<long>"), "prefixes")
    slim = materialize(heads.drop("prefix"), "classes")
    one = slim.filter("n_shingles > 0").groupBy("class").agg(F.min(F.struct(*ROW)).alias("first"))
    members = group_members(heads.filter("n_shingles > 0"), percent)
    discard(heads)
    release(spark)
    if every:
        found = joined(rows, one, block_pairs(members, group_rows, group_grams), n, percent, levels, True)
        discard(members)
        return slim, one, found.select("a", "b")
    found = joined(rows, one, stars(members, group_rows, group_grams), n, percent, levels, False)
    release(spark)
    links = found.filter("not rest").select("a", "b")
    rest = found.filter("rest").select("hub", short("a").alias("cid")).distinct()
    if not rest.isEmpty():
        more = joined(rows, one, rest_pairs(members, rest, REST_TIMES * group_rows, group_grams), n, percent, levels, False)
        links = links.unionAll(more.select("a", "b"))
        release(spark)
    discard(members)
    return slim, one, links


def _named(slim: DataFrame, links: DataFrame) -> DataFrame:
    """class, root: the component of each class."""
    classes = slim.filter("n_shingles > 0").select("class").distinct()
    roots = components(links)
    return classes.join(roots, classes["class"] == roots["node"], "left").select("class", F.coalesce("root", "class").alias("root"))


def jaccard_classes(docs: DataFrame, n: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text", group_rows: int = GROUP_ROWS, group_grams: int = GROUP_GRAMS) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs``."""
    slim, _, links = _linked(with_rows(texts(docs, id_col, text_col)), n, percent, group_rows, group_grams, every=False)
    ids = slim.filter("n_shingles > 0").groupBy("class").agg(F.min("doc_id").alias("first_id"))
    named = _named(slim, links).join(ids, "class")
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    final = named.join(least, "root").select("class", "component_id")
    out = slim.join(final, "class", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_first(docs: DataFrame, n: int = 5, percent: int = 80, group_rows: int = GROUP_ROWS, group_grams: int = GROUP_GRAMS) -> DataFrame:
    """The rows of ``docs``, all columns as they are, without those that an earlier row of their class stands for."""
    keyed = with_rows(docs)
    slim, _, links = _linked(texts(keyed, keep=ROW), n, percent, group_rows, group_grams, every=False)
    rows = slim.filter("n_shingles > 0").join(_named(slim, links), "class")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", *ROW)
    kept = rows.groupBy("root").agg(F.min(order).alias("kept")).select(*(F.col(f"kept.{c}").alias(c) for c in ROW))
    gone = rows.select(*ROW).join(kept, ROW, "left_anti")
    return keyed.join(gone, ROW, "left_anti").drop(*ROW)


def jaccard_links(docs: DataFrame, n: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text", group_rows: int = GROUP_ROWS, group_grams: int = GROUP_GRAMS) -> DataFrame:
    """(a, b, a_id, b_id): every linked pair of different sets once, by class and by its smallest document.

    As many rows as there are such pairs: the square of a group's size where all are alike.
    """
    slim, _, links = _linked(with_rows(texts(docs, id_col, text_col)), n, percent, group_rows, group_grams, every=True)
    ids = slim.filter("n_shingles > 0").groupBy("class").agg(F.min("doc_id").alias("first_id"))
    first = lambda side: ids.select(F.col("class").alias(side), F.col("first_id").alias(f"{side}_id"))
    return links.distinct().join(first("a"), "a").join(first("b"), "b").select("a", "b", "a_id", "b_id")


def link_counts(docs: DataFrame, n: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text", group_rows: int = GROUP_ROWS, group_grams: int = GROUP_GRAMS) -> DataFrame:
    """doc_id, n_links for every row of ``docs``: how many other distinct sets its set is linked to."""
    slim, _, links = _linked(with_rows(texts(docs, id_col, text_col)), n, percent, group_rows, group_grams, every=True)
    links = links.distinct()
    ends = links.select(F.col("a").alias("class")).unionAll(links.select(F.col("b").alias("class")))
    counted = ends.groupBy("class").agg(F.count("*").alias("n_links"))
    return slim.join(counted, "class", "left").select("doc_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))


SQL = """
with recursive d as (
  select row_number() over () as r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as ws
  from documents),
s as (select distinct r, array_to_string(list_slice(ws, i, i + 3), ' ') as sh
  from (select r, ws, unnest(range(1, greatest(2, len(ws) - 2))) as i from d where len(ws) > 0)),
n as (select r, count(*) as n from s group by r),
pairs as (select a.r as p, b.r as q, count(*) as k from s a join s b on a.sh = b.sh and a.r <> b.r group by a.r, b.r),
links as (select p, q from pairs join n x on x.r = p join n y on y.r = q where 100 * k >= 85 * (x.n + y.n - k)),
reach(r, q) as (select r, r from d union select reach.r, links.q from reach join links on links.p = reach.q),
least_ids as (select reach.r, min(e.doc_id) as component_id from reach join d e on e.r = reach.q group by reach.r)
select doc_id, coalesce(n, 0)::bigint as n_shingles, component_id
from d left join n using (r) join least_ids using (r)
"""
