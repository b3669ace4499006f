"""Benchmark decontamination by a distributed positional inverted index.

Every training token gets a position. The index is a Parquet table of segments, each
over whole documents with about ``segment_words`` tokens: its terms, and for each term
the ascending positions it stands at (delta coded, under zstandard). Positions skip one
number between documents, so a run of consecutive positions never crosses one. Segments
are cut by documents, so building shuffles no token, and a term as frequent as a third of
all rows is cut up with its documents.

The test items are a table of windows. A window's rarest term, by its count in the whole
index, decides where it is looked for: windows and segments meet by that term, and each
segment is searched with its own windows. There the rarest term's postings are shifted by
the term's offset and intersected with the other terms' shifted postings from rare to
common (phrases), or held against the others' within ``reach`` words (proximity). Items
meet their windows by join. Nothing of the items or the hits is on the driver; of fixed
size there is a map of 2**20 bits of the terms that items have, which keeps other terms
out of the first exchange.

Defined results: null and empty texts have no words and no hits; an item without words or
without an id is never found; repeated rows are counted alike; an empty table gives no
rows; other columns are ignored, and kept by ``drop_contaminated``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm.common import ROW, bounded_batches, hash_map, in_map, materialize, texts, with_rows

WINDOW = 13
REACH = 26  # words to either side of a window's rarest term
SEGMENT_WORDS = 400_000
BLOCK_WINDOWS = 20_000  # of a segment, searched at once
MAP_BITS = 20
#: ASCII upper to lower case; every other ASCII character but digits and letters to space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
INDEX = f"segment long, doc_ids array<long>, {ROW[0]} array<long>, {ROW[1]} array<long>, n_words array<int>, terms binary, heads binary, postings binary"


def words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split()


def _squeeze(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values, dtype="<i4").tobytes())


def _spread(raw: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), dtype="<i4")


def segment(number: int, doc_ids: list, files: list, rows: list, docs: list[list[bytes]]) -> list:
    """One row of the index."""
    known: dict[bytes, int] = {}
    add = known.setdefault
    sizes = np.array([len(d) for d in docs], dtype=np.int64)
    ids = np.fromiter((add(w, len(known)) for d in docs for w in d), dtype=np.int32, count=int(sizes.sum()))
    at = np.arange(len(ids), dtype=np.int64) + np.repeat(np.arange(len(docs)), sizes)
    order = np.argsort(ids, kind="stable")
    heads = np.concatenate([[0], np.cumsum(np.bincount(ids, minlength=len(known)))])
    steps = np.diff(at[order], prepend=0)
    steps[heads[:-1]] = at[order][heads[:-1]]
    packed = zstandard.ZstdCompressor(level=1).compress(b"\n".join(known))
    return [number, doc_ids, files, rows, sizes.astype(np.int32), packed, _squeeze(np.diff(heads)), _squeeze(steps)]


def _build(batches):
    number, doc_ids, files, rows, docs, held = TaskContext.get().partitionId() << 32, [], [], [], [], 0
    lists = [(c, pa.list_(pa.int64())) for c in ("doc_ids", *ROW)]
    schema = pa.schema([("segment", pa.int64()), *lists, ("n_words", pa.list_(pa.int32())), *((c, pa.binary()) for c in ("terms", "heads", "postings"))])

    def row():
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(segment(number, doc_ids, files, rows, docs), schema)], schema=schema)

    for batch in batches:
        for doc_id, file, place, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", *ROW, "text"))):
            found = words(text)
            doc_ids.append(doc_id)
            files.append(file)
            rows.append(place)
            docs.append(found)
            held += len(found) + 1
            if held >= SEGMENT_WORDS:
                yield row()
                number, doc_ids, files, rows, docs, held = number + 1, [], [], [], [], 0
    if docs:
        yield row()


def build_index(docs: DataFrame) -> DataFrame:
    """The stored index over all words of all texts; ``docs`` may have the places of ``with_rows``."""
    bounded_batches(docs.sparkSession)
    keyed = texts(docs, keep=ROW) if set(ROW) <= set(docs.columns) else with_rows(texts(docs))
    return materialize(keyed.mapInArrow(_build, INDEX), "posindex")


def term_hash(term: bytes) -> int:
    return xxhash.xxh64_intdigest(term) - (1 << 63)


def spread_terms(row: dict) -> tuple[list[bytes], np.ndarray]:
    """A segment's terms and how often each stands in it."""
    raw = zstandard.ZstdDecompressor().decompress(row["terms"])
    return (raw.split(b"\n") if raw else []), _spread(row["heads"]).astype(np.int64)


class Segment:
    """Postings of the wanted terms of one index row."""

    def __init__(self, row: dict, wanted: dict[bytes, int]):
        sizes = np.array(row["n_words"], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(sizes + 1)])
        terms, counts = spread_terms(row)
        heads = np.concatenate([[0], np.cumsum(counts)])
        steps = None
        self.at: dict[int, np.ndarray] = {}
        self.counts = np.zeros(len(wanted), dtype=np.int64)
        for k, term in enumerate(terms):
            q = wanted.get(term)
            if q is not None:
                if steps is None:
                    steps = _spread(row["postings"]).astype(np.int64)
                self.at[q] = np.cumsum(steps[heads[k] : heads[k + 1]])
                self.counts[q] = counts[k]

    def phrase(self, terms: np.ndarray) -> np.ndarray:
        """Positions where ``terms``, which all stand here, stand one after another."""
        order = np.argsort(self.counts[terms], kind="stable")
        found = self.at[int(terms[order[0]])] - order[0]
        for k in order[1:]:
            if not len(found):
                break
            there = self.at[int(terms[k])] - k
            near = np.searchsorted(there, found)
            near[near == len(there)] = 0
            found = found[there[near] == found]
        return found

    def near(self, terms: np.ndarray, rarest: int, reach: int) -> np.ndarray:
        """Positions of the term ``rarest`` that have every other within ``reach`` words of the same document."""
        found = self.at[rarest]
        doc = self.docs(found)
        low, high = np.maximum(found - reach, self.starts[doc]), np.minimum(found + reach, self.starts[doc + 1] - 2)
        for k in np.unique(terms).tolist():
            if k != rarest:
                there = self.at[k]
                ok = np.searchsorted(there, high, side="right") > np.searchsorted(there, low, side="left")
                found, low, high = found[ok], low[ok], high[ok]
            if not len(found):
                break
        return found

    def docs(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, positions, side="right") - 1


def _windows(window: int | None):
    """(item, win, terms): the windows of an item, or with None all its words as one."""
    kinds = [pa.string(), pa.string(), pa.list_(pa.struct([("term", pa.string()), ("h", pa.int64())]))]

    def run(batches):
        for batch in batches:
            rows = []
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist()):
                found = words(text)
                size = min(window or len(found), len(found))
                for win in {tuple(found[k : k + size]) for k in range(len(found) - size + 1)} if found else ():
                    rows.append((item, b" ".join(win).decode(), [{"term": w.decode(), "h": term_hash(w)} for w in sorted(set(win))]))
            for k in range(0, max(1, len(rows)), 5000):
                columns = list(zip(*rows[k : k + 5000])) or [()] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["item", "win", "terms"])

    return run


def _vocabulary(bits: np.ndarray):
    """(segment, h, n): how often a segment has each term that items may have."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                terms, counts = spread_terms(row)
                hashes = np.fromiter(map(term_hash, terms), dtype=np.int64, count=len(terms))
                some = in_map(bits, hashes)
                columns = [np.full(int(some.sum()), row["segment"], dtype=np.int64), hashes[some], counts[some]]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["segment", "h", "n"])

    return run


HITS = "segment long, place int, begins array<int>, ends array<int>, wins array<string>, near array<struct<win:string,n:long>>"


def _search(reach: int, phrases: bool):
    kinds = [pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.struct([("win", pa.string()), ("n", pa.int64())]))]
    names = "segment place begins ends wins near".split()

    def search(row: dict) -> list[tuple]:
        wanted: dict[bytes, int] = {}
        number = wanted.setdefault
        windows = [(w["win"], np.array([number(t, len(wanted)) for t in w["win"].encode().split(b" ")]), number(w["rarest"].encode(), len(wanted))) for w in row["windows"]]
        seg = Segment(row, wanted)
        hit = np.zeros(int(seg.starts[-1]) + 2, dtype=np.int32)
        wins: dict[int, list[str]] = {}
        close: dict[int, list[dict]] = {}
        for win, terms, rarest in windows:
            if not seg.counts[terms].all():
                continue
            near = seg.near(terms, rarest, reach)
            if not len(near):
                continue
            places, n = np.unique(seg.docs(near), return_counts=True)
            for d, k in zip(places.tolist(), n.tolist()):
                close.setdefault(d, []).append({"win": win, "n": k})
            if phrases and len(found := seg.phrase(terms)):
                np.add.at(hit, found, 1)
                np.add.at(hit, found + len(terms), -1)
                for d in np.unique(seg.docs(found)).tolist():
                    wins.setdefault(d, []).append(win)
        edge = np.diff(np.concatenate([[0], (np.cumsum(hit) > 0).astype(np.int8), [0]]))
        spans: dict[int, tuple[list[int], list[int]]] = {}
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        for b, e, d in zip(begin.tolist(), end.tolist(), seg.docs(begin).tolist()):
            both = spans.setdefault(d, ([], []))
            both[0].append(b - int(seg.starts[d]))
            both[1].append(e - int(seg.starts[d]))
        return [(row["segment"], d, *spans.get(d, ([], [])), wins.get(d, []), close[d]) for d in sorted(close)]

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                rows = search(batch.slice(k, 1).to_pylist()[0])
                columns = list(zip(*rows)) or [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    return run


def matches(index: DataFrame, items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int | None = WINDOW, reach: int = REACH, block_windows: int = BLOCK_WINDOWS, phrases: bool = True) -> tuple[DataFrame, DataFrame]:
    """HITS of each document that has some (a row for each block of windows), and (item, win)."""
    rows = items.select(F.col(id_col).cast("string").alias("item"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).filter("item is not null")
    owners = materialize(rows.mapInArrow(_windows(window), "item string, win string, terms array<struct<term:string,h:long>>"), "windows")
    terms = owners.select(F.explode("terms").alias("t")).select("t.term", "t.h").distinct()
    vocabulary = materialize(index.select("segment", "terms", "heads").mapInArrow(_vocabulary(hash_map(terms.select("h"), MAP_BITS)), "segment long, h long, n long"), "vocabulary")
    totals = vocabulary.groupBy("h").agg(F.sum("n").alias("total"))
    each = owners.select("win", "terms").dropDuplicates(["win"]).select("win", F.size("terms").alias("size"), F.explode("terms").alias("t")).select("win", "size", "t.term", "t.h")
    rarest = each.join(totals, "h").groupBy("win", "size").agg(F.count("*").alias("known"), F.min(F.struct("total", "term", "h")).alias("r")).filter("known = size")
    pairs = rarest.select("win", F.col("r.term").alias("rarest"), F.col("r.h").alias("h")).join(vocabulary.select("segment", "h"), "h")
    sizes = pairs.groupBy("segment").agg(F.ceil(F.count("*") / block_windows).cast("int").alias("blocks"))
    dealt = pairs.join(sizes, "segment").withColumn("block", F.pmod(F.xxhash64("win"), F.col("blocks")))
    lists = materialize(dealt.groupBy("segment", "block").agg(F.collect_list(F.struct("win", "rarest")).alias("windows")), "candidates")
    found = index.join(lists, "segment").select("segment", "n_words", "terms", "heads", "postings", "windows").mapInArrow(_search(reach, phrases), HITS)
    return materialize(found, "hits"), owners.select("item", "win")


def _covered(batches):
    """(segment, place, n_hit): words in the union of the runs."""
    for batch in batches:
        out = []
        for begins, ends in zip(batch.column("begins").to_pylist(), batch.column("ends").to_pylist()):
            hit = last = 0
            for b, e in sorted(zip(begins, ends)):
                hit += max(0, e - max(b, last))
                last = max(last, e)
            out.append(hit)
        yield pa.RecordBatch.from_arrays([batch.column("segment"), batch.column("place"), pa.array(out, pa.int64())], ["segment", "place", "n_hit"])


def counted(index: DataFrame, hits: DataFrame, owners: DataFrame) -> DataFrame:
    """A row for each document of the index, with its place and the columns of ``contamination``."""
    here = ["segment", "place"]
    runs = hits.filter("size(begins) > 0").groupBy(*here).agg(*(F.flatten(F.collect_list(c)).alias(c) for c in ("begins", "ends")))
    covered = runs.mapInArrow(_covered, "segment long, place int, n_hit long")
    item_lists = {}
    for name, wins in (("exact", F.explode("wins")), ("close", F.explode("near.win"))):
        at = hits.select(*here, wins.alias("win")).join(owners, "win").select(*here, "item").distinct()
        item_lists[name] = at.groupBy(*here).agg(F.count("*").alias(f"n_{name}"), F.array_join(F.array_sort(F.collect_list("item")), ",").alias(name))
    docs = index.select("segment", F.posexplode(F.arrays_zip("doc_ids", *ROW, "n_words")).alias("place", "d"))
    docs = docs.select(*here, "d.*").join(covered, here, "left").join(item_lists["exact"], here, "left").join(item_lists["close"].drop("close"), here, "left")
    n_words, n_hit = F.col("n_words").cast("long"), F.coalesce("n_hit", F.lit(0)).cast("long")
    return docs.select(
        *ROW,
        F.col("doc_ids").alias("doc_id"),
        n_words.alias("n_words"),
        n_hit.alias("n_hit"),
        F.coalesce("n_exact", F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce("exact", F.lit("")).cast("binary"), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= n_words)).alias("contaminated"),
        F.coalesce("n_close", F.lit(0)).cast("long").alias("n_near"),
    )


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, reach: int = REACH, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near for every row of ``docs``.

    ``n_near`` counts items with a window whose rarest term stands where all its other terms
    are within ``reach`` words.
    """
    index = build_index(docs)
    return counted(index, *matches(index, items, window=window, reach=reach, block_windows=block_windows)).drop(*ROW)


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs``, all columns as they are, of which under a twentieth of the words stand in windows of items."""
    keyed = with_rows(docs)
    index = build_index(keyed)
    bad = counted(index, *matches(index, items, window=window)).filter("contaminated").select(*ROW)
    return keyed.join(bad, ROW, "left_anti").drop(*ROW)


def proximity_matches(index: DataFrame, items: DataFrame, reach: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """doc_id, item_id, n: places of an item's rarest term with all its other terms within ``reach`` words."""
    hits, owners = matches(index, items, id_col, text_col, None, reach, phrases=False)
    found = hits.select("segment", "place", F.explode("near").alias("m")).select("segment", "place", "m.win", "m.n").join(owners, "win")
    docs = index.select("segment", F.posexplode("doc_ids").alias("place", "doc_id"))
    return found.join(docs, ["segment", "place"]).select("doc_id", F.col("item").alias("item_id"), "n")


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
SQL = f"""
with d as (select row_number() over () as r, doc_id, {_WORDS} as ws from documents),
b as (select item_id, {_WORDS} as ws from benchmark),
bw as (select distinct item_id, k, array_to_string(list_slice(ws, i, i + k - 1), ' ') as win
  from (select item_id, ws, least(13, len(ws)) as k, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) as i from b where len(ws) > 0)),
dw as (select r, i, k, array_to_string(list_slice(ws, i, i + k - 1), ' ') as win
  from (select r, ws, k, unnest(range(1, len(ws) - k + 2)) as i from d, (select distinct k from bw) where len(ws) >= k)),
hits as (select r, i, k, item_id from dw join bw using (k, win)),
places as (select r, count(*) as n_hit from (select distinct r, unnest(range(i, i + k)) as p from hits) group by r),
items as (select r, count(*) as n_items, sha256(string_agg(id, ',' order by id)) as sha from (select distinct r, item_id::varchar as id from hits) group by r),
dt as (select r, unnest(ws) as w, unnest(range(1, len(ws) + 1)) as p from d),
tot as (select w, count(*) as n from dt group by w),
wt as (select distinct win, unnest(string_split(win, ' ')) as w from bw),
rare as (select win, count(*) as size, arg_min(w, row(n, w)) as rarest from wt left join tot using (w) group by win having count(n) = count(*)),
cand as (select win, size, r, p from rare join dt on dt.w = rarest),
close as (select win, cand.r, cand.p from cand join wt using (win) join dt on dt.r = cand.r and dt.w = wt.w and dt.p between cand.p - 26 and cand.p + 26
  group by win, cand.r, cand.p, size having count(distinct wt.w) = size),
near as (select r, count(distinct item_id) as n_near from close join bw using (win) group by r)
select doc_id, len(ws)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  coalesce(sha, sha256('')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(ws) as contaminated, coalesce(n_near, 0)::bigint as n_near
from d left join places using (r) left join items using (r) left join near using (r)
"""
