"""Removal of repeated 100-byte strings by suffix arrays, built by two-stage sorting.

The array of a block of text: suffixes smaller than their successors are sorted
directly, by ranks of 8, 16, 32 and 64 bytes; the others are induced by one
scan over the buckets of first bytes, a whole bucket at a time. Neighbours in the array that share ``length``
bytes are occurrences of one string, and all but the earliest are repeats.

A corpus is not one array. Of every window of ``length`` bytes the smallest hash of the
``gram``-byte strings in it is an anchor, so equal windows have equal anchors at equal
places. Anchors that occur in one place only (copies of a text aside) are gone after one
sum by anchor, which a frequent one enters added up by task. The text around the others is sent once to where the first document with the
same anchor gathers its kin, and an array is built there. A repeat found in any of the
arrays is one, and each repeat shares an array with an earlier occurrence, so the result
is that of one array over everything. Copies of whole texts are found by their digests.

Small gatherings share an array of about ``group_anchors`` places, where a text's overlapping
parts become one; large ones are cut by anchor, and those still too large are dealt as pairs
of blocks. Texts are read twice beside the anchors' pass: to cut the
texts around anchors and to remove.

Defined results: null and empty texts have nothing to remove; a null id counts as
smaller than any; rows with the same id and text are one document, and are all treated
like the first; of rows with the same id and different texts, each is a document, in
order of their crc32 (then of another hash); an empty table gives no rows; other columns
are ignored. Texts of one id are told by 63 bits, whole texts by sha256, anchors by 64 bits
and their bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.llm.chunkreuse import Roller
from kinfold.llm.common import bounded_batches, discard, materialize, release, texts, tidy
from kinfold.llm.ngramjoin import mixed

LENGTH = 100
GRAM = 36
GROUP_ANCHORS = 10_000
BLOCK_ANCHORS = 100_000
NULL_ID = -(2**63)
_ROLLER = Roller()


def words_at(text: np.ndarray) -> np.ndarray:
    """The big-endian number of the 8 bytes from each position; zeros beyond the end."""
    padded = np.concatenate([text, np.zeros(8, dtype=np.uint8)])
    out = np.zeros(len(text), dtype=np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | padded[k : k + len(text)].astype(np.uint64)
    return out


def ascending(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than its successor."""
    n = len(text)
    out = np.zeros(n, dtype=bool)
    if n < 2:
        return out
    step = text[:-1] != text[1:]
    # Runs of one byte take the type of their last place.
    following = np.where(step, np.arange(n - 1), n)
    following = np.minimum.accumulate(following[::-1])[::-1]
    known = following < n
    out[:-1][known] = text[following[known]] < text[following[known] + 1]
    return out


def dense(keys: np.ndarray) -> np.ndarray:
    """Place of each key among the different ones, from 0."""
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.zeros(len(keys), dtype=np.int64)
    new[1:] = ordered[1:] != ordered[:-1]
    out = np.empty(len(keys), dtype=np.int64)
    out[order] = np.cumsum(new)
    return out


def after(ranks: np.ndarray, step: int) -> np.ndarray:
    """The rank ``step`` bytes on; beyond the end the shorter rest is smaller, and all are smaller than ranks."""
    return np.concatenate([ranks[step:] + step, np.arange(step - 1, -1, -1)[: len(ranks)]])[: len(ranks)] if step else ranks


def sorted_directly(places: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """``places`` by their first ``depth`` bytes: ranks of 8 bytes give those of 16, and so on; two ranks make up ``depth``."""
    ranks, width = dense(words), 8
    while 2 * width <= depth and len(ranks) and ranks.max() + 1 < len(ranks):
        ranks = dense((ranks << 32) | after(ranks, width))
        width *= 2
    key = (ranks << 32) | after(ranks, max(0, depth - width))
    return places[np.argsort(key[places])]


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """All suffixes of ``text`` in order of their first ``depth`` bytes at least."""
    n = len(text)
    if n == 0:
        return np.empty(0, dtype=np.int64)
    small = ascending(text)
    direct = sorted_directly(np.flatnonzero(small), words_at(text), depth)
    large = ~small
    ends = np.cumsum(np.bincount(text[direct], minlength=256))
    begun: list[list[np.ndarray]] = [[] for _ in range(256)]  # induced so far, by first byte
    begun[text[-1]].append(np.array([n - 1]))
    out: list[np.ndarray] = []
    for c in np.flatnonzero(np.bincount(text, minlength=256)).tolist():
        new = np.concatenate(begun[c]) if begun[c] else np.empty(0, dtype=np.int64)
        bucket = []
        while len(new):  # a suffix before one of its own bucket comes after all that are there
            bucket.append(new)
            before = new - 1
            before = before[before >= 0]
            new = before[large[before] & (text[before] == c)]
        bucket.append(direct[(ends[c - 1] if c else 0) : ends[c]])
        scanned = np.concatenate(bucket)
        before = scanned - 1
        before = before[before >= 0]
        before = before[large[before] & (text[before] > c)]
        first = text[before]
        order = np.argsort(first, kind="stable")
        heads = np.flatnonzero(np.diff(first[order], prepend=np.int16(-1)))
        for k, part in zip(heads.tolist(), np.split(before[order], heads[1:])):
            begun[first[order[k]]].append(part)
        out.append(scanned)
    return np.concatenate(out)


def shared(a: np.ndarray, b: np.ndarray, words: np.ndarray, length: int) -> np.ndarray:
    """Whether the suffixes at ``a`` and ``b`` have ``length`` bytes in common (both are that long)."""
    same = np.ones(len(a), dtype=bool)
    for at in range(0, length, 8):
        at = min(at, max(0, length - 8))
        left = np.flatnonzero(same)
        same[left] = words[a[left] + at] == words[b[left] + at]
    return same


def repeats(bodies: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For bodies in order, the starts in each of strings of ``length`` bytes that start earlier too."""
    sizes = np.array([len(b) for b in bodies], dtype=np.int64)
    begins = np.concatenate([[0], np.cumsum(sizes)])
    text = np.frombuffer(b"".join(bodies), dtype=np.uint8)
    inside = np.zeros(len(text) + 1, dtype=np.int32)
    fits = sizes >= length
    np.add.at(inside, begins[:-1][fits], 1)
    np.add.at(inside, begins[1:][fits] - length + 1, -1)
    valid = np.cumsum(inside)[:-1] > 0
    again = np.zeros(len(text), dtype=bool)
    if valid.any():
        array = suffix_array(text, length)
        array = array[valid[array]]
        words = words_at(text)
        first = np.ones(len(array), dtype=bool)
        first[1:] = ~shared(array[:-1], array[1:], words, length)
        group = np.cumsum(first) - 1
        earliest = np.minimum.reduceat(array, np.flatnonzero(first))
        again[array[array != earliest[group]]] = True
    return [np.flatnonzero(again[a:b]) for a, b in zip(begins[:-1], begins[1:])]


def slide(values: np.ndarray, width: int, best) -> np.ndarray:
    """Minimum or maximum of every ``width`` neighbours, in blocks scanned both ways."""
    n = len(values)
    if width == 1:
        return values
    edge = np.uint64(0xFFFFFFFFFFFFFFFF) if best is np.minimum else np.uint64(0)
    rows = np.concatenate([values, np.full(-n % width, edge, dtype=values.dtype)]).reshape(-1, width)
    ahead = best.accumulate(rows, axis=1).ravel()
    back = best.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return best(back[: n - width + 1], ahead[width - 1 : n])


def anchors(raw: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the smallest grams of all windows; none in texts shorter than a window."""
    if len(raw) < length:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
    hashes = mixed(_ROLLER.hashes(np.frombuffer(raw, dtype=np.uint8), gram))
    width = length - gram + 1
    low = slide(hashes, width, np.minimum)
    edges = np.zeros(width - 1, dtype=np.uint64)
    high = slide(np.concatenate([edges, low, edges]), width, np.maximum)
    at = np.flatnonzero(high == hashes)
    return at, hashes[at]


def _anchors(length: int, gram: int):
    """(gram, key_id, crc, place, more): a row for each gram of a document, with its first place and any others."""
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int32())]

    def run(batches):
        for batch in batches:
            for key_id, crc, text in zip(batch.column("key_id").to_pylist(), batch.column("crc").to_pylist(), batch.column("text").to_pylist()):
                at, hashes = anchors(text.encode("utf-8", "surrogatepass"), length, gram)
                order = np.argsort(hashes, kind="stable")
                at, hashes = at[order].astype(np.int64), hashes[order]
                heads = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(at) else at
                more = [None] * len(heads)
                sizes = np.diff(np.append(heads, len(at)))
                for k in np.flatnonzero(sizes > 1).tolist():
                    more[k] = at[heads[k] + 1 : heads[k] + sizes[k]].astype(np.int32)
                for k in range(0, len(heads), 100_000):
                    part = heads[k : k + 100_000]
                    columns = [hashes[part].view(np.int64), np.full(len(part), key_id, dtype=np.int64), np.full(len(part), crc, dtype=np.int64), at[part].astype(np.int32), more[k : k + 100_000]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["gram", "key_id", "crc", "place", "more"])

    return run


def _cut(length: int, gram: int):
    """(hub, slice, key_id, crc, offset, body): the text around a document's live anchors, by hub."""
    names = ["hub", "slice", "key_id", "crc", "offset", "body"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    before = length - gram

    def run(batches):
        for batch in batches:
            rows = []
            for row in batch.select(["key_id", "crc", "text", "groups"]).to_pylist():
                raw = row["text"].encode("utf-8", "surrogatepass")
                for g in row["groups"]:
                    at = np.sort(np.array(g["places"], dtype=np.int64))
                    begin, end = np.maximum(at - before, 0), np.minimum(at + length, len(raw))
                    heads = np.flatnonzero(np.concatenate([[True], begin[1:] > end[:-1]]))
                    for a, b in zip(begin[heads].tolist(), np.maximum.reduceat(end, heads).tolist()):
                        rows.append((g["hub"], g["slice"], row["key_id"], row["crc"], a, raw[a:b]))
            for k in range(0, max(1, len(rows)), 5000):
                columns = list(zip(*rows[k : k + 5000])) or [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    return run


def merged(begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of what the intervals cover."""
    if not len(begins):
        return begins, ends
    order = np.argsort(begins, kind="stable")
    begins, ends = begins[order], np.maximum.accumulate(ends[order])
    heads = np.flatnonzero(np.concatenate([[True], begins[1:] > ends[:-1]]))
    return begins[heads], np.maximum.reduceat(ends, heads)


def united(rows: list[tuple[int, int, int, bytes]]) -> list[tuple[int, int, int, bytes]]:
    """Sorted (key_id, crc, offset, body) with overlapping bodies of a text as one, so that none repeats itself."""
    out: list[tuple[int, int, int, list[bytes]]] = []
    end = 0
    for key_id, crc, offset, body in rows:
        if out and out[-1][:2] == (key_id, crc) and offset <= end:
            if offset + len(body) > end:
                out[-1][3].append(body[end - offset :])
                end = offset + len(body)
        else:
            out.append((key_id, crc, offset, [body]))
            end = offset + len(body)
    return [(key_id, crc, offset, b"".join(parts)) for key_id, crc, offset, parts in out]


def _find(length: int):
    schema = pa.schema([("key_id", pa.int64()), ("crc", pa.int64()), ("begins", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64()))])

    def run(table: pa.Table) -> pa.Table:
        table = table.select(["key_id", "crc", "offset", "body"])
        rows = united(sorted(set(zip(*(table.column(c).to_pylist() for c in table.column_names)))))
        places: dict[tuple[int, int], list] = {}
        if len(rows):
            for (key_id, crc, offset, _), starts in zip(rows, repeats([r[3] for r in rows], length)):
                if len(starts):
                    places.setdefault((key_id, crc), []).append(starts + offset)
        out = []
        for (key_id, crc), starts in places.items():
            starts = np.sort(np.concatenate(starts))
            begins, ends = merged(starts, starts + length)
            out.append((key_id, crc, begins, ends))
        columns = list(zip(*out)) or [()] * 4
        found = pa.table([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
        tidy()
        return found

    return run


def _remove(length: int):
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    kinds = [pa.int64()] * 4 + [pa.string()]

    def run(batches):
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                raw = row["text"].encode("utf-8", "surrogatepass")
                if row["copy"]:
                    rows.append((row["doc_id"], len(raw), len(raw), 1, hashlib.sha256(b"").hexdigest()))
                    continue
                begins, ends = merged(np.array(row["begins"] or [], dtype=np.int64), np.array(row["ends"] or [], dtype=np.int64))
                kept = hashlib.sha256()
                at = 0
                for a, b in zip(begins.tolist(), ends.tolist()):
                    kept.update(raw[at:a])
                    at = b
                kept.update(raw[at:])
                rows.append((row["doc_id"], len(raw), int((ends - begins).sum()), len(begins), kept.hexdigest()))
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    return run


def live_anchors(keyed: DataFrame, firsts: DataFrame, length: int, gram: int, group_anchors: int) -> DataFrame:
    """key_id, crc, groups: for each first document the anchors that other places have too, by hub and slice."""
    spark = keyed.sparkSession
    found = materialize(keyed.mapInArrow(_anchors(length, gram), "gram long, key_id long, crc long, place int, more array<int>"), "grams")
    # Of one text and place, so that copies of a text are one; a gram that a text has twice is in two places.
    at = F.xxhash64("crc", "place")
    twice = F.col("more").isNotNull().cast("long")
    sums = found.groupBy("gram").agg(F.min(at).alias("low"), F.max(at).alias("high"), F.max(twice).alias("twice"), F.min("key_id").alias("hub"))
    shared_grams = materialize(sums.filter("low <> high or twice > 0").select("gram", "hub"), "shared")
    release(spark)
    live = found.join(shared_grams, "gram").join(firsts, ["key_id", "crc"], "left_semi").select("gram", "key_id", "crc", "place", "more", "hub")
    stored = live = materialize(live, "anchors")
    discard(found, shared_grams)
    release(spark)
    places = F.concat(F.array("place"), F.coalesce("more", F.array().cast("array<int>")))
    arrays = max(1, -(-(live.agg(F.sum(F.size(places))).first()[0] or 0) // group_anchors))
    live = live.withColumn("hub", F.pmod(F.xxhash64("hub"), F.lit(arrays)).cast("long"))
    sizes = live.groupBy("hub").agg(F.ceil(F.sum(F.size(places)) / group_anchors).cast("int").alias("slices"))
    large = materialize(sizes.filter("slices > 1"), "slices", 4)  # few: one for ``group_anchors`` places at most
    cut = live.join(large, "hub", "left").withColumn("slice", F.coalesce(F.pmod("gram", F.col("slices")), F.lit(0)).cast("int"))
    groups = cut.groupBy("key_id", "crc", "hub", "slice").agg(F.flatten(F.collect_list(places)).alias("places"))
    groups = materialize(groups.groupBy("key_id", "crc").agg(F.collect_list(F.struct("hub", "slice", "places")).alias("groups")), "live")
    discard(stored, large)
    return groups


def repeated_spans(keyed: DataFrame, firsts: DataFrame, length: int = LENGTH, gram: int = GRAM, group_anchors: int = GROUP_ANCHORS, block_anchors: int = BLOCK_ANCHORS) -> DataFrame:
    """key_id, crc, begins, ends: bytes of first documents that an earlier place has, as runs (several a row)."""
    spark = keyed.sparkSession
    groups = live_anchors(keyed, firsts, length, gram, group_anchors)
    release(spark)
    sizes = groups.select(F.explode("groups").alias("g")).groupBy("g.hub", "g.slice").agg(F.ceil(F.sum(F.size("g.places")) / block_anchors).cast("int").alias("blocks"))
    large = materialize(sizes.filter("blocks > 1"), "blocks", 4)
    bodies = keyed.join(groups, ["key_id", "crc"]).mapInArrow(_cut(length, gram), "hub long, slice int, key_id long, crc long, offset long, body binary")
    dealt = bodies.join(large, ["hub", "slice"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("key_id", "crc"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("hub", "slice", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "key_id", "crc", "offset", "body")
    found = dealt.groupBy("hub", "slice", "i", "j").applyInArrow(_find(length), "key_id long, crc long, begins array<long>, ends array<long>")
    found = materialize(found, "spans")
    discard(groups, large)
    release(spark)
    return found


def text_key(raw) -> Column:
    """63 bits of a text: its crc32, and 31 bits of another hash below."""
    return F.shiftleft(F.crc32(raw), 31).bitwiseOR(F.xxhash64(raw).bitwiseAND(F.lit(2**31 - 1)))


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", **sizes) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of ``docs``."""
    bounded_batches(docs.sparkSession)
    rows = texts(docs, id_col, text_col)
    raw = F.col("text").cast("binary")
    keyed = rows.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("key_id"), text_key(raw).alias("crc"), "text")
    keyed = keyed.filter(F.octet_length("text") >= length)
    slim = materialize(keyed.select("key_id", "crc", F.unhex(F.sha2(raw, 256)).alias("sha")).distinct(), "digests")
    least = slim.groupBy("sha").agg(F.min(F.struct("key_id", "crc")).alias("first"))
    firsts = materialize(least.select("first.key_id", "first.crc"), "firsts")
    spans = repeated_spans(keyed, firsts, length, **sizes)
    lists = {c: F.flatten(F.collect_list(c)).alias(c) for c in ("begins", "ends")}
    marks = spans.groupBy("key_id", "crc").agg(*lists.values()).withColumn("copy", F.lit(False))
    none = F.array().cast("array<long>")
    copies = slim.select("key_id", "crc").join(firsts, ["key_id", "crc"], "left_anti")
    marks = marks.unionByName(copies.withColumns({"begins": none, "ends": none, "copy": F.lit(True)}))
    whole = rows.select("doc_id", F.coalesce("doc_id", F.lit(NULL_ID)).alias("key_id"), text_key(raw).alias("crc"), "text")
    joined = whole.join(marks, ["key_id", "crc"], "left").select("doc_id", "text", "begins", "ends", "copy")
    return joined.mapInArrow(_remove(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
