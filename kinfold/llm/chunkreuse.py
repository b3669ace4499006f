"""BPE encoding and decoding with content-defined chunks, shared across documents.

A rolling hash over 48 bytes of text cuts it where the hash has certain bits, so equal
passages of different documents fall into equal chunks wherever they stand. Chunks are
counted by their digests; one that the corpus has twice or more is encoded once, into a
table of chunks, and its ids are joined to every document that has it. What a chunk's ids are near its ends depends on what stands around it. So the
table has the ids between the first and the last boundary in it, a boundary being a place
where the pre-tokenizer cuts whatever stands around; at each join the text from the left
chunk's last boundary to the right chunk's first is encoded again, from where on both sides
agree exactly. A chunk without two boundaries stays open, and so does one that is not shared.

Shared chunks' texts gather by digest, one from each task; which those are, tasks know from a
map of 2**23 bits (a corpus with more shared chunks than that sends needless ones, which the
join with the digests drops). Texts that have none are encoded where they are read; the others
are sent to their chunks' ids, under zstandard. Rows are
told apart by their place in the files, so repeated rows and null ids need no care.

Defined results: null and empty texts have no ids; texts with a special token's opening are
encoded whole; texts of scripts without spaces have few boundaries and so share less;
repeated rows are encoded alike; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm.codec import SPACED, Codec, codec, read_tokenizer
from kinfold.llm.common import ROW, bounded_batches, discard, hash_map, in_map, materialize, release, texts, tidy, with_rows

WINDOW = 48
MASK = 10  # bits: chunks of about 2**10 characters
MAP_BITS = 23
BASE = 0x9E3779B97F4A7C15 | 1
Known = list[tuple[int, int, bytes]]  # first and last boundary of a shared chunk, and the ids between (``narrow``)


class Roller:
    """Hashes of all windows at once: prefix sums of powers, modulo 2**64."""

    def __init__(self):
        self.size = 0

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.size:
            self.size = 1 << max(12, (n - 1).bit_length())
            base, inverse = np.uint64(BASE), np.uint64(pow(BASE, -1, 1 << 64))
            self.up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(self.size - 1, base)]), dtype=np.uint64)
            self.down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(self.size - 1, inverse)]), dtype=np.uint64)
        return self.up[:n], self.down[:n]

    def hashes(self, codes: np.ndarray, window: int) -> np.ndarray:
        n = len(codes)
        if n < window:
            return np.empty(0, dtype=np.uint64)
        up, down = self.powers(n)
        sums = np.concatenate([[np.uint64(0)], np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up, dtype=np.uint64)])
        return (sums[window:] - sums[:-window]) * down[: n - window + 1]


_ROLLER = Roller()


def cuts(text: str, window: int = WINDOW, mask: int = MASK) -> list[int]:
    """Ends of the chunks of ``text`` in characters; the last is its length."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    hashes = _ROLLER.hashes(codes, window)
    at = np.flatnonzero((hashes >> np.uint64(64 - mask)) == 0) + window
    found = at.tolist()
    if not found or found[-1] != len(text):
        found.append(len(text))
    return found


def last_boundary(text: str, begin: int, end: int) -> int:
    """Place of the last space before ``end`` that a sign follows, which itself is before ``end``; -1 if none."""
    at = text.rfind(" ", begin, end - 1)
    while at >= 0 and text[at + 1].isspace():
        at = text.rfind(" ", begin, at)
    return at


def chunks(tool: Codec, text: str, mask: int = MASK) -> list[tuple[bytes, int, int]]:
    """Digest and first and last boundary of each chunk of ``text`` that has two.

    Such a chunk's ids between them are the whole text's there, wherever it stands.
    """
    out = []
    if tool.kind != "spaced" or not tool.divides(text):
        return out
    begin = 0
    for end in cuts(text, mask=mask):
        first = SPACED.search(text, begin, end)
        if first is not None:
            last = last_boundary(text, first.start(), end)
            if last > first.start():
                out.append((hashlib.blake2b(text[begin:end].encode("utf-8", "surrogatepass"), digest_size=16).digest(), first.start(), last))
        begin = end
    return out


def narrow(tool: Codec, raw: bytes) -> bytes:
    """Ids in two bytes each, where the vocabulary allows."""
    return np.frombuffer(raw, dtype="<u4").astype("<u2").tobytes() if len(tool.shown()) <= 1 << 16 else raw


def wide(tool: Codec, packed: bytes) -> bytes:
    return np.frombuffer(packed, dtype="<u2").astype("<u4").tobytes() if len(tool.shown()) <= 1 << 16 else packed


def encode_with(tool: Codec, rows: list[tuple[str, Known]]) -> list[bytes]:
    """Ids of texts of which some chunks' ids are known: the rest is encoded from boundary to boundary."""
    gaps: list[str] = []
    for text, known in rows:
        at = 0
        for first, last, _ in known:
            gaps.append(text[at:first])
            at = last
        gaps.append(text[at:])
    made = iter(tool.encode_all(gaps))
    out = []
    for _, known in rows:
        parts = []
        for _, _, ids in known:
            parts += [next(made), wide(tool, ids)]
        parts.append(next(made))
        out.append(b"".join(parts))
    return out


def _occurrences(spec: str, mask: int):
    names = ["digest", *ROW, "first", "last"]
    kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]

    def run(batches):
        tool = codec(spec)
        for batch in batches:
            rows = []
            for text, file, row in zip(*(batch.column(c).to_pylist() for c in ("text", *ROW))):
                rows += [(digest, file, row, first, last) for digest, first, last in chunks(tool, text, mask)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 5, kinds)], names)
        tidy()

    return run


def _chunk_texts(spec: str, mask: int, bits: np.ndarray):
    """(digest, body): the part between the boundaries of each chunk that may be shared, once a task."""

    def run(batches):
        tool, seen = codec(spec), set()
        for batch in batches:
            digests, bodies = [], []
            for text in batch.column("text").to_pylist():
                found = chunks(tool, text, mask)
                if found:
                    some = in_map(bits, np.array([hashed(d) for d, _, _ in found], dtype=np.int64)).tolist()
                    for (digest, first, last), maybe in zip(found, some):
                        if maybe and digest not in seen:
                            seen.add(digest)
                            digests.append(digest)
                            bodies.append(text[first:last])
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(bodies, pa.string())], ["digest", "body"])
        tidy()

    return run


def hashed(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "big", signed=True)


def _chunk_ids(spec: str):
    def run(batches):
        tool = codec(spec)
        for batch in batches:
            ids = [narrow(tool, raw) for raw in tool.encode_all(batch.column("body").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(ids, pa.binary())], ["digest", "ids"])

    return run


def shared_chunks(rows: DataFrame, spec: str, mask: int = MASK) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """(digest, ids) of chunks that stand in two places or more, (row, digest, first, last) of all chunks, and the map."""
    spark = rows.sparkSession
    places = materialize(rows.mapInArrow(_occurrences(spec, mask), f"digest binary, {ROW[0]} long, {ROW[1]} long, first int, last int"), "chunks")
    shared = materialize(places.groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1").select("digest"), "digests")
    head = F.conv(F.hex(F.substring("digest", 1, 8)), 16, -10).cast("long")
    bits = hash_map(shared.select(head.alias("h")), MAP_BITS, shared.count())
    bodies = rows.select("text").mapInArrow(_chunk_texts(spec, mask, bits), "digest binary, body string")
    once = bodies.groupBy("digest").agg(F.first("body").alias("body")).join(shared, "digest", "left_semi")
    found = materialize(once.mapInArrow(_chunk_ids(spec), "digest binary, ids binary"), "chunkids")
    discard(shared)
    release(spark)
    return found, places, bits


def _scattered(parts: list[list[pa.Array]], where: list[list[int]], rows: int) -> list[pa.Array]:
    """Columns of ``rows`` rows: those of each of ``parts`` at its places, null elsewhere."""
    at: list[int | None] = [None] * rows
    before = 0
    for places in where:
        for k, row in enumerate(places):
            at[row] = before + k
        before += len(places)
    taken = pa.array(at, pa.int64())
    return [pa.concat_arrays(columns).take(taken) for columns in zip(*parts)]


def _read(spec: str, mask: int, bits: np.ndarray, make, names: list[str]):
    """Results of texts without shared chunks, the packed texts of others."""

    def run(batches):
        tool, press = codec(spec), zstandard.ZstdCompressor(level=1)
        for batch in batches:
            found = batch.column("text").to_pylist()
            packed: list[bytes | None] = [None] * len(found)
            done = []
            for k, text in enumerate(found):
                parts = [hashed(d) for d, _, _ in chunks(tool, text, mask)]
                if parts and in_map(bits, np.array(parts, dtype=np.int64)).any():
                    packed[k] = press.compress(text.encode("utf-8", "surrogatepass"))
                else:
                    done.append(k)
            results = _scattered([make(tool, tool.encode_all([found[k] for k in done]))], [done], len(found))
            own = [batch.column(c) for c in ("doc_id", *ROW)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(packed, pa.binary()), *results], ["doc_id", *ROW, "packed", *names])
        tidy()

    return run


def _finish(spec: str, make, names: list[str]):
    def run(batches):
        tool, press = codec(spec), zstandard.ZstdDecompressor()
        for batch in batches:
            packed = batch.column("packed").to_pylist()
            known = batch.column("known").to_pylist()
            rest = [k for k, raw in enumerate(packed) if raw is not None]
            done = [k for k, raw in enumerate(packed) if raw is None]
            some = [(press.decompress(packed[k]).decode("utf-8", "surrogatepass"), sorted((c["first"], c["last"], c["ids"]) for c in known[k] or ())) for k in rest]
            before = [batch.column(c).take(pa.array(done, pa.int64())) for c in names]
            results = _scattered([before, make(tool, encode_with(tool, some))], [done, rest], len(packed))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *results], ["doc_id", *names])
        tidy()

    return run


def encoded(docs: DataFrame, tokenizer: str, make, schema: str, mask: int = MASK) -> DataFrame:
    """doc_id and what ``make`` gives of the ids (columns of ``schema``), for every row of ``docs``."""
    bounded_batches(docs.sparkSession)
    spec = read_tokenizer(tokenizer)
    names = [c.split()[0] for c in schema.split(", ")]
    rows = with_rows(texts(docs))
    table, places, bits = shared_chunks(rows, spec, mask)
    uses = places.join(table, "digest").groupBy(*ROW).agg(F.collect_list(F.struct("first", "last", "ids")).alias("known"))
    read = rows.mapInArrow(_read(spec, mask, bits, make, names), f"doc_id long, {ROW[0]} long, {ROW[1]} long, packed binary, {schema}")
    joined = read.join(uses, ROW, "left").select("doc_id", "packed", "known", *names)
    return joined.mapInArrow(_finish(spec, make, names), f"doc_id long, {schema}")


def _digests(tool: Codec, encoded_texts: list[bytes]) -> list[pa.Array]:
    shown = tool.shown()
    rows = []
    for raw in encoded_texts:
        ids = np.frombuffer(raw, dtype="<u4").tolist()
        decoded = tool.decode(ids)
        rows.append((len(ids), hashlib.sha256(",".join(map(shown.__getitem__, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest()))
    return [pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 3, (pa.int64(), pa.string(), pa.string()))]


def _id_lists(tool: Codec, encoded_texts: list[bytes]) -> list[pa.Array]:
    return [pa.array([np.frombuffer(raw, dtype="<u4").astype(np.int32) for raw in encoded_texts], pa.list_(pa.int32()))]


def encode_ids(docs: DataFrame, tokenizer: str, mask: int = MASK) -> DataFrame:
    """doc_id and the ids of each whole text."""
    return encoded(docs, tokenizer, _id_lists, "ids array<int>", mask)


def encode_decode(docs: DataFrame, tokenizer: str, mask: int = MASK) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each whole text."""
    return encoded(docs, tokenizer, _digests, "n_tokens long, ids_sha256 string, decoded_sha256 string", mask)
