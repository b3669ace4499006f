"""Token-id files: blocks of ids as bit or byte planes, each plane under zstandard.

A file is a Parquet dataset of chunks. A chunk holds whole documents in ascending id
order, at least ``chunk_ids`` ids where there are so many: their doc ids and lengths,
the number of ids before it in its part, a checksum, and its ids cut into blocks of
``block_ids``. A block is transposed, so that plane k holds bit (or byte) k of all its
ids, and each plane is compressed by itself; planes of zeros, as the high ones always
are, take no bytes. Columns other than the blocks are the chunk index: finding a range
of ids or a document reads those alone.

Parquet carries the chunks because Spark's committed writes survive lost executors and
reach any store. Parts are ranges of doc_id; a document is never split over chunks.

Defined results: null and empty texts have the end id only; a null doc_id sorts first;
repeated ids are kept, in order of a hash of their texts; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinfold.llm.codec import codec, read_tokenizer
from kinfold.llm.common import bounded_batches, new_path, texts

BLOCK_IDS = 1 << 16
CHUNK_IDS = 1 << 18
SCHEMA = (
    "part int, chunk int, before long, n_ids long, checksum long, doc_ids array<long>, n_tokens array<long>, "
    "planes string, blocks array<struct<n:int, planes:array<binary>>>"
)
ARROW = pa.schema(
    [
        ("part", pa.int32()),
        ("chunk", pa.int32()),
        ("before", pa.int64()),
        ("n_ids", pa.int64()),
        ("checksum", pa.int64()),
        ("doc_ids", pa.list_(pa.int64())),
        ("n_tokens", pa.list_(pa.int64())),
        ("planes", pa.string()),
        ("blocks", pa.list_(pa.struct([("n", pa.int32()), ("planes", pa.list_(pa.binary()))]))),
    ]
)


def pack(ids: np.ndarray, planes: str, level: int = 1) -> list[bytes]:
    """The compressed planes of one block of unsigned 32-bit ids."""
    raw = np.ascontiguousarray(ids.astype("<u4")).view(np.uint8).reshape(-1, 4)
    rows = raw.T if planes == "byte" else np.packbits(np.unpackbits(raw, axis=1, bitorder="little").T, axis=1, bitorder="little")
    press = zstandard.ZstdCompressor(level=level)
    return [press.compress(np.ascontiguousarray(row)) if row.any() else b"" for row in rows]


def unpack(n: int, packed: list[bytes], planes: str) -> np.ndarray:
    width = n if planes == "byte" else (n + 7) // 8
    rows = np.zeros((len(packed), width), dtype=np.uint8)
    press = zstandard.ZstdDecompressor()
    for k, plane in enumerate(packed):
        if plane:
            rows[k] = np.frombuffer(press.decompress(plane), dtype=np.uint8)
    if planes == "byte":
        return np.ascontiguousarray(rows.T).view("<u4").ravel()
    bits = np.unpackbits(rows, axis=1, bitorder="little")[:, :n].T
    return np.packbits(np.ascontiguousarray(bits), axis=1, bitorder="little").view("<u4").ravel()


def writer(spec: str, end_id: int, planes: str, block_ids: int, chunk_ids: int):
    tail = end_id.to_bytes(4, "little")

    def run(batches):
        tool, part, number, before = codec(spec), TaskContext.get().partitionId(), 0, 0
        doc_ids: list = []
        encoded: list[bytes] = []
        held = 0

        def chunk():
            raw = b"".join(encoded)
            ids = np.frombuffer(raw, dtype="<u4")
            cuts = range(0, len(ids), block_ids)
            blocks = [{"n": len(ids[a : a + block_ids]), "planes": pack(ids[a : a + block_ids], planes)} for a in cuts]
            row = [part, number, before, len(ids), zlib.crc32(raw), doc_ids, [len(x) // 4 for x in encoded], planes, blocks]
            return pa.RecordBatch.from_arrays([pa.array([v], t.type) for v, t in zip(row, ARROW)], schema=ARROW)

        for batch in batches:
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), tool.encode_all(batch.column("text").to_pylist())):
                doc_ids.append(doc_id)
                encoded.append(ids + tail)
                held += len(encoded[-1]) // 4
                if held >= chunk_ids:
                    yield chunk()
                    number, before = number + 1, before + held
                    doc_ids, encoded, held = [], [], 0
        if encoded:
            yield chunk()

    return run


def write_planes(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, planes: str = "byte", block_ids: int = BLOCK_IDS, chunk_ids: int = CHUNK_IDS) -> None:
    """Encode every text of ``docs`` with the tokenizer file and write the chunks to ``path``."""
    bounded_batches(docs.sparkSession)
    # A hash of the text breaks ties, and lets many rows of one id be dealt to several parts. The
    # ranges are cut by a sample of these two on the driver; the texts themselves must not be in it.
    keyed = texts(docs).withColumn("tie", F.xxhash64("text"))
    ordered = keyed.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    ordered.mapInArrow(writer(read_tokenizer(tokenizer), end_id, planes, block_ids, chunk_ids), SCHEMA).write.parquet(path)


def read_chunk(row: dict) -> np.ndarray:
    """All ids of a chunk, checked."""
    ids = np.concatenate([unpack(b["n"], b["planes"], row["planes"]) for b in row["blocks"]])
    if len(ids) != row["n_ids"] or zlib.crc32(ids.tobytes()) != row["checksum"]:
        raise ValueError(f"chunk {row['chunk']} of part {row['part']} is damaged")
    return ids


def _documents(batches):
    names = ["part", "doc_id", "local", "n_tokens", "ids_crc32"]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pylist()[0]
            raw = memoryview(read_chunk(row).tobytes())
            sizes = np.array(row["n_tokens"], dtype=np.int64)
            last = np.cumsum(sizes)
            sums = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(last.tolist(), sizes.tolist())]
            columns = [[row["part"]] * len(sums), row["doc_ids"], (row["before"] + last - sizes).tolist(), row["n_tokens"], sums]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)


def chunk_index(spark: SparkSession, path: str) -> DataFrame:
    """part, chunk, start (global), n_ids, without reading a block."""
    chunks = spark.read.schema(SCHEMA).parquet(path).select("part", "chunk", "before", "n_ids")
    return chunks.join(part_starts(chunks), "part").select("part", "chunk", (F.col("first") + F.col("before")).alias("start"), "n_ids")


def part_starts(chunks: DataFrame) -> DataFrame:
    """Ids before each part; one row for each part, of which there are as many as write tasks."""
    sizes = chunks.groupBy("part").agg(F.sum("n_ids").alias("all"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    return sizes.select("part", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("first"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the file."""
    bounded_batches(spark)
    chunks = spark.read.schema(SCHEMA).parquet(path)
    found = chunks.mapInArrow(_documents, "part int, doc_id long, local long, n_tokens long, ids_crc32 long")
    starts = part_starts(chunks.select("part", "n_ids"))
    return found.join(starts, "part").select("doc_id", (F.col("first") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 1, planes: str = "byte") -> DataFrame:
    """Write the file to the shared folder and give what it holds for each document."""
    path = new_path(docs.sparkSession, "planes")
    write_planes(docs, path, tokenizer, end_id, planes)
    return read_documents(docs.sparkSession, path)
