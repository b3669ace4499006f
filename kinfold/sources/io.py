"""Readers and writers of event tables, and event views of the star-schema test tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def normalized(name: str) -> str:
    """A column name without byte-order mark, with other signs than letters, digits and _ replaced."""
    clean = re.sub(r"\W+", "_", name.replace("﻿", "").strip()).strip("_")
    return f"_{clean}" if clean[:1].isdigit() else clean


def read_csv(spark: SparkSession, path: str, infer: bool = True) -> DataFrame:
    """CSV with header, empty fields as null, and normalised column names."""
    df = spark.read.option("header", True).option("nullValue", "").option("inferSchema", infer).csv(path)
    return df.toDF(*map(normalized, df.columns))


def read_arrow(spark: SparkSession, path: str) -> DataFrame:
    """Arrow IPC files (file or stream format), read on the executors, a file a task."""
    import pyarrow as pa

    def tables(raw: bytes):
        try:
            return pa.ipc.open_file(pa.BufferReader(raw)).read_all()
        except pa.ArrowInvalid:
            return pa.ipc.open_stream(pa.BufferReader(raw)).read_all()

    files = spark.read.format("binaryFile").load(path).select("content")
    first = files.limit(1).collect()
    if not first:
        raise FileNotFoundError(path)
    from pyspark.sql.pandas.types import from_arrow_schema

    schema = tables(bytes(first[0].content)).schema
    plain = pa.schema([pa.field(f.name, f.type.value_type if pa.types.is_dictionary(f.type) else f.type) for f in schema])

    def read(batches):
        for batch in batches:
            for raw in batch.column("content").to_pylist():
                yield from tables(raw).select(plain.names).cast(plain).to_batches(max_chunksize=10_000)

    return files.mapInArrow(read, from_arrow_schema(plain))


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """An event table by the path's ending: .arrow/.feather/.ipc, .csv, else Parquet."""
    if re.search(r"\.(arrow|feather|ipc)$", path):
        return read_arrow(spark, path)
    return read_csv(spark, path) if path.endswith(".csv") else spark.read.parquet(path)


def union_by_name(*parts: DataFrame) -> DataFrame:
    """All rows, with the union of the columns; what a part lacks is null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def write_arrow(df: DataFrame, path: str) -> None:
    """One Arrow IPC file on the driver; for results, not for event tables."""
    import pyarrow as pa

    data = df.toArrow()
    with pa.OSFile(path, "wb") as sink, pa.ipc.new_file(sink, data.schema) as out:
        out.write_table(data)


# Event views of the test tables.


def baskets(spark: SparkSession, sf_dir: str, item: str = "p_brand") -> DataFrame:
    """Orders as records: items are parts' brands (or types), groups market segments."""
    t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    lines = t("lineitem").select("l_orderkey", "l_partkey", F.year("l_shipdate").alias("year"))
    orders = t("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    customers = t("customer").select("c_custkey", F.col("c_mktsegment").alias("group"))
    parts = t("part").select(F.col("p_partkey").alias("l_partkey"), F.col(item).alias("item"))
    joined = lines.join(parts, "l_partkey").join(orders, "l_orderkey").join(customers, "c_custkey")
    return joined.select(F.col("l_orderkey").alias("id"), "item", "group", "year")


TOKEN = "[^a-zA-ZÀ-ÖØ-öø-ÿ]+"


def doc_tokens(spark: SparkSession, sf_dir: str, least: float = 0.04, most: float = 0.4, length: int = 4) -> DataFrame:
    """Documents as records: items are words that a share of ``least`` to ``most`` of documents has; groups languages."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text")
    words = F.explode(F.array_distinct(F.split(F.lower("text"), TOKEN)))
    tokens = docs.select(F.col("doc_id").alias("id"), words.alias("item"), F.col("lang").alias("group"))
    tokens = tokens.filter(F.length("item") >= length)
    total = docs.agg(F.count("*").alias("n"))
    counts = tokens.groupBy("item").agg(F.count("*").alias("k")).join(F.broadcast(total))
    kept = counts.filter((F.col("k") >= F.col("n") * least) & (F.col("k") <= F.col("n") * most)).select("item")
    return tokens.join(kept, "item", "left_semi")


def doc_words(spark: SparkSession, sf_dir: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, id, items: documents as records of all their distinct words, of any length and share of documents.

    Rows of one id (and keys) are one record, as in ``prep.transactions``. All signs of
    ``TOKEN`` are in Latin-1, so words are split as bytes.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), F.col("lang").alias("group"), F.lower("text").alias("text"))
    whole = docs.groupBy(*keys, "id").agg(F.concat_ws("\n", F.sort_array(F.collect_list("text"))).alias("text"))
    letters = re.compile(TOKEN)
    blanks = bytes(32 if letters.match(chr(c)) else c for c in range(256))

    def split(batches):
        import pyarrow as pa

        for batch in batches:
            found = [sorted({*t.encode("latin-1", "replace").translate(blanks).split()}) for t in batch.column("text").to_pylist()]
            items = pa.array([[w.decode("latin-1") for w in ws] for ws in found], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*keys, "id")), items], [*keys, "id", "items"])

    kinds = dict(whole.dtypes)
    return whole.mapInArrow(split, ", ".join(f"`{c}` {kinds[c]}" for c in (*keys, "id")) + ", items array<string>")


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's day of events as a record: items are event types, groups user ids modulo 3."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    return ev.select(
        F.concat_ws(":", F.col("user_id").cast("string"), F.to_date("ts").cast("string")).alias("id"),
        F.col("event_type").alias("item"),
        (F.col("user_id") % 3).cast("string").alias("group"),
        F.hour("ts").alias("year"),
    )
