"""Sharding by proportional stratified interleaving, in DataFrame operations only.

Rows are shuffled within each source by a seeded hash of their id, ranked there,
sorted by the fractional rank ``(rank + 0.5) / rows of the source`` and cut into
shards whose row counts differ by at most one. Every shard so holds the mixture of
sources of the whole.

Both rankings are distributed. The hash is uniform, and so are fractional ranks: a
source is split into ranges of the hash with about ``bucket_rows`` rows each, rows are
numbered within a range only, and the ranges' counts are summed before. A source with
a third of all rows is thus as many tasks as its size asks for.

Defined results: null text has size 8 and crc32 0; null source is a source of its own;
a null id is ranked like an id of its own; repeated rows each get a slot; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinfold.llm.common import materialize, running_offsets

LAW = "rows"
SALTS = 64


def shuffle_key(doc_id: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))


def stratified_interleave(
    docs: DataFrame,
    n_shards: int = 24,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    bucket_rows: int = 2048,
) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, source_rank, source_rows."""
    base = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("null")).alias("stratum"),
        F.col(text_col).cast("string").alias("text"),
    ).withColumn("key", shuffle_key(F.col("doc_id"), seed))
    # A source's size goes out ``SALTS`` times, so that no task gets all rows of a hot source to add it to.
    sizes = base.groupBy("stratum").agg(F.count("*").alias("source_rows"))
    sizes = sizes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumn("salt", F.col("salt").cast("long"))

    def ranges(df: DataFrame) -> DataFrame:
        head = F.conv(F.substring("key", 1, 8), 16, 10)
        salted = df.withColumns({"share": head.cast("double") / F.lit(2.0**32), "salt": head.cast("long") % SALTS})
        joined = salted.join(sizes, ["stratum", "salt"])
        return joined.withColumn("part", F.floor(F.col("share") * F.ceil(F.col("source_rows") / bucket_rows))).drop("share", "salt")

    counts = ranges(base.select("stratum", "key")).groupBy("stratum", "part").agg(F.count("*").alias("n"))
    before = running_offsets(counts, ["stratum"], "part", "n")
    slim = ranges(
        base.select(
            "doc_id",
            "stratum",
            "key",
            (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
            F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        )
    )
    within = W.partitionBy("stratum", "part").orderBy("key", "doc_id", "text_crc32", "size")
    # Dealt by both keys: a join on the source alone would leave a hot source in one task.
    dealt = slim.repartition("stratum", "part")
    ranked = dealt.withColumn("at", F.row_number().over(within)).join(before, ["stratum", "part"])
    ranked = ranked.withColumn("source_rank", F.col("before") + F.col("at") - 1)
    ranked = ranked.withColumn("fraction", (F.col("source_rank") + 0.5) / F.col("source_rows"))
    ranked = materialize(ranked.select("doc_id", "stratum", "size", "text_crc32", "source_rank", "source_rows", "fraction"), "interleave")

    total = ranked.count()
    n_ranges = max(1, -(-total // bucket_rows))
    ranked = ranked.withColumn("range", F.floor(F.col("fraction") * n_ranges))
    starts = running_offsets(ranked.groupBy("range").agg(F.count("*").alias("n")), [], "range", "n")
    order = W.partitionBy("range").orderBy("fraction", "stratum", "source_rank")
    placed = ranked.withColumn("at", F.row_number().over(order)).join(starts, "range")
    placed = placed.withColumn("position", F.col("before") + F.col("at") - 1)
    shard = F.expr(f"((position + 1) * {n_shards} - 1) div {max(1, total)}")
    placed = placed.withColumn("shard", shard.cast("int"))
    slot = F.col("position") - F.expr(f"(shard * cast({total} as bigint)) div {n_shards}")
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit(LAW).alias("law"),
        "shard",
        slot.cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        F.col("source_rank").cast("long").alias("source_rank"),
        F.col("source_rows").cast("long").alias("source_rows"),
    )


#: The same law in one global sort; DuckDB has no crc32, so it is built bit by bit.
SQL = """
with crc as (
  select list(list_reduce(range(0, 8), lambda c, k: case when c % 2 = 1 then xor(3988292384, c >> 1) else c >> 1 end, n)
              order by n) as t
  from range(0, 256) r(n)),
bytes as (
  select doc_id, source, text, rowid_ as r, coalesce(strlen(text), 0) + 8 as size,
    case when coalesce(text, '') = '' then 0::bigint else xor(4294967295::bigint, list_reduce(
      list_transform(range(0, strlen(text)), lambda i: ('0x' || substr(hex(encode(text)), 2 * i::int + 1, 2))::bigint),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::bigint)) end as text_crc32
  from (select *, row_number() over () as rowid_ from documents), crc),
ranked as (
  select *, row_number() over (partition by source order by md5('17:' || coalesce(doc_id::varchar, 'null')), doc_id, text_crc32, size) - 1 as source_rank,
    count(*) over (partition by source) as source_rows
  from bytes),
placed as (
  select *, row_number() over (order by (source_rank + 0.5::double) / source_rows, coalesce('=' || source, 'null'), source_rank) - 1 as position,
    count(*) over () as n
  from ranked)
select doc_id, size::bigint as size, text_crc32::bigint as text_crc32, 'rows' as law,
  (((position + 1) * 24 - 1) // n)::int as shard,
  (position - ((((position + 1) * 24 - 1) // n) * n) // 24)::bigint as slot,
  null::int as grown_shard, source_rank::bigint as source_rank, source_rows::bigint as source_rows
from placed
"""
