"""Proportional stratified interleaving into shards [DataFrame functions only]."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_scratch, scratch

_ROW = (1 << 33) - 1


def stratified_shards(docs: DataFrame, shards: int = 16, seed: int = 20, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Deal every row into `shards` shards, each with the mixture of sources of the whole.

    Rows are ranked within their source in a seeded pseudo-random order; the fractional ranks
    (rank + 1/2) / (rows of the source) of all sources are merged into one order, which is cut
    into equal runs. Counts differ by at most one, and so does each source's share of a shard
    from its exact proportion, up to ties.

    Ranks come from range-partitioned sorts plus offsets per partition, so a hot source spreads
    over many tasks and no window spans the table. Only ids, sizes and hashes are shuffled.

    Null text has size 1 and crc32 0; a null source is a source of its own; repeated rows are each
    dealt; an empty table gives an empty result; other columns are ignored. More shards than rows
    leave shards empty. Returns id, source, size, text_crc32, shard, slot.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.when(F.col(source_col).isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col(source_col).cast("string")))
    base = docs.select(
        F.col(id_col).alias("id"), F.octet_length(text).cast("long").alias("bytes"), F.crc32(text).alias("crc"), key.alias("src"),
    ).withColumn("h", F.xxhash64(F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit("null"))))
    base = scratch(base, "shard-base")

    order = ["src", "h", "id", "bytes", "crc"]
    ranked = base.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("mid", F.monotonically_increasing_id())
    ranked = scratch(ranked.select("*", F.shiftright("mid", 33).alias("pid"), F.col("mid").bitwiseAND(F.lit(_ROW)).alias("i")).drop("mid"), "shard-rank")
    part = ranked.groupBy("src", "pid").agg(F.min("i").alias("first"), F.count("*").alias("n"))
    by_src = Window.partitionBy("src")
    part = part.select("src", "pid", (F.sum("n").over(by_src.orderBy("pid")) - F.col("n") - F.col("first")).alias("shift"), F.sum("n").over(by_src).alias("total"))
    frac = ranked.join(part, ["src", "pid"]).select("id", "bytes", "crc", "src", "h", ((F.col("i") + F.col("shift") + F.lit(0.5)) / F.col("total")).alias("frac"))

    order = ["frac", "src", "h", "id", "bytes", "crc"]
    merged = scratch(frac, "shard-frac")
    placed = merged.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("mid", F.monotonically_increasing_id())
    placed = scratch(placed.select("id", "bytes", "crc", "src", F.shiftright("mid", 33).alias("pid"), F.col("mid").bitwiseAND(F.lit(_ROW)).alias("i")), "shard-placed")
    # One row per partition of the sort: as few as there are shuffle partitions.
    parts = placed.groupBy("pid").agg(F.count("*").alias("n"))
    whole = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    parts = parts.select("pid", (F.sum("n").over(Window.orderBy("pid")) - F.col("n")).alias("before"), F.sum("n").over(whole).alias("rows"))
    out = placed.join(F.broadcast(parts), "pid")
    # Whole-number division, so that the cuts are exact for any count.
    out = out.withColumn("shard", F.expr(f"((i + before) * {shards}L) div rows"))
    out = out.withColumn("slot", F.expr(f"i + before - ((shard * rows + {shards - 1}L) div {shards}L)"))
    drop_scratch(base)
    drop_scratch(ranked)
    drop_scratch(merged)
    return out.select(F.col("id").alias("doc_id"), F.when(F.col("src") == "-", F.lit(None)).otherwise(F.substring("src", 2, 1 << 30)).alias("source"), (F.col("bytes") + 1).alias("size"), F.col("crc").alias("text_crc32"), F.col("shard").cast("int").alias("shard"), "slot")
