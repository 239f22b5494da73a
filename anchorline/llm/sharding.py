"""Sharding by proportional stratified interleaving.

Rows are shuffled by a seeded hash within their source; the i-th of a source's n
rows gets the fractional rank (i - 1 + u) / n, with an offset u in [0, 1) of the
source, so that small sources don't all fall on one place.  Sorting by it spreads
each source evenly, and cutting the sorted rows into equal runs gives shards
whose numbers of rows differ by one at most and whose mixture is the whole's.

Neither rank is taken by one task: the hash, uniform by nature, deals the rows of
a source to cells of about CELL_ROWS rows, whose counts, summed up in order, give
each cell's first rank; the same holds for the fractional ranks.  Only doc_id,
source, size and checksum are shuffled, never the texts.

Law: rows.  Defined results: a null text has size 8 and the checksum of no bytes;
a null source is a source of its own; rows alike in all of this are
interchangeable; a very long text is one row, placed like any other; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from anchorline.llm.common import materialize, table

CELL_ROWS, CELLS_PER_TASK = 20_000, 8
SEED = "shards-1"
_TWO32 = 1 << 32


def _u32(hex_digits: Column) -> Column:
    return F.conv(F.substring(hex_digits, 1, 8), 16, 10).cast("long")


def stratified_shards(docs: DataFrame, n_shards: int = 24, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, text_crc32, shard, slot of every row."""
    raw = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", "source", (F.octet_length(raw) + 8).cast("long").alias("size"), F.crc32(raw.cast("binary")).alias("text_crc32"), F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")).alias("h"))
    rows = materialize(rows, "shard-rows")
    n = rows.count()
    # more cells than tasks, so that no task has several at once; ranks don't depend on their number
    cells = max(1, -(-n // CELL_ROWS), min(n, CELLS_PER_TASK * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))

    rows = rows.withColumn("cell", F.expr(f"(cast(conv(substring(h, 1, 8), 16, 10) as bigint) * {cells}) div {_TWO32}"))
    by_source = Window.partitionBy("source")
    counts = rows.groupBy("source", "cell").agg(F.count("*").alias("c"))
    counts = counts.select("source", "cell", (F.sum("c").over(by_source.orderBy("cell")) - F.col("c")).alias("before"), F.sum("c").over(by_source).alias("n_source"))
    counts = counts.select(F.col("source").alias("source_"), F.col("cell").alias("cell_"), "before", "n_source")
    ranked = rows.withColumn("rn", F.row_number().over(Window.partitionBy("source", "cell").orderBy("h", "doc_id", "size", "text_crc32")))
    ranked = ranked.join(counts, ranked["source"].eqNullSafe(counts["source_"]) & (ranked["cell"] == counts["cell_"]))
    rank = F.col("before") + F.col("rn")
    offset = _u32(F.md5(F.concat(F.lit(f"{seed}/"), F.coalesce(F.col("source"), F.lit(""))).cast("binary"))) / float(_TWO32)
    ranked = ranked.select("doc_id", "source", "size", "text_crc32", rank.alias("rank"), ((rank - 1 + offset) / F.col("n_source")).alias("fraction"))
    ranked = materialize(ranked.withColumn("run", F.least(F.floor(F.col("fraction") * cells), F.lit(cells - 1))), "shard-ranks")

    runs = ranked.groupBy("run").agg(F.count("*").alias("c"))
    runs = runs.select(F.col("run").alias("run_"), (F.sum("c").over(Window.orderBy("run")) - F.col("c")).alias("ahead"))
    placed = ranked.withColumn("rn", F.row_number().over(Window.partitionBy("run").orderBy("fraction", F.col("source").asc_nulls_last(), "rank")))
    placed = placed.join(runs, placed["run"] == runs["run_"])
    placed = placed.withColumn("pos", F.col("ahead") + F.col("rn") - 1)
    shard = F.expr(f"(pos * {n_shards}) div {max(n, 1)}")
    placed = placed.withColumn("shard", shard)
    first = F.expr(f"(shard * {n} + {n_shards - 1}) div {n_shards}")
    return placed.select("doc_id", "source", "size", "text_crc32", F.col("shard").cast("int"), (F.col("pos") - first).cast("long").alias("slot"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = stratified_shards(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")
