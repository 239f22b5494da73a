"""Projects each arriving batch of region files against a fixed collection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from anchorline.api import Engine
from anchorline.sources.text import parse_regions
from anchorline.storage import materialize, small

#: Region numbers of a batch: its own number times this, plus the line.
BATCH = 1 << 40


def numbered_lines(lines: DataFrame, batch: int) -> DataFrame:
    """lines: value, file, block, n (grows along each block of a file). region_idx: batch * BATCH plus the place in the batch by file, block and line.

    A batch that comes again has the same files, and so the same numbers, however Spark packs these into tasks.
    """
    lines = materialize(lines, "stream-lines")
    # one row a block of a file
    of = lines.groupBy("file", "block").agg(F.min("n").alias("_first"), F.count("*").alias("_lines"))
    before = F.coalesce(F.sum("_lines").over(Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = small(materialize(of.withColumn("_before", before), "stream-blocks"))
    met = lines.join(at, ["file", "block"])
    return met.select((F.lit(batch * BATCH) + F.col("_before") + F.col("n") - F.col("_first")).alias("region_idx"), "value")


def project_stream(spark: SparkSession, engine: Engine, inbox: str, ref: str, qry: str, out: str, checkpoint: str, targets: DataFrame | None = None) -> StreamingQuery:
    """Writes the projections of every batch to ``out``/batch=N, once: a repeated batch overwrites its own folder with the same rows. The engine's index is opened or built once, before the first batch."""
    engine.index  # noqa: B018
    source = spark.readStream.text(inbox)
    lines = source.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))

    def batch(df: DataFrame, number: int) -> None:
        regions = parse_regions(numbered_lines(df.withColumn("n", F.monotonically_increasing_id()), number))
        engine.project(regions, ref, qry, targets).table.drop("path", "first", "last").write.mode("overwrite").parquet(f"{out}/batch={number}")

    return lines.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
