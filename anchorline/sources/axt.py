"""Alignment nets in axt form: a header line, the two aligned sequences, an empty line.

The header has a number, the reference's chromosome, start and end, the query's chromosome, start and end, its strand and a score; positions
count from 1, on the query's own strand.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from anchorline.sources.text import TBL
from anchorline.storage import small

_RUNS = ArrayType(StructType([StructField("r", LongType()), StructField("q", LongType()), StructField("n", IntegerType())]))
#: The longest block that a collection can hold.
LONGEST = (1 << 15) - 1


def read_axt(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One row a record: files split between records, so that none is read by one task unless compressed. Columns: axt (its text), file."""
    return spark.read.option("lineSep", "\n\n").text(paths).select(F.col("value").alias("axt"), F.col("_metadata.file_name").alias("file"))


def parse_axt(records: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """records: axt. The header's fields and the sequences ``ref_text`` and ``qry_text``; comments and empty records are passed over, an incomplete one is an error."""
    lines = F.filter(F.split("axt", "\n"), lambda x: (F.trim(x) != "") & ~F.startswith(x, F.lit("#")))
    cut = records.select(*keep, F.explode(F.array(lines)).alias("lines")).where(F.size("lines") > 0)
    head = F.split(F.trim(F.get("lines", F.lit(0))), r"\s+")
    whole = (F.size("lines") == 3) & (F.size(head) >= 8) & (F.length(F.get("lines", F.lit(1))) == F.length(F.get("lines", F.lit(2))))
    cut = cut.select(*keep, F.when(whole, head).otherwise(F.raise_error(F.concat(F.lit("an axt record needs a header and two sequences of one length: "), F.get("lines", F.lit(0)))).cast("array<string>")).alias("h"), F.get("lines", F.lit(1)).alias("ref_text"), F.get("lines", F.lit(2)).alias("qry_text"))
    field = lambda i: F.get("h", F.lit(i))
    number = lambda i: field(i).cast("long")
    return cut.select(*keep, field(1).alias("ref_chrom"), number(2).alias("ref_start"), number(3).alias("ref_end"), field(4).alias("qry_chrom"), number(5).alias("qry_start"), number(6).alias("qry_end"), (field(7) == "-").alias("qry_rev"), "ref_text", "qry_text")


def _sized(parsed: DataFrame, sizes: DataFrame) -> DataFrame:
    """sizes: chrom, size (of the query). Reverse records on a chromosome without a size are an error."""
    known = parsed.join(small(sizes.select(F.col("chrom").alias("qry_chrom"), F.col("size").cast("long").alias("size"))), "qry_chrom", "left")
    missing = F.raise_error(F.concat(F.lit("no size is given for chromosome "), F.col("qry_chrom"))).cast("long")
    return known.withColumn("size", F.when(F.col("qry_rev") & F.col("size").isNull(), missing).otherwise(F.col("size")))


def axt_tbl(parsed: DataFrame, sizes: DataFrame) -> DataFrame:
    """Records as rows of a block table, gaps and all, with the numbers of the file; those of reverse queries are subtracted from the size."""
    flip = lambda c: F.when(F.col("qry_rev"), F.col("size") - F.col(c)).otherwise(F.col(c)).alias(c)
    return _sized(parsed, sizes).select(*[flip(c) if c in ("qry_start", "qry_end") else F.col(c) for c in TBL])


@F.arrow_udf(_RUNS)
def _runs(ref: pa.Array, qry: pa.Array) -> pa.Array:
    """Of each pair of sequences: the runs where neither has a gap, as offsets in both without gaps, and lengths of at most LONGEST."""
    cut, parts = [0], []
    for a, b in zip(ref.to_pylist(), qry.to_pylist(), strict=True):
        solid = [np.frombuffer(x.encode("latin-1", "replace"), np.uint8) != ord("-") for x in (a, b)]
        both = np.r_[False, solid[0] & solid[1], False]
        edge = np.flatnonzero(both[1:] != both[:-1])
        first, size = edge[::2], edge[1::2] - edge[::2]
        pieces = -(-size // LONGEST)
        within = (np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * LONGEST
        at, length = np.repeat(first, pieces) + within, np.minimum(np.repeat(size, pieces) - within, LONGEST)
        before = [np.r_[0, np.cumsum(s)][at] for s in solid]
        parts.append((*before, length))
        cut.append(cut[-1] + len(at))
    joined = [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in range(3)]
    runs = pa.StructArray.from_arrays([pa.array(joined[0], pa.int64()), pa.array(joined[1], pa.int64()), pa.array(joined[2], pa.int32())], ["r", "q", "n"])
    return pa.ListArray.from_arrays(pa.array(cut, pa.int32()), runs)


def axt_blocks(parsed: DataFrame, sizes: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The ungapped blocks of each record, counted from 0, as inclusive forward starts with length and strand."""
    each = _sized(parsed, sizes).select(*keep, "ref_chrom", "ref_start", "qry_chrom", "qry_start", "qry_rev", "size", F.explode(_runs("ref_text", "qry_text")).alias("p"))
    own = F.col("qry_start") + F.col("p.q")
    return each.select(*keep, "ref_chrom", (F.col("ref_start") - 1 + F.col("p.r")).alias("ref_start"), "qry_chrom", F.when(F.col("qry_rev"), F.col("size") - own).otherwise(own - 1).alias("qry_start"), F.col("p.n").alias("length"), "qry_rev")
