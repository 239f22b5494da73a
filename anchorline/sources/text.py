"""Text formats: BED regions and targets, chains, sizes, species lists, block tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from anchorline.functions import scalar as S

TBL = ["ref_chrom", "ref_start", "ref_end", "qry_chrom", "qry_start", "qry_end"]


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with an order: position of the block they were read in, then place in it."""
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))


def parse_regions(lines: DataFrame) -> DataFrame:
    """lines: region_idx, value. Four tab-separated columns are needed, more are ignored."""
    f = F.split("value", "\t")
    cell = lambda i: F.get(f, F.lit(i))
    checked = F.when(F.size(f) >= 4, cell(3)).otherwise(F.raise_error(F.concat(F.lit("a region needs chrom, start, end and name: "), F.col("value"))).cast("string"))
    rows = lines.where("value <> ''").select("region_idx", checked.alias("id"), cell(0).alias("chrom"), cell(1).cast("long").alias("start"), cell(2).cast("long").alias("end"))
    return rows.withColumn("loc", S.centre(F.col("start"), F.col("end")))


def read_regions(spark: SparkSession, path: str) -> DataFrame:
    """Regions of one BED file; region_idx grows in file order, with gaps."""
    lines = _lines(spark, path)
    # blocks are numbered by their start, so that the order holds however Spark packs them into tasks
    return parse_regions(lines.select((F.col("block") * 4 + F.col("n").bitwiseAND((1 << 33) - 1)).alias("region_idx"), "value"))


def parse_targets(lines: DataFrame) -> DataFrame:
    """lines: value. Three tab-separated columns are needed, the fourth is the name."""
    f = F.split("value", "\t")
    rows = lines.where("value <> '' and not startswith(value, '#')")
    return rows.select(f[0].alias("chrom"), f[1].cast("long").alias("start"), f[2].cast("long").alias("end"), F.get(f, F.lit(3)).alias("name"))


def read_targets(spark: SparkSession, path: str) -> DataFrame:
    return parse_targets(spark.read.text(path))


def read_chains(spark: SparkSession, path: str) -> DataFrame:
    """One row a chain: its text without the leading word. A chain is one record, so that files split between chains."""
    rows = spark.read.option("lineSep", "\nchain ").text(path)
    clean = F.regexp_replace("value", r"(?m)^#.*$", "")
    return rows.select(F.regexp_replace(clean, r"^\s*chain ", "").alias("chain"), F.col("_metadata.file_name").alias("file")).where(F.trim("chain") != "")


@F.arrow_udf(ArrayType(LongType()))
def _running(steps: pa.Array) -> pa.Array:
    """Of each list of steps: the sum of those before each."""
    cut = np.asarray(steps.offsets).astype(np.int64)
    cut -= cut[0]
    flat = np.asarray(steps.flatten()).astype(np.int64)
    before = np.cumsum(flat) - flat
    size = np.diff(cut)
    before -= np.repeat(before[np.minimum(cut[:-1], max(len(before) - 1, 0))] if len(before) else np.zeros(len(size), np.int64), size)
    return pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(before))


def parse_chains(chains: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """chains: chain. The blocks of each chain, as inclusive forward starts with length and strand.

    The running offsets of a chain are sums over its own lines, in time linear in
    these: nothing is sorted or shuffled.
    """
    lines = F.filter(F.split("chain", "\n"), lambda x: F.trim(x) != "")
    head = F.split(F.trim(F.get(lines, F.lit(0))), r"\s+")
    body = F.transform(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: F.transform(F.split(F.trim(x), r"\s+"), lambda v: v.cast("long")))
    # a generator's output is computed once, whatever uses it
    cut = chains.select(*keep, F.explode(F.array(F.struct(head.alias("h"), body.alias("b")))).alias("c")).select(*keep, "c.h", "c.b")
    field = lambda i: F.get(F.col("h"), F.lit(i))
    cut = cut.withColumns({"ref_chrom": field(1), "t_strand": field(3), "t_start": field(4).cast("long"), "qry_chrom": field(6), "q_size": field(7).cast("long"), "qry_rev": field(8) == "-", "q_start": field(9).cast("long")})
    step = lambda i: F.transform("b", lambda x: x[0] + F.coalesce(F.get(x, F.lit(i)), F.lit(0)))
    each = cut.where("t_strand = '+'").withColumn("r", _running(step(1))).withColumn("q", _running(step(2)))
    each = each.select(*keep, "ref_chrom", "qry_chrom", "q_size", "qry_rev", "t_start", "q_start", F.explode(F.arrays_zip(F.transform("b", lambda x: x[0]).alias("n"), "r", "q")).alias("p"))
    return each.select(*keep, "ref_chrom", (F.col("t_start") + F.col("p.r")).alias("ref_start"), "qry_chrom", S.flip(F.col("q_start") + F.col("p.q"), F.col("q_size"), F.col("qry_rev")).alias("qry_start"), F.col("p.n").cast("int").alias("length"), "qry_rev")


def pair_chains(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The chains of files named {ref}.{qry}.all.pre.chain, with ref_sp and qry_sp."""
    chains = spark.read.option("lineSep", "\nchain ").text(paths)
    clean = F.regexp_replace(F.regexp_replace("value", r"(?m)^#.*$", ""), r"^\s*chain ", "")
    name = F.split(F.col("_metadata.file_name"), r"\.")
    return chains.select(clean.alias("chain"), name[0].alias("ref_sp"), name[1].alias("qry_sp")).where(F.trim("chain") != "")


def collect_blocks(spark: SparkSession, chain_dir: str, species: list[str]) -> DataFrame:
    """Blocks of all ordered pairs of species, from files {ref}.{qry}.all.pre.chain, without duplicates."""
    paths = [f"{chain_dir}/{a}.{b}.all.pre.chain" for a in species for b in species if a != b]
    return parse_chains(pair_chains(spark, paths), ("ref_sp", "qry_sp")).dropDuplicates()


def genome_sizes(lines: DataFrame) -> DataFrame:
    """lines: species, value ('chrom size'). The sum of each species' sizes."""
    return lines.groupBy("species").agg(F.sum(F.split(F.trim("value"), r"\s+")[1].cast("long")).alias("genome_size"))


def read_sizes(spark: SparkSession, sizes_dir: str, species: list[str]) -> DataFrame:
    rows = spark.read.text([f"{sizes_dir}/{x}.sizes" for x in species])
    return genome_sizes(rows.where("trim(value) <> ''").select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.sizes$", 1).alias("species"), "value"))


def parse_species(lines: DataFrame) -> DataFrame:
    """The first field of each line of ``value`` that isn't a comment."""
    return lines.where("trim(value) <> '' and not startswith(value, '#')").select(F.split(F.trim("value"), r"\s+")[0].alias("species"))


def read_species(spark: SparkSession, path_or_list: str) -> list[str]:
    """Species of a file, or of a comma-separated list."""
    if "," in path_or_list:
        return [x.strip() for x in path_or_list.split(",") if x.strip()]
    return [r.species for r in parse_species(spark.read.text(path_or_list)).collect()]


def read_tbl(spark: SparkSession, paths: list[str], missing_allowed: bool = False) -> DataFrame:
    """Blocks of six-column tables named {ref}.{qry}.tbl; both ends are inclusive."""
    schema = ", ".join(f"{c} {'string' if 'chrom' in c else 'long'}" for c in TBL)
    reader = spark.read.schema(schema).option("sep", "\t").option("ignoreMissingFiles", missing_allowed)
    name = F.split(F.col("_metadata.file_name"), r"\.")
    rows = reader.csv(paths).select("*", name[0].alias("ref_sp"), name[1].alias("qry_sp"))
    return rows.select("ref_sp", "qry_sp", "ref_chrom", "ref_start", "qry_chrom", "qry_start", (F.col("ref_end") - F.col("ref_start") + 1).cast("int").alias("length"), (F.col("qry_start") > F.col("qry_end")).alias("qry_rev"))


def tbl_rows(blocks: DataFrame) -> DataFrame:
    """Blocks (with ends) as rows of a block table."""
    return blocks.select(*TBL)
