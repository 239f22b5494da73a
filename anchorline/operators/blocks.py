"""Alignment blocks: derived columns, ranks, dictionaries and statistics.

Ranks never come from one window over a chromosome: positions are dealt to cells
of CELL bases, counts per cell are summed up, and rows are numbered within their
cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from anchorline.functions import scalar as S

CELL = 32_768
PAIR = ["ref_sp", "qry_sp", "ref_chrom"]


def with_ends(blocks: DataFrame) -> DataFrame:
    """Inclusive ends; blocks without length are no anchors."""
    return blocks.where("length > 0").withColumns({"ref_end": S.ref_end(F.col("ref_start"), F.col("length")), "qry_end": S.qry_end(F.col("qry_start"), F.col("length"), F.col("qry_rev"))})


def cell_of(position: Column) -> Column:
    return F.floor(position / CELL).cast("long")


def ranked(df: DataFrame, position: str, order: list, name: str) -> DataFrame:
    """Adds the rank of each row within its PAIR; ``order`` begins with ``position``."""
    cell = f"_{name}_cell"
    df = df.withColumn(cell, cell_of(F.col(position)))
    before = df.groupBy(*PAIR, cell).agg(F.count("*").alias("_n"))
    before = before.withColumn("_before", F.sum("_n").over(Window.partitionBy(*PAIR).orderBy(cell)) - F.col("_n")).drop("_n")
    df = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*PAIR, cell).orderBy(*order)))
    return df.join(before, [*PAIR, cell]).withColumn(name, F.col("_before") + F.col("_rn")).drop("_rn", "_before", cell)


START_ORDER = ["ref_start", "qry_chrom", "qry_start", "qry_rev", "length"]
END_ORDER = ["ref_end", "ref_start", "qry_start", "qry_chrom", "qry_rev"]


def block_ranks(blocks: DataFrame) -> DataFrame:
    """blocks (with ends) with their ranks by start and by end."""
    return ranked(ranked(blocks, "ref_start", START_ORDER, "rn_start"), "ref_end", END_ORDER, "rn_end")


def chromosome_dictionary(seen: DataFrame) -> DataFrame:
    """seen: chrom, ord. Ids in order of first appearance; one row a chromosome passes the window."""
    first = seen.groupBy("chrom").agg(F.min("ord").alias("ord"))
    return first.select((F.row_number().over(Window.orderBy("ord", "chrom")) - 1).cast("long").alias("chrom_id"), "chrom")


def chromosome_counts(blocks: DataFrame) -> DataFrame:
    """Blocks of each chromosome of each pair of species."""
    return blocks.groupBy(*PAIR).agg(F.count("*").alias("n_blocks"))


def longest_block(blocks: DataFrame) -> DataFrame:
    return blocks.agg(F.max("length").alias("max_length"))


def ordered_pairs(species: DataFrame) -> DataFrame:
    """All ordered pairs of different species (at most 255 of them)."""
    return species.select(F.col("species").alias("ref_sp")).join(species.select(F.col("species").alias("qry_sp")), F.col("ref_sp") != F.col("qry_sp"))


def chromosome_runs(blocks: DataFrame) -> DataFrame:
    """The ordered chromosomes of each pair of species, and where each begins: the groups of a written collection."""
    w = Window.partitionBy("ref_sp", "qry_sp").orderBy("ref_chrom")
    return chromosome_counts(blocks).withColumn("first_row", F.sum("n_blocks").over(w) - F.col("n_blocks")).withColumn("previous", F.lag("ref_chrom").over(w))
