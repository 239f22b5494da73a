"""Writers. Result files are single files in the order of the regions, joined from sorted parts; each takes the place of an earlier one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anchorline.operators.project import PROJ, bed9
from anchorline.sources.ordered import write_lines

#: The anchor columns of a file, in its order; fixed names.
ANCHOR_HEADER = {f"{kind}_{side}_{near}_{end}": f"{side}_anchor_{kind}_{name}_{end}" for side in ("ref", "qry") for kind in ("direct", "multi") for near, name in (("up", "left"), ("down", "right")) for end in ("start", "end")}


def formatted(table: DataFrame) -> DataFrame:
    """Scores as text with three decimals."""
    return table.withColumns({c: F.format_string("%.3f", c) for c, t in table.dtypes if t == "double"})


def write_projections(table: DataFrame, path: str) -> None:
    """One header; the order is the regions'."""
    cols = [c for c in PROJ if c in table.columns] + [F.col(c).alias(name) for c, name in ANCHOR_HEADER.items() if c in table.columns]
    write_lines(formatted(table.orderBy("region_idx")).select(*cols), path, header=True)


def write_bed9(table: DataFrame, which: str, path: str) -> None:
    write_lines(bed9(table, which).orderBy("region_idx").drop("region_idx"), path)


def write_unmapped(names: DataFrame, path: str) -> None:
    write_lines(names.orderBy("region_idx").select("id"), path)


def write_blocks(blocks: DataFrame, path: str) -> None:
    """The native form of a collection: Parquet by pair of species, so that other pairs are never read."""
    blocks.write.mode("overwrite").partitionBy("ref_sp", "qry_sp").parquet(path)


def write_tbl(rows: DataFrame, path: str) -> None:
    write_lines(rows.orderBy("ref_chrom", "ref_start"), path)
