"""Command line: project the regions of a BED file from one species to another."""

from __future__ import annotations

import argparse
import os

from pyspark.sql import SparkSession

from anchorline.api import Engine
from anchorline.config import Settings
from anchorline.sources import sinks
from anchorline.sources.text import read_regions, read_targets
from anchorline.storage import cancelled_by_signals, exists, scratch


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("regions"), p.add_argument("ref"), p.add_argument("qry"), p.add_argument("collection")
    p.add_argument("-o", "--out_dir", default=".")
    p.add_argument("-sdc", "--score_DC", type=float, default=Settings.score_dc)
    p.add_argument("-sic", "--score_IC", type=float, default=Settings.score_ic)
    number = lambda x: None if x == "none" else float(x)
    p.add_argument("-ddc", "--distance_DC", type=number, default=Settings.distance_dc, help="'none': use the score")
    p.add_argument("-dic", "--distance_IC", type=number, default=Settings.distance_ic, help="'none': use the score")
    p.add_argument("-dfc", "--distance_FC", type=float, default=Settings.distance_fc)
    p.add_argument("-hl", "--half_life", type=int, default=Settings.half_life)
    p.add_argument("-n", "--n_cores", default="*")
    p.add_argument("-t", "--target_bedfile")
    p.add_argument("-q", "--quiet", action="store_true", help="no progress and no closing line")
    p.add_argument("-v", "--verbose", action="store_true", help="print each region's route")
    p.add_argument("-c", "--simple_coords", action="store_true", help="with -v: subtract the smallest coordinate of each step")
    p.add_argument("-a", "--include_anchors", action="store_true")
    p.add_argument("-x", "--index", help="folder of the stored block index: opened if it is there, else made from the collection")
    a = p.parse_args(argv)
    spark = SparkSession.builder.master(f"local[{a.n_cores}]").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", str(not a.quiet).lower()).getOrCreate()
    s = Settings(half_life=a.half_life, distance_dc=a.distance_DC, distance_ic=a.distance_IC, score_dc=a.score_DC, score_ic=a.score_IC, distance_fc=a.distance_FC)
    regions, targets = read_regions(spark, a.regions), read_targets(spark, a.target_bedfile) if a.target_bedfile else None
    with cancelled_by_signals(spark), scratch(spark):
        if a.index and exists(spark, f"{a.index}/manifest"):
            engine = Engine.open(spark, a.index, s, a.collection)
        else:
            engine = Engine.load(spark, a.collection, s)
            if a.index:
                engine.save(a.index, a.collection)
                engine = Engine.open(spark, a.index, s, a.collection)
        done = engine.project(regions, a.ref, a.qry, targets)
        base = os.path.join(a.out_dir, os.path.splitext(os.path.basename(a.regions))[0])
        sinks.write_unmapped(done.unmapped, f"{base}.{a.ref}-{a.qry}.unmapped")
        n = done.table.count()
        if n:
            sinks.write_projections(done.proj(a.include_anchors), f"{base}.{a.ref}-{a.qry}.proj")
            for which, species in (("ref", a.ref), ("qry", a.qry)):
                sinks.write_bed9(done.table, which, f"{base}.{species}.bed")
        if a.verbose:
            for row in done.explain_paths(a.simple_coords).toLocalIterator():
                print(*["" if x is None else x for x in row], sep="\t")
        if not a.quiet:
            print(f"{n} regions projected to {base}.{a.ref}-{a.qry}.proj")


if __name__ == "__main__":
    main()
