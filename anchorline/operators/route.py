"""The best route of each region over the graph of species.

A label is a place of a region's search: species, chromosome, position, score, and what orders equal ones (the species and places
before it).  It knows the label before it by number only; anchors stay in the table of the hop that made it.  A round moves all
open labels one species on, in two phases: first to the query, which gives each region a score to beat, and then to the other species those
labels only that can still beat it (scores never grow along a route).  A state (region, species, place)
keeps the best of its labels in the order score, number of intermediate species, species, places; only improved states stay open.  There are at most as many rounds as species.  The nodes of a route, with their anchors, are looked up at the end, for winners only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from anchorline.config import Settings
from anchorline.operators.hop import ENDS, BlockIndex, hopped
from anchorline.storage import materialize

STATE = ["region_idx", "species", "chrom", "loc"]
NODE = f"struct<species:string,chrom:string,loc:bigint,score:double,up:{ENDS},down:{ENDS}>"
LABEL = [*STATE, "score", "n_inter", "through", "places", "id"]


def check_species(pairs: DataFrame, genomes: DataFrame, ref: str, qry: str) -> None:
    """Clear errors for what has no projection; one small job."""
    if ref == qry:
        raise ValueError("reference and query species are the same")
    known = {r.species for r in genomes.select("species").where(F.col("species").isin(ref, qry)).collect()}
    for name in (ref, qry):
        if name not in known:
            raise ValueError(f"unknown species {name}")


def species_pairs(blocks: DataFrame) -> DataFrame:
    """The ordered pairs of species that have blocks: at most 255 squared."""
    return blocks.select("ref_sp", "qry_sp").distinct()


def _moved(open_: DataFrame, pairs: DataFrame, to_query: bool, index: BlockIndex, genomes: DataFrame, qry: str, s: Settings, number: int) -> DataFrame | None:
    """All labels that a hop makes of open ones, with anchors, place in the hop, and the number of the label before."""
    known = pairs.where((F.col("qry_sp") == qry) == F.lit(to_query))
    at = [r.species for r in open_.select("species").distinct().collect()]
    if not at:
        return None
    step = open_.join(F.broadcast(known), open_["species"] == known["ref_sp"]).where(~F.array_contains("through", F.col("qry_sp"))).withColumnRenamed("chrom", "ref_chrom")
    part = index.of(at, [qry] if to_query else None)
    here = F.struct(F.col("hop.chrom").alias("chrom"), F.col("hop.at").alias("loc"))
    moved = hopped(step, part, genomes, s).select(
        "region_idx", F.col("qry_sp").alias("species"), F.col("hop.chrom").alias("chrom"), F.col("hop.at").alias("loc"), (F.col("score") * F.col("hop.score")).alias("score"),
        (F.col("n_inter") + int(not to_query)).alias("n_inter"), F.concat("through", F.array("qry_sp")).alias("through"), F.concat("places", F.array(here)).alias("places"), F.col("id").alias("parent"), "hop.up", "hop.down", "hop.place",
    )
    return materialize(moved.withColumn("id", F.lit(number << 53) + F.monotonically_increasing_id()), "route-moved")


def _best(labels: DataFrame, key: list[str], *then: str) -> DataFrame:
    """The first label of each key."""
    order = Window.partitionBy(*key).orderBy(F.desc("score"), "n_inter", "through", *then)
    return labels.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def routes(regions: DataFrame, index: BlockIndex, genomes: DataFrame, ref: str, qry: str, s: Settings) -> tuple[DataFrame, DataFrame]:
    """regions: region_idx, chrom, loc. Returns the best labels at the query, with their paths, and the first direct targets."""
    pairs = species_pairs(index.tails)
    check_species(pairs, genomes, ref, qry)
    pairs = materialize(pairs, "species-pairs")
    start = regions.select("region_idx", F.lit(ref).alias("species"), "chrom", "loc", F.lit(1.0).alias("score"), F.lit(0).alias("n_inter"), F.array(F.lit(ref)).alias("through"))
    start = start.withColumn("places", F.array().cast("array<struct<chrom: string, loc: bigint>>")).withColumn("id", F.monotonically_increasing_id())
    open_, labels, direct, best = materialize(start, "route-start"), None, None, None
    made: list[DataFrame] = []
    for number in range(pairs.select("ref_sp").distinct().count()):
        arrived = _moved(open_, pairs, True, index, genomes, qry, s, 2 * number + 1)
        if arrived is None:
            break
        made.append(arrived)
        if direct is None:
            direct = arrived.where("place = 0").select("region_idx", "chrom", "loc", "score", "up", "down")
        first = _best(arrived, ["region_idx"], "chrom", "loc", "places", "up", "down").select(*LABEL)
        best = materialize(first if best is None else _best(best.unionByName(first), ["region_idx"], "chrom", "loc", "places"), "route-best")
        to_beat = best.select("region_idx", F.col("score").alias("_best"))
        hopeful = lambda df: df.join(to_beat, "region_idx", "left").where("_best is null or score >= _best").drop("_best")  # noqa: E731,B023
        moved = _moved(materialize(hopeful(open_), "route-open"), pairs, False, index, genomes, qry, s, 2 * number + 2)
        if moved is None:
            break
        made.append(moved)
        fresh = _best(hopeful(moved), STATE, "places", "up", "down").select(*LABEL).withColumn("round", F.lit(number))
        labels = materialize(fresh if labels is None else _best(labels.unionByName(fresh), STATE, "places"), "route-labels")
        open_ = labels.where(F.col("round") == number).drop("round")
    if best is None:
        best = open_.where("false")
        direct = open_.where("false").select("region_idx", "chrom", "loc", "score", F.lit(None).cast(ENDS).alias("up"), F.lit(None).cast(ENDS).alias("down"))
    return _with_paths(best, regions, made, ref), direct


def _with_paths(best: DataFrame, regions: DataFrame, made: list[DataFrame], ref: str) -> DataFrame:
    """The best labels with the nodes of their routes, looked up from the last hop to the first."""
    none = F.lit(None).cast(ENDS)
    node = lambda up, down: F.struct("species", "chrom", "loc", "score", up.alias("up"), down.alias("down")).cast(NODE)
    walk = best.select("region_idx", "id", F.array().cast(f"array<{NODE}>").alias("path"))
    for hop in reversed(made):
        nodes = hop.select("id", "parent", node(F.col("up"), F.col("down")).alias("node"))
        walk = walk.join(nodes, "id", "left").select("region_idx", F.coalesce("parent", "id").alias("id"), F.when(F.col("node").isNull(), F.col("path")).otherwise(F.concat(F.array("node"), "path")).alias("path"))
    begin = regions.select("region_idx", F.lit(ref).alias("species"), "chrom", "loc", F.lit(1.0).alias("score")).select("region_idx", node(none, none).alias("node"))
    walk = walk.join(begin, "region_idx").select("region_idx", F.concat(F.array("node"), "path").alias("path"))
    return best.select("region_idx", "species", "chrom", "loc", "score", "n_inter").join(walk, "region_idx")
