"""Result tables of a projection: scores, classes, overlap with targets, tracks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anchorline.config import Settings
from anchorline.functions import scalar as S
from anchorline.operators.blocks import CELL


def result_table(regions: DataFrame, best: DataFrame, direct: DataFrame, thresholds: tuple[float, float]) -> DataFrame:
    """One row per mapped region, without the functional flag; anchors as structs."""
    d = direct.select("region_idx", *[F.col(c).alias(f"direct_{c}") for c in ("chrom", "loc", "score", "up", "down")])
    m = best.select("region_idx", F.col("chrom").alias("multi_chrom"), F.col("loc").alias("multi_loc"), F.col("score").alias("multi_score"), "path", "n_inter")
    t = regions.join(m, "region_idx").join(d, "region_idx", "left")
    t = t.withColumns({
        "score_direct": S.floor3(F.coalesce("direct_score", F.lit(0.0))),
        "score_multi": S.floor3(F.col("multi_score")),
        "coords_ref": S.coord_text(F.col("chrom"), F.col("loc")),
        "coords_direct": S.coord_text(F.col("direct_chrom"), F.col("direct_loc")),
        "coords_multi": S.coord_text(F.col("multi_chrom"), F.col("multi_loc")),
        "bridging_species": F.array_join(F.transform(F.slice("path", 2, F.greatest(F.size("path") - 2, F.lit(0))), lambda n: n["species"]), ","),
        "first": F.element_at("path", 2),
        "last": F.element_at("path", -1),
    })
    return t.withColumn("sequence_conservation", S.sequence_class(F.col("score_direct"), F.col("score_multi"), *thresholds))


#: Cells of level n are CELL * FAN**n bases wide; from level 1 on they are dealt to at most SALTS parts.
FAN, LEVELS, SALTS = 8, 12, 64


def _by_level(level: Column, value) -> Column:
    """value(n) for the level n, up to LEVELS."""
    return F.element_at(F.array(*[F.lit(value(n)) for n in range(LEVELS + 1)]), level + 1)


def overlapping(points: DataFrame, targets: DataFrame, gap: float) -> DataFrame:
    """The distinct points (chrom, loc, ...) that lie within gap of a target: an interval semi join.

    A target stands in the one or two cells that it touches on the level whose cells are as wide as it or wider, so that its rows don't grow with
    its width; a point asks the levels that there are.  Cells of wide levels hold many points: these are dealt to parts, which have the (few)
    wide targets each.
    """
    wide = targets.select(F.col("chrom").alias("_chrom"), (F.col("start") - gap).alias("_a"), (F.col("end") + gap).alias("_b")).where("_b > _a")
    level = F.lit(LEVELS)
    for n in reversed(range(LEVELS)):
        level = F.when(F.col("_b") - F.col("_a") <= CELL * FAN**n, n).otherwise(level)
    width, parts = _by_level(F.col("_level"), lambda n: CELL * FAN**n), _by_level(F.col("_level"), lambda n: min(FAN**n, SALTS))
    placed = wide.withColumn("_level", level)
    # at most LEVELS + 1 numbers
    levels = sorted(r._level for r in placed.select("_level").distinct().collect())
    placed = placed.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("_a") / width).cast("long"), F.floor((F.col("_b") - 1) / width).cast("long"))))
    placed = placed.withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1)))
    p = points.withColumn("_level", F.explode(F.array(*[F.lit(n) for n in levels]).cast("array<int>")))
    p = p.withColumn("_cell", F.floor(F.col("loc") / width).cast("long")).withColumn("_part", F.pmod(F.xxhash64(*points.columns), parts).cast("int"))
    same = [p[c] == placed[c] for c in ("_level", "_cell", "_part")]
    met = p.join(placed, [p["chrom"] == placed["_chrom"], *same, p["loc"] >= placed["_a"], p["loc"] < placed["_b"]], "left_semi")
    return met.drop("_level", "_cell", "_part").distinct()


def with_function(table: DataFrame, targets: DataFrame | None, s: Settings) -> DataFrame:
    """functional_conservation: '' without targets, else + for regions whose projection is near one."""
    if targets is None:
        return table.withColumn("functional_conservation", F.lit(""))
    near = overlapping(table.select("region_idx", F.col("multi_chrom").alias("chrom"), F.col("multi_loc").alias("loc")), targets, s.distance_fc)
    near = near.select("region_idx", F.lit("+").alias("functional_conservation"))
    return table.join(near, "region_idx", "left").fillna({"functional_conservation": "-"})


PROJ = ["id", "coords_ref", "coords_direct", "coords_multi", "score_direct", "score_multi", "sequence_conservation", "functional_conservation", "bridging_species"]


def anchor_columns(table: DataFrame) -> DataFrame:
    """The table with the sixteen anchor columns."""
    def four(side: str, up, down, kind: str) -> dict:
        return {f"{kind}_{side}_{w}_{e}": x[f"{side}_{e}"] for w, x in (("up", up), ("down", down)) for e in ("start", "end")}

    cols = four("ref", F.col("direct_up"), F.col("direct_down"), "direct")
    cols |= four("ref", F.col("first.up"), F.col("first.down"), "multi")
    cols |= four("qry", F.col("direct_up"), F.col("direct_down"), "direct")
    cols |= four("qry", F.col("last.up"), F.col("last.down"), "multi")
    return table.select("region_idx", *PROJ, *[c.alias(k) for k, c in cols.items()])


def bed9(table: DataFrame, which: str) -> DataFrame:
    """Nine-column track of the reference or the query side."""
    own, other = ("chrom", "loc"), "coords_multi"
    if which == "qry":
        own, other = ("multi_chrom", "multi_loc"), "coords_ref"
    kind = F.concat("sequence_conservation", "functional_conservation")
    start = F.col(own[1])
    return table.select(
        "region_idx", F.col(own[0]).alias("chrom"), start.alias("start"), (start + 1).alias("end"), F.concat_ws("_", "id", other, kind).alias("name"), F.col("score_multi").alias("score"),
        F.lit(".").alias("strand"), start.alias("thick_start"), (start + 1).alias("thick_end"), S.colour(kind).alias("item_rgb"),
    )


def named_by_last(regions: DataFrame) -> DataFrame:
    """Regions whose centre is shared, with the name (last_id) that the centre has where the last region of it names them all."""
    last = regions.groupBy("chrom", "loc").agg(F.max_by("id", "region_idx").alias("last_id"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    return regions.join(last, ["chrom", "loc"])


def on_unknown_chromosomes(regions: DataFrame, blocks: DataFrame) -> DataFrame:
    """Regions on a chromosome that no block has on either side."""
    known = blocks.select(F.col("ref_chrom").alias("chrom")).unionByName(blocks.select(F.col("qry_chrom").alias("chrom"))).distinct()
    return regions.join(known, "chrom", "left_anti")


def unmapped(regions: DataFrame, best: DataFrame) -> DataFrame:
    return regions.join(best.select("region_idx"), "region_idx", "left_anti").select("region_idx", "id")
