"""One query per operator, over the whole supplied tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anchorline.api import Engine, Projection
from anchorline.config import Settings
from anchorline.functions import scalar as S
from anchorline.operators import blocks as B
from anchorline.operators import hop as H
from anchorline.operators import nearest as N
from anchorline.operators import pages as G
from anchorline.operators import project as P
from anchorline.plans import fixture as X
from anchorline.sources import axt as A
from anchorline.sources import collection as C
from anchorline.sources import text as T
from anchorline.sources.collecting import collect, stored_blocks
from anchorline.sources.ordered import write_lines
from anchorline.sources.sinks import formatted, write_tbl
from anchorline.storage import materialize, shared_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
REF, QRY = "sp0", "sp4"
SET = Settings()


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


#: Engines that a caller has made ready by ``prepare``; queries make their own where there is none.
_prepared: dict[tuple[str, str], Engine] = {}


def fresh_engine(spark: SparkSession, sf_dir: str) -> Engine:
    return Engine(X.blocks(spark, sf_dir), X.genomes(spark, sf_dir), SET)


def prepare(spark: SparkSession, sf_dir: str) -> None:
    """Builds the block index of these tables once for all later queries of this application: for tables that don't change."""
    made = fresh_engine(spark, sf_dir)
    made.index  # noqa: B018
    _prepared[spark.sparkContext.applicationId, sf_dir] = made


def engine(spark: SparkSession, sf_dir: str, wanted: str = "true") -> Engine:
    """An engine that has the blocks of the wanted pairs of species at least."""
    made = _prepared.get((spark.sparkContext.applicationId, sf_dir))
    return made or Engine(X.blocks(spark, sf_dir).where(wanted), X.genomes(spark, sf_dir), SET)


#: Pairs of species: the one pair, and those that a route can take (it never leaves the query nor comes back to the reference).
ONE_HOP, ON_ROUTES = f"ref_sp = '{REF}' and qry_sp = '{QRY}'", f"ref_sp <> '{QRY}' and qry_sp <> '{REF}'"


def projection(spark: SparkSession, sf_dir: str) -> Projection:
    """All regions from REF to QRY."""
    return engine(spark, sf_dir, ON_ROUTES).project(X.regions(spark, sf_dir), REF, QRY, X.targets(spark, sf_dir))


def hop_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The regions as points of one hop."""
    return X.regions(spark, sf_dir).select("region_idx", F.lit(REF).alias("ref_sp"), F.lit(QRY).alias("qry_sp"), F.col("chrom").alias("ref_chrom"), "loc")


def hop_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir, ONE_HOP)
    return H.hopped(hop_points(spark, sf_dir), e.index.of([REF], [QRY]), e.genomes, SET).select("region_idx", "hop.*")


def ended(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.with_ends(X.blocks(spark, sf_dir))


# scans and scalar functions


@query
def region_points(spark, d):
    lines = X.regions(spark, d).select("region_idx", F.concat_ws("\t", "chrom", F.col("start").cast("string"), F.col("end").cast("string"), "id").alias("value"))
    return T.parse_regions(lines).select("region_idx", "id", "chrom", "loc")


@query
def target_regions(spark, d):
    t = X.targets(spark, d)
    lines = t.select(F.concat_ws("\t", "chrom", F.col("start").cast("string"), F.col("end").cast("string"), "name").alias("value"))
    return T.parse_targets(lines).withColumnsRenamed({"start": "start_pos", "end": "end_pos"})


@query
def genome_sizes(spark, d):
    lines = X.view(spark, d, "customer").select(F.concat(F.lit("sp"), (F.col("c_nationkey") % 5).cast("string")).alias("species"), F.concat(F.lit("chr"), F.col("c_custkey").cast("string"), F.lit("\t"), (F.col("c_custkey") * 1000 + 7).cast("string")).alias("value"))
    return T.genome_sizes(lines)


@query
def species_list(spark, d):
    mark = F.when(F.col("s_suppkey") % 4 == 0, F.concat(F.lit("# "), "s_name")).when(F.col("s_suppkey") % 4 == 1, F.concat(F.col("s_suppkey").cast("string"), F.lit("  # "), "s_name")).otherwise(F.concat(F.lit("asm"), F.col("s_suppkey").cast("string")))
    return T.parse_species(X.view(spark, d, "supplier").select(mark.alias("value")))


def _chains(spark, d):
    """Each order as a chain, each of its lines as a block; even customers on the reverse strand."""
    line = F.struct(F.col("l_linenumber").alias("n"), (F.col("l_quantity").cast("long") + 1).alias("w"), (F.col("l_partkey") % 50).alias("dt"), (F.col("l_suppkey") % 30).alias("dq"))
    o = X.view(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("ls"), F.max("l_suppkey").alias("k"))
    text = lambda *c: F.concat_ws(" ", *[x.cast("string") for x in c])
    head = text(F.lit("1000"), F.concat(F.lit("chr"), (F.col("l_orderkey") % 3).cast("string")), F.lit("90000000"), F.lit("+"), F.col("l_orderkey") * 100, F.col("l_orderkey") * 100 + 500, F.concat(F.lit("chr"), (F.col("l_orderkey") % 2).cast("string")), F.lit("80000000"), F.when(F.col("k") % 2 == 0, "-").otherwise("+"), F.col("l_orderkey") * 90, F.col("l_orderkey") * 90 + 500, F.col("l_orderkey"))
    n = F.size("ls")
    body = F.transform("ls", lambda x, i: F.when(i == n - 1, x["w"].cast("string")).otherwise(text(x["w"], x["dt"], x["dq"])))
    return o.select("l_orderkey", F.concat_ws("\n", F.array(head), body, F.array(F.lit(""))).alias("chain"))


@query
def chain_blocks(spark, d):
    return T.parse_chains(_chains(spark, d)).dropDuplicates()


@query
def chain_tbl(spark, d):
    return T.tbl_rows(B.with_ends(T.parse_chains(_chains(spark, d)).dropDuplicates()))


@query
def tbl_blocks(spark, d):
    """The blocks of the chains, written as one block table and read from it."""
    path = f"{shared_dir(spark)}/anchorline/tbl-{uuid.uuid4().hex}/sp0.sp1.tbl"
    write_tbl(chain_tbl(spark, d), path)
    return T.read_tbl(spark, [path]).drop_duplicates()


@query
def collected_blocks(spark, d):
    """Chain files of two pairs of species (the orders of even and of odd customers), collected into a block table."""
    at = f"{shared_dir(spark)}/anchorline/collect-{uuid.uuid4().hex}"
    chains = _chains(spark, d).join(X.view(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_custkey") % 2).alias("odd")), "l_orderkey")
    for n, (ref, qry) in enumerate((("sp0", "sp1"), ("sp1", "sp0"))):
        own = chains.where(F.col("odd") == n).orderBy("l_orderkey").select(F.concat(F.lit("chain "), "chain").alias("line"))
        write_lines(own, f"{at}/{ref}.{qry}.all.pre.chain")
        write_lines(spark.range(1).select(F.lit("chr1"), F.lit("1000")), f"{at}/{ref}.sizes")
    collect(spark, at, at, ["sp0", "sp1"], f"{at}/table")
    return stored_blocks(spark, f"{at}/table")


def _axt(spark, d):
    """Each order as an axt record of its lines, with gaps on both sides between them; even suppliers on the reverse strand."""
    line = F.struct(F.col("l_linenumber").alias("n"), (F.col("l_quantity").cast("int") + 1).alias("w"), (F.col("l_partkey") % 50 + 1).cast("int").alias("dt"), (F.col("l_suppkey") % 30).cast("int").alias("dq"))
    o = X.view(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("ls"), F.max("l_suppkey").alias("k"))
    n = F.size("ls")
    side = lambda a, b: F.array_join(F.transform("ls", lambda x, i: F.concat(F.repeat(F.lit("A"), x["w"]), F.when(i < n - 1, F.concat(F.repeat(F.lit(a), x["dt"]), F.repeat(F.lit(b), x["dq"]))).otherwise(F.lit("")))), "")
    o = o.select("l_orderkey", "k", side("c", "-").alias("a"), side("-", "g").alias("b"))
    size = lambda c: F.length(F.replace(F.col(c), F.lit("-"), F.lit("")))
    text = lambda *c: F.concat_ws(" ", *[x.cast("string") for x in c])
    head = text(F.lit("0"), F.concat(F.lit("chr"), (F.col("l_orderkey") % 3).cast("string")), F.col("l_orderkey") * 100 + 1, F.col("l_orderkey") * 100 + size("a"), F.concat(F.lit("chr"), (F.col("l_orderkey") % 2).cast("string")), F.col("l_orderkey") * 90 + 1, F.col("l_orderkey") * 90 + size("b"), F.when(F.col("k") % 2 == 0, "-").otherwise("+"), F.lit("3500"))
    sizes = spark.range(2).select(F.concat(F.lit("chr"), F.col("id").cast("string")).alias("chrom"), F.lit(80_000_000).alias("size"))
    return A.parse_axt(o.select(F.concat_ws("\n", head, "a", "b").alias("axt"))), sizes


@query
def axt_blocks(spark, d):
    return A.axt_blocks(*_axt(spark, d)).dropDuplicates()


@query
def axt_tbl(spark, d):
    return A.axt_tbl(*_axt(spark, d))


@query
def block_ends(spark, d):
    return ended(spark, d)


@query
def strand_pack(spark, d):
    packed = X.blocks(spark, d).withColumn("word", S.pack(F.col("length"), F.col("qry_rev")))
    return packed.select("ref_sp", "qry_sp", "ref_start", "word", S.unpack_length(F.col("word")).alias("length"), S.unpack_reverse(F.col("word")).alias("qry_rev")).dropDuplicates()


@query
def decay_score(spark, d):
    o = X.regions(spark, d).withColumn("species", F.concat(F.lit("sp"), (F.col("region_idx") % 5).cast("string"))).join(X.genomes(spark, d), "species")
    up, down = F.col("start") - F.col("region_idx") % 4000 - 1, F.col("end") + F.col("region_idx") % 3000 + 1
    return o.select("region_idx", S.floor3(S.decay_score(F.col("loc"), up, down, F.col("genome_size"), SET)).alias("score"))


@query
def thresholds(spark, d):
    """The limits of each species as reference; one row a species."""
    limits = [(r.species, *SET.thresholds(r.genome_size)) for r in X.genomes(spark, d).collect()]
    return spark.createDataFrame(limits, "species string, dc double, ic double")


@query
def score_floor(spark, d):
    return X.view(spark, d, "events").select("event_id", S.floor3(F.col("event_id") % 9973 / 9973).alias("score"))


def _scored(spark, d):
    e = X.view(spark, d, "events")
    return e.select("event_id", (F.col("event_id") % 101 / 100).alias("direct"), (F.col("event_id") % 97 / 96).alias("multi"), F.when(F.col("user_id") % 3 == 0, "").when(F.col("user_id") % 3 == 1, "+").otherwise("-").alias("flag"))


@query
def seq_class(spark, d):
    return _scored(spark, d).select("event_id", S.sequence_class(F.col("direct"), F.col("multi"), 0.828, 0.207).alias("sequence_conservation"))


@query
def class_colour(spark, d):
    kind = F.concat(S.sequence_class(F.col("direct"), F.col("multi"), 0.828, 0.207), F.col("flag"))
    return _scored(spark, d).select("event_id", S.colour(kind).alias("item_rgb"))


@query
def coord_text(spark, d):
    return X.regions(spark, d).select("region_idx", S.coord_text(F.col("chrom"), F.col("loc")).alias("coords"))


@query
def name_cleanup(spark, d):
    o = X.regions(spark, d).withColumn("species", F.concat(F.lit("sp"), (F.col("region_idx") % 5).cast("string")))
    name = F.when(F.col("region_idx") % 3 == 0, F.concat("species", "species", F.lit("."), "chrom")).otherwise(F.concat("species", F.lit("_"), "chrom"))
    return o.select("region_idx", S.clean_chromosome(name, F.col("species"), F.col("region_idx") % 2 == 0).alias("name"))


@query
def species_pairs(spark, d):
    return B.ordered_pairs(X.genomes(spark, d))


# blocks


@query
def block_dedup(spark, d):
    b = X.blocks(spark, d)
    return b.unionByName(b.where("length % 2 = 0")).dropDuplicates()


@query
def block_ranks(spark, d):
    return B.block_ranks(ended(spark, d)).select(*B.PAIR, "ref_start", "ref_end", "qry_chrom", "qry_start", "qry_rev", "rn_start", "rn_end")


@query
def block_counts(spark, d):
    return B.chromosome_counts(X.blocks(spark, d))


@query
def max_anchor(spark, d):
    return B.longest_block(X.blocks(spark, d))


@query
def chrom_dict(spark, d):
    seen = X.view(spark, d, "lineitem").select(F.concat(F.lit("scaffold"), (F.col("l_partkey") % 700).cast("string")).alias("chrom"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))
    return B.chromosome_dictionary(seen)


@query
def chrom_runs(spark, d):
    return B.chromosome_runs(X.blocks(spark, d))


# anchors of one hop


def _sides(spark, d):
    """The regions, and both sides of each."""
    p = hop_points(spark, d)
    return p, engine(spark, d, ONE_HOP).index.of([REF], [QRY]).sides(p, SET)


@query
def asof_rank(spark, d):
    p, both = _sides(spark, d)
    rank = lambda kind, name: F.coalesce(F.max(F.when(F.col("kind") == kind, F.col("before"))), F.lit(0)).cast("long").alias(name)
    return p.select("region_idx").join(both, "region_idx", "left").groupBy("region_idx").agg(rank(G.DOWN, "k_start"), rank(G.UP, "k_end"))


def _listed(found: DataFrame, kind: str) -> DataFrame:
    """The blocks found with their ranks: those after the blocks passed (DOWN), or the last ones of these (UP)."""
    each = found.where(F.col("kind") == kind).select("region_idx", "before", F.size("found").alias("n"), F.posexplode("found").alias("i", "b"))
    rank = F.col("before") + F.col("i") + 1 - (F.col("n") if kind == G.UP else 0)
    return each.select("region_idx", rank.cast("long").alias("rn"), "b.ref_start", "b.ref_end", "b.qry_chrom", "b.qry_start")


@query
def nearest_down(spark, d):
    return _listed(_sides(spark, d)[1], G.DOWN)


@query
def nearest_up(spark, d):
    return _listed(_sides(spark, d)[1], G.UP)


@query
def stab_join(spark, d):
    e = engine(spark, d, f"ref_sp = '{REF}'")
    p = X.regions(spark, d).select("region_idx", F.lit(REF).alias("ref_sp"), F.col("chrom").alias("ref_chrom"), "loc").join(F.broadcast(X.genomes(spark, d).select(F.col("species").alias("qry_sp"))), F.col("qry_sp") != REF)
    return N.over(p, e.blocks.where(F.col("ref_sp") == REF)).select("region_idx", "qry_sp", "block.ref_start", "block.ref_end", "block.qry_chrom", "block.qry_start")


@query
def anchor_sides(spark, d):
    e, p = engine(spark, d, ONE_HOP), hop_points(spark, d)
    n = lambda k: F.aggregate("sides", F.lit(0).cast("long"), lambda t, x: t + F.when(x["kind"] == k, F.size(x["found"])).otherwise(0))
    return H.gathered(p, e.index.of([REF], [QRY]), SET).select("region_idx", n("u").alias("n_up"), n("o").alias("n_over"), n("d").alias("n_down"))


def _resolved(spark, d, chain=False):
    e = engine(spark, d, ONE_HOP)
    return H.resolved(hop_points(spark, d), e.index.of([REF], [QRY]), SET, chain).select("region_idx", "r.*")


@query
def major_chrom(spark, d):
    return _resolved(spark, d).select("region_idx", F.col("major").alias("chrom"))


@query
def major_filter(spark, d):
    return _resolved(spark, d).where("two_sided").select("region_idx", "n_kept")


@query
def collinear_chain(spark, d):
    c = _resolved(spark, d, chain=True).select("region_idx", F.posexplode("chain").alias("place", "a"))
    return c.select("region_idx", "place", "a.ref_start", "a.qry_start", "a.qry_rev")


@query
def hop_all(spark, d):
    return hop_results(spark, d).select("region_idx", "place", S.floor3(F.col("score")).alias("score"), "chrom", "at")


@query
def hop_aligned(spark, d):
    return hop_results(spark, d).where("up = down").select("region_idx", "place", "chrom", "at")


@query
def hop_interp(spark, d):
    return hop_results(spark, d).where("up <> down").select("region_idx", "chrom", "at", F.col("up.ref_end").alias("up_end"), F.col("down.ref_start").alias("down_start"))


@query
def direct_projection(spark, d):
    return hop_results(spark, d).where("place = 0").select("region_idx", S.floor3(F.col("score")).alias("score_direct"), S.coord_text(F.col("chrom"), F.col("at")).alias("coords_direct"))


# routes and result tables


@query
def route_best(spark, d):
    return projection(spark, d).table.select("region_idx", "score_multi", "n_inter", "coords_multi")


@query
def bridging(spark, d):
    return projection(spark, d).table.select("region_idx", "bridging_species")


@query
def half_life_direct(spark, d):
    """Direct scores where a score halves in half of the usual distance."""
    settings, points = replace(SET, half_life=SET.half_life // 2), hop_points(spark, d)
    e = engine(spark, d, ONE_HOP)
    found = H.hopped(points, e.index.of([REF], [QRY]), e.genomes, settings).select("region_idx", "hop.*")
    return found.where("place = 0").select("region_idx", S.floor3(F.col("score")).alias("score_direct"))


@query
def path_table(spark, d):
    return projection(spark, d).explain_paths().withColumn("score", S.floor3(F.col("score")))


@query
def stored_direct(spark, d):
    """Direct projections by a block index that was stored and opened again."""
    path = f"{shared_dir(spark)}/anchorline/index-{uuid.uuid4().hex}"
    engine(spark, d).save(path)
    e, points = Engine.open(spark, path, SET), hop_points(spark, d)
    found = H.hopped(points, e.index.of([REF], [QRY]), e.genomes, SET).select("region_idx", "hop.*")
    return found.where("place = 0").select("region_idx", S.floor3(F.col("score")).alias("score_direct"), S.coord_text(F.col("chrom"), F.col("at")).alias("coords_direct"))


@query
def proj_table(spark, d):
    return formatted(projection(spark, d).proj())


@query
def proj_anchors(spark, d):
    return formatted(projection(spark, d).proj(with_anchors=True))


@query
def bed9_ref(spark, d):
    return projection(spark, d).bed9("ref")


@query
def bed9_qry(spark, d):
    return projection(spark, d).bed9("qry")


@query
def unmapped(spark, d):
    return projection(spark, d).unmapped


@query
def class_counts(spark, d):
    p = projection(spark, d)
    mapped = p.table.groupBy("sequence_conservation", "functional_conservation").agg(F.count("*").alias("n"))
    return mapped.unionByName(p.unmapped.agg(F.lit("unmapped").alias("sequence_conservation"), F.lit("").alias("functional_conservation"), F.count("*").alias("n")))


@query
def func_class(spark, d):
    """Region centres against the targets."""
    r = X.regions(spark, d).select("region_idx", F.col("chrom").alias("multi_chrom"), F.col("loc").alias("multi_loc"))
    return P.with_function(r, X.targets(spark, d), SET).select("region_idx", F.col("functional_conservation").alias("flag"))


@query
def func_wide(spark, d):
    """Region centres against targets of all widths, up to a hundred million bases."""
    t = X.targets(spark, d).where("start % 97 = 0").withColumn("end", F.col("start") + F.pow(F.lit(10), F.col("start") % 9).cast("long"))
    r = X.regions(spark, d).select("region_idx", F.col("chrom").alias("multi_chrom"), F.col("loc").alias("multi_loc"))
    return P.with_function(r, t, SET).select("region_idx", F.col("functional_conservation").alias("flag"))


@query
def collection_blocks(spark, d):
    """The blocks, written as one binary collection and read from it in ranges."""
    path = f"{shared_dir(spark)}/anchorline/blocks-{uuid.uuid4().hex}.bin"
    # read several times: for its coordinates, its chromosomes and its rows
    b = materialize(X.blocks(spark, d), "collected")
    C.write_collection(b, X.genomes(spark, d), path, C.coordinate_bits(b))
    return C.read_collection(spark, path)


@query
def collection_sizes(spark, d):
    """The genome sizes, written with the largest block of each pair, and read from the headers."""
    path = f"{shared_dir(spark)}/anchorline/sizes-{uuid.uuid4().hex}.bin"
    b = X.blocks(spark, d)
    largest = b.groupBy(*B.PAIR).agg(F.max(F.struct("length", *[c for c in b.columns if c not in (*B.PAIR, "length")])).alias("b")).select(*B.PAIR, "b.*")
    largest = materialize(largest, "largest")
    C.write_collection(largest, X.genomes(spark, d), path, C.coordinate_bits(largest))
    return C.read_collection_sizes(spark, path)


@query
def dup_centres(spark, d):
    """Centres are rounded here, so that some are shared."""
    return P.named_by_last(X.regions(spark, d).withColumn("loc", F.floor(F.col("loc") / 2000))).select("region_idx", "id", "last_id")


@query
def unknown_chrom(spark, d):
    r = X.regions(spark, d).withColumn("chrom", F.when(F.col("region_idx") % 50 == 0, F.concat(F.lit("chrUn"), "chrom")).otherwise(F.col("chrom")))
    return P.on_unknown_chromosomes(r, X.blocks(spark, d)).select("region_idx", "chrom")


@query
def region_rank(spark, d):
    """Place of each region along its chromosome, by cells."""
    r = X.regions(spark, d).select(F.lit(REF).alias("ref_sp"), F.lit("").alias("qry_sp"), F.col("chrom").alias("ref_chrom"), "region_idx", "loc")
    return B.ranked(r, "loc", ["loc", "region_idx"], "rn").select("region_idx", "rn")

