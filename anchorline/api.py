"""The engine: blocks and genome sizes once, projections of any regions."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anchorline.config import Settings
from anchorline.operators import project as P
from anchorline.operators.blocks import with_ends
from anchorline.operators.hop import BlockIndex
from anchorline.operators.route import routes
from anchorline.sources import collection
from anchorline.sources.collecting import stored_blocks
from anchorline.storage import exists, identity, materialize, small


@dataclass
class Projection:
    """``table``: mapped regions; ``unmapped``: the others."""

    table: DataFrame
    unmapped: DataFrame

    def proj(self, with_anchors: bool = False) -> DataFrame:
        return P.anchor_columns(self.table) if with_anchors else self.table.select("region_idx", *P.PROJ)

    def bed9(self, which: str) -> DataFrame:
        return P.bed9(self.table, which)

    def explain_paths(self, simple: bool = False) -> DataFrame:
        """The routes of all regions, one row a species; ``simple`` subtracts the smallest coordinate of each row."""
        steps = self.table.select("region_idx", "id", F.posexplode("path").alias("step", "n")).select("region_idx", "id", "step", "n.*")
        ends = [f"{s}.{e}" for s in ("up", "down") for e in ("ref_start", "ref_end", "qry_start", "qry_end")]
        strand = F.when(F.col("up").isNull(), None).when(F.col("up.qry_start") < F.col("up.qry_end"), "+").otherwise("-")
        low = {k: F.least(*[F.col(e) for e in ends if k in e]) if simple else F.lit(0) for k in ("ref", "qry")}
        cols = [(F.col(e) - low["ref" if "ref" in e else "qry"]).alias(e.replace(".", "_")) for e in ends]
        return steps.select("region_idx", "id", "step", "species", "chrom", "loc", "score", strand.alias("strand"), *cols).orderBy("region_idx", "step")

    def explain_path(self, region_idx: int, simple: bool = False) -> DataFrame:
        """The route of one region."""
        return self.explain_paths(simple).where(F.col("region_idx") == region_idx).drop("region_idx")


class Engine:
    def __init__(self, blocks: DataFrame, genomes: DataFrame, settings: Settings | None = None):
        self.settings = settings or Settings()
        self._genomes = genomes
        self.blocks = with_ends(blocks)

    @classmethod
    def load(cls, spark: SparkSession, path: str, settings: Settings | None = None) -> Engine:
        """From a binary collection, or from a folder with the Parquet tables ``blocks`` and ``genomes``."""
        if exists(spark, f"{path}/blocks"):
            return cls(stored_blocks(spark, path), spark.read.parquet(f"{path}/genomes"), settings)
        return cls(collection.read_collection(spark, path), collection.read_collection_sizes(spark, path), settings)

    def save(self, path: str, source: str | None = None) -> None:
        """Stores the block index and the genome sizes; ``source``, the files that they come from, is held in the manifest by names, sizes and times."""
        self.genomes.write.mode("overwrite").parquet(f"{path}/genomes")
        files = identity(self.index.blocks.sparkSession, source) if source else None
        self.index.save(path, {"nearest": self.settings.nearest, "source": files})

    @classmethod
    def open(cls, spark: SparkSession, path: str, settings: Settings | None = None, source: str | None = None) -> Engine:
        """From a stored index, without building anything. An index of other settings, another version or changed source files is an error."""
        settings = settings or Settings()
        expected = {"nearest": settings.nearest} | ({"source": identity(spark, source)} if source else {})
        index, _ = BlockIndex.open(spark, path, **expected)
        made = cls(index.blocks, spark.read.parquet(f"{path}/genomes"), settings)
        made.__dict__["index"] = index
        return made

    @cached_property
    def genomes(self) -> DataFrame:
        """species, genome_size: one row a species, broadcast behind a count."""
        return small(materialize(self._genomes.select("species", F.col("genome_size").cast("long").alias("genome_size")), "genomes"))

    @cached_property
    def index(self) -> BlockIndex:
        return BlockIndex.build(self.blocks, self.settings)

    def genome_size(self, species: str) -> int:
        row = self.genomes.where(F.col("species") == species).first()
        if row is None:
            raise ValueError(f"unknown species {species}")
        return int(row.genome_size)

    def unknown(self, regions: DataFrame) -> DataFrame:
        """The regions on chromosomes that no species has in the blocks; they can't be mapped."""
        return P.on_unknown_chromosomes(regions, self.blocks)

    def project(self, regions: DataFrame, ref: str, qry: str, targets: DataFrame | None = None) -> Projection:
        """regions: region_idx, id, chrom, start, end, loc; targets: chrom, start, end on the query species."""
        limits = self.settings.thresholds(self.genome_size(ref))
        best, direct = routes(regions, self.index, self.genomes, ref, qry, self.settings)
        best = materialize(best, "routes")
        table = P.with_function(P.result_table(regions, best, direct, limits), targets, self.settings)
        return Projection(materialize(table, "projections"), P.unmapped(regions, best))

    @staticmethod
    def cancel(spark: SparkSession, tag: str) -> None:
        """Stops the jobs that were started under ``spark.addTag(tag)``."""
        spark.interruptTag(tag)
