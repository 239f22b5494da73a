"""One hop: points of one species projected to another through collinear anchors."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from anchorline.config import Settings
from anchorline.functions import scalar as S
from anchorline.functions.chain import RESOLVED
from anchorline.operators import nearest as N
from anchorline.operators import pages as G
from anchorline.operators.blocks import CELL, PAIR
from anchorline.storage import materialize, small

KEYS = [*PAIR, "loc"]
ENDS = "struct<ref_start:bigint,ref_end:bigint,qry_start:bigint,qry_end:bigint>"
#: The form in which an index is stored, and the order of its tables within a pair and chromosome.
STORED_VERSION = 2
_INNER = {"blocks": "ref_start", "pages": "page", "finder": "_span", "tails": "first_page"}


@dataclass
class BlockIndex:
    """Blocks, their pages, and the finder of the pages: computed once for any number of hops.

    ``finder``, a row for each span of cells, and ``tails``, one for each chromosome of a pair, are broadcast behind a count.
    """

    blocks: DataFrame
    pages: DataFrame
    finder: DataFrame
    tails: DataFrame

    @classmethod
    def build(cls, blocks: DataFrame, s: Settings) -> BlockIndex:
        """Pages are written in ranges of the pair of species, so that a filter on the pair skips the rest of them."""
        blocks = materialize(blocks, "blocks")
        found, tails = G.finder(blocks)
        return cls(blocks, G.pages(blocks, found, tails, s.nearest), found, tails)

    def save(self, path: str, manifest: dict) -> None:
        """Writes the tables, each in folders by pair of species, and last the manifest: without it the index doesn't count as written."""
        spark = self.blocks.sparkSession
        rows = {}
        for name, df in self.tables().items():
            df.repartitionByRange(*PAIR, _INNER[name]).sortWithinPartitions(*PAIR, _INNER[name]).write.mode("overwrite").partitionBy("ref_sp", "qry_sp").parquet(f"{path}/{name}")
            rows[name] = spark.read.schema(df.schema).parquet(f"{path}/{name}").count()
        schemas = {name: json.loads(df.schema.json()) for name, df in self.tables().items()}
        written = json.dumps(manifest | {"version": STORED_VERSION, "cell": CELL, "rows": rows, "schemas": schemas}, sort_keys=True)
        spark.createDataFrame([(written,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")

    @classmethod
    def open(cls, spark: SparkSession, path: str, **expected) -> tuple[BlockIndex, dict]:
        """A stored index and its manifest; an error if it is incomplete, or if it was made with something else than expected."""
        try:
            manifest = json.loads(spark.read.text(f"{path}/manifest").first().value)
        except (AnalysisException, AttributeError):
            raise ValueError(f"no complete index in {path}") from None
        for name, value in ({"version": STORED_VERSION, "cell": CELL} | expected).items():
            if manifest.get(name) != value:
                raise ValueError(f"the index in {path} is stale: its {name} is {manifest.get(name)}, not {value}")
        found = {}
        for name in _INNER:
            schema = StructType.fromJson(manifest["schemas"][name])
            found[name] = spark.read.schema(schema).parquet(f"{path}/{name}").select(*schema.names)
            if (n := found[name].count()) != manifest["rows"][name]:
                raise ValueError(f"the index in {path} is damaged: {n} rows in {name}, not {manifest['rows'][name]}")
        for name in ("finder", "tails"):
            found[name] = small(found[name], manifest["rows"][name])
        return cls(**found), manifest

    def tables(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in _INNER}

    def of(self, ref: list[str], qry: list[str] | None = None) -> BlockIndex:
        """The part of some reference (and query) species: the filter reaches the scans."""
        part = lambda df: df.where(F.col("ref_sp").isin(ref) & (F.lit(True) if qry is None else F.col("qry_sp").isin(qry)))
        return BlockIndex(part(self.blocks), part(self.pages), part(self.finder), part(self.tails))

    def sides(self, points: DataFrame, s: Settings) -> DataFrame:
        """points (PAIR, loc, ...), a row for each side: kind, before (blocks passed, in ranks) and found, the nearest in rank order."""
        each = gathered(points, self, s).select(*points.columns, F.explode("sides").alias("side"))
        return each.where(F.col("side.kind") != G.OVER).select(*points.columns, "side.*")


def _at_pages(points: DataFrame, index: BlockIndex, s: Settings, *what) -> DataFrame:
    return N.at_pages(points, index.finder, index.tails, index.pages, s.nearest, *what)


def gathered(points: DataFrame, index: BlockIndex, s: Settings) -> DataFrame:
    """points (KEYS, ...) with ``sides``: the nearest blocks on either side (kind u and d) and those over it (o)."""
    return _at_pages(points, index, s, N.as_sides, "sides", N.SIDES)


def resolved(points: DataFrame, index: BlockIndex, s: Settings, chain: bool = False) -> DataFrame:
    """points (KEYS, ...) that have anchors, with ``r``: major (the commonest query chromosome), two_sided, n_kept (anchors on it), and what
    follows from the longest collinear chain of these, if it is two-sided and the chain is long enough: on, up, down and, if asked for, chain.
    """
    return _at_pages(points, index, s, N.as_resolved(s.least_chain, chain), "r", RESOLVED).where("r.major is not null")


def _ends(a: Column) -> Column:
    return F.struct(*[a[c].alias(c) for c in ("ref_start", "ref_end", "qry_start", "qry_end")])


def hopped(points: DataFrame, index: BlockIndex, genomes: DataFrame, s: Settings) -> DataFrame:
    """points (KEYS, ...) with each target, as ``hop``: place (in the chain), score, chrom, at, up, down.

    A point on alignments of its chain has one target per alignment, with score 1; else it has
    one target between the nearest anchors, if there is one on each side.
    """
    found = resolved(points, index, s).where("size(r.on) > 0 or (r.up is not null and r.down is not null)")
    loc = F.col("loc")
    cut = found.join(genomes.select(F.col("species").alias("ref_sp"), F.col("genome_size").alias("_size")), "ref_sp")
    up, down = F.col("r.up"), F.col("r.down")
    exact = lambda a: F.when(a["qry_rev"], a["qry_start"] - (loc - a["ref_start"])).otherwise(a["qry_start"] + (loc - a["ref_start"]))
    target = lambda score, at, u, d: F.struct(score.alias("score"), at.cast("long").alias("at"), _ends(u).alias("up"), _ends(d).alias("down"))
    between = F.array(target(S.decay_score(loc, up["ref_end"], down["ref_start"], F.col("_size"), s), S.interpolate(loc, up["ref_end"], down["ref_start"], up["qry_end"], down["qry_start"], up["qry_rev"]), up, down))
    targets = F.when(F.size("r.on") > 0, F.transform("r.on", lambda a: target(F.lit(1.0), exact(a), a, a))).when(up.isNotNull() & down.isNotNull(), between)
    each = cut.select(*points.columns, F.col("r.major").alias("_major"), F.posexplode(targets).alias("_place", "_t"))
    hop = F.struct(F.col("_place").alias("place"), F.col("_t.score").alias("score"), F.col("_major").alias("chrom"), F.col("_t.at").alias("at"), F.col("_t.up").alias("up"), F.col("_t.down").alias("down"))
    return each.select(*points.columns, hop.alias("hop"))


def hops(points: DataFrame, index: BlockIndex, genomes: DataFrame, s: Settings) -> DataFrame:
    """KEYS of each distinct point with each target: the columns of ``hopped``'s hop."""
    return hopped(points.select(*KEYS).distinct(), index, genomes, s).select(*KEYS, "hop.*")
