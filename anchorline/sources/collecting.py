"""The block table of many pairs of species, kept up to date pair by pair.

Folder: ``blocks`` (Parquet by pair of species), ``genomes``, and ``inputs``, which has the name, size and time of each pair's
chain file as it was collected.  A pair whose file is as it was is left alone; the others take the place of their own part only.
"""

from __future__ import annotations

import argparse
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anchorline.sources import collection
from anchorline.sources import text as T
from anchorline.storage import delete, exists, identity


@dataclass
class Collected:
    """The pairs that were written, those that were left alone, and the chain files that aren't there."""

    written: list[tuple[str, str]]
    unchanged: list[tuple[str, str]]
    missing: list[str]


def collect(spark: SparkSession, chain_dir: str, sizes_dir: str, species: list[str], out: str, allow_missing: bool = False) -> Collected:
    """Brings the table in ``out`` up to date with the files {ref}.{qry}.all.pre.chain of all ordered pairs. The ``inputs`` are written last: a run that was ended is repeated."""
    pairs = [(a, b) for a in species for b in species if a != b]
    name = lambda p: f"{p[0]}.{p[1]}.all.pre.chain"
    missing = [name(p) for p in pairs if not exists(spark, f"{chain_dir}/{name(p)}")]
    if missing and not allow_missing:
        raise FileNotFoundError(f"no {', '.join(missing)} in {chain_dir}")
    known = {r.file: r.identity for r in spark.read.parquet(f"{out}/inputs").collect()} if exists(spark, f"{out}/inputs") else {}
    now = {p: json.dumps(identity(spark, f"{chain_dir}/{name(p)}")) for p in pairs if name(p) not in missing}
    changed = [p for p in now if known.get(name(p)) != now[p]]
    if changed:
        blocks = T.parse_chains(T.pair_chains(spark, [f"{chain_dir}/{name(p)}" for p in changed]), ("ref_sp", "qry_sp")).dropDuplicates()
        blocks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("ref_sp", "qry_sp").parquet(f"{out}/blocks")
        # a file without chains leaves what its pair had before
        found = {tuple(r) for r in stored_blocks(spark, out).select("ref_sp", "qry_sp").distinct().collect()}
        filled = {tuple(r) for r in blocks.select("ref_sp", "qry_sp").distinct().collect()}
        delete(spark, [f"{out}/blocks/ref_sp={a}/qry_sp={b}" for a, b in changed if (a, b) in found - filled])
    T.read_sizes(spark, sizes_dir, species).coalesce(1).write.mode("overwrite").parquet(f"{out}/genomes")
    inputs = known | {name(p): now[p] for p in now}
    if changed:
        spark.createDataFrame(sorted(inputs.items()), "file string, identity string").coalesce(1).write.mode("overwrite").parquet(f"{out}/inputs")
    return Collected(changed, [p for p in now if p not in changed], missing)


def stored_blocks(spark: SparkSession, out: str) -> DataFrame:
    """The blocks of a collected table; names of species are text whatever they look like."""
    return spark.read.schema(collection.SCHEMA).parquet(f"{out}/blocks").select(*[x.split()[0] for x in collection.SCHEMA.split(", ")])


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description="Collect the alignment blocks of all pairs of species; pairs whose files haven't changed are left alone.")
    p.add_argument("chain_dir"), p.add_argument("assembly_dir"), p.add_argument("species", help="names with commas between them, or a file"), p.add_argument("out_dir")
    p.add_argument("-m", "--missing_allowed", action="store_true")
    p.add_argument("-b", "--binary", help="also write a binary collection to this file")
    a = p.parse_args(argv)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    species = T.read_species(spark, a.species)
    done = collect(spark, a.chain_dir, a.assembly_dir, species, a.out_dir, a.missing_allowed)
    if a.binary:
        listed = F.col("ref_sp").isin(species) & F.col("qry_sp").isin(species)
        collection.write_collection(stored_blocks(spark, a.out_dir).where(listed), spark.read.parquet(f"{a.out_dir}/genomes"), a.binary)
    print(f"{len(done.written)} pairs written, {len(done.unchanged)} unchanged, {len(done.missing)} missing")
    for name in done.missing:
        print(f"missing: {name}")


if __name__ == "__main__":
    main()
