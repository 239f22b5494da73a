"""Species, blocks, regions and targets derived from the supplied tables.

Five species, three chromosomes; odd species carry reversed coordinates, so that
routes compose.  The SQL is the same for Spark and for the comparison.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BLOCKS = """
select distinct concat('sp', cast(r as varchar(9))) ref_sp, concat('sp', cast(q as varchar(9))) qry_sp, rc ref_chrom,
  case when r % 2 = 0 then p else 40000000 - (p + len - 1) end ref_start, qc qry_chrom, (r % 2) <> (q % 2) qry_rev, len length,
  case when q % 2 = 0 then case when r % 2 = 0 then pq else pq + len - 1 end
       else case when r % 2 = 1 then 40000000 - (pq + len - 1) else 40000000 - pq end end qry_start
from (
  select *, p + (k * (q + 1)) % 60 + case when k % 13 = 0 then (k * 37) % 5000 else 0 end pq
  from (
    select cast(l_suppkey % 5 as int) r, cast((l_suppkey % 5 + 1 + l_linenumber % 4) % 5 as int) q,
      concat('chr', cast(1 + l_orderkey % 3 as varchar(9))) rc,
      concat('chr', cast(1 + (case when l_partkey % 11 = 0 then l_orderkey + 1 else l_orderkey end) % 3 as varchar(9))) qc,
      200 * l_orderkey + l_partkey % 90 p, 6 * cast(l_quantity as int) + 1 len, l_partkey k
    from lineitem) a
  where not (abs(r - q) = 4 and k % 7 <> 0) and not (r = 0 and q = 3 and k % 307 <> 0)) b
"""
REGIONS = """
select o_orderkey region_idx, concat('peak_', cast(o_orderkey as varchar(12))) id, concat('chr', cast(1 + o_orderkey % 3 as varchar(9))) chrom,
  200 * o_orderkey + o_custkey % 150 start_pos, 200 * o_orderkey + o_custkey % 150 + 1 + o_custkey % 101 end_pos
from orders
"""
TARGETS = """
select concat('chr', cast(1 + event_id % 3 as varchar(9))) chrom, 1500 * event_id + user_id start_pos,
  1500 * event_id + user_id + 20 + cast(floor(value / 4) as bigint) end_pos, concat('t', cast(event_id as varchar(12))) name
from events
"""
GENOMES = """
select concat('sp', cast(n as varchar(9))) species, cast(300000000 as bigint) * (n + 1) genome_size from (select distinct cast(l_suppkey % 5 as bigint) n from lineitem) t
"""


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _run(spark: SparkSession, sf_dir: str, sql: str, table: str) -> DataFrame:
    return spark.sql(sql.replace(f"from {table}", f"from {{{table}}}"), **{table: view(spark, sf_dir, table)})


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _run(spark, sf_dir, BLOCKS, "lineitem")
    return df.selectExpr("ref_sp", "qry_sp", "ref_chrom", "cast(ref_start as long) ref_start", "qry_chrom", "cast(qry_start as long) qry_start", "length", "qry_rev")


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _run(spark, sf_dir, REGIONS, "orders")
    return df.selectExpr("region_idx", "id", "chrom", "start_pos start", "end_pos end", "cast(floor((start_pos + end_pos) / 2) as long) loc")


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, TARGETS, "events").selectExpr("chrom", "start_pos start", "end_pos end", "name")


def genomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, GENOMES, "lineitem")
