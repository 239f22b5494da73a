"""SQL of the registered queries."""

from __future__ import annotations

from anchorline.functions.scalar import COLOURS
from anchorline.plans import fixture as X
from anchorline.plans import route_oracle as O

_B = f"blocks as ({X.BLOCKS})"
_E = f"{_B}, ended as (select *, ref_start + length - 1 as ref_end, case when qry_rev then qry_start - length + 1 else qry_start + length - 1 end as qry_end from blocks where length > 0)"
_R = f"regions as (select region_idx, id, chrom, start_pos, end_pos, cast(floor((start_pos + end_pos) / 2) as bigint) as loc from ({X.REGIONS}) r0)"
_T = f"targets as ({X.TARGETS})"
_G = f"genomes as ({X.GENOMES})"
_RANKS = f"""{_E}, ranks as (
  select *, row_number() over (partition by ref_sp, qry_sp, ref_chrom order by ref_start, qry_chrom, qry_start, qry_rev, length) as rn_start,
    row_number() over (partition by ref_sp, qry_sp, ref_chrom order by ref_end, ref_start, qry_start, qry_chrom, qry_rev) as rn_end from ended)"""
_PAIR = f"""{_RANKS}, {_R}, hop as (select * from ranks where ref_sp = 'sp0' and qry_sp = 'sp4'),
  s as (select ref_chrom, ref_start, max(rn_start) as k from hop group by 1, 2), e as (select ref_chrom, ref_end, max(rn_end) as k from hop group by 1, 2),
  k1 as (select region_idx, chrom, loc, coalesce(s.k, 0) as k_start from regions asof left join s on regions.chrom = s.ref_chrom and regions.loc >= s.ref_start),
  ks as (select region_idx, chrom, loc, k_start, coalesce(e.k, 0) as k_end from k1 asof left join e on k1.chrom = e.ref_chrom and k1.loc > e.ref_end),
  down as (select region_idx, rn_start as rn, ref_start, ref_end, h.qry_chrom, qry_start from ks join hop h on h.ref_chrom = ks.chrom and h.rn_start between k_start + 1 and k_start + 20),
  up as (select region_idx, rn_end as rn, ref_start, ref_end, h.qry_chrom, qry_start from ks join hop h on h.ref_chrom = ks.chrom and h.rn_end between k_end - 19 and k_end),
  o as (select region_idx, ref_start, ref_end, h.qry_chrom, qry_start from regions r join hop h on h.ref_chrom = r.chrom and h.ref_start <= r.loc and r.loc <= h.ref_end),
  a as (select region_idx, 'u' as side, qry_chrom from up union all select region_idx, 'd', qry_chrom from down union all select region_idx, 'o', qry_chrom from o),
  m as (select region_idx, qry_chrom as chrom from (select region_idx, qry_chrom, row_number() over (partition by region_idx order by count(*) desc, qry_chrom) as n from a group by 1, 2) where n = 1)"""
_SCORED = "scored as (select event_id, event_id % 101 / 100 as direct, event_id % 97 / 96 as multi, case user_id % 3 when 0 then '' when 1 then '+' else '-' end as flag from events)"
_CLASS = "case when direct >= 0.828 then 'DC' when multi >= 0.207 then 'IC' else 'NC' end"
_CHAIN = """c as (
  select l_orderkey, l_linenumber, cast(l_quantity as bigint) + 1 as w, l_partkey % 50 as dt, l_suppkey % 30 as dq, max(l_suppkey) over (partition by l_orderkey) % 2 = 0 as qry_rev,
    row_number() over (partition by l_orderkey order by l_linenumber, cast(l_quantity as bigint) + 1, l_partkey % 50, l_suppkey % 30) as n from lineitem),
  f as (select *, coalesce(sum(w + dt) over p, 0) as ra, coalesce(sum(w + dq) over p, 0) as qa from c window p as (partition by l_orderkey order by n rows between unbounded preceding and 1 preceding)),
  cb as (select distinct 'chr' || l_orderkey % 3 as ref_chrom, cast(l_orderkey * 100 + ra as bigint) as ref_start, 'chr' || l_orderkey % 2 as qry_chrom,
    cast(case when qry_rev then 80000000 - (l_orderkey * 90 + qa) - 1 else l_orderkey * 90 + qa end as bigint) as qry_start, cast(w as int) as length, qry_rev from f)"""

_AXT = """c as (
  select l_orderkey, cast(l_quantity as bigint) + 1 as w, l_partkey % 50 + 1 as dt, l_suppkey % 30 as dq, max(l_suppkey) over (partition by l_orderkey) % 2 = 0 as qry_rev,
    row_number() over (partition by l_orderkey order by l_linenumber, cast(l_quantity as bigint) + 1, l_partkey % 50, l_suppkey % 30) as n from lineitem),
  f as (select *, coalesce(sum(w + dt) over p, 0) as ra, coalesce(sum(w + dq) over p, 0) as qa from c window p as (partition by l_orderkey order by n rows between unbounded preceding and 1 preceding)),
  ax as (select l_orderkey, 'chr' || l_orderkey % 3 as ref_chrom, 'chr' || l_orderkey % 2 as qry_chrom, l_orderkey * 100 + ra as r0, l_orderkey * 90 + qa as q0, w, qry_rev from f)"""

ORACLE_SQL = {
    "region_points": f"with {_R} select region_idx, id, chrom, loc from regions",
    "target_regions": f"with {_T} select * from targets",
    "genome_sizes": "select 'sp' || c_nationkey % 5 as species, cast(sum(c_custkey * 1000 + 7) as bigint) as genome_size from customer group by 1",
    "species_list": "select case when s_suppkey % 4 = 1 then cast(s_suppkey as varchar) else 'asm' || s_suppkey end as species from supplier where s_suppkey % 4 <> 0",
    "chain_blocks": f"with {_CHAIN} select * from cb",
    "chain_tbl": f"with {_CHAIN} select ref_chrom, ref_start, ref_start + length - 1 as ref_end, qry_chrom, qry_start, case when qry_rev then qry_start - length + 1 else qry_start + length - 1 end as qry_end from cb",
    "tbl_blocks": f"with {_CHAIN} select distinct 'sp0' as ref_sp, 'sp1' as qry_sp, ref_chrom, ref_start, qry_chrom, qry_start, length, qry_start > case when qry_rev then qry_start - length + 1 else qry_start + length - 1 end as qry_rev from cb",
    "collected_blocks": f"""with {_CHAIN.replace("f as (select *,", "f as (select c.*, o_custkey % 2 as odd,").replace("from c window", "from c join orders on o_orderkey = l_orderkey window").replace("cb as (select distinct", "cb as (select distinct 'sp' || odd as ref_sp, 'sp' || (1 - odd) as qry_sp,")} select * from cb""",
    "axt_blocks": f"with {_AXT} select distinct ref_chrom, cast(r0 as bigint) as ref_start, qry_chrom, cast(case when qry_rev then 80000000 - q0 - 1 else q0 end as bigint) as qry_start, cast(w as int) as length, qry_rev from ax",
    "axt_tbl": f"""with {_AXT}, e as (select l_orderkey, ref_chrom, qry_chrom, qry_rev, l_orderkey * 100 + 1 as a, max(r0 + w) as b, l_orderkey * 90 + 1 as s, max(q0 + w) as t from ax group by all)
      select ref_chrom, cast(a as bigint) as ref_start, cast(b as bigint) as ref_end, qry_chrom, cast(case when qry_rev then 80000000 - s else s end as bigint) as qry_start, cast(case when qry_rev then 80000000 - t else t end as bigint) as qry_end from e""",
    "block_ends": f"with {_E} select * from ended",
    "strand_pack": f"with {_B} select distinct ref_sp, qry_sp, ref_start, length + case when qry_rev then 32768 else 0 end as word, length, qry_rev from blocks",
    "decay_score": f"with {_R}, {_G} select region_idx, floor(pow(0.5, (least(loc - (start_pos - region_idx % 4000 - 1), end_pos + region_idx % 3000 + 1 - loc) / 10000.0::double) * (2728222451.0::double / genome_size)) * 1000) / 1000 as score from regions join genomes on species = 'sp' || region_idx % 5",
    "thresholds": f"with {_G} select species, round(pow(0.5, 818466735300.0::double / (genome_size * 10000)), 3) as dc, round(pow(0.5, 6820556127500.0::double / (genome_size * 10000)), 3) as ic from genomes",
    "score_floor": "select event_id, floor((event_id % 9973 / 9973) * 1000) / 1000 as score from events",
    "seq_class": f"with {_SCORED} select event_id, {_CLASS} as sequence_conservation from scored",
    "class_colour": f"with {_SCORED} select event_id, case {_CLASS} || flag " + " ".join(f"when '{k}' then '{v}'" for k, v in COLOURS.items()) + " end as item_rgb from scored",
    "coord_text": f"with {_R} select region_idx, chrom || ':' || loc as coords from regions",
    "name_cleanup": f"with {_R} select region_idx, case when region_idx % 2 = 0 then replace(n, s || s, s) else replace(n, s, '') end as name from (select region_idx, 'sp' || region_idx % 5 as s, case when region_idx % 3 = 0 then s || s || '.' || chrom else s || '_' || chrom end as n from regions)",
    "species_pairs": f"with {_G} select a.species as ref_sp, b.species as qry_sp from genomes a join genomes b on a.species <> b.species",
    "block_dedup": f"with {_B} select ref_sp, qry_sp, ref_chrom, ref_start, qry_chrom, qry_start, length, qry_rev from blocks",
    "block_ranks": f"with {_RANKS} select ref_sp, qry_sp, ref_chrom, ref_start, ref_end, qry_chrom, qry_start, qry_rev, rn_start, rn_end from ranks",
    "block_counts": f"with {_B} select ref_sp, qry_sp, ref_chrom, count(*) as n_blocks from blocks group by all",
    "max_anchor": f"with {_B} select max(length) as max_length from blocks",
    "chrom_dict": "select row_number() over (order by o, chrom) - 1 as chrom_id, chrom from (select 'scaffold' || l_partkey % 700 as chrom, min(l_orderkey * 10 + l_linenumber) as o from lineitem group by 1)",
    "chrom_runs": f"with {_B}, n as (select ref_sp, qry_sp, ref_chrom, count(*) as n_blocks from blocks group by all) select *, cast(sum(n_blocks) over w - n_blocks as bigint) as first_row, lag(ref_chrom) over w as previous from n window w as (partition by ref_sp, qry_sp order by ref_chrom)",
    "asof_rank": f"with {_PAIR} select region_idx, k_start, k_end from ks",
    "nearest_down": f"with {_PAIR} select * from down",
    "nearest_up": f"with {_PAIR} select * from up",
    "stab_join": f"with {_E}, {_R} select region_idx, qry_sp, ref_start, ref_end, qry_chrom, qry_start from regions r join ended h on h.ref_sp = 'sp0' and h.ref_chrom = r.chrom and h.ref_start <= r.loc and r.loc <= h.ref_end",
    "anchor_sides": f"with {_PAIR} select region_idx, count(*) filter (side = 'u') as n_up, count(*) filter (side = 'o') as n_over, count(*) filter (side = 'd') as n_down from a group by 1",
    "major_chrom": f"with {_PAIR} select * from m",
    "major_filter": f"with {_PAIR} select region_idx, count(*) as n_kept from a join m using (region_idx) where a.qry_chrom = m.chrom group by 1 having count(*) filter (side = 'u') > 0 and count(*) filter (side = 'd') > 0",
    "func_class": f"with {_R}, {_T}, near as (select distinct region_idx from regions r join targets t on t.chrom = r.chrom and t.start_pos - 500 <= r.loc and r.loc < t.end_pos + 500) select region_idx, case when near.region_idx is null then '-' else '+' end as flag from regions left join near using (region_idx)",
    "func_wide": f"with {_R}, {_T}, near as (select distinct region_idx from regions r join (select chrom, start_pos, start_pos + cast(pow(10, start_pos % 9) as bigint) as end_pos from targets where start_pos % 97 = 0) t on t.chrom = r.chrom and t.start_pos - 500 <= r.loc and r.loc < t.end_pos + 500) select region_idx, case when near.region_idx is null then '-' else '+' end as flag from regions left join near using (region_idx)",
    "collection_blocks": f"with {_B} select * from blocks",
    "collection_sizes": f"with {_G} select * from genomes",
    "dup_centres": f"with {_R}, r as (select *, loc // 2000 as g from regions), l as (select chrom, g, max_by(id, region_idx) as last_id, count(*) as n from r group by 1, 2) select region_idx, id, last_id from r join l using (chrom, g) where n > 1",
    "unknown_chrom": f"with {_R} select region_idx, 'chrUn' || chrom as chrom from regions where region_idx % 50 = 0",
    "region_rank": f"with {_R} select region_idx, row_number() over (partition by chrom order by loc, region_idx) as rn from regions",
}
_HOPS = f"with {_RANKS}, {_R}, {_T}, {_G}, {O.LOOKUP}"
ORACLE_SQL |= {name: f"{_HOPS}, {O.DIRECT} {sql}" for name, sql in O.OF_DIRECT.items()}
ORACLE_SQL |= {name: f"{_HOPS}, {O.ROUTES} {sql}" for name, sql in O.OF_ROUTES.items()}
ORACLE_SQL["half_life_direct"] = f"{_HOPS}, {O.DIRECT.replace('/ 10000.0::double', '/ 5000.0::double')} select region_idx, floor(score * 1000) / 1000 as score_direct from direct where place = 0"
