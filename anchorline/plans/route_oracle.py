"""SQL of the chain, the hop, the route search and the result tables, as lists of common table expressions.

The collinear chain keeps, for each length, the chain of that length that ends first in the
query (its anchors' places as text), which is another way to the result than the
fold of the engine.  The rounds of the route search are written out: five species
allow four hops.
"""

from __future__ import annotations

from anchorline.functions.scalar import COLOURS

HOPS = 4
_KEYS = "ref_sp, qry_sp, ref_chrom, loc"
_ORDER = "ref_start, ref_end, qry_start, qry_chrom, qry_end, qry_rev"
_STATE = "struct(e bigint, t varchar)[]"

#: After the ranks of all blocks: the number of starts and ends up to each.
LOOKUP = """starts as materialized (select ref_sp, qry_sp, ref_chrom, ref_start, max(rn_start) as k from ranks group by all),
  finals as materialized (select ref_sp, qry_sp, ref_chrom, ref_end, max(rn_end) as k from ranks group by all)"""


def _longest(anchors: str, sign: str) -> str:
    """The places of the longest chain of ``anchors`` (with their place), as text; null without anchors."""
    made = f"struct_pack(e := {sign}x.qry_end, t := coalesce(acc[k].t, '') || ',' || x.place)"
    return f"""list_reduce({anchors}, lambda acc, x: list_transform([len(list_filter(acc, lambda b: b.e < {sign}x.qry_start))], lambda k:
      case when k = len(acc) then list_append(acc, {made}) when {sign}x.qry_end < acc[k + 1].e then acc[1:k] || [{made}] || acc[k + 2:] else acc end)[1], []::{_STATE})[-1].t"""


def hop(n: int, points: str) -> str:
    """Expressions that end with ``hop{n}``: KEYS, place, score, chrom, at, up, down and ``chained{n}`` of the distinct ``points``."""
    pair = "h.ref_sp = p.ref_sp and h.qry_sp = p.qry_sp and h.ref_chrom = p.ref_chrom"
    anchor = "h.ref_start, h.ref_end, h.qry_start, h.qry_chrom, h.qry_end, h.qry_rev"
    four = lambda a: f"struct_pack(ref_start := {a}.ref_start, ref_end := {a}.ref_end, qry_start := {a}.qry_start, qry_end := {a}.qry_end)"
    near = "least(loc - up.ref_end, down.ref_start - loc)"
    part = "((loc - up.ref_end + 0.5::double) / (down.ref_start - up.ref_end))"
    return f"""p{n} as materialized (select *, row_number() over () as hop from (select distinct {_KEYS} from {points})),
  k{n} as materialized (select q.*, coalesce(h.k, 0) as k_end from (select p.*, coalesce(h.k, 0) as k_start from p{n} p asof left join starts h on {pair} and p.loc >= h.ref_start) q
    asof left join finals h on {pair.replace("p.", "q.")} and q.loc > h.ref_end),
  a{n} as materialized (
    select hop, {anchor}, 'd' as side from (select *, k_start + unnest(generate_series(1, 20)) as rn from k{n}) p join ranks h on {pair} and h.rn_start = p.rn
    union all select hop, {anchor}, 'u' from (select *, k_end - unnest(generate_series(0, 19)) as rn from k{n}) p join ranks h on {pair} and h.rn_end = p.rn
    union all select hop, {anchor}, 'o' from p{n} p join ranks h on {pair} and h.ref_start <= p.loc and p.loc <= h.ref_end),
  m{n} as (select hop, qry_chrom from (select hop, qry_chrom, row_number() over (partition by hop order by count(*) desc, qry_chrom) as n from a{n} group by 1, 2) where n = 1),
  kept{n} as materialized (
    select hop, qry_chrom as major, list(struct_pack(ref_start := ref_start, ref_end := ref_end, qry_start := qry_start, qry_end := qry_end, qry_rev := qry_rev) order by {_ORDER}, side) as anchors
    from a{n} join m{n} using (hop, qry_chrom) group by 1, 2 having count(*) filter (side = 'u') > 0 and count(*) filter (side = 'd') > 0),
  placed{n} as (select hop, major, list_transform(anchors, lambda x, i: struct_pack(qry_start := x.qry_start, qry_end := x.qry_end, qry_rev := x.qry_rev, place := i)) as a, anchors from kept{n}),
  both{n} as (
    select hop, major, anchors, {_longest("list_filter(a, lambda x: not x.qry_rev)", "")} as ahead, {_longest("list_filter(a, lambda x: x.qry_rev)", "-")} as behind from placed{n}),
  chained{n} as materialized (
    select p.ref_sp, p.qry_sp, p.ref_chrom, p.loc, hop, major, chain from (
      select hop, major, list_transform(case when coalesce(len(f), 0) >= coalesce(len(r), 0) then f else r end, lambda i: anchors[i::bigint]) as chain
      from (select *, string_split(ahead[2:], ',') as f, string_split(behind[2:], ',') as r from both{n})) join p{n} p using (hop) where len(chain) >= 5),
  cut{n} as (
    select *, list_filter(chain, lambda a: a.ref_start <= loc and loc <= a.ref_end) as hit, list_filter(chain, lambda a: a.ref_start > loc)[1] as down,
      list_filter(chain, lambda a: a.ref_end = list_max(list_transform(list_filter(chain, lambda b: b.ref_end < loc), lambda b: b.ref_end)))[1] as up
    from chained{n} join genomes on species = ref_sp),
  hop{n} as materialized (
    select {_KEYS}, cast(i - 1 as int) as place, 1.0::double as score, major as chrom,
      case when a.qry_rev then a.qry_start - (loc - a.ref_start) else a.qry_start + (loc - a.ref_start) end as "at", {four("a")} as up, {four("a")} as down
    from (select *, unnest(hit) as a, unnest(generate_series(1, len(hit))) as i from cut{n} where len(hit) > 0)
    union all select {_KEYS}, 0, pow(0.5::double, ({near} / 10000.0::double) * (2728222451.0::double / genome_size)), major,
      cast(trunc(case when up.qry_rev then up.qry_end - {part} * (up.qry_end - down.qry_start) else up.qry_end + {part} * (down.qry_start - up.qry_end) end) as bigint), {four("up")}, {four("down")}
    from cut{n} where len(hit) = 0 and up is not null and down is not null)"""


#: One hop of all regions, sp0 to sp4.
DIRECT = f"""asked as (select region_idx, 'sp0' as ref_sp, 'sp4' as qry_sp, chrom as ref_chrom, loc from regions),
  {hop(0, "asked")},
  direct as (select region_idx, h.* from asked p join hop0 h on h.ref_chrom = p.ref_chrom and h.loc = p.loc)"""

_NODE = "struct_pack(species := {s}, chrom := {c}, loc := {l}, score := {x}, up := {u}, down := {d})"
_ENDS = "struct(ref_start bigint, ref_end bigint, qry_start bigint, qry_end bigint)"
_FIRST = _NODE.format(s="'sp0'", c="chrom", l="loc", x="1.0::double", u=f"null::{_ENDS}", d=f"null::{_ENDS}")
_SPECIES = "list_transform(path, lambda n: n.species)"


def _round(n: int) -> str:
    node = _NODE.format(s="h.qry_sp", c="h.chrom", l='h."at"', x="s.score * h.score", u="h.up", d="h.down")
    found = f"select *, {n} as round from moved{n}"
    known = found if n == 0 else f"select region_idx, species, chrom, loc, score, n_inter, path, round from labels{n - 1} union all ({found})"
    return f"""step{n} as materialized (select o.region_idx, o.species as ref_sp, q.qry_sp, o.chrom as ref_chrom, o.loc, o.score, o.n_inter, o.path from open{n} o join pairs q on q.ref_sp = o.species
    where not list_contains(list_transform(o.path, lambda n: n.species), q.qry_sp)),
  {hop(n, f"step{n}")},
  placed_moves{n} as materialized (
    select s.region_idx, h.qry_sp as species, h.chrom, h."at" as loc, s.score * h.score as score, s.n_inter + (h.qry_sp <> 'sp4')::int as n_inter, s.path || [{node}] as path, h.place
    from step{n} s join hop{n} h on h.ref_sp = s.ref_sp and h.qry_sp = s.qry_sp and h.ref_chrom = s.ref_chrom and h.loc = s.loc),
  moved{n} as (select * exclude (place) from placed_moves{n}),
  labels{n} as materialized (
    select * exclude (best) from (
      select *, max(case when species = 'sp4' then score end) over (partition by region_idx) as best from (
        select * from ({known}) qualify row_number() over (partition by region_idx, species, chrom, loc order by score desc, n_inter, {_SPECIES}, path) = 1))
    where species = 'sp4' or best is null or score >= best),
  open{n + 1} as (select region_idx, species, chrom, loc, score, n_inter, path from labels{n} where round = {n} and species <> 'sp4')"""


def _sides(kind: str, side: str, up: str, down: str) -> str:
    return ", ".join(f"{x}.{side}_{e} as {kind}_{side}_{w}_{e}" for w, x in (("up", up), ("down", down)) for e in ("start", "end"))


#: The routes of all regions, sp0 to sp4, and the result table.
ROUTES = f"""pairs as (select distinct ref_sp, qry_sp from ranks),
  open0 as (select region_idx, 'sp0' as species, chrom, loc, 1.0::double as score, 0 as n_inter, [{_FIRST}] as path from regions),
  {", ".join(_round(n) for n in range(HOPS))},
  best as (select * from labels{HOPS - 1} where species = 'sp4' qualify row_number() over (partition by region_idx order by score desc, n_inter, {_SPECIES}, chrom, loc) = 1),
  straight as (select region_idx, chrom as d_chrom, loc as d_loc, score as d_score, path[-1].up as d_up, path[-1].down as d_down from placed_moves0 where species = 'sp4' and place = 0),
  bounds as (select round(pow(0.5, 818466735300.0::double / (genome_size * 10000)), 3) as dc, round(pow(0.5, 6820556127500.0::double / (genome_size * 10000)), 3) as ic from genomes where species = 'sp0'),
  near as (select distinct region_idx from best b join targets t on t.chrom = b.chrom and t.start_pos - 500 <= b.loc and b.loc < t.end_pos + 500),
  result as (
    select *, case when score_direct >= dc then 'DC' when score_multi >= ic then 'IC' else 'NC' end as sequence_conservation from (
      select r.region_idx, r.id, r.chrom, r.loc, b.chrom as multi_chrom, b.loc as multi_loc, b.n_inter, b.path, d_up, d_down,
        floor(coalesce(d_score, 0.0::double) * 1000) / 1000 as score_direct, floor(b.score * 1000) / 1000 as score_multi,
        r.chrom || ':' || r.loc as coords_ref, d_chrom || ':' || d_loc as coords_direct, b.chrom || ':' || b.loc as coords_multi,
        array_to_string(list_transform(b.path[2:-2], lambda n: n.species), ',') as bridging_species, case when near.region_idx is null then '-' else '+' end as functional_conservation
      from regions r join best b using (region_idx) left join straight using (region_idx) left join near using (region_idx)), bounds)"""
_PROJ = "region_idx, id, coords_ref, coords_direct, coords_multi, printf('%.3f', score_direct) as score_direct, printf('%.3f', score_multi) as score_multi, sequence_conservation, functional_conservation, bridging_species"
_COLOUR = "case sequence_conservation || functional_conservation " + " ".join(f"when '{k}' then '{v}'" for k, v in COLOURS.items()) + " end"


def _bed9(chrom: str, loc: str, other: str) -> str:
    return f"""select region_idx, {chrom} as chrom, {loc} as "start", {loc} + 1 as "end", id || '_' || {other} || '_' || sequence_conservation || functional_conservation as name, score_multi as score,
      '.' as strand, {loc} as thick_start, {loc} + 1 as thick_end, {_COLOUR} as item_rgb from result"""


OF_DIRECT = {
    "collinear_chain": "select region_idx, cast(i - 1 as int) as place, a.ref_start, a.qry_start, a.qry_rev from (select region_idx, unnest(chain) as a, unnest(generate_series(1, len(chain))) as i from asked p join chained0 c on c.ref_chrom = p.ref_chrom and c.loc = p.loc)",
    "hop_all": 'select region_idx, place, floor(score * 1000) / 1000 as score, chrom, "at" from direct',
    "hop_aligned": 'select region_idx, place, chrom, "at" from direct where up = down',
    "hop_interp": 'select region_idx, chrom, "at", up.ref_end as up_end, down.ref_start as down_start from direct where up <> down',
    "direct_projection": """select region_idx, floor(score * 1000) / 1000 as score_direct, chrom || ':' || "at" as coords_direct from direct where place = 0""",
}
OF_DIRECT["stored_direct"] = OF_DIRECT["direct_projection"]
OF_ROUTES = {
    "route_best": "select region_idx, score_multi, n_inter, coords_multi from result",
    "path_table": f"""select region_idx, id, cast(i - 1 as int) as step, n.species, n.chrom, n.loc, floor(n.score * 1000) / 1000 as score, case when n.up is null then null when n.up.qry_start < n.up.qry_end then '+' else '-' end as strand,
      {", ".join(f"n.{s}.{e} as {s}_{e}" for s in ("up", "down") for e in ("ref_start", "ref_end", "qry_start", "qry_end"))}
      from (select region_idx, id, unnest(path) as n, unnest(generate_series(1, len(path))) as i from result)""",
    "bridging": "select region_idx, bridging_species from result",
    "proj_table": f"select {_PROJ} from result",
    "proj_anchors": f"select {_PROJ}, {_sides('direct', 'ref', 'd_up', 'd_down')}, {_sides('multi', 'ref', 'path[2].up', 'path[2].down')}, {_sides('direct', 'qry', 'd_up', 'd_down')}, {_sides('multi', 'qry', 'path[-1].up', 'path[-1].down')} from result",
    "bed9_ref": _bed9("chrom", "loc", "coords_multi"),
    "bed9_qry": _bed9("multi_chrom", "multi_loc", "coords_ref"),
    "unmapped": "select region_idx, id from regions where region_idx not in (select region_idx from best)",
    "class_counts": """select sequence_conservation, functional_conservation, count(*) as n from result group by 1, 2
      union all select 'unmapped', '', count(*) from regions where region_idx not in (select region_idx from best)""",
}
