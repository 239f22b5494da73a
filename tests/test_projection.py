"""Anchors, chains, hops and routes against plain Python."""

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from anchorline.api import Engine
from anchorline.config import Settings
from anchorline.functions.chain import collinear_chain, major_chromosome
from anchorline.operators import hop as H
from anchorline.operators import nearest as N
from anchorline.operators import pages as G
from anchorline.operators.blocks import PAIR, block_ranks, with_ends
from tests import brute

S = Settings()
SHAPE = "ref_sp string, qry_sp string, ref_chrom string, ref_start long, qry_chrom string, qry_start long, length int, qry_rev boolean"
SPECIES = ["a", "b", "c", "d"]
GENOMES = {"a": 300_000_000, "b": 600_000_000, "c": 900_000_000, "d": 500_000_000}


def species_blocks(seed, n=160):
    rnd = random.Random(seed)
    rows = set()
    for a in SPECIES:
        for b in SPECIES:
            if a == b:
                continue
            rev = SPECIES.index(a) % 2 != SPECIES.index(b) % 2
            for _ in range(n // (6 if (a, b) == ("a", "d") else 1)):
                x, size = rnd.randrange(1, 90_000), rnd.randrange(1, 300)
                y = x + rnd.randrange(-40, 40) + (rnd.randrange(-3000, 3000) if rnd.random() < 0.1 else 0)
                chrom = rnd.choice(["1", "1", "1", "2"])
                rows.add((a, b, chrom, x, chrom if rnd.random() < 0.9 else "9", max(400, 200_000 - y if rev else y + 500), size, rev))
    return sorted(rows)


@pytest.fixture(scope="module")
def world(spark):
    rows = species_blocks(3)
    genomes = spark.createDataFrame(list(GENOMES.items()), "species string, genome_size long")
    by = defaultdict(list)
    for r in rows:
        by[r[:3]].append((r[3], r[6], r[4], r[5], r[7]))
    return Engine(spark.createDataFrame(rows, SHAPE), genomes), by


@pytest.fixture(scope="module")
def points(spark):
    rnd = random.Random(8)
    rows = [(i, f"r{i}", rnd.choice(["1", "2"]), p, p + 10, p + 5) for i, p in enumerate([*range(0, 96_000, 1_900), *(rnd.randrange(95_000) for _ in range(30))])]
    rows += [(900, "nowhere", "77", 5, 9, 7), (901, "twin", *rows[5][2:])]
    return rows, spark.createDataFrame(rows, "region_idx long, id string, chrom string, start long, end long, loc long")


def test_chain_expression(spark):
    rnd = random.Random(1)
    cases = []
    for n in [0, 1, 2, 3, 5, 8, 8, 8, 12, 12, 25, 40, 40]:
        anchors = []
        for k in range(n):
            rev, q, m = rnd.random() < 0.4, rnd.randrange(50, 400), rnd.randrange(1, 40)
            anchors.append((k * 10, q, q - m + 1 if rev else q + m - 1, rev))
        cases.append(anchors)
    df = spark.createDataFrame([(i, a) for i, a in enumerate(cases)], "i int, a array<struct<ref_start:long,qry_start:long,qry_end:long,qry_rev:boolean>>")
    got = {r.i: [tuple(x) for x in r.c] for r in df.select("i", collinear_chain(F.col("a")).alias("c")).collect()}
    for i, a in enumerate(cases):
        dicts = [dict(zip(("ref_start", "qry_start", "qry_end", "qry_rev"), x)) for x in a]
        assert got[i] == [tuple(x.values()) for x in brute.longest(dicts)]
        if len(a) <= 12:
            assert len(got[i]) == brute.length_by_enumeration(dicts)


def test_major_chromosome(spark):
    df = spark.createDataFrame([(["b", "a", "b", "a"],), (["c"],), ([],)], "c array<string>")
    assert [r[0] for r in df.select(major_chromosome(F.col("c"))).collect()] == ["a", "c", None]


def test_nearest_and_over(world, points):
    engine, by = world
    df = points[1].select(F.lit("a").alias("ref_sp"), F.lit("b").alias("qry_sp"), F.col("chrom").alias("ref_chrom"), "loc", "region_idx")
    i = engine.index
    for side in "du":
        got, before = defaultdict(list), defaultdict(int)
        for r in i.sides(df, S).where(F.col("kind") == side).collect():
            assert r.region_idx not in before
            got[r.region_idx] = [(b.ref_start, b.ref_end) for b in r.found]
            before[r.region_idx] = r.before
        for idx, _, chrom, _, _, loc in points[0]:
            es = [brute.ends(b) for b in by["a", "b", chrom]]
            want = sorted((e["ref_start"], e["ref_end"]) for e in es if e["ref_start"] > loc)[:20] if side == "d" else sorted(((e["ref_end"], e["ref_start"]) for e in es if e["ref_end"] < loc))[-20:]
            assert sorted(x[side == "u"] for x in got[idx]) == sorted(x[0] for x in want)
            assert before[idx] == sum(e["ref_start"] <= loc if side == "d" else e["ref_end"] < loc for e in es)
    over = {(r.region_idx, r.block.ref_start) for r in N.over(df, i.blocks).collect()}
    assert over == {(idx, b[0]) for idx, _, chrom, _, _, loc in points[0] for b in by["a", "b", chrom] if b[0] <= loc <= b[0] + b[1] - 1}


def test_hops(world, points):
    engine, by = world
    df = points[1].select(F.lit("a").alias("ref_sp"), F.explode(F.array(F.lit("b"), F.lit("c"), F.lit("d"))).alias("qry_sp"), F.col("chrom").alias("ref_chrom"), "loc")
    got = defaultdict(list)
    for r in H.hops(df, engine.index, engine.genomes, S).orderBy("place").collect():
        got[r.qry_sp, r.ref_chrom, r.loc].append((round(r.score, 9), r.chrom, r["at"], r.up.ref_end, r.down.ref_start))
    want = {}
    for q in "bcd":
        for _, _, chrom, _, _, loc in points[0]:
            t = [(round(x[0], 9), x[1], x[2], x[3]["ref_end"], x[4]["ref_start"]) for x in brute.hop(by["a", q, chrom], loc, GENOMES["a"], S)]
            if t:
                want[q, chrom, loc] = t
    assert dict(got) == want and len(want) > 100


def test_places_below_zero_and_over_many_pages(spark, monkeypatch):
    """Pages of few blocks: a point's blocks come from several of them, blocks lie over their borders; a chromosome may begin below zero."""
    monkeypatch.setattr(G, "PAGE_BLOCKS", 7)
    rnd = random.Random(4)
    rows = sorted({("a", "b", "1", rnd.randrange(-900_000, 200_000), rnd.choice(["1", "1", "9"]), rnd.randrange(10**6), rnd.randrange(1, 30_000), rnd.random() < 0.3) for _ in range(150)})
    listed = [(r[3], r[6], r[4], r[5], r[7]) for r in rows]
    engine = Engine(spark.createDataFrame(rows, SHAPE), spark.createDataFrame([*GENOMES.items()], "species string, genome_size long"))
    locs = sorted({rnd.randrange(-1_000_000, 300_000) for _ in range(60)} | {r[3] for r in rows[::40]})
    df = spark.createDataFrame([("a", "b", "1", x) for x in locs], "ref_sp string, qry_sp string, ref_chrom string, loc long")
    assert engine.index.pages.select("page").distinct().count() > 8
    sides = {(r.loc, r.kind): r for r in engine.index.sides(df, S).collect()}
    got = defaultdict(list)
    for r in H.hops(df, engine.index, engine.genomes, S).orderBy("place").collect():
        got[r.loc].append((round(r.score, 9), r.chrom, r["at"]))
    some = 0
    for x in locs:
        es = [brute.ends(b) for b in listed]
        assert sides[x, "d"].before == sum(e["ref_start"] <= x for e in es) and sides[x, "u"].before == sum(e["ref_end"] < x for e in es)
        assert [b.ref_start for b in sides[x, "d"].found] == sorted(e["ref_start"] for e in es if e["ref_start"] > x)[:20]
        assert [b.ref_end for b in sides[x, "u"].found] == sorted(e["ref_end"] for e in es if e["ref_end"] < x)[-20:]
        want = [(round(t[0], 9), t[1], t[2]) for t in brute.hop(listed, x, GENOMES["a"], S)]
        assert got[x] == want
        some += bool(want)
    assert some > 30


def test_lists_of_anchors_are_not_shuffled(spark, world, points):
    """The last exchanges before the anchors are gathered are those of points and pages; none follows."""
    df = points[1].select("region_idx", F.lit("a").alias("ref_sp"), F.lit("b").alias("qry_sp"), F.col("chrom").alias("ref_chrom"), "loc")
    for made in (H.gathered(df, world[0].index, S), H.hopped(df, world[0].index, world[0].genomes, S)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        above = plan[: plan.index("FlatMapCoGroupsInArrow")]
        assert "Exchange" not in above.replace("BroadcastExchange", "") and "SortMergeJoin" not in above


def test_single_hops_index_their_pair_only(spark):
    from anchorline.plans import queries as Q

    for wanted, n in ((Q.ONE_HOP, 1), (Q.ON_ROUTES, 13)):
        made = Q.engine(spark, "/root/testdata/sf0.001", wanted)
        assert made.index.pages.select("ref_sp", "qry_sp").distinct().count() == n


def test_routes(world, points):
    engine, by = world
    done = engine.project(points[1], "a", "d")
    got = {r.region_idx: r for r in done.table.collect()}
    lost = {r.region_idx for r in done.unmapped.collect()}
    assert {900} <= lost and not lost & set(got) and len(lost) + len(got) == len(points[0])
    bridged = 0
    for idx, _, chrom, _, _, loc in points[0]:
        want = brute.route(by, GENOMES, "a", "d", chrom, loc, S)
        assert (want is None) == (idx in lost)
        if want:
            r = got[idx]
            # a dominated label is never expanded by label setting, so relaxation can only be better
            assert r.multi_score >= want[0] - 1e-12
            if abs(r.multi_score - want[0]) < 1e-12:
                assert r.n_inter <= want[1]
            bridged += r.n_inter > 0
            assert r.score_multi == math.floor(r.multi_score * 1000) / 1000
            assert r.bridging_species == ",".join(n.species for n in r.path[1:-1])
    assert bridged > 10
    direct = {idx: brute.hop(by["a", "d", chrom], loc, GENOMES["a"], S)[:1] for idx, _, chrom, _, _, loc in points[0]}
    for idx, r in got.items():
        assert r.score_direct == (math.floor(direct[idx][0][0] * 1000) / 1000 if direct[idx] else 0.0)
    steps = done.explain_path(min(got)).collect()
    assert [s.species for s in steps][0] == "a" and steps[-1].species == "d"
    simple = done.explain_path(min(got), simple=True).collect()
    assert min(x for s in simple[1:] for x in (s.up_ref_start, s.down_ref_start)) >= 0


def test_routes_with_places_and_paths(spark, points):
    """Each route in whole: score, species, and the place in each, by exhaustive rounds. Chromosomes have other names in c and d, and b has c's blocks too, so that routes tie."""
    name = lambda sp, chrom: f"{chrom}x" if sp in "cd" else chrom
    rows = [(r[0], r[1], name(r[0], r[2]), r[3], name(r[1], r[4]), *r[5:]) for r in species_blocks(3) if "b" not in r[:2]]
    twin = {"c": "b"}
    rows += [(twin.get(r[0], r[0]), twin.get(r[1], r[1]), r[2].strip("x") if r[0] == "c" else r[2], r[3], r[4].strip("x") if r[1] == "c" else r[4], *r[5:]) for r in rows if "c" in r[:2]]
    by = defaultdict(list)
    for a, b, chrom, start, q, qs, n, rev in rows:
        by[a, b, chrom].append((start, n, q, qs, rev))
    engine = Engine(spark.createDataFrame(rows, SHAPE), spark.createDataFrame([*{**GENOMES, "b": GENOMES["c"]}.items()], "species string, genome_size long"))
    got = {r.region_idx: r for r in engine.project(points[1], "a", "d").table.collect()}
    changed = 0
    for idx, _, chrom, _, _, loc in points[0]:
        want = brute.relax(by, {**GENOMES, "b": GENOMES["c"]}, "a", "d", chrom, loc, S)
        assert (want is None) == (idx not in got)
        if want:
            path = got[idx].path
            assert got[idx].multi_score == pytest.approx(want[0], rel=1e-12) and got[idx].n_inter == want[1]
            assert [n.species for n in path] == want[2] and [(n.chrom, n.loc) for n in path[1:]] == want[3]
            assert (path[0].chrom, path[0].loc, path[0].up) == (chrom, loc, None) and all(n.up is not None and n.down is not None for n in path[1:])
            changed += len({n.chrom for n in path}) > 1
    assert changed > 0 and len(got) > 30 and any(r.bridging_species == "b" for r in got.values())


def test_errors(world, points, spark):
    engine, _ = world
    for ref, qry in (("a", "a"), ("zz", "a"), ("a", "zz")):
        with pytest.raises(ValueError):
            engine.project(points[1], ref, qry)
    with pytest.raises(ValueError):
        Settings(distance_dc=3000, distance_ic=10).thresholds(GENOMES["a"])
    none = engine.project(points[1].where("region_idx < 0"), "a", "d")
    assert none.table.count() == 0 and none.unmapped.count() == 0


def test_large_loci_and_no_length(spark):
    rows = [("a", "b", "1", 2**31 + 1000 * i, "1", 2**31 + 5 + 1000 * i, 50, False) for i in range(12)] + [("a", "b", "1", 2**31 + 5500, "1", 7, 0, False)]
    engine = Engine(spark.createDataFrame(rows, SHAPE), spark.createDataFrame([("a", 10**9), ("b", 10**9)], "species string, genome_size long"))
    points = spark.createDataFrame([(0, "x", "1", 0, 0, 2**31 + 5500)], "region_idx long, id string, chrom string, start long, end long, loc long")
    r = engine.project(points, "a", "b").table.first()
    # 5,054 + (451.5 / 951) * 951, truncated
    assert r.multi_loc == 2**31 + 5505


def test_thresholds():
    assert Settings().thresholds(2_728_222_451) == (0.979, 0.841)
    assert Settings(distance_dc=None, distance_ic=None).thresholds(1) == (0.98, 0.84)


def test_ranks_cross_cells(spark):
    rows = [("a", "b", "1", 20_000 * i, "1", 5 * i + 10, 3, False) for i in range(30)]
    got = block_ranks(with_ends(spark.createDataFrame(rows, SHAPE))).orderBy("ref_start").collect()
    assert [r.rn_start for r in got] == list(range(1, 31)) == [r.rn_end for r in got]
    assert PAIR == ["ref_sp", "qry_sp", "ref_chrom"]
