"""Readers, writers, codec, command line, stream and registered queries."""

import os
import signal
import threading
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from anchorline.__main__ import main
from anchorline.api import Engine
from anchorline.functions import scalar as SC
from anchorline.config import Settings
from anchorline.operators import project as P
from anchorline.operators.blocks import with_ends
from anchorline.operators.hop import BlockIndex
from anchorline.plans import fixture as X
from anchorline.plans.queries import QUERIES
from anchorline.sources import axt as A
from anchorline.sources import collecting
from anchorline.sources import collection as C
from anchorline.sources import sinks
from anchorline.sources import text as T
from anchorline.sources.ordered import write_lines
from tests.brute_collection import decode_collection, encode_collection
from tests.test_projection import GENOMES, SHAPE, species_blocks

CHAIN = """# comment
chain 100 chr1 1000 + 10 60 chrA 500 + 20 80 1
5 2 3
10 0 4
7

chain 90 chr2 2000 + 100 130 chrB 400 - 30 60 2
30
chain 90 chr2 2000 + 100 130 chrB 400 - 30 60 3
30
"""
BLOCKS = [("chr1", 10, "chrA", 20, 5, False), ("chr1", 17, "chrA", 28, 10, False), ("chr1", 27, "chrA", 42, 7, False), ("chr2", 100, "chrB", 369, 30, True)]


def test_chains(spark, tmp_path):
    (tmp_path / "a.b.all.pre.chain").write_text(CHAIN)
    (tmp_path / "b.a.all.pre.chain").write_text(CHAIN)
    got = T.parse_chains(T.read_chains(spark, str(tmp_path / "a.b.all.pre.chain"))).dropDuplicates()
    assert sorted(map(tuple, got.collect())) == BLOCKS
    both = T.collect_blocks(spark, str(tmp_path), ["a", "b"])
    assert both.groupBy("ref_sp", "qry_sp").count().count() == 2 and both.count() == 2 * len(BLOCKS)
    tbl = T.tbl_rows(with_ends(got))
    sinks.write_tbl(tbl, str(tmp_path / "t"))
    assert (tmp_path / "t").read_text().splitlines()[-1] == "chr2\t100\t129\tchrB\t369\t340"
    (tmp_path / "a.b.tbl").write_text((tmp_path / "t").read_text())
    back = T.read_tbl(spark, [str(tmp_path / "a.b.tbl")])
    assert sorted(tuple(r)[2:] for r in back.collect()) == BLOCKS


def test_axt_records(spark, tmp_path):
    (tmp_path / "a.b.net.axt").write_text("# net\n\n0 chr1 11 18 chrA 5 11 + 10\nACGT--ACGT\nAC-TTTA--T\n\n1 chr2 1 4 chrB 3 6 - 9\nACGT\nACGT\n\n")
    sizes = spark.createDataFrame([("chrB", 100)], "chrom string, size long")
    parsed = A.parse_axt(A.read_axt(spark, str(tmp_path)))
    assert sorted(map(tuple, A.axt_tbl(parsed, sizes).collect())) == [("chr1", 11, 18, "chrA", 5, 11), ("chr2", 1, 4, "chrB", 97, 94)]
    assert sorted(map(tuple, A.axt_blocks(parsed, sizes).collect())) == [("chr1", 10, "chrA", 4, 2, False), ("chr1", 13, "chrA", 6, 1, False), ("chr1", 14, "chrA", 9, 1, False), ("chr1", 17, "chrA", 10, 1, False), ("chr2", 0, "chrB", 97, 4, True)]
    with pytest.raises(Exception, match="no size"):
        A.axt_tbl(parsed, sizes.limit(0)).collect()
    for bad in ("0 chr1 1 2 chrA 1 2 + 3\nAC\n", "0 chr1 1 2 chrA 1 2 + 3\nAC\nA\n", "0 chr1 1\nAC\nAC\n"):
        with pytest.raises(Exception, match="axt record"):
            A.axt_tbl(A.parse_axt(spark.createDataFrame([(bad,)], "axt string")), sizes).collect()
    long = spark.createDataFrame([("0 c 1 70000 d 1 70000 + 1\n" + "A" * 70_000 + "\n" + "A" * 70_000,)], "axt string")
    assert sorted(r.length for r in A.axt_blocks(A.parse_axt(long), sizes).collect()) == [70_000 - 2 * A.LONGEST, A.LONGEST, A.LONGEST]


def test_regions_targets_sizes_species(spark, tmp_path):
    (tmp_path / "r.bed").write_text("chr1\t10\t21\tx\t0\t.\nchr2\t5\t6\ty\n")
    r = T.read_regions(spark, str(tmp_path / "r.bed")).orderBy("region_idx").collect()
    assert [(x.id, x.chrom, x.loc) for x in r] == [("x", "chr1", 15), ("y", "chr2", 5)]
    (tmp_path / "bad.bed").write_text("chr1\t10\t21\n")
    with pytest.raises(Exception, match="name"):
        T.read_regions(spark, str(tmp_path / "bad.bed")).collect()
    (tmp_path / "t.bed").write_text("#c\nchr1\t1\t2\n")
    assert [tuple(x) for x in T.read_targets(spark, str(tmp_path / "t.bed")).collect()] == [("chr1", 1, 2, None)]
    (tmp_path / "a.sizes").write_text("chr1 10\nchr2 5\n")
    assert [tuple(x) for x in T.read_sizes(spark, str(tmp_path), ["a"]).collect()] == [("a", 15)]
    (tmp_path / "s.txt").write_text("# all\nmm39  # mouse\nhg38\n")
    assert T.read_species(spark, str(tmp_path / "s.txt")) == ["mm39", "hg38"] and T.read_species(spark, "a, b") == ["a", "b"]


def test_collection_is_read_in_ranges_and_written_in_parts(spark, tmp_path):
    names = [x.split()[0] for x in SHAPE.split(", ")]
    rows = pd.DataFrame(species_blocks(5, 40), columns=names).drop_duplicates()
    rows = rows.sort_values(["ref_sp", "qry_sp", "ref_chrom", "ref_start", "qry_chrom", "qry_start"], kind="stable").reset_index(drop=True)
    sizes = dict(sorted(GENOMES.items()))
    data = encode_collection(rows, sizes)
    key = lambda found: sorted(tuple(r[c] for c in names) for r in found)
    want = key(rows.to_dict("records"))
    (tmp_path / "c.bin").write_bytes(data)
    for n in (7, 10**6):
        read = C.read_collection(spark, str(tmp_path / "c.bin"), n)
        assert key(r.asDict() for r in read.collect()) == want
        assert read.rdd.getNumPartitions() == max(1, -(-len(rows) // n))
    assert {r.species: r.genome_size for r in C.read_collection_sizes(spark, str(tmp_path / "c.bin")).collect()} == sizes
    some = C.read_collection(spark, str(tmp_path / "c.bin"), 7).where("ref_sp = 'a' and qry_sp in ('b', 'd')")
    assert key(r.asDict() for r in some.collect()) == [t for t in want if t[0] == "a" and t[1] in ("b", "d")]
    assert some.rdd.getNumPartitions() <= -(-some.count() // 7) + 1
    blocks, genomes = spark.createDataFrame(rows.sample(frac=1, random_state=1), SHAPE).repartition(5), spark.createDataFrame(list(sizes.items()), "species string, genome_size long")
    for _ in range(2):
        C.write_collection(blocks, genomes, str(tmp_path / "w.bin"))
        assert (tmp_path / "w.bin").read_bytes() == data and decode_collection(data)[1] == sizes
    assert sorted(x.name for x in tmp_path.iterdir()) == ["c.bin", "w.bin"]
    (tmp_path / "folder").mkdir()
    for name in ("x.bin", "y.bin"):
        (tmp_path / "folder" / name).write_bytes(data)
    assert C.read_collection(spark, str(tmp_path / "folder")).count() == 2 * len(rows)
    C.write_collection(blocks.limit(0), genomes, str(tmp_path / "empty.bin"))
    assert C.read_collection(spark, str(tmp_path / "empty.bin")).count() == 0 and C.read_collection_sizes(spark, str(tmp_path / "empty.bin")).count() == len(sizes)


@pytest.mark.parametrize("damage", [lambda d: b"\x03" + d[1:], lambda d: d[:1] + b"\xfe\x0a" + d[3:], lambda d: d[:-3], lambda d: d + b"x", lambda d: d[:40]])
def test_damaged_collections_are_errors(spark, tmp_path, damage):
    rows = pd.DataFrame(species_blocks(3), columns=[x.split()[0] for x in SHAPE.split(", ")])
    (tmp_path / "c.bin").write_bytes(damage(encode_collection(rows, GENOMES)))
    with pytest.raises(Exception, match="collection"):
        C.read_collection(spark, str(tmp_path / "c.bin")).count()


def test_blocks_that_do_not_fit_are_not_written(spark, tmp_path):
    genomes = spark.createDataFrame(list(GENOMES.items()), "species string, genome_size long")
    for row, why in ((("a", "b", "1", -1, "1", 0, 5, False), "32 bits"), (("a", "b", "1", 1, "1", 0, 1 << 15, False), "15 bits"), (("a", "zz", "1", 1, "1", 0, 5, False), None), (("zz", "a", "1", 1, "1", 0, 5, False), "genome size")):
        blocks = spark.createDataFrame([row], SHAPE)
        if why:
            with pytest.raises(Exception, match=why):
                C.write_collection(blocks, genomes, str(tmp_path / "w.bin"))
            assert not list(tmp_path.iterdir()) or why == "genome size"
        else:
            C.write_collection(blocks, genomes, str(tmp_path / "ok.bin"))
            (tmp_path / "ok.bin").unlink()


def test_coordinates_beyond_32_bits_take_the_wide_form(spark, tmp_path):
    names = [x.split()[0] for x in SHAPE.split(", ")]
    rows = [("a", "b", "1", -7 - i, "2", 2**33 + i, 5 + i, i % 2 == 1) for i in range(40)] + [("b", "a", "2", 2**32, "1", 0, 0x7FFF, True)]
    blocks, genomes = spark.createDataFrame(rows, SHAPE), spark.createDataFrame(list(GENOMES.items()), "species string, genome_size long")
    assert [C.coordinate_bits(x) for x in (blocks, blocks.where("ref_start >= 0").selectExpr("ref_start - 1 as ref_start", "qry_start"), blocks.limit(0))] == [64, 32, 32]
    C.write_collection(blocks, genomes, str(tmp_path / "w.bin"), C.coordinate_bits(blocks))
    for n in (7, 10**6):
        read = C.read_collection(spark, str(tmp_path / "w.bin"), n).select(*names)
        assert sorted(map(tuple, read.collect())) == sorted(rows)
    assert {r.species: r.genome_size for r in C.read_collection_sizes(spark, str(tmp_path / "w.bin")).collect()} == GENOMES


def test_collection_queries_with_negative_coordinates(spark, tmp_path):
    """Orders beyond 200,000 have negative places in the reversed species of the fixture."""
    line = spark.range(60).selectExpr("190000 + 400 * id as l_orderkey", "id * 7 as l_partkey", "id as l_suppkey", "cast(id % 7 as int) as l_linenumber", "cast(1 + id % 50 as double) as l_quantity")
    line.write.parquet(str(tmp_path / "lineitem.parquet"))
    want = sorted(map(tuple, X.blocks(spark, str(tmp_path)).collect()))
    assert min(r[3] for r in want) < 0
    assert sorted(map(tuple, QUERIES["collection_blocks"](spark, str(tmp_path)).collect())) == want
    assert QUERIES["collection_sizes"](spark, str(tmp_path)).count() == 5


def test_scalars(spark):
    df = spark.createDataFrame([(10, 20, 110, 150, 11)], "up long, down long, qu long, qd long, loc long")
    r = df.select(SC.interpolate(F.col("loc"), F.col("up"), F.col("down"), F.col("qu"), F.col("qd"), F.lit(False)).alias("f"), SC.interpolate(F.col("loc"), F.col("up"), F.col("down"), F.col("qd"), F.col("qu"), F.lit(True)).alias("r"), SC.unpack_length(SC.pack(F.lit(77), F.lit(True))).alias("n"), SC.unpack_reverse(SC.pack(F.lit(77), F.lit(True))).alias("v")).first()
    assert (r.f, r.r, r.n, r.v) == (116, 144, 77, True)


def test_command_line_and_files(spark, tmp_path):
    rows = pd.DataFrame(species_blocks(3), columns=[x.split()[0] for x in SHAPE.split(", ")])
    (tmp_path / "c.bin").write_bytes(encode_collection(rows, GENOMES))
    (tmp_path / "r.bed").write_text("".join(f"1\t{p}\t{p + 11}\tp{p}\n" for p in range(3000, 60000, 9000)) + "zz\t1\t2\tlost\n")
    (tmp_path / "t.bed").write_text("1\t0\t90000\tt\n")
    for name, more in (("o1", ["-q", "-ddc", "300.5"]), ("o2", ["-q"]), ("o2", ["--include_anchors", "-v", "-c", "--target_bedfile", str(tmp_path / "t.bed")])):
        main([str(tmp_path / "r.bed"), "a", "d", str(tmp_path / "c.bin"), "-o", str(tmp_path / name), "--n_cores", "4", *more])
        table = (tmp_path / name / "r.a-d.proj").read_text().splitlines()
        head = table[0].split("\t")
        assert head[: len(P.PROJ)] == P.PROJ and len(head) == len(P.PROJ) + (16 if "-v" in more else 0)
        assert not [x for x in table[1:] if x == table[0]] and sorted(x.name for x in (tmp_path / name).iterdir()) == ["r.a-d.proj", "r.a-d.unmapped", "r.a.bed", "r.d.bed"]
        if "-v" in more:
            assert head[len(P.PROJ) :] == [f"{s}_anchor_{k}_{n}_{e}" for s in ("ref", "qry") for k in ("direct", "multi") for n in ("left", "right") for e in ("start", "end")]
        bed = (tmp_path / name / "r.d.bed").read_text().splitlines()
        assert all(len(x.split("\t")) == 9 for x in bed) and bed
        assert "lost" in (tmp_path / name / "r.a-d.unmapped").read_text()
        flag = [dict(zip(head, x.split("\t")))["functional_conservation"] for x in table[1:] if x != table[0]]
        assert set(flag) <= ({"+", "-"} if "-v" in more else {""})


def test_stored_index(spark, tmp_path, monkeypatch):
    rows = pd.DataFrame(species_blocks(3), columns=[x.split()[0] for x in SHAPE.split(", ")])
    (tmp_path / "c.bin").write_bytes(encode_collection(rows, GENOMES))
    source, at = str(tmp_path / "c.bin"), str(tmp_path / "index")
    built = Engine.load(spark, source)
    with pytest.raises(ValueError, match="no complete index"):
        Engine.open(spark, at)
    built.save(at, source)
    regions = spark.createDataFrame([(i, f"p{i}", "1", 700 * i, 700 * i + 9, 700 * i + 4) for i in range(90)], "region_idx long, id string, chrom string, start long, end long, loc long")
    want = sorted(map(tuple, built.project(regions, "a", "d").proj().collect()))

    def never(*_):
        raise AssertionError("the index is built again")

    monkeypatch.setattr(BlockIndex, "build", never)
    opened = Engine.open(spark, at, source=source)
    assert sorted(map(tuple, opened.project(regions, "a", "d").proj().collect())) == want and want
    assert opened.genome_size("a") == GENOMES["a"]
    plan = opened.index.of(["a"], ["d"]).pages._jdf.queryExecution().toString()
    assert "PartitionFilters: [ref_sp" in plan.replace("isnotnull(ref_sp", "ref_sp")
    with pytest.raises(ValueError, match="stale: its nearest"):
        Engine.open(spark, at, Settings(nearest=7))
    (tmp_path / "c.bin").write_bytes(encode_collection(rows.iloc[1:], GENOMES))
    with pytest.raises(ValueError, match="stale: its source"):
        Engine.open(spark, at, source=source)
    next((tmp_path / "index" / "pages").rglob("part-*")).unlink()
    with pytest.raises(ValueError, match="damaged"):
        Engine.open(spark, at)


def test_command_line_with_a_stored_index_and_with_parquet(spark, tmp_path):
    blocks, genomes = spark.createDataFrame(species_blocks(3), SHAPE), spark.createDataFrame(list(GENOMES.items()), "species string, genome_size long")
    blocks.write.parquet(str(tmp_path / "p" / "blocks"))
    genomes.write.parquet(str(tmp_path / "p" / "genomes"))
    (tmp_path / "r.bed").write_text("".join(f"1\t{p}\t{p + 11}\tp{p}\n" for p in range(3000, 60000, 9000)))
    for name in ("o1", "o2"):
        main([str(tmp_path / "r.bed"), "a", "d", str(tmp_path / "p"), "-q", "-o", str(tmp_path / name), "--index", str(tmp_path / "index")])
    tables = [(tmp_path / name / "r.a-d.proj").read_text() for name in ("o1", "o2")]
    assert tables[0] == tables[1] and len(tables[0].splitlines()) > 3


def test_functional_overlap_is_half_open(spark):
    p = spark.createDataFrame([(i, "1", i) for i in range(0, 3000, 1)], "region_idx long, chrom string, loc long")
    t = spark.createDataFrame([("1", 1000, 1010), ("2", 0, 9999)], "chrom string, start long, end long")
    got = sorted(r.region_idx for r in P.overlapping(p, t, 500).collect())
    assert got == list(range(500, 1510))


def test_shared_centres_and_unknown_chromosomes(spark):
    r = spark.createDataFrame([(1, "a", "1", 5), (2, "b", "1", 5), (3, "c", "1", 6), (4, "d", "none", 5), (5, "e", None, 5)], "region_idx long, id string, chrom string, loc long")
    assert sorted((x.region_idx, x.last_id) for x in P.named_by_last(r).collect()) == [(1, "b"), (2, "b")]
    engine = Engine(spark.createDataFrame(species_blocks(3), SHAPE), spark.createDataFrame(list(GENOMES.items()), "species string, genome_size long"))
    assert sorted(x.region_idx for x in engine.unknown(r).collect()) == [4, 5]


def test_collecting_writes_changed_pairs_only(spark, tmp_path):
    chains, out = tmp_path / "chains", str(tmp_path / "table")
    chains.mkdir()
    for a in "abc":
        (chains / f"{a}.sizes").write_text("chr1 1000\n")
    for a, b in (("a", "b"), ("b", "a")):
        (chains / f"{a}.{b}.all.pre.chain").write_text(CHAIN)
    run = lambda species, **how: collecting.collect(spark, str(chains), str(chains), species, out, **how)
    files = lambda: {str(f.relative_to(out)): f.stat().st_mtime_ns for f in (tmp_path / "table" / "blocks").rglob("part-*")}
    done = run(["a", "b"])
    assert sorted(done.written) == [("a", "b"), ("b", "a")] and not done.unchanged and not done.missing
    first = files()
    with pytest.raises(FileNotFoundError, match="a.c.all.pre.chain"):
        run(["a", "b", "c"])
    for a, b in (("a", "c"), ("c", "b"), ("b", "c")):
        (chains / f"{a}.{b}.all.pre.chain").write_text(CHAIN)
    done = run(["a", "b", "c"], allow_missing=True)
    assert sorted(done.written) == [("a", "c"), ("b", "c"), ("c", "b")] and len(done.unchanged) == 2 and done.missing == ["c.a.all.pre.chain"]
    assert first.items() <= files().items()
    (chains / "a.b.all.pre.chain").write_text("# nothing\n")
    assert run(["a", "b", "c"], allow_missing=True).written == [("a", "b")]
    blocks = collecting.stored_blocks(spark, out)
    assert {tuple(r) for r in blocks.select("ref_sp", "qry_sp").distinct().collect()} == {("a", "c"), ("b", "a"), ("b", "c"), ("c", "b")} and blocks.count() == 4 * len(BLOCKS)
    collecting.main([str(chains), str(chains), "a,b,c", out, "-m", "-b", str(tmp_path / "c.bin")])
    assert len(decode_collection((tmp_path / "c.bin").read_bytes())[0]) == 4 * len(BLOCKS)
    assert run(["a", "b", "c"], allow_missing=True).written == []


def test_ordered_file(spark, tmp_path):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("n"), F.when(F.col("id") % 3 > 0, F.lit("x")).alias("x")).repartition(6)
    for _ in range(2):
        write_lines(df.orderBy("n"), str(tmp_path / "sub" / "f.tsv"), header=True)
        lines = (tmp_path / "sub" / "f.tsv").read_text().splitlines()
        assert lines[0] == "n\tx" and [int(x.split("\t")[0]) for x in lines[1:]] == list(range(5000)) and set(x.split("\t")[1] for x in lines[1:]) == {"", "x"}
    write_lines(df.limit(0), str(tmp_path / "sub" / "g.tsv"))
    assert (tmp_path / "sub" / "g.tsv").read_text() == "" and sorted(x.name for x in (tmp_path / "sub").iterdir()) == ["f.tsv", "g.tsv"]


def test_a_signal_ends_the_command_and_leaves_nothing(spark, tmp_path):
    rows = pd.DataFrame(species_blocks(3), columns=[x.split()[0] for x in SHAPE.split(", ")])
    (tmp_path / "c.bin").write_bytes(encode_collection(rows, GENOMES))
    (tmp_path / "r.bed").write_text("".join(f"1\t{p}\t{p + 11}\tp{p}\n" for p in range(3000, 60000, 40)))
    shared = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(os.listdir(f"{shared}/anchorline")) if os.path.isdir(f"{shared}/anchorline") else set()
    handler = signal.getsignal(signal.SIGTERM)

    def when_routes_are_searched():
        for _ in range(2400):
            if os.path.isdir(f"{shared}/anchorline") and any(x.startswith("route-moved") for x in set(os.listdir(f"{shared}/anchorline")) - before):
                break
            time.sleep(0.05)
        os.kill(os.getpid(), signal.SIGTERM)

    timer = threading.Thread(target=when_routes_are_searched)
    timer.start()
    with pytest.raises(KeyboardInterrupt, match="signal"):
        main([str(tmp_path / "r.bed"), "a", "d", str(tmp_path / "c.bin"), "-q", "-o", str(tmp_path / "out")])
    timer.join()
    assert signal.getsignal(signal.SIGTERM) is handler
    for _ in range(100):
        if not spark.sparkContext.statusTracker().getActiveJobsIds():
            break
        time.sleep(0.1)
    assert not spark.sparkContext.statusTracker().getActiveJobsIds() and not spark.getTags()
    assert not (tmp_path / "out").exists() and set(os.listdir(f"{shared}/anchorline")) == before
    assert spark.range(10).count() == 10


def test_stream(spark, tmp_path):
    from anchorline.streaming.regions import BATCH, numbered_lines, project_stream

    engine = Engine(spark.createDataFrame(species_blocks(3), SHAPE), spark.createDataFrame(list(GENOMES.items()), "species string, genome_size long"))
    (tmp_path / "in").mkdir()
    run = lambda: project_stream(spark, engine, str(tmp_path / "in"), "a", "d", str(tmp_path / "out"), str(tmp_path / "ckpt")).awaitTermination(180)
    rows = lambda: sorted((r.batch, r.region_idx, r.id) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    (tmp_path / "in" / "a.bed").write_text("1\t30000\t30010\tx\n1\t40000\t40010\ty\n")
    run()
    (tmp_path / "in" / "b.bed").write_text("1\t30000\t30010\tx2\n1\t40000\t40010\ty2\n")
    run()
    found = rows()
    numbers = [n for _, n, _ in found]
    assert len(numbers) == len(set(numbers)) and {b for b, _, _ in found} == {0, 1} and all(n // BATCH == b for b, n, _ in found)
    # the last batch once more, as after a crash before its commit
    (tmp_path / "ckpt" / "commits" / "1").unlink()
    for crc in (tmp_path / "ckpt" / "commits").glob(".1*"):
        crc.unlink()
    run()
    assert rows() == found
    lines = spark.createDataFrame([(f"l{i}", f"f{i // 50}", 0, (3 - i // 50) * 10**9 + i) for i in range(200)], "value string, file string, block long, n long")
    got = [{r.value: r.region_idx for r in numbered_lines(lines.repartition(k), 5).collect()} for k in (1, 7)]
    assert got[0] == got[1] == {f"l{i}": 5 * BATCH + i for i in range(200)}


def test_queries_are_registered():
    names, sql = entry.queries(), entry.oracle_sql()
    assert len(names) >= 45 and set(sql) <= set(names)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() == 1477 and df.columns[0] == "region_idx"


