"""Approximate nearest neighbours by multiprobe p-stable hashing.

Each of ``tables`` tables hashes a unit vector x to the cell of
floor((a_j . x + b_j) / width), j = 1..hashes, with Gaussian a_j (2-stable: the
difference of two hashed values is distributed as the vectors' distance).  A
query visits its own cell and the ``probes`` - 1 perturbed cells that are
likeliest to hold its neighbours: perturbations by -1 or +1 in some coordinates,
in order of the sum of squared distances to the crossed cell borders, made by
the shift and expand heap.  The candidates of all tables are merged and ranked
by the exact cosine of the original vectors, in double precision.

Unless given, the parameters are chosen by ``tuned`` from a bounded sample: the exact
neighbours of SAMPLE_QUERIES queries (one pass over all entries) and SAMPLE_ENTRIES entries tell,
for each number of hashes, width and number of probes, which share of the neighbours would be found and which share of the
entries visited; the cheapest choice that finds TARGET of the neighbours is taken, so that
cells grow in number with the table wherever the vectors have structure.

Equal vectors are one entry of the index, with their smallest ids (as many as
a result can show), so that a vector shared by many rows costs once.  The cells hold numbers of entries only.  A cell
with more than ``CELL_ROWS`` entries, or queries, is dealt to several parts:
every entry still meets every query of its cell.  Parts that both sides have are dealt to groups, and a vector
goes to a group once, however many of its cells are there.

Defined results: vectors that are null or zero or hold a null, NaN or infinite
component neither ask nor answer, nor do rows without id; a repeated row counts once; an id
with several vectors is answered, and answers, by the nearest of them, in one row; vectors of another
length never meet; ties go to the smaller id; with too few candidates a query has fewer
rows; an empty table gives an empty result; other columns aren't touched.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from anchorline.llm.common import fmix, materialize, table

TABLES, SEED = 5, 7
#: Choices of ``tuned``: numbers of hashes, cell widths and cells visited a table; the share of neighbours to be found in the sample.
HASHES, WIDTHS, PROBES, TARGET = (2, 4, 6, 8, 12, 16), (0.75, 1.5, 3.0), (1, 2, 4, 8, 16, 32, 64, 96), 0.97
SAMPLE_QUERIES, SAMPLE_ENTRIES = 32, 3_000
#: Entries, or queries, of a part of a cell; entries and queries with their cells of a group.
CELL_ROWS, GROUP_ROWS = 20_000, 50_000


def planes(dim: int, tables: int, hashes: int, width: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([seed, dim])
    return rng.standard_normal((tables, hashes, dim)), rng.uniform(0, width, (tables, hashes))


def perturbations(below: np.ndarray, count: int) -> list[list[tuple[int, int]]]:
    """The likeliest ``count`` sets of (coordinate, step), the empty one first, for the distances to the lower borders in cell widths."""
    steps = sorted([(f * f, i, -1) for i, f in enumerate(below)] + [((1 - f) ** 2, i, 1) for i, f in enumerate(below)])
    out: list[list[tuple[int, int]]] = [[]]
    heap = [(steps[0][0], (0,))]
    while heap and len(out) < count:
        cost, at = heapq.heappop(heap)
        if len({steps[j][1] for j in at}) == len(at):
            out.append([steps[j][1:] for j in at])
        last = at[-1]
        if last + 1 < len(steps):
            heapq.heappush(heap, (cost - steps[last][0] + steps[last + 1][0], (*at[:-1], last + 1)))
            heapq.heappush(heap, (cost + steps[last + 1][0], (*at, last + 1)))
    return out


def _cell_ids(cells: np.ndarray, dim: int) -> np.ndarray:
    """One 64-bit number for the cells (rows) of a table."""
    h = np.full(len(cells), dim, np.uint64)
    for j in range(cells.shape[1]):
        h = fmix(h * np.uint64(0x9E3779B97F4A7C15) + cells[:, j].astype(np.int64).view(np.uint64))
    return h.view(np.int64)


def _matrix(column: pa.ListArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Vectors by length: row numbers and a double matrix."""
    lengths = np.diff(np.asarray(column.offsets))
    flat = np.asarray(column.flatten()).astype(np.float64)
    starts = np.cumsum(lengths) - lengths
    found = {}
    for d in np.unique(lengths):
        rows = np.flatnonzero(lengths == d)
        found[int(d)] = rows, flat[starts[rows][:, None] + np.arange(d)]
    return found


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled by powers of two, which is exact, so that squares neither overflow nor vanish."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def _normal(x: np.ndarray) -> np.ndarray:
    x = _unit(x)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _hash_rows(probes: int, tables: int, hashes: int, width: float, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dim, (rows, x) in _matrix(b.column("embedding")).items():
                a, shift = planes(dim, tables, hashes, width, seed)
                unit = _normal(x)
                for t in range(tables):
                    v = (unit @ a[t].T + shift[t]) / width
                    cell = np.floor(v).astype(np.int64)
                    take, ids = rows, cell
                    if probes > 1:
                        sets = [perturbations(f, probes) for f in v - cell]
                        take = np.repeat(rows, [len(s) for s in sets])
                        ids = np.repeat(cell, [len(s) for s in sets], axis=0)
                        for k, s in enumerate(s for one in sets for s in one):
                            for i, step in s:
                                ids[k, i] += step
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(take), t, np.int32)), pa.array(_cell_ids(ids, dim)), b.column("eid").take(pa.array(take))], ["t", "cell", "eid"])

    return run


def _exact(x: np.ndarray, q: np.ndarray, rep: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each row of q: the places and cosines of its k best rows of x; of equal ones those of smaller ``rep``."""
    x, q = _unit(x), _unit(q)
    own, theirs = np.sqrt(np.einsum("ij,ij->i", q, q)), np.sqrt(np.einsum("ij,ij->i", x, x))
    for lo in range(0, len(q) if len(x) else 0, 256):
        rough = (q[lo : lo + 256] @ x.T) / own[lo : lo + 256, None] / theirs[None, :]
        for i, row in enumerate(rough, lo):
            near = np.arange(len(x)) if len(x) <= k else np.flatnonzero(row >= np.partition(row, len(x) - k)[len(x) - k] - 1e-12)
            score = np.einsum("ij,j->i", x[near], q[i]) / (theirs[near] * own[i])
            by = np.lexsort((rep[near], -score))[:k]
            yield i, near[by], score[by]


def _best(k: int):
    """Of a group's entries and queries: for each cell that both are in, each query's k best entries there, by exact cosine."""

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        asks, rep, eid = (np.asarray(group.column(c)) for c in ("asks", "rep", "eid"))
        found: list[np.ndarray] = []
        if asks.any() and not asks.all():
            cells = group.column("cells").chunk(0)
            owner, cell = np.repeat(np.arange(len(asks)), np.diff(np.asarray(cells.offsets))), np.asarray(cells.flatten())
            by = np.lexsort((owner, asks[owner], cell))
            owner, cell = owner[by], cell[by]
            place, kind = np.empty(len(asks), np.int64), np.empty(len(asks), np.int64)
            vectors = []
            for rows, x in _matrix(group.column("embedding").chunk(0)).values():
                place[rows], kind[rows] = np.arange(len(rows)), len(vectors)
                vectors.append(x)
            cut = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1], True])
            for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                # a cell's number is made of the vectors' length too
                mine = owner[lo:hi]
                middle = int(np.searchsorted(asks[mine], True))
                c, q = mine[:middle], mine[middle:]
                if len(c) and len(q):
                    x = vectors[kind[c[0]]]
                    for i, near, score in _exact(x[place[c]], x[place[q]], rep[c], k):
                        found.append(np.stack([np.full(len(near), eid[q[i]]), eid[c[near]], rep[c[near]], score.view(np.int64)]))
        out = np.concatenate(found, axis=1) if found else np.zeros((4, 0), np.int64)
        once = np.unique(out[:2], axis=1, return_index=True)[1]
        out = out[:, once]
        return pa.table({"q": out[0], "eid": out[1], "rep": out[2], "score": np.ascontiguousarray(out[3]).view(np.float64)})

    return run


def _top(df: DataFrame, by: str, k: int, *order) -> DataFrame:
    return df.withColumn("n", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), *order))).where(F.col("n") <= k)


def _sample(df: DataFrame, n: int) -> DataFrame:
    return df.orderBy(F.xxhash64("eid", F.lit(3)), "eid").limit(n)


def _true_neighbours(entries: DataFrame, asked: list[np.ndarray], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(query, neighbour) pairs of vectors: the k nearest entries of each asked vector, other than its own copy, by one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dim, (rows, x) in _matrix(b.column("embedding")).items():
                mine = [i for i, v in enumerate(asked) if len(v) == dim]
                if mine:
                    for i, near, score in _exact(x, np.stack([asked[i] for i in mine]), rows, k + 1):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(near), mine[i])), b.column("eid").take(pa.array(rows[near])), pa.array(score)], ["q", "eid", "score"])

    met = _top(entries.mapInArrow(run, "q long, eid long, score double").where("score < 1 - 1e-12"), "q", k, "eid")
    return [(asked[r.q], np.array(r.embedding, np.float64)) for r in met.join(entries, "eid").select("q", "embedding").collect()]


def tuned(entries: DataFrame, queries: DataFrame, k: int = 5, tables: int = TABLES, seed: int = SEED) -> tuple[int, float, int]:
    """(hashes, width, probes) of least cost that find TARGET of the sample's neighbours; entries, queries: eid, embedding."""
    asked = [np.array(r.embedding, np.float64) for r in _sample(queries, SAMPLE_QUERIES).select("embedding").collect()]
    some = [np.array(r.embedding, np.float64) for r in _sample(entries, SAMPLE_ENTRIES).select("embedding").collect()]
    pairs = _true_neighbours(entries, asked, k)
    best = (np.inf, HASHES[0], WIDTHS[-1], PROBES[-1])
    if not pairs:
        return best[1:]
    dim = max({len(q) for q, _ in pairs}, key=lambda d: sum(len(q) == d for q, _ in pairs))
    q, of = np.unique(np.stack([q for q, _ in pairs if len(q) == dim]), axis=0, return_inverse=True)
    of = of.ravel()
    q, near, far = _normal(q), _normal(np.stack([v for u, v in pairs if len(u) == dim])), _normal(np.stack([v for v in some if len(v) == dim] or [q[0]]))
    for hashes in HASHES:
        for width in WIDTHS:
            a, shift = planes(dim, tables, hashes, width, seed)
            met, seen = np.full(len(near), PROBES[-1] + 1.0), np.full((len(q), len(far)), PROBES[-1] + 1.0)
            for t in range(tables):
                v = (q @ a[t].T + shift[t]) / width
                cell = np.floor(v)
                f = v - cell
                costs = [np.array([sum(g[i] ** 2 if d < 0 else (1 - g[i]) ** 2 for i, d in s) for s in perturbations(g, PROBES[-1])]) for g in f]

                def turns(x: np.ndarray, asks: np.ndarray, f=f, cell=cell, costs=costs, t=t, a=a, shift=shift, width=width) -> np.ndarray:
                    """After how many visited cells query asks[i] comes to the cell of x[i]; infinite if never."""
                    step = np.floor((x @ a[t].T + shift[t]) / width) - cell[asks]
                    cost = np.where(step < 0, f[asks] ** 2, np.where(step > 0, (1 - f[asks]) ** 2, 0)).sum(1)
                    reached = np.abs(step).max(1) <= 1
                    out = np.full(len(x), np.inf)
                    for i in np.unique(asks[reached]):
                        mine = reached & (asks == i)
                        out[mine] = np.searchsorted(costs[i], cost[mine] - 1e-12) + 1
                    return out

                met = np.minimum(met, turns(near, of))
                # all queries' distances in cells to the sample's cells, a query at a time only where they are near
                here = np.floor((far @ a[t].T + shift[t]) / width)
                for i in range(len(q)):
                    step = here - cell[i]
                    close = np.flatnonzero(np.abs(step).max(1) <= 1)
                    cost = np.where(step[close] < 0, f[i] ** 2, np.where(step[close] > 0, (1 - f[i]) ** 2, 0)).sum(1)
                    seen[i, close] = np.minimum(seen[i, close], np.searchsorted(costs[i], cost - 1e-12) + 1)
            for probes in PROBES:
                # a visited cell costs a row in the joins, a candidate a comparison
                cost = (seen <= probes).mean() + 1e-4 * probes
                if (met <= probes).mean() >= TARGET and cost < best[0]:
                    best = (cost, hashes, width, probes)
    return best[1:]


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, tables: int = TABLES, hashes: int | None = None, width: float | None = None, probes: int | None = None, seed: int = SEED) -> DataFrame:
    """vectors, queries: vec_id, embedding; a query's own id is never its answer. Returns query_id, rank, vec_id, score."""
    finite = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    sound = lambda df: df.select(F.col("vec_id").cast("long"), "embedding").where(finite).dropDuplicates()
    rows = sound(vectors)
    first = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    few = rows.withColumn("n", first).where(F.col("n") <= k + 1)
    entries = few.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select(F.monotonically_increasing_id().alias("eid"), F.col("ids")[0].alias("rep"), "ids", "embedding")
    entries = materialize(entries, "ann-entries")
    # an id with several vectors may fill as many places; usually one
    many = vectors.where("vec_id is not null").groupBy("vec_id").agg(F.count("*").alias("c")).where("c > 1").limit(1).count()
    most = (k + 1) * (max(1, rows.groupBy("vec_id").agg(F.count("*").alias("c")).agg(F.max("c")).first()[0] or 1) if many else 1)
    asked = sound(queries).withColumnRenamed("vec_id", "query_id")
    unique = materialize(asked.groupBy("embedding").agg(F.min("query_id").alias("rep")).select(F.monotonically_increasing_id().alias("eid"), "rep", "embedding"), "ann-queries")
    asked = asked.join(unique.select("embedding", "eid"), "embedding").select("query_id", F.col("eid").alias("q"))
    if hashes is None or width is None or probes is None:
        hashes, width, probes = tuned(entries.select("eid", "embedding"), unique.select("eid", "embedding"), k, tables, seed)

    shape = "t int, cell long, eid long"
    index = materialize(entries.select("eid", "embedding").mapInArrow(_hash_rows(1, tables, hashes, width, seed), shape), "ann-index")
    visits = materialize(unique.select("eid", "embedding").mapInArrow(_hash_rows(probes, tables, hashes, width, seed), shape), "ann-visits")
    parts = lambda df, name: df.groupBy("t", "cell").agg(F.ceil(F.count("*") / CELL_ROWS).cast("int").alias(name))
    cells = parts(index, "pi").join(parts(visits, "pv"), ["t", "cell"])

    groups = max(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(index.count() + visits.count()) // GROUP_ROWS))

    def dealt(df: DataFrame, of: DataFrame, own: str, other: str, asks: bool) -> DataFrame:
        mine, all_of = F.pmod(F.xxhash64("eid"), F.col(own)).cast("int"), F.explode(F.sequence(F.lit(0), F.col(other) - 1))
        placed = df.join(cells, ["t", "cell"]).withColumn(f"g_{own}", mine).withColumn(f"g_{other}", all_of)
        placed = placed.select("eid", F.xxhash64("t", "cell", "g_pi", "g_pv").alias("cell")).withColumn("g", F.pmod(F.xxhash64("cell", F.lit(5)), F.lit(groups)))
        # a vector goes to a group once, with all its cells there
        placed = placed.groupBy("g", "eid").agg(F.collect_list("cell").alias("cells"))
        return placed.join(of.select("eid", "rep", "embedding"), "eid").select("g", F.lit(asks).alias("asks"), "eid", "cells", "rep", "embedding")

    met = dealt(index, entries, "pi", "pv", False).unionByName(dealt(visits, unique, "pv", "pi", True))
    found = met.groupBy("g").applyInArrow(_best(most), "q long, eid long, rep long, score double")
    merged = found.groupBy("q", "eid").agg(F.max("score").alias("score"), F.first("rep").alias("rep"))
    listed = _top(merged, "q", most, "rep").join(entries.select("eid", "ids"), "eid").select("q", "score", F.explode("ids").alias("vec_id"))
    answers = asked.join(listed, "q").where("vec_id <> query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return _top(answers, "query_id", k, "vec_id").select("query_id", F.col("n").alias("rank"), "vec_id", "score")


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 50 = 0"))
