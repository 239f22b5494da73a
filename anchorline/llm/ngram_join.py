"""Jaccard self-join of documents on n-word shingles by T-occurrence search.

Links join documents whose shingle sets have a Jaccard similarity of
``percent`` / 100 or more; the result gives each document's component.

1. Equal sets are one node, known by a 64-bit fingerprint; everything below costs
   once for any number of copies.
2. Candidates.  Two linked sets of sizes n <= m differ in d(n) shingles at most.
   Shingles are dealt by hash to K > d(n) parts, so that some part is equal in
   both; the hash of each part's shingles is a signature.  K depends on a class
   of sizes; a set close to the next lower class signs for that one too.  Shingles
   of passages that unlike texts share, as far as a sample shows them, don't count in the parts: leaving
   shingles out of all sets only lowers their differences.  Empty parts don't
   sign: K exceeds d(n) by more than the empty parts of nearly every set, and
   sets with more of them sign with all their shingles as well.  So no linked
   pair is lost, whatever the sample holds.
   Sorted by signature, each run of sets is a star of candidate edges.
3. The candidate graph's components are dealt to blocks of a bounded number of
   shingles (small components share one).  In a block, DivideSkip finds the
   links: for each set, the inverted lists but the L longest are merged; what
   occurs T - L times in them is looked up in the long ones by binary probes, and
   what reaches the overlap that the two sizes require is a link.  Sets that
   are in one component already needn't be compared.
4. A candidate component larger than a block is split.  After its blocks, one
   set of each local component is searched against the others, and then every
   set outside the largest component so far against all blocks, since a
   missing link must have an end there.

Defined results: null, empty and blank texts have no shingles, no links, and are
their own component; a text of fewer words than a shingle is one shingle; ties
don't matter; a null id can be in a component but never names it; a very long text is one set, held by
one task at a time; an empty table gives an empty result; further columns play no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from anchorline.llm.common import WORD_CLASS, chunks, fmix, materialize, shingle_set, table, text_bytes, word_hashes
from anchorline.llm.components import connected

#: Shingles of a block; components above a quarter of it have blocks of their own.
BLOCK = 4_000_000
#: At most so many candidate sets (ids and numbers, some 50 bytes each) are broadcast to the texts.
BROADCAST_SETS = 400_000
#: The sample in which shared passages are sought, and the most of their shingles that are set aside.
SAMPLE_TEXTS, COMMON = 8_000, 200_000
#: DivideSkip's factor of the length of the longest list, and the long lists that are probed at once.
MU, PROBES = 0.01, 32
_EMPTY = np.uint64(0x5851F42D4C957F2D)


def fingerprint(s: np.ndarray) -> np.uint64:
    return fmix(np.array([fmix(s ^ _EMPTY).sum(dtype=np.uint64) + np.uint64(len(s))], np.uint64))[0]


def most_differences(n: int, percent: int) -> int:
    """The most shingles in which a set of n and a linked one of n or more can differ."""
    return (n + 100 * n // percent) * (100 - percent) // (100 + percent)


@lru_cache(maxsize=4096)
def size_class(n: int) -> tuple[int, int, int]:
    """Number, smallest and largest size of the class of n: each is half as large again as the one before."""
    k, low = 0, 1
    while True:
        high = low + max(1, low // 2) - 1
        if n <= high:
            return k, low, high
        k, low = k + 1, high + 1


@lru_cache(maxsize=4096)
def parts_for(n: int, percent: int) -> tuple[tuple[int, int, int], ...]:
    """(class, parts, differences) that a set of n signs for."""
    out = []
    k, low, high = size_class(n)
    while True:
        d = most_differences(high, percent)
        spare = 2 if d else 0
        while d and spare < d and (d + 1 + spare) * np.exp(-low / (d + 1 + spare)) * 1.5 > spare:
            spare += max(1, spare // 4)
        out.append((k, d + 1 + spare, d))
        if low == 1 or 100 * (low - 1) // percent < n:
            return tuple(out)
        k, low, high = size_class(low - 1)


def _part_hashes(s: np.ndarray, k: int, parts: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each part: the hash of its shingles, and whether it has any."""
    part = (s % np.uint64(parts)).astype(np.int64)
    sums = np.zeros(parts, np.uint64)
    np.add.at(sums, part, fmix(s + _EMPTY))
    which = np.arange(parts, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return fmix(sums + which + np.uint64(((2 * k + salt + 1) * 0xD1342543DE82EF95) % 2**64)), np.bincount(part, minlength=parts) > 0


def signatures(s: np.ndarray, percent: int, common: np.ndarray | None = None) -> np.ndarray:
    """Signatures of a set; two linked sets share one, whatever ``common`` (sorted) is.

    Shingles in ``common`` take no part in the first kind, which a set signs with
    its parts that aren't empty: of two linked sets one of which has less empty parts than
    spare ones, some equal part isn't empty.  A set with more empty parts signs with all its
    shingles too, and, if even then too many are empty, with the empty parts.
    """
    found = []
    rest = s
    if common is not None and len(common):
        rest = s[common[np.minimum(np.searchsorted(common, s), len(common) - 1)] != s]
    for k, parts, d in parts_for(len(s), percent):
        h, full = _part_hashes(rest, k, parts, 0)
        found.append(h[full])
        if parts - int(full.sum()) >= parts - d:
            h, full = _part_hashes(s, k, parts, 1)
            found.append(h if parts - int(full.sum()) >= parts - d else h[full])
    return np.concatenate(found)


def _sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray]]:
    for b in batches:
        data, offsets = text_bytes(b.column("text"))
        for i, j in chunks(offsets):
            h, per, _, _ = word_hashes(data, offsets[i : j + 1], lower=True)
            at = np.r_[0, np.cumsum(per)]
            for k in range(j - i):
                yield b, i + k, shingle_set(h[at[k] : at[k + 1]], n)


def _describe(n: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [(len(s), int(fingerprint(s).view(np.int64)) if len(s) else None) for _, _, s in _sets(iter([b]), n)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("th"), pa.array([x[0] for x in sets], pa.int64()), pa.array([x[1] for x in sets], pa.int64())], ["doc_id", "th", "n_shingles", "fp"])

    return run


def _sample_shingles(n: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, s in _sets(batches, n):
            if len(s):
                yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64)), pa.array(np.full(len(s), len(s), np.int64))], ["h", "n"])

    return run


def common_shingles(texts: DataFrame, each: DataFrame, n: int, percent: int) -> np.ndarray:
    """Shingles that texts of unlike sizes share, in a sample: passages rather than copies. They steer cost, never results."""
    chosen = each.where("fp is not null").groupBy("fp").agg(F.min(F.struct("doc_id", "th")).alias("d")).orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE_TEXTS).select("d.doc_id", "d.th")
    some = texts.join(F.broadcast(chosen), ["doc_id", "th"]).select("text").mapInArrow(_sample_shingles(n), "h long, n long")
    seen = some.groupBy("h").agg(F.count("*").alias("c"), F.min("n").alias("lo"), F.max("n").alias("hi")).where(f"c >= 3 and hi * {percent} > lo * 125")
    top = seen.orderBy(F.desc("c"), "h").limit(COMMON).select("h").toArrow()
    return np.sort(top["h"].to_numpy().view(np.uint64))


def _sign(n: int, percent: int, common: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        sigs: list[np.ndarray] = []
        fps: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.concatenate(fps).view(np.int64))], ["sig", "fp"])
            sigs.clear(), fps.clear()
            return out

        for _, _, s in _sets(batches, n):
            if not len(s) or (f := fingerprint(s)) in seen:
                continue
            if len(seen) > 500_000:
                seen.clear()
            seen.add(f)
            g = signatures(s, percent, common)
            sigs.append(g), fps.append(np.full(len(g), f))
            held += len(g)
            if held > 200_000:
                yield flush()
                held = 0
        if held:
            yield flush()

    return run


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by sig and fp: an edge from each set to the first one of its signature."""
    sig, hub = None, None
    for b in batches:
        s, f = b.column("sig").to_numpy(), b.column("fp").to_numpy()
        if not len(s):
            continue
        new = np.r_[sig is None or s[0] != sig, s[1:] != s[:-1]]
        first = np.where(new, np.arange(len(s)), 0)
        hubs = f[np.maximum.accumulate(first)]
        if not new[0]:
            hubs[: int(np.argmax(new)) if new.any() else len(s)] = hub
        sig, hub = s[-1], hubs[-1]
        far = hubs != f
        if far.any():
            u, v = np.unique(np.stack([f[far], hubs[far]]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])


class Links:
    """Components of the sets of a block: ``of`` numbers each set's component by its smallest member."""

    def __init__(self, n: int):
        self.of = np.arange(n)
        self.members = [[i] for i in range(n)]

    def join(self, i: int, j: int) -> None:
        a, b = int(self.of[i]), int(self.of[j])
        if a == b:
            return
        if len(self.members[a]) < len(self.members[b]):
            a, b = b, a
        name = min(a, b)
        moved = self.members[b] if name == a else self.members[a] + self.members[b]
        self.of[moved] = name
        both = self.members[a]
        both.extend(self.members[b])
        self.members[a] = self.members[b] = []
        self.members[name] = both


def _ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The numbers of all ranges [lo, hi), one after the other."""
    n = hi - lo
    at = np.cumsum(n) - n
    return np.arange(int(n.sum())) - np.repeat(at - lo, n)


def long_lists(need: int, longest: int) -> int:
    """DivideSkip's number of long lists: T / (mu log M + 1), T - 1 at most."""
    return max(0, min(need - 1, int(need / (MU * np.log2(max(2, longest)) + 1))))


def divide_skip(sets: list[np.ndarray], percent: int, ask: np.ndarray | None = None, links: Links | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """Yields (i, linked places) for sets in order of size; each pair once, those only with an end in ``ask`` if given.

    Sets must come in order of size; a pair is found at its later place.  Of a set's inverted
    lists the L longest are set apart.  Merging the others gives the places that occur there
    T - L times at least (all other places are skipped); these are looked up in the long lists by
    binary probes, until the overlap that the two sizes require is reached or out of reach.
    With ``links``, pairs inside a component needn't be known: of the candidates of each component
    one is probed, then twice as many as before, until one is linked or none is left.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    # one sort makes the numbers of the shingles and the order of the postings; 32 bits hold both
    flat = np.concatenate(sets)
    by = np.argsort(flat, kind="stable")
    flat = flat[by]
    number = np.cumsum(np.r_[False, flat[1:] != flat[:-1]], dtype=np.int32)
    del flat
    df = np.bincount(number)
    where = np.empty(len(by), np.int32)
    where[by] = number
    postings = np.repeat(np.arange(n, dtype=np.int32), sizes)[by]
    del by
    keys = number.astype(np.int64)
    del number
    keys *= n
    keys += postings
    cut = np.r_[0, np.cumsum(sizes)]
    for q in range(1, n):
        m = int(sizes[q])
        first = int(np.searchsorted(sizes[:q], -(-percent * m // 100)))
        if not m or first >= q:
            continue
        need = -(-percent * (m + int(sizes[first])) // (100 + percent))
        mine = where[cut[q] : cut[q + 1]].astype(np.int64)
        mine = mine[df[mine] > 1]
        if len(mine) < need:
            continue
        lo, hi = np.searchsorted(keys, mine * n + first), np.searchsorted(keys, mine * n + q)
        some = hi > lo
        if int(some.sum()) < need:
            continue
        mine, lo, hi = mine[some], lo[some], hi[some]
        order = np.argsort(hi - lo, kind="stable")
        mine, lo, hi = mine[order], lo[order], hi[order]
        apart = long_lists(need, int(hi[-1] - lo[-1]))
        short = len(mine) - apart
        counts = np.bincount(postings[_ranges(lo[:short], hi[:short])] - first, minlength=q - first)
        candidates = np.flatnonzero(counts >= need - apart)
        if ask is not None and not ask[q]:
            candidates = candidates[ask[candidates + first]]
        if links is not None:
            candidates = candidates[np.argsort(-counts[candidates], kind="stable")]
        found, take = [], 1
        while len(candidates):
            now, rest = candidates, candidates[:0]
            if links is not None:
                of = links.of[candidates + first]
                open_ = of != links.of[q]
                candidates, of = candidates[open_], of[open_]
                by_part = np.argsort(of, kind="stable")
                begin = np.r_[True, of[by_part][1:] != of[by_part][:-1]] if len(of) else np.zeros(0, bool)
                turn = np.arange(len(of)) - np.maximum.accumulate(np.where(begin, np.arange(len(of)), 0))
                now, rest = candidates[by_part[turn < take]], candidates[np.sort(by_part[turn >= take])]
                take *= 2
            total, least = counts[now], -(-percent * (m + sizes[now + first]) // (100 + percent))
            for k in range(short, len(mine), PROBES):
                keep = total + (len(mine) - k) >= least
                now, total, least = now[keep], total[keep], least[keep]
                if not len(now):
                    break
                key = mine[k : k + PROBES, None] * n + now + first
                at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                total = total + (keys[at] == key).sum(0)
            ok = now[total >= least]
            if len(ok):
                found.append(ok + first)
                if links is not None:
                    for p in ok.tolist():
                        links.join(q, p + first)
            candidates = rest
        if found:
            yield q, np.sort(np.concatenate(found))


def _search(percent: int, asked: bool) -> Callable:
    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        column = group.column("shingles").chunk(0) if group.num_rows else None
        flat, off = np.asarray(column.flatten()).view(np.uint64), np.asarray(column.offsets)
        off = off - off[0]
        fp = np.asarray(group.column("fp"))
        size = np.diff(off)
        _, once = np.unique(fp, return_index=True)
        order = once[np.lexsort((fp[once], size[once]))]
        sets = [flat[off[i] : off[i + 1]] for i in order]
        ask = np.asarray(group.column("ask"))[order] if asked else None
        links = Links(len(sets))
        for _ in divide_skip(sets, percent, ask, links):
            pass
        return pa.table({"fp": fp[order], "root": fp[order][links.of]})

    return run


def _rooted(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, fp and root (both null without shingles) of every row of docs (doc_id, text); linked texts have one root."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    each = materialize(texts.mapInArrow(_describe(n), "doc_id long, th long, n_shingles long, fp long"), "join-sets")
    signed = texts.select("text").mapInArrow(_sign(n, percent, common_shingles(texts, each, n, percent)), "sig long, fp long")
    stars = signed.repartition("sig").sortWithinPartitions("sig", "fp").mapInArrow(_stars, "u long, v long")
    clusters = materialize(connected(stars, "join-candidates").select(F.col("node").alias("fp"), F.col("root").alias("cluster")), "join-clusters")

    # one text of each candidate set
    first = each.where("fp is not null").groupBy("fp").agg(F.min(F.struct("doc_id", "th", "n_shingles")).alias("d")).select("fp", "d.doc_id", "d.th", "d.n_shingles")
    wanted = materialize(clusters.join(first, "fp"), "join-wanted")
    plans = wanted.groupBy("cluster").agg(F.sum("n_shingles").alias("weight"))
    total = wanted.agg(F.sum("n_shingles")).first()[0] or 0
    bins = max(1, -(-total // (BLOCK // 4)))
    blocks = F.when(F.col("weight") * 4 <= BLOCK, 0).otherwise(F.ceil(F.col("weight") / BLOCK)).cast("int")
    plans = plans.select("cluster", blocks.alias("blocks"))
    placed = wanted.join(plans, "cluster").select("fp", "cluster", "blocks", "doc_id", "th", F.when(F.col("blocks") == 0, F.pmod(F.xxhash64("cluster"), F.lit(bins))).otherwise(F.pmod(F.xxhash64("fp"), F.col("blocks"))).cast("int").alias("block"))
    # a null or repeated id may stand for many texts: rows meet by the hash of the text as well, and the fingerprint decides
    placed = materialize(placed.withColumn("own", F.when(F.col("blocks") == 0, F.lit(0)).otherwise(F.col("cluster")).cast("long")), "join-placed")
    small = placed.count() <= BROADCAST_SETS
    # few candidates go to where the texts are; many meet them by merging
    at, to = (texts, F.broadcast(placed)) if small else (texts.hint("merge"), placed)
    source = at.join(to, texts["doc_id"].eqNullSafe(placed["doc_id"]) & (texts["th"] == placed["th"])).select("text", "fp", "own", "blocks", "block")
    sets = source.mapInArrow(_shingles_of(n), "fp long, own long, blocks int, block int, shingles array<long>")
    split = bool(placed.where("blocks > 1").limit(1).count())
    if split:
        # a text of repeated rows may be there once a task; a search takes it once
        sets = materialize(sets, "join-shingles")
    roots = materialize(sets.groupBy("own", "blocks", "block").applyInArrow(_search(percent, False), "fp long, root long"), "join-roots")
    if split:
        roots = materialize(_across(sets, roots, percent), "join-across")
    return each.join(roots, "fp", "left").select("doc_id", "th", "n_shingles", "fp", F.coalesce("root", "fp").alias("root"))


def jaccard_components(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, fp (null without shingles), component_id of every row of docs (doc_id, text)."""
    named = _rooted(docs, n, percent)
    least = named.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("least"))
    return named.join(least, "root", "left").select("doc_id", "n_shingles", "fp", F.coalesce("least", "doc_id").alias("component_id"))


def _shingles_of(n: int) -> Callable:
    """The shingle sets of the texts that have the fingerprint they are joined to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for b in batches:
            rows: list[int] = []
            sets: list[np.ndarray] = []
            wanted = b.column("fp").to_pylist()
            for _, i, s in _sets(iter([b]), n):
                # rows that are repeated whole count once a task
                if len(s) and wanted[i] not in done and int(fingerprint(s).view(np.int64)) == wanted[i]:
                    rows.append(i), sets.append(s), done.add(wanted[i])
            cut = np.r_[0, np.cumsum([len(s) for s in sets])].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(cut), pa.array(np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)))
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(at) for c in ("fp", "own", "blocks", "block")), lists], ["fp", "own", "blocks", "block", "shingles"])

    return run


def _across(sets: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """The links between the blocks of split components, joined to those inside them.

    Which sets meet in which task is planned on rows without shingles; these are shuffled to the tasks only.
    """
    plain = sets.where("blocks > 1").select("fp", "own", "blocks", "block", F.size("shingles").alias("n")).distinct().join(roots, "fp")
    plain = materialize(plain, "join-plain")
    edges = roots.select(F.col("fp").alias("u"), F.col("root").alias("v"))

    def dealt(rows: DataFrame, name: str, *salt: Column) -> DataFrame:
        """rows with the part of their component that they are in, parts being of BLOCK shingles."""
        many = rows.groupBy("own").agg(F.ceil(F.sum("n") / BLOCK).alias("_parts"))
        return rows.join(many, "own").withColumn(name, F.pmod(F.xxhash64("fp", *salt), F.col("_parts")).cast("int")).drop("_parts")

    def searched(rows: DataFrame, by: list[str], asked: bool) -> DataFrame:
        met = rows.join(sets.select("fp", "shingles"), "fp")
        return met.groupBy(*by).applyInArrow(_search(percent, asked), "fp long, root long").select(F.col("fp").alias("u"), F.col("root").alias("v"))

    heads = dealt(plain.where(F.col("fp") == F.col("root")).select("fp", "own", "n"), "block")
    edges = materialize(edges.unionByName(searched(heads.select("fp", "own", "block"), ["own", "block"], False)), "join-heads")
    now = connected(edges, "join-local").select(F.col("node").alias("fp"), "root")
    split = plain.drop("root").join(now, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    main = split.groupBy("own", "root").agg(F.count("*").alias("c")).groupBy("own").agg(F.max_by("root", "c").alias("main"))
    split = materialize(split.join(main, "own").withColumn("ask", F.col("root") != F.col("main")), "join-split")
    minor = dealt(split.where("ask"), "part", F.lit(1))
    parts = minor.groupBy("own").agg((F.max("part") + 1).alias("parts"))
    columns = ["own", "part", "block", "fp", "ask"]
    asks = minor.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(*columns)
    # minor sets meet each other too: those of each block are there as told ones
    told = split.join(parts, "own").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(*columns)
    more = searched(asks.unionByName(told), ["own", "part", "block"], True)
    edges = materialize(edges.unionByName(more).distinct(), "join-edges")
    return connected(edges, "join-all").select(F.col("node").alias("fp"), "root")


def without_near_copies(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One row of docs (with its columns) of each component: that with the least id, of equal texts with it the first by a hash of the row.

    Each row whose text has no shingles stays; a row without id stays only if no row with an id is linked to it.  An empty table stays empty; columns may have any name.
    """
    lead = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp", "th"))
    first = _rooted(docs, n, percent).where("root is not null").groupBy("root").agg(lead.alias("d"))
    first = first.select(F.col("d.doc_id").alias("k_id"), F.col("d.th").alias("k_th"))
    # an id may be null or stand for several texts, so that rows are known by the hash of their text too; a row without words has a key of its own
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", F.xxhash64(text).alias("th"), F.when(~text.rlike(WORD_CLASS), F.monotonically_increasing_id()).alias("blank"))
    # repeated rows are brought down to one before they are shuffled
    once = rows.groupBy("doc_id", "th", "blank").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"))
    kept = once.join(first.withColumn("first", F.lit(True)), once["doc_id"].eqNullSafe(first["k_id"]) & (once["th"] == first["k_th"]), "left").where("blank is not null or first")
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard_components(docs).select("doc_id", "n_shingles", "component_id")


ORACLE_SQL = r"""
with recursive w as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0b\x0c\r]+'), lambda x: x <> '') as ws
  from documents),
s as (
  select distinct doc_id, g from (
    select doc_id, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] as g from (select doc_id, ws, unnest(generate_series(1, len(ws) - 2)) as i from w where len(ws) >= 3)
    union all select doc_id, array_to_string(ws, ' ') from w where len(ws) between 1 and 2)),
n as (select doc_id, count(*) as n from s group by doc_id),
pairs as (select a.doc_id as u, b.doc_id as v, count(*) as o from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
links as (select u, v from pairs join n a on a.doc_id = u join n b on b.doc_id = v where 100 * o >= 90 * (a.n + b.n - o)),
two as (select u, v from links union all select v, u from links),
reach(doc_id, r) as (select doc_id, doc_id from n union select reach.doc_id, two.v from reach join two on reach.r = two.u),
c as (select doc_id, min(r) as component_id from reach group by doc_id)
select d.doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, coalesce(c.component_id, d.doc_id) as component_id
from documents d left join n using (doc_id) left join c using (doc_id)
"""
