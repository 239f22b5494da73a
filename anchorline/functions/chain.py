"""The longest collinear chain of anchors, for batches of anchor lists.

For anchors in reference order, the best chain that ends at anchor i extends one
of the longest chains that end at an earlier anchor strictly before i in the
query; among equals, the one that ends first.  So it is enough to keep, for each
length, the chain of that length that ends first: an anchor extends the longest of these that
ends before it, and takes the place of the next one if it ends earlier.  Ends grow with
length, so that a count finds the place.  Reverse anchors are chained with negated
coordinates; the forward chain wins ties.

As an array expression this took a millisecond per list (nested lambdas are interpreted); here the lists of an
Arrow batch take each step together in numpy.  ``resolve`` does the same for all that happens to the anchors of a point: order,
majority chromosome, chain, and the anchors that its targets come from.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

#: Lists up to this length are padded and chained together, at most so many anchors at once; longer ones are searched one by one.
LONG, TOGETHER = 256, 1 << 20
_END = np.iinfo(np.int64).max


def bind(value: Column, body) -> Column:
    """body(value), with value evaluated once."""
    return F.transform(F.array(value), body)[0]


def _together(start: np.ndarray, end: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """The places of each row's chain; rows of ``start`` and ``end`` are padded."""
    rows, width = start.shape
    tails = np.full((rows, width), _END)
    holder, before = np.full((rows, width), -1), np.full((rows, width), -1)
    for w in range(width):
        r = np.flatnonzero(size > w)
        k = (tails[r, : w + 1] < start[r, w, None]).sum(1)
        before[r, w] = np.where(k > 0, holder[r, np.maximum(k - 1, 0)], -1)
        sooner = end[r, w] < tails[r, k]
        r, k = r[sooner], k[sooner]
        tails[r, k], holder[r, k] = end[r, w], w
    length = (holder >= 0).sum(1)
    out = np.full((rows, int(length.max(initial=0))), -1)
    at = np.where(length > 0, holder[np.arange(rows), np.maximum(length - 1, 0)], -1)
    for step in range(out.shape[1]):
        r = np.flatnonzero(length > step)
        out[r, length[r] - 1 - step] = at[r]
        at[r] = before[r, at[r]]
    return [out[r, : length[r]] for r in range(rows)]


def _alone(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    tails, holder, before = [], [], []
    for w, (s, e) in enumerate(zip(start.tolist(), end.tolist(), strict=True)):
        k = bisect_left(tails, s)
        before.append(holder[k - 1] if k else -1)
        if k == len(tails):
            tails.append(e), holder.append(w)
        elif e < tails[k]:
            tails[k], holder[k] = e, w
    out, at = [], holder[-1] if holder else -1
    while at >= 0:
        out.append(at)
        at = before[at]
    return np.array(out[::-1], np.int64)


def longest_chains(start: np.ndarray, end: np.ndarray, rev: np.ndarray, cut: np.ndarray) -> list[np.ndarray]:
    """Of each list of anchors (those between two numbers of ``cut``): the places of its longest collinear chain."""
    lists = len(cut) - 1
    owner = np.repeat(np.arange(lists), np.diff(cut))
    best: list[np.ndarray] = [np.zeros(0, np.int64)] * lists
    for back in (False, True):
        mine = np.flatnonzero(rev == back)
        s, e = (-start[mine], -end[mine]) if back else (start[mine], end[mine])
        size = np.bincount(owner[mine], minlength=lists)
        first = np.cumsum(size) - size
        place = mine - cut[owner[mine]]
        order = np.argsort(size, kind="stable")
        order = order[size[order] > 0]
        lo = 0
        while lo < len(order):
            widest = int(size[order[lo]])
            if widest > LONG:
                i = order[lo]
                found, some, lo = [_alone(s[first[i] : first[i] + widest], e[first[i] : first[i] + widest])], [i], lo + 1
            else:
                hi = min(len(order), int(np.searchsorted(size[order], min(LONG, widest + widest // 2 + 8), side="right")))
                hi = min(hi, lo + max(1, TOGETHER // int(size[order[hi - 1]])))
                some = order[lo:hi]
                width = int(size[some].max())
                at = np.minimum(first[some, None] + np.arange(width), len(s) - 1)
                found, lo = _together(s[at], e[at], size[some]), hi
            for i, c in zip(some, found, strict=True):
                if len(c) > len(best[i]):
                    best[i] = place[first[i] + c]
    return best


@F.arrow_udf(ArrayType(IntegerType()))
def _places(start: pa.Array, end: pa.Array, rev: pa.Array) -> pa.Array:
    cut = np.asarray(start.offsets).astype(np.int64)
    flat = lambda a, kind: np.asarray(a.flatten().to_numpy(zero_copy_only=False)).astype(kind)
    chains = longest_chains(flat(start, np.int64), flat(end, np.int64), flat(rev, bool), cut - cut[0])
    ends = np.r_[0, np.cumsum([len(c) for c in chains])].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(chains).astype(np.int32) if chains else np.zeros(0, np.int32)))


def chain_places(anchors: Column) -> Column:
    """The places (from 0) of the longest collinear chain. anchors: array of structs with qry_start, qry_end, qry_rev, in reference order."""
    return _places(*[anchors.getField(c) for c in ("qry_start", "qry_end", "qry_rev")])


def collinear_chain(anchors: Column) -> Column:
    """The anchors of the longest collinear chain."""
    return F.transform(chain_places(anchors), lambda i: F.get(anchors, i))


def major_chromosome(chroms: Column) -> Column:
    """The commonest value; the smallest of those that tie."""
    return bind(chroms, lambda cs: F.array_min(F.transform(F.array_distinct(cs), lambda c: F.struct((-F.size(F.filter(cs, lambda x: x == c))).alias("n"), c.alias("c"))))["c"])


_ANCHOR = "struct<ref_start: long, ref_end: long, qry_chrom: string, qry_start: long, qry_end: long, qry_rev: boolean>"
RESOLVED = f"struct<major: string, two_sided: boolean, n_kept: long, on: array<{_ANCHOR}>, up: {_ANCHOR}, down: {_ANCHOR}, chain: array<{_ANCHOR}>>"


def _first_of(owner: np.ndarray, n: int, *order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each owner below n the place that comes first in the order, and whether there is one."""
    by = np.lexsort((*reversed(order), owner))
    at = np.searchsorted(owner[by], np.arange(n))
    there = at < len(by)
    place = by[np.minimum(at, max(len(by) - 1, 0))] if len(by) else np.zeros(n, np.int64)
    there &= (owner[place] == np.arange(n)) if len(by) else False
    return place, there


def resolve(blocks, anchors: pa.StructArray, place: np.ndarray, owner: np.ndarray, is_up: np.ndarray, is_down: np.ndarray, loc: np.ndarray, least: int, with_chain: bool) -> pa.Array:
    """Of each position: the majority chromosome of its anchors (the smallest name among equals), whether it has anchors of it on both sides and how many in
    all, the anchors of their longest chain (of ``least`` or more) that lie over the position, and the nearest of it on either side.

    Anchors are places among ``blocks`` (numpy columns) and in ``anchors`` (the same in Arrow), each with the number of its position as owner and its side.
    """
    n = len(loc)
    a = {c: getattr(blocks, c)[place] for c in ("ref_start", "ref_end", "qry_start", "qry_end", "qry_rev")}
    chrom = blocks.chrom[place]
    many = max(len(blocks.spelled), 1)
    pairs, count = np.unique(owner * many + chrom, return_counts=True)
    best, some = _first_of(pairs // many, n, -count, pairs % many)
    major = np.where(some, pairs[best] % many if len(pairs) else 0, -1)
    kept = chrom == major[owner]
    has = [np.bincount(owner[kept & flag], minlength=n) > 0 for flag in (is_up, is_down)]
    two_sided = has[0] & has[1]
    order = np.lexsort((a["qry_rev"], a["qry_end"], chrom, a["qry_start"], a["ref_end"], a["ref_start"], owner))
    chosen = order[(kept & two_sided[owner])[order]]
    cut = np.searchsorted(owner[chosen], np.arange(n + 1))
    chains = longest_chains(a["qry_start"][chosen], a["qry_end"][chosen], a["qry_rev"][chosen], cut)
    size = np.array([len(c) if len(c) >= least else 0 for c in chains], np.int64)
    link = np.concatenate([cut[i] + chains[i] for i in np.flatnonzero(size)] or [np.zeros(0, np.int64)])
    link, of = chosen[link], np.repeat(np.arange(n), size)
    at = loc[of]
    before, after = a["ref_end"][link] < at, a["ref_start"][link] > at
    on = link[~before & ~after]
    number = np.arange(len(link))
    # the one that ends last, and the one that begins first; in each case the first of the chain
    up, up_there = _first_of(of[before], n, -a["ref_end"][link][before], number[before])
    down, down_there = _first_of(of[after], n, number[after])
    one = lambda rows, pick, there: anchors.take(pa.array(place[rows[pick]] if len(rows) else np.zeros(n, np.int64), mask=~there))
    listed = lambda rows, who: pa.ListArray.from_arrays(pa.array(np.searchsorted(who, np.arange(n + 1)), pa.int32()), anchors.take(pa.array(place[rows])))
    chromosomes = pa.array(blocks.spelled, pa.string()).take(pa.array(np.maximum(major, 0), mask=major < 0))
    nothing = pa.array([], anchors.type)
    columns = [chromosomes, pa.array(two_sided), pa.array(np.bincount(owner[kept], minlength=n)), listed(on, of[~before & ~after]), one(link[before], up, up_there), one(link[after], down, down_there)]
    columns.append(listed(link, of) if with_chain else pa.ListArray.from_arrays(pa.array(np.zeros(n + 1), pa.int32()), nothing))
    return pa.StructArray.from_arrays(columns, ["major", "two_sided", "n_kept", "on", "up", "down", "chain"])
