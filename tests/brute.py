"""Plain Python versions of the anchor search, the hop and the route search, for small inputs."""

from __future__ import annotations

import heapq
import itertools
import math
from collections import Counter

from anchorline.config import Settings


def ends(b):
    """b: (ref_start, length, qry_chrom, qry_start, rev) -> with inclusive ends."""
    s, n, c, q, rev = b
    return {"ref_start": s, "ref_end": s + n - 1, "qry_chrom": c, "qry_start": q, "qry_end": q - n + 1 if rev else q + n - 1, "qry_rev": rev, "length": n}


def longest(anchors):
    """All subsequences by dynamic programming over predecessors, with the documented choice among equals."""
    best = []
    for rev in (False, True):
        own = [a for a in anchors if a["qry_rev"] == rev]
        sign = -1 if rev else 1
        size, pred = [], []
        for i, a in enumerate(own):
            before = [(-size[j], own[j]["qry_end"] * sign, j) for j in range(i) if own[j]["qry_end"] * sign < a["qry_start"] * sign]
            top = min(before, default=None)
            size.append(1 - top[0] if top else 1)
            pred.append(top[2] if top else None)
        chain = []
        if own:
            i = min(range(len(own)), key=lambda i: (-size[i], own[i]["qry_end"] * sign, i))
            while i is not None:
                chain.append(own[i])
                i = pred[i]
        best.append(chain[::-1])
    return best[0] if len(best[0]) >= len(best[1]) else best[1]


def length_by_enumeration(anchors):
    """The longest collinear subsequence's length, from all subsets."""
    top = 0
    for rev in (False, True):
        own = [a for a in anchors if a["qry_rev"] == rev]
        sign = -1 if rev else 1
        for r in range(len(own), 0, -1):
            if any(all(x["qry_end"] * sign < y["qry_start"] * sign for x, y in itertools.pairwise(c)) for c in itertools.combinations(own, r)):
                top = max(top, r)
                break
    return top


def hop(blocks, loc, genome_size, s: Settings):
    """Targets of one point: (score, chrom, loc, up, down)."""
    es = [ends(b) for b in blocks]
    up = sorted((e for e in es if e["ref_end"] < loc), key=lambda e: (e["ref_end"], e["ref_start"], e["qry_start"], e["qry_chrom"], e["qry_rev"]))[-s.nearest :]
    down = sorted((e for e in es if e["ref_start"] > loc), key=lambda e: (e["ref_start"], e["qry_chrom"], e["qry_start"], e["qry_rev"], e["length"]))[: s.nearest]
    on = [e for e in es if e["ref_start"] <= loc <= e["ref_end"]]
    count = Counter(e["qry_chrom"] for e in up + down + on)
    if not count:
        return []
    major = min(count, key=lambda c: (-count[c], c))
    keep = lambda xs: [e for e in xs if e["qry_chrom"] == major]
    up, down, on = keep(up), keep(down), keep(on)
    if not up or not down:
        return []
    anchors = sorted(up + down + on, key=lambda e: (e["ref_start"], e["ref_end"], e["qry_start"], e["qry_chrom"], e["qry_end"], e["qry_rev"]))
    chain = longest(anchors)
    if len(chain) < s.least_chain:
        return []
    over = [e for e in chain if e["ref_start"] <= loc <= e["ref_end"]]
    if over:
        return [(1.0, major, e["qry_start"] + (loc - e["ref_start"]) * (-1 if e["qry_rev"] else 1), e, e) for e in over]
    ups, downs = [e for e in chain if e["ref_end"] < loc], [e for e in chain if e["ref_start"] > loc]
    if not ups or not downs:
        return []
    u, d = max(ups, key=lambda e: e["ref_end"]), min(downs, key=lambda e: e["ref_start"])
    score = 0.5 ** ((min(loc - u["ref_end"], d["ref_start"] - loc) / s.half_life) * (s.genome_basis / genome_size))
    part = (loc - u["ref_end"] + 0.5) / (d["ref_start"] - u["ref_end"])
    at = u["qry_end"] + part * (d["qry_start"] - u["qry_end"])
    return [(score, major, math.trunc(at), u, d)]


def route(blocks, genomes, ref, qry, chrom, loc, s: Settings):
    """Label setting with a priority queue: the best (score, intermediates, path, chrom, loc) at the query, or None."""
    heap = [(-1.0, 0, (ref,), chrom, loc)]
    done = set()
    while heap:
        score, n, path, c, at = heapq.heappop(heap)
        if (path[-1], c, at) in done:
            continue
        done.add((path[-1], c, at))
        if path[-1] == qry:
            return -score, n, path, c, at
        for a, b in {(x[0], x[1]) for x in blocks}:
            if a == path[-1] and b not in path:
                for t in hop(blocks.get((a, b, c), []), at, genomes[a], s):
                    heapq.heappush(heap, (score * t[0], n + (b != qry), (*path, b), t[1], t[2]))
    return None


def relax(by, genomes, ref, qry, chrom, loc, s):
    """The best route by rounds of all open labels, a state keeping its best label: (score, intermediates, species, places), or None."""
    key = lambda x: (-x[0], *x[1:])
    labels = {(ref, chrom, loc): (1.0, 0, [ref], [])}
    open_, arrived = dict(labels), []
    for _ in genomes:
        fresh = {}
        for (sp, c, at), (score, n, through, places) in open_.items():
            for to in genomes:
                if to in through or (sp, to, c) not in by:
                    continue
                for x in hop(by[sp, to, c], at, genomes[sp], s):
                    label = (score * x[0], n + (to != qry), [*through, to], [*places, (x[1], x[2])])
                    if to == qry:
                        arrived.append(label)
                    elif (state := (to, x[1], x[2])) not in fresh or key(label) < key(fresh[state]):
                        fresh[state] = label
        open_ = {k: v for k, v in fresh.items() if k not in labels or key(v) < key(labels[k])}
        labels |= open_
    return min(arrived, key=lambda x: (-x[0], x[1], x[2], x[3][-1], x[3]), default=None)
