"""Anchors around a point: the nearest k on each side, and all blocks over it.

Points go to the page of their cell (see ``pages``), where those of a page meet it once: a hop shuffles points and pages, and the
lists of blocks around the points, forty and more times as large, are never shuffled.  In a page all points are searched together.
Blocks over a point alone are found by an equi-join on the one or two cells they touch.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from anchorline.functions.chain import resolve
from anchorline.operators.blocks import CELL, PAIR, cell_of
from anchorline.operators.pages import ANCHOR, DOWN, OVER, UP, Blocks, flat, placed, ranges

#: Points whose anchors are held at once.
TOGETHER = 4096
_SIDE = "struct<kind: string, before: long, found: array<struct<ref_start: long, ref_end: long, qry_chrom: string, qry_start: long, qry_end: long, qry_rev: boolean>>>"
SIDES = f"array<{_SIDE}>"


class Page:
    """The blocks of a page and of those beside it, for points of the page."""

    def __init__(self, rows: pa.Table, k: int):
        self.blocks, self.k = Blocks(flat(rows, "blocks")), k
        b, begin = self.blocks, rows.column("page")[0].as_py() * CELL
        self.anchors = b.anchors()
        self.starts, self.ends = b.ref_start[b.by_start], b.ref_end[b.by_end]
        self.longest = int(b.length.max(initial=1))
        # ranks of the first block here, less those that stand beside it from before
        self.rank_start = sum(rows.column("before_start").to_pylist()) - int((b.ref_start < begin).sum())
        self.rank_end = sum(rows.column("before_end").to_pylist()) - int((b.ref_end < begin).sum())

    def around(self, loc: np.ndarray) -> tuple[dict[str, np.ndarray], dict[str, tuple[np.ndarray, np.ndarray]]]:
        """How many blocks have begun and have ended at each position, in ranks, and of each side the places of its blocks and how many each position has."""
        b = self.blocks
        begun, ended = np.searchsorted(self.starts, loc, side="right"), np.searchsorted(self.ends, loc, side="left")
        down, up = np.minimum(begun + self.k, len(self.starts)), np.maximum(ended - self.k, 0)
        first = np.searchsorted(self.starts, loc - self.longest, side="left")
        over, of = b.by_start[ranges(first, begun)], np.repeat(np.arange(len(loc)), begun - first)
        there = b.ref_end[over] >= loc[of]
        found = {UP: (b.by_end[ranges(up, ended)], ended - up), DOWN: (b.by_start[ranges(begun, down)], down - begun), OVER: (over[there], np.bincount(of[there], minlength=len(loc)))}
        return {UP: self.rank_end + ended, DOWN: self.rank_start + begun, OVER: np.zeros(len(loc), np.int64)}, found


def as_sides(page: Page, loc: np.ndarray) -> pa.Array:
    """Of each position its three sides."""
    before, found = page.around(loc)
    columns = []
    for kind in (UP, DOWN, OVER):
        at, size = found[kind]
        cut = pa.array(np.r_[0, np.cumsum(size)], pa.int32())
        columns.append(pa.StructArray.from_arrays([pa.array([kind] * len(loc), pa.string()), pa.array(before[kind], pa.int64()), pa.ListArray.from_arrays(cut, page.anchors.take(pa.array(at)))], ["kind", "before", "found"]))
    by_point = np.arange(3 * len(loc)).reshape(3, len(loc)).T.ravel()
    return pa.ListArray.from_arrays(pa.array(np.arange(len(loc) + 1) * 3, pa.int32()), pa.concat_arrays(columns).take(pa.array(by_point)))


def as_resolved(least: int, with_chain: bool) -> Callable[[Page, np.ndarray], pa.Array]:
    """Of each position what follows from its anchors: see ``resolve``."""

    def run(page: Page, loc: np.ndarray) -> pa.Array:
        _, found = page.around(loc)
        place = np.concatenate([found[kind][0] for kind in (UP, DOWN, OVER)])
        owner = np.concatenate([np.repeat(np.arange(len(loc)), found[kind][1]) for kind in (UP, DOWN, OVER)])
        side = np.repeat(np.arange(3), [len(found[kind][0]) for kind in (UP, DOWN, OVER)])
        return resolve(page.blocks, page.anchors, place, owner, side == 0, side == 1, loc, least, with_chain)

    return run


def at_pages(points: DataFrame, found: DataFrame, tails: DataFrame, paged: DataFrame, k: int, each: Callable[[Page, np.ndarray], pa.Array], name: str, kind: str) -> DataFrame:
    """points (PAIR, loc, ...) on chromosomes that have blocks, with the column ``name``, which ``each`` makes of a page and distinct positions."""
    shape = StructType([*points.schema.fields, StructField(name, DataType.fromDDL(kind))])
    columns = points.columns

    def run(mine: pa.Table, rows: pa.Table) -> pa.Table:
        mine = mine.combine_chunks()
        loc, which = np.unique(mine.column("loc").to_numpy(), return_inverse=True)
        page = Page(rows.combine_chunks(), k)
        made = [each(page, loc[i : i + TOGETHER]) for i in range(0, max(len(loc), 1), TOGETHER)]
        return mine.select(columns).append_column(name, pa.concat_arrays(made).take(pa.array(which)))

    own = [*PAIR, "page"]
    met = placed(points, cell_of(F.col("loc")), found, tails).select(*columns, F.col("_page.page").alias("page"))
    return met.groupBy(*own).cogroup(paged.groupBy(*own)).applyInArrow(run, shape)


def over(points: DataFrame, blocks: DataFrame) -> DataFrame:
    """points with each block over them, as ``block``."""
    cells = F.explode(F.sequence(cell_of(F.col("ref_start")), cell_of(F.col("ref_end"))))
    placed_ = blocks.select(*PAIR, cells.alias("_cell"), F.struct(*ANCHOR).alias("block"))
    met = points.withColumn("_cell", cell_of(F.col("loc"))).join(placed_, [*PAIR, "_cell"])
    return met.where((F.col("block.ref_start") <= F.col("loc")) & (F.col("loc") <= F.col("block.ref_end"))).drop("_cell")
