"""Pages of blocks for the search around a point: each holds all blocks that any of its points needs.

Positions are dealt to cells, and cells that have blocks to pages in order: a page begins after PAGE_BLOCKS blocks or with a new span of
cells, and answers for all positions from its first cell up to the next page.  It is known by that cell.  A page holds the blocks that
touch its positions; beside them, in a row of its own, the k blocks that begin next after it and the k that end last before it.  These
come from the pages around it, of which only k blocks of each side are brought together: one row a page.

A finder lists the pages by span, so that a row meets its page by an equi-join; what lies before the first page of a chromosome or
after its last one goes to these.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from anchorline.operators.blocks import CELL, PAIR, cell_of
from anchorline.storage import materialize, small

ANCHOR = ["ref_start", "ref_end", "qry_chrom", "qry_start", "qry_end", "qry_rev"]
#: Sides of a search: nearest blocks that begin after the point, that end before it, and blocks over it.
DOWN, UP, OVER = "d", "u", "o"
#: Blocks and cells of a page, about and at most.
PAGE_BLOCKS, SPAN = 4096, 256
_BLOCK = ["ref_start", "length", "qry_chrom", "qry_start", "qry_rev"]
_BLOCKS = "array<struct<ref_start: long, length: int, qry_chrom: string, qry_start: long, qry_rev: boolean>>"
_OWN = "ref_sp string, qry_sp string, ref_chrom string, page long"
_PAGES = f"{_OWN}, before_start long, before_end long, blocks {_BLOCKS}"


class Blocks:
    """The blocks of an Arrow array of structs as numpy columns; ``by_start`` and ``by_end`` are their places in rank order."""

    def __init__(self, blocks: pa.StructArray):
        get = lambda c: blocks.field(c).to_numpy(zero_copy_only=False)
        self.rows, self.names = blocks, blocks.field("qry_chrom").dictionary_encode()
        self.ref_start, self.length, self.qry_start, self.qry_rev = get("ref_start").astype(np.int64), get("length").astype(np.int64), get("qry_start").astype(np.int64), get("qry_rev").astype(bool)
        self.ref_end = self.ref_start + self.length - 1
        self.qry_end = np.where(self.qry_rev, self.qry_start - self.length + 1, self.qry_start + self.length - 1)
        self.spelled = self.names.dictionary.to_pylist()
        place = np.empty(len(self.spelled), np.int64)
        place[sorted(range(len(self.spelled)), key=lambda i: self.spelled[i])] = np.arange(len(self.spelled))
        self.spelled.sort()
        #: Numbers of the query chromosomes in the order of their names.
        self.chrom = place[self.names.indices.to_numpy(zero_copy_only=False)] if len(blocks) else np.zeros(0, np.int64)
        self.by_start = np.lexsort((self.length, self.qry_rev, self.qry_start, self.chrom, self.ref_start))
        self.by_end = np.lexsort((self.qry_rev, self.chrom, self.qry_start, self.ref_start, self.ref_end))

    def anchors(self) -> pa.StructArray:
        columns = [pa.array(self.ref_start), pa.array(self.ref_end), self.rows.field("qry_chrom"), pa.array(self.qry_start), pa.array(self.qry_end), pa.array(self.qry_rev)]
        return pa.StructArray.from_arrays(columns, ANCHOR)


def flat(table: pa.Table, column: str) -> pa.StructArray:
    """The elements of a column of lists."""
    lists = table.column(column).combine_chunks()
    return (pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists).flatten()


def listed(values: pa.Array, at: np.ndarray, size: np.ndarray) -> pa.ListArray:
    """Lists of the values at places, so many each."""
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)], pa.int32()), values.take(pa.array(at)))


def ranges(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The numbers of all ranges [low, high), one after the other."""
    size = high - low
    return np.arange(int(size.sum())) + np.repeat(low - (np.cumsum(size) - size), size)


def finder(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of each span of a PAIR its pages in order, as ``pages`` (page, last: the last cell that it answers for, null for the last page), and of each PAIR its first and last page."""
    cells = blocks.groupBy(*PAIR, cell_of(F.col("ref_start")).alias("_cell")).agg(F.count("*").alias("_n"))
    cells = cells.withColumn("_before", F.sum("_n").over(Window.partitionBy(*PAIR).orderBy("_cell")) - F.col("_n"))
    each = cells.groupBy(*PAIR, span_of(F.col("_cell")).alias("_span"), F.floor(F.col("_before") / PAGE_BLOCKS).alias("_run")).agg(F.min("_cell").alias("page"))
    last = F.lead("page").over(Window.partitionBy(*PAIR).orderBy("page")) - 1
    each = materialize(each.select(*PAIR, "page", last.alias("last")), "page-cells")
    spans = F.explode(F.sequence(span_of(F.col("page")), span_of(F.coalesce("last", "page"))))
    found = each.select(*PAIR, spans.alias("_span"), F.struct("page", "last").alias("p")).groupBy(*PAIR, "_span").agg(F.sort_array(F.collect_list("p")).alias("pages"))
    tails = each.groupBy(*PAIR).agg(F.min("page").alias("first_page"), F.max("page").alias("last_page"))
    return small(materialize(found, "block-finder", [*PAIR, "_span"])), small(materialize(tails, "block-tails"))


def span_of(cell: Column) -> Column:
    return F.floor(cell / SPAN).cast("long")


def placed(rows: DataFrame, cell: Column, found: DataFrame, tails: DataFrame) -> DataFrame:
    """rows (PAIR, ...) on chromosomes that have blocks, with ``_page`` (page, last), the page of their cell."""
    at = rows.withColumn("_cell", cell).join(tails, PAIR).withColumn("_cell", F.least(F.greatest("_cell", "first_page"), "last_page"))
    at = at.withColumn("_span", span_of(F.col("_cell"))).join(found, [*PAIR, "_span"])
    return at.withColumn("_page", F.element_at(F.filter("pages", lambda p: p["page"] <= F.col("_cell")), -1)).select(*rows.columns, "_page")


def _body(k: int):
    def run(group: pa.Table) -> pa.Table:
        """A page: its blocks, and its first k to begin and its last k to end, with the numbers of all that begin and end in it."""
        group = group.combine_chunks()
        rows = pa.StructArray.from_arrays([pa.concat_arrays(group.column(c).chunks) for c in _BLOCK], _BLOCK)
        b, page, last = Blocks(rows), group.column("page")[0].as_py(), group.column("last")[0].as_py()
        begins = b.by_start[b.ref_start[b.by_start] >= page * CELL]
        ends = b.by_end if last is None else b.by_end[b.ref_end[b.by_end] < (last + 1) * CELL]
        one = lambda at: listed(rows, at, np.array([len(at)]))
        own = [group.column(c).slice(0, 1) for c in (*PAIR, "page")]
        columns = [*own, pa.array([len(begins)], pa.int64()), pa.array([len(ends)], pa.int64()), one(b.by_start), one(begins[:k]), one(ends[-k:])]
        return pa.table(columns, names=[*PAIR, "page", "begins", "ends", "blocks", "firsts", "lasts"])

    return run


def _beside(k: int):
    def run(pages: pa.Table) -> pa.Table:
        """Of the pages of a chromosome, by their first and last blocks: the blocks beside each, and how many begin and end before it."""
        pages = pages.sort_by("page").combine_chunks()
        first, last = flat(pages, "firsts"), flat(pages, "lasts")
        size = lambda c: np.diff(pages.column(c).chunk(0).offsets.to_numpy())
        after, before = np.cumsum(size("firsts")), np.cumsum(size("lasts")) - size("lasts")
        stop, low = np.minimum(after + k, len(first)), np.maximum(before - k, 0)
        own, many = np.stack([after, len(first) + low], 1).ravel(), np.stack([stop, len(first) + before], 1).ravel()
        blocks = listed(pa.concat_arrays([first, last]), ranges(own, many), (stop - after) + (before - low))
        so_far = lambda c: pa.array(np.cumsum(x := pages.column(c).to_numpy()) - x)
        return pa.table([*[pages.column(c) for c in (*PAIR, "page")], so_far("begins"), so_far("ends"), blocks], names=[*PAIR, "page", "before_start", "before_end", "blocks"])

    return run


def pages(blocks: DataFrame, found: DataFrame, tails: DataFrame, k: int) -> DataFrame:
    """Two rows a page: its blocks; and the blocks beside it, with the numbers of those that begin and end before it."""
    own = cell_of(F.col("ref_start"))
    each = blocks.select(*PAIR, *_BLOCK, own.alias("_own"), F.explode(F.sequence(own, cell_of(F.col("ref_end")))).alias("_at"))
    # a block goes to the page that it begins in and to those whose first cell it touches
    dealt = placed(each, F.col("_at"), found, tails).where((F.col("_at") == F.col("_own")) | (F.col("_at") == F.col("_page.page")))
    dealt = dealt.select(*PAIR, F.col("_page.page").alias("page"), F.col("_page.last").alias("last"), *_BLOCK).repartitionByRange(*PAIR, "page")
    body = f"{_OWN}, begins long, ends long, blocks {_BLOCKS}, firsts {_BLOCKS}, lasts {_BLOCKS}"
    body = materialize(dealt.groupBy(*PAIR, "page").applyInArrow(_body(k), body), "block-bodies")
    beside = materialize(body.drop("blocks").groupBy(*PAIR).applyInArrow(_beside(k), _PAGES), "block-sides")
    return body.select(*PAIR, "page", F.lit(0).cast("long").alias("before_start"), F.lit(0).cast("long").alias("before_end"), "blocks").unionByName(beside)
