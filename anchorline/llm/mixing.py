"""Mixing sources to target weights by pivotal dependent rounding.

Each row of a source should be repeated target / source_size times on average.
The whole part is certain; the fractional part is a copy probability, rounded
by the pivotal method: two rows with fractional probabilities pass mass
(probability times size) from one to the other, in a random direction whose
chances keep both expectations, until one of them is 0 or 1.  The other goes on
to the next partner.  So the words taken from a source differ from its target
by less than the size of one row.

Rows meet in a reduction tree: a seeded hash deals them to small cells per
source, an ordered fold settles all of a cell's rows but one, and the residual
rows of FAN_IN neighbouring cells meet at the next level, until each source has
one residual.  A source that holds most rows has as many cells as it needs;
each level shuffles only what the one below left over.  Everything is DataFrame
expressions; only the per-source totals are broadcast, behind a count.

Defined results: null and blank texts have size 0, count as taken 0 and never
disturb the others; a null source is a source of its own, last in order; m rows
that agree in doc_id, source and text are one unit, of which the whole part of
m times the fractional probability is certain too, one copy each for so many of its rows, and
only what is left of a single copy enters the tree, so that the target is missed by one row
at most; a very long text is one row of its size, read in its own task; an empty table gives an empty result; other columns aren't touched.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from anchorline.llm.common import SPACE_CLASS, materialize, table
from anchorline.storage import small

FAN_IN = 128
#: Per-source totals of at most so many sources are broadcast; more are joined by a shuffle.
BROADCAST_SOURCES = 100_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.size(F.filter(F.split(text, SPACE_CLASS), lambda w: w != "")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), cap: float = 3.0) -> DataFrame:
    """One row a source: source, source_size, target.

    Sources in code point order, null last, take the weights in turn and share
    the total size; no target exceeds ``cap`` times its source, and the excess is
    shared again by weight.  The window runs over one row a source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    every = Window.partitionBy()
    k = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (k % len(weights) + 1).cast("int")))
    per = per.withColumn("most", F.col("source_size") * cap).withColumn("total", F.sum("source_size").over(every))
    before = Window.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0.0)
    rest = F.col("total") - F.coalesce(F.sum("most").over(before), none)
    per = per.withColumn("capped", F.col("most") < rest / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), none)) * F.col("w"))
    left = F.col("total") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("most"))).over(every), none)
    open_w = F.sum(F.when(~F.col("capped"), F.col("w"))).over(every)
    return per.select("source", "source_size", F.when(F.col("capped"), F.col("most")).otherwise(left / open_w * F.col("w")).alias("target"))


def _uniform(*parts: Column) -> Column:
    """A reproducible number in [0, 1)."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / F.lit(float(1 << 53))


def _fold(level: int) -> Column:
    """Settles the rows of a cell, in hash order: struct(out: settled rows with ``up``, rest: the one left)."""
    item = "struct<k:bigint,doc_id:bigint,size:bigint,m:bigint,th:bigint,w:double,p:double>"
    out = "array<struct<k:bigint,doc_id:bigint,size:bigint,m:bigint,th:bigint,up:int>>"

    def settled(x: Column, up: int) -> Column:
        return F.array(F.struct(x["k"].alias("k"), x["doc_id"].alias("doc_id"), x["size"].alias("size"), x["m"].alias("m"), x["th"].alias("th"), F.lit(up).alias("up")))

    def with_p(x: Column, p: Column) -> Column:
        return F.struct(*[x[c].alias(c) for c in ("k", "doc_id", "size", "m", "th", "w")], F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)).alias("p"))

    def step(acc: Column, x: Column) -> Column:
        i = acc["rest"]
        gain_i, lose_i, gain_x, lose_x = (1 - i["p"]) * i["w"], i["p"] * i["w"], (1 - x["p"]) * x["w"], x["p"] * x["w"]
        to_i, to_x = F.least(gain_i, lose_x), F.least(lose_i, gain_x)
        # mass goes to i with chance to_x / (to_i + to_x): both expectations stay
        towards_i = _uniform(i["k"], x["k"], F.lit(level)) * (to_i + to_x) < to_x
        put = lambda done, up, rest: F.struct(F.concat(acc["out"], settled(done, up)).alias("out"), rest.alias("rest"))
        moved = (
            F.when(towards_i & (gain_i <= lose_x), put(i, 1, with_p(x, x["p"] - to_i / x["w"])))
            .when(towards_i, put(x, 0, with_p(i, i["p"] + to_i / i["w"])))
            .when(lose_i <= gain_x, put(i, 0, with_p(x, x["p"] + to_x / x["w"])))
            .otherwise(put(x, 1, with_p(i, i["p"] - to_x / i["w"])))
        )
        return F.when(i.isNull(), F.struct(acc["out"].alias("out"), x.alias("rest"))).otherwise(moved)

    start = F.struct(F.expr(f"cast(array() as {out})").alias("out"), F.expr(f"cast(null as {item})").alias("rest"))
    return F.aggregate(F.array_sort("items"), start, step)


def pivotal_round(units: DataFrame, n_rows: int) -> DataFrame:
    """units: source, k, doc_id, size, m, th, w > 0, p in [0, 1]. Returns source, doc_id, size, m, th, up (0 or 1)."""
    cells = max(1, -(-n_rows // FAN_IN))
    now = units.select("source", F.pmod(F.xxhash64("k", F.lit(17)), F.lit(cells)).alias("cell"), F.struct("k", "doc_id", "size", "m", "th", "w", "p").alias("item"))
    done = []
    level = 0
    while True:
        folded = materialize(now.groupBy("source", "cell").agg(F.collect_list("item").alias("items")).select("source", "cell", _fold(level).alias("f")).select("source", "cell", "f.out", "f.rest"), f"mix-level{level}")
        done.append(folded.select("source", F.explode("out").alias("x")).select("source", "x.doc_id", "x.size", "x.m", "x.th", "x.up"))
        if cells == 1:
            break
        cells = -(-cells // FAN_IN)
        level += 1
        now = folded.where(F.col("rest").isNotNull()).select("source", F.expr(f"cell div {FAN_IN}").alias("cell"), F.col("rest").alias("item"))
    last = folded.where(F.col("rest").isNotNull()).select("source", "rest.doc_id", "rest.size", "rest.m", "rest.th", (_uniform(F.col("rest.k"), F.lit(-1)) < F.col("rest.p")).cast("int").alias("up"))
    for d in done:
        last = last.unionByName(d)
    return last


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), cap: float = 3.0, seed: int = 11) -> DataFrame:
    """One row a unit: doc_id, source, th (hash of the text), m (rows of the unit), size, source_size, target, copies (of each row), extra (how many of the m rows have one more)."""
    rows = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("th"))
    units = materialize(rows.groupBy("doc_id", "source", "size", "th").agg(F.count("*").alias("m")), "mix-units")
    totals = materialize(source_targets(units.select("source", (F.col("size") * F.col("m")).alias("size")), weights, cap), "mix-totals")
    few = totals.count() <= BROADCAST_SOURCES
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    t = totals.withColumnRenamed("source", "source_").withColumn("whole", F.floor(ratio)).withColumn("part", ratio - F.col("whole"))
    if few:
        t = F.broadcast(t)
    mass, certain = F.col("m") * F.col("part"), F.floor(F.col("m") * F.col("part"))
    units = units.join(t, F.col("source").eqNullSafe(F.col("source_"))).drop("source_").withColumn("p", mass - certain).withColumn("k", F.xxhash64(F.lit(seed), "doc_id", "th", "source"))
    sized = units.where("size > 0").withColumn("w", F.col("size").cast("double"))
    up = pivotal_round(sized, sized.select("k").count())
    cols = ["doc_id", "source", "th", "m", "size", "source_size", "target", F.col("whole").cast("int").alias("copies"), "extra"]
    done = up.join(t, up["source"].eqNullSafe(F.col("source_"))).drop("source_").withColumn("extra", (certain + F.col("up")).cast("long"))
    blank = units.where("size = 0").withColumn("extra", F.when(_uniform(F.col("k"), F.lit(-2)) < F.col("part"), F.col("m")).otherwise(0).cast("long"))
    return done.select(*cols).unionByName(blank.select(*cols))


def mixed_rows(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, with the columns they had.

    Where only some of a unit's m rows have one copy more, its rows are numbered by a hash of the whole row, and those with a number
    up to ``extra`` have it; such units are broadcast behind a count, so that texts are shuffled once.  Rows that are equal in all columns are counted, not numbered; others get their number from cells of the hash, so
    that no unit is sorted in one task.  Further columns may have any name; columns are packed in a struct meanwhile.
    """
    names = ("doc_id", "source", "th", "copies", "extra", "m")
    plan = materialize(mix(docs, **how).where("copies > 0 or extra > 0").select(*[F.col(c).alias(f"u_{c}") for c in names]), "mix-plan")
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "source", F.xxhash64("text").alias("t"))

    def met(part: DataFrame) -> DataFrame:
        return keyed.join(part, keyed["doc_id"].eqNullSafe(part["u_doc_id"]) & keyed["source"].eqNullSafe(part["u_source"]) & (keyed["t"] == part["u_th"]))

    times = F.col("u_copies") + (F.col("u_extra") == F.col("u_m")).cast("int")
    each = met(plan).select("row", times.alias("n")).where("n > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n"))))
    unit = ["u_doc_id", "u_source", "u_th"]
    written = F.to_json("row")
    rows = met(small(materialize(plan.where("u_extra > 0 and u_extra < u_m"), "mix-some"))).select("row", *unit, "u_extra", F.xxhash64(written).alias("h"), F.xxhash64(F.lit(1), written).alias("g"))
    kinds = rows.groupBy(*unit, "h", "g").agg(F.count(F.lit(1)).alias("c"), F.first("row").alias("row"), F.first("u_extra").alias("extra")).withColumn("cell", F.shiftrightunsigned("h", 54))
    kinds = materialize(kinds, "mix-kinds")
    cells = kinds.groupBy(*unit, "cell").agg(F.sum("c").alias("before"))
    cells = cells.withColumn("before", F.sum("before").over(Window.partitionBy(*unit).orderBy("cell")) - F.col("before")).select(*[F.col(u).alias(f"c_{u}") for u in unit], F.col("cell").alias("c_cell"), "before")
    within = F.coalesce(F.sum("c").over(Window.partitionBy(*unit, "cell").orderBy("h", "g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = kinds.withColumn("within", within)
    numbered = numbered.join(cells, (numbered["cell"] == cells["c_cell"]) & (numbered["u_th"] == cells["c_u_th"]) & numbered["u_doc_id"].eqNullSafe(cells["c_u_doc_id"]) & numbered["u_source"].eqNullSafe(cells["c_u_source"]))
    share = F.greatest(F.lit(0), F.least(F.col("c"), F.col("extra") - F.col("before") - F.col("within")))
    # a row that many copies go to is dealt out before it is repeated
    more = numbered.select("row", share.alias("n")).where("n > 0").withColumn("first", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"), F.lit(1000).cast("long")))).repartition("first", "row")
    more = more.withColumn("copy", F.explode(F.sequence(F.col("first"), F.least(F.col("first") + 999, F.col("n")))))
    return each.select("row").unionByName(more.select("row")).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"))
    each = mixed.withColumn("row", F.explode(F.sequence(F.lit(1), F.col("m").cast("int")))).withColumn("copies", F.col("copies") + (F.col("row") <= F.col("extra")).cast("int"))
    return each.select("doc_id", "size", "source_size", F.col("target").cast("double"), (F.col("copies") * F.col("size")).cast("long").alias("taken"), "source", "copies")
