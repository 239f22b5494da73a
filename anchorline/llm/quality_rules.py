"""Quality rules: a threshold table compiled into one Spark projection.

``METRICS`` are SQL expressions over a row's words and text, ``RULES`` bounds on
them; ``compile_rules`` turns both into plain columns, so that the whole verdict
is one projection without shuffle, join or user function.

Defined results: a null or blank text has no words and fails the base rule; a very long text is judged
whole, in memory in proportion to itself; an empty table gives an empty result;
repeated rows are judged alike; extra columns are kept unless they bear the
name of a result column, which then replaces them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from anchorline.llm.common import SPACE_CLASS, WORD_CLASS, table, words

#: Frequent function words of the four languages of the corpus.
STOP_WORDS = (
    "the and of to in that is it for on with as was be by are this have from or an at not you "
    "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als "
    "le la les de des du et en un une que qui dans pour par sur au est pas il "
    "el los las y del que en una por con para se su lo como más al es no"
).split()


@dataclass(frozen=True)
class Rule:
    """Keep a row while ``low <= metric <= high``; a null bound is open."""

    metric: str
    low: float | None = None
    high: float | None = None


#: metric -> SQL over the columns n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_stop, n_adjacent, n_upper.
METRICS = {
    "words": "n_words",
    "mean_word_chars": "word_chars / n_words",
    "symbol_ratio": "n_symbols / n_words",
    "stop_ratio": "n_stop / n_words",
    "dup_line_ratio": "n_dup_lines / greatest(n_lines, 1)",
    "adjacent_ratio": "n_adjacent / n_words",
    "upper_ratio": "n_upper / greatest(word_chars, 1)",
}

RULES = (
    Rule("words", 20, None),
    Rule("mean_word_chars", 2.0, 14.0),
    Rule("symbol_ratio", None, 0.2),
    Rule("stop_ratio", 0.02, None),
    Rule("dup_line_ratio", None, 0.5),
    Rule("adjacent_ratio", None, 0.4),
    Rule("upper_ratio", None, 0.5),
)

WINDOW = 8


def repeat_words(tokens: Column, window: int = WINDOW) -> Column:
    """How many words lie in windows of ``window`` words that occur twice or more in the text.

    Windows are compared by a 64-bit hash of their words' hashes.  Only texts
    with an equal pair of windows go on to sort them.  ``F.transform(F.array(x),
    f)[0]`` binds x to a name, so that it is evaluated once.
    """

    def hashed(ws: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(ws) - window), lambda i: F.xxhash64(*[F.get(ws, i + k) for k in range(window)]))

    def covered(hs: Column) -> Column:
        pairs = F.array_sort(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        at = lambda ps, j: F.get(ps, j)["h"]
        twice = F.transform(F.array(pairs), lambda ps: F.array_sort(F.transform(F.filter(ps, lambda p, j: (p["h"] == F.coalesce(at(ps, j + 1), F.bitwise_not(p["h"]))) | (p["h"] == F.coalesce(at(ps, j - 1), F.bitwise_not(p["h"])))), lambda p: p["i"])))
        return F.transform(
            twice,
            lambda ps: F.aggregate(ps, F.struct(F.lit(0).alias("n"), F.lit(-window).alias("last")), lambda acc, p: F.struct((acc["n"] + F.least(F.lit(window), p - acc["last"])).alias("n"), p.alias("last")), lambda acc: acc["n"]),
        )[0]

    many = lambda hs: F.size(F.array_distinct(hs)) < F.size(hs)
    counted = F.transform(F.transform(F.array(F.transform(tokens, lambda w: F.xxhash64(w))), hashed), lambda hs: F.when(many(hs), covered(hs)).otherwise(0))[0]
    return F.when(F.size(tokens) > window, counted).otherwise(0).cast("long")


def base_columns(docs: DataFrame) -> DataFrame:
    """Adds the counted columns to the rows."""
    text = F.coalesce(F.col("text"), F.lit(""))
    chars = lambda cls: F.length(F.regexp_replace(text, cls, ""))
    stops = sorted({v for w in STOP_WORDS for v in (w, w.capitalize())})
    by_word = lambda ws: F.struct(
        F.size(ws).cast("long").alias("n_words"),
        repeat_words(ws).alias("n_repeat_words"),
        F.size(F.filter(ws, lambda w: w.isin(stops))).cast("long").alias("n_stop"),
        F.size(F.filter(ws, lambda w, i: w == F.get(ws, i - 1))).cast("long").alias("n_adjacent"),
    )
    solid = lambda x: F.length(F.regexp_replace(x, SPACE_CLASS, "")) > 0
    by_line = lambda ls: F.struct(F.size(ls).cast("long").alias("n_lines"), (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"))
    counted = docs.withColumn("__rules_w", F.transform(F.array(words(text)), by_word)[0]).withColumn("__rules_l", F.transform(F.array(F.filter(F.split(text, "\n"), solid)), by_line)[0])
    return counted.withColumns(
        {k: F.col(f"__rules_w.{k}") for k in ("n_words", "n_repeat_words", "n_stop", "n_adjacent")}
        | {k: F.col(f"__rules_l.{k}") for k in ("n_lines", "n_dup_lines")}
        | {"word_chars": (F.length(text) - chars(WORD_CLASS)).cast("long"), "n_symbols": chars("[^#*$%&|<>]+").cast("long"), "n_upper": chars("[^A-Z]+").cast("long")}
    ).drop("__rules_w", "__rules_l")


def compile_rules(rules: tuple[Rule, ...] = RULES) -> Column:
    """One boolean column: every rule holds. Only defined for rows with words."""
    verdict = F.lit(True)
    for r in rules:
        m = F.expr(METRICS[r.metric])
        if r.low is not None:
            verdict = verdict & (m >= r.low)
        if r.high is not None:
            verdict = verdict & (m <= r.high)
    return verdict


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` with the counts, ``base_failed`` and ``kept``."""
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return base_columns(docs).withColumn("base_failed", failed).withColumn("kept", F.when(F.col("base_failed"), False).otherwise(compile_rules(rules)))


COLUMNS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules(docs).select(*COLUMNS)

_SPACE_SQL = "[ \\t\\n\\x0b\\x0c\\r]+"
_STOPS_SQL = ", ".join(f"'{v}'" for v in sorted({v for w in STOP_WORDS for v in (w, w.capitalize())}))
ORACLE_SQL = f"""
with w as (
  select doc_id, coalesce(text, '') as text,
         list_filter(string_split_regex(coalesce(text, ''), '{_SPACE_SQL}'), lambda x: x <> '') as ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '{_SPACE_SQL}', '', 'g') <> '') as ls
  from documents),
win as (
  select doc_id, i, list_aggregate(list_slice(ws, i, i + {WINDOW - 1}), 'string_agg', ' ') as win
  from (select doc_id, ws, unnest(generate_series(1, greatest(len(ws) - {WINDOW - 1}, 0))) as i from w)),
twice as (select doc_id, i from win qualify count(*) over (partition by doc_id, win) > 1),
rep as (select doc_id, count(distinct p) as n from (select doc_id, unnest(generate_series(i, i + {WINDOW - 1})) as p from twice) group by doc_id),
m as (
  select doc_id, cast(len(ws) as bigint) as n_words,
         cast(length(regexp_replace(text, '{_SPACE_SQL}', '', 'g')) as bigint) as word_chars,
         cast(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) as bigint) as n_symbols,
         cast(len(ls) - len(list_distinct(ls)) as bigint) as n_dup_lines,
         cast(coalesce(rep.n, 0) as bigint) as n_repeat_words, len(ls) as n_lines,
         len(list_filter(ws, lambda x: x in ({_STOPS_SQL}))) as n_stop,
         len(list_filter(ws, lambda x, i: i > 1 and x = ws[i - 1])) as n_adjacent,
         length(regexp_replace(text, '[^A-Z]+', '', 'g')) as n_upper
  from w left join rep using (doc_id)),
b as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       case when base_failed then false else
         word_chars / n_words between 2.0 and 14.0 and n_symbols / n_words <= 0.2 and n_stop / n_words >= 0.02
         and n_dup_lines / greatest(n_lines, 1) <= 0.5 and n_adjacent / n_words <= 0.4 and n_upper / greatest(word_chars, 1) <= 0.5 end as kept
from b
"""
