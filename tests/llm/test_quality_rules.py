import re
from collections import Counter

import pytest

from anchorline.llm import quality_rules as Q

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    ws = [w for w in SPACE.split(text) if w]
    wins = [tuple(ws[i : i + 8]) for i in range(len(ws) - 7)]
    c = Counter(wins)
    hit = {i + k for i, w in enumerate(wins) if c[w] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if SPACE.sub("", x)]
    n = len(ws)
    counts = (n, sum(map(len, ws)), sum(ch in "#*$%&|<>" for ch in text), len(lines) - len(set(lines)), len(hit))
    return counts, n < 20 or 100 * len(hit) > 30 * n


def test_against_brute_force(messy, messy_rows):
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in Q.quality_rules(messy).select(*Q.COLUMNS).collect())
    want = Counter((r[0], *brute(r[1])[0], brute(r[1])[1]) for r in messy_rows)
    assert got == want


def test_verdicts(spark):
    good = "the cat and a dog " * 3 + " ".join(f"word{i} of" for i in range(40))
    rows = [(1, good), (2, "few words"), (3, " | ".join(f"thing{i} the" for i in range(40))), (4, good.upper()), (5, "\n".join(["same the line"] * 30)), (6, " ".join(w for i in range(9) for w in [f"the{i}"] * 7)), (7, None)]
    kept = {r.doc_id: (r.base_failed, r.kept) for r in Q.quality_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept[1] == (False, True) and kept[2] == (True, False) and kept[3] == (False, False) and kept[4] == (False, False)
    assert not any(kept[i][1] for i in (5, 6, 7))


def test_rules_are_a_table(spark):
    df = spark.createDataFrame([(1, "the " * 5 + " ".join(f"w{i}" for i in range(30)))], "doc_id long, text string")
    assert Q.quality_rules(df, ()).first().kept
    assert not Q.quality_rules(df, (Q.Rule("words", 100, None),)).first().kept


def test_one_projection(messy):
    plan = Q.quality_rules(messy)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Exchange|Join|Python|Arrow", plan)


@pytest.mark.parametrize("column", ["kept", "__x"])
def test_empty_table_and_extra_columns(nothing, column):
    assert Q.quality_rules(nothing.withColumnRenamed("score", column)).count() == 0
