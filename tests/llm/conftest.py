import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, score string"


def prose(rnd: random.Random, n: int) -> str:
    return " ".join(rnd.choice(["the", "of", "and"]) if rnd.random() < 0.4 else "".join(rnd.choice(["an", "er", "in", "th", "ea"]) for _ in range(rnd.randrange(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def messy_rows():
    """Nulls in every column, empty, blank and very long texts, repeated rows, near copies."""
    rnd = random.Random(1)
    base = prose(rnd, 120)
    near = base.split()
    near[60] = "changed"
    texts = [base, base, " ".join(near), None, "", " \t\n ", "one", "two words", "Two Words", "a b c", prose(rnd, 9000), "x" * 5000, "### $$$ &&& | <a>\n" * 30, "line one\nline one\nline two\n\n", base + " " + base, "é漢字 ÀÉ ß", "the the the the " * 20]
    rows = [(i, t, "en", f"s{i % 4}" if i % 5 else None, 1, "clash", "clash") for i, t in enumerate(texts)]
    rows += [rows[0], rows[0], (None, base, None, None, None, None, None), (None, None, None, None, None, None, None)]
    rows += [(100 + i, prose(rnd, rnd.randrange(1, 80)), "de", f"s{i % 6}", 2, None, None) for i in range(60)]
    return rows


@pytest.fixture(scope="session")
def messy(spark, messy_rows):
    return spark.createDataFrame(messy_rows, SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
