import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from anchorline.llm import prefix_trie


def brute(sequences: dict[int, list[tuple[str, str]]]) -> set[tuple]:
    members: dict[tuple, list[int]] = {}
    for c, turns in sequences.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids = {n: sorted(m for m in members if m[:-1] == n and m) for n in members}

    def total(n: tuple, own) -> int:
        return own(n) + sum(total(k, own) for k in kids[n])

    out = set()
    for n, who in members.items():
        ends = ",".join(str(c) for c in sorted(who) if len(sequences[c]) == len(n))
        saved = total(n, lambda x: (len(members[x]) - 1) * len(x[-1][1]) if x else 0)
        out.add((min(who), len(n), min(members[n[:-1]]) if n else None, len(who), len(kids[n]), total(n, lambda x: int(not kids[x])), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def nodes(df) -> set[tuple]:
    rows = [tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


SCHEMA = "conv_id long, turn long, role string, text string"


def texts_of(rows: list[tuple]) -> dict[int, list[tuple[str, str]]]:
    """Turns by conversation; rows whose turn is repeated are ordered by their digest, as the operator says."""
    out: dict[int, list] = {}
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            out.setdefault(c, []).append(((t is not None, t or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]), (role, text)))
    return {c: [x for _, x in sorted(v)] for c, v in out.items()}


@pytest.mark.parametrize("rows,turns", [(100_000, 400_000), (1, 400_000), (2, 400_000), (100_000, 3)])
def test_nodes_of_random_conversations(spark, rows, turns):
    rng = random.Random(rows + turns)
    data = []
    for c in range(-3, 60):
        for t in range(rng.choice([1, 1, 2, 3, 6])):
            data.append((c * 7, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "é€", "", None])))
    data += [(500 + c, t, "user", "same") for c in range(40) for t in range(2)]
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    assert nodes(prefix_trie.trie_nodes(prefix_trie.sequences(df), rows, turns)) == brute(texts_of(data))


def test_nulls_ties_and_further_columns(spark):
    data = [(None, 0, "user", "x"), (1, None, "user", "first"), (1, 0, "user", "b"), (1, 0, "user", "a"), (2, 0, "user", "a"), (2, 0, "user", "a"), (3, 1, None, None), (4, 1, "", "")]
    df = spark.createDataFrame(data, SCHEMA).withColumn("key", F.lit(1)).withColumn("digests", F.lit("x")).withColumn("sizes", F.lit(2))
    assert nodes(prefix_trie.trie_nodes(prefix_trie.sequences(df))) == brute(texts_of(data))


def test_no_conversation_no_node(spark):
    assert prefix_trie.trie_nodes(prefix_trie.sequences(spark.createDataFrame([], SCHEMA))).count() == 0


def test_shared_heads(spark):
    rng = random.Random(5)
    data = [(c, t, "user", f"{c % 3} {t}") for c in [*range(-120, -95), *range(0, 12), *range(98, 104), 205, 206] for t in range(rng.choice([1, 2, 4, 7]))]
    own = texts_of(data)
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        rebuilt[c] = own.get(base, [])[:h] + turns[h:]
    assert any(not v for v in rebuilt.values())
    df = spark.createDataFrame(data, SCHEMA)
    assert nodes(prefix_trie.trie_nodes(prefix_trie.with_shared_heads(prefix_trie.sequences(df)), 3, 50)) == brute(rebuilt)


def test_one_deep_conversation_and_many_copies(spark):
    deep = [(1, t, "user", f"t{t}") for t in range(3000)]
    data = deep + [(2, t, "user", f"t{t}") for t in range(2990)] + [(10 + c, 0, "user", "t0") for c in range(5000)]
    got = prefix_trie.trie_nodes(prefix_trie.sequences(spark.createDataFrame(data, SCHEMA).repartition(7)), 700, 2_000)
    by = {r["depth"]: r for r in got.collect()}
    assert len(by) == 3001
    ends = hashlib.sha256(",".join(str(10 + c) for c in range(5000)).encode()).hexdigest()
    assert (by[1]["n_convs"], by[1]["ends_sha256"], by[2990]["n_convs"], by[2991]["n_convs"], by[0]["n_leaves"]) == (5002, ends, 2, 1, 1)
    assert by[0]["saved_tokens"] == 5001 * 2 + sum(len(f"t{t}") for t in range(1, 2990))
