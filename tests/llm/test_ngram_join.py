import random
import re

import numpy as np
import pytest

from anchorline.llm import ngram_join as J
from anchorline.llm.components import connected
from tests.llm.conftest import prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, n):
    ws = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)} if len(ws) >= n else {tuple(ws)} if ws else set()


def brute(rows, n, percent):
    sets = [shingles(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((str(d), len(sets[i]), str(min(ids) if ids else None)))
    return sorted(out)


def groups(seed, docs=160):
    """Groups of copies with more and more edits, chains among them, sharing a passage."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    common = [word() for _ in range(40)]
    rows, i = [], 0
    while i < docs:
        base = [word() for _ in range(rnd.choice([3, 8, 20, 60, 150, 400]))]
        if rnd.random() < 0.5:
            base += common
        for _ in range(rnd.randrange(1, 9)):
            rows.append((i, " ".join(base)))
            i += 1
            for _ in range(rnd.randrange(0, max(2, len(base) // 40))):
                base[rnd.randrange(len(base))] = word()
            if rnd.random() < 0.3:
                base.append(word())
    return rows


@pytest.mark.parametrize(("seed", "n", "percent"), [(1, 3, 90), (2, 5, 80), (3, 3, 70)])
def test_components(spark, seed, n, percent):
    rows = groups(seed)
    got = J.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), n, percent).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute(rows, n, percent)


def test_split_components(spark, monkeypatch):
    """Components far above a block: the same result."""
    monkeypatch.setattr(J, "BLOCK", 900)
    monkeypatch.setattr(J, "BROADCAST_SETS", 10)
    rows = groups(4, 120)
    got = J.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute(rows, 3, 85)


def test_messy(messy, messy_rows):
    rows = [(r[0], r[1]) for r in messy_rows]
    got = J.jaccard_components(messy).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute(rows, 3, 90)


def test_divide_skip_finds_every_link():
    rng = np.random.default_rng(5)
    for percent in (60, 80, 95):
        sets = []
        for _ in range(12):
            base = rng.integers(0, 4000, rng.integers(5, 200)).astype(np.uint64)
            sets += [np.unique(np.where(rng.random(len(base)) < 0.06, rng.integers(0, 4000, len(base)).astype(np.uint64), base)) for _ in range(9)]
        sets.sort(key=len)
        want = {(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= percent * len(np.union1d(sets[i], sets[j]))}
        for mu in (0.0, 0.01, 1.0, 100.0):
            old, J.MU = J.MU, mu
            assert {(i, int(j)) for i, js in J.divide_skip(sets, percent) for j in js} == want
            J.MU = old
        links = J.Links(len(sets))
        assert {(i, int(j)) for i, js in J.divide_skip(sets, percent, links=links) for j in js} <= want
        whole = list(range(len(sets)))
        for _ in whole:
            for i, j in want:
                whole[i] = whole[j] = min(whole[i], whole[j])
        assert links.of.tolist() == whole
        ask = rng.random(len(sets)) < 0.3
        assert {(i, int(j)) for i, js in J.divide_skip(sets, percent, ask) for j in js} == {(i, j) for i, j in want if ask[i] or ask[j]}


def test_many_rows_without_id_dont_multiply(spark):
    base = [f"w{i}" for i in range(60)]
    rows = [(None if i % 2 else 5, " ".join([*base[:30], f"x{i % 20}", *base[31:]])) for i in range(80)] + [(9, None)] * 3
    got = J.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 1, 80).collect()
    assert len(got) == 83 and all(r.component_id == (5 if r.n_shingles else 9) for r in got)


def test_linked_sets_share_a_signature():
    rng = np.random.default_rng(6)
    for percent in (80, 90):
        for _ in range(300):
            n = int(rng.integers(1, 300))
            a = np.unique(rng.integers(0, 2**62, n).astype(np.uint64))
            gone = int(rng.integers(0, len(a) // 8 + 1))
            b = np.unique(np.r_[a[gone:], rng.integers(0, 2**62, int(rng.integers(0, n // 8 + 1))).astype(np.uint64)])
            o = len(np.intersect1d(a, b))
            if 100 * o >= percent * (len(a) + len(b) - o) and len(b):
                either = np.union1d(a, b)
                for share in (0, 0.3, 0.8, 1):
                    common = either[rng.random(len(either)) < share]
                    assert len(np.intersect1d(J.signatures(a, percent, common), J.signatures(b, percent, common)))


def test_one_row_of_each_group_stays(messy):
    kept = J.without_near_copies(messy)
    assert kept.columns == messy.columns
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(ids)) and {0, 3, 4, 5} <= set(ids) and not {1, 2} & set(ids)


def test_rows_without_id_and_repeated_ids_keep_their_texts(spark):
    """Different texts stay whether ids are null or repeated; of copies the one with an id stays."""
    rnd = random.Random(8)
    a, b, c, d, e = (prose(rnd, 60) for _ in range(5))
    rows = [(None, a), (None, b), (7, c), (7, d), (None, c), (3, e), (None, e), (7, e), (None, None), (None, ""), (7, c), (None, b)]
    got = J.without_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(None, a), (None, b), (7, c), (7, d), (3, e), (None, None), (None, "")]))


def test_empty(nothing):
    assert J.jaccard_components(nothing).count() == 0


def test_connected(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 102), (7, 7), (200, 201), (201, 200)]
    got = {r.node: r.root for r in connected(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 102: 100, 200: 200, 201: 200}


def test_columns_with_clashing_names(spark):
    """Columns named like those of the search, and a map, keep their values; equal rows are one."""
    rows = [(i % 40, f"some words of text number {i % 40} and more of them to tell {i % 40}", i % 40, "x", {"k": i % 40}) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __join_id int, first string, row map<string, int>")
    got = J.without_near_copies(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id, r["__join_id"], r["first"], r["row"]["k"]) for r in got.collect()) == [(i, i, "x", i) for i in range(40)]
