import random
from collections import defaultdict

from anchorline.llm import mixing as M


def brute_targets(sizes, weights=(5, 2, 1), cap=3.0):
    """sizes: source -> size. Shares by weight; what exceeds the cap is shared again until nothing does."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(cap * sizes[s] for s in capped)
        open_ = [s for s in order if s not in capped]
        rate = left / sum(w[s] for s in open_) if open_ else 0
        over = {s for s in open_ if rate * w[s] > cap * sizes[s]}
        if not over:
            return {s: cap * sizes[s] if s in capped else rate * w[s] for s in order}
        capped |= over


def test_targets_and_rounding(messy, messy_rows):
    got = M.mix(messy).collect()
    sizes, taken, most = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in messy_rows:
        sizes[r[3]] += len((r[1] or "").split())
        most[r[3]] = max(most[r[3]], len((r[1] or "").split()))
    assert sum(r.m for r in got) == len(messy_rows)
    want = brute_targets(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
        ratio = want[r.source] / sizes[r.source] if sizes[r.source] else 0
        assert int(ratio) == r.copies and 0 <= r.extra <= r.m and (r.copies + (r.extra > 0)) <= 3
        taken[r.source] += (r.copies * r.m + r.extra) * r.size
    for s in sizes:
        assert abs(taken[s] - want[s]) <= most[s]
    key = lambda rows: sorted(map(str, rows))
    assert key(got) == key(M.mix(messy).collect())


def test_expectations_hold(spark):
    rows = [(i, " ".join(["w"] * (1 + i % 7)), "ab"[i % 3 == 0]) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    share = defaultdict(list)
    for seed in range(6):
        for r in M.mix(df, weights=(2, 1), seed=seed).collect():
            share[r.source].append(r.copies + r.extra / r.m - r.target / r.source_size)
    assert all(abs(sum(v) / len(v)) < 0.05 for v in share.values())


def test_tree_has_levels(spark, monkeypatch):
    monkeypatch.setattr(M, "FAN_IN", 4)
    rnd = random.Random(2)
    df = spark.createDataFrame([(i, " ".join(["w"] * rnd.randrange(1, 30)), "a" if i % 3 else "b") for i in range(200)], "doc_id long, text string, source string")
    got = M.mix(df).collect()
    for s in "ab":
        own = [r for r in got if r.source == s]
        assert abs(sum((r.copies * r.m + r.extra) * r.size for r in own) - own[0].target) <= max(r.size for r in own)


def test_rows_of_the_mix(messy):
    rows = M.mixed_rows(messy)
    assert rows.columns == messy.columns
    want = sum(r.copies * r.m + r.extra for r in M.mix(messy).collect())
    assert rows.count() == want


def test_equal_rows_are_rounded_by_row(spark):
    rows = [(1, "ten words " * 5, "a")] * 1000 + [(i, "w " * (1 + i % 9), "b") for i in range(2, 400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = M.mix(df, weights=(1, 3)).collect()
    unit = next(r for r in got if r.source == "a")
    assert unit.m == 1000 and abs((unit.copies * 1000 + unit.extra) * 10 - unit.target) <= 10
    mixed = M.mixed_rows(df, weights=(1, 3)).groupBy("source").count().collect()
    assert {r.source: r["count"] for r in mixed} == {s: sum(r.copies * r.m + r.extra for r in got if r.source == s) for s in "ab"}


def test_equal_keys_with_unlike_columns_share_the_extra_copies(spark):
    keys = [(1, "ten words " * 5, "a", f"row {i}") for i in range(10)] + [(7, "same words " * 5, "a", "same")] * 10
    df = spark.createDataFrame(keys + [(100 + i, "w " * 50, "b", "") for i in range(8)], "doc_id long, text string, source string, note string")
    found = [sorted((r.doc_id, r.note, r["count"]) for r in M.mixed_rows(df.repartition(n), weights=(3, 1)).where("source = 'a'").groupBy("doc_id", "note").count().collect()) for n in (1, 4)]
    assert found[0] == found[1]
    unit = {r.doc_id: r for r in M.mix(df, weights=(3, 1)).collect() if r.source == "a"}
    assert all(0 < r.extra < 10 for r in unit.values())
    unlike = [n for d, _, n in found[0] if d == 1]
    assert set(unlike) == {unit[1].copies, unit[1].copies + 1} and sum(unlike) == 10 * unit[1].copies + unit[1].extra
    assert [n for d, _, n in found[0] if d == 7] == [10 * unit[7].copies + unit[7].extra]


def test_columns_with_clashing_names(spark):
    df = spark.createDataFrame([(i, "a b c " * (1 + i % 3), "s", "x", 5, i) for i in range(30)], "doc_id long, text string, source string, __mix_doc_id string, row int, t int")
    got = M.mixed_rows(df)
    assert got.columns == df.columns and set(map(tuple, got.collect())) <= set(map(tuple, df.collect()))


def test_empty(nothing):
    assert M.mix(nothing).count() == 0 and M.mixed_rows(nothing).count() == 0
