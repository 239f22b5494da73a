from collections import Counter

from anchorline.llm import sharding as S
from anchorline.llm.common import crc_text


def test_law_and_mixture(messy, messy_rows, monkeypatch):
    monkeypatch.setattr(S, "CELL_ROWS", 7)
    got = S.stratified_shards(messy, 5).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((r[0], len((r[1] or "").encode()) + 8, crc_text(r[1] or "")) for r in messy_rows)
    n = Counter(r.shard for r in got)
    assert set(n) == set(range(5)) and max(n.values()) - min(n.values()) <= 1
    for s in n:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(n[s]))
    per = Counter((r.source, r.shard) for r in got)
    for source, total in Counter(r.source for r in got).items():
        assert all(abs(per[source, s] - total / 5) < 2 for s in range(5))


def test_reruns_agree_and_cells_dont_matter(messy, monkeypatch):
    key = lambda rows: sorted((str(r.doc_id), r.text_crc32, r.shard, r.slot) for r in rows)
    one = key(S.stratified_shards(messy, 7).collect())
    monkeypatch.setattr(S, "CELL_ROWS", 3)
    assert one == key(S.stratified_shards(messy.repartition(3), 7).collect())


def test_brute_force(messy_rows, messy):
    import hashlib

    rows = [(r[3], hashlib.md5(f"{S.SEED}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), -1 if r[0] is None else r[0], len((r[1] or "").encode()) + 8, crc_text(r[1] or "")) for r in messy_rows]
    placed = []
    for source in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == source), key=lambda r: r[1:])
        u = int(hashlib.md5(f"{S.SEED}/{source or ''}".encode()).hexdigest()[:8], 16) / 2**32
        placed += [((i + u) / len(own), (source is None, source or ""), i, r) for i, r in enumerate(own)]
    placed.sort(key=lambda x: x[:3])
    n = len(placed)
    want = sorted((str(r[0]), r[2], r[4], i * 6 // n) for i, (_, _, _, r) in enumerate(placed))
    got = sorted((str(r.source), -1 if r.doc_id is None else r.doc_id, r.text_crc32, r.shard) for r in S.stratified_shards(messy, 6).collect())
    assert got == want


def test_empty_and_few(nothing, spark):
    assert S.stratified_shards(nothing).count() == 0
    few = spark.createDataFrame([(1, "a", "s"), (2, None, None)], "doc_id long, text string, source string")
    assert sorted(r.slot for r in S.stratified_shards(few, 24).collect()) == [0, 0]
