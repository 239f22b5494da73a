import math
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from anchorline.llm import brown_lm as B
from anchorline.llm import common as C
from anchorline.llm.common import crc_mod, word_hashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows, held):
    c, docs = Counter(), 0
    for d, t in rows:
        if not held(d):
            c.update(tokens(t))
            docs += 1
    n, v = sum(c.values()) + docs, len(c) + (docs > 0)
    out = []
    for d, t in rows:
        ws = tokens(t)
        s = sum(math.log10((x + 0.1) / (n + 0.1 * (v + 1))) for x in [*(c[w] for w in ws), docs])
        out.append((str(d), held(d), len(ws) + 1, sum(c[w] > 0 for w in ws) + (docs > 0), n, round(s, 6)))
    return sorted(out)


@pytest.mark.parametrize("hot", [1 << 17, 5])
def test_base_against_brute_force(messy, messy_rows, monkeypatch, hot):
    monkeypatch.setattr(B, "HOT", hot)
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0
    got = B.lm_scores(messy, crc_mod(F.col("doc_id"), 10) == 0).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == brute([(r[0], r[1]) for r in messy_rows], held)
    assert all(r.score < 0 and r.perplexity > 1 for r in got)


def test_hot_table_doesnt_change_scores(messy, monkeypatch):
    """Which words are broadcast is a matter of cost only."""
    held = crc_mod(F.col("doc_id"), 10) == 0
    key = lambda: sorted((str(r.doc_id), r.n_tokens, round(r.score, 6)) for r in B.lm_scores(messy, held).collect())
    one = key()
    monkeypatch.setattr(B, "HOT", B.FREQUENT)
    assert key() == one


def test_probabilities_sum_to_one(messy):
    """Over all words and one unseen word of each class, and over all next classes."""
    m = B.train(messy.select("text"))
    assert np.allclose((10 ** m["step"]).sum(1), 1)
    words = {w for r in messy.select("text").collect() for w in tokens(r.text)}
    assert m["vocabulary"] == len(words) + 1
    counts = {r.h: r.c for r in m["counts"].collect()}
    assert len(counts) == len(words)
    hot, of = m["hot"], m["of"]
    mass = np.zeros(B.CLASSES)
    kind = {int(h): k for h, k in zip(hot.h.view(np.int64), hot.kind)}
    for r in m["counts"].collect():
        k = kind.get(r.h, -1)
        c = of[k if k >= 0 else B.FREQUENT + r.g]
        mass[c] += (r.c + B.DELTA) / 10 ** m["share"][c]
    for c in {int(x) for x in of[B.FREQUENT : B.END]}:
        mass[c] += B.DELTA / 10 ** m["share"][c]
    used = [c for c in range(B.CLASSES) if mass[c] > 0]
    assert np.allclose(mass[used], 1)


def test_exchange_raises_information():
    rng = np.random.default_rng(1)
    true = rng.integers(0, 3, 60)
    n = np.zeros((61, 61))
    seq = []
    c = 0
    for _ in range(20000):
        c = (c + 1) % 3 if rng.random() < 0.9 else int(rng.integers(3))
        seq.append(int(rng.choice(np.flatnonzero(true == c))))
    np.add.at(n, (seq[:-1], seq[1:]), 1)

    def info(of):
        one = np.zeros((61, 4))
        one[np.arange(61), of] = 1
        p = one.T @ n @ one / n.sum()
        a, b = p.sum(1, keepdims=True), p.sum(0, keepdims=True)
        return float(np.sum(np.where(p > 0, p * np.log(np.maximum(p, 1e-300) / np.maximum(a * b, 1e-300)), 0)))

    found = B.exchange_classes(n, 4)
    assert info(found) > 0.95 * info(np.r_[true, 3])


def test_rare_words_go_by_their_neighbours(spark):
    """Words outside the frequent ones that end alike but have unlike neighbours have classes of their own."""
    rng = np.random.default_rng(3)
    rows = []
    pick = lambda side: f"{side}{rng.integers(170)}{side}"
    for k in range(1200):
        common = [f"{pick(a)} f{rng.integers(50)}{side} {pick(b)}" for _ in range(8) for a, b, side in (("p", "q", "left_aa"), ("s", "t", "right_bb"))]
        rows.append((" ".join([*common, f"{pick('p')} r{k % 300}left_zz {pick('q')} {pick('s')} r{k % 300}right_zz {pick('t')}"]),))
    m = B.train(spark.createDataFrame(rows, "text string"))
    g = {r.h: r.g for r in m["counts"].collect()}
    kind = {int(h): k for h, k in zip(m["hot"].h.view(np.int64), m["hot"].kind)}
    found = {}
    for side in ("left", "right"):
        text = np.frombuffer(" ".join(f"r{k}{side}_zz" for k in range(300)).encode(), np.uint8)
        hashes = B.word_hashes(text, np.array([0, len(text)]), lower=True)[0].view(np.int64)
        found[side] = Counter(int(m["of"][kind[h] if kind.get(h, -1) >= 0 else B.FREQUENT + g[h]]) for h in hashes.tolist())
    assert sum((found["left"] & found["right"]).values()) < 0.05 * 300, found


def test_words_seen_once_keep_their_endings_class(spark, monkeypatch):
    """In every sweep, also where no word but the frequent ones stands in a neighbour's place with a class of its own."""
    rng = np.random.default_rng(5)
    rows = [(" ".join([*(f"f{rng.integers(40)}" for _ in range(20)), f"once{k}{'abcde'[k % 5]}", *(f"f{rng.integers(40)}" for _ in range(5)), f"more{k % 50}x"]),) for k in range(2500)]
    for context in (B.CONTEXT, B.FREQUENT):
        monkeypatch.setattr(B, "CONTEXT", context)
        m = B.train(spark.createDataFrame(rows, "text string"))
        frequent = set(m["hot"].h.view(np.int64)[m["hot"].kind < B.FREQUENT].tolist())
        once = [r for r in m["counts"].collect() if r.c == 1 and r.h not in frequent]
        assert len(once) > 500
        text = np.frombuffer(" ".join(f"once{k}{'abcde'[k % 5]}" for k in range(2500)).encode(), np.uint8)
        h, _per, start, length = word_hashes(text, np.array([0, len(text)]), lower=True)
        ending = dict(zip(h.view(np.int64).tolist(), B._suffix(text, start, length).tolist()))
        assert all(r.g - (B.TYPES - B.FREQUENT) == m["of"][B.FREQUENT + ending[r.h]] for r in once)


def test_gain_is_the_exchanges(spark):
    """One word's class by sparse neighbours is the class that raises the information of all class bigrams most."""
    rng = np.random.default_rng(4)
    size, k = 200, B.CLASSES
    n = rng.poisson(0.4, (size, size)).astype(float)
    of = np.r_[rng.integers(0, k - 1, size - 1), k - 1]

    def info(now):
        one = np.zeros((size, k))
        one[np.arange(size), now] = 1
        p = one.T @ n @ one
        x = lambda v: v * np.log(np.maximum(v, 1e-300))
        return x(p).sum() - x(p.sum(0)).sum() - x(p.sum(1)).sum()

    one = np.zeros((size, k))
    one[np.arange(size), of] = 1
    for w in range(0, 40):
        others = one.copy()
        others[w] = 0
        near = np.r_[n[w] @ others, n[:, w] @ others, n[w, w]]
        code = np.flatnonzero(near)
        got = B.best_classes(one.T @ n @ one, np.zeros(len(code), np.int64), code, near[code], of[w : w + 1])[0]
        tried = [info(np.r_[of[:w], c, of[w + 1 :]]) for c in range(k - 1)]
        assert got == int(np.argmax(tried))


def test_better_than_unigrams(spark):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(f"{'xyz'[(k + i) % 3]}{rng.integers(40)}" for k in range(60))) for i in range(200)]
    got = B.lm_scores(spark.createDataFrame(rows, "doc_id long, text string"), crc_mod(F.col("doc_id"), 10) == 0).where("held_out").collect()
    assert sum(r.score for r in got) > 0.85 * sum(r.base_score for r in got) and all(r.score > r.base_score for r in got)


def test_empty(nothing):
    assert B.lm_scores(nothing, F.lit(False)).count() == 0


def test_scores_against_brute_force(spark, messy_rows):
    """Transitions counted and smoothed, emissions and sums by plain Python, from the words' classes alone."""
    rows = [(i, r[1]) for i, r in enumerate(messy_rows)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    m = B.train(docs)
    class_of = {r.h: r.g - (B.TYPES - B.FREQUENT) for r in m["counts"].collect()}
    count = Counter(w for _, t in rows for w in tokens(t))
    hashed = {}
    for w in count:
        data = np.frombuffer(w.encode(), np.uint8)
        hashed[w] = int(word_hashes(data, np.array([0, len(data)]), lower=True)[0].view(np.int64)[0])
    assert set(hashed.values()) == set(class_of) and len(set(class_of.values())) > 3
    end = int(m["of"][B.END])
    texts = {d: [class_of[hashed[w]] for w in tokens(t)] + [end] for d, t in rows}
    assert all(end not in c[:-1] for c in texts.values())
    big = np.zeros((B.CLASSES, B.CLASSES))
    for c in texts.values():
        for a, b in zip([end, *c], c):
            big[a, b] += 1
    prior = (big.sum(0) + 1) / (big.sum() + B.CLASSES)
    in_class, distinct = Counter(), Counter()
    for w, n in count.items():
        in_class[class_of[hashed[w]]] += n
        distinct[class_of[hashed[w]]] += 1
    # classes that have endings have a place for a word that training never saw
    unseen = {int(c) for c in m["of"][B.FREQUENT : B.END]}
    for r in B.perplexity(docs, m, ["doc_id"]).collect():
        want, before = 0.0, end
        for c in texts[r.doc_id]:
            want += math.log10((big[before, c] + B.PULL * prior[c]) / (big[before].sum() + B.PULL))
            before = c
        for w in tokens(dict(rows)[r.doc_id]):
            c = class_of[hashed[w]]
            want += math.log10((count[w] + 0.1) / (in_class[c] + 0.1 * (distinct[c] + (c in unseen))))
        assert r.score == pytest.approx(want, rel=1e-9, abs=1e-9)


def test_word_hashes_by_plain_python(monkeypatch):
    """Weighed by the place among all bytes or in the word: the same hashes, starts and lengths, and those of the formula."""
    base, low, mask = int(C._BASE), lambda b: b + 32 if 65 <= b <= 90 else b, 2**64 - 1

    def plain(word, lower):
        h = sum(((low(b) if lower else b) + 1) * pow(base, i, 1 << 64) for i, b in enumerate(word)) + len(word) & mask
        h ^= h >> 33
        h = h * int(C._MIX1) & mask
        h ^= h >> 33
        h = h * int(C._MIX2) & mask
        return h ^ h >> 33

    texts = ["One  two\tONE", "", " \n", "é漢字 \x00a", "end", "x" * 300, "next begins at once"]
    data = [t.encode() for t in texts]
    offsets = np.r_[0, np.cumsum(list(map(len, data)))]
    want = [[w for w in re.findall(rb"[^\x20\x09-\x0D]+", d)] for d in data]
    for run in (C.RUN, 16):
        monkeypatch.setattr(C, "RUN", run)
        for lower in (True, False):
            h, per, start, length = C.word_hashes(np.frombuffer(b"".join(data), np.uint8), offsets, lower)
            assert h.tolist() == [plain(w, lower) for ws in want for w in ws] and per.tolist() == list(map(len, want))
            assert [b"".join(data)[a : a + n] for a, n in zip(start.tolist(), length.tolist())] == [w for ws in want for w in ws]


def test_hot_words_are_found_faster_than_by_halving():
    """The words of every pass over the texts meet the hot ones; a binary search took a third of such a pass."""
    rng = np.random.default_rng(8)
    h = rng.integers(0, 2**64, B.CONTEXT, np.uint64)
    hot = B.HotWords(h, np.ones(len(h), np.int64))
    asked = np.r_[rng.choice(h, 150_000), rng.integers(0, 2**64, 50_000, np.uint64)]
    suffix = np.zeros(len(asked), np.int64)
    hit, at, _ = hot.find(asked, suffix)
    assert np.array_equal(hit, np.isin(asked, h)) and np.array_equal(hot.h[at[hit]], asked[hit])

    def least(f):
        took = []
        for _ in range(7):
            began = time.process_time()
            f()
            took.append(time.process_time() - began)
        return min(took)

    assert least(lambda: hot.find(asked, suffix)) < 0.8 * least(lambda: np.searchsorted(hot.h, asked))


def test_counts_beyond_24_bits():
    """A word that stands beside itself more often than a packed count can say."""
    times = (1 << 24) + 1000
    text = pa.RecordBatch.from_arrays([pa.array(["a " * times])], ["text"])
    h = word_hashes(np.frombuffer(b"a", np.uint8), np.array([0, 1]), lower=True)[0]
    hot = B.HotWords(h, np.array([times]), np.array([B.TYPES + 3]))
    hot.kind[:] = B.TYPES + 3
    of = np.r_[np.zeros(B.END, np.int64), B.CLASSES - 1, np.arange(B.CLASSES)]
    rows = list(B._neighbours(hot, of)([text]))
    found = Counter()
    for b in rows:
        for near in b.column("near").to_pylist():
            for x in np.frombuffer(near, np.uint32).tolist():
                found[x >> 24] += x & 0xFFFFFF
    assert found == {B.SELF: times - 1, B.CLASSES - 1: 1, B.BEFORE + B.CLASSES - 1: 1}
