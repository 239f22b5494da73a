import random

import numpy as np
import pytest

from anchorline.llm import labelled as L
from anchorline.llm import quality_classifier as Q
from anchorline.llm import toxicity as T
from anchorline.llm.common import crc_mod, word_hashes
from tests.llm.conftest import prose

BAD = ["idiotic", "wretched", "moronish", "scumlike"]


def auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(len(score))
    return (rank[y == 1].mean() - (y.sum() - 1) / 2) / (len(y) - y.sum())


@pytest.fixture(scope="module")
def corpus(spark):
    rnd = random.Random(4)
    docs, labels = [], []
    for i in range(900):
        words = prose(rnd, rnd.randrange(40, 160)).split()
        good, toxic = int(rnd.random() < 0.7), int(rnd.random() < 0.25)
        if toxic:
            for _ in range(4):
                words.insert(rnd.randrange(len(words)), rnd.choice(BAD))
        text = " ".join(words) if good else " | ".join(words).upper()
        docs.append((i, text))
        labels.append((i, good, toxic))
    labels += [(None, 1, 1), (5000, 0, 0), (3, None, None)]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), labels


@pytest.mark.parametrize(("run", "column", "mod", "rest"), [(Q.quality_scores, 1, 3, 1), (T.toxicity_scores, 2, 4, 2)])
def test_held_out_rows(corpus, run, column, mod, rest):
    import zlib

    docs, labels, truth = corpus
    got = run(docs, labels).collect()
    assert len(got) == docs.count()
    y = {r[0]: r[column] for r in truth if r[column] is not None}
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % mod == rest) and 0 <= r.score <= 1 for r in got)
    s, t = np.array([r.score for r in held]), np.array([y[r.doc_id] for r in held])
    assert auc(s, t) > 0.95
    assert np.mean([r.predicted for r in held] == t) > 0.9
    again = {r.doc_id: r.score for r in run(docs, labels).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-9 for r in got)


@pytest.mark.parametrize("run", [Q.quality_scores, T.toxicity_scores])
def test_messy_and_unlabelled(spark, messy, nothing, corpus, run):
    _, labels, _ = corpus
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for given in (labels, none):
        got = run(messy, given).collect()
        assert len(got) == messy.count() and all(r.score is not None and r.held_out is not None and r.predicted in (0, 1) for r in got)
        assert set(messy.columns) - {"score"} <= set(run(messy, given).columns)
    assert run(nothing, labels).count() == 0


def test_labels_of_held_out_rows_teach_nothing(corpus, spark):
    from pyspark.sql import functions as F

    docs, labels, _ = corpus
    learn = ~(crc_mod(F.col("doc_id"), 3) == 1)
    flipped = labels.withColumn("quality", F.when(learn, F.col("quality")).otherwise(1 - F.col("quality")))
    a, b = ({r.doc_id: r.score for r in Q.quality_scores(docs, x).collect()} for x in (labels, flipped))
    assert a == b


def test_sample_is_bounded(corpus):
    from pyspark.sql import functions as F

    docs, labels, _ = corpus
    assert L.labelled_sample(docs, labels, "quality", F.lit(True), 50).count() == 50


def test_sample_is_bounded_by_rows_where_ids_are_repeated(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(1, f"text {i % 40}") for i in range(500)] + [(i, "one") for i in range(2, 9)] + [(9, None), (9, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 10)], "doc_id long, quality int")
    for limit in (2, 30, 100):
        rows = L.labelled_sample(docs, labels, "quality", F.lit(True), limit).collect()
        assert len(rows) <= limit and len({(r.doc_id, r.text) for r in rows}) == len(rows)
        assert sorted(rows) == sorted(L.labelled_sample(docs.repartition(3), labels, "quality", F.lit(True), limit).collect())
    assert len(rows) == 48 and {r.doc_id for r in rows} == set(range(1, 10))
    assert len(Q.quality_scores(docs, labels, limit=5).collect()) == docs.count()


def test_features_and_windows():
    assert T.windows("") == [] and len(T.windows("w " * 17)) == 3
    assert T.features(np.zeros(0, int)).shape == T.features(np.array([3, 9])).shape
    meter = T.Meter("plain words here", "wretched scumlike")
    clean, bad = meter(["plain words here plain words here", "plain wretched words scumlike here"])
    assert bad[0] > clean[0]


def test_network_learns():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((600, 4))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    net = L.train_network(x[:500], y[:500], epochs=150)
    assert auc(L.apply_network(net, x[500:]), y[500:]) > 0.9


def test_quality_scores_against_brute_force(corpus, messy):
    """Words, their entries, pooling and the network by plain Python, from the fitted vectors and weights alone."""
    import math
    import re
    from bisect import bisect_right

    from pyspark.sql import functions as F

    docs, labels, _ = corpus
    m = Q.fit(docs, labels, "quality", F.lit(True))
    known = {int(h): i for i, h in enumerate(m["known"])}
    vectors = m["vectors"].astype(float).tolist()

    def entry(word: bytes) -> int:
        data = np.frombuffer(word, np.uint8)
        h = int(word_hashes(data, np.array([0, len(data)]), lower=False)[0][0])
        kind = 0
        for b in word:
            kind |= 1 if 97 <= b <= 122 else 2 if 65 <= b <= 90 else 4 if 48 <= b <= 57 else 16 if b in b"#*$%&|<>" else 32 if b >= 128 else 8
        return known.get(h, len(known) + kind * 4 + bisect_right([4, 8, 14], len(word)))

    def brute(text: str | None) -> tuple[list[float], float]:
        es = [entry(w) for w in re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())]
        n, d = len(es), Q.DIM
        x = [sum(vectors[e][k] for e in es) / max(n, 1) for k in range(d)]
        x += [d * sum(vectors[a][k] * vectors[b][k] for a, b in zip(es, es[1:])) / max(n, 1) for k in range(d)] + [math.log1p(n)]
        a, b, c, e = m["net"]["layers"]
        z = [(v - mean) / scale for v, mean, scale in zip(x, m["net"]["mean"], m["net"]["scale"])]
        hidden = [math.tanh(sum(z[i] * a[i][j] for i in range(len(z))) + b[j]) for j in range(len(b))]
        t = (sum(h * w for h, w in zip(hidden, c)) + e[0]) / m["net"]["temperature"]
        return x, 1 / (1 + math.exp(-max(-30.0, min(30.0, t))))

    rows = Q.score(messy, m).collect()
    assert len(rows) == messy.count()
    for r in rows:
        if len(r.text or "") < 5000:
            pooled, want = brute(r.text)
            data = np.frombuffer((r.text or "").encode(), np.uint8)
            assert np.allclose(Q._pool(m["known"], m["vectors"], data, np.array([0, len(data)]))[0], pooled, atol=1e-4)
            assert r["score"] == pytest.approx(want, abs=2e-4)


def test_toxicity_scores_against_brute_force(corpus, messy):
    """Each window compressed by itself with both dictionaries, features and calibration by plain Python."""
    import math

    from pyspark.sql import functions as F

    docs, labels, _ = corpus
    m = T.fit(docs, labels, "toxic", F.lit(True))
    ordinary, toxic = T.compressor(f" {m['ordinary']} "), T.compressor(f" {m['ordinary']} {m['toxic']} ")
    assert any(w in m["toxic"].split() for w in BAD)

    def brute(text: str | None) -> float:
        words = "".join(c if c.isalnum() or c == "_" else " " for c in (text or "").lower()).split()
        gains = []
        for k in range(0, len(words), 8):
            window = f" {' '.join(words[k : k + 8])} ".encode()
            gains.append(len(ordinary.compress(window)) - len(toxic.compress(window)))
        gains.sort(reverse=True)
        many = [sum(g >= s for g in gains) for s in (2, 3, 4, 5, 6, 7, 9)]
        x = [gains[0] if gains else 0, sum(gains[:3]), math.log1p(len(gains)), *[c / math.sqrt(len(gains) + 1) for c in many], *[math.log1p(c) for c in many]]
        w, mean, scale = m["calibration"]
        t = sum((v - a) / b * k for v, a, b, k in zip(x, mean, scale, w)) + w[-1]
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, t))))

    rows = T.score(messy, m).collect()
    assert len(rows) == messy.count()
    for r in rows:
        assert r["score"] == pytest.approx(brute(r.text), abs=1e-9)
