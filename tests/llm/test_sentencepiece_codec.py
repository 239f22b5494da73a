"""Held against the sentencepiece library itself."""

import hashlib
import random
import time

import numpy as np
import pytest
import sentencepiece as spm

from anchorline.llm import sentencepiece_codec as S
from anchorline.llm.common import Places


@pytest.fixture(scope="module")
def lib():
    return spm.SentencePieceProcessor(model_file=S.piece_model())


CASES = ["", " ", "  a", "a\nb\tc", "▁x", "hi  there ", "\x00a", "é漢😀", "\r\n", "a▁▁b", "<s> hi", "<unk>", "<0x41>", "a" * 999, " " * 50, "!" * 77 + "?", "\n\n\n", "  \n  x", "the" * 300, "漢" * 40]


def test_cases(lib):
    own = S.codec(S.piece_model())
    for t in CASES:
        assert own.encode(t) == lib.encode(t), t[:30]
        assert own.decode(own.encode(t)) == lib.decode(lib.encode(t)), t[:30]
        n, ids, decoded = own.summaries([t])[0]
        assert n == len(lib.encode(t)) and decoded == lib.decode(lib.encode(t))


def test_random_texts(lib):
    own, rnd = S.codec(S.piece_model()), random.Random(5)
    alphabet = "aaabbethinoersABC  \n\t.,é▁ßñ漢😀-_=\\^]['0123456789"
    for _ in range(3000):
        t = "".join(rnd.choice(alphabet) for _ in range(rnd.randrange(60)))
        assert own.encode(t) == lib.encode(t), t
        assert own.summaries([t])[0][2] == lib.decode(lib.encode(t)), t


def test_long_segments(lib):
    own, rnd = S.codec(S.piece_model()), random.Random(4)
    letters = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(200_000))
    base64 = "".join(rnd.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(50_000))
    cases = [letters, base64, "a" * 5001, "ab" * 3000, "the" * 4000, "inter" * 999 + "nation" * 700, " " * 3000 + "x", "een" * 2000 + "漢字かな" * 500, "".join(rnd.choice(["er", "in", "est", "tion", "al", "s"]) for _ in range(6000))]
    began = time.time()
    for text, (n, ids, decoded) in zip(cases, own.summaries(cases), strict=True):
        want = lib.encode(text)
        assert [int(x) for x in ids.split(",")] == want and n == len(want) and decoded == lib.decode(want)
    assert time.time() - began < 60


def test_agenda_merges_in_the_librarys_order(lib, monkeypatch):
    monkeypatch.setattr(S, "LONG", 3)
    monkeypatch.setattr(S, "LONG_ROUNDS", 1)
    own = S.PieceCodec(S.piece_model())
    for text in ("internationalisation of undercover misunderstandings", "aaaaaaaaaaaaaaa", "hhhhhhéé  ==== ----- 11111"):
        assert own.encode(text) == lib.encode(text)


def test_table_is_bounded(lib, monkeypatch):
    monkeypatch.setattr(S, "REMEMBERED", 10)
    monkeypatch.setattr(S, "BATCH_SYMBOLS", 16)
    own = S.PieceCodec(S.piece_model())
    for t in ("one two three four five six seven", "eight nine ten eleven twelve", " ".join(map(str, range(40)))):
        assert own.encode(t) == lib.encode(t)


def test_query_rows(spark, lib):
    rows = [(1, "the the the", "x"), (2, None, "y"), (2, None, "y"), (3, "", None), (None, "a " * 5000, "z"), (4, "ok\n", "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = S.encode_decode(df).collect()
    assert len(got) == len(rows)
    for r in got:
        ids = lib.encode(r.text or "")
        assert r.n_tokens == len(ids) and r.ids == ",".join(map(str, ids))
        assert r.ids_sha256 == hashlib.sha256(r.ids.encode()).hexdigest()
        assert r.decoded == lib.decode(ids) and r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()
    assert S.encode_decode(df.where("doc_id = 99")).count() == 0


def test_rounds_look_up_only_new_pairs(lib, monkeypatch):
    """A merge makes two pairs at most; all others keep what was found for them."""
    own, rnd = S.PieceCodec(S.piece_model()), random.Random(6)
    words = ["▁" + "".join(rnd.choice("etaoinshrdlu") for _ in range(12)) for _ in range(500)]
    looked, merged = [], own.merged
    monkeypatch.setattr(own, "merged", lambda a, b: looked.append(len(a)) or merged(a, b))
    own.learn(words)
    pairs, merges = sum(len(w) - 1 for w in words), sum(len(w) - own.ids_of[w].count(",") - 1 for w in words)
    assert merges > 1500 and sum(looked) <= pairs + 2 * merges
    assert all(own.ids_of[w] == ",".join(map(str, lib.encode(w[1:]))) for w in words)


def test_places_hold_all_keys():
    rnd = np.random.default_rng(7)
    some = rnd.integers(0, 2**64, 5000, np.uint64)
    for keys in (some, some[:1], some[:0], np.r_[some, np.arange(40, dtype=np.uint64), np.uint64(2**64 - 1) - np.arange(40, dtype=np.uint64)]):
        asked = np.r_[keys, keys + np.uint64(1), rnd.integers(0, 2**64, 500, np.uint64), np.uint64(0), np.uint64(2**64 - 1)]
        hit, at = Places(keys).find(asked)
        place = {k: i for i, k in enumerate(np.sort(keys).tolist())}
        assert [int(a) if h else None for h, a in zip(hit, at)] == [place.get(k) for k in asked.tolist()]


def test_tasks_leave_no_table(spark):
    """A worker that goes on to other stages doesn't hold the last task's segments."""
    docs = spark.createDataFrame([(i, f"word{i} of many") for i in range(200)], "doc_id long, text string")
    assert S.encode_decode(docs).where("n_tokens > 0").count() == 200

    def held(_):
        own = S.codec(S.piece_model())
        yield len(own.ids_of) + len(own.bytes_of) + len(own.old[0]) + len(own.old[1])

    assert max(spark.sparkContext.parallelize(range(8), 8).mapPartitions(held).collect()) == 0
