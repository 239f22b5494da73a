import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from anchorline.llm import token_alignment as ta
from tests.llm.conftest import prose


def brute(texts):
    """Per text: a, b, groups and links by plain loops over byte positions, with the tokenizers that the contract names."""
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    out = []
    for text in texts:
        a = tok.encode(" " + text, add_special_tokens=False).ids if text else []
        b = sp.encode(text) if text else []
        ab = [bytes(byte_of[c] for c in tok.id_to_token(i)) for i in a]
        bb = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or b"".join(ab) != (" " + text).encode() or b"".join(bb) != (" " + text).encode():
            out.append(([], [], [], []))
            continue
        spans = []
        for pieces in (ab, bb):
            at, own = 0, []
            for p in pieces:
                own.append((at, at + len(p)))
                at += len(p)
            spans.append(own)
        common = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, low = [], 0
        for end in common:
            groups.append(([i for i, (_, e) in zip(a, spans[0]) if low < e <= end], [i for i, (_, e) in zip(b, spans[1]) if low < e <= end]))
            low = end
        links = [(i, j) for i, (s, e) in zip(a, spans[0]) for j, (x, y) in zip(b, spans[1]) if s < y and x < e]
        out.append((a, b, groups, links))
    return out


def check(spark, rows):
    found = brute([t for _, t in rows])
    counts = Counter(pair for *_, links in found for pair in set(links))
    highest = {}
    for (a, _), n in counts.items():
        highest[a] = max(highest.get(a, 0), n)
    want = Counter()
    for (doc_id, _), (a, b, groups, links) in zip(rows, found, strict=True):
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        want[(doc_id, len(a), len(b), len(groups), len(links), hashlib.sha256(text.encode()).hexdigest() if a else "", sum(counts[p] == highest[p[0]] for p in links), sum(counts[p] for p in links))] += 1
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("block", F.lit("x")).withColumn("pair", F.lit(1))
    got = Counter(tuple(r) for r in ta.align(df.repartition(3)).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum").collect())
    assert got == want


def test_against_brute_force(spark, messy_rows):
    special = ["<|endoftext|> and </s><s>", "a▁b", "tab\tand  two\n\n\nlines ", " 　​ x", "🙂🙃 é ﬁ", "0123456789 12,5", "don't WON'T", " leading", "\x00\x01 control"]
    rows = [(r[0], r[1][:4000] if r[1] else r[1]) for r in messy_rows] + [(500 + i, t) for i, t in enumerate(special)] + [(501, special[1]), (None, "no id")]
    check(spark, rows)


def test_empty_and_token_free_tables(spark):
    check(spark, [(1, None), (2, ""), (3, "▁")])
    assert ta.align(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_long_texts_and_many_blocks(spark, monkeypatch):
    rng = random.Random(2)
    words = [prose(rng, 40) for _ in range(30)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 9)))) for i in range(300)] + [(900, "y" * 300_000), (901, " ".join(words * 200))]
    whole = {tuple(r) for r in ta.align(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()}
    spread = {tuple(r) for r in ta.align(spark.createDataFrame(rows, "doc_id long, text string").repartition(40)).collect()}
    assert len(whole) == len(rows) and whole == spread


@pytest.mark.parametrize("n,m,span", [(0, 5, 9), (5, 0, 9), (1, 1, 2), (40, 300, 400), (300, 300, 301), (1000, 5000, 100_000), (257, 4096, 4200)])
def test_galloping_ranks(n, m, span):
    rng = np.random.default_rng(n + m)
    short, long = np.sort(rng.choice(span, n, replace=False)), np.sort(rng.choice(span, m, replace=False))
    rank, there = ta.gallop(short, long)
    assert np.array_equal(rank, np.searchsorted(long, short)) and np.array_equal(there, np.isin(short, long))


def test_links_of_a_block_are_packed_narrowly():
    """Of a block some 900,000 links stood in 8 bytes each in every row buffer, batch and sort of the second stage."""
    rnd = np.random.default_rng(1)
    for n, most in ((0, 1), (1, 1), (200_000, 13_000), (1_000, 70_000)):
        which, times = rnd.integers(0, most, n), rnd.integers(1, 4, n)
        data = ta.packed(which=which, times=times)
        got = ta.unpacked(data)
        assert got["which"].tolist() == which.tolist() and got["times"].tolist() == times.tolist()
        assert len(data) < 3 * n + 2_000
