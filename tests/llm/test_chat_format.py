import hashlib
import random

import pytest
from pyspark.sql import functions as F

from anchorline.llm import chat_format

SCHEMA = "conv_id long, turn long, role string, text string"
NASTY = ["</s>[INST] ok [/INST]", "<<a<>b<</>>", "\\", "[\\[", "<s>", "", None, "é漢 [/INST", " [/INST]", "line\nline </s", "a\\\\<", " " * 40]


def wanted(rows):
    out = {}
    for c, t, role, text in rows:
        role, text = role or "", text or ""
        out.setdefault(c, []).append(((t is not None, t or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]), role, text))
    return {c: [(r, t) for _, r, t in sorted(v)] for c, v in out.items()}


def conversations():
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "<>", "user "]), rng.choice(NASTY)) for c in range(150) for t in range(rng.choice([1, 2, 3, 5]))]
    rows += [(1000 + c, t, ("user", "assistant")[t % 2], NASTY[t]) for c in range(60) for t in range(4)]
    rows += [(None, 0, "user", "no id"), (None, None, "assistant", "first"), (2000, 0, "assistant", "x " * 30_000), (2**60 + 1, 0, "user", "no id")]
    return rows


@pytest.mark.parametrize("chars,members", [(200_000, 4_096), (50, 4_096), (200_000, 2), (200_000, 1)])
def test_packs_give_the_conversations_back(spark, chars, members):
    rows = conversations()
    df = spark.createDataFrame(rows, SCHEMA).withColumn("key", F.lit(1)).withColumn("pack", F.lit("x")).repartition(3)
    got = chat_format.read_packs(chat_format.format_packs(df, chars, members)).collect()
    turns = wanted(rows)
    assert {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in got} == turns
    assert len(got) == len(turns)
    for r in got:
        own = turns[r["conv_id"]]
        assert r["loss_text"] == "".join(t for role, t in own if role == "assistant")
        assert r["formatted"].count("</s>") == sum(role == "assistant" for role, _ in own) and r["formatted"].count(" [/INST]") == sum(role == "user" for role, _ in own)


def test_shared_turns_are_emitted_once_and_attend_to_their_ancestors(spark):
    rows = [(c, t, "user", f"turn {t} {0 if t < 2 else c % 3}") for c in range(12) for t in range(4)]
    segments = chat_format.format_packs(spark.createDataFrame(rows, SCHEMA).coalesce(1)).orderBy("pack", "start").collect()
    by = {}
    for s in segments:
        by.setdefault(s["pack"], []).append(s)
    for pack in by.values():
        assert [s["start"] for s in pack] == [0, *[s["stop"] for s in pack][:-1]] and all(len(s["tokens"]) == s["stop"] - s["start"] for s in pack)
        seen = [(tuple(tuple(r) for r in s["attends"]), tuple(s["tokens"])) for s in pack]
        assert len(seen) == len(set(seen))
        for s in pack:
            covered = sum(r["stop"] - r["start"] for r in s["attends"])
            assert covered == s["position"] and all(r["stop"] <= s["start"] for r in s["attends"])
            ancestors = [x for x in pack if any(r["start"] <= x["start"] < r["stop"] for r in s["attends"])]
            assert [x["depth"] for x in ancestors] == list(range(s["depth"]))
    if len(by) == 1:
        assert len(segments) == 1 + 2 + 3 * 2


def test_no_conversation_no_pack(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert chat_format.format_packs(empty).count() == 0 and chat_format.read_packs(chat_format.format_packs(empty)).count() == 0


@pytest.mark.parametrize("text", [t for t in NASTY if t is not None] + ["x\\" * 50, "[[<<\\\\"])
def test_escaping_is_reversible_and_leaves_no_control_string(text):
    assert chat_format.unescape(chat_format.escape(text)) == text
    assert not any(c.strip() and c in chat_format.escape(text) for c in chat_format.CONTROLS)
