"""Chat formatting with a prefix tree: turns that conversations share are emitted once.

Conversations are sorted by the digests of their turns and cut into packs: runs of neighbours with at most PACK_CHARS new
characters of text.  A pack's prefix tree (union-find over the links between neighbours, see ``prefix_trie``) is emitted in depth-first order:
each node's tokens once, with the position that they have in every conversation through them, and the ranges of the
pack's stream that hold the node's ancestors, which is all that its tokens may attend to besides their own.  A pack is complete by
itself: its first conversation's turns are emitted in it even if the pack before has them.

Template: ``<s>`` once, then per turn ``[INST] text [/INST]`` (user), `` text</s>`` (assistant) or ``<<role<>text<</>>`` (any other role).
In roles and texts each of ``[``, ``<`` and a backslash is followed by a backslash more, so that no control string occurs in them
and the text comes back exactly.  Control strings have token ids of their own (from 50,256 on), texts go through the byte-level vocabulary, which
loses nothing.  The loss mask covers the tokens of assistant texts only.

Defined results: a null role or text counts as empty; turns are ordered by turn (null first), then by a digest of role and text; repeated
rows are turns of their own; rows without conv_id are one conversation, whose id is null; an empty table gives no packs; other columns
play no part.  A conversation is formatted whole: a task holds a pack, and one conversation more.
"""

from __future__ import annotations

import base64
import itertools
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anchorline.llm.common import materialize, table
from anchorline.llm.prefix_trie import DIGEST, Forest, turn_digest

#: Characters of new text, and conversations, of a pack.
PACK_CHARS, PACK_ROWS = 200_000, 4_096
#: Control strings, in the order of their token ids.
CONTROLS = ("<s>", "[INST] ", " [/INST]", " ", "</s>", "<<", "<>", "<</>>")
FIRST_CONTROL = 50_256
BEGIN, USER, USER_END, ASSISTANT, ASSISTANT_END, OTHER, OTHER_TEXT, OTHER_END = range(FIRST_CONTROL, FIRST_CONTROL + len(CONTROLS))
_TURN = re.compile(r"\[INST\] (?P<user>.*?) \[/INST\]| (?P<assistant>.*?)</s>|<<(?P<role>.*?)<>(?P<other>.*?)<</>>", re.S)

_SEGMENT = pa.schema([
    ("pack", pa.int64()), ("start", pa.int64()), ("stop", pa.int64()), ("position", pa.int64()), ("depth", pa.int64()), ("attends", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
    ("tokens", pa.list_(pa.int32())), ("loss_start", pa.int64()), ("loss_stop", pa.int64()), ("ends", pa.list_(pa.int64())),
])
_READ = pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("turns", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))), ("loss_text", pa.string())])
SEGMENT_DDL = "pack long, start long, stop long, position long, depth long, attends array<struct<start: long, stop: long>>, tokens array<int>, loss_start long, loss_stop long, ends array<long>"


def escape(text: str) -> str:
    return re.sub(r"([\[<\\])", r"\1\\", text)


def unescape(text: str) -> str:
    return re.sub(r"([\[<\\])\\", r"\1", text)


@lru_cache(maxsize=1)
def _encoding():
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    pieces = [b""] * FIRST_CONTROL
    for token, rank in ranks.items():
        pieces[rank] = token
    return tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), [*pieces, *[c.encode() for c in CONTROLS]]


def encode_turn(role: str, text: str) -> tuple[list[int], int, int]:
    """Tokens of a turn, and the range of them that the loss covers (empty at 0 for other roles than the assistant)."""
    own = _encoding()[0]
    body = own.encode_ordinary(escape(text))
    if role == "user":
        return [USER, *body, USER_END], 0, 0
    if role == "assistant":
        return [ASSISTANT, *body, ASSISTANT_END], 1, 1 + len(body)
    return [OTHER, *own.encode_ordinary(escape(role)), OTHER_TEXT, *body, OTHER_END], 0, 0


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    out, at = [], len(CONTROLS[0])
    if not formatted.startswith(CONTROLS[0]):
        raise ValueError("no begin of a conversation")
    while at < len(formatted):
        found = _TURN.match(formatted, at)
        if not found:
            raise ValueError(f"no turn begins at {at}")
        at = found.end()
        if found["user"] is not None:
            out.append(("user", unescape(found["user"])))
        elif found["assistant"] is not None:
            out.append(("assistant", unescape(found["assistant"])))
        else:
            out.append((unescape(found["role"]), unescape(found["other"])))
    return out


def _pack(number: int, keys: list[bytes], lcp: list[int], ids: list[int | None], turns: list[list[dict]]) -> pa.RecordBatch:
    """The segments of a pack in depth-first order; rows sorted by key, ``lcp`` the turns shared with the row before."""
    depth = np.array([len(k) // DIGEST for k in keys], np.int64)
    links = np.array([0, *lcp[1:]], np.int64)
    new = np.r_[True, (links[1:] < depth[1:]) | (links[1:] < depth[:-1])]
    rows = np.flatnonzero(new)
    cut = [*rows.tolist(), len(keys)]
    forest = Forest(depth[rows], links[rows], np.zeros(len(rows), np.int64))
    tokens, losses = [[BEGIN]], [(None, None)]
    start, depths = [0], [0]
    at = 1
    for k, d in zip(forest.first.tolist(), forest.depth.tolist(), strict=True):
        turn = turns[cut[k]][d - 1]
        ids_, a, b = encode_turn(turn["role"], turn["text"])
        tokens.append(ids_), start.append(at), depths.append(d)
        losses.append((at + a, at + b) if a else (None, None))
        at += len(ids_)
    stop = [s + len(t) for s, t in zip(start, tokens, strict=True)]
    # of each key: the ranges of its ancestors that an earlier key emitted, and their tokens in all
    inherited: list[list[tuple[int, int]]] = []
    attends: list[list[dict]] = [[]]
    position = [0]
    ends: list[list] = [[]]
    begin, above, shared = forest.begin.tolist(), forest.above.tolist(), forest.lcp.tolist()
    for k in range(len(rows)):
        if shared[k]:
            top = above[k]
            ranges = [*inherited[top]]
            a, b = start[1 + begin[top]], stop[1 + begin[top] + shared[k] - shared[top] - 1]
        else:
            ranges, (a, b) = [], (0, 1)
        if ranges and ranges[-1][1] == a:
            ranges[-1] = (ranges[-1][0], b)
        else:
            ranges.append((a, b))
        inherited.append(ranges)
        before = sum(y - x for x, y in ranges)
        first = 1 + begin[k]
        for j in range(first, first + int(depth[rows[k]]) - shared[k]):
            chain = ranges if j == first else [*ranges[:-1], (ranges[-1][0], start[j])] if ranges[-1][1] == start[first] else [*ranges, (start[first], start[j])]
            attends.append([{"start": x, "stop": y} for x, y in chain])
            position.append(before + start[j] - start[first])
            ends.append([])
        ends[-1 if depth[rows[k]] else 0].extend(ids[cut[k] : cut[k + 1]])
    lost = list(zip(*losses, strict=True))
    columns = [[number] * len(start), start, stop, position, depths, attends, tokens, lost[0], lost[1], ends]
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, _SEGMENT, strict=True)], schema=_SEGMENT)


def _shared(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // DIGEST
    x, y = np.frombuffer(a, np.uint8, n), np.frombuffer(b, np.uint8, n)
    return int(np.argmax(x != y)) // DIGEST


def _packs(batches: Iterator[pa.RecordBatch], most_chars: int, most_rows: int) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 32
    keys: list[bytes] = []
    lcp: list[int] = []
    ids: list[int | None] = []
    turns: list[list[dict]] = []
    chars = 0
    for batch in batches:
        for i in range(batch.num_rows):
            key = batch.column("key")[i].as_py()
            own = batch.column("turns")[i].as_py()
            same = _shared(keys[-1], key) if keys else 0
            new = sum(len(t["text"]) + len(t["role"]) for t in own[same:])
            if keys and (chars + new > most_chars or len(keys) >= most_rows):
                yield _pack(number, keys, lcp, ids, turns)
                keys, lcp, ids, turns, chars, number, same = [], [], [], [], 0, number + 1, 0
                new = sum(len(t["text"]) + len(t["role"]) for t in own)
            # of equal keys in a row the first one's turns are enough
            turns.append(own if same < len(own) or not turns else turns[-1])
            keys.append(key), lcp.append(same), ids.append(batch.column("conv_id")[i].as_py())
            chars += new
    if keys:
        yield _pack(number, keys, lcp, ids, turns)


def format_packs(conversations: DataFrame, most_chars: int = PACK_CHARS, most_rows: int = PACK_ROWS) -> DataFrame:
    """The packs' segments: pack, start and stop in the pack's stream of tokens, position of the first token, depth, attends, tokens, loss_start and loss_stop (null where nothing is learned), ends (conversations that are complete with this segment)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").isNotNull().alias("given"), F.coalesce("turn", F.lit(0)).alias("turn"), turn_digest(role, text).alias("digest"), role.alias("role"), text.alias("text")).alias("t"))
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    keyed = whole.select("conv_id", F.unhex(F.array_join("t.digest", "")).alias("key"), F.arrays_zip(F.col("t.role").alias("role"), F.col("t.text").alias("text")).alias("turns"))
    rows = keyed.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    return rows.mapInArrow(lambda batches: _packs(batches, most_chars, most_rows), SEGMENT_DDL)


def _read_pack(rows: pa.Table) -> pa.Table:
    segments = sorted(rows.to_pylist(), key=lambda s: s["start"])
    starts = [s["start"] for s in segments]
    pieces = _encoding()[1]
    # the bytes of the stream, and where each token's begin
    stream = [pieces[t] for s in segments for t in s["tokens"]]
    at = [0, *itertools.accumulate(map(len, stream))]
    whole = b"".join(stream)
    text = lambda x, y: whole[at[x] : at[y]]
    out: dict[str, list] = {"conv_id": [], "formatted": [], "turns": [], "loss_text": []}
    for s in segments:
        if not s["ends"]:
            continue
        ranges = [(r["start"], r["stop"]) for r in s["attends"]] + [(s["start"], s["stop"])]
        position, learned = 0, []
        for x, y in ranges:
            for k in range(bisect_left(starts, x), bisect_left(starts, y)):
                if segments[k]["position"] != position:
                    raise ValueError("positions of a conversation aren't in order")
                position += segments[k]["stop"] - segments[k]["start"]
                if segments[k]["loss_start"] is not None:
                    learned.append(text(segments[k]["loss_start"], segments[k]["loss_stop"]))
        formatted = b"".join(text(x, y) for x, y in ranges).decode("utf-8", "replace")
        turns = [{"role": r, "text": t} for r, t in parse(formatted)]
        loss = unescape(b"".join(learned).decode("utf-8", "replace"))
        n = len(s["ends"])
        for c, values in zip(out, (s["ends"], [formatted] * n, [turns] * n, [loss] * n), strict=True):
            out[c].extend(values)
    return pa.table(out, schema=_READ)


def read_packs(packs: DataFrame) -> DataFrame:
    """Conversations read back from packs (of bounded size each): conv_id, formatted text, turns, and all text under the loss mask."""
    return packs.groupBy("pack").applyInArrow(_read_pack, "conv_id long, formatted string, turns array<struct<role: string, text: string>>, loss_text string")


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    packs = materialize(format_packs(given.unionByName(more)), "chat-packs")
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read_packs(packs).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines.cast("binary"), 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE_SQL = r"""
with turns as (
  select conv_id, turn, coalesce(role, '') role, coalesce(text, '') txt from conversations
  union all
  select -1, t, case when t = 0 then 'user' else 'assistant' end, '</s>[INST] ok [/INST]' from range(2) r(t)),
sized as (
  select *, length(regexp_replace(txt, '([\[<\\])', '\1\\', 'g')) n, length(regexp_replace(role, '([\[<\\])', '\1\\', 'g')) m from turns)
select conv_id, count(*) n_turns, sha256(string_agg(concat(role, chr(10), txt, chr(10)), '' order by turn nulls first, role, txt)) turns_sha256,
       cast(coalesce(sum(length(txt)) filter (where role = 'assistant'), 0) as bigint) loss_chars,
       sha256(coalesce(string_agg(txt, '' order by turn nulls first, role, txt) filter (where role = 'assistant'), '')) loss_sha256,
       cast(3 + sum(case when role = 'user' then 15 + n when role = 'assistant' then 5 + n else 9 + m + n end) as bigint) formatted_chars
from sized group by conv_id
"""
