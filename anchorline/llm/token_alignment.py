"""Alignment of two tokenizers over the same text by galloping intersection of their token ends.

Both token lists of a text are byte ranges that cover the same bytes.  The shorter list of ends is searched in the
longer one: element by element from its left neighbour's place, with steps that double until they pass it, then by
halves (all elements of a level at once, levels from coarse to fine, so that each one starts near its place).  Common
ends cut both lists into groups; the ranks of a token's two ends in the other list are the range of tokens that
it overlaps.

Texts go through in blocks of bounded size.  A block is one row: its documents, its distinct linked id pairs,
and which document has which pair how often.  The pairs of all blocks are counted by a shuffle (a block adds a pair
once, so no pair is hotter than the number of blocks), and the counts of a block's pairs come back to it by a
join; texts are encoded once.

Defined results: a null or empty text has no tokens, nor has one whose joined tokens aren't a space and its bytes (such
as one with U+2581); their numbers are 0 and their digest is ''.  Repeated rows, also of one id, are documents of their
own, in the counts too.  Columns other than doc_id and text play no part.  Long texts are encoded whole and make a block by themselves.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from anchorline.llm.common import chunks, materialize, table, text_bytes

#: Bytes of text that are aligned together, and that make a block.
ALIGN_BYTES, BLOCK_BYTES = 1 << 20, 1 << 23
#: Blocks of a task that brings the counts back.
TASK_BLOCKS = 8
_EMPTY = np.zeros(0, np.int64)

_DOC = [("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string())]
_DOC_DDL = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
_RESULT_DDL = f"{_DOC_DDL}, n_best long, count_sum long"


class Vocabulary:
    """Encodes texts; ``lengths`` and ``pieces`` have the bytes that each id stands for."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], pieces: list[bytes]):
        self.encode, self.pieces = encode, pieces
        self.lengths = np.array([len(p) for p in pieces], np.int64)
        digits = np.zeros((len(pieces), 8), np.uint8)
        for i in range(len(pieces)):
            name = str(i).encode()
            digits[i, : len(name)] = np.frombuffer(name, np.uint8)
        self.digits, self.digit_count = digits, (digits > 0).sum(1)


@lru_cache(maxsize=1)
def byte_vocabulary() -> Vocabulary:
    """byte_bpe_50k, of a space and the text; special strings are plain text. The rank file has the vocabulary of the JSON file, and its library encodes alike, four times as fast."""
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    own = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    pieces = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        pieces[rank] = token
    return Vocabulary(lambda texts: [own.encode_ordinary(" " + t) for t in texts], pieces)


@lru_cache(maxsize=1)
def piece_vocabulary() -> Vocabulary:
    """piece_bpe_32k, which puts the space before the text itself."""
    import public_tokenizers
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    names = [own.id_to_piece(i) for i in range(own.get_piece_size())]
    pieces = [bytes([int(p[3:5], 16)]) if own.is_byte(i) else b"" if own.is_control(i) or own.is_unknown(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
    return Vocabulary(lambda texts: own.encode(texts, num_threads=1), pieces)


def gallop(short: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each element of ``short`` its rank in ``long`` (how many are smaller), and whether it is there. Both strictly ascending."""
    n, m = len(short), len(long)
    rank = np.zeros(n, np.int64)
    if not n or not m:
        return rank, np.zeros(n, bool)
    padded = np.append(long, np.iinfo(np.int64).max)

    def search(at: np.ndarray, low: np.ndarray) -> None:
        """Ranks of short[at], which are low or more."""
        x = short[at]
        high, step = low.copy(), 1
        passing = np.flatnonzero(padded[high] < x)
        while len(passing):
            low[passing] = high[passing] + 1
            high[passing] = np.minimum(high[passing] + step, m)
            step *= 2
            passing = passing[padded[high[passing]] < x[passing]]
        open_ = np.flatnonzero(low < high)
        while len(open_):
            middle = (low[open_] + high[open_]) >> 1
            smaller = padded[middle] < x[open_]
            low[open_[smaller]] = middle[smaller] + 1
            high[open_[~smaller]] = middle[~smaller]
            open_ = open_[low[open_] < high[open_]]
        rank[at] = low

    search(np.zeros(1, np.int64), np.zeros(1, np.int64))
    stride = 1 << max(0, (n - 1).bit_length() - 1)
    while stride and n > 1:
        at = np.arange(stride, n, 2 * stride)
        search(at, rank[at - stride].copy())
        stride >>= 1
    return rank, padded[rank] == short


def links(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Indices of all overlapping pairs of tokens, and for both lists which tokens end a group. Both cover the same bytes."""
    swap = len(a_ends) > len(b_ends)
    short, long = (b_ends, a_ends) if swap else (a_ends, b_ends)
    rank, common = gallop(short, long)
    # a token overlaps what ends after its begin, up to the one that holds or shares its end
    first = np.r_[0, (rank + common)[:-1]] if len(rank) else rank
    many = rank - first + 1
    mine = np.repeat(np.arange(len(short)), many)
    other = np.arange(len(mine)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)
    ends = np.zeros(len(long), bool)
    ends[rank[common]] = True
    return (other, mine, ends, common) if swap else (mine, other, common, ends)


def groups_text(a: np.ndarray, b: np.ndarray, a_last: np.ndarray, b_last: np.ndarray, va: Vocabulary, vb: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of `a1,a2|b1;a3|b2,b3;`, and of each B token where its part ends."""
    n = len(a) + len(b)
    a_group, b_group = np.cumsum(a_last) - a_last, np.cumsum(b_last) - b_last
    b_before = np.r_[0, np.flatnonzero(b_last) + 1]  # B tokens before each group
    a_through = np.flatnonzero(a_last) + 1  # A tokens up to the end of each group
    at_a, at_b = np.arange(len(a)) + b_before[a_group], np.arange(len(b)) + a_through[b_group]
    cells, size = np.empty((n, 8), np.uint8), np.empty(n, np.int64)
    for at, ids, last, mark, v in ((at_a, a, a_last, "|", va), (at_b, b, b_last, ";", vb)):
        part, count = v.digits[ids], v.digit_count[ids]
        part[np.arange(len(ids)), count] = np.where(last, ord(mark), ord(","))
        cells[at], size[at] = part, count + 1
    return cells[cells > 0], np.cumsum(size)[at_b]


def _joined(ids: list[int], v: Vocabulary) -> bytes:
    return b"".join(map(v.pieces.__getitem__, ids))


def align_texts(texts: list[str | None], va: Vocabulary, vb: Vocabulary) -> tuple[dict[str, np.ndarray], list[bytes], np.ndarray, np.ndarray]:
    """Of each text the numbers of tokens, groups and links, and the groups; of all links the text and the pair (A id times B ids, plus B id)."""
    given = [t or "" for t in texts]
    some = [i for i, t in enumerate(given) if t]
    wanted = [given[i] for i in some]
    a_ids, b_ids = va.encode(wanted), vb.encode(wanted)
    good = []
    for i, a, b in zip(some, a_ids, b_ids, strict=True):
        text = (" " + given[i]).encode("utf-8", "surrogatepass")
        good.append(_joined(a, va) == text and _joined(b, vb) == text)
    rows = np.array([i for i, g in zip(some, good, strict=True) if g], np.int64)
    a_ids, b_ids = [x for x, g in zip(a_ids, good, strict=True) if g], [x for x, g in zip(b_ids, good, strict=True) if g]
    n_a, n_b = np.array([len(x) for x in a_ids], np.int64), np.array([len(x) for x in b_ids], np.int64)
    a = np.concatenate([np.array(x, np.int64) for x in a_ids]) if len(rows) else _EMPTY
    b = np.concatenate([np.array(x, np.int64) for x in b_ids]) if len(rows) else _EMPTY
    # both lists of a text end at the same byte, so all texts go through one search
    la, lb, a_last, b_last = links(np.cumsum(va.lengths[a]), np.cumsum(vb.lengths[b]))
    doc = np.repeat(np.arange(len(rows)), n_a)[la]
    out = {c: np.zeros(len(given), np.int64) for c in ("n_a", "n_b", "n_groups", "n_links")}
    out["n_a"][rows], out["n_b"][rows] = n_a, n_b
    out["n_groups"][rows] = np.bincount(np.repeat(np.arange(len(rows)), n_b)[b_last], minlength=len(rows))
    out["n_links"][rows] = np.bincount(doc, minlength=len(rows))
    flat, ends = groups_text(a, b, a_last, b_last, va, vb)
    data, begin, groups = flat.tobytes(), 0, [b""] * len(given)
    for i, end in zip(rows.tolist(), ends[np.cumsum(n_b) - 1].tolist() if len(rows) else [], strict=True):
        groups[i] = data[begin : end - 1]
        begin = end
    return out, groups, rows[doc], a[la] * len(vb.pieces) + b[lb]


def packed(**columns: np.ndarray) -> bytes:
    """Columns of whole numbers, none negative, in the narrowest form that holds them, compressed: a block's rows stay small wherever they are sorted, shuffled and batched."""
    narrow = {c: x.astype(np.min_scalar_type(int(x.max(initial=0)))) for c, x in columns.items()}
    batch = pa.record_batch([pa.array(x) for x in narrow.values()], names=list(narrow))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 1))) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpacked(data: bytes) -> dict[str, np.ndarray]:
    batch = pa.ipc.open_stream(data).read_next_batch()
    return {c: batch.column(c).to_numpy() for c in batch.schema.names}


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per block; ``links`` has, packed, ``which`` and ``times``: for all documents in turn, ``per_doc`` of them each, the places of their pairs in ``pairs`` and how often each stands."""
    va, vb = byte_vocabulary(), piece_vocabulary()
    number = TaskContext.get().partitionId() << 32
    held: dict[str, list] = {}
    size = 0

    def flush() -> pa.RecordBatch:
        doc = pa.StructArray.from_arrays([pa.array(np.concatenate(held[c]), t) if c.startswith("n_") else pa.array([x for part in held[c] for x in part], t) for c, t in _DOC], [c for c, _ in _DOC])
        pair = np.concatenate(held["pair"])
        pairs, which = np.unique(pair, return_inverse=True)
        one = lambda values, kind: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))
        docs = pa.ListArray.from_arrays(pa.array([0, len(doc)], pa.int32()), doc)
        columns = [pa.array([number], pa.int64()), docs, one(pairs, pa.int64()), one(np.bincount(which, minlength=len(pairs)), pa.int64()), one(np.concatenate(held["per_doc"]), pa.int64()), pa.array([packed(which=which, times=np.concatenate(held["times"]))], pa.binary())]
        return pa.record_batch(columns, names=["block", "docs", "pairs", "in_docs", "per_doc", "links"])

    for batch in batches:
        text, ids = batch.column("text"), batch.column("doc_id")
        _, offsets = text_bytes(text)
        for i, j in chunks(offsets, ALIGN_BYTES):
            numbers, groups, doc, pair = align_texts(text.slice(i, j - i).to_pylist(), va, vb)
            # distinct pairs of each document, with the number of their links
            of, times = np.unique(doc * (len(va.pieces) * len(vb.pieces)) + pair, return_counts=True)
            own = of // (len(va.pieces) * len(vb.pieces))
            parts = numbers | {"doc_id": ids.slice(i, j - i).to_pylist(), "groups_sha256": [hashlib.sha256(g).hexdigest() if g else "" for g in groups]}
            parts |= {"pair": of % (len(va.pieces) * len(vb.pieces)), "times": times.astype(np.int32), "per_doc": np.bincount(own, minlength=j - i)}
            for c, values in parts.items():
                held.setdefault(c, []).append(values)
            size += int(offsets[j] - offsets[i])
            if size >= BLOCK_BYTES:
                done = flush()
                held, size, number = {}, 0, number + 1
                yield done
                # what a block took isn't kept for the worker's next tasks
                del done
                pa.default_memory_pool().release_unused()
    if held:
        yield flush()


def _with_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of the blocks with the sums over their links."""
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1)
            flat = lambda c: row.column(c).flatten().to_numpy(zero_copy_only=False)  # noqa: E731,B023
            docs = row.column("docs").flatten()
            counted = row.column("counted").flatten()
            pair, count, best = [counted.field(i).to_numpy(zero_copy_only=False) for i in range(3)]
            by = np.argsort(pair)
            count, best = count[by].astype(np.int64), best[by].astype(np.int64)
            per_doc, links_ = flat("per_doc").astype(np.int64), unpacked(row.column("links")[0].as_py())
            which, times = links_["which"], links_["times"].astype(np.int64)
            cut = np.r_[0, np.cumsum(per_doc)]
            sums = [np.diff(np.r_[0, np.cumsum(times * x[which] if len(which) else times)][cut]) for x in (best, count)]
            fields = [docs.field(i) for i in range(len(_DOC))]
            yield pa.record_batch([*fields, *[pa.array(s, pa.int64()) for s in sums]], names=[*[c for c, _ in _DOC], "n_best", "count_sum"])


def aligned_blocks(docs: DataFrame) -> DataFrame:
    """The blocks of doc_id and text, written to the shared folder."""
    ddl = f"block long, docs array<struct<{', '.join(f'{c}: {t}' for c, t in (x.split() for x in _DOC_DDL.split(', ')))}>>, pairs array<long>, in_docs array<long>, per_doc array<long>, links binary"
    return materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_blocks, ddl), "aligned-blocks")


def pair_counts(blocks: DataFrame, pieces: int) -> DataFrame:
    """Of each linked pair: pair (A id times ``pieces`` plus B id), documents that hold it linked, and whether no pair of its A id has more."""
    counts = blocks.select(F.explode(F.arrays_zip("pairs", "in_docs")).alias("p")).groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.in_docs").alias("documents"))
    # an A id has no more pairs than there are B ids
    return counts.withColumn("best", F.col("documents") == F.max("documents").over(Window.partitionBy(F.expr(f"pair div {pieces}"))))


def align(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum."""
    blocks = aligned_blocks(docs)
    spark = docs.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), blocks.select("block").count() // TASK_BLOCKS)
    asked = blocks.select("block", F.explode("pairs").alias("pair"))
    counted = asked.join(pair_counts(blocks, len(piece_vocabulary().pieces)), "pair").repartition(tasks, "block")
    counted = counted.groupBy("block").agg(F.collect_list(F.struct("pair", "documents", "best")).alias("counted"))
    back = blocks.select("block", "docs", "per_doc", "links").repartition(tasks, "block").join(counted, "block", "left")
    empty = F.array().cast("array<struct<pair: long, documents: long, best: boolean>>")
    return back.withColumn("counted", F.coalesce("counted", empty)).mapInArrow(_with_counts, _RESULT_DDL)


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"))
