"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A text becomes segments that no piece of the vocabulary can cross: a run of the
space mark with what follows it up to the next one, or a single symbol outside
the vocabulary.  A long segment is cut further wherever two characters stand side by side
that do so in no piece: no merge can cross such a place.  The distinct segments of a batch are encoded together: their
symbols stand in flat numpy arrays, each round finds every segment's best pair
(the smallest rank of the merged piece), merges it, and compacts the arrays; a
segment without a pair leaves the rounds.  All leftmost non-overlapping
occurrences of the best pair merge at once where that can't change the outcome
(no merged neighbour offers a better rank), else the leftmost alone.

What stays longer than LONG symbols (such as a letter repeated) and isn't done after
LONG_ROUNDS rounds goes on with an agenda: a heap of pairs over linked neighbours, in the
library's order, so that time grows with the length and its logarithm.

Each segment's ids are kept in a table per task that is bounded in characters, so that a
frequent word is encoded once in it.  Rounds, tables and batches are bounded by
parameters; a long text needs memory in proportion to itself only.

Defined results: a null or empty text has no ids and decodes to the empty text;
repeated rows repeat their results; other columns pass through, and those named
like a result are replaced.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from anchorline.llm.common import Places, table

MARK = "▁"
_NONE = np.int32(1 << 30)
#: Odd: it spreads the numbers of two pieces over all bits, and no two pairs alike.
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
#: Characters of segments that a task remembers (in either generation), symbols that one run of merge rounds takes, and characters of the texts that learn together.
REMEMBERED, BATCH_SYMBOLS, BATCH_TEXT = 2_000_000, 400_000, 1_000_000
#: Segments above CUT characters are cut at borders; those above LONG go to the agenda after LONG_ROUNDS rounds.
CUT, LONG, LONG_ROUNDS = 24, 256, 64


def piece_model() -> str:
    """The default model's path, on whichever machine this runs."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PieceCodec:
    """Encodes and decodes with the vocabulary of a SentencePiece BPE model with byte fallback."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or not model.trainer_spec.byte_fallback or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix or not spec.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("a BPE model with byte fallback, a dummy prefix and no normalization is needed")
        pieces = [(i, p.piece, p.score) for i, p in enumerate(model.pieces) if p.type == 1]
        if any(re.search(f"[^{MARK}]{MARK}", p) for _, p, _ in pieces) or any(p.type in (4, 5) for p in model.pieces):
            raise ValueError("pieces with inner space marks, user-defined or unused pieces aren't supported")
        ids = {p: i for i, p, _ in pieces}
        place = {score: r for r, score in enumerate(sorted({score for *_, score in pieces}, reverse=True))}
        # the last one is that of no piece (-1)
        self.rank = np.full(len(model.pieces) + 1, _NONE, np.int32)
        for i, p, score in pieces:
            if len(p) > 1:
                self.rank[i] = place[score]
        self.byte_id = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == 6}
        self.id_text = [str(i) for i in range(len(model.pieces))]
        self.text_of = [p.piece.replace(MARK, " ").encode() if p.type == 1 else bytes([int(p.piece[3:5], 16)]) if p.type == 6 else b"" for p in model.pieces]
        self.starts_marked = [p.type == 1 and p.piece.startswith(MARK) for p in model.pieces]
        self.single = {p: i for p, i in ids.items() if len(p) == 1}
        self.id_size, self.text_size = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.id_text, self.text_of))
        self.id_of_char = np.full(0x110000, -1, np.int32)
        for p, i in self.single.items():
            self.id_of_char[ord(p)] = i
        left, right, into = [], [], []
        for p, i in ids.items():
            for k in range(1, len(p)):
                a, b = ids.get(p[:k]), ids.get(p[k:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), into.append(i)
        keys = np.array(left, np.uint64) << np.uint64(32) | np.array(right, np.uint64)
        self.into: dict[int, int] = dict(zip(keys.tolist(), into, strict=True))
        spread = keys * _SPREAD
        self.pairs, self.pair_into = Places(spread), np.array(into, np.int32)[np.argsort(spread)]
        points = lambda c: np.frombuffer("".join(c).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        sides = {p[k : k + 2] for p in ids for k in range(len(p) - 1)}
        both = points(sorted(sides)).reshape(-1, 2)
        self.joined = np.unique(both[:, 0] << 21 | both[:, 1])
        inside = re.escape("".join(c for c in self.single if c != MARK))
        self.segments = re.compile(f"{MARK}*[{inside}]+|{MARK}+|.", re.S)
        #: Of a segment: its ids as text, and the bytes that they decode to. The old generation is asked before encoding anew.
        self.forget()

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The piece that each pair of neighbours makes, or -1."""
        hit, at = self.pairs.find((a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)) * _SPREAD)
        return np.where(hit, self.pair_into[np.where(hit, at, 0)], -1)

    def rounds(self, symbols: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merges until no segment has a pair left; symbols and owners of all segments, by owner.

        ``piece`` and ``rank`` say what each symbol makes with the next one of its segment; a round looks up only the pairs that its merges made.
        """
        symbols, owner = symbols.astype(np.int32), owner.astype(np.int32)
        done_s, done_o = [], []
        number = 0
        piece = np.full(len(symbols), -1, np.int32)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        piece[inner] = self.merged(symbols[inner], symbols[inner + 1])
        rank = self.rank[piece]
        while len(symbols):
            number += 1
            begin = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            length = np.diff(np.r_[begin, len(owner)])
            if number > LONG_ROUNDS and number % LONG_ROUNDS == 1:
                long = length > LONG
                if long.any():
                    for b, e in zip(begin[long].tolist(), (begin + length)[long].tolist(), strict=True):
                        out = self.agenda(symbols[b:e].tolist())
                        done_s.append(np.array(out, np.int32)), done_o.append(np.full(len(out), owner[b]))
                    stay = np.repeat(~long, length)
                    symbols, owner, piece, rank = symbols[stay], owner[stay], piece[stay], rank[stay]
                    continue
            best = np.minimum.reduceat(rank, begin)
            going = best < _NONE
            if not going.all():
                live = np.repeat(going, length)
                done_s.append(symbols[~live]), done_o.append(owner[~live])
                symbols, owner, piece, rank = symbols[live], owner[live], piece[live], rank[live]
                if not len(symbols):
                    break
                best, length = best[going], length[going]
            every = np.repeat(best, length)
            at = np.flatnonzero(rank == every)
            # in a run of overlapping occurrences, every second one counts, from the left
            run = np.r_[True, np.diff(at) != 1]
            if not run.all():
                place = np.arange(len(at)) - np.flatnonzero(run)[np.cumsum(run) - 1]
                at = at[place % 2 == 0]
            single = np.r_[True, owner[at[1:]] != owner[at[:-1]]]
            after = self.apply(symbols, owner, piece, rank, at)
            if not single.all():
                # several merges of a segment go together only if none makes a pair that beats them
                _, o, _, r, new, keep = after
                worse = new[r[new] <= every[keep][new]]
                if len(worse):
                    alone = ~single & np.isin(owner[at], o[worse])
                    if alone.any():
                        after = self.apply(symbols, owner, piece, rank, at[~alone])
            symbols, owner, piece, rank = after[:4]
        if not done_s:
            return symbols, owner
        s, o = np.concatenate(done_s), np.concatenate(done_o)
        by = np.argsort(o, kind="stable")
        return s[by], o[by]

    def agenda(self, symbols: list[int]) -> list[int]:
        """The same merges one by one: always the best rank, the leftmost first."""
        into, rank = self.into, self.rank
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, int, int]] = []

        def propose(i: int, j: int) -> None:
            piece = into.get(symbols[i] << 32 | symbols[j])
            if piece is not None and rank[piece] < _NONE:
                heapq.heappush(heap, (int(rank[piece]), i, symbols[i], symbols[j]))

        for i in range(n - 1):
            propose(i, i + 1)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != a or j >= n or symbols[j] != b:
                continue
            symbols[i], symbols[j] = into[a << 32 | b], -2
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                propose(i, k)
            if before[i] >= 0:
                propose(before[i], i)
        return [x for x in symbols if x != -2]

    def apply(self, symbols: np.ndarray, owner: np.ndarray, piece: np.ndarray, rank: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, ...]:
        """Symbols, owners, pieces and ranks after the chosen merges, the places of the pairs that these made, and which symbols stayed."""
        symbols, keep = symbols.copy(), np.ones(len(symbols), bool)
        symbols[chosen] = piece[chosen]
        keep[chosen + 1] = False
        symbols, owner, piece, rank = symbols[keep], owner[keep], piece[keep], rank[keep]
        made = np.zeros(len(symbols) + 1, bool)
        at = chosen - np.arange(len(chosen))
        made[at] = made[at - 1] = True
        # the place before the first symbol is the last one here
        new = np.flatnonzero(made[:-1])
        piece[new], rank[new] = -1, _NONE
        if len(new) and new[-1] == len(symbols) - 1:
            new = new[:-1]
        new = new[owner[new] == owner[new + 1]]
        piece[new] = into = self.merged(symbols[new], symbols[new + 1])
        rank[new] = self.rank[into]
        return symbols, owner, piece, rank, new, keep

    def learn(self, segments: list[str]) -> None:
        """Encodes new segments and remembers them."""
        at = 0
        while at < len(segments):
            total, end = 0, at
            while end < len(segments) and (end == at or total + len(segments[end]) <= BATCH_SYMBOLS):
                total += len(segments[end])
                end += 1
            part = segments[at:end]
            # a symbol outside the vocabulary stands alone in its segment; it gets -1
            flat = self.id_of_char[np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), np.uint32)]
            owner = np.repeat(np.arange(len(part)), np.fromiter(map(len, part), np.int64, len(part)))
            s, o = self.rounds(flat, owner)
            unknown = np.flatnonzero(s < 0)
            if len(unknown):
                spelt = [[self.byte_id[b] for b in part[k].encode("utf-8", "replace")] for k in o[unknown].tolist()]
                times = np.ones(len(s), np.int64)
                times[unknown] = list(map(len, spelt))
                s, o = np.repeat(s, times), np.repeat(o, times)
                s[s < 0] = [i for ids in spelt for i in ids]
            # all ids and all bytes are joined once, and each segment's are cut from these
            values = s.tolist()
            ids = ",".join(map(self.id_text.__getitem__, values))
            data = b"".join(map(self.text_of.__getitem__, values))
            cut = np.searchsorted(o, np.arange(len(part) + 1))
            for known, whole, size, gap in ((self.ids_of, ids, self.id_size, 1), (self.bytes_of, data, self.text_size, 0)):
                ends = np.r_[0, np.cumsum(size[s] + gap)][cut].tolist()
                known.update(zip(part, [whole[a : b - gap] for a, b in zip(ends, ends[1:])], strict=True))
            at = end

    def forget(self) -> None:
        """Begins with empty tables."""
        self.ids_of: dict[str, str] = {}
        self.bytes_of: dict[str, bytes] = {}
        self.old: tuple[dict[str, str], dict[str, bytes]] = ({}, {})
        self.held = 0

    def know(self, segments: set[str]) -> None:
        """Sees that all of these segments are in the table."""
        new = segments.difference(self.ids_of)
        size = sum(map(len, new))
        if self.held + size > REMEMBERED and self.ids_of:
            self.old = self.ids_of, self.bytes_of
            self.ids_of, self.bytes_of, self.held = {}, {}, 0
            new, size = segments, sum(map(len, segments))
        self.held += size
        ids, decoded = self.old
        again = new.intersection(ids) if ids else set()
        for s in again:
            self.ids_of[s], self.bytes_of[s] = ids[s], decoded[s]
        if len(again) < len(new):
            self.learn(list(new - again))

    def split(self, text: str) -> list[str]:
        found = self.segments.findall(MARK + text.replace(" ", MARK)) if text else []
        if len(found) and max(map(len, found)) > CUT:
            return [part for s in found for part in (self.cut(s) if len(s) > CUT else (s,))]
        return found

    def cut(self, segment: str) -> list[str]:
        """The parts of a segment between places that no piece has inside."""
        c = np.frombuffer(segment.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        key = c[:-1] << 21 | c[1:]
        at = np.minimum(np.searchsorted(self.joined, key), len(self.joined) - 1)
        ends = np.r_[0, np.flatnonzero(self.joined[at] != key) + 1, len(segment)].tolist()
        return [segment[a:b] for a, b in zip(ends, ends[1:])]

    def encode(self, text: str | None) -> list[int]:
        ids = self.summaries([text])[0][1]
        return [int(i) for i in ids.split(",")] if ids else []

    def decode(self, ids: Iterable[int]) -> str:
        ids = list(ids)
        data = b"".join(map(self.text_of.__getitem__, ids))
        if ids and self.starts_marked[ids[0]]:
            data = data[1:]
        return data.decode("utf-8", "replace")

    def summaries(self, texts: Iterable[str | None]) -> list[tuple[int, str, str]]:
        """Of each text: the number of its ids, the ids joined by commas, the decoded text.

        The first segment always bears the dummy prefix, which decoding drops.
        """
        out: list[tuple[int, str, str]] = []
        held: list[list[str]] = []
        size = 0

        def flush() -> None:
            self.know(set().union(*held))
            ids_of, bytes_of = self.ids_of.__getitem__, self.bytes_of.__getitem__
            for segments in held:
                ids = ",".join(map(ids_of, segments))
                out.append((ids.count(",") + 1 if ids else 0, ids, b"".join(map(bytes_of, segments))[1:].decode("utf-8", "replace")))
            held.clear()

        for text in texts:
            held.append(self.split(text or ""))
            size += len(text or "")
            if size > BATCH_TEXT:
                flush()
                size = 0
        flush()
        return out


@lru_cache(maxsize=2)
def codec(path: str) -> PieceCodec:
    return PieceCodec(path)


def encode_decode(docs: DataFrame, model: str | None = None, texts: bool = True) -> DataFrame:
    """Adds n_tokens, ids_sha256, decoded_sha256 and, with ``texts``, the ids (comma-joined) and the decoded text."""
    added = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"} | ({"ids": "string", "decoded": "string"} if texts else {})
    kept = [c for c in docs.columns if c not in added]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in kept), *(f"{k} {v}" for k, v in added.items())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = codec(model or piece_model())
        try:
            for pdf in batches:
                rows = []
                for n, ids, decoded in own.summaries([t if isinstance(t, str) else None for t in pdf["text"]]):
                    rows.append((n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode("utf-8", "replace")).hexdigest(), *((ids, decoded) if texts else ())))
                yield pd.concat([pdf[kept].reset_index(drop=True), pd.DataFrame(rows, columns=list(added))], axis=1)
        finally:
            # the worker goes on to other tasks, also of other stages
            own.forget()
            pa.default_memory_pool().release_unused()

    return docs.mapInPandas(run, schema)


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_decode(docs, texts=False).drop("text")
