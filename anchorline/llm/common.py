"""Helpers shared by the corpus operators: word tokens, hashing, shared tables.

Words are maximal runs of bytes outside ``[\\x20\\x09-\\x0D]``.  The numpy
tokenizer works straight on Arrow buffers, so that no Python string is made
per word; everything is bounded by ``CHUNK_BYTES`` or by the longest text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from anchorline.storage import materialize  # noqa: F401

SPACE_CLASS = r"[\x20\x09-\x0D]+"
WORD_CLASS = r"[^\x20\x09-\x0D]+"
CHUNK_BYTES = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, *range(9, 14)]] = True
#: What a byte adds to its word's hash, as it is and lower-cased: nothing, if it is no letter.
_OWN, _LOWERED = (np.where(_IS_SPACE, 0, x.astype(np.uint64) + 1).astype(np.uint64) for x in (np.arange(256), _LOWER))
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text as an array; null for a null text."""
    return F.filter(F.split(text, SPACE_CLASS), lambda w: w != "")


def crc_mod(doc_id: Column, mod: int) -> Column:
    """crc32 of the id's decimal text, modulo ``mod``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod


def fmix(h: np.ndarray) -> np.ndarray:
    """The 64-bit finalizer of MurmurHash3."""
    h = h ^ (h >> _S33)
    h = h * _MIX1
    h ^= h >> _S33
    h *= _MIX2
    h ^= h >> _S33
    return h


_powers = np.ones(1, np.uint64)
#: Bytes that are weighed by their place among all of a call, not in their word: the powers that this takes are kept.
RUN = 1 << 18
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_inverses = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """The first n powers of the hash base."""
    global _powers
    if len(_powers) < n:
        m = 1 << max(8, int(n - 1).bit_length())
        p = np.full(m, _BASE, np.uint64)
        p[0] = 1
        _powers = np.multiply.accumulate(p)
    return _powers[:n]


def inverse_powers() -> np.ndarray:
    """What undoes the first RUN powers, modulo 2^64: the base is odd."""
    global _inverses
    if len(_inverses) < RUN:
        p = np.full(RUN, _INVERSE, np.uint64)
        p[0] = 1
        _inverses = np.multiply.accumulate(p)
    return _inverses


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string column; a null has no bytes."""
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.binary()) if column.nbytes < 2**31 - 1 else column
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``limit`` bytes, of one row at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hash of each word of the rows between ``offsets``, the number of words of each row, and each word's start and length in ``data``.

    ``lower`` lower-cases A-Z only.
    """
    base, end = int(offsets[0]), int(offsets[-1])
    b = data[base:end]
    none = np.zeros(0, np.int64)
    if not len(b):
        return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64), none, none
    solid = ~_IS_SPACE[b]
    first = np.empty(len(b) + 1, bool)
    first[0], first[-1] = True, True
    first[1:-1] = ~solid[:-1]
    cut = offsets - base
    first[cut] = True
    starts = np.flatnonzero(solid & first[:-1])
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64), none, none
    last = first[1:].copy()
    last[:-1] |= ~solid[1:]
    lens = np.flatnonzero(solid & last) + 1 - starts
    worth = _LOWERED if lower else _OWN
    if len(b) <= RUN:
        letters = worth[b]
        letters *= powers(RUN)[: len(b)]
        # from start to start: the spaces between add nothing
        sums = np.add.reduceat(letters, starts) * inverse_powers()[starts]
    else:
        letters = worth[b[solid]]
        at = np.cumsum(lens) - lens
        within = np.arange(len(letters), dtype=np.int64) - np.repeat(at, lens)
        letters *= powers(int(lens.max()))[within]
        sums = np.add.reduceat(letters, at)
    hashes = fmix(sums + lens.astype(np.uint64))
    per_row = np.diff(np.searchsorted(starts, cut))
    return hashes, per_row, starts + base, lens


class Places:
    """Where each of some distinct 64-bit keys stands in their sorted order.

    The keys' leading bits must be evenly spread (hashes), as they number the bucket that a search begins in; it takes one or two steps
    where a binary search takes one for each doubling.
    """

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(len(keys) - 1).bit_length() + 1)
        self.shift = np.uint64(64 - bits)
        # a search beyond the last key ends at one more
        self.padded = np.r_[np.sort(keys), np.uint64(2**64 - 1)]
        self.start = np.searchsorted(self.keys, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)

    @property
    def keys(self) -> np.ndarray:
        return self.padded[:-1]

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each key is there, and its place if it is."""
        at = self.start[keys >> self.shift]
        met = self.padded[at]
        todo = np.flatnonzero(met < keys)
        while len(todo):
            at[todo] += 1
            here = self.padded[at[todo]]
            met[todo] = here
            todo = todo[here < keys[todo]]
        hit = met == keys
        hit &= at < len(self.padded) - 1
        return hit, at


_LANES = np.array([(0x9E3779B97F4A7C15 * (2 * i + 3)) % 2**64 | 1 for i in range(64)], np.uint64)


def shingle_set(word: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles; shorter texts are one shingle, no word gives none."""
    m = len(word)
    if m == 0:
        return np.zeros(0, np.uint64)
    if m < n:
        h = word * _LANES[:m]
        return fmix(h.sum(keepdims=True, dtype=np.uint64) + np.uint64(m))
    h = word[: m - n + 1] * _LANES[0]
    for i in range(1, n):
        h = h + word[i : m - n + 1 + i] * _LANES[i]
    return np.unique(fmix(h))


def crc_text(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass"))
