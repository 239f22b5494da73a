"""Brown class-based n-grams: exchange clustering, class transitions, word emissions.

Training counts every word of the training texts.  The FREQUENT commonest words are types of
their own, all other words are first grouped by their ending into SUFFIXES types; exchange clustering moves
one type at a time to the class that gains most mutual information of
neighbouring classes, until a sweep moves little.  Then every other word that the
training texts have LEAST times goes, by the same gain, to the class that its own neighbours' classes
choose (one shuffle brings a word's neighbours together), in REST_SWEEPS sweeps between which the class bigrams
are counted anew, and the transitions are counted with the classes of all words.  Rarer and unseen words keep
the class of their ending.  A text's probability is the
product, over its words and its end, of the smoothed transition from the class
before and the smoothed emission of the word in its class:

    log10 P = sum log10 T(c | c before) + log10 (n(w) + d) / (n(c) + d (v(c) + 1))

with n counts, v numbers of distinct words, d = 0.1 and one unseen word per class
that holds suffix types, so that each class sums to one.  The unigram
base score uses the same counts.

The counts and classes of all words stay a distributed table.  The HOT commonest ones, most
of all tokens, are broadcast (their number is a parameter) and settled where
the text is; each text's other words, with their places, meet the table in one
shuffle join, which has no hot key since the hot words aren't in it.  Bounded at every
size: the FREQUENT words and SUFFIXES endings whose bigrams the exchange itself
sees, the CONTEXT words with a class of their own in a neighbour's place, and the number of classes.

Words are compared by 64-bit hash.  Defined results: a null or empty text is its
end alone; repeated rows count and score as often as they occur; a very long text is
counted and scored whole, in chunks; with nothing to
learn from, all words are unseen; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from anchorline.llm.common import RUN, Places, chunks, crc_mod, fmix, materialize, table, text_bytes, word_hashes

FREQUENT, SUFFIXES, CLASSES, HOT = 2_048, 192, 48, 1 << 17
DELTA, PULL, SWEEPS = 0.1, 20.0, 6
#: Sweeps over all words that the exchange didn't have as types, and how often training must have a word for it to move: a single place in the texts
#: would choose the class by the very transitions that it is then scored by.  From the second sweep on, the CONTEXT commonest words stand in a
#: neighbour's place with the class of the sweep before, other words with that of their ending.
REST_SWEEPS, LEAST, CONTEXT = 2, 2, 1 << 17
#: Bytes of texts that are tokenised at a time, of one text at least: what a core keeps close.
READ = RUN
END = FREQUENT + SUFFIXES
TYPES = END + 1
#: Types from TYPES on: a word in the class of that number.  Codes of a word's neighbours: the class after, the class before, the word itself after.
BEFORE, SELF, CODES = CLASSES, 2 * CLASSES, 2 * CLASSES + 1
#: The largest count beside a packed code.
MOST = (1 << 24) - 1

_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)


def _suffix(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The suffix group of each word: by its last two bytes."""
    last = _LOWER[data[start + length - 1]]
    before = np.where(length > 1, _LOWER[data[start + np.maximum(length - 2, 0)]], np.uint64(0))
    return (fmix(last << np.uint64(8) | before) % np.uint64(SUFFIXES)).astype(np.int64)


def _each_chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        data, offsets = text_bytes(b.column("text"))
        for i, j in chunks(offsets, READ):
            h, per, start, length = word_hashes(data, offsets[i : j + 1], lower=True)
            yield b, i, j, h, per, _suffix(data, start, length) if len(h) else np.zeros(0, np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def flush() -> pa.RecordBatch:
        h, g, c = (np.concatenate(x) for x in zip(*held, strict=True))
        u, first, which = np.unique(h, return_index=True, return_inverse=True)
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(g[first].astype(np.int32)), pa.array(np.bincount(which, c).astype(np.int64))], ["h", "g", "c"])

    size = 0
    for *_, h, _per, g in _each_chunk(batches):
        u, first, c = np.unique(h, return_index=True, return_counts=True)
        held.append((u, g[first], c))
        size += len(u)
        if size > 1_500_000:
            yield flush()
            size = 0
    if held:
        yield flush()


class HotWords:
    """The commonest words: sorted hashes, counts, and types (-1: by suffix)."""

    def __init__(self, h: np.ndarray, c: np.ndarray, kind: np.ndarray | None = None):
        place = np.lexsort((h, -c))
        kind = np.full(len(h), -1, np.int64) if kind is None else kind.copy()
        kind[place[:FREQUENT]] = np.arange(min(FREQUENT, len(h)))
        by = np.argsort(h.view(np.uint64))
        self.places, self.c, self.kind = Places(h.view(np.uint64)), c[by], kind[by]

    @property
    def h(self) -> np.ndarray:
        return self.places.keys

    def find(self, h: np.ndarray, suffix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether each word is hot, its place, its type."""
        if not len(self.h) or not len(h):
            return np.zeros(len(h), bool), np.zeros(len(h), np.int64), FREQUENT + suffix
        hit, at = self.places.find(h)
        at = np.where(hit, at, 0)
        kind = np.where(hit, self.kind[at], -1)
        return hit, at, np.where(kind >= 0, kind, FREQUENT + suffix)


def _with_ends(kinds: np.ndarray, per: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Types with an end after each row's words, and each one's row."""
    ends = np.cumsum(per + 1) - 1
    out = np.full(int(per.sum()) + len(per), END, np.int64)
    place = np.ones(len(out), bool)
    place[ends] = False
    out[place] = kinds
    return out, np.repeat(np.arange(len(per)), per + 1)


def _bigrams(hot: HotWords) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(TYPES * TYPES, np.int64)
        for *_, h, per, g in _each_chunk(batches):
            t, _row = _with_ends(hot.find(h, g)[2], per)
            np.add.at(total, np.r_[END, t[:-1]] * TYPES + t, 1)
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total[cells])], ["cell", "c"])

    return run


def _class_bigrams(texts: DataFrame, hot: Broadcast, of: np.ndarray) -> np.ndarray:
    """How often each class follows each, with the classes that ``hot`` has for its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES * CLASSES, np.int64)
        for *_, h, per, g in _each_chunk(batches):
            c = of[_with_ends(hot.value.find(h, g)[2], per)[0]]
            total += np.bincount(np.r_[of[END], c[:-1]] * CLASSES + c, minlength=len(total))
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total[cells])], ["cell", "c"])

    cells = texts.mapInArrow(run, "cell long, c long").groupBy("cell").agg(F.sum("c").alias("c")).toArrow()
    big = np.zeros(CLASSES * CLASSES)
    big[cells["cell"].to_numpy()] = cells["c"].to_numpy()
    return big.reshape(CLASSES, CLASSES)


def _neighbours(hot: HotWords, of: np.ndarray) -> Callable:
    """Of each word that isn't frequent: its class and, packed, how often each code is beside it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # of hot words place and code in one number, of others hash, class and code
        met: list[np.ndarray] = []
        cold: list[tuple[np.ndarray, ...]] = []
        size = tokens = 0

        def rows(h: np.ndarray, a: np.ndarray, new: np.ndarray, code: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            """A row for each word, where a new one begins, of all its codes."""
            packed = (code.astype(np.uint32) << np.uint32(24)) | n.astype(np.uint32)
            cut = pa.py_buffer(np.r_[new, len(code)].astype(np.int32) * 4)
            lists = pa.Array.from_buffers(pa.binary(), len(new), [None, cut, pa.py_buffer(packed)])
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(a.astype(np.int32)), lists], ["h", "a", "near"])

        def flush() -> Iterator[pa.RecordBatch]:
            if met:
                key = np.concatenate(met)
                met.clear()
                key.sort()
                new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
                if len(key) > MOST:
                    # a count has 24 bits; more take another entry
                    new = np.unique(np.r_[new, np.arange(0, len(key), MOST)])
                place, code = np.divmod(key[new].astype(np.int64), CODES)
                word = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
                yield rows(hot.h[place[word]], of[hot_kind[place[word]]], word, code, np.diff(np.r_[new, len(key)]))
            if cold:
                h, a, code = (np.concatenate(x) for x in zip(*cold, strict=True))
                cold.clear()
                by = np.argsort(h)
                h = h[by]
                word = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
                yield rows(h[word], a[by[word]], word, code[by], np.ones(len(h)))

        hot_kind = hot.kind.copy()
        for *_, h, per, g in _each_chunk(batches):
            if not len(h):
                continue
            hit, place, kind = hot.find(h, g)
            # a hot word without a type of its own has that of its ending
            hot_kind[place[hit]] = kind[hit]
            t, _row = _with_ends(kind, per)
            word = t != END
            every, at = np.zeros(len(t), np.uint64), np.full(len(t), -1, np.int64)
            every[word], at[word] = h, np.where(hit, place, -1)
            same = np.r_[False, (every[1:] == every[:-1]) & word[1:] & word[:-1], False]
            c = of[t]
            rare = word & (t >= FREQUENT)
            after = np.flatnonzero(rare)
            ahead = np.flatnonzero(rare & ~same[:-1])
            where = np.r_[after, ahead]
            code = np.r_[np.where(same[after + 1], SELF, c[np.minimum(after + 1, len(c) - 1)]), BEFORE + np.where(ahead > 0, c[ahead - 1], of[END])]
            if not len(where):
                continue
            known = at[where] >= 0
            other = where[~known]
            if known.any():
                met.append((at[where[known]] * CODES + code[known]).astype(np.uint32))
            if len(other):
                cold.append((every[other], c[other].astype(np.uint8), code[~known].astype(np.uint8)))
            size += len(other)
            tokens += len(h)
            if size > 1_500_000 or tokens > 1 << 22:
                yield from flush()
                size = tokens = 0
        yield from flush()

    return run


def best_classes(big: np.ndarray, word: np.ndarray, code: np.ndarray, n: np.ndarray, a: np.ndarray) -> np.ndarray:
    """The class of most mutual information for each word, now in ``a``: ``exchange_classes``' gain from sparse neighbours.

    ``big`` has the class bigrams with all words; word (sorted), code and n say how often a word has a neighbour.
    """
    count, row = len(a), np.arange(len(a))
    full = np.zeros((count, CODES))
    full[word, code] = n
    r, left, self_ = full[:, :CLASSES], full[:, BEFORE:SELF], full[:, SELF]
    gain = np.zeros((count, CLASSES))
    for first, table_, other in ((0, big.T, left), (BEFORE, big, r)):
        e = np.flatnonzero((code >= first) & (code < first + CLASSES))
        w, j, c = word[e], code[e] - first, n[e].astype(float)
        base = table_[j]
        at = np.arange(len(e))
        base[at, a[w]] -= c
        own = j == a[w]
        base[own] -= other[w[own]]
        add = _xlogx(base + c[:, None]) - _xlogx(base)
        add[at, j] = 0
        if len(e):
            new = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
            gain[w[new]] += np.add.reduceat(add, new, axis=0)
    diag = np.repeat(np.diag(big)[None], count, 0)
    diag[row, a] -= r[row, a] + left[row, a] + self_
    gain += _xlogx(diag + r + left + self_[:, None]) - _xlogx(diag)
    for side, total in ((r, big.sum(1)), (left, big.sum(0))):
        own = (side.sum(1) + self_)[:, None]
        margin = np.repeat(total[None], count, 0)
        margin[row, a] -= own[:, 0]
        gain -= _xlogx(margin + own) - _xlogx(margin)
    best = np.argmax(gain[:, : CLASSES - 1], axis=1)
    return np.where(gain[row, best] > gain[row, a] + 1e-9, best, a)


def _assign(big: np.ndarray) -> Callable:
    """Of rows sorted by word: its count, and its class as a type."""

    def settle(h: np.ndarray, a: np.ndarray, per: np.ndarray, packed: np.ndarray) -> pa.RecordBatch:
        new = np.r_[True, h[1:] != h[:-1]]
        which = np.repeat(np.cumsum(new) - 1, per)
        key, at = np.unique(which * CODES + (packed >> np.uint32(24)).astype(np.int64), return_inverse=True)
        n = np.bincount(at, (packed & np.uint32(0xFFFFFF)).astype(float)).astype(np.int64)
        word, code = key // CODES, key % CODES
        count = np.bincount(word, np.where((code < BEFORE) | (code == SELF), n, 0), int(new.sum())).astype(np.int64)
        now = a[new].astype(np.int64)
        of = np.where(count >= LEAST, best_classes(big, word, code, n, now), now)
        return pa.RecordBatch.from_arrays([pa.array(h[new]), pa.array((TYPES - FREQUENT + of).astype(np.int32)), pa.array(count)], ["h", "g", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: tuple[np.ndarray, ...] | None = None
        for b in batches:
            if not b.num_rows:
                continue
            data, offsets = text_bytes(b.column("near"))
            now = (b.column("h").to_numpy(), b.column("a").to_numpy(), np.diff(offsets) // 4, data[offsets[0] : offsets[-1]].copy().view(np.uint32))
            h, a, per, packed = now if rest is None else (np.concatenate(x) for x in zip(rest, now, strict=True))
            # the last word may go on in the next batch
            k = int(np.argmax(h == h[-1]))
            cut = int(per[:k].sum())
            if k:
                yield settle(h[:k], a[:k], per[:k], packed[:cut])
            rest = (h[k:], a[k:], per[k:], packed[cut:])
        if rest is not None:
            yield settle(*rest)

    return run


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange_classes(n: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """The class of each type, for the type bigram counts ``n``; the last type (end) keeps the last class to itself."""
    size = n.sum(0) + n.sum(1)
    order = np.argsort(-size[:-1], kind="stable")
    k = classes - 1
    of = np.empty(len(n), np.int64)
    of[order] = np.arange(len(order)) % k
    of[-1] = k
    one = np.zeros((len(n), classes))
    one[np.arange(len(n)), of] = 1
    big = one.T @ n @ one
    for _ in range(sweeps):
        moved = 0
        for w in order:
            if not size[w]:
                continue
            a, self_ = of[w], n[w, w]
            one[w, a] = 0
            r, left = n[w] @ one, n[:, w] @ one
            big[a] -= r
            big[:, a] -= left
            big[a, a] -= self_
            # transitions to and from the type count in every class's margins, wherever it goes
            rows, cols = big.sum(1) + left, big.sum(0) + r
            row_gain = _xlogx(big + r) - _xlogx(big)
            col_gain = (_xlogx(big.T + left) - _xlogx(big.T)).sum(1)
            diag = np.diag(big)
            gain = row_gain.sum(1) - np.diag(row_gain) + col_gain - (_xlogx(diag + left) - _xlogx(diag)) + _xlogx(diag + r + left + self_) - _xlogx(diag)
            gain -= _xlogx(rows + r.sum() + self_) - _xlogx(rows) + _xlogx(cols + left.sum() + self_) - _xlogx(cols)
            b = int(np.argmax(gain[:k]))
            if gain[b] <= gain[a] + 1e-9:
                b = a
            moved += b != a
            of[w] = b
            one[w, b] = 1
            big[b] += r
            big[:, b] += left
            big[b, b] += self_
        if moved < len(order) // 200 + 1:
            break
    return of


def _words(docs: DataFrame) -> dict:
    """Counts and classes of the texts' words: ``counts`` is a table (h, g, c), g numbers the word's type from FREQUENT on; the rest is bounded."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    n_docs = docs.count()
    seen = materialize(texts.mapInArrow(_count, "h long, g int, c long").groupBy("h").agg(F.first("g").alias("g"), F.sum("c").alias("c")), "lm-counts")
    common = lambda df, n: df.orderBy(F.desc("c"), "h").limit(n).toArrow()
    top = common(seen, CONTEXT)
    hot = HotWords(top["h"].to_numpy(), top["c"].to_numpy())
    shared = spark.sparkContext.broadcast(hot)
    cells = texts.mapInArrow(lambda batches: _bigrams(shared.value)(batches), "cell long, c long").groupBy("cell").agg(F.sum("c").alias("c")).toArrow()
    n = np.zeros(TYPES * TYPES)
    n[cells["cell"].to_numpy()] = cells["c"].to_numpy()
    n = n.reshape(TYPES, TYPES)
    of = exchange_classes(n)
    one = np.zeros((TYPES, CLASSES))
    one[np.arange(TYPES), of] = 1
    big = one.T @ n @ one

    place = np.flatnonzero(hot.kind >= 0)
    frequent = [(h, TYPES - FREQUENT + int(of[k]), c) for h, k, c in zip(hot.h[place].view(np.int64).tolist(), hot.kind[place].tolist(), hot.c[place].tolist(), strict=True)]
    settled = spark.createDataFrame(frequent, "h long, g int, c long").coalesce(1)
    for sweep in range(REST_SWEEPS):
        if sweep:
            top = common(counts, CONTEXT)
            shared = spark.sparkContext.broadcast(HotWords(*(top[x].to_numpy() for x in "hc"), FREQUENT + top["g"].to_numpy().astype(np.int64)))
            big = _class_bigrams(texts, shared, of)
        near = texts.mapInArrow(lambda batches, shared=shared, of=of: _neighbours(shared.value, of)(batches), "h long, a int, near binary")
        rare = near.repartition("h").sortWithinPartitions("h").mapInArrow(_assign(big), "h long, g int, c long")
        counts = materialize(rare.unionByName(settled), "lm-words")
        of = np.r_[of[:TYPES], np.arange(CLASSES)]
    top = common(counts, HOT)
    hot = HotWords(top["h"].to_numpy(), top["c"].to_numpy(), FREQUENT + top["g"].to_numpy().astype(np.int64))

    per_g = counts.groupBy("g").agg(F.sum("c").alias("c"), F.count("*").alias("v")).toArrow()
    class_n, class_v = np.zeros(CLASSES), np.zeros(CLASSES)
    class_n[of[FREQUENT + per_g["g"].to_numpy()]] = per_g["c"].to_numpy()
    class_v[of[FREQUENT + per_g["g"].to_numpy()]] = per_g["v"].to_numpy()
    tokens, vocabulary = int(class_n.sum()) + n_docs, int(class_v.sum()) + (n_docs > 0)
    unseen = np.zeros(CLASSES)
    unseen[of[FREQUENT:END]] = 1
    share = np.log10(class_n + DELTA * (class_v + unseen) + 1e-300)
    share[of[END]] = 0.0
    return {"counts": counts, "hot": hot, "of": of, "share": share, "n_docs": n_docs, "tokens": tokens, "vocabulary": vocabulary}


def _classes(hot: HotWords, of: np.ndarray) -> Callable:
    """Of each text: its classes (of words that aren't hot, that of the ending), and its words that aren't hot with their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log_hot = np.log10(hot.c + DELTA)
        for b, i, j, h, per, g in _each_chunk(batches):
            hit, at, kind = hot.find(h, g)
            rows = np.repeat(np.arange(len(per)), per)
            t, _row = _with_ends(kind, per)
            warm = np.bincount(rows[hit], log_hot[at[hit]], len(per)) if hit.any() else np.zeros(len(per))
            known = np.bincount(rows[hit], minlength=len(per))
            ends = np.r_[0, np.cumsum(per + 1)].astype(np.int32)
            classes = pa.Array.from_buffers(pa.binary(), len(per), [None, pa.py_buffer(ends), pa.py_buffer(of[t].astype(np.uint8))])
            cold = np.flatnonzero(~hit)
            cut = np.searchsorted(rows[cold], np.arange(len(per) + 1)).astype(np.int32)
            first = np.cumsum(per) - per
            lists = [pa.ListArray.from_arrays(pa.array(cut), pa.array(v)) for v in (h[cold].view(np.int64), (cold - first[rows[cold]]).astype(np.int64))]
            own = [b.column(k).slice(i, j - i) for k in range(b.num_columns) if b.schema.names[k] != "text"]
            yield pa.RecordBatch.from_arrays([*own, pa.array(per + 1), pa.array(known.astype(np.int64)), pa.array(warm), pa.array(per - known), classes, *lists], [*(x for x in b.schema.names if x != "text"), "n_tokens", "known", "warm", "n_cold", "classes", "cold_h", "cold_at"])

    return run


def _sequences(docs: DataFrame, m: dict, keep: list[str]) -> DataFrame:
    """The kept columns of each row, its counts, its classes, and what the table of all words says of those that aren't hot (``met``: place * 64 + class)."""
    small = {k: m[k] for k in ("hot", "of")}
    shared = docs.sparkSession.sparkContext.broadcast(small)
    own = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*keep).schema)
    added = "n_tokens long, known long, warm double, n_cold long, classes binary, cold_h array<long>, cold_at array<long>"
    read = docs.select(*keep, F.coalesce("text", F.lit("")).alias("text"))
    each = materialize(read.mapInArrow(lambda batches: _classes(**shared.value)(batches), own + added).withColumn("row", F.monotonically_increasing_id()), "lm-texts")
    cold = each.select("row", F.explode(F.arrays_zip("cold_h", "cold_at")).alias("x")).select("row", F.col("x.cold_h").alias("h"), F.col("x.cold_at").alias("at"))
    place = F.col("at") * 64 + F.col("g") - (TYPES - FREQUENT)
    met = cold.join(m["counts"], "h").groupBy("row").agg(F.count("*").alias("cold_known"), F.sum(F.log10(F.col("c") + DELTA)).alias("cold_log"), F.collect_list(place).alias("met"))
    return each.drop("cold_h", "cold_at").join(met, "row", "left").drop("row").fillna({"cold_known": 0, "cold_log": 0.0})


def _filled(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Batches of ``_sequences`` with all their classes, and where the rows begin in these."""
    for b in batches:
        data, offsets = text_bytes(b.column("classes"))
        c = data[offsets[0] : offsets[-1]].astype(np.int64)
        cut = offsets - offsets[0]
        met = b.column("met")
        flat = met.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        if len(flat):
            c[np.repeat(cut[:-1], met.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)) + flat // 64] = flat % 64
        yield b, c, cut


def _transitions(sequences: DataFrame, m: dict) -> np.ndarray:
    """The smoothed log10 transitions between the classes of all words."""
    end = int(m["of"][END])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES * CLASSES, np.int64)
        for _, c, _cut in _filled(batches):
            total += np.bincount(np.r_[end, c[:-1]] * CLASSES + c, minlength=len(total)) if len(c) else 0
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total[cells])], ["cell", "c"])

    cells = sequences.select("classes", "met").mapInArrow(run, "cell long, c long").groupBy("cell").agg(F.sum("c").alias("c")).toArrow()
    big = np.zeros(CLASSES * CLASSES)
    big[cells["cell"].to_numpy()] = cells["c"].to_numpy()
    big = big.reshape(CLASSES, CLASSES)
    prior = (big.sum(0) + 1) / (big.sum() + CLASSES)
    return np.log10((big + PULL * prior) / (big.sum(1, keepdims=True) + PULL))


def train(docs: DataFrame) -> dict:
    """Counts and model of the texts: ``counts`` is a table (h, g, c), the rest is bounded."""
    m = _words(docs)
    return m | {"step": _transitions(_sequences(docs, m, []), m)}


def _scores(sequences: DataFrame, m: dict, keep: list[str]) -> DataFrame:
    of, step, share = m["of"], m["step"], m["share"]
    end_class = int(of[END])
    numbers = ("n_tokens", "known", "warm", "n_cold", "cold_known", "cold_log")

    def moves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, c, cut in _filled(batches):
            # every row has its end at least
            each = np.add.reduceat(step[np.r_[end_class, c[:-1]], c] - share[c], cut[:-1]) if len(c) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(b.column(x) for x in (*keep, *numbers)), pa.array(each)], [*keep, *numbers, "moves"])

    own = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in sequences.select(*keep).schema)
    got = sequences.select(*keep, *numbers, "classes", "met").mapInArrow(moves, own + "n_tokens long, known long, warm double, n_cold long, cold_known long, cold_log double, moves double")
    unseen = float(np.log10(DELTA))
    logs = F.col("warm") + F.col("cold_log") + (F.col("n_cold") - F.col("cold_known")) * unseen
    end = float(np.log10(m["n_docs"] + DELTA))
    per_token = float(np.log10(m["tokens"] + DELTA * (m["vocabulary"] + 1)))
    return got.select(
        *keep, "n_tokens", (F.col("known") + F.col("cold_known") + int(m["n_docs"] > 0)).cast("long").alias("n_known"), F.lit(m["tokens"]).cast("long").alias("train_tokens"),
        (logs + end - F.col("n_tokens") * per_token).alias("base_score"), (logs + F.col("moves")).alias("score"),
    ).withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def perplexity(docs: DataFrame, model: dict, keep: list[str]) -> DataFrame:
    """The kept columns of each row with n_tokens, n_known, train_tokens, base_score, score (log10) and perplexity."""
    return _scores(_sequences(docs, model, keep), model, keep)


def lm_scores(docs: DataFrame, held: Column) -> DataFrame:
    keep = ["doc_id", "held_out"]
    marked = docs.select("doc_id", "text", held.alias("held_out"))
    m = _words(marked.where(~F.col("held_out")))
    each = materialize(_sequences(marked, m, keep), "lm-classes")
    m["step"] = _transitions(each.where(~F.col("held_out")), m)
    return _scores(each, m, keep)


def op7_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"), crc_mod(F.col("doc_id"), 10) == 0)
