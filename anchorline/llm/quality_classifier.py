"""Quality classifier: random-indexing word vectors, pooled, and a two-layer network.

Random indexing: each word of the vocabulary has a sparse ternary index vector
made from its hash; its word vector is the sum of its neighbours' index vectors
over the sample (two words to each side), plus its own, at unit length.  Words that
the sample has once or not at all share an entry per shape (kinds of characters, length), which
those seen once train, so that every word of every text counts.  A document is the mean of its vectors,
the mean of the products of neighbouring vectors, and its length; a two-layer
numpy network turns it into a probability, calibrated by a temperature.

Fitted on at most ``SAMPLE_ROWS`` labelled rows, whose words bound the table that is broadcast;
scoring is one pass over whole texts without a shuffle.

Defined results: equal texts get equal scores, however often they occur; a very long text is a
piece of work of its own; null and empty texts get the score of a text without words;
with no labelled rows, or labels of one kind only, the score is that kind's
smoothed share; extra columns aren't touched.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from anchorline.llm.common import chunks, crc_mod, fmix, table, text_bytes, word_hashes
from anchorline.llm.labelled import apply_network, labelled_sample, train_network

SAMPLE_ROWS, DIM, NONZERO, CHUNK = 12_000, 48, 6, 1 << 18
SHAPES = 256

_KIND = np.full(256, 8, np.uint8)
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 1, 2, 4, 32
_KIND[[ord(c) for c in "#*$%&|<>"]] = 16


def _entries(data: np.ndarray, offsets: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The table entry of each word, and the words of each row."""
    h, per, start, length = word_hashes(data, offsets, lower=False)
    if not len(h):
        return np.zeros(0, np.int64), per
    at = np.minimum(np.searchsorted(known, h), max(len(known) - 1, 0))
    hit = known[at] == h if len(known) else np.zeros(len(h), bool)
    base = int(offsets[0])
    kinds = _KIND[data[base : int(offsets[-1])]]
    ends = np.stack([start - base, start - base + length], 1).ravel()
    if ends[-1] == len(kinds):
        ends = ends[:-1]
    kind = np.bitwise_or.reduceat(kinds, ends)[::2]
    shape = kind.astype(np.int64) % 64 * 4 + np.searchsorted([4, 8, 14], length, side="right")
    return np.where(hit, at, len(known) + shape), per


def _index_vectors(known: np.ndarray) -> np.ndarray:
    """The ternary index vector of each table entry; a few of its signs may meet."""
    keys = np.r_[known, fmix(np.arange(1, SHAPES + 1, dtype=np.uint64))]
    out = np.zeros((len(keys), DIM), np.int8)
    rows = np.arange(len(keys))
    for k in range(NONZERO):
        h = fmix(keys + np.uint64(0x9E3779B97F4A7C15 * (k + 1) % 2**64))
        out[rows, (h >> np.uint64(8)) % np.uint64(DIM)] += np.where(h & np.uint64(1), 1, -1).astype(np.int8)
    return out


def _each_chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, int, np.ndarray, np.ndarray]]:
    for b in batches:
        data, offsets = text_bytes(b.column("text"))
        for i, j in chunks(offsets, CHUNK):
            yield b, i, j, data, offsets[i : j + 1]


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for *_, data, cut in _each_chunk(batches):
        h, c = np.unique(word_hashes(data, cut, lower=False)[0], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.astype(np.int64))], ["h", "c"])


def _contexts(known: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index_vectors(known)
        total = np.zeros((len(index), DIM), np.float32)
        for *_, data, cut in _each_chunk(batches):
            e, per = _entries(data, cut, known)
            row = np.repeat(np.arange(len(per)), per)
            for step in (1, 2):
                same = np.flatnonzero(row[step:] == row[:-step])
                for a, b in ((e[same], e[same + step]), (e[same + step], e[same])):
                    by = np.argsort(a, kind="stable")
                    cuts = np.flatnonzero(np.r_[True, np.diff(a[by]) != 0]) if len(a) else by
                    if len(a):
                        total[a[by][cuts]] += np.add.reduceat(index[b[by]].astype(np.float32), cuts)
        used = np.flatnonzero(total.any(1))
        for lo in range(0, len(used), 20_000):
            yield _vectors(used[lo : lo + 20_000], total[used[lo : lo + 20_000]])

    return run


def _vectors(entries: np.ndarray, vectors: np.ndarray) -> pa.RecordBatch:
    """Entries with their vectors as bytes of 32-bit numbers."""
    cut = pa.py_buffer((np.arange(len(entries) + 1) * 4 * DIM).astype(np.int32))
    packed = pa.Array.from_buffers(pa.binary(), len(entries), [None, cut, pa.py_buffer(np.ascontiguousarray(vectors, np.float32))])
    return pa.RecordBatch.from_arrays([pa.array(entries), packed], ["e", "v"])


def _unpacked(column: pa.Array) -> np.ndarray:
    data, offsets = text_bytes(column)
    return data[offsets[0] : offsets[-1]].copy().view(np.float32).reshape(-1, DIM)


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One vector an entry: the sum of its rows, all of which are in this partition."""
    held = [(b.column("e").to_numpy(), _unpacked(b.column("v"))) for b in batches if b.num_rows]
    if held:
        e, which = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
        total = np.zeros((len(e), DIM))
        np.add.at(total, which, np.concatenate([v for _, v in held]))
        yield _vectors(e, total)


def _pool(known: np.ndarray, vectors: np.ndarray, data: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """A row's mean vector, mean product of neighbours, and log length."""
    e, per = _entries(data, cut, known)
    out = np.zeros((len(per), 2 * DIM + 1))
    full = np.flatnonzero(per)
    if len(full):
        v = vectors[e].astype(np.float32)
        start = (np.cumsum(per) - per)[full]
        out[full, :DIM] = np.add.reduceat(v, start) / per[full, None]
        p = np.zeros_like(v)
        p[:-1] = v[:-1] * v[1:]
        p[start + per[full] - 1] = 0
        out[full, DIM : 2 * DIM] = np.add.reduceat(p, start) / per[full, None] * DIM
    out[:, -1] = np.log1p(per)
    return out


def fit(docs: DataFrame, labels: DataFrame, label: str, learn: Column, limit: int = SAMPLE_ROWS) -> dict:
    sample = labelled_sample(docs, labels, label, learn, limit)
    texts = sample.select("text").coalesce(8)
    counts = texts.mapInArrow(_count_words, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).where("c > 1")
    known = np.sort(counts.select("h").toArrow()["h"].to_numpy().view(np.uint64))
    rows = texts.mapInArrow(_contexts(known), "e long, v binary").repartition("e").mapInArrow(_added, "e long, v binary").toArrow()
    vectors = _index_vectors(known).astype(np.float32)
    if rows.num_rows:
        for b in rows.to_batches():
            vectors[b.column("e").to_numpy()] += _unpacked(b.column("v"))
    vectors = (vectors / (np.linalg.norm(vectors, axis=1, keepdims=True) + 1e-9)).astype(np.float16)

    def pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, i, j, data, cut in _each_chunk(batches):
            yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i), b.column("y").slice(i, j - i), pa.array(list(_pool(known, vectors, data, cut)), pa.list_(pa.float64()))], ["doc_id", "y", "x"])

    got = sample.coalesce(8).mapInArrow(pooled, "doc_id long, y int, x array<double>").toPandas().sort_values("doc_id", kind="stable")
    y = got["y"].to_numpy(np.float64)
    if len(set(y.tolist())) < 2:
        return {"known": known, "vectors": vectors, "share": (y.sum() + 1) / (len(y) + 2)}
    return {"known": known, "vectors": vectors, "net": train_network(np.stack(got["x"].to_list()), y)}


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b, i, j, data, cut in _each_chunk(batches):
            p = apply_network(m["net"], _pool(m["known"], m["vectors"], data, cut)) if "net" in m else np.full(j - i, m["share"])
            yield pa.RecordBatch.from_arrays([*(b.column(k).slice(i, j - i) for k in range(b.num_columns)), pa.array(p)], [*b.schema.names, "score"])

    kept = [c for c in docs.columns if c != "score"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in kept) + ", score double"
    return docs.select(*[f"`{c}`" for c in kept]).mapInArrow(run, schema)


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality", limit: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of docs with held_out, score and predicted; learns from rows that aren't held out."""
    held = crc_mod(F.col("doc_id"), 3) == 1
    model = fit(docs, labels, label, ~held, limit)
    return score(docs, model).withColumn("held_out", held).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_scores(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")
