"""Toxicity by compression distance.

Two zstandard dictionaries, one of ordinary and one of toxic text, compress each
window of WINDOW words; a window that the toxic one makes shorter is suspicious.
Labels mark whole documents, in which most words are ordinary.  So the text of
the dictionaries is chosen by document frequency: the ordinary dictionary holds
the commonest words of ordinary documents, the toxic one the same words (so that
ordinary text costs both the same) and then those words that toxic documents hold
far more often, strongest last, where matches are cheapest.  A ridge logistic
regression on the distribution of the length differences gives the calibrated
probability; it is fitted on rows that the dictionaries haven't seen.

Fitted on at most SAMPLE_ROWS labelled rows; the dictionaries' sizes are bounded;
scoring is one pass over whole texts, in batches of windows, without a shuffle.

Defined results: null and empty texts get the score of a text without windows; equal texts get equal
scores, however often they occur; a very long text is scored by all of its windows, a batch of them at a time;
an empty table gives an empty result;
with no labels, or labels of one kind only, all texts get that kind's smoothed
share; extra columns aren't touched.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from anchorline.llm.common import crc_mod, table
from anchorline.llm.labelled import apply_logistic, labelled_sample, logistic

SAMPLE_ROWS, WINDOW, ORDINARY_BYTES, TOXIC_BYTES, LEVEL, MIN_MATCH = 20_000, 8, 60_000, 24_000, 5, 3
#: A word is toxic evidence if its log odds and its log odds times the root of its toxic documents reach these.
LOG_ODDS, STRENGTH = 1.6, 7.0
STEPS = (2, 3, 4, 5, 6, 7, 9)
_OTHER = re.compile(r"[^\w]+")
BATCH_WINDOWS = 20_000


def plain_words(text: str) -> list[str]:
    return _OTHER.sub(" ", text.lower()).split()


def windows(text: str) -> list[bytes]:
    ws = plain_words(text)
    return [f" {' '.join(ws[k : k + WINDOW])} ".encode("utf-8", "replace") for k in range(0, len(ws), WINDOW)]


def compressor(content: str) -> zstandard.ZstdCompressor:
    data = content.encode()
    how = zstandard.ZstdCompressionParameters.from_level(LEVEL, source_size=200, dict_size=len(data), min_match=MIN_MATCH, write_checksum=0, write_content_size=0, write_dict_id=0)
    return zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=how)


def lengths(by: zstandard.ZstdCompressor, parts: list[bytes]) -> np.ndarray:
    size = np.fromiter(map(len, parts), np.uint64, len(parts))
    places = np.stack([np.cumsum(size) - size, size], 1)
    return np.array([len(x) for x in by.multi_compress_to_buffer(zstandard.BufferWithSegments(b"".join(parts), places.tobytes()))], np.int64)


def features(gains: np.ndarray) -> np.ndarray:
    """Of a document's length differences: the largest, and how many reach each step."""
    n = len(gains)
    top = np.sort(gains)[::-1]
    many = np.array([(gains >= s).sum() for s in STEPS], float)
    return np.r_[top[0] if n else 0, top[:3].sum(), np.log1p(n), many / np.sqrt(n + 1), np.log1p(many)]


class Meter:
    """Measures documents with both dictionaries."""

    def __init__(self, ordinary: str, toxic: str):
        self.ordinary, self.toxic = compressor(f" {ordinary} "), compressor(f" {ordinary} {toxic} ")

    def __call__(self, texts: list[str]) -> np.ndarray:
        rows: list[np.ndarray] = []
        parts: list[bytes] = []
        owners: list[int] = []

        def flush() -> None:
            gains = np.zeros(0, np.int64)
            for lo in range(0, len(parts), BATCH_WINDOWS):
                some = parts[lo : lo + BATCH_WINDOWS]
                gains = np.r_[gains, lengths(self.ordinary, some) - lengths(self.toxic, some)]
            at = 0
            for n in owners:
                rows.append(features(gains[at : at + n]))
                at += n
            parts.clear(), owners.clear()

        for t in texts:
            own = windows(t)
            parts.extend(own)
            owners.append(len(own))
            if len(parts) >= BATCH_WINDOWS:
                flush()
        flush()
        return np.array(rows).reshape(len(texts), -1)


def fit(docs: DataFrame, labels: DataFrame, label: str, learn: Column, limit: int = SAMPLE_ROWS) -> dict:
    sample = labelled_sample(docs, labels, label, learn, limit).withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(3)))
    n = {(r.y, r.tune): r.n for r in sample.groupBy("y", (F.col("part") == 0).alias("tune")).agg(F.count("*").alias("n")).collect()}
    tox, ordi, both = n.get((1, False), 0), n.get((0, False), 0), sum(n.values())
    share = (n.get((1, False), 0) + n.get((1, True), 0) + 1) / (both + 2)
    if not all(n.get((y, t), 0) for y in (0, 1) for t in (False, True)):
        return {"share": share}
    plain = F.filter(F.split(F.regexp_replace(F.lower("text"), r"(?U)[^\w]+", " "), " "), lambda w: w != "")
    words = sample.where("part <> 0").select("y", F.explode(F.array_distinct(plain)).alias("w"))
    df = words.groupBy("w").agg(F.sum("y").alias("t"), F.sum(1 - F.col("y")).alias("o"))
    odds = F.log((F.col("t") + 0.2) / (tox + 1)) - F.log((F.col("o") + 0.2) / (ordi + 1))
    df = df.withColumn("odds", odds).withColumn("z", odds * F.sqrt("t"))
    evidence = (F.col("t") >= 3) & (F.col("odds") > LOG_ODDS) & (F.col("z") >= STRENGTH)
    toxic = [r.w for r in df.where(evidence).orderBy(F.desc("z"), "w").limit(TOXIC_BYTES // 4).collect()]
    common = [r.w for r in df.where(~evidence & (F.length("w") > 3)).orderBy(F.desc("o"), "w").limit(ORDINARY_BYTES // 4).collect()]

    def upto(ws: list[str], size: int) -> str:
        out, used = [], 0
        for w in ws:
            used += len(w.encode()) + 1
            if used > size:
                break
            out.append(w)
        return " ".join(reversed(out))

    ordinary, poison = upto(common, ORDINARY_BYTES), upto(toxic, TOXIC_BYTES)

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        meter = Meter(ordinary, poison)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "y": pdf["y"], "x": list(meter(pdf["text"].tolist()))})

    got = sample.where("part = 0").select("doc_id", "y", "text").mapInPandas(measured, "doc_id long, y int, x array<double>").toPandas().sort_values("doc_id", kind="stable")
    return {"ordinary": ordinary, "toxic": poison, "calibration": logistic(np.stack(got["x"].to_list()), got["y"].to_numpy(float)), "share": share}


def score(docs: DataFrame, model: dict) -> DataFrame:
    """The rows of docs with their score."""
    kept = [f for f in docs.schema if f.name != "score"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        meter = Meter(model["ordinary"], model["toxic"]) if "calibration" in model else None
        for pdf in batches:
            texts = [t if isinstance(t, str) else "" for t in pdf["text"]]
            yield pdf.assign(score=apply_logistic(model["calibration"], meter(texts)) if meter else model["share"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", score double"
    return docs.select(*[f"`{f.name}`" for f in kept]).mapInPandas(run, schema)


def toxicity_scores(docs: DataFrame, labels: DataFrame, label: str = "toxic", limit: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of docs with held_out, score and predicted; learns from rows that aren't held out."""
    held = crc_mod(F.col("doc_id"), 4) == 2
    model = fit(docs, labels, label, ~held, limit)
    return score(docs, model).withColumn("held_out", held).withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity_scores(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")
