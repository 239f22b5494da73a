"""Bounded samples of labelled rows, and the small models that are fitted on the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anchorline.llm.common import materialize


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, limit: int) -> DataFrame:
    """doc_id, text, y of at most ``limit`` labelled rows for which ``learn`` (on doc_id) holds, one of each id and text.

    Which ones is decided by hashes of the id and the text.  Only ids with labels, and then ids with hashes of texts, at most
    ``limit`` of them, are broadcast; a null label or id teaches nothing.
    """
    ids = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).where(learn)
    ids = ids.groupBy("doc_id").agg(F.max(label).cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    text = F.coalesce("text", F.lit(""))
    found = materialize(docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("h")).join(F.broadcast(ids), "doc_id"), f"labelled-{label}")
    keys = found.select("doc_id", "h").distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "h").limit(limit)
    rows = found.join(F.broadcast(keys), ["doc_id", "h"]).groupBy("doc_id", "h").agg(F.first("text").alias("text"), F.first("y").alias("y"))
    return materialize(rows.select("doc_id", "text", "y"), f"sample-{label}")


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ridge logistic regression by Newton steps: weights (the last is the bias), mean and scale of the inputs."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    keep = np.r_[np.full(z.shape[1] - 1, ridge), 1e-6]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(keep)
        w = w - np.linalg.solve(h, z.T @ (p - y) + keep * w)
    return w, mean, scale


def apply_logistic(model: tuple[np.ndarray, np.ndarray, np.ndarray], x: np.ndarray) -> np.ndarray:
    w, mean, scale = model
    return 1 / (1 + np.exp(-np.clip(np.c_[(x - mean) / scale, np.ones(len(x))] @ w, -30, 30)))


def train_network(x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 60, seed: int = 3) -> dict:
    """Two layers (tanh, logistic) by Adam; a fifth of the rows sets the number of epochs and the temperature."""
    rng = np.random.default_rng(seed)
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = (x - mean) / scale
    order = rng.permutation(len(z))
    cut = max(1, len(z) // 5)
    va, tr = order[:cut], order[cut:] if len(z) > 5 else order
    par = [rng.standard_normal((z.shape[1], hidden)) / np.sqrt(z.shape[1]), np.zeros(hidden), rng.standard_normal(hidden) / np.sqrt(hidden), np.zeros(1)]
    m, v = [np.zeros_like(p) for p in par], [np.zeros_like(p) for p in par]
    logits = lambda q, p: np.tanh(q @ p[0] + p[1]) @ p[2] + p[3][0]
    loss = lambda t, s: float(np.mean(np.logaddexp(0, t) - s * t))
    best, kept, step = np.inf, [p.copy() for p in par], 0
    for _ in range(epochs):
        rng.shuffle(tr)
        for lo in range(0, len(tr), 64):
            i = tr[lo : lo + 64]
            a = np.tanh(z[i] @ par[0] + par[1])
            d = (1 / (1 + np.exp(-np.clip(a @ par[2] + par[3][0], -30, 30))) - y[i]) / len(i)
            back = d[:, None] * par[2] * (1 - a * a)
            step += 1
            for k, g in enumerate((z[i].T @ back + 1e-3 * par[0], back.sum(0), a.T @ d + 1e-3 * par[2], np.array([d.sum()]))):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                par[k] -= 0.003 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        if (now := loss(logits(z[va], par), y[va])) < best:
            best, kept = now, [p.copy() for p in par]
    held = logits(z[va], kept)
    temperature = min(np.geomspace(0.25, 8, 60), key=lambda t: loss(held / t, y[va]))
    return {"mean": mean, "scale": scale, "layers": kept, "temperature": float(temperature)}


def apply_network(net: dict, x: np.ndarray) -> np.ndarray:
    a, b, c, d = net["layers"]
    t = (np.tanh(((x - net["mean"]) / net["scale"]) @ a + b) @ c + d[0]) / net["temperature"]
    return 1 / (1 + np.exp(-np.clip(t, -30, 30)))
