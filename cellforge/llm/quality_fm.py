"""Quality classifier: a factorisation machine over hashed words, structure statistics and text metadata.

score = w0 + sum_i w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2], so all pairwise
interactions cost time linear in the features of a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, features
from . import textnum as tn

BITS = 16
RANK = 8
EPOCHS = 6
#: Labelled rows of each class that training draws at most (on average; drawn by a hash of the id).
SAMPLE = 3000
THRESHOLD = 0.3
FOLDS, HELD_OUT = 5, 0
_DENSE = len(features.STRUCTURE)


def _rows(data: np.ndarray, offs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(distinct word buckets, structure statistics) of each text."""
    for i, j in tn.chunks(offs):
        b, o = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        h, _, rows = features.normal_words(b, o)
        raw = b.tobytes()
        bucket = (h >> np.uint64(64 - BITS)).astype(np.int32)
        for r in range(j - i):
            own = slice(rows[r], rows[r + 1])
            yield np.unique(bucket[own]), features.structure(raw[o[r] : o[r + 1]], h[own])


def sample(docs: DataFrame, labels: DataFrame, label: str, train, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """About ``per_class`` training rows of each class, drawn by a hash of the id, with ``_y``; and the class sizes.

    ``train`` is the condition on the id. Rows of ``labels`` with nulls are ignored; of a repeated id
    the highest label counts.
    """
    lab = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & train).groupBy("doc_id").agg(F.max(label).cast("int").alias("_y"))
    sizes = {int(r["_y"]): int(r["n"]) for r in lab.where("_y in (0, 1)").groupBy("_y").agg(F.count("*").alias("n")).collect()}
    million = 1_000_000
    share = {y: min(million, million * per_class // n) for y, n in sizes.items()}
    draw = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(million))
    lab = lab.where(draw < F.when(F.col("_y") == 1, share.get(1, 0)).otherwise(share.get(0, 0)))
    return common.small_join(docs, lab, "doc_id", "inner"), sizes


def train(docs: DataFrame, labels: DataFrame, condition, label: str = "quality", seed: int = 5) -> dict:
    """The model, fit on the driver to a bounded sample of rows; features of their whole texts (at most
    2^BITS word buckets a text) are taken on the executors. Repeated documents train as often as they occur."""
    drawn, sizes = sample(docs.select("doc_id", "text"), labels, label, condition, SAMPLE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = tn.buffer(batch.column(0))
            got = list(_rows(data, offs))
            words = [w for w, _ in got]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(words, pa.list_(pa.int32())), pa.array([d for _, d in got], pa.list_(pa.float64())), batch.column(2)], names=["y", "words", "dense", "id"])

    rows = drawn.select("text", "_y", F.col("doc_id")).mapInArrow(run, "y int, words array<int>, dense array<double>, id long").collect()
    rows.sort(key=lambda r: (r["id"], r["y"], r["dense"], r["words"]))  # whatever the partitions, the same model
    return fit([(r["y"], np.asarray(r["words"], np.int64), np.asarray(r["dense"])) for r in rows], sizes, seed)


def fit(rows: list, sizes: dict[int, int], seed: int = 5) -> dict:
    rng = np.random.default_rng(seed)
    total = sum(sizes.values())
    prior = (sizes.get(1, 0) + 1) / (total + 2)
    base = {"prior": prior, "ok": False}
    if len({y for y, _, _ in rows}) < 2:
        return base
    dense = np.stack([d for _, _, d in rows])
    mean, dev = dense.mean(0), dense.std(0) + 1e-3
    dense = np.clip((dense - mean) / dev, -4, 4) / 4
    y = np.array([r[0] for r in rows], float)
    n_in = (1 << BITS) + _DENSE
    w, v = np.zeros(n_in), rng.normal(0, 0.02, (n_in, RANK))
    gw, gv, w0, g0 = np.full(n_in, 1e-2), np.full((n_in, RANK), 1e-2), 0.0, 1e-2
    rate, decay = 0.15, 1e-4
    dense_ids = np.arange(1 << BITS, n_in)
    balance = np.where(y == 1, 0.5 / max(1e-9, y.mean()), 0.5 / max(1e-9, 1 - y.mean()))
    for _ in range(EPOCHS):
        for r in rng.permutation(len(rows)):
            words = rows[r][1]
            if rng.random() < 0.5:  # half of the steps see structure only, so that it must do alone
                words = words[:0]
            ids = np.concatenate([words, dense_ids])
            x = np.concatenate([np.full(len(words), 0.5 / np.sqrt(max(1, len(words)))), dense[r]])
            vx = v[ids] * x[:, None]
            s = vx.sum(0)
            z = w0 + w[ids] @ x + 0.5 * (s @ s - (vx * vx).sum())
            err = balance[r] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[r])
            d = err * x + decay * w[ids]
            gw[ids] += d * d
            w[ids] -= rate * d / np.sqrt(gw[ids])
            dv = err * (x[:, None] * s - vx * x[:, None]) + decay * v[ids]
            gv[ids] += dv * dv
            v[ids] -= rate * dv / np.sqrt(gv[ids])
            g0 += err * err
            w0 -= rate * err / np.sqrt(g0)
    # trained on balanced classes: shift to the classes' true shares
    w0 += np.log(prior / (1 - prior))
    return base | {"ok": True, "w0": w0, "w": w.astype(np.float32), "v": v.astype(np.float32), "mean": mean, "dev": dev}


def margins(model: dict, words: list[np.ndarray], dense: np.ndarray) -> np.ndarray:
    """The machine's output for many texts at once, by the sum-of-squares identity."""
    x = np.clip((dense - model["mean"]) / model["dev"], -4, 4) / 4
    n = np.array([len(a) for a in words])
    ids = np.concatenate(words) if n.sum() else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(words)), n)
    scale = 0.5 / np.sqrt(np.maximum(1, n))
    wd, vd = model["w"][1 << BITS :].astype(float), model["v"][1 << BITS :].astype(float)
    linear = x @ wd + np.bincount(row, model["w"][ids], len(words)) * scale
    s, sq = x @ vd, (x * x) @ (vd * vd).sum(1)
    v = model["v"][ids]
    for f in range(RANK):
        s[:, f] += np.bincount(row, v[:, f], len(words)) * scale
    sq += np.bincount(row, (v * v).sum(1), len(words)) * scale * scale
    return model["w0"] + linear + 0.5 * ((s * s).sum(1) - sq)


def score(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """The documents, without the text, with ``score`` in [0, 1]. Whole texts; a null text is an empty one.

    Without labels of both classes the score is the (smoothed) share of label 1. Extra columns pass
    through, unless one is called score. Equal texts have equal scores.
    """
    named = (text_col,)
    out = common.unstash(docs, ["score", text_col], named)
    docs, _ = common.stash(docs, named)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # of fixed size: 2^BITS * (RANK + 1) floats
    at = 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            if m["ok"] and batch.num_rows:
                data, offs = tn.buffer(batch.column(at))
                got = list(_rows(data, offs))
                z = margins(m, [w for w, _ in got], np.stack([d for _, d in got]))
                p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            else:
                p = np.full(batch.num_rows, m["prior"])
            keep = [n for n in range(batch.num_columns) if n != at]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in keep] + [pa.array(p)], names=[batch.schema.names[n] for n in keep] + ["score"])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema.fields[1:])
    return docs.mapInArrow(run, f"{schema}score double").select(*out, "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    fold = common.crc_fold(FOLDS)
    model = train(docs, common.table(spark, sf_dir, "labels"), fold != HELD_OUT)
    out = score(docs, model)
    return out.select("doc_id", F.coalesce(fold == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
