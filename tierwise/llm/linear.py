"""Shared frame of the trained text classifiers: bounded training rows, one training task, scoring."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import binary_texts, ids_of, prepare, releasing, texts_with_key, to_batch


def held_out(modulus: int, fold: int) -> Column:
    """Whether crc32 of the id as text falls into the held-out fold; a null id is held out."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(modulus)) == fold, F.lit(True))


#: Bytes of the texts that a model is fitted on, at most.
TRAIN_BYTES = 256 << 20


def training_rows(docs: DataFrame, labels: DataFrame, label: str, keep: Column, bound: int, most_bytes: int = TRAIN_BYTES) -> DataFrame:
    """(doc_id, text, y) of at most ``bound`` labelled ids, of each label the first half as many by hash; few enough to be broadcast.

    A row an id: of rows that share one the text that comes first. Texts are whole; by the ids' hash they are taken as long as all together
    have at most ``most_bytes``, so that what the one training task holds is bounded in rows and bytes.
    """
    ids = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).where(keep).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    first = lambda rows: rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound // 2)
    chosen = first(ids.where("y > 0")).unionByName(first(ids.where("y <= 0")))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    so_far = F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))  # ``bound`` rows at most
    return rows.withColumn("_bytes", so_far).where(F.col("_bytes") <= most_bytes).select("doc_id", "text", "y")


def train(rows: DataFrame, fit: Callable[[list[bytes], np.ndarray], dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    """Runs ``fit`` on the bounded training rows in one executor task; its arrays have a fixed size."""
    prepare(rows.sparkSession)
    schema = pa.schema([("name", pa.string()), ("value", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = []
        for b in batches:
            got += zip(ids_of(b), binary_texts(b), ids_of(b, "y"), strict=True)
        got.sort(key=lambda r: (r[0], r[1]))
        made = fit([r[1] for r in got], np.array([r[2] for r in got], np.float64))
        yield to_batch({"name": list(made), "value": [v.astype(np.float32).tobytes() for v in made.values()]}, schema)

    found = rows.select("doc_id", "text", "y").repartition(1).mapInArrow(releasing(run), "name string, value binary").collect()
    if not found:  # no rows, so no task ran
        return {k: v.astype(np.float32) for k, v in fit([], np.empty(0)).items()}
    return {r["name"]: np.frombuffer(r["value"], np.float32) for r in found}


def scored(docs: DataFrame, model: dict[str, np.ndarray], score: Callable[[dict, list[bytes]], list[float]], out: Column, threshold: float, *forget: Callable[[], None]) -> DataFrame:
    """doc_id, held_out, score, predicted, one row per input row."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield to_batch({"doc_id": ids_of(b), "score": score(shared.value, binary_texts(b))}, schema)

    judged = texts_with_key(docs).mapInArrow(releasing(run, *forget), "doc_id long, score double")
    return judged.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def shift(z: np.ndarray, y: np.ndarray, threshold: float = 0.7) -> float:
    """What to add to a model's bias so that ``threshold`` parts the training labels best.

    The cut is the middle of the widest gap among those with the best mean recall of both labels.
    """
    if not 0 < y.sum() < len(y):
        return 0.0
    order = np.argsort(z, kind="stable")
    z, y = z[order], y[order]
    recall = np.r_[0, np.cumsum(1 - y)] / (1 - y).sum() + 1 - np.r_[0, np.cumsum(y)] / y.sum()  # cut before the k-th
    edge = np.r_[z[0] - 1, z, z[-1] + 1]
    gap = np.diff(edge)
    best = np.flatnonzero((recall >= recall[gap > 0].max() - 1e-12) & (gap > 0))
    k = best[np.argmax(gap[best])]
    return float(np.log(threshold / (1 - threshold)) - (edge[k] + edge[k + 1]) / 2)


def calibrated(fit: Callable, margin: Callable[[np.ndarray, bytes], float], texts: list[bytes], y: np.ndarray) -> dict[str, np.ndarray]:
    """A model of all rows whose bias is shifted by what suits every third row under a model of the others."""
    third = np.arange(len(texts)) % 3 == 0
    part = fit([t for t, out in zip(texts, third, strict=True) if not out], y[~third])["w"]
    model = fit(texts, y)
    model["w"][-1] += shift(np.array([margin(part, t) for t, out in zip(texts, third, strict=True) if out]), y[third])
    return model


def sigmoid(z: float) -> float:
    return 1 / (1 + float(np.exp(-min(35.0, max(-35.0, z)))))
