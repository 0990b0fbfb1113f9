"""Quality classifier: a byte-level convolutional network in numpy.

A document's UTF-8 bytes are cut into overlapping chunks that cover all of it.
Learned filters slide over each chunk, are max-pooled over its positions, and
a linear layer turns the pooled values into the chunk's logit; the mean of the
chunks' logits, weighed by their bytes, is the document's.

The model is fitted on the driver from a bounded sample: at most
``sample_per_label`` labelled documents of each label, at most
``sample_chunks`` chunks of each, among those with crc32(doc_id) mod 5 not 0.

Defined cases: a null text counts as empty, and an empty text scores as a
chunk of zero bytes; without labelled rows of both kinds every score is 0.5;
of rows that repeat a doc_id the sample has the least text, and of labels that
differ for one the lower; equal texts score alike; every chunk of a very long
text counts; an empty table gives no rows; extra columns are kept, but for
score and predicted, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FILTERS, WIDTH, CHUNK, OVERLAP = 8, 6, 512, 32
#: Documents of each label, and chunks of a document, in the sample the model is fitted on.
SAMPLE_PER_LABEL, SAMPLE_CHUNKS = 1500, 3
THRESHOLD = 0.3


@dataclass
class Model:
    taps: np.ndarray  # (WIDTH, 256, FILTERS)
    bias: np.ndarray
    out: np.ndarray
    out_bias: float


def chunks_of(data: np.ndarray, chunk: int = CHUNK, overlap: int = OVERLAP) -> np.ndarray:
    """Overlapping chunks that cover ``data``, zero-padded: (n, chunk)."""
    step = chunk - overlap
    n = max(1, -(-(len(data) - overlap) // step))
    padded = np.zeros((n - 1) * step + chunk, dtype=np.uint8)
    padded[: len(data)] = data
    return np.lib.stride_tricks.sliding_window_view(padded, chunk)[::step]


def pooled(taps: np.ndarray, x: np.ndarray, where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Max-pooled filter responses of chunks (n, FILTERS), and the positions they are from."""
    n = x.shape[1] - len(taps) + 1
    response = taps[0].take(x[:, :n], axis=0)
    for k in range(1, len(taps)):
        response += taps[k].take(x[:, k : k + n], axis=0)
    return response.max(axis=1), response.argmax(axis=1) if where else None


def fit(x: np.ndarray, y: np.ndarray, *, epochs: int = 12, batch: int = 64, rate: float = 0.05, seed: int = 5) -> Model | None:
    """Adam on the chunks' logistic loss, each label weighing the same. ``x``: (n, CHUNK) bytes."""
    if not len(y) or y.min() == y.max():
        return None
    rng = np.random.default_rng(seed)
    m = Model(rng.normal(0, 0.1, (WIDTH, 256, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), rng.normal(0, 0.3, FILTERS).astype(np.float32), 0.0)
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    grads = [np.zeros_like(m.taps), np.zeros_like(m.bias), np.zeros_like(m.out), np.zeros(1, np.float32)]
    first, second = [np.zeros_like(g) for g in grads], [np.zeros_like(g) for g in grads]
    t = 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), batch):
            rows = order[at : at + batch]
            xs = x[rows]
            top, place = pooled(m.taps, xs, where=True)
            hidden = np.maximum(top + m.bias, 0)
            p = 1 / (1 + np.exp(-np.clip(hidden @ m.out + m.out_bias, -30, 30)))
            d = ((p - y[rows]) * weight[rows] / len(rows)).astype(np.float32)
            dh = d[:, None] * m.out * (hidden > 0)
            for g in grads:
                g[...] = 0
            for w in range(WIDTH):
                np.add.at(grads[0][w], (np.take_along_axis(xs, place + w, axis=1), np.arange(FILTERS)[None, :]), dh)
            grads[1][:], grads[2][:], grads[3][0] = dh.sum(0), hidden.T @ d, d.sum()
            t += 1
            steps = []
            for g, a, b in zip(grads, first, second, strict=True):
                a *= 0.9
                a += 0.1 * g
                b *= 0.999
                b += 0.001 * g * g
                steps.append(rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-7))
            m.taps -= steps[0]
            m.bias -= steps[1]
            m.out -= steps[2]
            m.out_bias -= float(steps[3][0])
    return m


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, *, sample_per_label: int = SAMPLE_PER_LABEL, sample_chunks: int = SAMPLE_CHUNKS, epochs: int = 12) -> Model | None:
    """Fit the model on the bounded sample; the sampled ids are broadcast, at most 2 * ``sample_per_label``."""
    usable = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    sample = usable.filter("quality = 0").orderBy(*order).limit(sample_per_label).unionByName(usable.filter("quality = 1").orderBy(*order).limit(sample_per_label))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, quality, chunk = [], [], []
            for doc, q, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                every = chunks_of(np.frombuffer((text.as_py() or "").encode(), dtype=np.uint8))
                for k in np.unique(np.linspace(0, len(every) - 1, sample_chunks).round().astype(int)):
                    ids.append(doc), quality.append(q), chunk.append(every[k].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(quality, pa.int32()), pa.array(chunk, pa.binary())], names=["doc_id", "quality", "chunk"])

    rows = (
        docs.select("doc_id", "text")
        .join(F.broadcast(sample), "doc_id")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
        .agg(F.min("text").alias("text"))  # one row of an id that repeats, so that the sample stays within its bound
        .mapInArrow(cut, "doc_id long, quality int, chunk binary")
        .toPandas()
        .sort_values(["doc_id", "chunk"], ignore_index=True)
    )
    x = np.frombuffer(b"".join(bytes(c) for c in rows["chunk"]), dtype=np.uint8).reshape(-1, CHUNK)
    return fit(x, rows["quality"].to_numpy(), epochs=epochs)


def score_bytes(model: Model, data: np.ndarray, slab: int = 64) -> float:
    x = chunks_of(data)
    filled = np.full(len(x), CHUNK)
    filled[-1] = max(1, len(data) - (len(x) - 1) * (CHUNK - OVERLAP))
    total = 0.0
    for at in range(0, len(x), slab):
        top, _ = pooled(model.taps, x[at : at + slab])
        total += float((np.maximum(top + model.bias, 0) @ model.out + model.out_bias) @ filled[at : at + slab])
    return float(1 / (1 + np.exp(-np.clip(total / filled.sum(), -30, 30))))


def score(docs: DataFrame, model: Model | None, *, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` (of which ``text`` is used) with score and predicted; columns of these names are replaced."""
    docs = docs.drop("score", "predicted")
    spark, names, at = docs.sparkSession, docs.columns, docs.columns.index("text")
    if model is None:
        return docs.withColumns({"score": F.lit(0.5), "predicted": F.lit(1)})
    sent = spark.sparkContext.broadcast(model)  # a few hundred KB, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            scores = [score_bytes(own, np.frombuffer((t.as_py() or "").encode(), dtype=np.uint8)) for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*names, "score"])

    schema = T.StructType([*docs.schema, T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
