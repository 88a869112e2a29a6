"""A small network over the first words of a text: hashed embeddings, their mean, one layer.

Each of the first ``max_tokens`` words picks a row of the embedding table by its hash; the
rows' mean, cut at zero, goes through a linear layer to one logit per label. Training is
full-batch: every step sends the weights to the tasks, each task adds up the gradient of
its rows, and the sums are added in a tree. Only weights and their gradient, of a size the
settings fix, pass the driver; the rows stay in the shared folder as word numbers.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from postlens.operators.sums import SUMS, part_sum, tree_sum
from postlens.plans.models import plugin_scores
from postlens.session import written

WORD = re.compile(r"\w{2,}")
PART_ROWS = 512  # texts held as numbers at once; a task's memory does not follow the batch


@dataclass(frozen=True)
class Network:
    """Settings of the network and its training; ``max_tokens`` is the fixed cut of the scorer."""

    buckets: int = 4096
    width: int = 16
    max_tokens: int = 512
    steps: int = 30
    rate: float = 0.05
    seed: int = 42


@dataclass(frozen=True)
class SequenceModel:
    labels: tuple[str, ...]
    settings: Network
    embedding: np.ndarray
    layer: np.ndarray
    bias: np.ndarray


def word_buckets(text: str | None, settings: Network) -> np.ndarray:
    """Buckets of the first words."""
    words = islice((m.group() for m in WORD.finditer((text or "").lower())), settings.max_tokens)
    return np.array([zlib.crc32(w.encode()) % settings.buckets for w in words], np.int64)


def forward(rows: list[np.ndarray], embedding: np.ndarray, layer: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(hidden, logits)``; a text without words has the bias alone."""
    sizes = np.array([len(r) for r in rows])
    means = np.zeros((len(rows), embedding.shape[1]))
    some = np.flatnonzero(sizes)
    if len(some):
        flat = np.concatenate([rows[i] for i in some])
        starts = np.cumsum(sizes[some]) - sizes[some]
        means[some] = np.add.reduceat(embedding[flat], starts, axis=0) / sizes[some, None]
    hidden = np.maximum(means, 0.0)
    return hidden, hidden @ layer + bias


def gradient(rows: list[np.ndarray], classes: np.ndarray, embedding: np.ndarray, layer: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Sums over rows: gradients of embedding, layer and bias, loss and row count, in one vector."""
    hidden, logits = forward(rows, embedding, layer, bias)
    shifted = np.exp(logits - logits.max(1, keepdims=True))
    share = shifted / shifted.sum(1, keepdims=True)
    loss = -np.log(np.maximum(share[np.arange(len(rows)), classes], 1e-300)).sum()
    share[np.arange(len(rows)), classes] -= 1.0
    inner = (share @ layer.T) * (hidden > 0)
    sizes = np.array([len(r) for r in rows])
    flat = np.concatenate(rows) if len(rows) else np.empty(0, np.int64)
    spread = np.repeat(inner / np.maximum(sizes, 1)[:, None], sizes, axis=0)
    table = np.stack([np.bincount(flat, spread[:, k], len(embedding)) for k in range(embedding.shape[1])], axis=1)
    return np.concatenate([table.ravel(), (hidden.T @ share).ravel(), share.sum(0), [loss, len(rows)]])


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, PART_ROWS):
            yield batch.slice(at, PART_ROWS)


def held_rows(words: pa.ListArray) -> list[np.ndarray]:
    """The rows of a list column as arrays, without a Python number per word."""
    ends = words.offsets.to_numpy()
    return np.split(words.flatten().to_numpy().astype(np.int64), ends[1:-1] - ends[0]) if len(words) else []


def _numbered(settings: Network) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            words = [word_buckets(t, settings).astype(np.int32) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.list_(pa.int32())), batch.column("y")], ["words", "y"])

    return run


def train_sequence(df: DataFrame, text: str = "text", label: str = "label", settings: Network = Network()) -> SequenceModel:
    """The network fitted on all rows with a text and a label, by Adam steps over gradient sums."""
    spark = df.sparkSession
    usable = df.where(F.col(text).isNotNull() & F.col(label).isNotNull()).select(F.col(text).alias("text"), F.col(label).cast("string").alias("label"))
    labels = tuple(r["label"] for r in usable.select("label").distinct().orderBy("label").collect())
    if not labels:
        raise ValueError("no rows with a text and a label")
    places = F.create_map(*[x for i, name in enumerate(labels) for x in (F.lit(name), F.lit(i))])
    rows = written(usable.select("text", places[F.col("label")].alias("y")).mapInArrow(_numbered(settings), "words array<int>, y int"), "sequences")

    draw = np.random.default_rng(settings.seed)
    shapes = [(settings.buckets, settings.width), (settings.width, len(labels)), (len(labels),)]
    sizes = [int(np.prod(s)) for s in shapes]
    weights = np.concatenate([draw.normal(size=sizes[0]) * 0.3, draw.normal(size=sizes[1]) * 0.3, np.zeros(sizes[2])])
    cut = lambda flat: [part.reshape(s) for part, s in zip(np.split(flat, np.cumsum(sizes)[:-1]), shapes)]
    parts = rows.rdd.getNumPartitions()
    first, second = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, settings.steps + 1):
        sent = spark.sparkContext.broadcast(weights)

        def add_up(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            now, total = cut(sent.value), None
            for batch in _parts(batches):
                sums = gradient(held_rows(batch.column("words")), batch.column("y").to_numpy(), *now)
                total = sums if total is None else total + sums
            if total is not None:
                yield part_sum(total)

        sums = tree_sum(rows.mapInArrow(add_up, SUMS), parts)
        sent.destroy()
        slope = sums[:-2] / sums[-1]
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope ** 2
        weights = weights - settings.rate * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.999 ** step)) + 1e-8)
    return SequenceModel(labels, settings, *cut(weights))


def sequence_scores(df: DataFrame, model: SequenceModel, text: str = "text") -> DataFrame:
    """Category, confidence and ranked predictions of every row, by the scorer hook.

    A null or empty text has the bias alone and gets the most likely label by it.
    """
    sent = df.sparkSession.sparkContext.broadcast((model.settings, model.embedding, model.layer, model.bias))

    def make() -> Callable:
        settings, *weights = sent.value
        return lambda texts: forward([word_buckets(t, settings) for t in texts], *weights)[1]

    return plugin_scores(df, model.labels, make, text)


def weight_table(spark: SparkSession, model: SequenceModel) -> DataFrame:
    """``(part, place, unit, value)``: embedding by bucket and unit, layer by unit and label, bias by label."""
    rows = [("embedding", int(b), int(k), float(v)) for (b, k), v in np.ndenumerate(model.embedding)]
    rows += [("layer", int(k), int(c), float(v)) for (k, c), v in np.ndenumerate(model.layer)]
    rows += [("bias", 0, int(c), float(v)) for (c,), v in np.ndenumerate(model.bias)]
    return spark.createDataFrame(rows, "part string, place int, unit int, value double")
