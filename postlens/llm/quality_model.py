"""Quality by ordinal regression on graded ratings (cumulative link).

One weight per hashed text feature is shared by all grades; ordered thresholds part
them: P(grade >= k) = logistic(score - threshold k). The expected grade and the tail
probability of the best grades follow for every document.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from postlens.llm.words import carried, few_rows, restored, texts_of

SHARES = (0.05, 0.15, 0.4, 0.7)


class WordFeatures(dict):
    """``(bucket of the word, shape)`` per distinct word, remembered up to ``limit`` words."""

    def __init__(self, buckets: int, limit: int = 300_000):
        self.buckets, self.limit = buckets, limit

    def __missing__(self, word: bytes) -> tuple[int, str]:
        lowered = word.lower().strip(b".,;:!?\"'()")
        shape, last = [], ""
        for c in word.decode("utf-8", "replace")[:64]:
            kind = "0" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c
            if kind != last:
                shape.append(kind)
            last = kind
        value = xxhash.xxh3_64_intdigest(lowered) % self.buckets, "".join(shape)[:12]
        if len(self) < self.limit:
            self[word] = value
        return value


def features(data: bytes, words: WordFeatures) -> np.ndarray:
    """Distinct feature buckets of a text: its words, word shapes by share, and repetition by share."""
    own = data.split()
    if not own:
        return np.empty(0, np.int64)
    found = [words[w] for w in own]
    out = {bucket for bucket, _ in found}
    n = len(own)
    marks = []
    shares = {f"shape {s}": c / n for s, c in Counter(s for _, s in found).items()}
    shares["again"] = sum(a == b for a, b in zip(own, own[1:])) / n
    shares["seen"] = 1 - len(set(own)) / n
    lines = [line for line in data.split(b"\n") if line.strip()]
    shares["lines"] = 1 - len(set(lines)) / max(1, len(lines))
    for name, share in shares.items():
        marks += [f"{name} {i}" for i, least in enumerate(SHARES) if share >= least]
    out.update(xxhash.xxh3_64_intdigest(m) % words.buckets for m in marks)
    return np.fromiter(out, np.int64, len(out))


@dataclass(frozen=True)
class OrdinalModel:
    weights: np.ndarray  # float32, one per bucket
    thresholds: np.ndarray  # rising, one less than grades

    @property
    def buckets(self) -> int:
        return len(self.weights)

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ... as columns."""
        return 1 / (1 + np.exp(self.thresholds[None, :] - scores[:, None]))


def association(flat: np.ndarray, of: np.ndarray, grades: np.ndarray, n_grades: int, buckets: int) -> np.ndarray:
    """Per feature, how many standard deviations its rows' share of better grades lies off that of all rows.

    The largest over the borders between grades, under sampling without replacement.
    """
    n, rows = np.bincount(flat, minlength=buckets), len(grades)
    most = np.zeros(buckets)
    for border in range(1, n_grades):
        better = (grades >= border).astype(float)
        share = better.mean()
        spread = np.sqrt(np.maximum(n * share * (1 - share) * (1 - n / rows), 1e-9))
        off = np.abs(np.bincount(flat, better[of], minlength=buckets) - n * share) / spread
        most = np.maximum(most, off)
    return most


def fit_ordinal(rows: list[np.ndarray], grades: np.ndarray, n_grades: int, buckets: int, min_docs: int = 3,
                least_association: float = 4.0, steps: int = 150, rate: float = 0.05,
                ridge: float = 1e-4) -> OrdinalModel:
    """Maximum likelihood of the cumulative-link model by full-batch Adam; repeatable.

    Most words say nothing of quality and would only be learnt by heart: features of
    fewer than ``min_docs`` rows or under ``least_association`` stay at weight 0.
    Without rows the weights are 0 and the thresholds evenly spread.
    """
    weights = np.zeros(buckets)
    low, gaps = -1.0, np.zeros(n_grades - 2)
    if not len(rows):
        return OrdinalModel(weights.astype(np.float32), low + np.concatenate([[0], np.cumsum(np.exp(gaps))]))
    flat = np.concatenate(rows)
    of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    seen = np.bincount(flat, minlength=buckets) >= min_docs
    seen &= association(flat, of, grades, n_grades, buckets) >= least_association
    flat, of = flat[seen[flat]], of[seen[flat]]
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -40, 40)))
    n = len(rows)
    state = [np.concatenate([weights, [low], gaps])] + [np.zeros(buckets + 1 + len(gaps)) for _ in range(2)]
    for step in range(1, steps + 1):
        w, low, gaps = state[0][:buckets], state[0][buckets], state[0][buckets + 1:]
        theta = low + np.concatenate([[0], np.cumsum(np.exp(gaps))])
        z = np.bincount(of, w[flat], minlength=n)
        edges = np.concatenate([[-40.0], theta, [40.0]])
        upper = sigmoid(edges[grades + 1] - z) * (grades < n_grades - 1) + (grades == n_grades - 1)
        lower = sigmoid(edges[grades] - z) * (grades > 0)
        chance = np.maximum(upper - lower, 1e-12)
        pull = (1 - upper - lower) / n  # minus the slope of the log-likelihood by z, per row
        slope_up = upper * (1 - upper) / chance / n
        slope_low = lower * (1 - lower) / chance / n
        by_theta = np.zeros(n_grades + 1)
        np.add.at(by_theta, grades + 1, -slope_up)
        np.add.at(by_theta, grades, slope_low)
        by_theta = by_theta[1:-1]
        after = np.cumsum(by_theta[::-1])[::-1]
        grad = np.concatenate([np.bincount(flat, pull[of], minlength=buckets) + ridge * w,
                               [after[0]], np.exp(gaps) * after[1:]])
        state[1] = 0.9 * state[1] + 0.1 * grad
        state[2] = 0.99 * state[2] + 0.01 * grad**2
        state[0] = state[0] - rate * (state[1] / (1 - 0.9**step)) / (np.sqrt(state[2] / (1 - 0.99**step)) + 1e-8)
    w, low, gaps = state[0][:buckets], state[0][buckets], state[0][buckets + 1:]
    return OrdinalModel(w.astype(np.float32), low + np.concatenate([[0], np.cumsum(np.exp(gaps))]))


def train(docs: DataFrame, ratings: DataFrame, n_grades: int = 3, id_col: str = "doc_id", text_col: str = "text",
          grade_col: str = "grade", buckets: int = 1 << 18, sample_rows: int = 20_000) -> OrdinalModel:
    """Fit on the ``sample_rows`` rated documents of smallest id hash: the documented bound.

    Only their feature numbers reach the driver, never texts. Rows with a null or
    impossible grade, or a null id, take no part.
    """
    rated = ratings.where(F.col(id_col).isNotNull() & F.col(grade_col).between(0, n_grades - 1))
    rated = rated.select(F.col(id_col).alias("_rated"), F.col(grade_col).cast("int").alias("_grade"))
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    # the choice needs ids only, so no text is sorted
    chosen = rated.join(texts.select("_id"), F.col("_rated") == F.col("_id"), "left_semi")
    chosen = chosen.orderBy(F.xxhash64("_rated"), "_rated", "_grade").limit(sample_rows)
    joined = texts.join(F.broadcast(chosen), F.col("_id") == F.col("_rated")).select("_text", "_grade")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordFeatures(buckets)
        for batch in batches:
            rows = [features(t or b"", words).astype(np.int32) for t in texts_of(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.int32())), batch.column(1)], names=["f", "g"])

    got = joined.mapInArrow(extract, "f array<int>, g int").toArrow()
    grades = np.array(got["g"].to_pylist(), np.int64)
    rows = [np.asarray(row.values.to_numpy(zero_copy_only=False), np.int64) for row in got["f"]]
    # the order of rows changes sums in their last digits, so it is fixed
    order = sorted(range(len(rows)), key=lambda i: (int(grades[i]), rows[i].tobytes()))
    return fit_ordinal([rows[i] for i in order], grades[order], n_grades, buckets)


def score(docs: DataFrame, model: OrdinalModel, text_col: str = "text", least_grade: int = 2,
          least_chance: float = 0.5, prefix: str = "") -> DataFrame:
    """``docs`` with ``expected_grade``, ``tail_probability`` of ``least_grade`` or better, and ``kept``.

    A null or empty text has no features and gets what the thresholds alone say; it
    is not kept. Rows are scored alone, so repeated rows agree and an empty table
    stays empty. An input column of an added column's name is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    shape = pa.struct([("grade", pa.float64()), ("tail", pa.float64()), ("text", pa.bool_())])

    @F.arrow_udf("struct<grade:double,tail:double,text:boolean>")
    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        fitted = shared.value
        words = WordFeatures(fitted.buckets)
        for batch in batches:
            rows = [features(t or b"", words) for t in texts_of(batch)]
            tails = fitted.tails(np.array([float(fitted.weights[r].astype(np.float64).sum()) for r in rows]))
            yield pa.StructArray.from_arrays(
                [pa.array(tails.sum(1)), pa.array(tails[:, least_grade - 1].copy()), pa.array([len(r) > 0 for r in rows])],
                fields=list(shape))

    judged = few_rows(docs).select(carried(docs), judge(F.col(text_col)).alias("_judged"))
    tail = F.col("_judged.tail")
    return restored(judged, docs.columns, {
        f"{prefix}expected_grade": F.col("_judged.grade"), f"{prefix}tail_probability": tail,
        f"{prefix}kept": (tail >= least_chance) & F.col("_judged.text"),
    })


def grades_of(labels: DataFrame) -> DataFrame:
    """Grade 0: toxic, 1: low quality, 2: good; one row per document, the lowest if labels disagree."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    return labels.groupBy("doc_id").agg(F.min(grade).alias("grade")).where("grade is not null")
