"""Toxicity from two Kneser-Ney models, one per class, that share their backoff counts.

An expression is a distinct word of a text. Per class, an expression's count is how many
documents of the class hold it; the discounted mass backs off to the word's stem (its
first characters), counted by the distinct words of the class that continue it, and what
is discounted there to the distinct words of *both* classes that continue the stem. Rare
expressions so rest on shared counts and tell the classes apart only through their stem.

A document is compared by the sum of its expressions' log-likelihood ratios over the
square root of their number, and a logistic curve turns that into a probability. Ratios
within ``dead_zone`` count as none: languages and topics are spread a little unevenly
over the classes, and in a long text such drift would add up to more than any expression
that stands out (held-out recall falls from 0.92 to 0.05 without it).

The curve is fitted on the learning rows, each compared without its own counts.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from postlens.llm.tokens import in_slices
from postlens.llm.words import few_rows
from postlens.operators.scaling import broadcast_if_small, fits
from postlens.session import written

WORD = re.compile(r"\w+")
CELL = 0.01
CELLS = 5000


@dataclass(frozen=True)
class Smoothing:
    """Settings of the two models.

    Up to ``broadcast_rows`` words that tell the classes apart are sent to every task;
    beyond that the words of the texts are joined with them, with the same result.
    ``label_rows`` bounds the labels that are broadcast; beyond it they are joined.
    """

    stem_chars: int = 7
    discount: float = 0.75
    dead_zone: float = 3.0
    broadcast_rows: int = 500_000
    label_rows: int = 1_000_000


@dataclass(frozen=True)
class Model:
    """``words(word, plain, less0, less1)`` and ``stems(word, plain)`` hold ratios beyond the dead zone.

    ``less0`` and ``less1`` are the ratios without one document of that class. Only what
    differs is listed: a word that is not takes its stem's ratio, and a stem that is not
    takes that of a stem never seen, ``unseen``.
    """

    words: DataFrame
    stems: DataFrame
    settings: Smoothing
    slope: float = 0.0
    intercept: float = 0.0
    unseen: float = 0.0


def expressions(text: str | None) -> set[str]:
    return set(WORD.findall(text.lower())) if text else set()


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents per word and class, summed within a slice of texts."""
    for batch in batches:
        classes = batch.column("_toxic").to_pylist()
        texts, at = [t or "" for t in batch.column("_text").to_pylist()], 0
        for part in in_slices(texts):
            found = Counter(), Counter()
            for text in part:
                found[classes[at]].update(expressions(text))
                at += 1
            for toxic, counts in enumerate(found):
                ones, none = pa.array(list(counts.values()), pa.int64()), pa.array([0] * len(counts), pa.int64())
                sums = (none, ones) if toxic else (ones, none)
                yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), *sums], ["word", "c0", "c1"])


def labelled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             label_col: str = "toxic", max_rows: int = 1_000_000) -> DataFrame:
    """``(_text, _toxic)`` of the documents with a label 0 or 1; of several labels the largest holds."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    known = known.groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_toxic"))
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return texts.join(broadcast_if_small(known, max_rows), "_id").select("_text", "_toxic")


def _ratios(counts: DataFrame, settings: Smoothing) -> Model:
    """The model without its curve."""
    d, zone = settings.discount, settings.dead_zone
    seen = written(counts.withColumn("stem", F.substr("word", F.lit(1), F.lit(settings.stem_chars))), "expressions")
    stems = written(seen.groupBy("stem").agg(
        F.count_if(F.col("c0") > 0).alias("k0"), F.count_if(F.col("c1") > 0).alias("k1"), F.count("*").alias("sh")), "stems")
    c = seen.agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"), F.count_if(F.col("c0") > 0).alias("n0"),
                 F.count_if(F.col("c1") > 0).alias("n1"), F.count("*").alias("types")).first()
    s = stems.agg(F.count_if(F.col("k0") > 0).alias("n0"), F.count_if(F.col("k1") > 0).alias("n1")).first()
    if not c["c0"] or not c["c1"]:
        nothing = stems.where(F.lit(False))
        return Model(nothing.selectExpr("stem AS word", "0D AS plain", "0D AS less0", "0D AS less1"),
                     nothing.selectExpr("stem AS word", "0D AS plain"), settings)
    spared = [d * c[f"n{y}"] / c[f"c{y}"] for y in (0, 1)]
    spared_stem = [d * s[f"n{y}"] / c[f"n{y}"] for y in (0, 1)]

    def beyond(x: Column) -> Column:
        return F.greatest(x - zone, F.lit(0.0)) - F.greatest(-x - zone, F.lit(0.0))

    def of_stem(y: int, k: Column, sh: Column) -> Column:
        return F.greatest(k - d, F.lit(0.0)) / c[f"n{y}"] + spared_stem[y] * (sh + 1) / (c["types"] + 1)

    def of_word(less: int | None) -> Column:
        count = [F.col(f"c{y}") - (1 if less == y else 0) for y in (0, 1)]
        # a word of that one document only is gone from its class, perhaps from both
        k = [F.col(f"k{y}") - (F.when(F.col(f"c{y}") == 1, 1).otherwise(0) if less == y else 0) for y in (0, 1)]
        gone = F.when(F.col("c0") + F.col("c1") == 1, 1).otherwise(0) if less is not None else F.lit(0)
        sh = F.col("sh") - gone
        p = [F.greatest(count[y] - d, F.lit(0.0)) / c[f"c{y}"] + spared[y] * of_stem(y, k[y], sh) / (sh + 1) for y in (0, 1)]
        full = F.log(p[1] / p[0])
        if less is None:
            return beyond(full)
        return beyond(F.when(gone == 1, F.log(of_stem(1, k[1], sh) / of_stem(0, k[0], sh))).otherwise(full))

    by_stem = stems.withColumn("plain", beyond(F.log(of_stem(1, F.col("k1"), F.col("sh")) / of_stem(0, F.col("k0"), F.col("sh")))))
    by_word = seen.join(by_stem.withColumnRenamed("plain", "_stem"), "stem").withColumns({
        "plain": of_word(None),
        "less0": F.when(F.col("c0") > 0, of_word(0)).otherwise(F.col("_stem")),
        "less1": F.when(F.col("c1") > 0, of_word(1)).otherwise(F.col("_stem")),
    })
    told = (F.col("plain") != F.col("_stem")) | (F.col("less0") != F.col("_stem")) | (F.col("less1") != F.col("_stem"))
    unseen = math.log(spared_stem[1] / spared_stem[0])
    unseen = max(unseen - zone, 0.0) - max(-unseen - zone, 0.0)
    return Model(
        written(by_word.where(told).select("word", "plain", "less0", "less1"), "word_ratios"),
        written(by_stem.where(F.col("plain") != unseen).select(F.col("stem").alias("word"), "plain"), "stem_ratios"),
        settings, unseen=unseen)


def _compared_here(text: Column, known: Column | None, model: Model) -> Column:
    """The comparison of a text inside its row, with the ratios broadcast."""
    listed = {r["word"]: (r["plain"], r["less0"], r["less1"]) for r in model.words.collect()}
    sent = model.words.sparkSession.sparkContext.broadcast((listed, {r["word"]: r["plain"] for r in model.stems.collect()}))
    length, unseen, mine = model.settings.stem_chars, model.unseen, known is not None

    @F.arrow_udf("double")
    def compare(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        listed, by_stem = sent.value
        for texts, classes in batches:
            out = []
            for text, own in zip(texts, classes):
                found, total = expressions(text.as_py()), []
                at = own.as_py() + 1 if mine else 0
                for word in found:
                    ratio = listed.get(word)
                    total.append(by_stem.get(word[:length], unseen) if ratio is None else ratio[at])
                out.append(round(math.fsum(total) / math.sqrt(len(found) + 1), 9))
            yield pa.array(out, pa.float64())

    return compare(text, known if mine else F.lit(0))


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(id, class, n, word)`` per expression; a text without any has one null word."""
    for batch in batches:
        ids, classes = batch.column("_n").to_pylist(), batch.column("_known").to_pylist()
        texts, at = [t or "" for t in batch.column("_text").to_pylist()], 0
        for part in in_slices(texts):
            rows = [[], [], [], []]
            for text in part:
                found = sorted(expressions(text)) or [None]
                n = 0 if found == [None] else len(found)
                for column, value in zip(rows, ([ids[at]] * len(found), [classes[at]] * len(found), [n] * len(found), found)):
                    column.extend(value)
                at += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int32(), pa.int64(), pa.string()))], ["_n", "_known", "n", "word"])


def _compared_by_join(rows: DataFrame, model: Model) -> DataFrame:
    """``(_n, x)`` of rows ``(_n, _text, _known)``; the ratios are joined, AQE splits frequent words."""
    spread = rows.mapInArrow(_spread, "_n bigint, _known int, n bigint, word string")
    spread = spread.withColumn("stem", F.substr("word", F.lit(1), F.lit(model.settings.stem_chars)))
    joined = spread.join(model.words, "word", "left").join(
        model.stems.select(F.col("word").alias("stem"), F.col("plain").alias("_stem")), "stem", "left")
    own = F.when(F.col("_known") == 0, F.col("less0")).when(F.col("_known") == 1, F.col("less1")).otherwise(F.col("plain"))
    ratio = F.when(F.col("word").isNull(), 0.0).otherwise(F.coalesce(own, F.col("_stem"), F.lit(model.unseen)))
    return joined.groupBy("_n", "n").agg(F.sum(ratio).alias("_s")).select(
        "_n", F.round(F.col("_s") / F.sqrt(F.col("n") + 1), 9).alias("x"))


def _with_comparison(df: DataFrame, text_col: str, known: str | None, model: Model, name: str) -> DataFrame:
    if all(fits(part, model.settings.broadcast_rows) for part in (model.words, model.stems)):
        own = F.col(known) if known else None
        return few_rows(df).withColumn(name, _compared_here(F.col(f"`{text_col}`"), own, model))
    # written, so that a row keeps its number whatever is computed again
    numbered = written(df.select(F.struct("*").alias("_all"), F.monotonically_increasing_id().alias("_n")), "numbered")
    label = F.col(f"_all.{known}").cast("int") if known else F.lit(None).cast("int")
    rows = numbered.select("_n", F.col(f"_all.`{text_col}`").alias("_text"), label.alias("_known"))
    found = _compared_by_join(rows, model).withColumnRenamed("x", name)
    return numbered.join(found, "_n").select("_all.*", name)


def fit_curve(values: np.ndarray, toxic: np.ndarray, weights: np.ndarray, ridge: float = 0.1) -> tuple[float, float]:
    """Slope (not negative) and intercept of a logistic curve, by Newton steps on weighted points."""
    rate = (weights @ toxic + 0.5) / (weights.sum() + 1.0)
    slope, intercept = 0.0, math.log(rate / (1 - rate))
    if not values.any() or not 0 < weights @ toxic < weights.sum():
        return slope, intercept
    scale = math.sqrt(weights @ values ** 2 / weights.sum())
    x = values / scale
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(slope * x + intercept, -30, 30)))
        off, curve = weights * (p - toxic), weights * p * (1 - p)
        gradient = np.array([off @ x + ridge * slope, off.sum()])
        hessian = np.array([[curve @ x ** 2 + ridge, curve @ x], [curve @ x, curve.sum() + 1e-9]])
        step = np.linalg.solve(hessian, gradient)
        step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        slope, intercept = slope - step[0], intercept - step[1]
        if np.abs(step).max() < 1e-10:
            break
    return max(slope, 0.0) / scale, intercept


def train(docs: DataFrame, labels: DataFrame, settings: Smoothing = Smoothing(), id_col: str = "doc_id",
          text_col: str = "text", label_col: str = "toxic") -> Model:
    """Both models from every labelled document, and the curve from the same documents.

    Without documents of both classes no expression tells them apart and every score is
    the rate of toxic ones, a half without any. The curve is fitted on the counts of the
    comparison's values in cells of 0.01 between -50 and 50: at most 20,002 rows reach the
    driver whatever the data.
    """
    known = written(labelled(few_rows(docs), labels, id_col, text_col, label_col, settings.label_rows), "labelled")
    counts = known.mapInArrow(_tables, "word string, c0 bigint, c1 bigint").groupBy("word").agg(
        F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))
    model = _ratios(counts, settings)
    compared = _with_comparison(known, "_text", "_toxic", model, "_x")
    cell = F.greatest(F.least(F.round(F.col("_x") / CELL), F.lit(CELLS)), F.lit(-CELLS))
    cells = compared.groupBy(cell.alias("x"), "_toxic").agg(F.count("*").alias("n")).collect()
    x, y, n = (np.array([r[i] for r in cells], float) for i in range(3))
    slope, intercept = fit_curve(x * CELL, y, n) if len(cells) else (0.0, 0.0)
    return replace(model, slope=slope, intercept=intercept)


def score(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.7, prefix: str = "") -> DataFrame:
    """``docs`` with ``score`` (0 to 1), ``predicted`` (1 from ``threshold`` on) and ``comparison``.

    Only the text is looked at, whatever its length. Null and empty texts have no
    expression, compare as 0 and take the curve's value there. Rows stay as they are,
    repeated ones and those without an id too; an empty table gives an empty one. Input
    columns with the names of added ones (after ``prefix``) are replaced.
    """
    name = f"{prefix}comparison"
    base = docs.drop(name)
    out = _with_comparison(base, text_col, None, model, name)
    probability = 1 / (1 + F.exp(-(F.lit(model.slope) * F.col(name) + F.lit(model.intercept))))
    return out.withColumns({f"{prefix}score": probability}).withColumn(
        f"{prefix}predicted", (F.col(f"{prefix}score") >= threshold).cast("int"))
