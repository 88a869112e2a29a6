"""Scoring texts against caller-given labels without a trained model.

Labels are indexed by term: a term's entry lists the labels it occurs in with their
weights. The index is broadcast after a check of its size, and a text adds up the entries
of its terms, so all label scores of a text arise in its row; no row per text and label is
ever formed. An index too large to send is cut by labels into parts, one pass each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from postlens.constants import CANDIDATE_LABELS, HYPOTHESIS_TEMPLATE
from postlens.functions import scores as S
from postlens.operators.scaling import fits
from postlens.operators.terms import counted_rows, repeats, term_counts, vocabulary, weigh, weigh_texts
from postlens.session import written

INDEX_ROWS = 1_000_000
PART_ROWS = 512  # texts whose terms a task holds as Python values


def label_table(spark: SparkSession, labels: Sequence[str] = CANDIDATE_LABELS,
                template: str = HYPOTHESIS_TEMPLATE) -> DataFrame:
    """``(label, text, place)`` with each label set into the hypothesis."""
    return spark.createDataFrame(
        [(x, template.format(x), i) for i, x in enumerate(labels)], "label string, text string, place int"
    )


def weighed_sides(texts: DataFrame, labels: DataFrame, key: str, label: str) -> tuple[DataFrame, DataFrame]:
    """``(key, terms)`` of the texts, only terms that labels have, and ``(label, term, w)``, both of unit length.

    Both sides are weighted by the vocabulary of the texts.
    """
    repeated = repeats(texts, key)
    counts = term_counts(texts, key) if repeated else counted_rows(texts, key)
    terms = vocabulary(counts, texts.agg(F.count("*").alias("n")))
    label_counts = term_counts(labels, label)
    raw = label_counts.join(terms, "term").withColumn("_w", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy(label)))
    index = written(raw.select(label, "term", (F.col("_w") / norm).alias("w")), "label_index")
    weights = (weigh(counts, terms, key) if repeated else weigh_texts(texts, terms, key)).select(key, "term", "tfidf")
    used = index.select("term").distinct()
    shared = weights.join(F.broadcast(used) if fits(used) else used, "term", "left_semi")
    # bounded by the terms of one text
    held = shared.groupBy(key).agg(F.collect_list(F.struct("term", "tfidf")).alias("_terms"))
    return written(held, "text_terms"), index


def _label_parts(index: DataFrame, label: str, names: list) -> Iterator[tuple[list, dict[str, tuple[np.ndarray, np.ndarray]]]]:
    """Runs of labels whose entries fit ``INDEX_ROWS``, with the index of their terms."""
    sizes = {r["l"]: r["n"] for r in index.groupBy(F.col(label).alias("l")).agg(F.count("*").alias("n")).collect()}
    part, size = [], 0
    runs = []
    for name in names:
        if part and size + sizes.get(name, 0) > INDEX_ROWS:
            runs.append(part)
            part, size = [], 0
        part.append(name)
        size += sizes.get(name, 0)
    runs.append(part)
    for run in runs:
        place = {name: i for i, name in enumerate(run)}
        own = index if len(runs) == 1 else index.where(F.col(label).isin(run))
        found: dict[str, list[tuple[int, float]]] = {}
        for r in own.collect():
            found.setdefault(r["term"], []).append((place[r[label]], r["w"]))
        yield run, {t: (np.array([i for i, _ in e]), np.array([w for _, w in e])) for t, e in found.items()}


def _adder(sent: Broadcast) -> Callable:
    """Sums of the entries of a text's terms, one per label, and which labels had any."""
    @F.arrow_udf("struct<c: array<double>, s: array<boolean>>")
    def add_up(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        count, entries = sent.value
        for batch in (b.slice(at, PART_ROWS) for b in batches for at in range(0, len(b), PART_ROWS)):
            cosines, shares = [], []
            for terms in batch.to_pylist():
                total, seen = np.zeros(count), np.zeros(count, bool)
                # in the order of terms, so that sums repeat
                for t in sorted(terms, key=lambda t: t["term"]):
                    if t["term"] in entries:
                        at, weight = entries[t["term"]]
                        total[at] += t["tfidf"] * weight
                        seen[at] = True
                cosines.append(np.round(total, 9).tolist())
                shares.append(seen.tolist())
            yield pa.StructArray.from_arrays([pa.array(cosines, pa.list_(pa.float64())), pa.array(shares, pa.list_(pa.bool_()))], ["c", "s"])

    return add_up


def label_cosines(texts: DataFrame, labels: DataFrame, key: str, label: str) -> tuple[DataFrame, list]:
    """``(key, cosines, shares)`` and the labels in order: per text an array of one score per label.

    ``shares`` tells which labels share a term with the text. Texts without such a term
    have no row. The labels are the caller's or a table's list; their number bounds an array.
    """
    names = sorted(r[label] for r in labels.select(label).distinct().collect())
    held, index = weighed_sides(texts, labels, key, label)
    parts = []
    for run, entries in _label_parts(index, label, names):
        sent = texts.sparkSession.sparkContext.broadcast((len(run), entries))
        parts.append(_adder(sent)("_terms"))
    scored = held.select(key, *[p.alias(f"_p{i}") for i, p in enumerate(parts)])
    both = lambda f: F.concat(*[F.col(f"_p{i}.{f}") for i in range(len(parts))])
    return scored.select(key, both("c").alias("cosines"), both("s").alias("shares")), names


def zero_shot_top(texts: DataFrame, labels: DataFrame, key: str, label: str) -> DataFrame:
    """``(key, label, confidence, shared)``: softmax over all labels, best one kept.

    Among labels that share a term the best cosine wins, ties go to the smallest label; a
    text that shares none gets the smallest label of all.
    """
    found, names = label_cosines(texts, labels, key, label)
    kind = labels.schema[label].dataType
    order = F.array(*[F.lit(x).cast(kind) for x in names])
    sharing = F.filter(F.transform("cosines", lambda c, i: F.struct((-c).alias("c"), i.alias("i"), F.get("shares", i).alias("s"))), lambda x: x["s"])
    best = found.select(key, F.array_min(sharing).alias("_b"), F.size(sharing).alias("_n"),
                        F.aggregate("cosines", F.lit(0.0), lambda a, c: a + F.exp(c)).alias("_z"))
    joined = texts.select(key).join(best, key, "left")
    return joined.select(
        key, F.get(order, F.coalesce("_b.i", F.lit(0))).alias(label),
        (F.exp(F.coalesce(-F.col("_b.c"), F.lit(0.0))) / F.coalesce("_z", F.lit(float(len(names))))).alias("confidence"),
        F.coalesce("_n", F.lit(0)).cast("bigint").alias("shared"),
    )


def zero_shot_predictions(texts: DataFrame, labels: Sequence[str], key: str,
                          template: str = HYPOTHESIS_TEMPLATE) -> DataFrame:
    """``texts`` with category, confidence and every label ranked, ties in the caller's order."""
    table = label_table(texts.sparkSession, labels, template)
    found, names = label_cosines(texts, table, key, "label")
    own = F.array(*[F.lit(x) for x in labels])
    order = [names.index(x) for x in labels]
    cosines = F.when(F.col("cosines").isNull(), F.array(*[F.lit(0.0)] * len(order))).otherwise(F.array(*[F.get("cosines", F.lit(i)) for i in order]))
    scored = texts.join(found, key, "left").withColumn("_p", S.prediction(own, S.softmax(cosines)))
    return scored.select(*texts.columns, "_p.*")
