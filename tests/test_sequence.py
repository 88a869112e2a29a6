"""The sequence network: gradient, learning, and its forward pass in SQL."""

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from postlens.plans import sequence as Q

SMALL = Q.Network(buckets=64, width=4, max_tokens=5, steps=60, rate=0.1)


def test_gradient_by_differences():
    draw = np.random.default_rng(0)
    rows = [draw.integers(0, 9, n) for n in (3, 1, 0, 5)]
    classes = np.array([0, 2, 1, 1])
    weights = [draw.normal(size=s) for s in ((9, 4), (4, 3), (3,))]
    whole = Q.gradient(rows, classes, *weights)
    assert whole[-1] == 4
    at = 0
    for part in weights:
        for i in np.ndindex(part.shape):
            was = part[i]
            part[i] = was + 1e-6
            up = Q.gradient(rows, classes, *weights)[-2]
            part[i] = was - 1e-6
            down = Q.gradient(rows, classes, *weights)[-2]
            part[i] = was
            assert whole[at] == pytest.approx((up - down) / 2e-6, abs=1e-5)
            at += 1


@pytest.fixture(scope="module")
def labelled(spark):
    words = {"cook": ["soup", "kitchen", "meal"], "drive": ["truck", "route", "road"], "teach": ["school", "lesson", "pupil"]}
    draw = np.random.default_rng(4)
    rows = [(i, " ".join(draw.choice(ws, 4)), label) for label, ws in words.items() for i in range(40)]
    rows += [(900, None, "cook"), (901, "soup", None)]
    return spark.createDataFrame(rows, "id int, text string, label string").repartition(5)


def test_learns_and_repeats(labelled):
    model = Q.train_sequence(labelled, settings=SMALL)
    got = Q.sequence_scores(labelled, model).where("label IS NOT NULL AND text IS NOT NULL").collect()
    assert np.mean([r["category"] == r["label"] for r in got]) == 1.0
    again = Q.train_sequence(labelled, settings=SMALL)
    assert np.allclose(model.embedding, again.embedding, atol=1e-9)
    assert model.labels == ("cook", "drive", "teach")


def test_only_the_first_words_count(labelled):
    model = Q.train_sequence(labelled, settings=SMALL)
    head = "soup kitchen meal soup meal"
    scored = Q.sequence_scores(labelled.sparkSession.createDataFrame([(1, head), (2, head + " truck" * 50), (3, ""), (4, None)], "id int, text string"), model)
    got = {r["id"]: r for r in scored.collect()}
    assert got[1]["confidence"] == got[2]["confidence"] and got[1]["category"] == "cook"
    assert got[3]["confidence"] == got[4]["confidence"]


def test_forward_pass_in_sql(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", F.col("lang").alias("label"))
    model = Q.train_sequence(docs, settings=Q.Network(buckets=256, width=4, steps=3))
    scored = {r["doc_id"]: r for r in Q.sequence_scores(docs, model).collect()}
    con = duckdb.connect()
    weights = Q.weight_table(spark, model).toPandas()
    words = [(r["doc_id"], int(b)) for r in docs.collect() for b in Q.word_buckets(r["text"], model.settings)]
    tokens = pd.DataFrame(words, columns=["doc_id", "bucket"])
    con.register("weights", weights)
    con.register("tokens", tokens)
    rows = con.execute("""
        WITH hidden AS (SELECT doc_id, unit, greatest(avg(value), 0) AS h FROM tokens JOIN weights ON part = 'embedding' AND place = bucket GROUP BY ALL),
        logits AS (SELECT doc_id, w.unit AS c, sum(h * w.value) + any_value(b.value) AS l FROM hidden JOIN weights w ON w.part = 'layer' AND w.place = hidden.unit
                   JOIN weights b ON b.part = 'bias' AND b.unit = w.unit GROUP BY ALL)
        SELECT doc_id, arg_max(c, l) AS best, 1 / sum(exp(l - m)) AS p FROM (SELECT *, max(l) OVER (PARTITION BY doc_id) AS m FROM logits) GROUP BY doc_id
    """).fetchall()
    assert len(rows) > 150
    for doc_id, best, p in rows:
        assert scored[doc_id]["category"] == model.labels[best] and scored[doc_id]["confidence"] == pytest.approx(p, abs=1e-9)


def test_held_out_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", F.col("lang").alias("label")).where("label IS NOT NULL")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    model = Q.train_sequence(docs.where(~held))
    got = Q.sequence_scores(docs.where(held), model).collect()
    assert np.mean([r["category"] == r["label"] for r in got]) > 0.9


def test_no_labelled_rows(labelled):
    with pytest.raises(ValueError):
        Q.train_sequence(labelled.where("id = 900"))


def test_large_batches_are_summed_in_parts():
    import pyarrow as pa

    column = pa.array([[1, 2], [], [3], [4, 5, 6]], pa.list_(pa.int32()))
    assert [r.tolist() for r in Q.held_rows(column)] == [[1, 2], [], [3], [4, 5, 6]]
    assert [r.tolist() for r in Q.held_rows(column.slice(1, 2))] == [[], [3]] and Q.held_rows(column.slice(0, 0)) == []
    batch = pa.RecordBatch.from_arrays([pa.array(range(2 * Q.PART_ROWS + 1))], names=["i"])
    assert [b.num_rows for b in Q._parts([batch])] == [Q.PART_ROWS, Q.PART_ROWS, 1]
