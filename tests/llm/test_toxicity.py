import dataclasses
import math
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from postlens.llm import toxicity as T
from postlens.llm.catalog import queries
from pyspark.sql import functions as F


def brute(texts, learn, smoothing):
    """{id: comparison} by plain dictionaries; ``learn`` maps ids to labels. Learning rows leave themselves out."""
    d, zone, stem = smoothing.discount, smoothing.dead_zone, lambda w: w[:smoothing.stem_chars]
    sets = {i: T.expressions(t) for i, t in texts.items()}
    c = [Counter(), Counter()]
    for i, y in learn.items():
        c[y].update(sets[i])
    k = [Counter(map(stem, x)) for x in c]
    shared = Counter(map(stem, c[0].keys() | c[1].keys()))
    total, types = [sum(x.values()) for x in c], [len(x) for x in c]
    every = len(c[0].keys() | c[1].keys())

    def ratio(word, own=None):
        count = [c[y][word] - (own == y) for y in (0, 1)]
        u = stem(word)
        cont = [k[y][u] - (own == y and count[y] == 0) for y in (0, 1)]
        sh = shared[u] - (own is not None and sum(count) == 0)
        low = [max(cont[y] - d, 0) / types[y] + d * len(k[y]) / types[y] * (sh + 1) / (every + 1) for y in (0, 1)]
        if sum(count) == 0:
            full = low
        else:
            full = [max(count[y] - d, 0) / total[y] + d * types[y] / total[y] * low[y] / (sh + 1) for y in (0, 1)]
        x = math.log(full[1] / full[0])
        return max(x - zone, 0) - max(-x - zone, 0)

    plain = {i: sum(map(ratio, s)) / math.sqrt(len(s) + 1) for i, s in sets.items()}
    less = {i: sum(ratio(w, y) for w in sets[i]) / math.sqrt(len(sets[i]) + 1) for i, y in learn.items()}
    return plain, less


def held(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


@pytest.fixture(scope="module")
def documents():
    return dict(duckdb.sql("SELECT doc_id, text FROM '/root/testdata/sf0.001/documents.parquet'").fetchall())


@pytest.fixture(scope="module")
def marks():
    return dict(duckdb.sql("SELECT doc_id, toxic FROM '/root/testdata/sf0.001/labels.parquet'").fetchall())


def test_query_against_brute_force(spark, data, documents, marks):
    learn = {i: y for i, y in marks.items() if i in documents and not held(i)}
    plain, less = brute(documents, learn, T.Smoothing())
    ids = sorted(learn)
    points = Counter((round(less[i] / T.CELL), learn[i]) for i in ids)
    slope, intercept = T.fit_curve(np.array([x * T.CELL for x, _ in points]), np.array([y for _, y in points], float),
                                   np.array(list(points.values()), float))
    rows = {r["doc_id"]: r for r in queries()["op11_toxicity"](spark, data).collect()}
    assert rows.keys() == documents.keys()
    for i, r in rows.items():
        assert r["held_out"] == held(i) and r["predicted"] == (r["score"] >= 0.7)
        assert r["comparison"] == pytest.approx(plain[i], abs=1e-6)
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-(slope * plain[i] + intercept))), abs=1e-3)


@pytest.mark.parametrize("zone", [0.0, 1.0])
def test_joined_ratios_give_the_same(spark, data, documents, marks, zone):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{data}/labels.parquet")
    near, far = T.Smoothing(dead_zone=zone), T.Smoothing(dead_zone=zone, broadcast_rows=1, label_rows=1)
    plain, _ = brute(documents, {i: y for i, y in marks.items() if i in documents}, near)
    first, second = T.train(docs, labels, near), T.train(docs, labels, far)
    assert (first.slope, first.intercept) == pytest.approx((second.slope, second.intercept), rel=1e-6)
    one, two = ({r["doc_id"]: r for r in T.score(docs, m).collect()} for m in (first, second))
    for i in documents:
        assert one[i]["comparison"] == pytest.approx(plain[i], abs=1e-6)
        assert two[i]["score"] == pytest.approx(one[i]["score"], abs=1e-6)


def test_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    rows = queries()["op11_toxicity"](spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out").collect()
    toxic, clean = ([r["predicted"] for r in rows if r["toxic"] == y] for y in (1, 0))
    assert np.mean(toxic) >= 0.75 and np.mean(clean) <= 0.01


def test_curve_rises_and_finds_its_points():
    draw = np.random.default_rng(1)
    x = draw.normal(size=4000) * 3
    y = (draw.random(4000) < 1 / (1 + np.exp(-(1.5 * x - 1)))).astype(float)
    slope, intercept = T.fit_curve(x, y, np.ones(4000))
    assert slope == pytest.approx(1.5, abs=0.15) and intercept == pytest.approx(-1, abs=0.15)
    assert T.fit_curve(x, 1 - y, np.ones(4000))[0] == 0.0


def test_edges(edge, odd_ids, empty, spark):
    marks = spark.createDataFrame(
        [(1, 0), (11, 1), (12, 1), (15, 0), (16, 0), (16, 1), (17, None), (None, 1), (9, 7), (4, 0), (5, 1)], "doc_id bigint, toxic int")
    model = T.train(edge, marks, T.Smoothing(dead_zone=0.0))
    got = {r["doc_id"]: r for r in T.score(edge, model).collect()}
    assert len(got) == 20 and all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in got.values())
    assert got[4]["comparison"] == got[5]["comparison"] == got[6]["comparison"] == 0.0
    assert got[2]["_id"] == "_id2" and got[3]["_id"] is None
    assert T.score(odd_ids, model).count() == 7 and T.score(empty, model).count() == 0
    clash = edge.select("doc_id", "text", F.lit("old").alias("score"), F.lit("kept").alias("_n"))
    for settings in (T.Smoothing(dead_zone=0.0), T.Smoothing(dead_zone=0.0, broadcast_rows=1)):
        again = T.score(clash, dataclasses.replace(model, settings=settings)).collect()
        assert {r["doc_id"]: r["score"] for r in again} == pytest.approx({i: r["score"] for i, r in got.items()}) and again[0]["_n"] == "kept"


@pytest.mark.parametrize("marks, rate", [([], 0.5), ([(1, 0), (11, 0), (15, 0)], 0.125), ([(1, 1)], 0.75)])
def test_one_class_or_none_gives_its_rate(edge, spark, marks, rate):
    model = T.train(edge, spark.createDataFrame(marks, "doc_id bigint, toxic int"))
    assert {round(r["score"], 6) for r in T.score(edge, model).collect()} == {rate}
