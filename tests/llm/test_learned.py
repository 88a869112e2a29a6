import collections

import duckdb
import numpy as np
import pytest
from oracle import compare, connect
from postlens.llm import neighbours, quality_model as Q, substring_dedup as S
from postlens.llm.catalog import oracles, queries
from pyspark.sql import functions as F


@pytest.mark.parametrize("key", ["op1_near_dedup", "op3_line_dedup", "op10_vantage_point_search"])
def test_matches_oracle(spark, data, key):
    assert compare(spark, connect(data), data, queries()[key], oracles()[key]) is None


# nearest neighbours

def brute_nearest(vectors, asked, k):
    out = {}
    for one in asked:
        far = [(np.sqrt(((vectors[one] - v) ** 2).cumsum()[-1]), other) for other, v in vectors.items() if other != one and len(v) == len(vectors[one])]
        out[one] = sorted(far)[:k]
    return out


def frame(spark, vectors):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v]) for i, v in vectors.items()], "vec_id bigint, embedding array<double>")


def found(df):
    out = collections.defaultdict(list)
    for row in sorted(df.collect(), key=lambda r: r["rank"]):
        out[row["query_id"]].append((row["score"], row["vec_id"]))
    return dict(out)


@pytest.mark.parametrize("shard_rows, query_block", [(8192, 8192), (300, 5)])
def test_factor_one_is_exact(spark, shard_rows, query_block):
    draw = np.random.default_rng(5)
    centres = draw.normal(size=(12, 6)) * 4
    vectors = {i: centres[i % 12] + draw.normal(size=6) for i in range(1200)}
    vectors |= {2000 + i: vectors[0] for i in range(40)}  # ties
    df = neighbours.nearest(frame(spark, vectors), F.col("vec_id") % 100 == 0, shard_rows=shard_rows, query_block=query_block)
    want = brute_nearest(vectors, [i for i in vectors if i % 100 == 0], 10)
    got = found(df)
    assert {q: [i for _, i in x] for q, x in got.items()} == {q: [i for _, i in x] for q, x in want.items()}
    assert all(abs(a[0] - b[0]) < 1e-12 for q in want for a, b in zip(got[q], want[q]))


def test_relaxed_factor_keeps_most(spark, data):
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{data}/embeddings.parquet'").fetchall()
    vectors = {i: np.array(v, float) for i, v in rows}
    want = brute_nearest(vectors, [i for i in vectors if i % 100 == 0], 10)
    got = found(neighbours.nearest(frame(spark, vectors), F.col("vec_id") % 100 == 0, factor=1.05))
    hit = sum(len({i for _, i in want[q]} & {i for _, i in got[q]}) for q in want)
    assert hit >= 0.9 * sum(map(len, want.values()))


def test_pruning_happens_and_factor_prunes_more(monkeypatch):
    draw = np.random.default_rng(1)
    points = np.concatenate([draw.normal(size=(400, 3)) + 30 * c for c in range(8)])
    tree = neighbours.Tree(points, np.arange(len(points)))
    seen = []
    plain = neighbours.distances
    monkeypatch.setattr(neighbours, "distances", lambda q, p: (seen.append(len(q) * len(p)), plain(q, p))[1])
    work = []
    for factor in (1.0, 3.0):
        seen.clear()
        tree.search(points[:20], np.arange(20), 10, factor)
        work.append(sum(seen))
    assert work[1] < work[0] < 0.5 * 20 * len(points)


def test_vectors_that_take_no_part(spark):
    vectors = {0: [1.0, 0.0], 1: [1.0, 1.0], 2: None, 3: [0.0, 0.0], 5: [], 6: [float("nan"), 1.0], 7: [float("inf"), 1.0], 8: [1.0, 2.0, 3.0]}
    df = frame(spark, vectors).unionByName(spark.createDataFrame([(9, [1.0, None]), (None, [1.0, 1.0]), (1, [1.0, 1.0])], "vec_id bigint, embedding array<double>"))
    df = df.withColumns({"id": F.lit("x"), "vec": F.lit(None).cast("int"), "dim": F.lit(3)})
    got = found(neighbours.nearest(df, F.col("vec_id") < 100))
    assert got == {0: [(1.0, 1)], 1: [(1.0, 0)]}
    assert neighbours.nearest(df.limit(0), F.col("vec_id") < 100).count() == 0


# ordinal classifier

def test_fit_recovers_an_ordinal_rule():
    draw = np.random.default_rng(3)
    effect = draw.normal(size=40) * 1.5
    rows = [draw.choice(40, 8, replace=False) for _ in range(6000)]
    score = np.array([effect[r].sum() for r in rows]) + draw.logistic(size=len(rows))
    grades = (score > -1).astype(int) + (score > 2)
    model = Q.fit_ordinal(rows[:5000], grades[:5000], 3, 64)
    assert model.thresholds[0] < model.thresholds[1]
    tails = model.tails(np.array([model.weights[r].sum() for r in rows[5000:]]))
    assert (tails[:, 0] >= tails[:, 1]).all()
    expected = tails.sum(1)
    assert np.corrcoef(expected, grades[5000:])[0, 1] > 0.6
    assert np.corrcoef(model.weights[:40], effect)[0, 1] > 0.95


def test_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    grades = Q.grades_of(spark.read.parquet(f"{folder}/labels.parquet"))
    held = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    model = Q.train(docs, grades.where(~held))
    rows = Q.score(docs.join(grades.where(held), "doc_id"), model).select("grade", "kept", "expected_grade").collect()
    kept = [r["kept"] == (r["grade"] == 2) for r in rows]
    assert len(kept) > 80 and sum(kept) / len(kept) > 0.95
    by_grade = {g: np.mean([r["expected_grade"] for r in rows if r["grade"] == g]) for g in (0, 1, 2)}
    assert by_grade[0] < by_grade[2] and by_grade[1] < by_grade[2]


def test_scores_of_edges(edge, empty, spark):
    rating = spark.createDataFrame([(1, 2), (11, 0), (9, 1), (None, 1), (3, None), (12, 7)], "doc_id bigint, grade int")
    model = Q.train(edge, rating)
    got = {r["doc_id"]: r for r in Q.score(edge, model).collect()}
    assert len(got) == 20 and all(0 <= r["expected_grade"] <= 2 for r in got.values())
    assert not any(got[i]["kept"] for i in (4, 5, 6))
    none = Q.train(empty, rating)
    assert not none.weights.any() and Q.score(empty, none).count() == 0


def test_training_repeats(edge, spark):
    rating = spark.createDataFrame([(i, i % 3) for i in range(1, 21)], "doc_id bigint, grade int")
    first, second = Q.train(edge, rating), Q.train(edge.repartition(5), rating)
    assert (first.weights == second.weights).all() and (first.thresholds == second.thresholds).all()


# passages

def passage(name, n):
    return " ".join(f"{name}{i}" for i in range(n))


def test_passages_in_running_text(spark, empty):
    shared, other = passage("p", 60), passage("q", 70)
    near = shared.split()
    near[30] = "changed"
    texts = {
        1: f"{passage('a', 33)} {shared} {passage('b', 20)}", 2: f"{passage('c', 7)}\n{shared.upper()} {passage('d', 90)}",
        3: f"{other} {passage('e', 40)} {' '.join(near)}", 4: f"{passage('f', 200)} {other}", 5: passage("g", 300), 6: shared,
        7: None, 8: "", 9: passage("p", 30), 10: passage("h", 40) + " " + passage("h", 40),
    }
    docs = spark.createDataFrame([(i, t, None) for i, t in texts.items()], "doc_id bigint, text string, id string")
    rows = S.repeated_passages(docs).collect()
    by = collections.defaultdict(dict)
    for r in rows:
        by[r["passage_id"]][r["doc_id"]] = (r["start"], r["stop"], r["removed"])
    assert sorted(map(sorted, by.values())) == [[1, 2, 3, 6], [3, 4]]
    first, second = sorted(by.values(), key=len, reverse=True)
    assert first[1] == (33, 93, False) and first[2] == (7, 67, True) and first[6] == (0, 60, True) and first[3][2]
    assert second == {3: (0, 70, False), 4: (200, 270, True)}
    assert S.repeated_passages(empty).count() == 0


def test_every_long_repetition_is_found(spark, data, documents):
    n, seen, texts = 51, collections.defaultdict(set), {i: (t or "").encode().lower().split() for i, t in documents.items()}
    for i, own in texts.items():
        for j in range(len(own) - n + 1):
            seen[tuple(own[j:j + n])].add(i)
    want = {i for ids in seen.values() if len(ids) > 1 for i in ids}
    rows = queries()["op4_substring_dedup"](spark, data).collect()
    assert want <= {r["doc_id"] for r in rows}
    # what is removed stands in a smaller document
    assert all(any(o["passage_id"] == r["passage_id"] and o["doc_id"] < r["doc_id"] for o in rows) for r in rows if r["removed"])


def test_one_passage_in_very_many_documents(spark):
    shared = passage("z", 80)
    docs = spark.createDataFrame([(i, f"{passage(f'u{i}_', 15)} {shared}") for i in range(400)], "doc_id bigint, text string")
    rows = S.repeated_passages(docs).collect()
    assert {r["doc_id"] for r in rows if r["removed"]} == set(range(1, 400)) and {r["n_copies"] for r in rows} == {400}
