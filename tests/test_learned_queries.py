"""The learned queries' real values: reports and importances recomputed in SQL, levels from their centres."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from postlens.operators import clusters, counts
from postlens.plans import catalog, catalog_learn, models, trees


@pytest.fixture(scope="module")
def forest(spark, data):
    train, _ = catalog_learn.split_texts(spark, data)
    return models.train_forest(counts.with_class_weights(train, "label"), config=models.BIGRAMS_5000, trees=15, max_depth=10, weight="weight")


@pytest.fixture
def small_forests(monkeypatch, forest):
    """The queries with fewer and shallower trees."""
    whole = models.train_forest
    monkeypatch.setattr(catalog_learn, "language_forest", lambda spark, d: forest)
    monkeypatch.setattr(catalog_learn, "scam_forest", lambda spark, d: whole(
        catalog_learn.toxic_texts(spark, d), config=models.UNIGRAMS_1000, trees=10, max_depth=6))


def run(spark, data, key):
    return catalog.queries()[key](spark, data)


@pytest.mark.parametrize("key", ["train_rf", "train_lr"])
def test_report_follows_from_predictions(spark, data, small_forests, forest, key):
    report = {r["label"]: r for r in run(spark, data, key).collect()}
    _, test = catalog_learn.split_texts(spark, data)
    model = forest if key == "train_rf" else catalog_learn.language_regression(spark, data)
    rows = models.classify_postings(test, model).select("label", "category").toPandas()
    want = duckdb.sql("""
        WITH classes AS (SELECT DISTINCT unnest([label, category]) AS c FROM rows),
        t AS (SELECT c, (SELECT count(*) FROM rows WHERE label = c AND category = c) AS tp, (SELECT count(*) FROM rows WHERE label = c) AS support,
                     (SELECT count(*) FROM rows WHERE category = c) AS guesses FROM classes)
        SELECT c, coalesce(tp / nullif(guesses, 0), 0), coalesce(tp / nullif(support, 0), 0), support FROM t""").fetchall()
    assert {c for c, *_ in want} | {"macro avg", "weighted avg"} == set(report)
    for c, precision, recall, support in want:
        r = report[c]
        assert (r["precision"], r["recall"], r["support"]) == (pytest.approx(precision), pytest.approx(recall), support)
        assert r["f1"] == pytest.approx(2 * precision * recall / (precision + recall) if precision + recall else 0)
    assert report["weighted avg"]["recall"] > 0.8


def test_importances_from_nodes_in_sql(spark, forest):
    nodes = trees.nodes_of(forest, spark).toPandas()
    rows = duckdb.sql("""
        WITH g AS (SELECT tree, feature, sum(gain * weight) AS g FROM nodes WHERE "left" IS NOT NULL GROUP BY ALL),
        s AS (SELECT feature, sum(g / t) AS s FROM g JOIN (SELECT tree, sum(g) AS t FROM g GROUP BY tree) USING (tree) GROUP BY feature)
        SELECT feature, s / sum(s) OVER () FROM s""").fetchall()
    got = {r["feature"]: r["importance"] for r in trees.importances(trees.nodes_of(forest, spark)).collect()}
    spark_own = next(s.featureImportances for s in forest.stages if hasattr(s, "featureImportances"))
    assert len(rows) == len(got) and sum(got.values()) == pytest.approx(1.0)
    for feature, importance in rows:
        assert got[feature] == pytest.approx(importance) == pytest.approx(float(spark_own[int(feature)]))


def test_importance_and_summary_queries(spark, data, small_forests, forest):
    top = run(spark, data, "feature_importance").collect()
    assert [r["rank"] for r in top] == list(range(1, 21)) and all(r["importance"] > 0 for r in top)
    vocabulary = models.stage_of(forest, models.CountVectorizerModel).vocabulary
    assert {r["term"] for r in top} <= set(vocabulary)
    facts = {r["property"]: r["value"] for r in run(spark, data, "model_summary").collect()}
    assert facts["feature_count"] == str(len(vocabulary)) and facts["param.numTrees"] == "15" and facts["class_count"] == "4"


def test_scores_agree_with_each_other(spark, data, small_forests):
    scored = run(spark, data, "classify_postings").collect()
    for r in scored:
        values = [p["score"] for p in r["all_predictions"]]
        assert sum(values) == pytest.approx(1) and values == sorted(values, reverse=True) and len(values) == 4
        assert (r["category"], r["confidence"]) == (r["all_predictions"][0]["label"], values[0])
    assert len({r["category"] for r in scored}) == 4
    for r in run(spark, data, "scam_score").collect():
        assert r["scam_probability"] == pytest.approx(max(r["p_scam"], 1 - r["p_scam"])) and r["is_scam"] == (r["p_scam"] > 0.5)
    whole = run(spark, data, "analyze_postings")
    assert "indicators" in whole.columns
    for r in whole.collect():
        assert r["risk"] == ("red" if r["p_scam"] > 0.7 else "orange" if r["p_scam"] > 0.3 else "green") and len(r["category"]) == 2


@pytest.mark.parametrize("key, scale", [("kmeans_levels", False), ("kmeans_levels_scaled", True)])
def test_levels_are_those_of_the_nearest_mean(spark, data, key, scale):
    rows = run(spark, data, key).toPandas()
    points = rows[["salary", "experience"]].to_numpy(float)
    if scale:
        points = (points - points.mean(0)) / points.std(0)
    means = np.stack([points[rows.level_cluster == c].mean(0) for c in range(3)])
    nearest = ((points[:, None] - means[None]) ** 2).sum(2).argmin(1)
    assert (nearest == rows.level_cluster).mean() > 0.98
    assert (np.diff(rows.groupby("level_cluster").salary.mean()) > 0).all()
    assert dict(zip(rows.level_cluster, rows.job_level)) == {0: "entry-level", 1: "mid-level", 2: "senior-level"}
    assert len(rows) == duckdb.sql(f"SELECT count(*) FROM '{data}/lineitem.parquet'").fetchall()[0][0]


def test_bands_are_ranges(spark, data):
    rows = run(spark, data, "salary_bands").toPandas()
    ends = rows.groupby("salary_band").salary.agg(["min", "max"]).sort_index()
    assert list(ends.index) == ["Band 0", "Band 1", "Band 2"]
    assert (ends["min"].to_numpy()[1:] > ends["max"].to_numpy()[:-1]).all()
    assert (rows.lowest <= rows.salary).all() and (rows.salary <= rows.highest).all()


def test_rules_lead_to_the_tree_s_levels(spark, data):
    found = run(spark, data, "experience_rules").collect()
    rows, _ = clusters.experience_tree(catalog_learn.priced_lines(spark, data))
    rows = rows.toPandas()
    covered = 0
    for r in found:
        hit = pd.Series(True, rows.index)
        for condition in filter(None, r["rule"].split(" and ")):
            name, sign, value = condition.split(" ")
            hit &= rows[name] <= float(value) if sign == "<=" else rows[name] > float(value)
        assert (rows[hit].experience_level == r["label"]).all() and r["depth"] <= 3
        covered += int(hit.sum())
    assert covered == len(rows) == sum(r["rows"] for r in found)


def test_a_pipeline_without_trees(spark, data):
    with pytest.raises(ValueError):
        trees.nodes_of(catalog_learn.language_regression(spark, data), spark)
