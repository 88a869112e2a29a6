"""Filters, lookups, counts, order, terms, clusters and drift on small tables."""

import random

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from postlens.operators import clusters, counts, drift, filters, lookup, mentions, order, scaling, terms, zero_shot

POSTINGS = [
    ("Urgent electrician needed", "Fix wiring and install fuse boxes", 18000.0, 2.0),
    ("Chef required for hotel", "Prepare Indian and Chinese dishes", 28000.0, 5.0),
    ("Driver needed", "Drive company truck for delivery", 15000.0, 1.0),
]


@pytest.fixture
def postings(spark):
    return spark.createDataFrame([(i, *p) for i, p in enumerate(POSTINGS)],
                                 "id long, title string, description string, salary double, experience double")


def test_band_filter(spark):
    rows = spark.createDataFrame([(14999,), (15000,), (20000,), (20001,)], "salary int")
    assert [r.salary for r in filters.filter_band(rows, salary_band="₹15k–₹20k").collect()] == [15000, 20000]
    assert filters.parse_band("₹15k–₹20k") == (15000, 20000)


def test_link_filter(spark):
    rows = spark.createDataFrame([("Careers", "/x"), ("About", "/about"), ("x", "/JOBS")], "text string, href string")
    assert [r.text for r in filters.filter_links(rows).collect()] == ["Careers", "x"]


def test_null_filters(spark):
    rows = spark.createDataFrame([(1, None), (None, 2), (3, 4)], "a int, b int")
    assert filters.drop_nulls(rows, ["a", "b"]).count() == 1
    assert filters.rows_with_nulls(rows).count() == 2


def test_lookup_and_union(spark):
    rows = spark.createDataFrame([(0,), (7,), (None,)], "c int")
    assert [r.n for r in lookup.label_lookup(rows, "c", {0: "entry"}, "n").collect()] == ["entry", None, None]
    a, b = spark.createDataFrame([(1, 2)], "x int, y int"), spark.createDataFrame([(3,)], "x int")
    assert sorted(lookup.union_sources({"a": a, "b": b}).select("source", "x", "y").collect()) == [("a", 1, 2), ("b", 3, None)]


def test_round_robin(postings):
    got = order.round_robin_label(postings, "id").orderBy("id").collect()
    assert [(r.category, r.confidence) for r in got] == [("plumber", 0.9), ("driver", 0.9), ("sweeper", 0.9)]


def test_category_codes(spark):
    rows = spark.createDataFrame([(0, "b"), (1, "a"), (2, None), (3, "b")], "i int, category string")
    assert [r.category_encoded for r in order.category_codes(rows, "category").orderBy("i").collect()] == [1, 0, -1, 1]


def test_balanced_classes_weigh_one(spark):
    rows = spark.createDataFrame([(f"c{i % 10}",) for i in range(50)], "label string")
    assert {r.weight for r in counts.class_weights(rows, "label").collect()} == {1.0}


def test_split_takes_each_class(spark):
    rows = spark.createDataFrame([(i, f"c{i % 10}") for i in range(50)], "id int, label string")
    split = order.stratified_split(rows, "id", "label")
    assert split.count() == 50
    per_class = split.where("is_test").groupBy("label").count().collect()
    assert [r["count"] for r in per_class] == [1] * 10


def test_hot_class_is_split_exactly(spark):
    rows = spark.range(9000).select("id", F.when(F.col("id") < 8990, "hot").otherwise("cold").alias("label"))
    got = {r.label: r.n for r in order.stratified_split(rows, "id", "label").where("is_test").groupBy("label").agg(
        F.count("*").alias("n")).collect()}
    assert got == {"hot": 1798, "cold": 2}


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("abc"), st.integers(-50, 50)), min_size=1, max_size=60, unique=True))
def test_running_totals_equal_brute_force(spark, rows):
    df = spark.createDataFrame(rows, "g string, v int")
    got = scaling.running_totals(df, "v", {"s": F.col("v")}, ["g"], following="after").collect()
    want = []
    for g in {r[0] for r in rows}:
        values = sorted(v for k, v in rows if k == g)
        for i, v in enumerate(values):
            want.append((g, v, sum(values[: i + 1]), values[i + 1] if i + 1 < len(values) else None))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_positions_over_many_ranges(spark):
    ids = random.Random(1).sample(range(100000), 5000)
    df = spark.createDataFrame([(i,) for i in ids], "id int").repartition(7)
    got = scaling.with_position(df, "id").orderBy("id").collect()
    assert [r.position for r in got] == list(range(5000))


def test_join_of_hot_keys(spark):
    fact = spark.range(20000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    counted = fact.groupBy("k").agg(F.count("*").alias("n"))
    joined = scaling.join_counted(fact, counted, "k", "n")
    assert joined.count() == 20000
    assert joined.where("k = 'hot'").select("n").distinct().first().n == 6667


def test_first_rows_of_a_hot_group(spark):
    log = spark.range(5000).select(F.when(F.col("id") < 4000, 1).otherwise(2).alias("g"), "id")
    got = scaling.first_per_group(log, "g", ["id"], 50).collect()
    assert sorted((r.g, r.id, r.step) for r in got) == [(1, i, i + 1) for i in range(50)] + [(2, 4000 + i, i + 1) for i in range(50)]


def test_episode_stops_at_first_success(spark):
    log = spark.createDataFrame(
        [(1, t, 1.0, t == 3, t % 2 == 0) for t in range(10)] + [(2, t, -0.5, False, False) for t in range(80)],
        "e int, t int, r double, s boolean, x boolean",
    )
    got = {r.e: r for r in order.episode_rollup(log, "e", ["t"], "r", "s", "x").collect()}
    assert (got[1].total_reward, got[1].steps, got[1].extracted, got[1].succeeded) == (4.0, 4, 2, True)
    assert (got[2].total_reward, got[2].steps, got[2].succeeded) == (-40.0, 80, False)
    cut = {r.e: r for r in order.episode_rollup(log, "e", ["t"], "r", "s", "x", max_steps=50).collect()}
    assert (cut[2].total_reward, cut[2].steps) == (-25.0, 50)


def test_report_of_unseen_class(spark):
    rows = spark.createDataFrame([("a", "a"), ("a", "b"), ("c", "a")], "y string, p string")
    got = {r.label: r for r in counts.classification_report(rows, "y", "p").collect()}
    assert (got["a"].precision, got["a"].recall, got["a"].support) == (0.5, 0.5, 2)
    assert (got["b"].precision, got["b"].recall, got["b"].f1) == (0.0, 0.0, 0.0)
    assert got["macro avg"].support == 3


def test_exact_quantiles(spark):
    values = [1.0, 2.0, 2.0, 2.0, 10.0, 11.0, 30.0]
    table = counts.collapsed_values(spark.createDataFrame([(v,) for v in values], "x double"), ["x"])
    got = {r.p: r.quantile for r in counts.exact_quantiles(table, [0.0, 0.25, 0.5, 0.9, 1.0]).collect()}
    assert got == pytest.approx({0.0: 1.0, 0.25: 2.0, 0.5: 2.0, 0.9: 18.6, 1.0: 30.0})


def test_tfidf_weights(spark):
    docs = spark.createDataFrame([(1, "aa bb"), (2, "aa cc"), (3, "")], "id int, text string").where("id < 3")
    got = {(r.id, r.term): r.tfidf for r in terms.tfidf(docs, "id").collect()}
    assert got[(1, "aa")] == pytest.approx(0.579739, abs=1e-6)
    assert got[(1, "bb")] == pytest.approx(0.814802, abs=1e-6)


def test_tfidf_limits(spark):
    docs = spark.createDataFrame([(1, "aa bb bb"), (2, "aa bb"), (3, "aa cc")], "id int, text string")
    kept = {r.term for r in terms.tfidf(docs, "id", min_df=2, max_df=0.9).collect()}
    assert kept == {"bb"}
    assert {r.term for r in terms.tfidf(docs, "id", max_features=1).collect()} == {"aa"}
    pairs = {r.term for r in terms.tfidf(docs, "id", ngram_max=2, stop_words=["bb"]).collect()}
    assert pairs == {"aa", "cc", "aa cc"}


def test_levels_follow_salary(postings):
    got = {r.title.split()[0]: r.job_level for r in clusters.kmeans_levels(postings).collect()}
    assert got == {"Driver": "entry-level", "Urgent": "mid-level", "Chef": "senior-level"}
    assert {r.job_level for r in clusters.kmeans_levels(postings.where("id < 2")).collect()} == {"unknown"}
    scaled = clusters.kmeans_levels_scaled(postings)
    assert {r.title: r.level_cluster for r in scaled.collect()}["Chef required for hotel"] == 2
    assert {r.job_level for r in clusters.kmeans_levels_scaled(postings.where("id < 2")).collect()} == {None}


def test_write_back_keeps_every_row(spark):
    rows = spark.createDataFrame([(1, 10.0, 1.0), (2, None, 1.0), (3, 90.0, 9.0), (4, 50.0, 5.0)], "i int, s double, e double")
    got = {r.i: r.level_name for r in clusters.cluster_writeback(rows, ["s", "e"], ["junior", "mid", "senior"]).collect()}
    assert got == {1: "junior", 2: None, 3: "senior", 4: "mid"}


def test_bands_are_ordered_and_disjoint(spark):
    rows = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 50, 51, 52, 200, 201]], "salary double")
    got = clusters.salary_bands(rows).groupBy("salary_band", "salary_range").agg(F.min("salary").alias("a"), F.max("salary").alias("b"))
    assert [tuple(r) for r in got.orderBy("salary_band").collect()] == [
        ("Band 0", "₹1 - ₹3", 1.0, 3.0), ("Band 1", "₹50 - ₹52", 50.0, 52.0), ("Band 2", "₹200 - ₹201", 200.0, 201.0)
    ]


def test_zscore_of_constant(spark):
    rows = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    assert [(r.a_z, r.b_z) for r in clusters.zscore(rows, ["a", "b"]).orderBy("a").collect()] == [(-1.0, 0.0), (1.0, 0.0)]


def test_experience_tree_repeats_the_rule(postings):
    levelled, rules = clusters.experience_tree(postings)
    assert all(r.experience_level == r.rule_level for r in levelled.collect())
    assert "feature" in rules


def test_entities_and_key_points(spark):
    docs = spark.createDataFrame(
        [(1, "We move. Acme hires in Mumbai today. Pay is $1,500 a week. Nothing here. New York on 2024-01-05."), (2, "")],
        "id int, text string",
    )
    names = spark.createDataFrame([("Mumbai", "GPE"), ("New York", "GPE"), ("Acme", "ORG")], "phrase string, kind string")
    got = {r.id: r for r in mentions.entities(docs, "id", names, longest=2).collect()}
    assert got[1].locations == ["Mumbai", "New York"] and got[1].organizations == ["Acme"]
    assert got[1].dates == ["2024-01-05"] and got[1].money == ["$1,500"]
    assert got[2].locations == []
    points = [(r["rank"], r.sentence) for r in mentions.key_points(docs, "id", names).orderBy("rank").collect()]
    assert points == [(1, "Acme hires in Mumbai today."), (2, "Pay is $1,500 a week."), (3, "New York on 2024-01-05.")]


def test_joined_mentions_equal_listed_ones(spark, data):
    """The join for long gazetteers and the in-row test for short ones agree."""
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    names = spark.createDataFrame(
        [("the", "ORG"), ("und", "GPE"), ("of the", "ORG"), ("que", "GPE"), ("was", "ORG")], "phrase string, kind string")
    short, long = (mentions.entities(docs, "doc_id", names, longest=2, limit=n) for n in (10, 0))
    assert short.exceptAll(long).count() == 0 and long.exceptAll(short).count() == 0
    short, long = (mentions.key_points(docs, "doc_id", names, longest=2, phrase_limit=n) for n in (10, 0))
    assert short.exceptAll(long).count() == 0 and short.count() == long.count() > 0


def test_zero_shot_scores_every_label(spark):
    docs = spark.createDataFrame([(1, "fix the wiring, electrician"), (2, "zzz qqq")], "id int, text string")
    got = {r.id: r for r in zero_shot.zero_shot_predictions(docs, ["driver", "electrician", "nurse"], "id", "{}").collect()}
    assert got[1].category == "electrician" and got[2].category == "driver"
    for r in got.values():
        scores = [p.score for p in r.all_predictions]
        assert sum(scores) == pytest.approx(1.0) and scores == sorted(scores, reverse=True) and len(scores) == 3


def numbers(spark, values, name="x"):
    return spark.createDataFrame([(None if v is None else float(v),) for v in values], f"{name} double")


def test_drift_statistics(spark):
    values = drift.two_sided(numbers(spark, [1, 2, 3, 4, 5]), numbers(spark, [1, 2, 3, 4, 6]), ["x"])
    assert drift.ks(values).first().statistic == pytest.approx(0.2)
    w = drift.wasserstein(values, drift.reference_deviations(values)).first()
    assert w.distance == pytest.approx(0.141421, abs=1e-6)
    codes = drift.two_sided(numbers(spark, [0, 1, 2, 3, 4]), numbers(spark, [0, 1, 2, 3, 5]), ["x"])
    assert drift.jensen_shannon(codes).first().distance == pytest.approx(0.372330, abs=1e-6)


@pytest.mark.parametrize("method", ["test", "distance"])
def test_same_frames_do_not_drift(spark, method):
    frame = numbers(spark, [1, 1, 2, 3, 5, 8, 13, 21, None])
    got = drift.column_drift(drift.two_sided(frame, frame, ["x"]), method=method).first()
    assert got.drifted is False
    summary = drift.drift_summary(frame, columns=["x"], method=method).first()
    assert (summary.drifted, summary.drift_score, summary.dataset_drift, summary.missing) == (False, None, False, 1)


def test_shifted_column_drifts(spark):
    a, b = numbers(spark, range(200)), numbers(spark, range(150, 350))
    assert drift.column_drift(drift.two_sided(a, b, ["x"]), method="test").first().drifted
    rolled = drift.summary_rollup(drift.drift_summary(b, a, ["x"])).first()
    assert rolled.dataset_drift and rolled.drift_columns == ["x"] and rolled.data_quality.current_rows == 200


def test_kind_and_method_decide_not_the_values(spark):
    test = lambda a, b, **how: drift.drift_between(numbers(spark, a), numbers(spark, b), ["x"], **how).first()
    two = test([0, 1] * 50, [0] * 90 + [1] * 10, categorical=["x"], method="test")
    few = test([0, 1, 2] * 30, [0] * 80 + [1, 2] * 5, categorical=["x"], method="test")
    assert (two.method, two.drifted) == ("z_test", True)
    assert (few.method, few.drifted) == ("chi_square", True)
    assert test([0, 1] * 50, [0] * 90 + [1] * 10, method="test").method == "ks"
    assert test([0, 1] * 1000, [0] * 90 + [1] * 10, categorical=["x"]).method == "jensen_shannon"


def test_text_columns_and_empty_sides(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2), ("x", None)], "t string, n bigint")
    b = spark.createDataFrame([("x", 1), ("z", None)], "t string, n bigint")
    nothing = spark.createDataFrame([], "t string, n bigint")
    for method in ("test", "distance"):
        assert drift.drift_between(a, b, ["t", "n"], method=method).count() == 2
        for left, right in ((a, nothing), (nothing, b), (a, b.withColumn("n", F.lit(None).cast("bigint")))):
            rows = drift.drift_summary(right, left, ["t", "n"], method=method).collect()
            assert len(rows) == 2 and not [r for r in rows if r.column == "n" and (r.drifted or r.drift_score is not None)]


def test_ks_series_for_small_arguments(spark):
    p = lambda d, n, m: spark.range(1).select(drift.ks_p_value(F.lit(d), F.lit(float(n)), F.lit(float(m)))).first()[0]
    assert p(0.0002, 1000, 1_000_000) == pytest.approx(1.0)
    for lam, want in ((0.5, 0.963945), (0.9, 0.392731), (1.0, 0.269999), (1.1, 0.177718), (1.5, 0.022218), (2.0, 0.000671)):
        assert p(lam / 10, 200, 200) == pytest.approx(want, abs=2e-6)


def test_profile_keeps_whole_numbers_and_text(spark):
    rows = [(2**53, "b"), (2**53 + 1, "a"), (2**53 + 1, "b"), (-(2**62), None)]
    got = {r.column: r for r in counts.quality_profile(spark.createDataFrame(rows, "n bigint, t string"), ["n", "t"]).collect()}
    assert (got["n"].distinct, got["n"].max, got["n"].most_common) == (3, str(2**53 + 1), str(2**53 + 1))
    assert (got["t"].distinct, got["t"].min, got["t"].most_common, got["t"].missing, got["t"].q50) == (2, "a", "b", 1, None)


def test_clusters_below_k_complete_rows(spark):
    rows = spark.createDataFrame([(1.0, 2.0), (None, 1.0), (2.0, None)], "salary double, experience double")
    assert {r.job_level for r in clusters.kmeans_levels(rows).collect()} == {"unknown"}
    assert {r.job_level for r in clusters.kmeans_levels_scaled(rows).collect()} == {None}
    assert {r.level for r in clusters.cluster_writeback(rows, ["salary", "experience"], ["a", "b", "c"]).collect()} == {None}
    assert {r.salary_band for r in clusters.salary_bands(rows).collect()} == {None}


def test_zero_shot_takes_text_labels(spark):
    docs = spark.createDataFrame([(1, "fix the wiring"), (2, "zzz qqq")], "id int, text string")
    labels = spark.createDataFrame([("b", "wiring"), ("a", "soup")], "label string, text string")
    assert {r.id: r.label for r in zero_shot.zero_shot_top(docs, labels, "id", "label").collect()} == {1: "b", 2: "a"}


def test_other_kinds_and_long_names_in_both_plans(spark):
    docs = spark.createDataFrame([(1, "New York City hires. Ada Lovelace came. Acme Tools Inc. pays.")], "id int, text string")
    names = spark.createDataFrame([("New York City", "GPE"), ("Ada Lovelace", "PERSON"), ("Acme  Tools", "ORG")], "phrase string, kind string")
    for limit in (10, 0):
        found = mentions.entities(docs, "id", names, limit=limit).first()
        assert (found.locations, found.organizations) == (["New York City"], ["Acme Tools"])
        points = mentions.key_points(docs, "id", names, phrase_limit=limit).orderBy("rank").collect()
        assert [p.sentence for p in points] == ["New York City hires.", "Acme Tools Inc."]


def test_chi_square_tail():
    assert drift._upper_gamma(0.5, 3.841458820694124 / 2) == pytest.approx(0.05, abs=1e-9)
    assert drift._upper_gamma(2.0, 9.487729036781154 / 2) == pytest.approx(0.05, abs=1e-9)
    assert drift._upper_gamma(5.0, 0.5) == pytest.approx(0.9998278, abs=1e-6)


def test_drift_ignores_row_order(spark, data):
    events = spark.read.parquet(f"{data}/events.parquet")
    split = F.expr("ts < timestamp'2024-01-16'")
    a = drift.ks(drift.two_sided_by(events, ["value"], split)).first()
    b = drift.ks(drift.two_sided_by(events.repartition(5, "user_id").orderBy("value"), ["value"], split)).first()
    assert a == b


def test_windows_against_brute_force(spark):
    ref = [1, 2, 2, 5, 9, 9]
    cur = {"2024-01-01 10:00:00": [2, 3], "2024-01-02 10:00:00": [0, 9, 20]}
    frame = spark.createDataFrame([(t, float(v)) for t, vs in cur.items() for v in vs], "t string, v double").select(
        F.col("t").cast("timestamp").alias("t"), "v")
    got = [r.statistic for r in drift.drift_by_window(frame, "t", "v", numbers(spark, ref, "v"), "1 day").orderBy("window_start").collect()]
    at = lambda xs, x: sum(v <= x for v in xs) / len(xs)
    want = [max(abs(at(ref, x) - at(vs, x)) for x in [*ref, *vs]) for vs in cur.values()]
    assert got == pytest.approx(want)


def test_label_index_in_parts_gives_the_same(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "fix the wiring and the soup"), (2, "soup soup wiring"), (3, "zzz"), (4, None), (5, "")], "id int, text string")
    labels = ["wiring", "soup", "the soup", "none of these"]
    whole = zero_shot.zero_shot_predictions(docs, labels, "id", "{}").orderBy("id").collect()
    monkeypatch.setattr(zero_shot, "INDEX_ROWS", 1)
    assert zero_shot.zero_shot_predictions(docs, labels, "id", "{}").orderBy("id").collect() == whole
    assert all(len(r.all_predictions) == 4 for r in whole)
    assert (whole[2].category, whole[2].confidence) == ("wiring", 0.25) and whole[1].category == "soup"


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_texts_are_weighed_where_they_lie(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "aa bb bb cc"), (2, "aa bb"), (3, "aa dd ee"), (4, None), (5, ""), (6, "x")], "id int, text string")
    tables = terms.term_counts(docs, "id", ngram_max=2)
    known = terms.vocabulary(tables, docs.agg(F.count("*").alias("n")))
    want = {(r.id, r.term, r.tf): pytest.approx(r.tfidf) for r in terms.weigh(tables, known, "id").collect()}
    whole = terms.tfidf(docs, "id", ngram_max=2)
    assert shuffles(whole) == 0 and shuffles(terms.counted_rows(docs, "id", ngram_max=2)) == 0
    assert {(r.id, r.term, r.tf): r.tfidf for r in whole.collect()} == want
    # terms too rare to be sent are joined
    monkeypatch.setattr(terms, "HOT_TERMS", 2)
    monkeypatch.setattr(terms, "PART_WORDS", 3)
    assert terms.hot_from(known) == (3, False)
    assert {(r.id, r.term, r.tf): r.tfidf for r in terms.tfidf(docs, "id", ngram_max=2).collect()} == want
    monkeypatch.setattr(terms, "HOT_TERMS", 0)
    assert {(r.id, r.term, r.tf): r.tfidf for r in terms.tfidf(docs, "id", ngram_max=2).collect()} == want


def test_rows_of_one_key_are_one_text(spark):
    docs = spark.createDataFrame([(1, "aa bb"), (1, "bb cc"), (None, "aa"), (None, "aa dd")], "id int, text string")
    got = {(r.id, r.term): r.tf for r in terms.tfidf(docs, "id").collect()}
    assert got == {(1, "aa"): 1, (1, "bb"): 2, (1, "cc"): 1, (None, "aa"): 2, (None, "dd"): 1}


def test_central_sentences_in_the_row_equal_those_by_tables(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "aa bb. cc dd! aa aa. ee"), (2, "aa. bb cc? x"), (3, None), (4, " . "), (5, "cc cc dd ee. aa")], "id int, text string")
    want = {tuple(r) for r in mentions.central_sentences(docs, terms.tfidf(docs, "id"), "id", width=12).collect()}
    assert {tuple(r) for r in mentions.central_texts(docs, "id", width=12).collect()} == want and len(want) == 3
    assert shuffles(mentions.central_texts(docs, "id", width=12)) == 0


def test_labels_are_added_up_in_parts(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"aa b{i:02d} cc") for i in range(20)], "id int, text string").coalesce(1)
    labels = spark.createDataFrame([(1, "aa b03"), (2, "cc"), (3, "zz")], "label int, text string")
    want = sorted(map(tuple, zero_shot.zero_shot_top(docs, labels, "id", "label").collect()))
    monkeypatch.setattr(zero_shot, "PART_ROWS", 3)
    assert sorted(map(tuple, zero_shot.zero_shot_top(docs, labels, "id", "label").collect())) == want and len(want) == 20
