"""Queries of the learned operators: zero-shot, forests, regression, clusters, profiles."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from postlens.constants import CANDIDATE_LABELS, HYPOTHESIS_TEMPLATE, SALARY_PATTERNS, SKILL_PATTERNS
from postlens.operators import clusters, counts
from postlens.operators.order import stratified_split
from postlens.operators.zero_shot import zero_shot_predictions, zero_shot_top
from postlens.plans import models, open_vocabulary, sequence, trees
from postlens.plans.catalog_text import R as TEXT, SQL_COUNTS, gazetteer, sql_skills
from postlens.plans.profile import analyze_postings as analyze, text_profile as profile
from postlens.plans.registry import Registry, table, wide_table
from postlens.session import scratch_path

R = Registry()
PARTS = TEXT.oracles


@R.add("zero_shot", rf"""
WITH counts AS ({SQL_COUNTS}),
terms AS (SELECT term, ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + count(*))) + 1 AS idf FROM counts GROUP BY term),
tw AS (SELECT doc_id, term, tf * idf AS w FROM counts JOIN terms USING (term)),
tn AS (SELECT doc_id, sqrt(sum(w * w)) AS n FROM tw GROUP BY doc_id),
lw AS (SELECT item_id, term, tf * idf AS w FROM
  (SELECT item_id, term, count(*) AS tf FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{2,}}')) AS term FROM benchmark)
   GROUP BY item_id, term) JOIN terms USING (term)),
ln2 AS (SELECT item_id, sqrt(sum(w * w)) AS n FROM lw GROUP BY item_id),
pairs AS (SELECT doc_id, item_id, round(sum((tw.w / tn.n) * (lw.w / ln2.n)), 9) AS cosine
          FROM tw JOIN lw USING (term) JOIN tn USING (doc_id) JOIN ln2 USING (item_id) GROUP BY doc_id, item_id),
best AS (SELECT doc_id, item_id, cosine, row_number() OVER (PARTITION BY doc_id ORDER BY cosine DESC, item_id) AS r,
                sum(exp(cosine)) OVER (PARTITION BY doc_id) AS z, count(*) OVER (PARTITION BY doc_id) AS shared FROM pairs)
SELECT d.doc_id, coalesce(item_id, (SELECT min(item_id) FROM benchmark)) AS item_id,
       round(exp(coalesce(cosine, 0)) / (coalesce(z, 0) + (SELECT count(*) FROM benchmark) - coalesce(shared, 0)), 6) AS confidence,
       coalesce(shared, 0) AS shared
FROM documents d LEFT JOIN (SELECT * FROM best WHERE r = 1) USING (doc_id)""")
def zero_shot(spark, d):
    found = zero_shot_top(wide_table(spark, d, "documents"), table(spark, d, "benchmark"), "doc_id", "item_id")
    return found.withColumn("confidence", F.round("confidence", 6))


SQL_LABELS = ", ".join(f"({i}, '{x}')" for i, x in enumerate(CANDIDATE_LABELS))


@R.add("zero_shot_labels", rf"""
WITH counts AS ({SQL_COUNTS}),
terms AS (SELECT term, ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + count(*))) + 1 AS idf FROM counts GROUP BY term),
tw AS (SELECT doc_id, term, tf * idf AS w FROM counts JOIN terms USING (term)),
tn AS (SELECT doc_id, sqrt(sum(w * w)) AS n FROM tw GROUP BY doc_id),
labels(place, label) AS (VALUES {SQL_LABELS}),
lw AS (SELECT place, term, tf * idf AS w FROM
  (SELECT place, term, count(*) AS tf FROM (SELECT place, unnest(regexp_extract_all(lower(replace('{HYPOTHESIS_TEMPLATE}', '{{}}', label)), '[\p{{L}}\p{{N}}_]{{2,}}')) AS term FROM labels)
   GROUP BY place, term) JOIN terms USING (term)),
ln2 AS (SELECT place, sqrt(sum(w * w)) AS n FROM lw GROUP BY place),
pairs AS (SELECT doc_id, place, round(sum((tw.w / tn.n) * (lw.w / ln2.n)), 9) AS cosine
          FROM tw JOIN lw USING (term) JOIN tn USING (doc_id) JOIN ln2 USING (place) GROUP BY doc_id, place),
every AS (SELECT doc_id, place, label, coalesce(cosine, 0) AS cosine FROM documents CROSS JOIN labels LEFT JOIN pairs USING (doc_id, place))
SELECT doc_id, arg_min(label, (round(-cosine, 9), place)) AS category, round(exp(max(cosine)) / sum(exp(cosine)), 6) AS confidence,
       string_agg(label, '|' ORDER BY cosine DESC, place) AS ranked
FROM every GROUP BY doc_id""")
def zero_shot_labels(spark, d):
    """Every document against the caller's labels, each set into the hypothesis, all of them ranked."""
    docs = wide_table(spark, d, "documents").select("doc_id", "text")
    scored = zero_shot_predictions(docs, CANDIDATE_LABELS, "doc_id", HYPOTHESIS_TEMPLATE)
    return scored.select("doc_id", "category", F.round("confidence", 6).alias("confidence"),
                         F.array_join(F.transform("all_predictions", lambda p: p["label"]), "|").alias("ranked"))


def language_texts(spark, d):
    return wide_table(spark, d, "documents").select("doc_id", "text", F.col("lang").alias("label"))


def split_texts(spark, d):
    flagged = stratified_split(language_texts(spark, d), "doc_id", "label")
    return flagged.where(~F.col("is_test")).drop("is_test"), flagged.where("is_test").drop("is_test")


def language_forest(spark, d):
    """The balanced forest on the training part, at the library's depth."""
    train, _ = split_texts(spark, d)
    return models.train_forest(counts.with_class_weights(train, "label"), config=models.BIGRAMS_5000, trees=300, weight="weight")


def language_regression(spark, d):
    train, _ = split_texts(spark, d)
    return models.train_logistic(train, config=models.BIGRAMS_1000)


def toxic_texts(spark, d):
    labels = table(spark, d, "labels").select("doc_id", F.col("toxic").alias("label"))
    return wide_table(spark, d, "documents").select("doc_id", "text").join(labels, "doc_id")


def scam_forest(spark, d):
    return models.train_forest(toxic_texts(spark, d), config=models.UNIGRAMS_1000, trees=100)


@R.add("train_rf")
def train_rf(spark, d):
    """Report of the forest on the held-out texts."""
    _, test = split_texts(spark, d)
    scored = models.classify_postings(test, language_forest(spark, d))
    return counts.classification_report(scored, "label", "category")


@R.add("train_lr")
def train_lr(spark, d):
    """Report of the regression on the held-out texts."""
    _, test = split_texts(spark, d)
    scored = models.classify_postings(test, language_regression(spark, d))
    return counts.classification_report(scored, "label", "category")


@R.add("classify_postings")
def classify_postings(spark, d):
    """Every document's category, confidence and ranked predictions, by a saved and reloaded model."""
    path = models.save_model(language_regression(spark, d), scratch_path(spark, "model"))
    scored = models.classify_postings(language_texts(spark, d), models.load_model(path))
    return scored.select("doc_id", "category", "confidence", "all_predictions")


PLUGIN_WORDS = ["the", "und", "les", "que"]


def word_scorer():
    """A scorer for the hook: how often each label occurs in a text."""
    return lambda texts: np.array([[(t or "").count(w) for w in PLUGIN_WORDS] for t in texts], dtype=float)


SQL_PLUGIN = ", ".join(
    f"(length(text) - length(replace(text, '{w}', ''))) // {len(w)} AS n{i}" for i, w in enumerate(PLUGIN_WORDS))
SQL_BEST = "greatest(n0, n1, n2, n3)"


@R.add("score_plugin", f"""
SELECT doc_id, CASE {' '.join(f"WHEN n{i} = {SQL_BEST} THEN '{w}'" for i, w in enumerate(PLUGIN_WORDS))} END AS category,
       round(1 / ({' + '.join(f'exp(n{i} - {SQL_BEST})' for i in range(len(PLUGIN_WORDS)))}), 6) AS confidence
FROM (SELECT doc_id, {SQL_PLUGIN} FROM documents)""")
def score_plugin(spark, d):
    """The whole-batch hook with a caller's scorer."""
    docs = wide_table(spark, d, "documents").select("doc_id", "text")
    scored = models.plugin_scores(docs, PLUGIN_WORDS, word_scorer)
    return scored.select("doc_id", "category", F.round("confidence", 6).alias("confidence"))


@R.add("sequence_scores")
def sequence_scores(spark, d):
    """Every document scored by the network over its first 512 words, trained on the training part."""
    train, _ = split_texts(spark, d)
    model = sequence.train_sequence(train)
    scored = sequence.sequence_scores(language_texts(spark, d), model)
    return scored.select("doc_id", "category", "confidence", "all_predictions")


@R.add("train_open_vocabulary")
def train_open_vocabulary(spark, d):
    """Report on the held-out texts of the regression over every single word, without a bound on the vocabulary."""
    train, test = split_texts(spark, d)
    model = open_vocabulary.train_open(train, "doc_id")
    return counts.classification_report(open_vocabulary.score_open(test, model, "doc_id"), "label", "category")


@R.add("scam_score")
def scam_score(spark, d):
    """Flag, probabilities and rule features of every document."""
    scored = models.scam_scores(wide_table(spark, d, "documents").select("doc_id", "text"), scam_forest(spark, d))
    return scored.select("doc_id", "is_scam", "scam_probability", "p_scam", "features.*")


@R.add("feature_importance")
def feature_importance(spark, d):
    """The twenty strongest terms of the balanced forest on whole documents."""
    return models.feature_importance(language_forest(spark, d))


@R.add("model_summary")
def model_summary(spark, d):
    """Every property of the balanced forest on whole documents."""
    return models.model_summary(language_forest(spark, d))


@R.add("analyze_postings")
def analyze_postings(spark, d):
    """Every document's category, confidence, scam fields, risk and indicators at one batch time."""
    rows = analyze(
        wide_table(spark, d, "documents").select("doc_id", "text"), language_regression(spark, d), scam_forest(spark, d),
        F.lit("2024-01-31 12:00:00"),
    )
    return rows.drop("text")


SQL_AMOUNTS = ", ".join(
    f"TRY_CAST(replace(coalesce({', '.join(f"nullif(regexp_extract(lower(text), '{p}', {g}), '')" for p in SALARY_PATTERNS)}), ',', '') AS DOUBLE) AS {n}"
    for g, n in ((1, "min_salary"), (2, "max_salary"))
)


@R.add("text_profile", f"""
WITH points AS (SELECT doc_id, string_agg(sentence, '|' ORDER BY rank) AS key_points FROM ({PARTS["key_points"]}) GROUP BY doc_id)
SELECT doc_id, summary, coalesce(key_points, '') AS key_points, locations, organizations, dates, money, skills,
       min_salary, max_salary, email, phone, original_length, summary_length, compression_ratio
FROM ({PARTS["summarize"]}) JOIN ({PARTS["entities"]}) USING (doc_id) JOIN ({sql_skills(SKILL_PATTERNS)}) USING (doc_id)
JOIN ({PARTS["contacts"]}) USING (doc_id) JOIN (SELECT doc_id, {SQL_AMOUNTS} FROM documents) USING (doc_id)
LEFT JOIN points USING (doc_id)""")
def text_profile(spark, d):
    """The nested profile, its lists joined and its structs spread out."""
    rows = profile(wide_table(spark, d, "documents").select("doc_id", "text"), "doc_id", gazetteer(spark, d))
    lists = ["locations", "organizations", "dates", "money", "skills"]
    return rows.select(
        "doc_id", "summary", F.array_join("key_points", "|").alias("key_points"),
        *[F.array_join(F.col("entities")[x], "|").alias(x) for x in lists],
        "salary.min_salary", "salary.max_salary", "contact.email", "contact.phone",
        "text_stats.original_length", "text_stats.summary_length",
        F.round("text_stats.compression_ratio", 6).alias("compression_ratio"),
    )


def priced_lines(spark, d):
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("salary"), F.col("l_quantity").alias("experience")
    )


@R.add("kmeans_levels")
def kmeans_levels(spark, d):
    """The level of every line by price and quantity."""
    return clusters.kmeans_levels(priced_lines(spark, d))


@R.add("kmeans_levels_scaled")
def kmeans_levels_scaled(spark, d):
    """The same on standard scores."""
    return clusters.kmeans_levels_scaled(priced_lines(spark, d))


@R.add("salary_bands", """
WITH c AS (SELECT o_totalprice AS v, count(*)::DOUBLE AS c FROM orders GROUP BY 1),
z AS (SELECT v, c, v - (SELECT sum(c * v) / sum(c) FROM c) AS x FROM c),
p AS (SELECT v, row_number() OVER o AS i, sum(c) OVER o AS w, sum(c * x) OVER o AS s1, sum(c * x * x) OVER o AS s2 FROM z WINDOW o AS (ORDER BY v)),
two AS (SELECT j.i AS j, min(a.s2 - a.s1 * a.s1 / a.w + j.s2 - a.s2 - (j.s1 - a.s1) * (j.s1 - a.s1) / (j.w - a.w)) AS d,
          arg_min(a.v, a.s2 - a.s1 * a.s1 / a.w + j.s2 - a.s2 - (j.s1 - a.s1) * (j.s1 - a.s1) / (j.w - a.w)) AS lo
        FROM p a JOIN p j ON a.i < j.i GROUP BY j.i),
best AS (SELECT arg_min(lo, d + c) AS lo, arg_min(v, d + c) AS hi FROM (
          SELECT two.lo, two.d, p.v, (e.s2 - p.s2 - (e.s1 - p.s1) * (e.s1 - p.s1) / (e.w - p.w)) AS c
          FROM two JOIN p ON p.i = two.j JOIN (SELECT * FROM p ORDER BY i DESC LIMIT 1) e ON p.i < e.i)),
banded AS (SELECT o_orderkey, o_totalprice AS salary, CASE WHEN o_totalprice <= lo THEN 0 WHEN o_totalprice <= hi THEN 1 ELSE 2 END AS b FROM orders, best)
SELECT o_orderkey, salary, 'Band ' || b AS salary_band, min(salary) OVER w AS lowest, max(salary) OVER w AS highest
FROM banded WINDOW w AS (PARTITION BY b)""")
def salary_bands(spark, d):
    """The band and its range of every order by total price."""
    found = clusters.salary_bands(table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("salary")))
    ends = found.groupBy("salary_band").agg(F.min("salary").alias("lowest"), F.max("salary").alias("highest"))
    return found.select("o_orderkey", "salary", "salary_band").join(F.broadcast(ends), "salary_band")


@R.add("experience_rules")
def experience_rules(spark, d):
    """The experience tree's rules, a row per leaf, walked from its saved nodes."""
    model = clusters.fit_experience_tree(priced_lines(spark, d))
    labels = model.stages[-1].getLabels()
    return trees.rules(trees.nodes_of(model, spark), ["salary", "experience"], labels)


@R.add("experience_tree", """
SELECT CASE WHEN l_quantity < 2 THEN 'entry' WHEN l_quantity < 5 THEN 'mid' ELSE 'senior' END AS experience_level,
       CASE WHEN l_quantity < 2 THEN 'entry' WHEN l_quantity < 5 THEN 'mid' ELSE 'senior' END AS rule_level, count(*) AS n
FROM lineitem GROUP BY 1, 2""")
def experience_tree(spark, d):
    """How the tree's levels agree with the rule it was trained on."""
    levelled, _rules = clusters.experience_tree(priced_lines(spark, d))
    return levelled.groupBy("experience_level", "rule_level").agg(F.count("*").alias("n"))
