"""Queries of the relational operators: filters, lookups, counts, order, scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from postlens import constants as C
from postlens.functions import scores as S
from postlens.operators import clusters, counts, filters, lookup, order
from postlens.plans.registry import Registry, table

R = Registry()


def lineitem_postings(spark, d):
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_returnflag").alias("category"),
        (1 - F.col("l_discount")).alias("confidence"), F.col("l_tax").alias("scam_probability"),
    )


SQL_POSTINGS = """SELECT l_orderkey, l_linenumber, l_returnflag AS category, 1 - l_discount AS confidence,
       l_tax AS scam_probability FROM lineitem"""


@R.add("filter_postings", f"""
SELECT * FROM ({SQL_POSTINGS}) WHERE category = 'A' AND confidence >= 0.95 AND scam_probability <= 0.04""")
def filter_postings(spark, d):
    return filters.filter_postings(lineitem_postings(spark, d), "A", 0.95, 0.04)


@R.add("filter_targets", f"""
SELECT * FROM ({SQL_POSTINGS}) WHERE category IN ('A', 'R') AND scam_probability <= 0.03""")
def filter_targets(spark, d):
    return filters.filter_targets(lineitem_postings(spark, d), ["A", "R"], 0.03)


LEVEL_OF_STATUS = {"F": "junior", "O": "mid"}


def order_postings(spark, d):
    rows = table(spark, d, "orders").select(
        "o_orderkey", F.col("o_orderpriority").alias("category"), F.col("o_totalprice").alias("salary"), "o_orderstatus"
    )
    return lookup.label_lookup(rows, "o_orderstatus", LEVEL_OF_STATUS, "level_name").drop("o_orderstatus")


SQL_ORDERS = """SELECT o_orderkey, o_orderpriority AS category, o_totalprice AS salary,
       CASE o_orderstatus WHEN 'F' THEN 'junior' WHEN 'O' THEN 'mid' END AS level_name FROM orders"""


@R.add("filter_band", f"""
SELECT o_orderkey, category, salary, level_name AS experience_level FROM ({SQL_ORDERS})
WHERE category = '2-HIGH' AND level_name = 'mid' AND salary BETWEEN 100000 AND 250000""")
def filter_band(spark, d):
    rows = order_postings(spark, d).withColumnRenamed("level_name", "experience_level")
    return filters.filter_band(rows, "2-HIGH", "mid", "₹100k–₹250k")


@R.add("filter_level_salary", f"""
SELECT o_orderkey, salary, level_name FROM ({SQL_ORDERS})
WHERE category = '5-LOW' AND level_name = 'junior' AND salary > 250000""")
def filter_level_salary(spark, d):
    return filters.filter_level_salary(
        order_postings(spark, d), "5-LOW", "junior", 250000, ["o_orderkey", "salary", "level_name"]
    )


def labelled_documents(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    return lookup.lookup_table(docs, table(spark, d, "labels"), "doc_id").select(
        "doc_id", "lang", "source", "n_chars", "quality", "toxic"
    )


SQL_LABELLED = """SELECT doc_id, lang, source, n_chars, quality, toxic
FROM documents LEFT JOIN labels USING (doc_id)"""


@R.add("drop_nulls", f"SELECT * FROM ({SQL_LABELLED}) WHERE quality IS NOT NULL AND toxic IS NOT NULL")
def drop_nulls(spark, d):
    return filters.drop_nulls(labelled_documents(spark, d), ["quality", "toxic"])


@R.add("rows_with_nulls", f"SELECT * FROM ({SQL_LABELLED}) WHERE quality IS NULL OR toxic IS NULL OR lang IS NULL OR source IS NULL OR n_chars IS NULL")
def rows_with_nulls(spark, d):
    return filters.rows_with_nulls(labelled_documents(spark, d), ["lang", "source", "n_chars", "quality", "toxic"])


@R.add("align_results", """
SELECT doc_id, CAST(length(text) AS INTEGER) AS length, toxic AS is_scam, quality FROM documents JOIN labels USING (doc_id)""")
def align_results(spark, d):
    lengths = table(spark, d, "documents").select("doc_id", F.length("text").alias("length"))
    flags = table(spark, d, "labels").select("doc_id", F.col("toxic").alias("is_scam"), "quality")
    return lookup.align_results(lengths, flags, "doc_id")


EVENT_NAMES = {"click": "entry-level", "view": "mid-level", "purchase": "senior-level"}


@R.add("label_lookup", """
SELECT event_id, event_type, CASE event_type WHEN 'click' THEN 'entry-level' WHEN 'view' THEN 'mid-level'
       WHEN 'purchase' THEN 'senior-level' END AS level FROM events""")
def label_lookup(spark, d):
    events = table(spark, d, "events").select("event_id", "event_type")
    return lookup.label_lookup(events, "event_type", EVENT_NAMES, "level")


@R.add("union_sources", """
SELECT c_custkey AS id, c_name AS title, c_acctbal AS salary, c_mktsegment AS category, 'customer' AS source FROM customer
UNION ALL SELECT s_suppkey, s_name, s_acctbal, NULL, 'supplier' FROM supplier""")
def union_sources(spark, d):
    customers = table(spark, d, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), F.col("c_acctbal").alias("salary"),
        F.col("c_mktsegment").alias("category"),
    )
    suppliers = table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("id"), F.col("s_name").alias("title"), F.col("s_acctbal").alias("salary")
    )
    return lookup.union_sources({"customer": customers, "supplier": suppliers})


@R.add("value_counts", """
SELECT 'lang' AS "column", lang AS value, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang
UNION ALL SELECT 'source', source, count(*) FROM documents WHERE source IS NOT NULL GROUP BY source""")
def value_counts(spark, d):
    return counts.by_count(counts.value_counts(table(spark, d, "documents"), ["lang", "source"]))


@R.add("row_count", "SELECT count(*) AS n FROM lineitem")
def row_count(spark, d):
    return table(spark, d, "lineitem").agg(F.count("*").alias("n"))


@R.add("null_counts", f"""
WITH t AS ({SQL_LABELLED})
SELECT 'lang' AS "column", count(*) FILTER (WHERE lang IS NULL) AS missing FROM t
UNION ALL SELECT 'quality', count(*) FILTER (WHERE quality IS NULL) FROM t
UNION ALL SELECT 'toxic', count(*) FILTER (WHERE toxic IS NULL) FROM t""")
def null_counts(spark, d):
    return counts.null_counts(labelled_documents(spark, d), ["lang", "quality", "toxic"])


@R.add("distinct_sorted", "SELECT DISTINCT o_orderpriority AS category FROM orders ORDER BY 1")
def distinct_sorted(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderpriority").alias("category"))
    return counts.distinct_sorted(rows, "category")


@R.add("min_max", "SELECT min(o_totalprice) AS min_value, max(o_totalprice) AS max_value FROM orders")
def min_max(spark, d):
    return counts.min_max(table(spark, d, "orders"), "o_totalprice")


@R.add("quality_block", f"""
WITH t AS ({SQL_LABELLED})
SELECT c AS "column", CASE c WHEN 'lang' THEN 0 WHEN 'n_chars' THEN 0 ELSE (SELECT count(*) FILTER (WHERE quality IS NULL) FROM t) END AS missing,
       (SELECT count(*) FROM t) AS current_rows, (SELECT count(*) FROM conversations) AS reference_rows, k AS type
FROM (VALUES ('lang', 'string'), ('n_chars', 'bigint'), ('quality', 'int')) v(c, k)""")
def quality_block(spark, d):
    return counts.quality_block(labelled_documents(spark, d), table(spark, d, "conversations"), ["lang", "n_chars", "quality"])


def _sql_profile(column: str) -> str:
    return f"""SELECT '{column}' AS "column", count({column}) AS count, count(*) FILTER (WHERE {column} IS NULL) AS missing,
  count(DISTINCT {column}) AS "distinct", round(avg({column}), 4) AS mean, round(stddev_samp({column}), 4) AS std,
  min({column}) AS min, round(quantile_cont({column}, 0.25), 4) AS q25, round(quantile_cont({column}, 0.5), 4) AS q50,
  round(quantile_cont({column}, 0.75), 4) AS q75, max({column}) AS max,
  (SELECT {column} FROM lineitem WHERE {column} IS NOT NULL GROUP BY {column} ORDER BY count(*) DESC, {column} LIMIT 1) AS most_common
FROM lineitem"""


@R.add("quality_profile", " UNION ALL ".join(map(_sql_profile, ["l_quantity", "l_extendedprice", "l_discount"])))
def quality_profile(spark, d):
    profile = counts.quality_profile(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])
    return profile.withColumns({c: F.round(c, 4) for c in ("mean", "std", "q25", "q50", "q75")})


SQL_MIXED_PROFILE = " UNION ALL ".join(f"""
SELECT '{c}' AS "column", count({c}) AS count, count(*) FILTER (WHERE {c} IS NULL) AS missing, count(DISTINCT {c}) AS "distinct",
  {f'round(avg({c}), 4)' if number else 'CAST(NULL AS DOUBLE)'} AS mean, {f'round(stddev_samp({c}), 4)' if number else 'CAST(NULL AS DOUBLE)'} AS std,
  CAST(min({c}) AS VARCHAR) AS min, CAST(max({c}) AS VARCHAR) AS max,
  (SELECT CAST({c} AS VARCHAR) FROM documents WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1) AS most_common,
  {', '.join(f'round(quantile_cont({c}, {q}), 4) AS {n}' if number else f'CAST(NULL AS DOUBLE) AS {n}' for q, n in ((0.25, 'q25'), (0.5, 'q50'), (0.75, 'q75')))}
FROM documents""" for c, number in (("lang", False), ("source", False), ("n_chars", True)))


@R.add("quality_profile_mixed", SQL_MIXED_PROFILE)
def quality_profile_mixed(spark, d):
    profile = counts.quality_profile(table(spark, d, "documents"), ["lang", "source", "n_chars"])
    return profile.withColumns({c: F.round(c, 4) for c in ("mean", "std", "q25", "q50", "q75")})


def judged_documents(spark, d):
    """Quality labels against a guess from the text length."""
    joined = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return joined.select("doc_id", "quality", F.when(F.length("text") >= 300, 1).otherwise(0).alias("guess"))


SQL_JUDGED = """SELECT doc_id, quality AS a, CASE WHEN length(text) >= 300 THEN 1 ELSE 0 END AS p
FROM documents JOIN labels USING (doc_id)"""


@R.add("classification_report", f"""
WITH j AS ({SQL_JUDGED}),
labels2 AS (SELECT a AS l FROM j UNION SELECT p FROM j),
t AS (SELECT l, (SELECT count(*) FROM j WHERE a = l AND p = l) AS tp, (SELECT count(*) FROM j WHERE a = l) AS support,
             (SELECT count(*) FROM j WHERE p = l) AS guesses FROM labels2),
r AS (SELECT CAST(l AS VARCHAR) AS label, coalesce(tp / nullif(guesses, 0), 0.0) AS precision,
             coalesce(tp / nullif(support, 0), 0.0) AS recall, support FROM t),
f AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0.0) AS f1 FROM r),
every AS (SELECT label, precision, recall, f1, support FROM f
  UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM f
  UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
                   sum(f1 * support) / sum(support), sum(support) FROM f)
SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
       CAST(support AS BIGINT) AS support FROM every""")
def classification_report(spark, d):
    report = counts.classification_report(judged_documents(spark, d), "quality", "guess")
    return report.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@R.add("accuracy", f"SELECT round(avg(CASE WHEN a = p THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*) AS support FROM ({SQL_JUDGED})")
def accuracy(spark, d):
    return counts.accuracy(judged_documents(spark, d), "quality", "guess").withColumn("accuracy", F.round("accuracy", 6))


@R.add("class_weights", """
SELECT lang, n, round((SELECT count(*) FROM documents WHERE lang IS NOT NULL) / (count(*) OVER () * n), 6) AS weight
FROM (SELECT lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang)""")
def class_weights(spark, d):
    return counts.class_weights(table(spark, d, "documents"), "lang").withColumn("weight", F.round("weight", 6))


@R.add("episode_rollup", """
WITH s AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step FROM events),
k AS (SELECT *, coalesce(max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY step
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM s)
SELECT user_id, round(sum(value), 4) AS total_reward, count(*) AS steps,
       count(*) FILTER (WHERE event_type = 'click') AS extracted, bool_or(event_type = 'purchase') AS succeeded
FROM k WHERE done = 0 GROUP BY user_id""")
def episode_rollup(spark, d):
    log = table(spark, d, "events").select(
        "user_id", "ts", "event_id", "value", (F.col("event_type") == "purchase").alias("saved"),
        (F.col("event_type") == "click").alias("extract"),
    )
    rolled = order.episode_rollup(log, "user_id", ["ts", "event_id"], "value", "saved", "extract")
    return rolled.withColumn("total_reward", F.round("total_reward", 4))


SQL_TRADES = ", ".join(f"'{x}'" for x in C.TRADE_LABELS)


@R.add("round_robin_label", f"""
SELECT o_orderkey, o_totalprice, [{SQL_TRADES}][(row_number() OVER (ORDER BY o_orderkey) - 1) % 12 + 1] AS category,
       CAST(0.9 AS DOUBLE) AS confidence FROM orders""")
def round_robin_label(spark, d):
    return order.round_robin_label(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey")


@R.add("category_codes", """
SELECT doc_id, source, CAST(coalesce(code, -1) AS INTEGER) AS category_encoded FROM documents LEFT JOIN
  (SELECT source, row_number() OVER (ORDER BY source) - 1 AS code FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL))
USING (source)""")
def category_codes(spark, d):
    return order.category_codes(table(spark, d, "documents").select("doc_id", "source"), "source")


@R.add("stratified_split", """
SELECT doc_id, lang, i < round(n * 0.2) AS is_test
FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id || ':42'), doc_id) - 1 AS i,
             count(*) OVER (PARTITION BY lang) AS n FROM documents WHERE lang IS NOT NULL)""")
def stratified_split(spark, d):
    return order.stratified_split(table(spark, d, "documents").select("doc_id", "lang"), "doc_id", "lang")


def score_rows(spark, d):
    """Embedding values as class scores, with one label per place."""
    rows = table(spark, d, "embeddings")
    labels = F.transform("embedding", lambda x, i: F.concat(F.lit("class_"), i))
    return rows.select("vec_id", F.col("embedding").cast("array<double>").alias("logits"), labels.alias("labels"))


SQL_SCORES = """SELECT vec_id, place, 'class_' || place AS label, x AS score,
       row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, place) AS rank
FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(0, len(embedding))) AS place FROM embeddings)"""


@R.add("rank_predictions", f"SELECT vec_id, CAST(rank AS INTEGER) AS rank, label, round(score, 6) AS score FROM ({SQL_SCORES})")
def rank_predictions(spark, d):
    ranked = score_rows(spark, d).select("vec_id", F.posexplode(S.ranked(F.col("labels"), F.col("logits"))).alias("r", "p"))
    return ranked.select("vec_id", (F.col("r") + 1).alias("rank"), "p.label", F.round("p.score", 6).alias("score"))


@R.add("top3_predictions", f"""
SELECT vec_id, string_agg(label, ', ' ORDER BY rank) AS top3, round(max(score), 6) AS confidence
FROM ({SQL_SCORES}) WHERE rank <= 3 GROUP BY vec_id""")
def top3_predictions(spark, d):
    ranked = score_rows(spark, d).select("vec_id", S.ranked(F.col("labels"), F.col("logits")).alias("r"))
    top = S.top_labels(F.col("r"))
    return ranked.select(
        "vec_id", F.array_join(F.transform(top, lambda p: p["label"]), ", ").alias("top3"),
        F.round(F.get("r", F.lit(0))["score"], 6).alias("confidence"),
    )


@R.add("softmax_argmax", f"""
SELECT vec_id, CAST(max(place) FILTER (WHERE rank = 1) AS INTEGER) AS predicted,
       round(1 / sum(exp(score - top)), 6) AS confidence
FROM (SELECT *, max(score) OVER (PARTITION BY vec_id) AS top FROM ({SQL_SCORES})) GROUP BY vec_id""")
def softmax_argmax(spark, d):
    rows = score_rows(spark, d).withColumn("p", S.softmax(F.col("logits")))
    return rows.select("vec_id", S.argmax(F.col("p")).alias("predicted"), F.round(F.array_max("p"), 6).alias("confidence"))


@R.add("round_conf", "SELECT l_orderkey, l_linenumber, round((1 - l_discount) * 0.9, 2) AS confidence FROM lineitem")
def round_conf(spark, d):
    value = S.round_confidence((1 - F.col("l_discount")) * 0.9)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", value.alias("confidence"))


@R.add("head_n", "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 10")
def head_n(spark, d):
    return filters.head_n(table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice"), "o_orderkey", 10)


# Fixed centres (price, quantity) for the assignment queries
CENTRES = [[20000.0, 10.0], [45000.0, 25.0], [80000.0, 40.0]]
SQL_DISTANCES = ", ".join(
    f"(l_extendedprice - {p}) * (l_extendedprice - {p}) + (l_quantity - {q}) * (l_quantity - {q})" for p, q in CENTRES
)
SQL_ASSIGNED = f"""SELECT l_orderkey, l_linenumber, l_extendedprice, l_quantity,
       CAST(list_position(dist, list_min(dist)) - 1 AS INTEGER) AS level_cluster
FROM (SELECT *, [{SQL_DISTANCES}] AS dist FROM lineitem)"""


def assigned_lines(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    return clusters.assign_centres(rows, ["l_extendedprice", "l_quantity"], CENTRES)


@R.add("assign_centres", f"SELECT l_orderkey, l_linenumber, level_cluster FROM ({SQL_ASSIGNED})")
def assign_centres(spark, d):
    return assigned_lines(spark, d).select("l_orderkey", "l_linenumber", "level_cluster")


@R.add("cluster_centres", f"""
SELECT level_cluster, count(*) AS n, round(avg(l_extendedprice), 4) AS l_extendedprice, round(avg(l_quantity), 4) AS l_quantity
FROM ({SQL_ASSIGNED}) GROUP BY level_cluster""")
def cluster_centres(spark, d):
    centres = clusters.cluster_centres(assigned_lines(spark, d), "level_cluster", ["l_extendedprice", "l_quantity"])
    return centres.withColumns({c: F.round(c, 4) for c in ("l_extendedprice", "l_quantity")})


@R.add("cluster_ranges", f"""
SELECT a.l_orderkey, a.l_linenumber, a.level_cluster, range_min, range_max,
       '₹' || format('{{:,.0f}}', range_min) || ' - ₹' || format('{{:,.0f}}', range_max) AS salary_range
FROM ({SQL_ASSIGNED}) a JOIN (SELECT level_cluster, min(l_extendedprice) AS range_min, max(l_extendedprice) AS range_max
  FROM ({SQL_ASSIGNED}) GROUP BY level_cluster) r USING (level_cluster)""")
def cluster_ranges(spark, d):
    rows = assigned_lines(spark, d).select("l_orderkey", "l_linenumber", "l_extendedprice", "level_cluster")
    return clusters.cluster_ranges(rows, "level_cluster", "l_extendedprice").drop("l_extendedprice")


DOC_CENTRES = [[150.0, 0.0], [900.0, 1.0], [6000.0, 1.0]]
SQL_DOC_DISTANCES = ", ".join(f"(n_chars - {p}) * (n_chars - {p}) + (quality - {q}) * (quality - {q})" for p, q in DOC_CENTRES)


@R.add("cluster_writeback", f"""
SELECT doc_id, level, CASE level WHEN 0 THEN 'junior' WHEN 1 THEN 'mid' WHEN 2 THEN 'senior' END AS level_name
FROM (SELECT doc_id, CASE WHEN quality IS NOT NULL THEN CAST(list_position(dist, list_min(dist)) - 1 AS INTEGER) END AS level
      FROM (SELECT *, [{SQL_DOC_DISTANCES}] AS dist FROM ({SQL_LABELLED})))""")
def cluster_writeback(spark, d):
    levelled = clusters.cluster_writeback(
        labelled_documents(spark, d), ["n_chars", "quality"], C.LEVELS_JUNIOR, DOC_CENTRES
    )
    return levelled.select("doc_id", "level", "level_name")


@R.add("zscore", """
SELECT l_orderkey, l_linenumber, round((l_quantity - mq) / sq, 4) AS l_quantity_z, round((l_extendedprice - mp) / sp, 4) AS l_extendedprice_z
FROM lineitem, (SELECT avg(l_quantity) AS mq, stddev_pop(l_quantity) AS sq, avg(l_extendedprice) AS mp, stddev_pop(l_extendedprice) AS sp FROM lineitem)""")
def zscore(spark, d):
    scaled = clusters.zscore(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"])
    return scaled.select(
        "l_orderkey", "l_linenumber", F.round("l_quantity_z", 4).alias("l_quantity_z"),
        F.round("l_extendedprice_z", 4).alias("l_extendedprice_z"),
    )


def scored_documents(spark, d):
    """Documents with a category where they carry a label, and two scores of their length."""
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    near = F.col("n_chars") / (F.col("n_chars") + 1000)
    return docs.select("doc_id", F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor").alias("category"),
                       F.array(F.lit("long"), F.lit("short")).alias("names"), F.array(near, 1 - near).alias("scores"))


@R.add("classified_only", "SELECT doc_id, CASE quality WHEN 1 THEN 'good' ELSE 'poor' END AS category FROM documents JOIN labels USING (doc_id) WHERE quality IN (0, 1)")
def classified_only(spark, d):
    """Documents without a category are left out."""
    return filters.classified_only(scored_documents(spark, d)).select("doc_id", "category")


@R.add("prediction_map", "SELECT doc_id, round(n_chars / (n_chars + 1000), 6) AS long, round(1 - n_chars / (n_chars + 1000), 6) AS short FROM documents")
def prediction_map(spark, d):
    """The ranked predictions as a map from label to score."""
    ranked = S.prediction(F.col("names"), F.col("scores"))["all_predictions"]
    rows = scored_documents(spark, d).select("doc_id", S.prediction_map(ranked).alias("m"))
    return rows.select("doc_id", *[F.round(F.col("m")[name], 6).alias(name) for name in ("long", "short")])


@R.add("filter_band_label", "SELECT o_orderkey, o_totalprice AS salary FROM orders WHERE o_orderpriority = '1-URGENT'")
def filter_band_label(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("salary"), F.col("o_orderpriority").alias("salary_band"))
    return filters.filter_band_label(rows, "1-URGENT").drop("salary_band")


@R.add("append_labelled", """
SELECT text, 'poor' AS label FROM documents JOIN labels USING (doc_id) WHERE quality = 0
UNION ALL SELECT text, 'good' FROM documents JOIN labels USING (doc_id) WHERE quality = 1""")
def append_labelled(spark, d):
    """Training texts appended class by class."""
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return lookup.append_labelled([(docs.where(F.col("quality") == 0), "poor"), (docs.where(F.col("quality") == 1), "good")])
