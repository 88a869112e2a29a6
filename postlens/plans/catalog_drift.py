"""Queries of the drift and monitoring operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from postlens.operators import drift, sketches
from postlens.operators.order import category_codes
from postlens.plans.registry import Registry, table, wide_table
from postlens.schemas import DRIFT_COLUMNS
from postlens.session import scratch_path, written

R = Registry()

# The first half of the month is the reference, the rest the current table
SPLIT = "TIMESTAMP '2024-01-16 00:00:00'"
EVENT_COLUMNS = ["value", "user_id", "event_code"]
EVENT_NUMBERS = ["value", "user_id"]


def event_frame(spark, d):
    events = table(spark, d, "events").select("event_id", "ts", "value", "user_id", "event_type")
    return category_codes(events, "event_type", name="event_code")


def event_values(spark, d):
    """Both sides of the event columns in one scan."""
    return drift.two_sided_by(event_frame(spark, d), EVENT_COLUMNS, F.expr(f"ts < {SPLIT}"))


SQL_EVENTS = """SELECT ts, value, user_id, code AS event_code FROM events JOIN
  (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS code FROM (SELECT DISTINCT event_type FROM events)) USING (event_type)"""
SQL_EVENT_LONG = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", CAST({c} AS DOUBLE) AS value, ts < {SPLIT} AS is_ref FROM ({SQL_EVENTS})""" for c in EVENT_COLUMNS
)


def sql_statistics(long: str, categorical: tuple[str, ...] = ("event_code", "category_encoded")) -> str:
    """CTEs from long(column, value, is_ref): values, gaps and one row of statistics per column."""
    named = ", ".join(f"'{c}'" for c in categorical)
    return f"""
long AS ({long}),
vals AS (SELECT "column", value, count(*) FILTER (WHERE is_ref) AS n_ref, count(*) FILTER (WHERE NOT is_ref) AS n_cur
         FROM long WHERE value IS NOT NULL GROUP BY "column", value),
sizes AS (SELECT "column", sum(n_ref) AS nr, sum(n_cur) AS nc, count(*) AS k, count(*) FILTER (WHERE n_ref > 0) AS k_ref FROM vals GROUP BY "column"),
gaps AS (SELECT "column", value, abs(sum(n_ref) OVER w / nr - sum(n_cur) OVER w / nc) AS gap,
                lead(value) OVER (PARTITION BY "column" ORDER BY value) AS next_value
         FROM vals JOIN sizes USING ("column")
         WINDOW w AS (PARTITION BY "column" ORDER BY value ROWS UNBOUNDED PRECEDING)),
spread AS (SELECT "column", stddev_pop(value) AS sd FROM long WHERE is_ref GROUP BY "column"),
ks AS (SELECT "column", max(gap) AS statistic FROM gaps GROUP BY "column"),
ws AS (SELECT "column", coalesce(sum(gap * (next_value - value)), 0) / max(greatest(sd, 0.001)) AS distance
       FROM gaps JOIN spread USING ("column") GROUP BY "column"),
chi AS (SELECT "column", sum(CASE WHEN n_ref > 0 THEN (n_cur - nc * n_ref / nr) * (n_cur - nc * n_ref / nr) / (nc * n_ref / nr) END) AS statistic,
               count(*) - 1 AS dof FROM vals JOIN sizes USING ("column") GROUP BY "column"),
js AS (SELECT "column", sqrt(greatest((sum(CASE WHEN n_ref > 0 THEN n_ref / nr * ln(2 * (n_ref / nr) / (n_ref / nr + n_cur / nc)) ELSE 0 END)
                     + sum(CASE WHEN n_cur > 0 THEN n_cur / nc * ln(2 * (n_cur / nc) / (n_ref / nr + n_cur / nc)) ELSE 0 END)) / 2, 0)) AS distance
       FROM vals JOIN sizes USING ("column") GROUP BY "column"),
scores AS (SELECT "column", CASE WHEN "column" IN ({named}) THEN 'jensen_shannon' ELSE 'wasserstein' END AS method,
                  CASE WHEN "column" IN ({named}) THEN js.distance ELSE ws.distance END AS score
           FROM sizes JOIN js USING ("column") JOIN ws USING ("column"))"""


SQL_EVENT_STATS = sql_statistics(SQL_EVENT_LONG)
# the alternating series with so many terms that it converges for any sample here
SQL_KS_P = """CASE WHEN statistic = 0 THEN 1.0 ELSE least(greatest(
  2 * list_sum([(CASE WHEN j % 2 = 1 THEN 1 ELSE -1 END) * exp(-2.0 * j * j * lam2) for j in range(1, 20000)]), 0.0), 1.0) END"""
# the regularised upper gamma function by the power series of its complement
SQL_CHI_P = """greatest(0.0, 1 - list_sum([exp(-x + (a + n) * ln(x) - lgamma(a + n + 1)) for n in range(0, 40000)]))"""


@R.add("drift_ks", f"""
WITH {SQL_EVENT_STATS}
SELECT "column", round(statistic, 6) AS statistic,
       round({SQL_KS_P}, 6) AS p_value
FROM (SELECT *, statistic * statistic * nr * nc / (nr + nc) AS lam2 FROM ks JOIN sizes USING ("column"))""")
def drift_ks(spark, d):
    found = drift.ks(event_values(spark, d))
    return found.withColumns({c: F.round(c, 6) for c in ("statistic", "p_value")})


@R.add("drift_wasserstein", f"""WITH {SQL_EVENT_STATS} SELECT "column", round(distance, 6) AS distance FROM ws""")
def drift_wasserstein(spark, d):
    values = event_values(spark, d)
    return drift.wasserstein(values, drift.reference_deviations(values)).withColumn("distance", F.round("distance", 6))


@R.add("drift_chi2", f"""WITH {SQL_EVENT_STATS} SELECT "column", round(statistic, 4) AS statistic, dof FROM chi""")
def drift_chi2(spark, d):
    return drift.chi_square(event_values(spark, d)).withColumn("statistic", F.round("statistic", 4))


@R.add("drift_js", f"""WITH {SQL_EVENT_STATS} SELECT "column", round(distance, 6) AS distance FROM js""")
def drift_js(spark, d):
    return drift.jensen_shannon(event_values(spark, d)).withColumn("distance", F.round("distance", 6))


@R.add("drift_dataset", f"""
WITH {SQL_EVENT_STATS}
SELECT count(*) AS columns, count(*) FILTER (WHERE score >= 0.1) AS drifted_columns,
       round(avg(CASE WHEN score >= 0.1 THEN 1.0 ELSE 0.0 END), 6) AS drift_share,
       avg(CASE WHEN score >= 0.1 THEN 1.0 ELSE 0.0 END) >= 0.5 AS dataset_drift FROM scores""")
def drift_dataset(spark, d):
    events, early = table(spark, d, "events"), F.expr(f"ts < {SPLIT}")
    found = drift.dataset_drift(drift.column_drift(
        drift.two_sided_by(events, EVENT_NUMBERS, early), drift.two_sided_by(events, ["event_type"], early, as_text=True)))
    return found.withColumn("drift_share", F.round("drift_share", 6))


def monitored(spark, d):
    """Documents as the reference table, conversation turns as the current one."""
    reference = wide_table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").select(
        "doc_id", "text", F.col("lang").alias("category"), F.col("quality").alias("confidence"),
        F.col("toxic").alias("scam_probability"),
    )
    current = wide_table(spark, d, "conversations").select("conv_id", "turn", "text", F.col("role").alias("category"))
    return reference, current


def monitored_features(spark, d):
    reference, current = monitored(spark, d)
    codes = drift.shared_codes(reference, current)
    return drift.drift_features(reference, codes=codes), drift.drift_features(current, codes=codes)


SQL_FEATURES = r"""
codes AS (SELECT category, row_number() OVER (ORDER BY category) - 1 AS code FROM
  (SELECT lang AS category FROM documents UNION SELECT role FROM conversations)),
ref AS (SELECT doc_id, CAST(length(text) AS DOUBLE) AS text_length, CAST(len(regexp_extract_all(text, '\S+')) AS DOUBLE) AS word_count,
               CAST(0 AS DOUBLE) AS compression_ratio, coalesce(CAST(quality AS DOUBLE), 0.0) AS confidence,
               coalesce(CAST(toxic AS DOUBLE), 0.0) AS scam_probability, CAST(code AS DOUBLE) AS category_encoded
        FROM documents LEFT JOIN labels USING (doc_id) JOIN codes ON lang = category),
cur AS (SELECT CAST(length(text) AS DOUBLE) AS text_length, CAST(len(regexp_extract_all(text, '\S+')) AS DOUBLE) AS word_count,
               CAST(0 AS DOUBLE) AS compression_ratio, CAST(0 AS DOUBLE) AS confidence, CAST(0 AS DOUBLE) AS scam_probability,
               CAST(code AS DOUBLE) AS category_encoded FROM conversations JOIN codes ON role = category)"""


@R.add("drift_features", f"WITH {SQL_FEATURES} SELECT * FROM ref")
def drift_features(spark, d):
    return monitored_features(spark, d)[0]


SQL_MONITORED = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", {c} AS value, {side} AS is_ref FROM {name}"""
    for c in DRIFT_COLUMNS for name, side in (("ref", "TRUE"), ("cur", "FALSE"))
)
SQL_SUMMARY = f"""
WITH {SQL_FEATURES}, {sql_statistics(SQL_MONITORED)}
SELECT "column", 'double' AS type, CAST(0 AS BIGINT) AS missing, (SELECT count(*) FROM cur) AS current_rows,
       (SELECT count(*) FROM ref) AS reference_rows, method, score >= 0.1 AS drifted,
       round(CASE WHEN score >= 0.1 THEN score END, 6) AS drift_score,
       (SELECT avg(CASE WHEN score >= 0.1 THEN 1.0 ELSE 0.0 END) >= 0.5 FROM scores) AS dataset_drift FROM scores"""


def summary(spark, d):
    reference, current = monitored_features(spark, d)
    found = drift.drift_summary(current, reference, categorical=["category_encoded"])
    return found.withColumn("drift_score", F.round("drift_score", 6))


@R.add("drift_summary", SQL_SUMMARY)
def drift_summary(spark, d):
    return summary(spark, d)


@R.add("drift_report", SQL_SUMMARY)
def drift_report(spark, d):
    """The summary written as a report and read back."""
    found = summary(spark, d)
    path = drift.write_drift_report(found, scratch_path(spark, "drift_report"), "report")
    return spark.read.schema(found.schema).json(path)


@R.add("drift_scores", f"""SELECT "column" AS "Column", drift_score AS "Drift Score" FROM ({SQL_SUMMARY}) WHERE drifted""")
def drift_scores(spark, d):
    return drift.drift_scores(summary(spark, d))


@R.add("drift_rollup", f"""
SELECT bool_or(dataset_drift) AS dataset_drift, string_agg("column", ', ' ORDER BY "column") FILTER (WHERE drifted) AS drift_columns,
       max(current_rows) AS current_rows, max(reference_rows) AS reference_rows, CAST(sum(missing) AS BIGINT) AS missing,
       round(max(drift_score), 6) AS top_score FROM ({SQL_SUMMARY})""")
def drift_rollup(spark, d):
    """The one-row summary, its lists and maps flattened."""
    rolled = drift.summary_rollup(summary(spark, d))
    quality = F.col("data_quality")
    total = F.aggregate(F.map_values(quality["missing_values"]), F.lit(0).cast("bigint"), lambda acc, n: acc + n)
    return rolled.select(
        "dataset_drift", F.array_join("drift_columns", ", ").alias("drift_columns"), quality["current_rows"].alias("current_rows"),
        quality["reference_rows"].alias("reference_rows"), total.alias("missing"),
        F.array_max(F.map_values("drift_scores")).alias("top_score"),
    )


@R.add("drift_tests", f"""
WITH {SQL_FEATURES}, {sql_statistics(SQL_MONITORED)},
tests AS (
  SELECT "column", 'ks' AS method, {SQL_KS_P} AS p
  FROM (SELECT *, statistic * statistic * nr * nc / (nr + nc) AS lam2 FROM ks JOIN sizes USING ("column")) WHERE "column" <> 'category_encoded'
  UNION ALL
  SELECT "column", 'chi_square', {SQL_CHI_P} FROM (SELECT "column", statistic / 2 AS x, dof / 2.0 AS a FROM chi) WHERE "column" = 'category_encoded')
SELECT "column", method, round(p, 6) AS score, p < 0.05 AS drifted FROM tests""")
def drift_tests(spark, d):
    """The test of every monitored column with its decision."""
    reference, current = monitored_features(spark, d)
    found = drift.drift_between(reference, current, DRIFT_COLUMNS, ["category_encoded"], "test")
    return found.withColumn("score", F.round("score", 6))


def labelled_and_not(spark, d):
    """Labelled documents as the reference, the others as the current table."""
    docs, labels = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars"), table(spark, d, "labels").select("doc_id")
    return docs.join(labels, "doc_id", "left_semi"), docs.join(labels, "doc_id", "left_anti")


SQL_TOLD = "SELECT *, doc_id IN (SELECT doc_id FROM labels) AS is_ref FROM documents"
SQL_MIXED_NAMES = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", dense_rank() OVER (ORDER BY {c})::DOUBLE AS value, is_ref FROM ({SQL_TOLD})""" for c in ("lang", "source"))


@R.add("drift_mixed", f"""
WITH {sql_statistics(SQL_MIXED_NAMES + f""" UNION ALL SELECT 'n_chars', n_chars::DOUBLE, is_ref FROM ({SQL_TOLD})""", ("lang", "source"))}
SELECT "column", method, round(score, 6) AS score, score >= 0.1 AS drifted FROM scores""")
def drift_mixed(spark, d):
    """Drift of text and number columns together."""
    reference, current = labelled_and_not(spark, d)
    return drift.drift_between(reference, current, ["lang", "source", "n_chars"]).withColumn("score", F.round("score", 6))


@R.add("drift_reference", f"WITH {SQL_FEATURES} SELECT * FROM ref")
def drift_reference(spark, d):
    """A stored reference snapshot, loaded again."""
    reference, _ = monitored_features(spark, d)
    return drift.load_reference(spark, drift.save_reference(reference, scratch_path(spark, "reference")))


@R.add("drift_by_window", f"""
WITH fixed AS (SELECT value FROM events WHERE ts < {SPLIT} AND value IS NOT NULL),
cur AS (SELECT date_trunc('day', ts) AS window_start, value, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1, 2),
days AS (SELECT DISTINCT window_start FROM cur),
vals AS (SELECT value, count(*) AS n_ref FROM fixed GROUP BY value),
points AS (SELECT window_start, value FROM days CROSS JOIN vals UNION SELECT window_start, value FROM cur),
run AS (SELECT window_start, sum(coalesce(n_ref, 0)) OVER w AS r, sum(coalesce(n, 0)) OVER w AS c,
               sum(coalesce(n, 0)) OVER (PARTITION BY window_start) AS cur_rows
        FROM points LEFT JOIN vals USING (value) LEFT JOIN cur USING (window_start, value)
        WINDOW w AS (PARTITION BY window_start ORDER BY value ROWS UNBOUNDED PRECEDING))
SELECT window_start, CAST(max(cur_rows) AS BIGINT) AS cur_rows,
       round(max(abs(r / (SELECT count(*) FROM fixed) - c / cur_rows)), 6) AS statistic
FROM run GROUP BY window_start""")
def drift_by_window(spark, d):
    events = table(spark, d, "events").select("ts", "value")
    reference = events.where(F.expr(f"ts < {SPLIT}"))
    found = drift.drift_by_window(events, "ts", "value", reference, "1 day")
    return found.withColumn("statistic", F.round("statistic", 6))


SKETCHED = ["l_quantity", "l_extendedprice", "l_discount"]


@R.add("sketch_quantiles")
def sketch_quantiles(spark, d):
    """Quartiles and tails of the lines' numbers by flag, and over all flags from the merged sketches."""
    by_flag = written(sketches.sketch_columns(table(spark, d, "lineitem"), SKETCHED, ["l_returnflag"]), "sketches")
    whole = sketches.merged(by_flag).select(F.lit("all").alias("l_returnflag"), "column", "sketch")
    return sketches.sketch_quantiles(by_flag.unionByName(whole), [0.01, 0.25, 0.5, 0.75, 0.99])


@R.add("sketch_drift")
def sketch_drift(spark, d):
    """How far the distributions of returned lines lie from those of the others, from sketches."""
    lines = table(spark, d, "lineitem")
    sides = [sketches.sketch_columns(lines.where(c), SKETCHED) for c in (F.col("l_returnflag") != "R", F.col("l_returnflag") == "R")]
    return sketches.sketch_gap(*sides)
