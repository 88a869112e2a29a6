"""Queries of the text, parsing and signal functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from postlens import constants as C
from postlens.functions import parse, signals, text as X
from postlens.operators import mentions, tagger, terms
from postlens.operators.scaling import unrolled
from postlens.plans.registry import Registry, table, wide_table

R = Registry()

# SQL pieces of the oracles
SQL_LIGHT = r"trim(lower(regexp_replace(text, '\s+', ' ', 'g')))"
SQL_CLEAN = (
    rf"trim(regexp_replace(regexp_replace({SQL_LIGHT}, '[^\p{{L}}\p{{N}}_\s.,!?-]', ' ', 'g'), "
    r"'\s+([.,!?-])\s+', '\1 ', 'g'))"
)
SQL_STRIP = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
SQL_STOPS = ", ".join(f"'{w}'" for w in C.STOP_WORDS)
SQL_SENTENCES = (
    rf"list_filter(list_transform(regexp_extract_all(text, '[^.!?]+[.!?]*'), lambda s: trim(s, {SQL_STRIP})), lambda s: s <> '')"
)


def documents(spark, d):
    return wide_table(spark, d, "documents")


@R.add("clean_text", f"SELECT doc_id, {SQL_CLEAN} AS clean FROM documents")
def clean_text(spark, d):
    return documents(spark, d).select("doc_id", X.clean_text(F.col("text")).alias("clean"))


@R.add("clean_light", f"SELECT doc_id, {SQL_LIGHT} AS clean FROM documents")
def clean_light(spark, d):
    return documents(spark, d).select("doc_id", X.clean_light(F.col("text")).alias("clean"))


@R.add("clean_min", f"SELECT doc_id, trim(lower(text), {SQL_STRIP}) AS clean FROM documents")
def clean_min(spark, d):
    return documents(spark, d).select("doc_id", X.clean_min(F.col("text")).alias("clean"))


@R.add("strip_stopwords", f"""
SELECT doc_id, array_to_string(list_filter(string_split({SQL_CLEAN}, ' '),
       lambda w: w <> '' AND w NOT IN ({SQL_STOPS})), ' ') AS clean FROM documents""")
def strip_stopwords(spark, d):
    return documents(spark, d).select("doc_id", X.strip_stopwords(F.col("text")).alias("clean"))


@R.add("text_stats", r"""
SELECT doc_id, CAST(length(text) AS INTEGER) AS text_length,
       CAST(len(regexp_extract_all(text, '\S+')) AS INTEGER) AS word_count FROM documents""")
def text_stats(spark, d):
    return documents(spark, d).select(
        "doc_id", X.text_length(F.col("text")).alias("text_length"), X.word_count(F.col("text")).alias("word_count")
    )


@R.add("title_preview", "SELECT doc_id, substring(text, 1, 50) AS preview FROM documents")
def title_preview(spark, d):
    return documents(spark, d).select("doc_id", X.preview(F.col("text"), C.PREVIEW_CHARS).alias("preview"))


@R.add("combine_text", """
SELECT p_partkey, coalesce(p_name, '') || ' ' || coalesce(p_type, '') AS combined FROM part""")
def combine_text(spark, d):
    return table(spark, d, "part").select("p_partkey", X.combine(F.col("p_name"), F.col("p_type")).alias("combined"))


@R.add("chunk_text", """
SELECT doc_id, CAST(i AS INTEGER) AS pos, substring(text, CAST(i * 1024 + 1 AS BIGINT), 1024) AS chunk
FROM (SELECT doc_id, text, unnest(range(0, CAST(ceil(length(text) / 1024.0) AS BIGINT))) AS i FROM documents)""")
def chunk_text(spark, d):
    return unrolled(documents(spark, d), ["doc_id"], X.chunks(F.col("text")), "pos", "chunk")


@R.add("nested_get", """
SELECT event_id, coalesce(CAST(json_extract_string(props, '$.k') AS DOUBLE), 0.0) AS k,
       coalesce(TRY_CAST(json_extract_string(props, '$.missing') AS DOUBLE), 0.0) AS missing FROM events""")
def nested_get(spark, d):
    return table(spark, d, "events").select(
        "event_id", signals.nested_number(F.col("props"), "$.k").alias("k"),
        signals.nested_number(F.col("props"), "$.missing").alias("missing"),
    )


@R.add("experience_level", """
SELECT l_orderkey, l_linenumber,
       CASE WHEN l_quantity < 2 THEN 'entry' WHEN l_quantity < 5 THEN 'mid' ELSE 'senior' END AS experience_level
FROM lineitem""")
def experience_level(spark, d):
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", signals.experience_level(F.col("l_quantity")).alias("experience_level")
    )


@R.add("risk_tier", """
SELECT l_orderkey, l_linenumber, CASE WHEN l_discount * 10 > 0.7 THEN 'red'
       WHEN l_discount * 10 > 0.3 THEN 'orange' ELSE 'green' END AS risk FROM lineitem""")
def risk_tier(spark, d):
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", signals.risk_tier(F.col("l_discount") * 10).alias("risk")
    )


SQL_TRADE = "CASE l_returnflag WHEN 'A' THEN 'computer operator' WHEN 'N' THEN 'driver' ELSE 'security guard' END"


@R.add("display_title", """
SELECT l_orderkey, l_linenumber, CASE WHEN l_tax > 0.05 THEN '⚠️ ' || title || ' - Potential Scam!' ELSE title END AS title
FROM (SELECT *, CASE l_returnflag WHEN 'A' THEN 'Computer Operator' WHEN 'N' THEN 'Driver' ELSE 'Security Guard' END
      || ' (Confidence: ' || printf('%.2f', (1 - l_discount) * 100) || '%)' AS title FROM lineitem)""")
def display_title(spark, d):
    rows = table(spark, d, "lineitem")
    title = signals.display_title(F.expr(SQL_TRADE), 1 - F.col("l_discount"), F.col("l_tax") > 0.05)
    return rows.select("l_orderkey", "l_linenumber", title.alias("title"))


# Salary and experience texts spelled from order columns, valid in both engines
SQL_N = "CAST(floor(o_totalprice / 1000) AS BIGINT)"
SALARY_TEXT = f"""CASE o_orderpriority
  WHEN '1-URGENT' THEN CAST(floor(o_totalprice / 100000) AS BIGINT) || '.5-' || CAST(floor(o_totalprice / 50000) AS BIGINT) || ' Lacs PA'
  WHEN '2-HIGH' THEN {SQL_N} || 'k'
  WHEN '3-MEDIUM' THEN {SQL_N} || ',000 a month'
  WHEN '4-NOT SPECIFIED' THEN 'Not specified'
  ELSE {SQL_N} || ' per week' END"""
EXPERIENCE_TEXT = """CASE o_orderstatus
  WHEN 'F' THEN (o_custkey % 7) || '-' || (o_custkey % 7 + 3) || ' Yrs'
  WHEN 'O' THEN (o_custkey % 9) || '+ years'
  ELSE 'Not specified' END"""
RUPEE_TEXT = f"""CASE o_orderpriority
  WHEN '1-URGENT' THEN '₹' || {SQL_N} || ',000 - ₹' || ({SQL_N} + 7) || ',501'
  WHEN '2-HIGH' THEN '₹' || {SQL_N} || ',000'
  WHEN '3-MEDIUM' THEN {SQL_N} || 'k'
  WHEN '4-NOT SPECIFIED' THEN 'Not Mentioned'
  ELSE CASE o_orderstatus WHEN 'F' THEN 'negotiable' WHEN 'O' THEN '.5k' ELSE '' END END"""
RANGE_TEXT = f"""CASE o_orderpriority
  WHEN '1-URGENT' THEN 'Salary: $' || {SQL_N} || ',000 - $' || ({SQL_N} + 1) || ',500.50 per year'
  WHEN '2-HIGH' THEN {SQL_N} || ',000 to ' || ({SQL_N} + 1) || ',000 per month'
  WHEN '3-MEDIUM' THEN 'salary: ' || {SQL_N} || '-' || ({SQL_N} + 1)
  WHEN '4-NOT SPECIFIED' THEN 'pay ' || {SQL_N} || ' per week'
  ELSE '$' || {SQL_N} || ' - $' || o_custkey || ' yearly' END"""


@R.add("parse_salary_lakh", f"""
SELECT o_orderkey, coalesce(CASE WHEN lakh THEN TRY_CAST(digits AS DOUBLE) * 100
         WHEN contains(low, 'k') THEN TRY_CAST(digits AS DOUBLE) END, 0.0) AS compat,
       round(coalesce(CASE WHEN lakh THEN mid * 100 WHEN regexp_matches(low, '\\d\\s*k\\b') THEN mid END, 0.0), 6) AS clean
FROM (SELECT *, (TRY_CAST(nums[1] AS DOUBLE) + coalesce(TRY_CAST(nums[2] AS DOUBLE), TRY_CAST(nums[1] AS DOUBLE))) / 2 AS mid
      FROM (SELECT o_orderkey, low, regexp_replace(low, '[^0-9]', '', 'g') AS digits,
                   contains(low, 'lacs') OR contains(low, 'lakh') AS lakh,
                   regexp_extract_all(low, '\\d+(?:\\.\\d+)?') AS nums
            FROM (SELECT o_orderkey, lower({SALARY_TEXT}) AS low FROM orders)))""")
def parse_salary_lakh(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.expr(SALARY_TEXT).alias("t"))
    return rows.select(
        "o_orderkey", parse.salary_lakh(F.col("t")).alias("compat"),
        F.round(parse.salary_lakh(F.col("t"), "clean"), 6).alias("clean"),
    )


@R.add("parse_experience_compact", f"""
SELECT o_orderkey, coalesce(TRY_CAST(regexp_replace(first, '[^0-9]', '', 'g') AS DOUBLE), 0.0) AS compat,
       coalesce(TRY_CAST(regexp_extract(first, '\\d+') AS DOUBLE), 0.0) AS clean
FROM (SELECT o_orderkey, string_split({EXPERIENCE_TEXT}, ' ')[1] AS first FROM orders)""")
def parse_experience_compact(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.expr(EXPERIENCE_TEXT).alias("t"))
    return rows.select(
        "o_orderkey", parse.experience_compact(F.col("t")).alias("compat"),
        parse.experience_compact(F.col("t"), "clean").alias("clean"),
    )


@R.add("parse_salary_mid", f"""
SELECT o_orderkey, CASE WHEN t = '' OR contains(t, 'Not Mentioned') THEN NULL
  WHEN regexp_matches(p, '^\\d') THEN (lo + coalesce(hi, lo)) // 2
  WHEN contains(p, 'k') THEN CAST(trunc(TRY_CAST(replace(p, 'k', '') AS DOUBLE) * 1000) AS BIGINT)
  ELSE TRY_CAST(nullif(p, '') AS BIGINT) END AS salary
FROM (SELECT *, TRY_CAST(nullif(regexp_extract(p, '^(\\d+)(?:\\s*-\\s*(\\d+))?', 1), '') AS BIGINT) AS lo,
             TRY_CAST(nullif(regexp_extract(p, '^(\\d+)(?:\\s*-\\s*(\\d+))?', 2), '') AS BIGINT) AS hi
      FROM (SELECT o_orderkey, t, lower(trim(replace(replace(t, '₹', ''), ',', ''))) AS p
            FROM (SELECT o_orderkey, {RUPEE_TEXT} AS t FROM orders)))""")
def parse_salary_mid(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.expr(RUPEE_TEXT).alias("t"))
    return rows.select("o_orderkey", parse.salary_midpoint(F.col("t")).alias("salary"))


@R.add("parse_experience_first", r"""
SELECT doc_id, CASE WHEN coalesce(text, '') = '' OR contains(text, 'Fresher') THEN 0
       ELSE TRY_CAST(nullif(regexp_extract(text, '\d+'), '') AS BIGINT) END AS experience FROM documents""")
def parse_experience_first(spark, d):
    return documents(spark, d).select("doc_id", parse.experience_first(F.col("text")).alias("experience"))


def _sql_amount(group: int) -> str:
    tried = ", ".join(f"nullif(regexp_extract(low, '{p}', {group}), '')" for p in C.SALARY_PATTERNS)
    return f"TRY_CAST(replace(coalesce({tried}), ',', '') AS DOUBLE)"


@R.add("salary_range", f"""
SELECT o_orderkey, {_sql_amount(1)} AS min_salary, {_sql_amount(2)} AS max_salary,
       CASE WHEN {_sql_amount(1)} IS NOT NULL THEN 'USD' END AS currency,
       CASE WHEN {_sql_amount(1)} IS NULL THEN NULL WHEN contains(low, 'year') THEN 'year' ELSE 'month' END AS period
FROM (SELECT o_orderkey, lower({RANGE_TEXT}) AS low FROM orders)""")
def salary_range(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.expr(RANGE_TEXT).alias("t"))
    return rows.select("o_orderkey", parse.salary_range(F.col("t")).alias("s")).select("o_orderkey", "s.*")


# RE2 knows ASCII word edges only, so the oracle states the edges as characters
SQL_EDGE = r"(?:^|[^\p{L}\p{N}_])"
SQL_PHONE = (
    rf"{SQL_EDGE}(\d{{3}}\)?[-.\s]?\d{{3}}[-.\s]?\d{{4}})(?:[^\p{{L}}\p{{N}}_]|$)"
)


@R.add("contacts", rf"""
SELECT doc_id, nullif(regexp_extract(text, '[\p{{L}}\p{{N}}_.-]+@[\p{{L}}\p{{N}}_.-]+'), '') AS email,
       nullif(regexp_extract(text, '{SQL_PHONE}', 1), '') AS phone FROM documents""")
def contacts(spark, d):
    return documents(spark, d).select("doc_id", signals.contacts(F.col("text")).alias("c")).select("doc_id", "c.*")


# trigger words that occur in the test texts
TEST_TRIGGERS = [
    r"\b(?:the|and)\s+([^.,]+)",
    r"\b(?:que|und|with)\s+([^.,]+)",
]


def _sql_skill(trigger: str) -> str:
    return f"regexp_extract_all(low, '{trigger.replace(chr(92) + 'b', SQL_EDGE)}', 1)"


def sql_skills(patterns) -> str:
    return f"""
SELECT doc_id, CAST(len(found) AS INTEGER) AS n, array_to_string(found, '|') AS skills
FROM (SELECT doc_id, list_transform(list_filter(list_zip(every, range(1, len(every) + 1)),
               lambda p: list_position(every, p[1]) = p[2]), lambda p: p[1]) AS found
      FROM (SELECT doc_id, list_transform(list_concat({', '.join(map(_sql_skill, patterns))}),
                                         lambda s: trim(s, {SQL_STRIP})) AS every
            FROM (SELECT doc_id, lower(text) AS low FROM documents)))"""


@R.add("skills", sql_skills(TEST_TRIGGERS))
def skills(spark, d):
    found = signals.skills(F.col("text"), TEST_TRIGGERS)
    return documents(spark, d).select("doc_id", found.alias("s")).select(
        "doc_id", F.size("s").alias("n"), F.array_join("s", "|").alias("skills")
    )


TEST_PHRASES = [*C.SUSPICIOUS_PHRASES, "license", "token", "that the", "und"]
SQL_PHRASES = " + ".join(f"CAST(contains(low, '{p}') AS INTEGER)" for p in TEST_PHRASES)
SQL_FEATURES = rf"""
SELECT doc_id, CAST(length(low) AS INTEGER) AS length,
       regexp_matches(low, '[\p{{L}}\p{{N}}_.-]+@[\p{{L}}\p{{N}}_.-]+') AS has_email,
       regexp_matches(low, '(^|[^\p{{L}}\p{{N}}_])\d{{10}}($|[^\p{{L}}\p{{N}}_])') AS has_phone,
       regexp_matches(low, 'https?://[a-z0-9$-_@.&+!*(),%]') AS has_url,
       {SQL_PHRASES} AS suspicious_word_count,
       regexp_matches(low, '{C.COMPANY_PATTERN}') AS has_company_name,
       regexp_matches(low, '{C.LOCATION_PATTERN}') AS has_location
FROM (SELECT doc_id, lower(text) AS low FROM documents)"""


@R.add("scam_features", SQL_FEATURES)
def scam_features(spark, d):
    features = signals.scam_features(F.col("text"), TEST_PHRASES)
    return documents(spark, d).select("doc_id", features.alias("f")).select("doc_id", "f.*")


@R.add("suspicious_indicators", f"""
SELECT doc_id, array_to_string(list_filter([
  CASE WHEN has_email THEN 'Has Email' END, CASE WHEN has_phone THEN 'Has Phone' END,
  CASE WHEN has_url THEN 'Has Url' END, CASE WHEN suspicious_word_count > 0 THEN 'Suspicious Word Count' END,
  CASE WHEN has_company_name THEN 'Has Company Name' END, CASE WHEN has_location THEN 'Has Location' END],
  lambda x: x IS NOT NULL), ', ') AS indicators FROM ({SQL_FEATURES})""")
def suspicious_indicators(spark, d):
    features = signals.scam_features(F.col("text"), TEST_PHRASES)
    rows = documents(spark, d).select("doc_id", features.alias("f"))
    return rows.select("doc_id", F.array_join(signals.suspicious_indicators(F.col("f")), ", ").alias("indicators"))


SQL_TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')"


def sql_tfidf(counts: str, vocabulary: str) -> str:
    """Weights from CTE bodies of counts(doc_id, term, tf) and kept terms(term, df)."""
    return f"""
WITH counts AS ({counts}),
     terms AS ({vocabulary}),
     raw AS (SELECT doc_id, term, tf, tf * (ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + df)) + 1) AS w
             FROM counts JOIN terms USING (term)),
     norms AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM raw GROUP BY doc_id)
SELECT doc_id, term, tf, round(w / norm, 6) AS tfidf FROM raw JOIN norms USING (doc_id)"""


SQL_COUNTS = f"""SELECT doc_id, term, count(*) AS tf
      FROM (SELECT doc_id, unnest({SQL_TOKENS}) AS term FROM documents) GROUP BY doc_id, term"""


@R.add("tfidf", sql_tfidf(SQL_COUNTS, "SELECT term, count(*) AS df FROM counts GROUP BY term"))
def tfidf(spark, d):
    return terms.tfidf(documents(spark, d), "doc_id").withColumn("tfidf", F.round("tfidf", 6))


def sql_bigram_counts(tokens: str) -> str:
    return f"""SELECT doc_id, term, count(*) AS tf
      FROM (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1]))) AS term
            FROM (SELECT doc_id, {tokens} AS w FROM documents)) GROUP BY doc_id, term"""


SQL_KEPT = f"list_filter({SQL_TOKENS}, lambda w: w NOT IN ({SQL_STOPS}))"


@R.add("tfidf_ngrams", sql_tfidf(
    sql_bigram_counts(SQL_KEPT),
    """SELECT term, df FROM (SELECT term, count(*) AS df, sum(tf) AS total FROM counts GROUP BY term)
       WHERE df >= 2 AND df <= 0.95 * (SELECT count(*) FROM documents) ORDER BY total DESC, term LIMIT 5000""",
))
def tfidf_ngrams(spark, d):
    weights = terms.tfidf(
        documents(spark, d), "doc_id", ngram_max=2, stop_words=C.STOP_WORDS, max_features=5000, min_df=2, max_df=0.95
    )
    return weights.withColumn("tfidf", F.round("tfidf", 6))


SQL_TOP_1000 = """SELECT term, df FROM (SELECT term, count(*) AS df, sum(tf) AS total FROM counts GROUP BY term)
       ORDER BY total DESC, term LIMIT 1000"""


@R.add("tfidf_bigrams", sql_tfidf(sql_bigram_counts(SQL_TOKENS), "SELECT term, count(*) AS df FROM counts GROUP BY term"))
def tfidf_bigrams(spark, d):
    return terms.tfidf(documents(spark, d), "doc_id", ngram_max=2).withColumn("tfidf", F.round("tfidf", 6))


@R.add("tfidf_bigrams_1000", sql_tfidf(sql_bigram_counts(SQL_KEPT), SQL_TOP_1000))
def tfidf_bigrams_1000(spark, d):
    weights = terms.tfidf(documents(spark, d), "doc_id", ngram_max=2, stop_words=C.STOP_WORDS, max_features=1000)
    return weights.withColumn("tfidf", F.round("tfidf", 6))


@R.add("tfidf_1000", sql_tfidf(SQL_COUNTS, SQL_TOP_1000))
def tfidf_1000(spark, d):
    return terms.tfidf(documents(spark, d), "doc_id", max_features=1000).withColumn("tfidf", F.round("tfidf", 6))


@R.add("vocabulary_head", f"""
WITH counts AS ({SQL_COUNTS}), terms AS (SELECT term, count(*) AS df FROM counts GROUP BY term)
SELECT term, df, (SELECT count(*) FROM terms) AS size FROM terms ORDER BY term LIMIT 10""")
def vocabulary_head(spark, d):
    docs = documents(spark, d)
    counts = (terms.term_counts if terms.repeats(docs, "doc_id") else terms.counted_rows)(docs, "doc_id")
    fitted = terms.vocabulary(counts, docs.agg(F.count("*").alias("n")))
    return terms.vocabulary_head(fitted)


@R.add("display_fields", """
SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, printf('%.1f', (event_id % 8) / 8.0 * 100) || '%' AS share FROM events""")
def display_fields(spark, d):
    share = F.col("event_id") % 8 / 8
    return table(spark, d, "events").select(
        "event_id", signals.time_text(F.col("ts").cast("timestamp")).alias("at"), signals.percent(share).alias("share")
    )


def gazetteer(spark, d):
    """Names for the entity queries: link texts of the pages with a word, nation and region names."""
    from postlens.sources.html import html_links

    word = html_links(wide_table(spark, d, "pages")).select(F.col("text").alias("phrase")).where(
        F.col("phrase").rlike(r"[\p{L}\p{N}_]")).distinct()
    kind = F.when(F.col("phrase").rlike(r"^\p{Lu}"), "GPE").otherwise("ORG")
    places = table(spark, d, "nation").select(F.col("n_name").alias("phrase"), F.lit("GPE").alias("kind"))
    regions = table(spark, d, "region").select(F.col("r_name").alias("phrase"), F.lit("GPE").alias("kind"))
    return word.select("phrase", kind.alias("kind")).unionByName(places).unionByName(regions)


SQL_GAZETTEER = r"""
links AS (SELECT trim(unnest(regexp_extract_all(html, '(?s)<a\s[^>]*>(.*?)</a>', 1))) AS phrase FROM pages),
gazetteer AS (
  SELECT array_to_string(regexp_extract_all(phrase, '[\p{L}\p{N}_]+'), ' ') AS phrase,
         CASE WHEN regexp_matches(phrase, '^\p{Lu}') THEN 'GPE' ELSE 'ORG' END AS kind
  FROM links WHERE regexp_matches(phrase, '[\p{L}\p{N}_]')
  UNION SELECT array_to_string(regexp_extract_all(n_name, '[\p{L}\p{N}_]+'), ' '), 'GPE' FROM nation
  UNION SELECT array_to_string(regexp_extract_all(r_name, '[\p{L}\p{N}_]+'), ' '), 'GPE' FROM region)"""
# every run of words up to the length of the longest name
SQL_RUNS = """SELECT {0}, pos, array_to_string(w[pos:pos + n - 1], ' ') AS phrase
          FROM (SELECT {0}, w, unnest(range(1, len(w) + 1)) AS pos FROM cut),
               (SELECT unnest(range(1, 1 + (SELECT max(len(string_split(phrase, ' '))) FROM gazetteer))) AS n)
          WHERE pos + n - 1 <= len(w)"""
SQL_WORDS = r"regexp_extract_all({0}, '[\p{{L}}\p{{N}}_]+')"


@R.add("entities", f"""
WITH {SQL_GAZETTEER},
cut AS (SELECT doc_id, {SQL_WORDS.format('text')} AS w FROM documents),
words AS ({SQL_RUNS.format('doc_id')}),
hits AS (SELECT doc_id, pos, phrase, kind FROM words JOIN gazetteer USING (phrase)),
lists AS (SELECT doc_id, string_agg(phrase, '|' ORDER BY pos, phrase) FILTER (WHERE kind = 'GPE') AS locations,
                 string_agg(phrase, '|' ORDER BY pos, phrase) FILTER (WHERE kind = 'ORG') AS organizations
          FROM hits GROUP BY doc_id)
SELECT d.doc_id, coalesce(locations, '') AS locations, coalesce(organizations, '') AS organizations,
       array_to_string(regexp_extract_all(text, '{mentions.DATE}'), '|') AS dates,
       array_to_string(regexp_extract_all(text, '{mentions.MONEY}'), '|') AS money
FROM documents d LEFT JOIN lists USING (doc_id)""")
def entities(spark, d):
    found = mentions.entities(documents(spark, d), "doc_id", gazetteer(spark, d))
    return found.select("doc_id", *[F.array_join(c, "|").alias(c) for c in found.columns if c != "doc_id"])


@R.add("entities_tagged")
def entities_tagged(spark, d):
    """Names found by form and neighbours, by a tagger trained on the texts as the gazetteer marks them."""
    docs = documents(spark, d)
    found = tagger.tagged_names(docs, tagger.train_tagger(docs, gazetteer(spark, d), "doc_id"))
    return found.select("doc_id", F.array_join("locations", "|").alias("locations"), F.array_join("organizations", "|").alias("organizations"))


@R.add("key_points", f"""
WITH {SQL_GAZETTEER},
cut AS (SELECT doc_id, unnest(s) AS sentence, unnest(range(1, len(s) + 1)) AS place
        FROM (SELECT doc_id, {SQL_SENTENCES} AS s FROM documents)),
named AS (SELECT DISTINCT doc_id, place
          FROM ({SQL_RUNS.format('doc_id, place').replace('FROM cut', "FROM (SELECT doc_id, place, " + SQL_WORDS.format('sentence') + " AS w FROM cut)")})
          JOIN gazetteer USING (phrase)
          UNION SELECT doc_id, place FROM cut WHERE regexp_matches(sentence, '{mentions.DATE}|{mentions.MONEY}'))
SELECT doc_id, CAST(rank AS INTEGER) AS rank, sentence
FROM (SELECT doc_id, sentence, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS rank
      FROM cut SEMI JOIN named USING (doc_id, place)) WHERE rank <= 5""")
def key_points(spark, d):
    return mentions.key_points(documents(spark, d), "doc_id", gazetteer(spark, d))


@R.add("summarize", rf"""
WITH cut AS (SELECT doc_id, i, substring(text, CAST(i * 1024 + 1 AS BIGINT), 1024) AS c
             FROM (SELECT doc_id, text, unnest(range(0, CAST(ceil(length(text) / 1024.0) AS BIGINT))) AS i FROM documents)),
heads AS (SELECT doc_id, i, array_to_string(list_slice(regexp_extract_all(c, '\S+'), 1, 100), ' ') AS head FROM cut),
leads AS (SELECT doc_id, i, head, regexp_extract(head, '(?s)^(.*[.!?])(?:\s|$)', 1) AS lead FROM heads),
parts AS (SELECT doc_id, i, CASE WHEN len(regexp_extract_all(lead, '\S+')) >= 30 THEN lead ELSE head END AS part FROM leads),
joined AS (SELECT doc_id, string_agg(part, ' ' ORDER BY i) AS summary FROM parts WHERE part <> '' GROUP BY doc_id)
SELECT d.doc_id, coalesce(summary, '') AS summary, CAST(length(text) AS INTEGER) AS original_length,
       CAST(length(coalesce(summary, '')) AS INTEGER) AS summary_length,
       CASE WHEN length(text) > 0 THEN round(length(coalesce(summary, '')) / length(text), 6) ELSE 0.0 END AS compression_ratio
FROM documents d LEFT JOIN joined USING (doc_id)""")
def summarize(spark, d):
    return mentions.summarize(documents(spark, d).select("doc_id", "text")).drop("text").withColumn(
        "compression_ratio", F.round("compression_ratio", 6)
    )


SQL_ALL_WEIGHTS = sql_tfidf(SQL_COUNTS, "SELECT term, count(*) AS df FROM counts GROUP BY term").replace(
    "round(w / norm, 6)", "w / norm"
)


@R.add("summarize_central", f"""
WITH weights AS ({SQL_ALL_WEIGHTS}),
cut AS (SELECT doc_id, i, substring(text, CAST(i * 1024 + 1 AS BIGINT), 1024) AS text
        FROM (SELECT doc_id, text, unnest(range(0, CAST(ceil(length(text) / 1024.0) AS BIGINT))) AS i FROM documents)),
lines AS (SELECT doc_id, i, unnest(s) AS sentence, unnest(range(1, len(s) + 1)) AS place
          FROM (SELECT doc_id, i, {SQL_SENTENCES} AS s FROM cut)),
scored AS (SELECT doc_id, i, place, round(avg(tfidf), 9) AS score
           FROM (SELECT doc_id, i, place, unnest(regexp_extract_all(lower(sentence), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term FROM lines)
           JOIN weights USING (doc_id, term) GROUP BY doc_id, i, place),
best AS (SELECT doc_id, i, place FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, i ORDER BY score DESC, place) AS r FROM scored) WHERE r = 1)
SELECT doc_id, string_agg(sentence, ' ' ORDER BY i) AS summary FROM lines JOIN best USING (doc_id, i, place) GROUP BY doc_id""")
def summarize_central(spark, d):
    return mentions.central_texts(documents(spark, d), "doc_id")
