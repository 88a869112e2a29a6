"""Queries of the sources and sinks: pages, JSON, CSV, typed rows, OCR tokens, stores."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F, types as T

from postlens.constants import NOT_MENTIONED
from postlens.functions import text as X
from postlens.operators import filters
from postlens.operators.scaling import unrolled
from postlens.plans.catalog_text import R as TEXT, SQL_SENTENCES, SQL_STRIP
from postlens.plans.registry import Registry, table, wide_table
from postlens.session import scratch_path
from postlens.sinks import stores
from postlens.sources import cards, html, rows
from postlens.streaming import texts

R = Registry()

SQL_BODY = r"regexp_replace(html, '(?is)<(script|style)\b.*?</(script|style)>', '', 'g')"
SQL_TAG = r"(?s)<!--.*?-->|<![^>]*>|<[^>]*>"


# the named characters that occur in the pages, the ampersand last
SQL_NAMED = {"&quot;": '"', "&copy;": "©", "&middot;": "·", "&lt;": "<", "&gt;": ">", "&amp;": "&"}


def sql_unescape(text: str) -> str:
    for name, char in SQL_NAMED.items():
        text = f"replace({text}, '{name}', '{char.replace(chr(39), chr(39) * 2)}')"
    return text


SQL_VISIBLE = (
    "trim(regexp_replace(" + sql_unescape(f"regexp_replace({SQL_BODY}, '{SQL_TAG}', '', 'g')")
    + r", '\s*[\r\n]+\s*|\s{2,}', ' ', 'g'))"
)


@R.add("html_visible_text", f"SELECT page_id, {SQL_VISIBLE} AS text FROM pages")
def html_visible_text(spark, d):
    return wide_table(spark, d, "pages").select("page_id", html.visible_text(F.col("html")).alias("text"))


@R.add("html_visible_text_tree", f"SELECT page_id, {SQL_VISIBLE} AS text FROM pages")
def html_visible_text_tree(spark, d):
    return wide_table(spark, d, "pages").select("page_id", html.visible_text_tree(F.col("html")).alias("text"))


ODD_HEAD = "<p>caf&eacute; &#8211; &#x20AC;5 &euro;6 &amp;lt; &unknown; a&nbsp;b</p>"


@R.add("html_entities", f"SELECT page_id, 'café – €5 €6 &lt; &unknown; a b' || text AS text FROM (SELECT page_id, {SQL_VISIBLE} AS text FROM pages)")
def html_entities(spark, d):
    """Numeric, rare and unknown references before the text of every page."""
    page = F.concat(F.lit(ODD_HEAD), F.col("html"))
    return wide_table(spark, d, "pages").select("page_id", html.visible_text(page).alias("text"))


QUOTED_HEAD = """<a title="a>b" href='x?a=1&amp;b=2'>y</a> <i data-x='>'>t</i><script>a</style>b</script>c<style>d</script></style> e<p don't>it's</p> """


@R.add("html_quoted_tags", f"""
SELECT page_id, trim('y tc eit''s ' || text) AS by_pattern, trim('y tc eit''s ' || text) AS by_tree FROM (SELECT page_id, {SQL_VISIBLE} AS text FROM pages)""")
def html_quoted_tags(spark, d):
    """Quoted angle brackets and mixed script and style ends before every page, by both text forms."""
    page = F.concat(F.lit(QUOTED_HEAD), F.col("html"))
    return wide_table(spark, d, "pages").select(
        "page_id", html.visible_text(page).alias("by_pattern"), html.visible_text_tree(page).alias("by_tree"))


SQL_ANCHORS = rf"""
SELECT page_id, url, unnest(range(0, len(h))) AS pos, unnest(h) AS raw, unnest(t) AS inner_html
FROM (SELECT page_id, url, regexp_extract_all(body, '(?is)<a\s([^>]*)>(.*?)</a>', 1) AS h,
             regexp_extract_all(body, '(?is)<a\s([^>]*)>(.*?)</a>', 2) AS t
      FROM (SELECT page_id, url, regexp_replace({SQL_BODY}, '(?s)<!--.*?-->', '', 'g') AS body FROM pages))"""
SQL_LINKS = rf"""
SELECT page_id, CAST(pos AS INTEGER) AS pos, text,
       CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN href
            WHEN starts_with(href, '//') THEN regexp_extract(url, '^([a-z]+:)', 1) || href
            WHEN starts_with(href, '/') THEN regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || href
            ELSE regexp_extract(url, '^([a-z]+://[^?#]*/)', 1) || href END AS href,
       NOT regexp_matches(raw, '(?i)hidden|display\s*:\s*none') AS visible
FROM (SELECT *, {sql_unescape(r"regexp_extract(raw, 'href=.([^\x22]*)', 1)")} AS href,
             trim({sql_unescape(f"regexp_replace(inner_html, '{SQL_TAG}', '', 'g')")}, {SQL_STRIP}) AS text
      FROM ({SQL_ANCHORS})) WHERE href <> '' AND NOT starts_with(href, '#')"""


@R.add("html_links", SQL_LINKS)
def html_links(spark, d):
    return html.html_links(wide_table(spark, d, "pages"))


TEST_KEYWORDS = ["the", "und", "que"]
SQL_KEYWORDS = " OR ".join(f"contains(lower(text), '{k}') OR contains(lower(href), '{k}')" for k in TEST_KEYWORDS)


@R.add("filter_links", f"SELECT * FROM ({SQL_LINKS}) WHERE {SQL_KEYWORDS}")
def filter_links(spark, d):
    return filters.filter_links(html.html_links(wide_table(spark, d, "pages")), TEST_KEYWORDS)


TEST_CLASSES = {
    "job_listings": ("div", "ad|job|listing|posting"),
    "pagination": ("a", "page|next|pagination"),
    "job_details": ("div", "detail|description|content"),
}


SQL_SHOWN = f"regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?is)<(script|style)\\b.*?</(script|style)>', '', 'g')"
SQL_STATE = f"""
SELECT page_id, 'job_listings_' || (len(regexp_extract_all(html, '(?i)<div\\s[^>]*class="[^">]*(?:ad|job|listing|posting)[^">]*"')) + {{0}})
  || '_pagination_' || len(regexp_extract_all(html, '(?i)<a\\s[^>]*class="[^">]*(?:page|next|pagination)[^">]*"'))
  || '_job_details_' || len(regexp_extract_all(html, '(?i)<div\\s[^>]*class="[^">]*(?:detail|description|content)[^">]*"')) AS state
FROM (SELECT page_id, {SQL_SHOWN} AS html FROM pages)"""


@R.add("html_page_state", SQL_STATE.format(0))
def html_page_state(spark, d):
    return wide_table(spark, d, "pages").select("page_id", html.page_state(F.col("html"), TEST_CLASSES).alias("state"))


@R.add("html_page_state_hidden", SQL_STATE.format(2))
def html_page_state_hidden(spark, d):
    """Elements in comments and scripts do not count, those with unquoted classes do."""
    odd = """<!-- <div class="job"> --><script>"<div class='job'>"</script><div class=job-card><div id=x class='Posting'>"""
    page = F.concat(F.lit(odd), F.col("html"))
    return wide_table(spark, d, "pages").select("page_id", html.page_state(page, TEST_CLASSES).alias("state"))


# Card layouts for the test pages: list items with a link, and the article
LIST_ITEM = cards.CardLayout("li", None, (
    cards.Field("title", "a", None, "N/A"),
    cards.Field("company", "span", "company-name", "N/A"),
), strip_pieces=True)
ARTICLE = cards.CardLayout("article", None, (
    cards.Field("title", "h1", None),
    cards.Field("description", "p", None),
    cards.Field("salary", "span", "salary", "Not specified"),
    cards.Field("experience", "span", "experience", "Not specified"),
))


@R.add("html_cards", f"""
SELECT page_id, CAST(card AS INTEGER) AS card, title, 'N/A' AS company
FROM (SELECT page_id, unnest(range(0, len(t))) AS card,
             unnest(list_transform(t, lambda x: {sql_unescape("x")})) AS title
      FROM (SELECT page_id, regexp_extract_all(html, '<li><a [^>]*>([^<]*)</a></li>', 1) AS t FROM pages))""")
def html_cards(spark, d):
    return cards.html_cards(wide_table(spark, d, "pages"), LIST_ITEM)


SQL_PLAIN = "trim(" + sql_unescape("regexp_replace({0}, '<[^>]*>', '', 'g')") + f", {SQL_STRIP})"


@R.add("html_cards_source", f"""
SELECT page_id, CAST(0 AS INTEGER) AS card, {SQL_PLAIN.format("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)")} AS title,
       {SQL_PLAIN.format("regexp_extract(html, '(?s)</h1>(.*?)</article>', 1)")} AS description,
       CAST(0 AS DOUBLE) AS salary, CAST(0 AS DOUBLE) AS experience, 'Indeed' AS source FROM pages""")
def html_cards_source(spark, d):
    return cards.parsed_cards(cards.html_cards(wide_table(spark, d, "pages"), ARTICLE), "Indeed")


@R.add("html_cards_function", R.oracles["html_cards"])
def html_cards_function(spark, d):
    """The same cards by a table function in SQL."""
    cards.register_card_function(spark, LIST_ITEM, "listing_cards")
    wide_table(spark, d, "pages").createOrReplaceTempView("stored_pages")
    return spark.sql("SELECT page_id, c.* FROM stored_pages, LATERAL listing_cards(html) c")


def order_pages(spark, d, layout, **values):
    """A page per order with one card of the layout; a field without a value is left out."""
    parts = [F.lit(f'<html><body><{layout.tag or "div"} class="{layout.cls}">')]
    for spec in layout.fields:
        tag = spec.tag or "p"
        shown = F.concat(F.lit(f'<{tag} class="{spec.cls}"> '), values[spec.name], F.lit(f" </{tag}>"))
        parts.append(F.coalesce(shown, F.lit("")))
    page = F.concat(*parts, F.lit(f'</{layout.tag or "div"}></body></html>'))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("page_id"), page.alias("html"))


def order_values():
    number = F.col("o_orderkey").cast("string")
    return {
        "title": F.col("o_orderpriority"), "company": F.concat(F.lit("c"), F.col("o_custkey").cast("string")),
        "location": F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderstatus")), "description": F.concat(F.lit("order "), number),
        "salary": F.when(F.col("o_orderkey") % 4 > 0, F.concat(number, F.lit(" a year"))),
        "experience": F.when(F.col("o_orderkey") % 5 > 0, F.lit("2 years")),
    }


SQL_CARD = """o_orderkey AS page_id, CAST(0 AS INTEGER) AS card, o_orderpriority AS title, 'c' || o_custkey AS company"""


@R.add("cards_strict", f"""
SELECT {SQL_CARD}, o_orderstatus AS location, 'order ' || o_orderkey AS description FROM orders WHERE o_orderkey % 3 > 0""")
def cards_strict(spark, d):
    """A card without one of its fields is dropped."""
    return cards.html_cards(order_pages(spark, d, cards.JOB_POST_STRICT, **order_values()), cards.JOB_POST_STRICT)


@R.add("cards_required_salary", f"""
SELECT {SQL_CARD}, 'order ' || o_orderkey AS description, o_orderkey || ' a year' AS salary, '2 years' AS experience
FROM orders WHERE o_orderkey % 4 > 0 AND o_orderkey % 5 > 0""")
def cards_required_salary(spark, d):
    return cards.html_cards(order_pages(spark, d, cards.JOB_TUPLE, **order_values()), cards.JOB_TUPLE)


@R.add("cards_placeholder", f"""
SELECT {SQL_CARD}, CASE WHEN o_orderkey % 3 > 0 THEN o_orderstatus ELSE 'Not mentioned' END AS location,
       CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey || ' a year' ELSE 'Not mentioned' END AS salary, 'order ' || o_orderkey AS description
FROM orders""".replace("Not mentioned", NOT_MENTIONED))
def cards_placeholder(spark, d):
    """Missing fields get the layout's placeholder."""
    return cards.html_cards(order_pages(spark, d, cards.JOB_CARD, **order_values()), cards.JOB_CARD)


def ocr_tokens_table(spark, d):
    """Document words as tokens; boxes and confidence follow from place and length."""
    words = F.regexp_extract_all("text", F.lit(r"(\S+)"), 1)
    pages = wide_table(spark, d, "documents").withColumnRenamed("doc_id", "page_id")
    placed = unrolled(pages, ["page_id"], words, "pos", "text")
    n = F.length("text")
    return placed.select(
        "page_id", "pos", "text", (40 + n * 5).alias("conf"), (F.col("pos") % 12 * 80).alias("left"),
        F.floor(F.col("pos") / 12).cast("int").alias("top"), (n * 8).alias("width"), F.lit(12).alias("height"),
    )


SQL_OCR = r"""
SELECT doc_id AS page_id, pos, word, pos % 12 * 80 AS x0, pos // 12 AS y0, pos % 12 * 80 + length(word) * 8 AS x1, pos // 12 + 12 AS y1
FROM (SELECT doc_id, unnest(w) AS word, unnest(range(0, len(w))) AS pos
      FROM (SELECT doc_id, regexp_extract_all(text, '\S+') AS w FROM documents))
WHERE 40 + length(word) * 5 > 60"""


@R.add("ocr_tokens", SQL_OCR)
def ocr_tokens(spark, d):
    return rows.ocr_words(ocr_tokens_table(spark, d))


@R.add("ocr_fields", f"""
SELECT page_id, coalesce(w[1], '') AS title, coalesce(w[2], '') AS company, coalesce(w[3], '') AS location,
       array_to_string(list_slice(w, 4, len(w)), ' ') AS description
FROM (SELECT page_id, list(word ORDER BY pos) AS w FROM ({SQL_OCR}) GROUP BY page_id)""")
def ocr_fields(spark, d):
    return rows.ocr_fields(rows.ocr_words(ocr_tokens_table(spark, d)))


@R.add("labelled_texts", "SELECT doc_id, text, quality AS label FROM documents JOIN labels USING (doc_id)")
def labelled_texts(spark, d):
    return rows.labelled_texts(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id", "quality")


@R.add("src_typed_rows", """
SELECT o_orderkey, title, description, TRY_CAST(salary AS DOUBLE) AS salary, TRY_CAST(experience AS DOUBLE) AS experience,
       title IS NOT NULL AND description IS NOT NULL AND TRY_CAST(salary AS DOUBLE) IS NOT NULL
         AND TRY_CAST(experience AS DOUBLE) IS NOT NULL AS is_valid
FROM (SELECT o_orderkey, o_orderpriority AS title, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS description,
             CASE WHEN o_custkey % 5 = 0 THEN 'n/a' ELSE CAST(o_custkey AS VARCHAR) END AS salary,
             CAST(o_custkey % 30 AS VARCHAR) || '.5' AS experience FROM orders)""")
def src_typed_rows(spark, d):
    customer = F.col("o_custkey")
    raw = table(spark, d, "orders").select(
        "o_orderkey", F.col("o_orderpriority").alias("title"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("description"),
        F.when(customer % 5 == 0, "n/a").otherwise(customer.cast("string")).alias("salary"),
        F.concat((customer % 30).cast("string"), F.lit(".5")).alias("experience"),
    )
    return rows.typed_postings(raw)


def order_rows(spark, d):
    return table(spark, d, "orders").select(
        F.col("o_orderkey").cast("string").alias("title"), F.col("o_orderpriority").alias("category"),
        F.col("o_totalprice").alias("salary"), F.col("o_custkey").cast("double").alias("experience"),
    )


SQL_ORDER_ROWS = """SELECT CAST(o_orderkey AS VARCHAR) AS title, o_orderpriority AS category, o_totalprice AS salary,
       CAST(o_custkey AS DOUBLE) AS experience FROM orders"""


@R.add("src_json", SQL_ORDER_ROWS)
def src_json(spark, d):
    """Orders written as JSON arrays and read through the posting reader."""
    path = stores.write_json_arrays(order_rows(spark, d), scratch_path(spark, "src_json"))
    return rows.read_postings_json(spark, path)


@R.add("src_json_lines", SQL_ORDER_ROWS)
def src_json_lines(spark, d):
    """Orders written as JSON lines and read through the posting reader."""
    path = stores.write_json(order_rows(spark, d), scratch_path(spark, "src_json_lines"))
    return rows.read_postings_json(spark, path, lines=True)


@R.add("src_json_texts", "SELECT text FROM documents")
def src_json_texts(spark, d):
    """The documents as JSON arrays of texts, read as an upload."""
    path = stores.write_json_arrays(table(spark, d, "documents").select("text"), scratch_path(spark, "src_json_texts"))
    return rows.read_json_strings(spark, path).select("text")


@R.add("src_json_strings", f"""
SELECT doc_id, CAST(pos AS INTEGER) AS pos, text FROM (
  SELECT doc_id, unnest(range(0, len(s))) AS pos, unnest(s) AS text FROM (SELECT doc_id, {SQL_SENTENCES} AS s FROM documents))""")
def src_json_strings(spark, d):
    """The sentences of each document as one JSON list, read back."""
    uploads = wide_table(spark, d, "documents").select("doc_id", F.to_json(X.sentences(F.col("text"))).alias("upload"))
    return rows.explode_json_strings(uploads, "upload", ("doc_id",))


SQL_EVENT_ROWS = """SELECT event_id, event_type, value, props FROM events"""


def event_rows(spark, d):
    return table(spark, d, "events").select("event_id", "event_type", "value", "props")


@R.add("sink_json", SQL_EVENT_ROWS)
def sink_json(spark, d):
    df = event_rows(spark, d)
    base = scratch_path(spark, "sink_json")
    stores.write_snapshot(df, base)
    return spark.read.schema(df.schema).json(f"{base}/*")


@R.add("sink_csv", "SELECT doc_id, text, lang FROM documents")
def sink_csv(spark, d):
    df = table(spark, d, "documents").select("doc_id", "text", "lang")
    return stores.read_csv(spark, stores.write_csv(df, scratch_path(spark, "sink_csv")), df.schema)


@R.add("sink_parquet", SQL_EVENT_ROWS)
def sink_parquet(spark, d):
    path = scratch_path(spark, "sink_parquet")
    stores.save(event_rows(spark, d), "parquet", path=path)
    return spark.read.parquet(path)


@R.add("sink_counted", "SELECT count(*) AS rows, count(*) FILTER (WHERE value IS NULL) AS no_value, count(DISTINCT event_type) AS kinds FROM events")
def sink_counted(spark, d):
    """What a write counted on its way, beside the kinds read back."""
    path = scratch_path(spark, "sink_counted")
    seen = stores.counted_write(event_rows(spark, d), lambda rows: rows.write.parquet(path), no_value=F.count_if(F.col("value").isNull()))
    kinds = spark.read.parquet(path).agg(F.count_distinct("event_type").alias("kinds"))
    return kinds.select(F.lit(seen["rows"]).cast("bigint").alias("rows"), F.lit(seen["no_value"]).cast("bigint").alias("no_value"), "kinds")


@R.add("stream_texts", TEXT.oracles["clean_text"])
def stream_texts(spark, d):
    """The documents as a stream of files, cleaned and written once, read back."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    folder, out, state = (scratch_path(spark, name) for name in ("stream_in", "stream_out", "stream_state"))
    docs.write.parquet(folder)
    arriving = texts.text_stream(spark, folder, docs.schema)
    texts.run_available(arriving, lambda rows: texts.scored_texts(rows).select("doc_id", "clean"), out, state)
    return spark.read.parquet(out)


@R.add("records_json", SQL_EVENT_ROWS)
def records_json(spark, d):
    """Rows to JSON records, parsed back."""
    df = event_rows(spark, d)
    return stores.records_json(df).select(F.from_json("record", df.schema).alias("r")).select("r.*")


@R.add("sink_jdbc_rows", """
SELECT text AS description, CASE WHEN quality IS NULL THEN '' ELSE lang END AS category,
       coalesce(CAST(quality AS DOUBLE), 0.0) AS confidence, TIMESTAMP '2024-01-31 12:00:00' AS timestamp,
       CASE WHEN quality IS NULL THEN '{}' ELSE '{"source":"' || source || '","n_chars":' || n_chars || '}' END AS metadata
FROM documents LEFT JOIN labels USING (doc_id)""")
def sink_jdbc_rows(spark, d):
    joined = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    known = F.col("quality").isNotNull()
    results = joined.select(
        F.col("text").alias("description"), F.when(known, F.col("lang")).alias("category"),
        F.col("quality").cast(T.DoubleType()).alias("confidence"),
        F.when(known, F.struct("source", "n_chars")).alias("metadata"),
    )
    return stores.store_rows(results, datetime(2024, 1, 31, 12))
