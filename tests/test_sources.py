"""Pages, cards, JSON, typed rows, tokens, stores and streams."""

import json
from datetime import datetime
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from postlens.session import checkpoint_dir, clear_scratch, scratch_path, written
from postlens.sinks import stores
from postlens.sources import cards, html, rows
from postlens.streaming import texts

CARD = {
    cards.JOB_POST: '<div class="job-post x"><h2 class="job-title"> Cook <b>A</b> </h2><span class="company-name">Inn</span>{}<div class="job-description">Soup</div></div>',
    cards.JOB_TUPLE: '<article class="jobTuple"><a class="title">Cook</a><a class="subTitle">Inn</a><div class="job-description">Soup</div><span class="salary">2.5-5 Lacs PA</span>{}</article>',
    cards.JOB_BEACON: '<div class="job_seen_beacon"><h2 class="jobTitle">Cook</h2><span class="companyName">Inn</span>{}<div class="job-snippet">Soup</div></div>',
    cards.JOB_CARD: '<div class="JobCard"><p class="JobCard_jobTitle__1X30I"> Cook </p>{}</div>',
}


def extract(spark, layout, *bodies):
    pages = spark.createDataFrame(list(enumerate(bodies)), "page_id int, html string")
    return [r.asDict() for r in cards.html_cards(pages, layout).orderBy("page_id", "card").collect()]


def test_defaults_fill_absent_fields(spark):
    full, bare = CARD[cards.JOB_POST].format('<span class="location">Pune</span>'), CARD[cards.JOB_POST].format("")
    got = extract(spark, cards.JOB_POST, full + bare, "<p>no cards</p>", None)
    assert [(r["page_id"], r["card"], r["title"], r["location"]) for r in got] == [(0, 0, "CookA", "Pune"), (0, 1, "CookA", "N/A")]
    strict = extract(spark, cards.JOB_POST_STRICT, full + bare)
    assert [(r["title"], r["location"]) for r in strict] == [("Cook A", "Pune")]


def test_required_fields_drop_cards(spark):
    body = CARD[cards.JOB_TUPLE]
    got = extract(spark, cards.JOB_TUPLE, body.format("") + body.format('<span class="experience">2-5 Yrs</span>'))
    assert len(got) == 1 and got[0]["experience"] == "2-5 Yrs"


def test_mixed_policies_and_parsing(spark):
    pages = spark.createDataFrame([(0, CARD[cards.JOB_BEACON].format(""))], "page_id int, html string")
    row = cards.parsed_cards(cards.html_cards(pages, cards.JOB_BEACON), "Indeed").first()
    assert (row.title, row.salary, row.experience, row.source) == ("Cook", 0.0, 0.0, "Indeed")
    got = extract(spark, cards.JOB_CARD, CARD[cards.JOB_CARD].format(""))
    assert (got[0]["title"], got[0]["company"], got[0]["description"]) == ("Cook", "Not Mentioned", "")


def test_card_table_function(spark):
    cards.register_card_function(spark, cards.JOB_POST)
    spark.createDataFrame([(CARD[cards.JOB_POST].format(""),)], "html string").createOrReplaceTempView("one_page")
    assert spark.sql("SELECT c.title FROM one_page, LATERAL html_cards(html) c").first().title == "CookA"


def test_visible_text(spark):
    body = '<html><style>x</style><script>var a="</p>";</script><!-- no --><p>One&amp;</p>\n  <p>two  three</p>&copy;</html>'
    row = spark.createDataFrame([(body,)], "h string").select(
        html.visible_text(F.col("h")).alias("a"), html.visible_text_tree(F.col("h")).alias("b")).first()
    assert row.a == row.b == "One& two three©"


@pytest.mark.parametrize("href", ["/a", "b", "b/c?d=1#e", "//h.org/x", "../up", "./same", "?q=1", "http://x.y/z", "mailto:a@b", "/a/../b/./c", "../../../far"])
@pytest.mark.parametrize("base", ["http://site.com/p/q/r.html?x=1", "https://site.com", "http://site.com/p/"])
def test_links_resolve_like_the_standard_library(spark, base, href):
    df = spark.createDataFrame([(base, href)], "b string, h string")
    want = urljoin(base, href)
    assert df.select(html.resolve(F.col("b"), F.col("h"))).first()[0] == want


def test_links(spark):
    body = """<a href="/a"> A <b>x</b></a><a href='#top'>t</a><a href="">e</a><a class="z" href="http://o.p/">O</a><a href=u/v>U</a>
    <a hidden href="c">C</a><!-- <a href="/no">no</a> --><script>'<a href="/js">js</a>'</script>"""
    pages = spark.createDataFrame([(1, "http://s.t/d/", body)], "page_id int, url string, html string")
    got = [(r.text, r.href, r.visible) for r in html.html_links(pages).orderBy("pos").collect()]
    assert got == [("A x", "http://s.t/a", True), ("O", "http://o.p/", True), ("U", "http://s.t/d/u/v", True), ("C", "http://s.t/d/c", False)]


def test_page_state(spark):
    body = '<div class="job-card">1</div><div id="i" class="x Job-card">2</div><a class="next" href="/n">n</a><div class="other">3</div>'
    row = spark.createDataFrame([(body,)], "h string").select(html.page_state(F.col("h"))).first()
    assert row[0] == "job_listings_2_pagination_1_job_details_0"


def test_json_object_or_array(spark, tmp_path):
    one = {"title": "Electrician", "category": "electrician", "salary": 18000, "experience": 1.5}
    (tmp_path / "one.json").write_text(json.dumps(one, indent=2))
    (tmp_path / "two.json").write_text(json.dumps([one, one], indent=2))
    assert [tuple(r) for r in rows.read_postings_json(spark, str(tmp_path / "one.json")).collect()] == [("Electrician", "electrician", 18000.0, 1.5)]
    assert rows.read_postings_json(spark, str(tmp_path / "two.json")).count() == 2
    assert rows.read_postings_json_or_empty(spark, str(tmp_path / "none.json")).count() == 0


def test_json_strings(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(["x, \"y\"", "z\n"]))
    (tmp_path / "l.json").write_text('"x"\n"y z"\n')
    (tmp_path / "o.json").write_text('{"a": 1}')
    assert [r.text for r in rows.read_json_strings(spark, str(tmp_path / "a.json")).orderBy("pos").collect()] == ['x, "y"', "z\n"]
    assert [r.text for r in rows.read_json_strings(spark, str(tmp_path / "l.json"), lines=True).collect()] == ["x", "y z"]
    with pytest.raises(Exception, match="expected a JSON list"):
        rows.read_json_strings(spark, str(tmp_path / "o.json")).collect()


def test_typed_rows(spark):
    raw = spark.createDataFrame([("a", "b", "12", "1.5"), ("a", None, "12", "1"), ("a", "b", "x", "1")],
                                "title string, description string, salary string, experience string")
    typed = rows.typed_postings(raw)
    assert [tuple(r) for r in rows.accepted(typed).collect()] == [("a", "b", 12.0, 1.5)]
    assert rows.rejected(typed).count() == 2


def test_ocr(spark):
    tokens = spark.createDataFrame(
        [(1, i, t, c, 1, 2, 3, 4) for i, (t, c) in enumerate([("A", 61), ("low", 60), (" ", 90), ("B", 99), ("C", 99), ("D", 99), ("E", 99)])]
        + [(2, 0, "only", 70, 0, 0, 1, 1)],
        "page_id long, pos int, text string, conf int, left int, top int, width int, height int",
    )
    words = rows.ocr_words(tokens)
    first = words.where("page_id = 1").orderBy("pos").first()
    assert (first.word, first.x0, first.y0, first.x1, first.y1) == ("A", 1, 2, 4, 6)
    got = [tuple(r) for r in rows.ocr_fields(words).orderBy("page_id").collect()]
    assert got == [(1, "A", "B", "C", "D E"), (2, "only", "", "", "")]


@pytest.fixture
def results(spark):
    return spark.createDataFrame(
        [("d,1\n\"q\"", "chef", 0.9, {"a": 0.9}), ("", None, None, None)],
        "description string, category string, confidence double, metadata map<string,double>",
    )


def test_store_rows(results, spark):
    at = datetime(2024, 5, 1, 10)
    got = [tuple(r) for r in stores.store_rows(results, at).collect()]
    assert got == [('d,1\n"q"', "chef", 0.9, at, '{"a":0.9}'), ("", "", 0.0, at, "{}")]
    bare = stores.store_rows(spark.createDataFrame([("x",)], "description string"), at).first()
    assert tuple(bare) == ("x", "", 0.0, at, "{}")


def test_files_read_back(spark, results, tmp_path):
    path = stores.write_snapshot(results, str(tmp_path), datetime(2024, 5, 1, 10, 2, 3))
    assert path.endswith("/jobs_20240501_100203")
    assert sorted(map(str, spark.read.schema(results.schema).json(path).collect())) == sorted(map(str, results.collect()))
    flat = stores.flat(results)
    back = stores.read_csv(spark, stores.write_csv(results, str(tmp_path / "c")), flat.schema)
    assert back.where("category = 'chef'").first() == flat.where("category = 'chef'").first()


def test_dispatch(spark, results, tmp_path):
    assert stores.save(results, "parquet", path=str(tmp_path / "p"))
    assert not stores.save(results.where("false"), "parquet", path=str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()
    with pytest.raises(ValueError, match="unsupported"):
        stores.save(results, "excel", path="x")
    with pytest.raises(ValueError):
        stores.jdbc_options(None)
    assert stores.mongo_options("mongodb://h")["collection"] == "classified_jobs"
    assert stores.jdbc_options("jdbc:x")["dbtable"] == "classified_jobs"


def test_records(results):
    got = [json.loads(r.record) for r in stores.records_json(results).collect()]
    assert {g["category"] for g in got} == {"chef", None}


def test_written_tables_live_in_the_shared_folder(spark):
    df = written(spark.range(5), "numbers")
    assert df.count() == 5
    assert df.inputFiles()[0].split(":", 1)[-1].lstrip("/").startswith(checkpoint_dir(spark).split(":", 1)[-1].lstrip("/"))
    assert scratch_path(spark, "a") != scratch_path(spark, "a")


def test_stream_equals_batch(spark, data, tmp_path):
    source = tmp_path / "in"
    batch = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    batch.repartition(3).write.parquet(str(source))
    stream = texts.text_stream(spark, str(source), batch.schema, 1)
    texts.run_available(stream, texts.scored_texts, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == batch.count()
    assert texts.scored_texts(batch).exceptAll(got).count() == 0


def test_references_are_decoded_once_in_both_forms(spark):
    page = "<p>caf&eacute; &#8211; &#x20AC;5 &amp;lt; &unknown; &#0; &amp;amp; a&nbsp;b &copy</p>"
    row = spark.createDataFrame([(page,)], "h string").select(html.visible_text(F.col("h")), html.visible_text_tree(F.col("h"))).first()
    assert row[0].startswith("café – €5 &lt; &unknown;") and "&amp; a b" in row[0]
    assert row[1].startswith("café – €5 &lt; &unknown;")


def test_state_sees_shown_elements_only(spark):
    page = """<div class="job"></div><!-- <div class="job"></div> --><script>x = '<div class="job">'</script><div class=job-ad>"""
    got = spark.createDataFrame([(page,)], "h string").select(html.class_count(F.col("h"), "div", "job|ad")).first()[0]
    assert got == 2


def test_malformed_files_give_no_rows(spark, tmp_path):
    (tmp_path / "bad.json").write_text('{"title": ')
    assert rows.read_postings_json(spark, str(tmp_path / "bad.json")).collect() == []
    (tmp_path / "mixed.json").write_text('{"title": "a"}\nnot json\n')
    assert [r[0] for r in rows.read_postings_json(spark, str(tmp_path / "mixed.json"), lines=True).collect()] == ["a"]
    assert rows.read_postings_json(spark, str(tmp_path / "mixed.json"), lines=True).count() == 1


def test_store_options_leave_types_to_the_dialect():
    assert stores.jdbc_options("jdbc:postgresql://h/d") == {
        "url": "jdbc:postgresql://h/d", "dbtable": "classified_jobs", "stringtype": "unspecified"}
    assert "createTableColumnTypes" not in stores.jdbc_options("jdbc:x")


def test_angle_brackets_in_quotes_and_mixed_ends(spark):
    pages = [
        '<a title="a>b" href="x">y</a> t', "<script>a</style>b</script>c", "<style>a</script>b</style >c", "<b class='>' x=\">\">z</b>",
        "<p don't>it's</p>", '<a href=x title="q>">one</a><a href="y>z">two</a>', "<" * 3000 + "a", '<i x="' * 300,
    ]
    df = spark.createDataFrame([(i, h, "http://h/") for i, h in enumerate(pages)], "page_id int, html string, url string")
    rows_ = df.orderBy("page_id").select(html.visible_text(F.col("html")).alias("a"), html.visible_text_tree(F.col("html")).alias("b")).collect()
    for r in rows_[:6]:
        assert r["a"] == r["b"]
    assert [r["a"] for r in rows_[:6]] == ["y t", "c", "c", "z", "it's", "onetwo"]
    links = html.html_links(df).orderBy("page_id", "pos").collect()
    assert [(r["text"], r["href"]) for r in links] == [("y", "http://h/x"), ("one", "http://h/x"), ("two", "http://h/y>z")]
