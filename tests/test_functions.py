"""Golden values of text, parsing, signal and score functions."""

import math
import re

import pytest
from pyspark.sql import functions as F

from postlens import constants as C
from postlens.functions import parse, scores as S, signals, text as X

T = F.col("t")


def test_clean_text(column):
    assert column(X.clean_text(T), ["Hello,   WORLD!! @ home .", "a , b", None]) == ["hello, world!!   home .", "a, b", None]


def test_strip_handles_every_white_space(column):
    assert column(X.clean_min(T), ["\t\n A b  \x1f"]) == ["a b"]
    assert column(X.clean_light(T), ["  A\t\n B\x1c"]) == ["a b"]


def test_strip_stopwords(column):
    assert column(X.strip_stopwords(T), ["The chef, and the driver", "the, cat"]) == ["chef, driver", "the, cat"]


def test_counts(column):
    texts = ["a  b c", "", "  ", None]
    assert column(X.text_length(T), texts) == [6, 0, 2, None]
    assert column(X.word_count(T), texts) == [3, 0, 0, None]


@pytest.mark.parametrize("n", [0, 1, 1023, 1024, 1025, 5000])
def test_chunks_cover_the_text(column, n):
    text = "".join(chr(97 + i % 26) for i in range(n))
    (got,) = column(X.chunks(T), [text])
    assert "".join(got) == text
    assert [len(c) for c in got] == [min(1024, n - i) for i in range(0, n, 1024)]


def test_ngrams(column):
    assert column(X.ngrams(X.tokens(T), 2), ["Aa bb cc", "aa", ""]) == [["aa bb", "bb cc"], [], []]


def test_sentences(column):
    assert column(X.sentences(T), ["One. Two!? three", "...", ""]) == [["One.", "Two!?", "three"], [], []]


def test_lead_summary(column):
    text = "One two three. Four five six seven. Eight nine"
    assert column(X.lead_summary(T, 8, 3), [text]) == ["One two three. Four five six seven."]
    assert column(X.lead_summary(T, 5, 4), [text]) == ["One two three. Four five"]


def test_combine(spark):
    row = spark.sql("SELECT 'a' AS x, CAST(NULL AS string) AS y").select(X.combine(F.col("x"), F.col("y"))).first()
    assert row[0] == "a "


def test_salary_lakh(column):
    texts = ["2.5-5 Lacs PA", "25k", "500 per week", "20,000 a month", "Not specified", "lakhs", None]
    assert column(parse.salary_lakh(T), texts) == [25500.0, 25.0, 500.0, 0.0, 0.0, 0.0, 0.0]
    assert column(parse.salary_lakh(T, "clean"), texts) == [375.0, 25.0, 0.0, 0.0, 0.0, 0.0, 0.0]
    with pytest.raises(ValueError):
        parse.salary_lakh(T, "other")


def test_experience_compact(column):
    texts = ["2-5 Yrs", "3+ years", "Not specified", "", None]
    assert column(parse.experience_compact(T), texts) == [25.0, 3.0, 0.0, 0.0, 0.0]
    assert column(parse.experience_compact(T, "clean"), texts) == [2.0, 3.0, 0.0, 0.0, 0.0]


def test_salary_midpoint(column):
    texts = ["₹15,000 - ₹20,000", "15000 - 20001", "₹30,000", "25k", "Not Mentioned", "negotiable", "rs 25k", ".5k", "", None]
    assert column(parse.salary_midpoint(T), texts) == [17500, 17500, 30000, 25, None, None, None, 500, None, None]


def test_experience_first(column):
    assert column(parse.experience_first(T), ["Fresher, 2 yrs ok", "5 years", "driver", "", None]) == [0, 5, None, 0, 0]


def test_salary_range(column):
    texts = [
        "Salary: $50,000 - $60,000 per year", "15,000 to 20,000 per month", "salary: 900-950",
        "salary: 900-60000", "pay 500 per week", "$900 - $950 per week",
    ]
    assert [tuple(r) for r in column(parse.salary_range(T), texts)] == [
        (50000.0, 60000.0, "USD", "year"), (15000.0, 20000.0, "USD", "month"), (900.0, 950.0, "USD", "month"),
        (900.0, 600.0, "USD", "month"), (None, None, None, None), (900.0, 950.0, "USD", "month"),
    ]


def test_contacts(column):
    rows = column(signals.contacts(T), ["mail a.b@x.com. call (743) 555-3824", "none", "é@ü.de 555.123.4567"])
    assert [tuple(r) for r in rows] == [("a.b@x.com.", "743) 555-3824"), (None, None), ("é@ü.de", "555.123.4567")]


def test_skills(column):
    text = "Experienced driver, required valid licence. Experienced driver"
    assert column(signals.skills(T), [text]) == [["driver", "valid licence"]]


def test_scam_features(column):
    (row,) = column(signals.scam_features(T), ["URGENT work from home 9876543210"])
    assert row.asDict() == {
        "length": 32, "has_email": False, "has_phone": True, "has_url": False, "suspicious_word_count": 2,
        "has_company_name": False, "has_location": False,
    }
    rows = column(signals.scam_features(T), ["electricity work", "see HTTP://x.y at ACME Ltd. or a@b"])
    assert rows[0]["has_location"] and rows[1]["has_url"] and rows[1]["has_company_name"] and rows[1]["has_email"]


def test_indicators(column):
    got = column(signals.suspicious_indicators(signals.scam_features(T)), ["urgent 9876543210", "plain"])
    assert got == [["Has Phone", "Suspicious Word Count"], []]


def test_risk_and_levels(column):
    assert column(signals.risk_tier(T), [0.71, 0.7, 0.3, 0.31], "double") == ["red", "orange", "green", "orange"]
    assert column(signals.experience_level(T), [1.5, 2.0, 4.9, 5.0], "double") == ["entry", "mid", "mid", "senior"]


def test_display(spark):
    row = spark.sql("SELECT 'computer operator' AS c, 0.5D AS p, true AS s").select(
        signals.display_title(F.col("c"), F.col("p"), F.col("s")), signals.rupee_range(F.lit(15000.0), F.lit(18000.4))
    ).first()
    assert row[0] == "⚠️ Computer Operator (Confidence: 50.00%) - Potential Scam!"
    assert row[1] == "₹15,000 - ₹18,000"


def test_softmax_and_rank(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0, -2.0],)], "x array<double>")
    names = F.array(*[F.lit(n) for n in "abcd"])
    row = df.select(S.softmax(F.col("x")).alias("p"), S.argmax(F.col("x")).alias("i"),
                    S.prediction(names, S.softmax(F.col("x"))).alias("r")).first()
    z = sum(math.exp(v) for v in (1, 3, 3, -2))
    assert row.p == pytest.approx([math.exp(v) / z for v in (1, 3, 3, -2)])
    assert row.i == 1
    assert row.r.category == "b" and [p.label for p in row.r.all_predictions] == ["b", "c", "a", "d"]


def test_softmax_of_large_logits(spark):
    df = spark.createDataFrame([([1000.0, 1001.0],)], "x array<double>")
    assert sum(df.select(S.softmax(F.col("x"))).first()[0]) == pytest.approx(1.0)


def test_empty_prediction(spark):
    df = spark.sql("SELECT CAST(array() AS array<string>) AS n, CAST(array() AS array<double>) AS s")
    row = df.select(S.prediction(F.col("n"), F.col("s")).alias("r")).first().r
    assert (row.category, row.confidence, row.all_predictions) == ("unknown", 0.0, [])


def test_patterns_agree_with_plain_python(spark, data):
    """Skills, phones and addresses of real texts against the standard library."""
    docs = spark.read.parquet(f"{data}/documents.parquet").select(
        "text", signals.contacts(T_TEXT).alias("c"), signals.skills(T_TEXT, [r"\b(?:the|que)\s+([^.,]+)"]).alias("s")
    ).collect()
    for row in docs:
        mail = re.search(r"[\w.-]+@[\w.-]+", row.text)
        call = re.search(C.PHONE_PATTERN, row.text)
        found = list(dict.fromkeys(m.strip() for m in re.findall(r"\b(?:the|que)\s+([^.,]+)", row.text.lower())))
        assert (row.c.email, row.c.phone) == (mail and mail.group(0), call and call.group(0))
        assert row.s == found


T_TEXT = F.col("text")
