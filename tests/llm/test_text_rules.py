import random
import string

import brute
import public_tokenizers
import pytest
from postlens.llm import line_dedup, quality, secrets
from postlens.llm.catalog import queries

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def test_lines_of_edges(edge, edge_texts, empty, odd_ids):
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["text"]) for r in line_dedup.dedup_lines(edge).collect()}
    assert got == brute.dedup_lines(edge_texts)
    out = line_dedup.dedup_lines(edge, prefix="_q_")
    assert out.columns == [*edge.columns, "_q_n_lines", "_q_n_dropped"]
    assert line_dedup.dedup_lines(empty).count() == 0
    # repeated rows are one document; rows without an id are kept whole
    kept = {(r["doc_id"], r["text"][:5]) for r in line_dedup.dedup_lines(odd_ids).collect()}
    assert kept == {(1, "alpha"), (2, ""), (2, "word0"), (3, ""), (None, "alpha"), (None, "")}


def test_more_documents_needed(spark):
    rows = [(i, f"in three documents\nin two documents\nown {i}") for i in (1, 2)] + [(3, "in three documents")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs, min_docs=3).collect()}
    assert got[2] == "in two documents\nown 2" and got[3] == ""


def test_a_text_of_very_many_lines(spark):
    text = "\n".join(f"line number {i % 5000}" for i in range(60_000))
    docs = spark.createDataFrame([(1, "line number 7"), (2, text)], "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs).collect()}
    assert (got[2]["n_lines"], got[2]["n_dropped"]) == (60_000, 12)


def test_quality_counts_of_edges(edge, edge_texts, empty):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    for row in quality.quality_rules(edge).collect():
        assert tuple(row[n] for n in names) == brute.quality_counts(edge_texts[row["doc_id"]])
    assert quality.quality_rules(empty).count() == 0


def test_op7_on_documents(spark, data, documents):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    rows = queries()["op7_quality_rules"](spark, data).collect()
    assert len(rows) == len(documents)
    for row in rows:
        assert tuple(row[n] for n in names) == brute.quality_counts(documents[row["doc_id"]])
        assert not (row["kept"] and row["base_failed"])


def test_bands_reject_repetition_and_noise_and_keep_prose(spark, documents):
    draw = random.Random(4)
    noise = lambda n: " ".join("".join(draw.choices(string.ascii_letters + string.digits + "+/", k=24)) for _ in range(n))
    cycle = [f"w{i}" for i in range(7)]
    # no window of eight words repeats often enough for the base rule, yet it holds next to nothing
    sparse = " ".join(random.Random(i).choice("abc") for i in range(4000))
    half = " ".join(t for t in documents.values() if t)[:6000]
    rows = [(1, noise(400)), (2, sparse), (3, half + " " + noise(500)), (4, half), (5, " ".join(cycle * 60))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in quality.quality_rules(docs).collect()}
    assert {i: r["kept"] for i, r in got.items()} == {1: False, 2: False, 3: False, 4: True, 5: False}
    assert not got[1]["base_failed"] and not got[3]["base_failed"]


def test_base_secrets_of_edges(spark, edge, edge_texts, empty):
    for row in secrets.find_secrets(edge, RANKS).collect():
        got = [f"{s['kind']}:{s['start']}:{s['end']}" for s in row["secrets"] if s["kind"] != "random"]
        assert got == brute.base_secrets(edge_texts[row["doc_id"]])
    assert secrets.find_secrets(empty, RANKS).count() == 0


def test_op6_on_documents(spark, data, documents):
    for row in queries()["op6_secret_scan"](spark, data).collect():
        want = brute.base_secrets(documents[row["doc_id"]])
        assert row["base_sha256"] == brute.sha(",".join(want))
        assert [s for s in row["spans"].split(",") if s and not s.startswith("random")] == want


def test_random_mixtures_of_base_patterns():
    draw = random.Random(6)
    parts = ["password", "Token", "api_key", "APIKEY", "secret", "=", ":", " ", '"', "abc", "f00d" * 6, "AKIA", "ABCDEFGH1234567890",
             "\n", "é", "x" * 7, "ſ", "0", "AKIAAKIA"]
    codec = secrets.encoding(RANKS)
    for _ in range(4000):
        text = "".join(draw.choice(parts) for _ in range(draw.randint(0, 14)))
        spans = [f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in secrets.scan(text, codec, 2.1) if k < 3]
        assert spans == brute.base_secrets(text)


@pytest.mark.parametrize("text, found", [
    ("see Zk3qT9vXw1LmP8rB2nYc7Hd here", 1), ("key xJ7-Qp2_Lm9Zt4Vw8Rb1Nc6Yk3 end", 1),
    ("digest " + "9F86D081884C7D659A2FEAA0C55AD015", 0), ("id 123e4567-E89B-12d3-a456-426614174000", 0),
    ("internationalization_of_configuration_parameters", 0), ("2024-01-01-0000-1111-2222", 0), ("short aB3xK9", 0),
    ("path/to/some/module/with/names", 0), ("", 0),
])
def test_random_strings_by_tokens(text, found):
    spans = [s for s in secrets.scan(text, secrets.encoding(RANKS), 2.1) if secrets.KINDS[s[1]] == "random"]
    assert len(spans) == found


def test_prose_holds_no_random_strings(documents):
    codec = secrets.encoding(RANKS)
    assert not [s for t in documents.values() for s in secrets.random_spans(t or "", codec, 2.1) if "token" not in t and "AKIA" not in t]


def test_redaction(edge, edge_texts):
    got = {r["doc_id"]: r["text"] for r in secrets.redact(edge, RANKS).collect()}
    assert got[17] == "[SECRET] [SECRET] [SECRET]"
    assert {i: t for i, t in got.items() if i not in (17, 18)} == {i: t for i, t in edge_texts.items() if i not in (17, 18)}
