"""The pipeline against plain Python, stage by stage, each on its own input."""

import brute
import public_tokenizers
import pytest
from postlens.llm import secrets
from test_tokens import check_packing
from tokenizers import Tokenizer

import corpus_pipeline

FILE = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def run_stages(spark, docs, folder):
    from postlens.session import written

    out = []
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, folder), name)
        out.append((name, docs))
    return out


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def test_stages(spark, data):
    from postlens.llm import quality

    docs = spark.read.parquet(f"{data}/documents.parquet")
    before = texts(docs)
    stages = run_stages(spark, docs, data)
    assert [n for n, _ in stages] == ["quality_rules", "line_dedup", "near_dedup", "secret_scan", "best_fit_packing"]
    assert all(df.columns == docs.columns for _, df in stages[:-1])

    kept = texts(stages[0][1])
    judged = {r["doc_id"]: r["kept"] for r in quality.quality_rules(docs).collect()}
    assert kept == {i: t for i, t in before.items() if judged[i]} and len(kept) > 0.8 * len(before)

    lines = texts(stages[1][1])
    assert lines == {i: t for i, (_, _, t) in brute.dedup_lines(kept).items()}
    assert all(r["n_chars"] == len(r["text"]) for r in stages[1][1].collect())

    single = texts(stages[2][1])
    assert single == {i: lines[i] for i, (_, c) in brute.near_duplicates(lines, 80).items() if c == i}

    clean = texts(stages[3][1])
    assert clean.keys() == single.keys()
    for i, text in clean.items():
        assert not brute.base_secrets(text)
        if not secrets.scan(single[i], secrets.encoding(RANKS), 2.1):
            assert text == single[i]

    used, least = check_packing(stages[4][1].collect(), clean, Tokenizer.from_file(FILE))
    assert used <= 1.02 * least + 1


@pytest.mark.parametrize("kind", ["edge", "empty", "odd_ids"])
def test_stages_on_odd_rows(spark, data, kind, request):
    docs = request.getfixturevalue(kind)
    stages = run_stages(spark, docs, data)
    assert all(df.columns == docs.columns for _, df in stages[:-1])
    # every stage also takes the odd rows themselves
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, docs, data).collect()


def test_run_is_the_stages(spark, data):
    whole = corpus_pipeline.run(spark, data)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(whole.columns) and whole.count() > 0
