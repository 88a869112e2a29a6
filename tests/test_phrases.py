"""The word automaton against trying every name at every place."""

import random

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from postlens.operators import mentions, phrases

WORDS = st.lists(st.sampled_from(["a", "b", "c"]), max_size=30)
NAMES = st.lists(st.tuples(st.lists(st.sampled_from(["a", "b", "c"]), min_size=1, max_size=5), st.sampled_from(["GPE", "ORG"])), max_size=12)


def brute(names, words):
    out = [(i, phrase, kind, i + phrase.count(" ")) for i in range(len(words)) for phrase, kind in names
           if words[i:i + phrase.count(" ") + 1] == phrase.split(" ")]
    return sorted(out)


@settings(max_examples=400, deadline=None)
@given(NAMES, WORDS)
def test_every_hit_and_no_other(names, words):
    listed = sorted({(" ".join(n), kind) for n, kind in names})
    assert phrases.Automaton(listed).hits(words) == brute(listed, words)


def test_work_follows_the_text_not_the_names():
    draw = random.Random(1)
    listed = sorted({(" ".join(f"w{draw.randint(0, 3000)}" for _ in range(draw.randint(1, 9))), "ORG") for _ in range(50_000)})
    automaton = phrases.Automaton(listed)
    words = [f"w{draw.randint(0, 3000)}" for _ in range(2000)]
    held = {n for n, _ in listed}
    want = sum(" ".join(words[i:i + n]) in held for i in range(len(words)) for n in range(1, 10) if i + n <= len(words))
    assert len(automaton.hits(words)) == want


def test_a_list_beyond_the_limits_is_not_sent(spark):
    names = spark.createDataFrame([("New York", "GPE"), ("Acme", "ORG")], "phrase string, kind string")
    assert phrases.listed_names(names) is not None
    assert phrases.listed_names(names, limit=1) is None and phrases.listed_names(names, chars=5) is None


def test_plan_holds_no_name(spark):
    docs = spark.createDataFrame([(1, "New York. Acme of New York City."), (2, None)], "id int, text string")
    names = spark.createDataFrame([("New York", "GPE"), ("New York City", "GPE"), ("Acme", "ORG")], "phrase string, kind string")
    found = mentions.entities(docs, "id", names)
    assert "Acme" not in found._jdf.queryExecution().toString().split("LogicalRDD")[0].split("LocalRelation")[0]
    rows = {r.id: r for r in found.collect()}
    assert rows[1].locations == ["New York", "New York", "New York City"] and rows[1].organizations == ["Acme"] and rows[2].locations == []
    assert mentions.entities(docs, "id", names, longest=2).where("id = 1").first().locations == ["New York", "New York"]


def test_python_and_spark_split_alike(spark, data):
    from postlens.functions import text as X

    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", X.sentences(F.col("text")).alias("s"),
                                                                  F.regexp_extract_all("text", F.lit(f"({mentions.WORD_RUN})"), 1).alias("w"))
    for r in docs.collect():
        text = r["text"] or ""
        cut = [m.group().strip(X.SPACE_CHARS) for m in phrases.SENTENCE.finditer(text)]
        assert [s for s in cut if s] == (r["s"] or []) and phrases.WORD.findall(text) == (r["w"] or [])


def test_results_of_a_batch_are_held_in_parts(monkeypatch):
    monkeypatch.setattr(phrases, "PART_ROWS", 3)
    held = []
    array = phrases.pa.array
    monkeypatch.setattr(phrases.pa, "array", lambda values, *a, **k: held.append(len(values)) or array(values, *a, **k))

    class Sent:
        value = phrases.Automaton([("Rome", "GPE")])

    taken = {}
    monkeypatch.setattr(phrases.F, "arrow_udf", lambda kind: lambda run: taken.setdefault("run", run) and (lambda c: c))
    phrases._over_texts("int", lambda t, a: len(a.hits(t.split())), phrases.pa.int32(), phrases.Names(Sent()))
    out = [x for part in taken["run"](iter([array(["Rome"] * 8)])) for x in part.to_pylist()]
    assert out == [1] * 8 and held == [3, 3, 2]
