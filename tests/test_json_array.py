"""Splittable JSON arrays: any split size, any content."""

import json
import random

import pytest
from hypothesis import given, settings, strategies as st

from postlens.sinks import stores
from postlens.sources import json_array as A, rows
from postlens.schemas import BANDED_POSTING

SPLITS = [100, 1 << 20]


@pytest.fixture
def split_at(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    before = {n: spark.conf.get(n, None) for n in names}

    def at(size):
        spark.conf.set(names[0], str(size))
        spark.conf.set(names[1], "0")
        spark.conf.set(names[2], "1")

    yield at
    for name, value in before.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def odd(n, seed=1):
    draw = random.Random(seed)
    parts = ['"', "\\", ",", "[", "]", "{", "}", "ü", "\n", " ", "x", '\\"', "😀"]
    return ["".join(draw.choice(parts) for _ in range(draw.randint(0, 40))) for _ in range(n)]


@pytest.mark.parametrize("size", SPLITS)
@pytest.mark.parametrize("style", [{"indent": 2}, {"separators": (",", ":"), "ensure_ascii": False}])
def test_texts_of_any_split(spark, tmp_path, split_at, size, style):
    texts = odd(60)
    (tmp_path / "a.json").write_text(json.dumps(texts, **style), encoding="utf-8")
    (tmp_path / "b.json").write_text(" \n" + json.dumps(texts[:5], **style) + " \n", encoding="utf-8")
    split_at(size)
    got = rows.read_json_strings(spark, str(tmp_path)).collect()
    by = {}
    for r in got:
        by.setdefault(r["file"][-6:], []).append((r["pos"], r["text"]))
    assert {f: sorted(x) for f, x in by.items()} == {"a.json": list(enumerate(texts)), "b.json": list(enumerate(texts[:5]))}


@pytest.mark.parametrize("size", SPLITS)
def test_objects_of_any_split(spark, tmp_path, split_at, size):
    texts = odd(40, 2)
    objects = [{"title": t, "category": "c", "salary": float(i), "experience": 1.5, "more": {"a": [1, {"b": t}]}} for i, t in enumerate(texts)]
    (tmp_path / "a.json").write_text(json.dumps(objects))
    split_at(size)
    got = rows.read_postings_json(spark, str(tmp_path / "a.json")).collect()
    assert sorted((r["title"], r["salary"]) for r in got) == sorted((o["title"], o["salary"]) for o in objects)


@pytest.mark.parametrize("text, want", [
    ("[]", 0), (" [ \n ] ", 0), ('[{"title": "a"}]', 1), ('{"title": "a", "category": "b,c"}', 1), ('[{"title": "a"}, {"title": "b', 1),
    ('[{"title": "a"}, 5, {"title": "b"}]', 2), ("", 0), ("not, json", 0), ('[[{"title": "a"}], {"title": "b"}]', 1),
    ("[" + ", ".join(['{"title": "' + "x," * 300 + '"}'] * 3) + "]", 3),
])
@pytest.mark.parametrize("size", [16])
def test_odd_files(spark, tmp_path, split_at, text, want, size):
    (tmp_path / "a.json").write_text(text)
    split_at(size)
    assert rows.read_postings_json(spark, str(tmp_path / "a.json"), BANDED_POSTING).count() == want


def test_not_a_list_raises(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"a": ["x", "y"]}')
    with pytest.raises(Exception, match="expected a JSON list"):
        rows.read_json_strings(spark, str(tmp_path / "a.json")).collect()


def test_join_of_states_beyond_the_limit(spark, tmp_path, split_at, monkeypatch):
    texts = odd(60, 3)
    (tmp_path / "a.json").write_text(json.dumps(texts))
    split_at(64)
    monkeypatch.setattr(A, "SPLIT_ROWS", 0)
    got = rows.read_json_strings(spark, str(tmp_path)).orderBy("pos").collect()
    assert [r["text"] for r in got] == texts


@settings(max_examples=200, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.integers() | st.text(), lambda c: st.lists(c) | st.dictionaries(st.text(), c), max_leaves=12))
def test_effects_compose(value):
    text = json.dumps([value])
    state, depth = False, 0
    for part in text.split(","):
        odd_, plain, quoted = A.effect(part)
        depth += quoted if state else plain
        state ^= odd_
    assert (state, depth) == (False, 0)


def test_written_arrays_read_back(spark, tmp_path):
    texts = [*odd(30, 4), None]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(4)
    path = stores.write_json_arrays(df, str(tmp_path / "texts"))
    got = [r["text"] for r in rows.read_json_strings(spark, path).collect()]
    assert sorted(got, key=str) == sorted(texts, key=str)
    assert rows.read_json_strings(spark, stores.write_json_arrays(df.limit(0), str(tmp_path / "none"))).count() == 0
