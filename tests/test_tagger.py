"""The name tagger: decoding against every sequence, learning on held-out texts."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from postlens.operators import mentions, phrases, tagger as T


def best_of_all(emission, transition):
    score = lambda tags: sum(transition[(0, *[t + 1 for t in tags])[i], t] + emission[i, t] for i, t in enumerate(tags))
    return max(itertools.product(range(len(T.TAGS)), repeat=len(emission)), key=score), score


@pytest.mark.parametrize("seed", range(20))
def test_viterbi_equals_trying_all(seed):
    draw = np.random.default_rng(seed)
    transition = draw.normal(size=(len(T.TAGS) + 1, len(T.TAGS))) + T.follows()
    emissions = [draw.normal(size=(n, len(T.TAGS))) for n in (0, 1, 3, 5, 2, 5, 4)]
    for emission, tags in zip(emissions, T.viterbi(emissions, transition)):
        best, score = best_of_all(emission, transition)
        assert len(tags) == len(emission)
        if len(emission):
            assert score(tags.tolist()) == pytest.approx(score(best)) and tags.tolist() == list(best)


def test_an_inner_tag_follows_its_own_kind():
    table = T.follows()
    at = {t: i for i, t in enumerate(T.TAGS)}
    assert table[0, at["I-GPE"]] == T.FORBIDDEN and table[1 + at["B-ORG"], at["I-GPE"]] == T.FORBIDDEN
    assert table[1 + at["B-GPE"], at["I-GPE"]] == table[1 + at["I-GPE"], at["I-GPE"]] == table[1 + at["I-GPE"], at["B-ORG"]] == 0


def test_marks_take_the_longest_from_the_left():
    automaton = phrases.Automaton([("New York", "GPE"), ("New York City", "GPE"), ("City Hall", "ORG"), ("Hall", "GPE")])
    words = "in New York City Hall today".split()
    tags = T.marked(words, automaton)
    assert [T.TAGS[t] for t in tags] == ["O", "B-GPE", "I-GPE", "I-GPE", "B-GPE", "O"]
    assert T.named(words, tags) == {"GPE": ["New York City", "Hall"], "ORG": []}


@pytest.fixture(scope="module")
def texts(spark):
    draw = np.random.default_rng(2)
    cities = [f"{a}{b}" for a in ("Ost", "West", "Nord", "Sud") for b in ("burg", "heim", "stadt", "dorf", "feld")]
    firms = [f"{a} {b}" for a in ("Acme", "Globex", "Initech", "Umbrella", "Hooli") for b in ("Tools Ltd", "Foods Ltd", "Cars Ltd")]
    rest = "we hire people who work with care and pay well for a good week".split()
    rows = []
    for i in range(600):
        words = lambda: " ".join(draw.choice(rest, draw.integers(1, 6)))
        rows.append((i, f"{words()} in {draw.choice(cities)} {words()}. {words()} at {draw.choice(firms)} {words()}. {words()}."))
    docs = spark.createDataFrame(rows, "id int, text string").repartition(4)
    names = spark.createDataFrame([(c, "GPE") for c in cities] + [(f, "ORG") for f in firms], "phrase string, kind string")
    return docs, names, set(cities[::4]), set(firms[::4])


def test_names_it_never_learned(spark, texts):
    docs, names, unseen_cities, unseen_firms = texts
    unseen = unseen_cities | unseen_firms
    listed = names.where(~F.col("phrase").isin(list(unseen)))
    holds = F.lit(False)
    for name in unseen:
        holds = holds | F.col("text").contains(name)
    model = T.train_tagger(docs.where(~holds), listed, "id")
    held = docs.where(holds)
    truth = mentions.entities(held, "id", names).select("id", F.col("locations").alias("l"), F.col("organizations").alias("o"))
    rows = T.tagged_names(held, model).join(truth, "id").collect()
    hit = guessed = real = 0
    for r in rows:
        for found, want in ((r["locations"], r["l"]), (r["organizations"], r["o"])):
            hit += len(set(found) & set(want))
            guessed += len(found)
            real += len(want)
    precision, recall = hit / guessed, hit / real
    assert len(rows) > 100 and 2 * precision * recall / (precision + recall) > 0.85


def test_listed_names_on_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    names = spark.createDataFrame([("the", "ORG"), ("of the", "GPE"), ("und", "GPE"), ("que", "ORG")], "phrase string, kind string")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    model = T.train_tagger(docs.where(~held), names, "doc_id", settings=T.Learning(epochs=3, sample_rows=300))
    automaton = phrases.Automaton([("of the", "GPE"), ("que", "ORG"), ("the", "ORG"), ("und", "GPE")])
    hit = guessed = real = 0
    for r in T.tagged_names(docs.where(held).limit(150), model).collect():
        want = {k: [] for k in T.KINDS}
        for m in phrases.SENTENCE.finditer(r["text"] or ""):
            words = phrases.WORD.findall(m.group())
            for kind, found in T.named(words, T.marked(words, automaton)).items():
                want[kind] += found
        for found, right in ((r["locations"], want["GPE"]), (r["organizations"], want["ORG"])):
            hit += sum(min(found.count(n), right.count(n)) for n in set(right))
            guessed, real = guessed + len(found), real + len(right)
    assert hit / guessed > 0.95 and hit / real > 0.95


def test_repeats_and_empty(spark, texts):
    docs, names, *_ = texts
    one, two = (T.train_tagger(docs, names, "id", settings=T.Learning(epochs=1)) for _ in range(2))
    assert one.emission.shape == two.emission.shape
    nothing = T.train_tagger(docs.limit(0), names, "id")
    got = T.tagged_names(spark.createDataFrame([(1, None), (2, ""), (3, "in Ostburg")], "id int, text string"), nothing).collect()
    assert all(r["locations"] == [] and r["organizations"] == [] for r in got)


def test_texts_are_dealt_out_however_large_the_splits(spark, monkeypatch):
    monkeypatch.setattr(T, "TASK_TEXTS", 10)
    docs = spark.createDataFrame([(i, "we go to Rome.") for i in range(200)], "id int, text string").coalesce(1)
    tagger = T.Tagger(np.zeros((64, len(T.TAGS))), np.zeros((len(T.TAGS) + 1, len(T.TAGS))))
    found = T.tagged_names(docs, tagger)
    assert "Exchange RoundRobinPartitioning(20)" in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 200


def test_texts_beyond_any_sample_are_learned_from(spark):
    """20,400 texts, of which only those of greatest key hash hold a name."""
    ids = spark.range(20_400).select(F.col("id").cast("int").alias("id"), F.xxhash64(F.col("id").cast("int")).alias("h"))
    last = ids.orderBy(F.desc("h")).limit(300).select("id", F.lit(True).alias("named"))
    docs = ids.join(last, "id", "left").select("id", F.when(F.col("named"), "they went to Ostburg today").otherwise("they went home").alias("text"))
    model = T.train_tagger(docs, spark.createDataFrame([("Ostburg", "GPE")], "phrase string, kind string"), "id")
    found = T.tagged_names(spark.createDataFrame([(1, "they went to Ostburg today"), (2, "they went home")], "id int, text string"), model)
    assert {r["id"]: r["locations"] for r in found.collect()} == {1: ["Ostburg"], 2: []}


def test_decoding_ahead_learns_what_single_batches_teach():
    draw, buckets = np.random.default_rng(3), 64
    sizes = draw.integers(1, 9, 200)
    ends = np.cumsum(sizes).astype(np.int32)
    own = draw.integers(0, buckets, (int(ends[-1]), T.WIDTH))
    tags = np.where(own[:, 0] < 8, T.TAGS.index("B-GPE"), 0)
    start = np.zeros((buckets, len(T.TAGS))), np.zeros((len(T.TAGS) + 1, len(T.TAGS)))
    emission, transition = (x.copy() for x in start)
    summed, steps, wrong = 0, 0, 0
    spans = list(zip(ends - sizes, ends))
    for at in range(0, len(spans), T.BATCH):
        part = spans[at:at + T.BATCH]
        guesses = T.viterbi([emission[own[a:b]].sum(1) for a, b in part], transition + T.follows())
        for (a, b), guess in zip(part, guesses):
            off = np.flatnonzero(tags[a:b] != guess)
            wrong += len(off) > 0
            if len(off):
                for path, sign in ((tags[a:b], 1.0), (guess, -1.0)):
                    np.add.at(emission, (own[a:b][off], path[off, None]), sign)
                    np.add.at(transition, (np.concatenate([[0], path[:-1] + 1]), path), sign)
        summed, steps = summed + np.concatenate([emission.ravel(), transition.ravel()]), steps + 1
    got = T.learn([(own, tags, ends)], *start)
    want = np.concatenate([emission.ravel(), transition.ravel(), summed / steps, [1.0, wrong, len(spans)]])
    assert 0 < wrong < len(spans) and np.allclose(got, want, rtol=0, atol=1e-12)
