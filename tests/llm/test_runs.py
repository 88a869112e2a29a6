import hashlib
import itertools
import random
import zlib

import duckdb
import pytest
from brute import words
from oracle import compare, connect
from postlens.llm import runs as R
from postlens.llm.catalog import oracles, queries
from pyspark.sql import functions as F


def brute(own, copies=4, least=6):
    """All runs by trying every period and every maximal stretch."""
    n, out = len(own), []
    for q in range(1, n // copies + 1):
        i = 0
        while i + q < n:
            if own[i] != own[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and own[j] == own[j + q]:
                j += 1
            start, length = i, j - i + q
            smaller = any(all(own[k] == own[k + d] for k in range(start, start + length - d)) for d in range(1, q))
            if length >= max(least, copies * q) and not smaller:
                out.append((start, length, q))
            i = j
    return sorted(out)


def collapsed(own, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return [w for i, w in enumerate(own) if i not in gone]


def test_all_short_texts_of_two_words():
    for n in range(1, 14):
        for own in itertools.product((b"a", b"b"), repeat=n):
            assert R.find_runs(list(own)) == brute(own)


@pytest.mark.parametrize("seed", range(60))
def test_random_texts_with_planted_runs(seed):
    draw = random.Random(seed)
    own = []
    for _ in range(draw.randint(1, 6)):
        own += [b"w%d" % draw.randint(0, draw.choice([1, 3, 30])) for _ in range(draw.randint(0, 30))]
        unit = [b"w%d" % draw.randint(0, 4) for _ in range(draw.randint(1, 17))]
        times = draw.randint(2, 9)
        own += (unit * times)[: max(1, len(unit) * times - draw.randint(0, len(unit)))]
    found = R.find_runs(own)
    assert found == brute(own)
    assert R.kept_words(own, found) == collapsed(own, found)


def test_splitting_leaves_little_of_prose_and_all_of_runs():
    draw = random.Random(1)
    prose = [b"w%d" % min(int(draw.paretovariate(0.7)), 5000) for _ in range(20_000)]
    places, _ = R.surviving(R.numbered(prose), 4, 6)
    assert len(places) < 0.2 * len(prose)
    loop = prose[:50] * 5
    places, _ = R.surviving(R.numbered(loop), 4, 6)
    assert len(places) == len(loop)


def test_very_long_texts_are_near_linear():
    draw = random.Random(2)
    two = [draw.choice((b"a", b"b")) for _ in range(300_000)]
    unit = [b"u%d" % i for i in range(70_001)]
    assert R.find_runs(unit * 5) == [(0, 5 * 70_001, 70_001)]
    assert R.find_runs([b"x"] * 1_000_000) == [(0, 1_000_000, 1)]
    assert all(n >= max(6, 4 * q) for _, n, q in R.find_runs(two))


def plant(doc_id, text):
    own = words(text)
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(own)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        own = [own[i] if i < a else own[a + (i - a) % p] for i in range(n)]
    return own


def test_query_against_brute_force(spark, data):
    documents = duckdb.sql(f"SELECT doc_id, text FROM '{data}/documents.parquet' WHERE length(text) < 4000 OR doc_id % 5 = 0").fetchall()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {r["doc_id"]: r for r in queries()["op12_periodic_runs"](spark, data).collect()}
    for i, text in documents:
        own = plant(i, text)
        if len(own) > 1500:
            continue
        found, row = brute(own), got[i]
        best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None,) * 3
        assert (row["n_runs"], row["start"], row["length"], row["period"]) == (len(found), *best)
        assert row["exponent_milli"] == (1000 * best[1] // best[2] if found else None)
        assert row["runs_sha256"] == sha("".join(f"{s},{n},{q}\n" for s, n, q in found))
        assert row["collapsed_sha256"] == sha(" ".join(collapsed(own, found)))


def test_matches_oracle(spark, data):
    assert compare(spark, connect(data), data, queries()["op12_periodic_runs"], oracles()["op12_periodic_runs"]) is None


def test_edges(edge, empty, odd_ids, spark):
    got = {r["doc_id"]: r for r in R.periodic_runs(edge).collect()}
    assert len(got) == 20 and got[4]["collapsed"] == got[5]["collapsed"] == got[6]["collapsed"] == ""
    assert got[4]["n_words"] == 0 and got[4]["runs"] == []
    assert [tuple(r) for r in got[19]["runs"]] == [(0, 600, 1)] and got[19]["collapsed"] == "the"
    assert got[15]["_id"] is None and got[16]["_id"] == "_id16"
    clash = edge.select("doc_id", "text", F.lit(1).alias("runs"), F.lit(2).alias("n_words"), F.lit(3).alias("_scan_doc_id_text"))
    assert R.periodic_runs(clash).columns == ["doc_id", "text", "_scan_doc_id_text", "n_words", "runs", "collapsed"]
    assert R.periodic_runs(clash, prefix="p_").first()["runs"] == 1
    assert R.periodic_runs(odd_ids).count() == 7 and R.periodic_runs(empty).count() == 0


def test_runs_that_overlap_and_nest():
    own = [b"a"] * 6 + [b"b"] + ([b"a"] * 6 + [b"b"]) * 4
    assert R.find_runs(own) == brute(own)
    assert len(R.find_runs(own)) == 6
    with pytest.raises(ValueError):
        R.find_runs(own, copies=3)
