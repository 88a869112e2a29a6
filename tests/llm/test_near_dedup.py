import math
import random

import brute
import numpy as np
from postlens.llm import graph, near_dedup as N
from pyspark.sql import functions as F


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def expected(texts, percent):
    return [(i, n, c, c == i) for i, (n, c) in brute.near_duplicates(texts, percent).items()]


def test_components_are_the_smallest_node(spark):
    edges = [(9, 5), (5, 7), (7, 1), (20, 21), (21, 22), (22, 23), (23, 24), (24, 20), (3, 3), (5, 9)]
    found = graph.components(spark.createDataFrame(edges, "u bigint, v bigint"))
    assert rows_of(found) == sorted([(n, 1) for n in (1, 5, 7, 9)] + [(n, 20) for n in range(20, 25)], key=str)
    assert graph.components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_long_chain(spark):
    chain = [(i, i + 1) for i in range(60)]
    random.Random(1).shuffle(chain)
    found = graph.components(spark.createDataFrame(chain, "u bigint, v bigint"))
    assert {r["component"] for r in found.collect()} == {0}


def test_bands_and_pruning_keep_their_promise():
    for percent in (80, 85, 90):
        how = N.Similarity(percent=percent)
        t = percent / 100
        assert (1 - t**how.rows) ** how.bands <= how.miss
        for n, least in how.least_matches():
            # a pair at the threshold falls below the limit with a chance near that of the posterior
            assert sum(math.comb(n, m) * t**m * (1 - t) ** (n - m) for m in range(least)) < 50 * how.miss


def test_signatures_estimate_similarity():
    by = N.permutations(2000)
    whole = np.arange(1, 3001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(7)
    same = (N.signature(whole[:2500], by) == N.signature(whole[500:], by)).mean()
    assert abs(same - 2000 / 3000) < 0.04


def test_edges_match_brute_force(edge, edge_texts):
    for percent in (80, 85):
        assert rows_of(N.near_duplicates(edge, N.Similarity(percent=percent))) == sorted(expected(edge_texts, percent), key=str)


def test_repeated_ids_and_missing_ids(odd_ids, empty):
    found = N.near_duplicates(odd_ids).groupBy("doc_id", "component_id", "kept").count()
    assert rows_of(found) == sorted([(1, 1, True, 2), (2, 1, False, 1), (2, 2, True, 1), (3, 2, False, 1), (None, None, True, 2)], key=str)
    assert N.near_duplicates(empty).count() == 0
    assert N.drop_near_duplicates(empty).columns == empty.columns
    assert {r["doc_id"] for r in N.drop_near_duplicates(odd_ids).collect()} == {1, 2, None}


def variants(n, edits, seed, size=150):
    draw = random.Random(seed)
    base = [f"t{draw.randrange(10**6)}" for _ in range(size)]
    out = {}
    for i in range(n):
        own = list(base)
        for _ in range(draw.randrange(edits)):
            own[draw.randrange(size)] = f"v{draw.randrange(10**6)}"
        out[i] = " ".join(own)
    return out


def test_a_large_group_in_one_cell_and_in_many_gives_the_same(spark):
    texts = variants(160, 12, 3) | {1000 + i: t for i, t in variants(40, 4, 4).items()} | {5000 + i: "own text %d " % i * 9 for i in range(20)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    want = sorted(expected(texts, 85), key=str)
    assert rows_of(N.near_duplicates(docs, N.Similarity(percent=85))) == want
    assert rows_of(N.near_duplicates(docs, N.Similarity(percent=85, block_weight=6_000))) == want


def test_filter_keeps_columns_and_one_of_each(edge, edge_texts):
    kept = N.drop_near_duplicates(edge)
    assert kept.columns == edge.columns
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} == {
        i for i, (_, c) in brute.near_duplicates(edge_texts, 80).items() if c == i}


def test_no_pairs_inside_a_bucket(spark):
    """A bucket gives one edge per member, whatever its size."""
    texts = [(i, "same start of a longer text " * 3 + f"end {i}") for i in range(300)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    found = N.near_duplicates(docs).agg(F.countDistinct("component_id")).first()[0]
    assert found >= 1
