import collections
import hashlib
import zlib

import duckdb
import pytest
from oracle import compare, connect
from postlens.llm import merkle as M
from postlens.llm.catalog import oracles, queries
from pyspark.sql import functions as F


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i:i + 16]) for i in range(0, len(levels[-1]), 16)])
    return levels


def path(levels, i):
    out = []
    for level in levels[:-1]:
        run = level[i // 16 * 16:i // 16 * 16 + 16]
        out.append((i % 16, run[:i % 16] + run[i % 16 + 1:]))
        i //= 16
    return out


def brute(docs):
    """{id: expected row} of ``(doc_id, source, lang, n_chars, text)`` rows."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: H(*map(field, r))
    by = collections.defaultdict(list)
    for r in docs:
        by[r[1]].append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([leaf(r) for r in sorted(by[s], key=lambda r: r[0])]) for s in names}
    top = tree([trees[s][-1][0] for s in names])
    out = {}
    for k, s in enumerate(names):
        for i, r in enumerate(sorted(by[s], key=lambda r: r[0])):
            steps = path(trees[s], i) + path(top, k)
            digest = leaf(r)
            if zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                digest = leaf((*r[:4], r[4].translate({c: c + 32 for c in range(65, 91)})))
            for place, others in steps:
                digest = H(*others[:place], digest, *others[place:])
            proof = H(*[d for _, others in steps for d in others])
            out[r[0]] = (leaf(r), trees[s][-1][0], top[-1][0], proof, digest, digest == top[-1][0])
    return out


def rows_of(df):
    return {r["doc_id"]: tuple(r)[1:] for r in df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()}


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 255, 256, 257, 273, 4095, 4096, 4097, 5000])
def test_positions_follow_the_order_nodes_are_complete(n):
    order, waiting = [], [0] * (M.height(n) + 1)
    for i in range(n):
        index = i
        for level in range(M.height(n) + 1):
            order.append((level, index))
            waiting[level] += 1
            if level == M.height(n) or (waiting[level] < 16 and i < n - 1):
                break
            waiting[level], index = 0, index // 16
    assert [M.position(n, level, index) for level, index in order] == list(range(len(order)))


def test_blocks_and_paths_without_spark():
    for n in (1, 5, 16, 100, 256, 257, 700):
        leaves = [H(str(i)) for i in range(n)]
        levels = tree(leaves)
        if n <= 256:
            at, nodes = M.build_block(leaves, 0, 0, n)
            assert at == list(range(len(nodes))) and nodes[-1] == levels[-1][0]
        for block in range(-(-n // 256)):
            at, nodes = M.build_block(leaves[block * 256:block * 256 + 256], block, 0, n)
            for i, steps in enumerate(M.block_paths(dict(zip(at, nodes)), block, 0, n)):
                want = [(p, "".join(o)) for p, o in path(levels, block * 256 + i)][:2]
                assert steps == want


def documents_frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars int, text string")


def made(docs):
    fields = [F.col(f) for f in ("doc_id", "source", "lang", "n_chars", "text")]
    return M.manifest(docs, fields, F.col("source"), F.col("doc_id"), keep=["doc_id"])


def test_hot_source_many_small_ones_and_nulls(spark, tmp_path):
    rows = [(i, "hot", "en", i, f"Text {i}") for i in range(4500)]
    rows += [(5000 + i, f"s{i}", None, None, None if i % 3 else "Über") for i in range(300)]
    rows += [(6000, None, "de", 0, ""), (6001, None, None, None, None), (6002, "", "x", 1, "Ä"), (-3, "hot", "en", 1, "A")]
    docs = documents_frame(spark, rows).repartition(5)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = rows_of(queries()["op13_merkle_manifest"](spark, str(tmp_path)))
    assert got == brute(rows)
    log = made(docs).log()
    sizes = {r["tree"]: (r["n"], r["top"]) for r in log.groupBy("tree").agg(F.count("*").alias("n"), F.max("position").alias("top")).collect()}
    assert all(n == top + 1 for n, top in sizes.values())
    assert sizes["=hot"][0] == sum(M.size_at(4501, k) for k in range(M.height(4501) + 1))


def test_lone_leaf_and_empty_table(spark):
    one = M.proofs(made(documents_frame(spark, [(7, None, None, None, None)]))).first()
    assert one["leaf"] == one["subroot"] == one["root"] == one["folded_root"] == H("1:7----") and one["proof_sha256"] == H("")
    assert M.proofs(made(documents_frame(spark, []))).count() == 0


def test_repeated_rows_and_other_columns(spark):
    rows = [(1, "a", "en", 1, "x")] * 20 + [(1, "a", "en", 1, "y"), (None, "a", "en", 1, "x")] + [(None, None, None, None, None)] * 2
    docs = documents_frame(spark, rows).withColumns({"_tree": F.lit(1), "leaf": F.lit(None), "_rows": F.lit("r"), "digest": F.lit(2)})
    got = M.proofs(made(docs)).collect()
    assert len(got) == 24 and all(r["verified"] for r in got)
    assert len({r["root"] for r in got}) == 1


def test_matches_oracle_and_tells_the_tampered(spark, data):
    assert compare(spark, connect(data), data, queries()["op13_merkle_manifest"], oracles()["op13_merkle_manifest"]) is None
    rows = duckdb.sql(f"SELECT doc_id, source, lang, n_chars, text FROM '{data}/documents.parquet'").fetchall()
    assert rows_of(queries()["op13_merkle_manifest"](spark, data)) == brute(rows)
