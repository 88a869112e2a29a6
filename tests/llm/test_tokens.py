import collections
import random
import time
import zlib

import brute
import numpy as np
import public_tokenizers
import pytest
from postlens.llm import bpe, packing, token_counts
from postlens.llm.catalog import queries
from postlens.llm.tokens import PieceEncoder, in_slices, pieces
from postlens.session import scratch_path
from pyspark.sql import functions as F
from tokenizers import Tokenizer

FILE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(FILE)


def packed(library, texts):
    return [np.array(e.ids, "<u4").tobytes() for e in library.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("kind", [PieceEncoder, bpe.TrieEncoder])
def test_encoders_equal_the_library_on_every_code_point(kind, library):
    codec = kind(FILE)
    points = [c for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    for at in range(0, len(points), 100_000):
        texts = [f"x{chr(c)}y 1{chr(c)} {chr(c)}" for c in points[at:at + 100_000]]
        assert codec.encode(texts) == packed(library, texts)


@pytest.mark.parametrize("kind", [PieceEncoder, bpe.TrieEncoder])
def test_encoders_equal_the_library_on_mixtures(kind, library):
    draw = random.Random(8)
    parts = ["a", " ", "\n", "  ", "é", "1", "'s", "'", "!", "<|endoftext|>", "<", "ab", "the", "\t", "　", "世界", "\x1c",
             "x" * 50, "-" * 9, "\r", "\u0085", "ing", "tion"]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randint(0, 16))) for _ in range(20_000)]
    texts += ["", "a" * 5000, "the" * 3000, "\n" * 400, " " * 400, "<|endoftext|>" * 30]
    small = kind(FILE)
    small.limit = 500  # what is remembered may be full at any time
    assert kind(FILE).encode(texts) == packed(library, texts)
    for part in in_slices(texts, 20_000):
        assert small.encode(part) == packed(library, part)


def test_pieces_join_to_the_text():
    for text in ("", " ", "   ", "a  b", "a   b ", " a", "a \n b", "\n \n"):
        assert " ".join(pieces(text)) == text


def test_tokens_of_a_word_share_its_prefix():
    vocabulary = bpe.Vocabulary(FILE)
    words = [b"token", b"tokens", b"tokenizer", b" tokenization", b"\xff\x00\xfe", b"t"]
    found = vocabulary.encode_words(words)
    assert {w: b"".join(vocabulary.table[i] for i in np.frombuffer(p, "<u4").tolist()) for w, p in found.items()} == {w: w for w in words}


def test_round_trip_of_edges(edge, edge_texts, empty, library):
    coded = bpe.decode(bpe.encode(edge, FILE), FILE)
    for row in coded.collect():
        text = edge_texts[row["doc_id"]] or ""
        assert bytes(row["ids"]) == packed(library, [text])[0] and row["decoded"] == text
    assert bpe.decode(bpe.encode(empty, FILE), FILE).count() == 0


def test_decoding_bytes_that_are_not_text(spark, library):
    ids = [[447], [447, 247], [564, 13], [50256, 11]]
    frame = spark.createDataFrame([(i, bytearray(np.array(x, "<u4").tobytes())) for i, x in enumerate(ids)] + [(9, None)], "i int, ids binary")
    got = {r["i"]: r["decoded"] for r in bpe.decode(frame, FILE).collect()}
    assert got == {i: library.decode(x, skip_special_tokens=False) for i, x in enumerate(ids)} | {9: ""}


def test_op5_on_documents(spark, data, documents, library):
    from postlens.llm.catalog import queries

    for row in queries()["op5_bpe_round_trip"](spark, data).collect():
        ids = library.encode(documents[row["doc_id"]] or "", add_special_tokens=False).ids
        assert (row["n_tokens"], row["ids_sha256"]) == (len(ids), brute.sha(np.array(ids, "<u4").tobytes()))
        assert row["decoded_sha256"] == brute.sha(library.decode(ids, skip_special_tokens=False))


def check_packing(rows, texts, library, capacity=1024):
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for row in rows:
        by_doc[row["doc_id"]].append(row)
        by_sequence[row["sequence_id"]].append((row["offset"], row["length"]))
    assert set(by_doc) == set(texts)
    total = 0
    for one, text in texts.items():
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        at = 0
        own = sorted(by_doc[one], key=lambda r: r["piece"])
        for number, row in enumerate(own):
            part = ids[at:at + row["length"]]
            assert (row["piece"], row["start"], row["ids_crc32"]) == (number, at, zlib.crc32(part.tobytes()))
            assert number == 0 or row["length"] == capacity
            at += row["length"]
        assert at == len(ids) and (len(own) == 1 or len(ids) > capacity)
        total += len(ids)
    for places in by_sequence.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    return len(by_sequence), -(-total // capacity)


def test_packing_of_edges(edge, edge_texts, empty, odd_ids, library):
    rows = packing.pack_documents(edge, FILE).collect()
    used, least = check_packing(rows, edge_texts, library)
    assert used <= least + 1
    assert packing.pack_documents(empty, FILE).count() == 0
    assert packing.pack_documents(odd_ids, FILE).count() == 7


def test_op2_on_documents(spark, data, documents, library):
    from postlens.llm.catalog import queries

    used, least = check_packing(queries()["op2_best_fit_packing"](spark, data).collect(), documents, library)
    assert used <= 1.02 * least + 1


def simple_best_fit(lengths, capacity):
    free = []
    for n in sorted(lengths, reverse=True):
        fits = [f for f in free if f >= n]
        if fits:
            free.remove(min(fits))
            free.append(min(fits) - n)
        else:
            free.append(capacity - n)
    return len(free)


def test_plan_by_counts_packs_like_best_fit_over_documents():
    draw = random.Random(2)
    for trial in range(60):
        lengths = [draw.randint(1, draw.choice([10, 60, 100])) for _ in range(draw.randint(1, 400))]
        plan = packing.plan_slots(collections.Counter(lengths), 100)
        used = collections.defaultdict(list)
        for length, first, end, sequence, per, base in plan:
            for k in range(end - first):
                used[sequence + k // per].append((base + k % per * length, length))
        for places in used.values():
            end = 0
            for offset, length in sorted(places):
                assert offset == end
                end += length
            assert end <= 100
        assert sorted(n for places in used.values() for _, n in places) == sorted(lengths)
        assert len(used) == simple_best_fit(lengths, 100)


def test_the_plan_does_not_grow_with_the_counts():
    histogram = {n: 1_000_003 * n % 77_777_777 + 5 for n in range(1, 1025)}
    assert len(packing.plan_slots(histogram, 1024)) < 30_000


def test_slots_with_clashing_columns(spark):
    rows = [(i % 3, 0, 7, "x", None) for i in range(10)] + [(None, None, None, "y", 1), (5, 0, 0, None, 2)]
    pieces_ = spark.createDataFrame(rows, "doc_id bigint, piece int, length bigint, first_rank string, sequence_id int")
    got = packing.best_fit(pieces_, 20).collect()
    assert len(got) == 12 and len({(r["sequence_id"], r["offset"]) for r in got if r["length"]}) == 10
    assert all(r["sequence_id"] is None for r in got if not r["length"])
    with pytest.raises(ValueError):
        packing.best_fit(pieces_, 5)


@pytest.mark.parametrize("block", [1, 3, 64, 1 << 18])
def test_token_counts_across_blocks(spark, edge, edge_texts, library, block):
    folder = scratch_path(spark, "flat-test")
    token_counts.write_flat(edge.repartition(2), FILE, folder, 50256)
    if block == 1:
        folder_rows = edge.where("doc_id in (4, 5, 7, 15, 18)")
        folder = scratch_path(spark, "flat-test")
        token_counts.write_flat(folder_rows, FILE, folder, 50256)
        edge_texts = {i: edge_texts[i] for i in (4, 5, 7, 15, 18)}
    rows = token_counts.count_tokens(spark, folder, 50256, block=block).collect()
    plain = Tokenizer.from_file(FILE)
    plain.encode_special_tokens = True  # their strings end no document
    want = collections.Counter(len(plain.encode(text or "", add_special_tokens=False).ids) for text in edge_texts.values())
    assert collections.Counter(r["n_tokens"] for r in rows) == want and all(r["ended"] for r in rows)
    for file in {r["file"] for r in rows}:
        own = sorted((r["doc_no"], r["start"], r["n_tokens"]) for r in rows if r["file"] == file)
        assert [x[0] for x in own] == list(range(len(own)))
        assert all(a[1] + a[2] + 1 == b[1] for a, b in zip(own, own[1:]))


def test_open_ends_and_empty_files(spark, tmp_path):
    for name, ids in {"a": [9, 9, 7, 7, 3, 9, 1, 2], "b": [], "c": [1], "d": [9]}.items():
        (tmp_path / name).write_bytes(np.array(ids, "<u2").tobytes())
    for block in (1, 2, 100):
        rows = token_counts.count_tokens(spark, str(tmp_path), 9, block=block).collect()
        got = sorted((r["file"][-1], r["doc_no"], r["start"], r["n_tokens"], r["ended"]) for r in rows)
        assert got == [("a", 0, 0, 0, True), ("a", 1, 1, 0, True), ("a", 2, 2, 3, True), ("a", 3, 6, 2, False),
                       ("c", 0, 0, 1, False), ("d", 0, 0, 0, True)]


def test_no_documents_no_counts(spark, empty):
    folder = scratch_path(spark, "flat-test")
    token_counts.write_flat(empty, FILE, folder, 50256)
    assert token_counts.count_tokens(spark, folder, 50256).count() == 0


def test_counts_by_document(spark, data, documents):
    rows = queries()["op8_token_counts"](spark, data).collect()
    plain = Tokenizer.from_file(FILE)
    plain.encode_special_tokens = True
    assert {r["doc_id"]: r["n_tokens"] for r in rows} == {i: len(plain.encode(t or "", add_special_tokens=False).ids) for i, t in documents.items()}
    assert len(rows) == len(documents) and all(r["ended"] for r in rows)


def test_end_of_text_in_a_text_ends_nothing(spark):
    docs = spark.createDataFrame([(1, "a <|endoftext|> b"), (2, "c")], "doc_id bigint, text string").coalesce(1)
    folder = scratch_path(spark, "flat-test")
    token_counts.write_flat(docs, FILE, folder, 50256)
    found = token_counts.count_tokens(spark, folder, 50256)
    assert found.count() == 2
    places = token_counts.written_places(docs).join(found, "doc_no").collect()
    assert {r["doc_id"] for r in places} == {1, 2}


def test_a_partition_is_written_as_small_files(spark, monkeypatch):
    docs = spark.range(1100).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("some words of"), "id").alias("text")).repartition(2, "doc_id")
    whole, cut = scratch_path(spark, "flat-test"), scratch_path(spark, "flat-test")
    monkeypatch.setattr(token_counts, "FILE_ROWS", 10_000)
    token_counts.write_flat(docs, FILE, whole, 50256)
    monkeypatch.setattr(token_counts, "FILE_ROWS", 50)
    token_counts.write_flat(docs, FILE, cut, 50256)
    longest = spark.read.format("binaryFile").load(cut).agg(F.max("length"), F.count("*")).first()
    assert longest[0] < 1000 and longest[1] > 20

    def rows(folder):
        found = token_counts.count_tokens(spark, folder, 50256, block=64, joined=True)
        return sorted((r["file"].split("part-")[1][:5], *r[1:]) for r in found.collect())

    assert rows(cut) == rows(whole) and len(rows(cut)) == 1100


LONG_RUNS = ["\n" * 60_000, "a" + "\n" * 60_000 + "b", " " * 60_000 + "x", "a" + " \t" * 30_000, "a" + "\u3000" * 25_000 + " word" + "\r\n" * 25_000 + "'s"]


@pytest.mark.parametrize("text", LONG_RUNS)
def test_long_white_space_as_the_library(library, text):
    want = library.encode(text, add_special_tokens=False).ids
    for codec in (PieceEncoder(FILE), bpe.TrieEncoder(FILE)):
        assert list(np.frombuffer(codec.encode([text])[0], "<u4")) == want


@pytest.mark.parametrize("text", ["\n" * 1_500_000, " " * 1_500_000, "x " * 500_000 + " " * 1_000_000, "a\n" * 700_000])
def test_very_long_white_space_ends_soon(text):
    start = time.time()
    for codec in (PieceEncoder(FILE), bpe.TrieEncoder(FILE)):
        assert len(codec.encode([text])[0])
    assert time.time() - start < 30
