"""MinHash near-duplicates with sequential Bayesian verification.

1. Every text gives its shingle set's digest and MinHash signature in one map. Equal
   sets are one class, held by its smallest document id.
2. Signatures are cut in bands; classes that share a band bucket are candidates. A
   bucket is a star around its smallest class, never all its pairs, and the buckets'
   components are the groups inside which links are searched.
3. A group is dealt into blocks of bounded size, and blocks meet in cells. A cell
   compares signatures a batch at a time, drops a pair as soon as its posterior
   chance of reaching the threshold falls under ``miss``, and verifies survivors on
   the full sets. It emits a spanning forest of its links only. A group of more than
   one block first meets its hub; what is linked to the hub is one component already,
   so that afterwards only the rest meets the group.
4. Components of the links give each document its class.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from postlens.llm.graph import components
from postlens.llm.words import few_rows, shingle_set, texts_of
from postlens.operators.scaling import small_side
from postlens.session import written

BATCH = 32
DOC_WEIGHT = 200  # what a class weighs in a block besides its shingles


@dataclass(frozen=True)
class Similarity:
    """Links need ``100 * intersection >= percent * union`` of distinct shingles of ``size`` words."""

    percent: int = 80
    size: int = 5
    rows: int = 6
    miss: float = 1e-5  # chance to miss a link at the threshold, for banding and for pruning each
    block_weight: int = 1_000_000

    @property
    def bands(self) -> int:
        """As many bands as find a pair at the threshold but for the chance ``miss``."""
        return math.ceil(math.log(self.miss) / math.log(1 - (self.percent / 100) ** self.rows))

    @property
    def hashes(self) -> int:
        return self.bands * self.rows

    def least_matches(self) -> list[tuple[int, int]]:
        """After so many hashes compared, the fewest matches that keep a pair alive.

        With a uniform prior, ``m`` of ``n`` matches leave a similarity of Beta(m + 1,
        n - m + 1); its chance to reach t is that of at most m successes in n + 1
        trials of chance t.
        """
        t = self.percent / 100
        limits = []
        for n in [*range(BATCH, self.hashes, BATCH), self.hashes]:
            tail, m = 0.0, -1
            while tail < self.miss:
                m += 1
                tail += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            limits.append((n, m))
        return limits


def permutations(count: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(20240229)
    odd = draw.integers(0, 1 << 32, count, dtype=np.uint32) | np.uint32(1)
    return odd[:, None], draw.integers(0, 1 << 32, count, dtype=np.uint32)[:, None]


def signature(shingles: np.ndarray, by: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Smallest value of each permutation over the set; long sets go in slices."""
    low = shingles.astype(np.uint32)
    parts = [(low[i:i + 1024] * by[0] + by[1]).min(1) for i in range(0, len(low), 1024)]
    return parts[0] if len(parts) == 1 else np.minimum.reduce(parts)


SKETCH = "id bigint, n_shingles bigint, d1 bigint, d2 bigint, sig binary"


def sketches(docs: DataFrame, how: Similarity, id_col: str, text_col: str) -> DataFrame:
    """``(id, n_shingles, d1, d2, sig)`` per row: set size, 128-bit set digest, signature."""
    by = permutations(how.hashes)
    schema = pa.schema([("id", pa.int64()), ("n_shingles", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()),
                        ("sig", pa.binary())])

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, signatures = [], [], []
            for text in texts_of(batch.column(1)):
                found = shingle_set((text or b"").lower().split(), how.size)
                sizes.append(len(found))
                digests.append(xxhash.xxh3_128_digest(found.tobytes()))
                signatures.append(signature(found, by).tobytes() if len(found) else None)
            halves = np.frombuffer(b"".join(digests), np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(halves[::2]), pa.array(halves[1::2]),
                 pa.array(signatures, pa.binary())], schema=schema)

    rows = few_rows(docs).select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(sketch, SKETCH)


def band_keys(sig: Column, how: Similarity) -> Column:
    width = 4 * how.rows
    return F.array(*[F.xxhash64(F.lit(i), F.substring(sig, 1 + i * width, width)) for i in range(how.bands)])


def linked_in(rows: list[tuple[int, bytes, int, bool]], how: Similarity, across: bool) -> list[tuple[int, int]]:
    """A spanning forest of the links among ``(id, text, side, known)``.

    ``across``: only pairs of different sides. Rows with ``known`` are one component
    already. Pairs inside a component are skipped.
    """
    by, limits = permutations(how.hashes), how.least_matches()
    ids = [row[0] for row in rows]
    sets = [shingle_set(row[1].lower().split(), how.size) for row in rows]
    sizes = np.array([len(s) for s in sets])
    side = np.array([row[2] for row in rows])
    label = np.arange(len(rows))
    if known := [i for i, row in enumerate(rows) if row[3]]:
        label[known] = known[0]
    matrix = np.stack([signature(s, by) for s in sets])
    links = []
    for i in range(len(rows) - 1):
        near = np.arange(i + 1, len(rows))
        fits = label[near] != label[i]
        fits &= 100 * np.minimum(sizes[near], sizes[i]) >= how.percent * np.maximum(sizes[near], sizes[i])
        if across:
            fits &= side[near] != side[i]
        near, same, done = near[fits], 0, 0
        same = np.zeros(len(near), np.int64)
        for upto, least in limits:
            if not len(near):
                break
            same += (matrix[near, done:upto] == matrix[i, done:upto]).sum(1)
            alive = same >= least
            near, same, done = near[alive], same[alive], upto
        for j in near[np.argsort(-same, kind="stable")]:
            if label[j] == label[i]:
                continue
            common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if 100 * common >= how.percent * (sizes[i] + sizes[j] - common):
                links.append((ids[i], ids[j]))
                label[label == label[j]] = label[i]
    return links


def cell_links(cells: DataFrame, how: Similarity, across: bool) -> DataFrame:
    """Links found in each cell of ``(grp, a, b, id, text, side, known)``; a cell is two blocks at most."""
    shape = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def search(table: pa.Table) -> pa.Table:
        rows = {}
        columns = [table["id"].to_pylist(), texts_of(table["text"]), table["side"].to_pylist(), table["known"].to_pylist()]
        for row in zip(*columns):
            rows.setdefault(row[:2], row)
        found = linked_in(sorted(rows.values()), how, across)
        return pa.Table.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], schema=shape)

    return cells.groupBy("grp", "a", "b").applyInArrow(search, "u bigint, v bigint")


def block_of(blocks: Column) -> Column:
    return F.pmod(F.xxhash64("id"), blocks).cast("int")


def group_links(texts: DataFrame, groups: DataFrame, how: Similarity) -> DataFrame:
    """All links inside groups, as a forest: ``groups`` is (id, n_shingles, grp, degree)."""
    weight = F.sum(F.col("n_shingles") + DOC_WEIGHT)
    hub = F.max_by("id", F.struct("degree", F.negative("id"))).alias("hub")
    sizes = small_side(groups.groupBy("grp").agg(F.ceil(weight / how.block_weight).cast("int").alias("blocks"), hub), "sizes")
    dealt = written(groups.join(sizes, "grp").select("id", "n_shingles", "grp", "blocks", "hub"), "groups")

    def with_text(rows: DataFrame) -> DataFrame:
        return texts.join(small_side(rows, "cells"), "id")

    none = F.lit(False).alias("known")
    whole = dealt.where("blocks = 1").select("id", "grp", F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("side"), none)
    found = written(cell_links(with_text(whole), how, False), "links")

    large = dealt.where("blocks > 1")
    counts = large.groupBy("grp", "hub", "blocks").count()
    if counts.isEmpty():
        return found
    # the hub meets every block
    own = large.where(F.col("id") != F.col("hub")).select(
        "id", "grp", block_of(F.col("blocks")).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("side"), none)
    hubs = counts.select(F.col("hub").alias("id"), "grp", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("a"),
                         F.lit(0).alias("b"), F.lit(1).alias("side"), none)
    first = written(cell_links(with_text(own.unionByName(hubs)), how, True), "hub-links")

    # linked to the hub: one component; only the others still meet every block
    joined = first.select(F.col("u").alias("id")).unionByName(first.select(F.col("v").alias("id"))).distinct()
    split = large.join(joined.withColumn("known", F.lit(True)), "id", "left")
    split = written(split.select("id", "n_shingles", "grp", F.coalesce("known", F.lit(False)).alias("known")), "split")
    parts = split.groupBy("grp", "known").agg(F.ceil(weight / how.block_weight).cast("int").alias("n"))
    parts = parts.groupBy("grp").agg(F.coalesce(F.max(F.when(F.col("known"), F.col("n"))), F.lit(0)).alias("nh"),
                                     F.coalesce(F.max(F.when(~F.col("known"), F.col("n"))), F.lit(0)).alias("nr"))
    # blocks 0 .. nr-1 hold the others, nr .. nr+nh-1 what is linked; cells are (a, b), a < nr, a <= b
    rows = split.join(parts, "grp").withColumn("k", F.when(F.col("known"), F.col("nr") + block_of(F.col("nh")))
                                               .otherwise(block_of(F.col("nr"))))
    upto = F.sequence(F.lit(0), F.col("nr") + F.col("nh") - 1)
    facing = F.filter(upto, lambda m: F.least(m, F.col("k")) < F.col("nr"))
    rows = rows.select("id", "grp", "known", "k", F.explode(facing).alias("m")).select(
        "id", "grp", F.least("k", "m").alias("a"), F.greatest("k", "m").alias("b"), F.col("k").alias("side"), "known")
    rest = cell_links(with_text(rows), how, False)
    return found.unionByName(first).unionByName(written(rest, "rest-links"))


def near_duplicates(docs: DataFrame, how: Similarity = Similarity(), id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """``(id_col, n_shingles, component_id, kept)`` for every row of ``docs``.

    Words are split at ASCII white space with A-Z lower-cased. A text with fewer words
    than a shingle is one shingle; a null, empty or blank text has none and is linked
    with nothing. ``component_id`` is the smallest id reachable over links, ``kept``
    is true for it alone. Rows that repeat an id are judged each by its own text. A row without an id takes no part: no component, kept. An
    empty table gives an empty one; other columns are left out.
    """
    base = written(sketches(docs, how, id_col, text_col), "sketches")
    classes = base.where("n_shingles > 0 and id is not null").groupBy("d1", "d2").agg(F.min("id").alias("rep"))
    classes = written(classes, "classes")
    named = classes.select(F.col("d1").alias("c1"), F.col("d2").alias("c2"), "rep")
    # a class's signature comes from its first row: joined by id, so that no class fills a task
    reps = base.join(named, (F.col("id") == F.col("rep")) & (F.col("d1") == F.col("c1")) & (F.col("d2") == F.col("c2")))
    entries = reps.select("id", "n_shingles", F.explode(band_keys(F.col("sig"), how)).alias("key"))
    buckets = entries.groupBy("key").agg(F.min("id").alias("centre"), F.count("*").alias("size")).where("size > 1")
    shared = written(
        entries.join(buckets, "key").groupBy("id", "centre")
        .agg(F.max("n_shingles").alias("n_shingles"), F.sum("size").alias("degree")), "stars")
    members = shared.groupBy("id").agg(F.max("n_shingles").alias("n_shingles"), F.sum("degree").alias("degree"))
    grouped = components(shared.select(F.col("id").alias("u"), F.col("centre").alias("v")), "groups")
    groups = members.join(grouped.select(F.col("node").alias("id"), F.col("component").alias("grp")), "id")
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    links = components(group_links(texts, groups, how), "linked")
    # every class with its component: few classes have links
    placed = named.join(links.withColumnRenamed("node", "rep"), "rep", "left")
    placed = placed.select("c1", "c2", F.coalesce("component", "rep").alias("component"))
    out = base.join(placed, (F.col("d1") == F.col("c1")) & (F.col("d2") == F.col("c2")) & (F.col("n_shingles") > 0), "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"),
                      F.col("id").eqNullSafe(component).alias("kept"))


def drop_near_duplicates(docs: DataFrame, how: Similarity = Similarity(), id_col: str = "doc_id",
                         text_col: str = "text") -> DataFrame:
    """``docs`` with one document per group of near-duplicates; its columns are unchanged.

    Rows that repeat an id all stay if any of them is kept; rows without an id stay.
    """
    judged = near_duplicates(docs, how, id_col, text_col)
    dropped = judged.groupBy(id_col).agg(F.max("kept").alias("kept")).where(~F.col("kept")).select(id_col)
    return docs.join(small_side(dropped, "dropped"), id_col, "left_anti")
