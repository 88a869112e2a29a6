"""A Merkle manifest of a dataset as a log of nodes in postorder, with proofs read by position.

Each tree hashes runs of ``ARITY`` digests to one until one is left. A node is written
when its last leaf is, after its children and before anything to its right; so its place
in the log follows from sizes alone: what was complete before its first leaf, plus the
size of its own subtree, less one. Nobody has to look for a node: builders over aligned
blocks write their parts of the log apart from each other, and a proof asks the log for
the positions of a node's siblings.

A builder spans ``LEVELS`` levels, so a block holds at most ``SPAN`` nodes. Blocks of
leaves are built first, then blocks of their roots; proofs go down the same way, each
block passing its path to the blocks below, so no node is asked for by all leaves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from postlens.operators.scaling import broadcast_if_small, with_position
from postlens.session import written

ARITY = 16
LEVELS = 2
SPAN = ARITY ** LEVELS
PATH = "array<struct<place: int, siblings: string>>"
PATH_TYPE = pa.list_(pa.struct([("place", pa.int32()), ("siblings", pa.string())]))


def digest_of(parts: Sequence[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def size_at(leaves: int, level: int) -> int:
    """Nodes of a level."""
    return -(-leaves // ARITY ** level)


def height(leaves: int) -> int:
    level = 0
    while size_at(leaves, level) > 1:
        level += 1
    return level


def position(leaves: int, level: int, index: int) -> int:
    """Place in the log of a tree's node."""
    first = index * ARITY ** level
    below = min(ARITY ** level, leaves - first)
    subtree = sum(size_at(below, step) for step in range(level + 1))
    done, rest = 0, first
    while rest:
        done += rest
        rest //= ARITY
    return done + subtree - 1


def build_block(digests: Sequence[str], block: int, base: int, leaves: int) -> tuple[list[int], list[str]]:
    """Positions and digests of a block's nodes in the order they are complete; its root comes last."""
    top = min(LEVELS, height(leaves) - base)
    positions, nodes, waiting = [], [], [[] for _ in range(top + 1)]
    for i, node in enumerate(digests):
        index, level = block * SPAN + i, 0
        while True:
            positions.append(position(leaves, base + level, index))
            nodes.append(node)
            if level == top:
                break
            waiting[level].append(node)
            if len(waiting[level]) < ARITY and i < len(digests) - 1:
                break
            node = digest_of(waiting[level])
            waiting[level] = []
            index, level = index // ARITY, level + 1
    return positions, nodes


def block_paths(log: dict[int, str], block: int, base: int, leaves: int) -> list[list[tuple[int, str]]]:
    """For each lowest node of a block its place among its siblings and their digests, level by level."""
    count = min(SPAN, size_at(leaves, base) - block * SPAN)
    paths: list[list[tuple[int, str]]] = [[] for _ in range(count)]
    for level in range(min(LEVELS, height(leaves) - base)):
        wide = ARITY ** level
        last = size_at(leaves, base + level)
        for start in range(block * SPAN // wide, min((block + 1) * SPAN // wide, last), ARITY):
            run = [log[position(leaves, base + level, j)] for j in range(start, min(start + ARITY, last))]
            for place in range(len(run)):
                step = (place, "".join(run[:place] + run[place + 1:]))
                first = (start + place) * wide - block * SPAN
                for path in paths[first:first + wide]:
                    path.append(step)
    return paths


def fold(digest: str, path: Sequence[tuple[int, str]]) -> str:
    """The root that follows from a leaf and its path."""
    for place, siblings in path:
        digest = digest_of((siblings[:64 * place], digest, siblings[64 * place:]))
    return digest


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text), F.lit(":"), text))


def leaf_digest(fields: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[field(c) for c in fields]), 256)


@dataclass(frozen=True)
class Manifest:
    """``leaves(_tree, _leaves, _block, _rows)``, the log by round, ``trees(_tree, _leaves, subroot, _path, root)``.

    A round's log has a row per block: ``(_tree, _leaves, _block, _at, _nodes, _root, _open)``.
    """

    blocks: DataFrame
    rounds: tuple[DataFrame, ...]
    trees: DataFrame

    def log(self) -> DataFrame:
        """``(tree, position, digest)`` of every node of the trees."""
        parts = [r.select(F.col("_tree").alias("tree"), F.explode(F.arrays_zip("_at", "_nodes")).alias("n"))
                 .select("tree", F.col("n._at").alias("position"), F.col("n._nodes").alias("digest")) for r in self.rounds]
        # the lowest nodes of an upper round are the roots of the round below
        whole = parts[0]
        for part in parts[1:]:
            whole = whole.unionByName(part)
        return whole.distinct()


def _builder(base: int) -> Column:
    @F.arrow_udf("struct<_at: array<bigint>, _nodes: array<string>, _root: string, _open: boolean>")
    def build(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for digests, blocks, leaves in batches:
            made = [(build_block(d, b, base, n), height(n) > base + LEVELS)
                    for d, b, n in zip(digests.to_pylist(), blocks.to_pylist(), leaves.to_pylist())]
            yield pa.StructArray.from_arrays([
                pa.array([at for (at, _), _ in made], pa.list_(pa.int64())),
                pa.array([nodes for (_, nodes), _ in made], pa.list_(pa.string())),
                pa.array([nodes[-1] for (_, nodes), _ in made], pa.string()),
                pa.array([higher for _, higher in made], pa.bool_()),
            ], ["_at", "_nodes", "_root", "_open"])

    return build(F.col("_digests"), F.col("_block"), F.col("_leaves")).alias("_b")


def _in_blocks(nodes: DataFrame, *values: str) -> DataFrame:
    """One row per aligned block of ``(_tree, _leaves, _index, ...)``: at most ``SPAN`` nodes in order."""
    return nodes.groupBy("_tree", F.floor(F.col("_index") / SPAN).alias("_block")).agg(
        F.array_sort(F.collect_list(F.struct("_index", *values))).alias("_rows"), F.max("_leaves").alias("_leaves"))


def _rounds(blocks: DataFrame, name: str) -> tuple[tuple[DataFrame, ...], DataFrame]:
    """The log by round, and ``(_tree, _leaves, subroot)``; a round per two levels of the highest tree."""
    rounds: list[DataFrame] = []
    roots = []
    current = blocks
    while True:
        base = LEVELS * len(rounds)
        digests = current.withColumn("_digests", F.transform("_rows", lambda r: r["digest"]))
        made = digests.select("_tree", "_leaves", "_block", _builder(base)).select("_tree", "_leaves", "_block", "_b.*")
        rounds.append(written(made, name))
        roots.append(rounds[-1].where(~F.col("_open")).select("_tree", "_leaves", F.col("_root").alias("subroot")))
        higher = rounds[-1].where("_open")
        if higher.isEmpty():
            break
        current = _in_blocks(higher.select("_tree", "_leaves", F.col("_block").alias("_index"), F.col("_root").alias("digest")), "digest")
    whole = roots[0]
    for part in roots[1:]:
        whole = whole.unionByName(part)
    return tuple(rounds), whole


def _lower_paths(base: int) -> Column:
    """The whole path of each lowest node of a block."""
    @F.arrow_udf(f"array<{PATH}>")
    def descend(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for columns in batches:
            out = []
            for at, nodes, block, leaves, path in zip(*(c.to_pylist() for c in columns)):
                own = block_paths(dict(zip(at, nodes)), block, base, leaves)
                out.append([[{"place": p, "siblings": s} for p, s in steps] + path for steps in own])
            yield pa.array(out, pa.list_(PATH_TYPE))

    return descend("_at", "_nodes", "_block", "_leaves", "_path")


def _down(rounds: Sequence[DataFrame], start: DataFrame) -> DataFrame:
    """``(_tree, _leaves, _block, _at, _nodes, _path, ...)`` of the leaf blocks with the path above each.

    ``start(_tree, _path, ...)`` holds the path above each tree's root, and columns to carry.
    """
    extra = [c for c in start.columns if c not in ("_tree", "_path")]
    above = None
    for base in reversed(range(0, LEVELS * len(rounds), LEVELS)):
        here = rounds[base // LEVELS]
        ending = here.where(~F.col("_open")).join(start, "_tree")
        if above is None:
            whole = ending
        else:
            whole = ending.unionByName(here.where("_open").join(above, ["_tree", "_block"]))
        if base == 0:
            return whole

        paths = whole.withColumn("_paths", _lower_paths(base))
        above = written(paths.select("_tree", *extra, (F.col("_block") * SPAN).alias("_first"), F.posexplode("_paths").alias("_i", "_path")).select(
            "_tree", *extra, (F.col("_first") + F.col("_i")).alias("_block"), "_path"), "paths")
    raise ValueError("no rounds")


def manifest(docs: DataFrame, fields: Sequence[Column], tree: Column, order: Column,
             presented: Column | None = None, keep: Sequence[str] = ()) -> Manifest:
    """The trees of ``docs``, one per value of ``tree``, and the tree over their roots.

    A leaf hashes ``fields``; leaves stand by ``order`` (null first), rows that agree there
    by their digest, and rows that agree in that too are alike, so any order gives the same
    digests. Null is a tree of its own, the first. ``presented`` is the digest shown for
    verification where it is not the leaf's own; ``keep`` names columns to keep by leaf.
    Texts of any length are only hashed; no text is shuffled. An empty table gives empty
    tables.
    """
    digest = leaf_digest(fields)
    # null before the empty name, any other in its bytes' order
    name = F.when(tree.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), tree.cast("string")))
    rows = docs.select(name.alias("_tree"), order.alias("_order"), digest.alias("digest"),
                       (digest if presented is None else presented).alias("presented"),
                       F.struct(*[F.col(f"`{c}`") for c in keep] or [F.lit(None).alias("_none")]).alias("_keep"))
    rows = written(rows, "leaves").withColumn("_order", F.struct("_order", "digest"))
    placed = with_position(rows, "_order", "_index", ["_tree"])
    sizes = rows.groupBy("_tree").agg(F.count("*").alias("_leaves"))
    blocks = _in_blocks(placed.withColumn("_leaves", F.lit(0)), "digest", "presented", "_keep").drop("_leaves")
    blocks = written(blocks.join(broadcast_if_small(sizes), "_tree"), "leaf_blocks")
    rounds, roots = _rounds(blocks, "log")
    roots = written(roots, "subroots")

    over = with_position(roots.select("_tree", F.col("subroot").alias("digest")), "_tree", "_index")
    over = over.withColumn("_leaves", roots.agg(F.count("*").alias("n")).scalar())
    top_blocks = written(_in_blocks(over.withColumnRenamed("_tree", "_name").withColumn("_tree", F.lit("")), "digest", "_name"), "tree_blocks")
    top_rounds, top = _rounds(top_blocks, "tree_log")
    start = top.select("_tree", F.col("subroot").alias("root"), F.array().cast(PATH).alias("_path"))

    lowest = _down(top_rounds, start).join(top_blocks.select("_tree", "_block", "_rows"), ["_tree", "_block"])
    found = lowest.withColumn("_paths", _lower_paths(0)).select(
        "root", F.explode(F.arrays_zip("_rows", "_paths")).alias("_z"))
    paths = found.select(F.col("_z._rows._name").alias("_tree"), F.col("_z._paths").alias("_path"), "root")
    return Manifest(blocks, rounds, written(roots.join(paths, "_tree"), "trees"))


def proofs(made: Manifest) -> DataFrame:
    """Per leaf the kept columns, ``leaf``, ``subroot``, ``root``, ``proof_sha256``, ``folded_root`` and ``verified``.

    The proof's digest is that of all siblings, level by level up to the root, left to
    right; the folded root follows from the presented digest and those siblings.
    """
    @F.arrow_udf("array<struct<proof_sha256: string, folded_root: string>>")
    def prove(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for columns in batches:
            out = []
            for at, nodes, block, leaves, path, shown in zip(*(c.to_pylist() for c in columns)):
                above = [(step["place"], step["siblings"]) for step in path]
                rest = "".join(siblings for _, siblings in above)
                own = block_paths(dict(zip(at, nodes)), block, 0, leaves)
                out.append([{
                    "proof_sha256": digest_of([s for _, s in steps] + [rest]), "folded_root": fold(digest, steps + above),
                } for steps, digest in zip(own, shown)])
            yield pa.array(out, pa.list_(pa.struct([("proof_sha256", pa.string()), ("folded_root", pa.string())])))

    start = made.trees.select("_tree", "_path", "subroot", "root")
    lowest = _down(made.rounds, start).join(made.blocks.select("_tree", "_block", "_rows"), ["_tree", "_block"])
    shown = F.transform("_rows", lambda r: r["presented"])
    found = lowest.withColumn("_proofs", prove("_at", "_nodes", "_block", "_leaves", "_path", shown)).select(
        "subroot", "root", F.explode(F.arrays_zip("_rows", "_proofs")).alias("_z"))
    kept = [] if [f.name for f in found.schema["_z"].dataType["_rows"].dataType["_keep"].dataType] == ["_none"] else ["_z._rows._keep.*"]
    return found.select(
        *kept, F.col("_z._rows.digest").alias("leaf"), "subroot", "root", "_z._proofs.proof_sha256", "_z._proofs.folded_root",
        (F.col("_z._proofs.folded_root") == F.col("root")).alias("verified"))
