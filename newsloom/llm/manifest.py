"""Merkle manifest of a dataset, and versions of it by path copying.

Every row is a leaf; the leaves of a source, in order of their ids, make a tree of fan-out 3, and the subroots of all
sources another one on top, whose root stands for the dataset. A tampered leaf makes a new version of the tree that
shares every untouched node: only the ancestors of the leaf are copied, everything beside them is read from the
original.

Trees are cut into aligned blocks of 3^6 nodes, six levels each (``LEVELS``). Upwards, a task reduces a block to its top, and the
tops are the nodes of the next tier, until one node a source is left; then the sources' subroots go the same way. Downwards,
the siblings on the path from a block's top to the root are passed on from tier to tier, each block getting those of
its parent. With them the blocks of leaves are visited once more: each leaf's copies inside its block are made there
from the block's shared levels, and the version goes on upwards along the siblings of the block. So no
task holds more than a block, a hot source is many blocks, and a version costs its depth. Only ids and digests are
shuffled, never texts.

Null values: ``-`` in the leaf's hash. Null id: before all others, never tampered. Null source: a source of its own,
before the others. Null text: stays null when tampered. Rows with equal ids: in order of their leaf; equal rows are
leaves of their own. Very long texts are hashed where they are read. Empty table: empty result. Other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.tables import type_of
from newsloom.plans.lineage import cut_lineage

FAN_OUT, LEVELS = 3, 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPERED_DIVISOR = 2

NODE = "tree string, position long, nodes long, digest string"
PATH = "array<struct<before:string,after:string>>"


# --- hashing inside a block -------------------------------------------------------------------

def joint_digest(parts: Sequence[str]) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def shared_levels(digests: list[str], nodes: int, height: int) -> list[list[str]]:
    """All levels of a block, nodes first, top last. A block that is its whole tree of ``nodes`` ends when one is left."""
    whole, found = nodes <= FAN_OUT**height, [digests]
    while len(found[-1]) > 1 if whole else len(found) <= height:
        below = found[-1]
        found.append([joint_digest(below[k:k + FAN_OUT]) for k in range(0, len(below), FAN_OUT)])
    return found


def siblings(levels: list[list[str]], at: int) -> list[tuple[str, str]]:
    """What stands before and after the path from node ``at`` to the top, level by level."""
    path = []
    for level in levels[:-1]:
        start = at - at % FAN_OUT
        path.append(("".join(level[start:at]), "".join(level[at + 1:start + FAN_OUT])))
        at //= FAN_OUT
    return path


def copied_path(digest: str, path: Sequence[tuple[str, str]]) -> list[str]:
    """The nodes a version copies above a leaf that became ``digest``; the last one is the top."""
    copies = []
    for before, after in path:
        digest = joint_digest((before, digest, after))
        copies.append(digest)
    return copies


# --- tiers ------------------------------------------------------------------------------------

def _block(height: int) -> Column:
    return F.expr(f"position div {FAN_OUT**height}L").alias("block")


def _top(rows: pd.DataFrame, height: int) -> pd.DataFrame:
    rows = rows.sort_values("position")
    nodes, first, size = int(rows["nodes"].iloc[0]), rows.iloc[0], FAN_OUT**height
    top = shared_levels(list(rows["digest"]), nodes, height)[-1][0]
    return pd.DataFrame({"tree": [first["tree"]], "position": [first["position"] // size], "nodes": [-(-nodes // size)], "digest": [top]})


def tops(nodes: DataFrame, height: int) -> DataFrame:
    """The next tier: one node per block."""
    blocks = nodes.select("tree", _block(height), "position", "nodes", "digest").groupBy("tree", "block")
    return cut_lineage(blocks.applyInPandas(lambda rows: _top(rows, height), NODE))


def tiers(nodes: DataFrame, height: int) -> list[DataFrame]:
    """All tiers from ``nodes`` to the one that has a single node per tree."""
    found = [nodes]
    while not found[-1].filter("nodes > 1").isEmpty():
        found.append(tops(found[-1], height))
    return found


def _with_path(nodes: pd.DataFrame, above: pd.DataFrame, height: int) -> pd.DataFrame:
    nodes = nodes.sort_values("position")
    levels = shared_levels(list(nodes["digest"]), int(nodes["nodes"].iloc[0]), height)
    upper = [(p["before"], p["after"]) for p in above["path"].iloc[0]]
    paths = [[{"before": b, "after": a} for b, a in siblings(levels, k) + upper] for k in range(len(nodes))]
    return pd.DataFrame({"tree": nodes["tree"], "position": nodes["position"], "subroot": above["subroot"].iloc[0],
                         "root": above["root"].iloc[0], "path": paths})


def paths_below(nodes: DataFrame, above: DataFrame, height: int) -> DataFrame:
    """Siblings up to the root for every node of a tier, given those of the tier above."""
    blocks = nodes.select("tree", _block(height), "position", "nodes", "digest").groupBy("tree", "block")
    return cut_lineage(blocks.cogroup(above.withColumnRenamed("position", "block").groupBy("tree", "block")).applyInPandas(
        lambda rows, upper: _with_path(rows, upper, height), f"tree string, position long, subroot string, root string, path {PATH}"))


def root_paths(sources: DataFrame, height: int) -> DataFrame:
    """Siblings up to the dataset's root for the subroot of every tree: the same form as ``paths_below``, position 0."""
    ranked = positions(sources.select(F.lit("").alias("of"), "tree", "digest"), "of", ("tree",))
    named = ranked.select("tree", F.col("digest").alias("subroot"), "position")
    levels = tiers(cut_lineage(ranked.select(F.lit("").alias("tree"), "position", "nodes", "digest")), height)
    none = F.array().cast(PATH)
    above = levels.pop().select("tree", "position", F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"), none.alias("path"))
    while levels:
        above = paths_below(levels.pop(), above, height)
    return cut_lineage(above.select("position", "root", "path").join(named, "position").select(
        "tree", F.lit(0).cast("long").alias("position"), "subroot", "root", "path"))


def positions(rows: DataFrame, tree: str, order: Sequence[str]) -> DataFrame:
    """Adds ``position`` (from 0 in its tree, by ``order``) and ``nodes`` (of its tree).

    Rows are sorted by range, so a tree of any size is spread over tasks; a tree's share of each range is joined back as a
    running sum over at most one row per range. Fully equal rows are told apart by a number, or they could not be split.
    """
    numbered = cut_lineage(rows.withColumn("row", F.monotonically_increasing_id()))
    placed = cut_lineage(
        numbered.repartitionByRange(tree, *order, "row").sortWithinPartitions(tree, *order, "row")
        .withColumn("part", F.spark_partition_id()).withColumn("seq", F.monotonically_increasing_id()))
    shares = placed.groupBy(F.col("part").alias("_part"), F.col(tree).alias("_tree")).agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first"))
    per_tree = Window.partitionBy("_tree")
    earlier = per_tree.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shares = shares.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).withColumn("nodes", F.sum("n").over(per_tree))
    joined = placed.join(shares, (F.col("part") == F.col("_part")) & (F.col(tree) == F.col("_tree")))
    return joined.withColumn("position", (F.col("seq") - F.col("first") + F.col("before")).cast("long")).drop(
        "part", "seq", "row", "_part", "_tree", "n", "first", "before")


# --- leaves -----------------------------------------------------------------------------------

def _hashed(*values: Column) -> Column:
    """One digest of the values: byte count, colon and value each, a dash for null."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def leaves(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """``(id, tree, leaf, changed)``: the leaf of every row, and that of its tampered form (null where it isn't tampered)."""
    fields = [F.col(id_column if f == "doc_id" else f) for f in FIELDS]
    *others, text = fields
    tampered = F.coalesce(F.crc32(F.encode(fields[0].cast("string"), "UTF-8")) % TAMPERED_DIVISOR == 0, F.lit(False))
    cut = _hashed(*others, F.replace(text, F.lit("\n"), F.lit("")))
    source = F.col("source").cast("string")
    # a leading digit keeps null apart from the empty string and before every source
    tree = F.when(source.isNull(), "0").otherwise(F.concat(F.lit("1"), source))
    return docs.select(fields[0].alias("id"), tree.alias("tree"), _hashed(*fields).alias("leaf"), F.when(tampered, cut).alias("changed"))


def _versions(rows: pd.DataFrame, above: pd.DataFrame, height: int) -> pd.DataFrame:
    rows = rows.sort_values("position")
    levels = shared_levels(list(rows["leaf"]), int(rows["nodes"].iloc[0]), height)
    upper = [(p["before"], p["after"]) for p in above["path"].iloc[0]]
    upper_proof = "".join(b + a for b, a in upper)
    root = above["root"].iloc[0]
    proofs, roots, copied = [], [], []
    for k, (leaf, changed) in enumerate(zip(rows["leaf"], rows["changed"], strict=True)):
        inside = siblings(levels, k)
        proofs.append(joint_digest([b + a for b, a in inside] + [upper_proof]))
        now = leaf if changed is None else changed
        copies = copied_path(now, inside + upper)
        roots.append(copies[-1] if copies else now)
        copied.append(0 if now == leaf else len(copies) + 1)
    return pd.DataFrame({"id": rows["id"], "leaf": rows["leaf"], "subroot": above["subroot"].iloc[0], "root": root, "proof_sha256": proofs,
                         "folded_root": roots, "verified": [r == root for r in roots], "copied_nodes": copied})


def verify(docs: DataFrame, id_column: str = "doc_id", height: int = LEVELS) -> DataFrame:
    """One row per input row: its leaf, roots and proof in the original, and the root of its version.

    ``copied_nodes`` is the number of nodes its version does not share with the original, the leaf included. ``height`` is
    that of a block; it changes no result.
    """
    kind = type_of(docs, id_column)
    placed = cut_lineage(positions(leaves(docs, id_column), "tree", ("id", "leaf")))
    levels = tiers(placed.select("tree", "position", "nodes", F.col("leaf").alias("digest")), height)
    if len(levels) == 1:  # a tree of leaves always has a tier of tops, if only of themselves
        levels.append(tops(levels[0], height))
    above = root_paths(levels.pop().select("tree", "digest"), height)
    while len(levels) > 1:
        above = paths_below(levels.pop(), above, height)
    blocks = placed.select("tree", _block(height), "position", "nodes", "id", "leaf", "changed").groupBy("tree", "block")
    return blocks.cogroup(above.withColumnRenamed("position", "block").groupBy("tree", "block")).applyInPandas(
        lambda rows, upper: _versions(rows, upper, height),
        f"id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, "
        "copied_nodes long").withColumnRenamed("id", id_column)
