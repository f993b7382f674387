"""A Merkle manifest of a dataset, kept as a log of nodes in postorder.

Leaves are digests of rows, numbered within trees (one for each group of the rows). Every ``FAN``
consecutive nodes of a level, and the fewer at its end, have a parent; so all leaves of a tree are
equally deep, and a node's place in the postorder of its tree follows from its level and index alone:
the leaves up to its last one, the inner nodes that are complete by then, and its own level.

Builders are aligned: each takes the ``FAN ** LEVELS`` leaves under one node and appends its nodes in the
order of their completion; their roots are the leaves of the next pass, so after a few passes every tree
has its root. For a proof, each level's siblings are addressed by their computed places in the log;
passes hand theirs down, so the work on a leaf is bounded by one builder and the height of the tree.
Trees hang together in one more tree over their roots.

Defined results: null values have a mark of their own; a null group is a tree, the first one; null ids
come first; rows of the same id are ordered by their digest; equal rows each are a leaf; texts are
hashed whole; an empty table has no leaves and no root. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retailcast.llm.common import small_enough, staged
from retailcast.llm.running import RANGE_ROWS, running

FAN = 8
#: Levels of a builder: it holds FAN ** LEVELS leaves at most.
LEVELS = 4
BROADCAST_BYTES = 32 << 20


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def encoded(*values: Column) -> Column:
    """The values in a row: each its UTF-8 length, a colon and itself, or a dash for null."""
    texts = [v.cast("string") for v in values]
    return F.concat(*(F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts))


def digest(*values: Column) -> Column:
    return F.sha2(encoded(*values).cast("binary"), 256)


def postorder(level, index, leaves, fan: int = FAN):
    """Places (from 0) of nodes in the postorder of a tree of so many leaves."""
    last = np.minimum((index + 1) * fan ** level, leaves) - 1
    place, inner = last + level, last
    while np.any(inner):
        inner = inner // fan
        place = place + inner
    return place


def _width(leaves: int, level: int, fan: int = FAN) -> int:
    """Nodes of a level."""
    return -(-leaves // fan ** level)


def _append(nodes: pd.DataFrame, level: int) -> pd.DataFrame:
    """What a builder appends over nodes of ``level`` (tree, number, digest, leaves): all nodes above
    them up to its root, and on the lowest level the leaves."""
    nodes = nodes.sort_values("number")
    leaves, index = int(nodes["leaves"].iloc[0]), int(nodes["number"].iloc[0])
    own, builder = nodes["digest"].tolist(), index // FAN ** LEVELS
    found = [(level, index, own)] if level == 0 else []
    for up in range(level + 1, level + LEVELS + 1):
        if _width(leaves, up - 1) == 1:
            break
        own, index = [sha256("".join(own[k:k + FAN])) for k in range(0, len(own), FAN)], index // FAN
        found.append((up, index, own))
    parts = []
    for at, first, digests in found:
        numbers = first + np.arange(len(digests), dtype=np.int64)
        parts.append(pd.DataFrame({"position": postorder(at, numbers, leaves), "level": at, "number": numbers, "digest": digests}))
    log = pd.concat(parts)
    log["tree"], log["builder"], log["leaves"] = nodes["tree"].iloc[0], builder, leaves
    return log.sort_values("position")[["tree", "builder", "position", "level", "number", "digest", "leaves"]]


def _appender(level: int):
    def append(nodes: pd.DataFrame) -> pd.DataFrame:
        return _append(nodes, level)
    return append


_LOG = "tree string, builder long, position long, level int, number long, digest string, leaves long"


@dataclass
class Forest:
    """``nodes``: the written nodes that each pass began with; ``logs``: what it appended."""
    nodes: list[DataFrame]
    logs: list[DataFrame]

    @property
    def log(self) -> DataFrame:
        """tree, position, level, number, digest of all nodes."""
        return reduce(DataFrame.unionByName, self.logs).select("tree", "position", "level", "number", "digest")

    def roots(self) -> DataFrame:
        """tree, root: the last node of each log."""
        return self.log.groupBy("tree").agg(F.max_by("digest", "position").alias("root"))


def build(leaves: DataFrame) -> Forest:
    """The trees over ``leaves`` (tree, number from 0, digest, and others), a written table."""
    sizes = staged(leaves.groupBy("tree").agg(F.count(F.lit(1)).alias("leaves")), "merkle-sizes")
    if small_enough(sizes, BROADCAST_BYTES, F.length("tree") + 16):
        sizes = F.broadcast(sizes)
    nodes = staged(leaves.join(sizes, "tree"), "merkle-leaves")
    most = nodes.agg(F.max("leaves")).first()[0] or 0
    forest, level = Forest([], []), 0
    while True:
        append = _appender(level)
        log = staged(nodes.select("tree", "number", "digest", "leaves", _builder()).groupBy("tree", "builder").applyInPandas(append, _LOG), f"merkle-log-{level}")
        forest.nodes.append(nodes)
        forest.logs.append(log)
        level += LEVELS
        if _width(most, level) <= 1:
            return forest
        nodes = log.where((F.col("level") == level) & (F.col("leaves") > FAN ** level)).select("tree", "number", "digest", "leaves", "position")


def _siblings(digests: dict[int, str], level: int, first: int, n: int, leaves: int) -> list[list[tuple[str, str]]]:
    """For each of the n nodes from ``first`` on of ``level``, up to its builder's root: the digests before
    and after it among its parent's children, one pair for each level."""
    levels = []
    for up in range(level, level + LEVELS):
        width = _width(leaves, up)
        if width == 1:
            break
        start, pairs = first // FAN * FAN, []
        numbers = np.arange(start, min((first + n - 1) // FAN * FAN + FAN, width))
        own = [digests[p] for p in postorder(up, numbers, leaves).tolist()]
        for k in range(0, len(own), FAN):
            run = "".join(own[k:k + FAN])
            pairs += [(run[:64 * j], run[64 * j + 64:]) for j in range(len(own[k:k + FAN]))]
        levels.append(pairs[first - start:first - start + n])
        first, n = first // FAN, (first + n - 1) // FAN - first // FAN + 1
    return levels


def _paths(nodes: pd.DataFrame, log: pd.DataFrame, level: int):
    """Of each node: its row and (before, after) of all levels up to the root."""
    nodes = nodes.sort_values("number")
    is_above = log["position"] < 0
    above = log[is_above].iloc[0]
    above = list(zip(above["before"], above["after"]))
    digests = dict(zip(log["position"][~is_above].tolist(), log["digest"][~is_above].tolist()))
    first, leaves = int(nodes["number"].iloc[0]), int(nodes["leaves"].iloc[0])
    levels = _siblings(digests, level, first, int(nodes["number"].iloc[-1]) - first + 1, leaves)
    for row in nodes.itertuples(index=False):
        k, own = row.number - first, []
        for up, pairs in enumerate(levels):
            own.append(pairs[(first + k) // FAN ** up - first // FAN ** up])
        yield row, own + above


_PATHS = "tree string, number long, before array<string>, after array<string>"


def _builder() -> Column:
    return F.floor(F.col("number") / FAN ** LEVELS).alias("builder")


def _readable(forest: Forest, k: int, upper: DataFrame) -> DataFrame:
    """What the builders of pass k read: the nodes that it began with, those it appended, and at position
    -1 the path from its root upwards, of ``upper`` (_PATHS; number: the builder)."""
    none = F.lit(None).cast("array<string>")
    rows = [forest.logs[k].select("tree", "builder", "position", "digest")]
    if k:
        rows.append(forest.nodes[k].select("tree", _builder(), "position", "digest"))
    own = reduce(DataFrame.unionByName, rows).select("*", none.alias("before"), none.alias("after"))
    extra = upper.select("tree", F.col("number").alias("builder"), F.lit(-1).cast("long").alias("position"),
                         F.lit(None).cast("string").alias("digest"), "before", "after")
    return own.unionByName(extra)


def _extract(forest: Forest, k: int, upper: DataFrame, leaves: DataFrame, find, schema: str) -> DataFrame:
    own = leaves.select("*", _builder()).groupBy("tree", "builder")
    return own.cogroup(_readable(forest, k, upper).groupBy("tree", "builder")).applyInPandas(find, schema)


def _paths_of_pass(forest: Forest, k: int, upper: DataFrame) -> DataFrame:
    """The path of each node that pass k began with."""
    def find(own: pd.DataFrame, log: pd.DataFrame) -> pd.DataFrame:
        rows = [(r.tree, r.number, [b for b, _ in path], [a for _, a in path]) for r, path in _paths(own, log, k * LEVELS)]
        return pd.DataFrame(rows, columns=["tree", "number", "before", "after"])

    return staged(_extract(forest, k, upper, forest.nodes[k], find, _PATHS), f"merkle-paths-{k}")


def handed_down(forest: Forest, above: DataFrame) -> DataFrame:
    """The paths (_PATHS) from the roots of the lowest pass's builders upwards; ``above``: tree, before,
    after of what lies over each tree's root."""
    upper = None
    for k in reversed(range(len(forest.nodes))):
        done = forest.nodes[k].where(F.col("leaves") <= FAN ** ((k + 1) * LEVELS)).select("tree").distinct()
        ends = above.join(done, "tree", "left_semi").select("tree", F.lit(0).cast("long").alias("number"), "before", "after")
        upper = ends if upper is None else ends.unionByName(_paths_of_pass(forest, k + 1, upper))
    return upper


def fold(leaf: str, path) -> str:
    """The root that a leaf and its siblings give."""
    for before, after in path:
        leaf = sha256(before + leaf + after)
    return leaf


@dataclass
class Manifest:
    """``trees``, ``top``: the logs; the first nodes of ``trees`` are the leaves (tree, number, digest,
    leaves) with all columns of their rows. ``roots``: tree, subroot, number (its place in the top tree);
    ``root``: None without rows."""
    trees: Forest
    top: Forest
    roots: DataFrame
    root: str | None


def manifest(rows: DataFrame, group: str, order: str, range_rows: int = RANGE_ROWS) -> Manifest:
    """The manifest of ``rows`` (with ``digest``): a tree for each ``group``, its leaves by ``order``."""
    tree = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))  # bytewise, null first
    one = F.lit(1).cast("long")
    held = staged(rows.withColumns({"tree": tree, "_one": one, "_tie": F.monotonically_increasing_id()}), "merkle-rows")
    keys = [F.col(order).asc_nulls_first(), F.col("digest"), F.col("_tie")]
    numbered = running(held, "tree", keys, {"number": ("_one", "sum")}, "merkle-order", range_rows)
    trees = build(staged(numbered.drop("_one", "_tie").withColumn("number", F.col("number") - 1), "merkle-numbered"))
    subroots = staged(trees.roots().select(F.lit("").alias("top"), "tree", "root", one.alias("_one")), "merkle-subroots")
    ranked = running(subroots, "top", [F.col("tree")], {"number": ("_one", "sum")}, "merkle-subroot-order", range_rows)
    roots = staged(ranked.select("top", "tree", F.col("root").alias("subroot"), (F.col("number") - 1).alias("number")), "merkle-tops")
    top = build(roots.select(F.col("top").alias("tree"), "number", F.col("subroot").alias("digest")))
    whole = top.roots().first()  # one row at most
    return Manifest(trees, top, roots, whole["root"] if whole else None)


def prove(made: Manifest, given: str, carried: dict[str, str]) -> DataFrame:
    """For each leaf of the manifest: digest, subroot, root, path_sha256 (of its siblings, level by level,
    left to right), folded_root (of the digest in column ``given`` and these siblings), verified, and the
    ``carried`` columns {name: type} of its row."""
    spark = made.roots.sparkSession
    none = F.array().cast("array<string>")
    over = spark.range(1).select(F.lit("").alias("tree"), none.alias("before"), none.alias("after"))
    tops = _paths_of_pass(made.top, 0, handed_down(made.top, over)).select("number", "before", "after")
    above = staged(made.roots.join(tops, "number").select("tree", "before", "after"), "merkle-above")
    schema = "".join(f"`{c}` {t}, " for c, t in carried.items()) + "tree string, digest string, path_sha256 string, folded_root string"
    names = [*carried, "tree", "digest", "path_sha256", "folded_root"]

    def find(own: pd.DataFrame, log: pd.DataFrame) -> pd.DataFrame:
        rows = [(*(getattr(r, c) for c in carried), r.tree, r.digest, sha256("".join(b + a for b, a in path)), fold(r.given, path))
                for r, path in _paths(own, log, 0)]
        return pd.DataFrame(rows, columns=names)

    leaves = made.trees.nodes[0].select("tree", "number", "digest", "leaves", F.col(given).alias("given"), *carried)
    found = _extract(made.trees, 0, handed_down(made.trees, above), leaves, find, schema)
    subroots = made.roots.select("tree", "subroot")
    if small_enough(subroots, BROADCAST_BYTES, F.length("tree") + 96):
        subroots = F.broadcast(subroots)
    root = F.lit(made.root).cast("string").alias("root")
    return found.join(subroots, "tree").select(*carried, "digest", "subroot", root, "path_sha256", "folded_root").withColumn(
        "verified", F.col("folded_root") == F.col("root"))
