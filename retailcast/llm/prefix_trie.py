"""The trie of all prefixes of conversations, with sums over every subtree.

A turn stands for itself by two 64-bit hashes of its place and contents, a prefix by the exclusive-or of
its turns' (running over ranges, so that a conversation may be of any length). Conversations are cut into
units of ``WIDTH`` turns, each under the prefix before it. Units are dealt into shards by ranges of (prefix,
turns, conv_id), so equal prefixes are neighbours and a group of copies may spread over shards. A shard
lays its units out as a padded matrix of turn ids, sorts it with numpy's lexsort, and or-accumulates the
masks of changes between neighbours along the columns: a mark in column j is where a node of j turns
begins, and reduceat sums each of these spans, one depth after the other. Only the nodes at a shard's
two ends can go on in another shard; the sums of equal prefixes are combined.

Sums over subtrees: a node belongs to its smallest conversation, so that each conversation owns one run
of depths on its own path. What a conversation owns in all counts, for each conversation above it,
at the depth where their paths part, and sums from the deepest depth upwards along the runs give the
subtrees. The rows of this are at most those of the turns, however deep the trie is.

Defined results: null roles and texts are empty; rows without conv_id belong to no conversation and are
left out; null turns come first, equal ones are ordered by role and the md5 of the text; repeated rows
are turns of their own; texts are taken whole; a table without conversations has no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from retailcast.llm.common import staged
from retailcast.llm.running import RANGE_ROWS, ranges, running

#: Turns of a unit, and units of a shard.
WIDTH = 16
SHARD_UNITS = 1 << 15
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()
_NODE = ["depth", "f1", "f2"]


# ------------------------------------------------------------------ conversations
def numbered_turns(conversations: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """conv_id, number (from 1), id1 and id2 (what the turn says, hashed) and chars of each turn."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    slim = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), F.md5(text.cast("binary")).alias("md5"),
        F.xxhash64(F.lit(1), role, text).alias("id1"), F.xxhash64(F.lit(2), text, role).alias("id2"),
        F.length(text).cast("long").alias("chars"), F.lit(1).cast("long").alias("one"), F.monotonically_increasing_id().alias("tie"))
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("md5"), F.col("tie")]
    turns = running(staged(slim, "turns"), "conv_id", order, {"number": ("one", "sum")}, "numbered-turns", range_rows)
    return turns.select("conv_id", "number", "id1", "id2", "chars")


def rebuilt(turns: DataFrame, family: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Each conversation c of ``numbered_turns`` rebuilt: the first crc32(c) % ``most`` turns are those of
    conversation c - c % ``family``, its own come after as many. Returns the turns and (conv_id, length)."""
    convs = staged(turns.groupBy("conv_id").agg(F.max("number").alias("n")), "conversations")
    convs = convs.withColumns({"base": F.col("conv_id") - F.col("conv_id") % family,
                               "head": F.crc32(F.col("conv_id").cast("string").cast("binary")) % most})
    bases = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = staged(convs.join(bases, "base", "left").select(
        "conv_id", "base", "n", "head", F.least("head", F.coalesce("base_n", F.lit(0).cast("long"))).alias("taken")), "rebuilt-conversations")
    heads = turns.where(F.col("number") < most).withColumnRenamed("conv_id", "base")
    shared = convs.join(heads, "base").where("number <= taken").select("conv_id", "number", "id1", "id2", "chars")
    own = turns.join(convs.select("conv_id", "head", "taken"), "conv_id").where("number > head").select(
        "conv_id", (F.col("number") - F.col("head") + F.col("taken")).alias("number"), "id1", "id2", "chars")
    length = F.col("taken") + F.greatest(F.col("n") - F.col("head"), F.lit(0).cast("long"))
    return shared.unionByName(own), convs.select("conv_id", length.alias("length"))


# ------------------------------------------------------------------ shards
_PARTS = pa.schema([("kind", pa.int32()), *((c, pa.int64()) for c in ("depth", "f1", "f2", "g1", "g2", "conv_id", "n", "chars")), ("ends", pa.string())])


def _dense(*columns: np.ndarray) -> np.ndarray:
    """Numbers from 1 for the distinct rows of the columns."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    for c in columns:
        new[1:] |= c[order][1:] != c[order][:-1]
    out = np.empty(len(order), np.int64)
    out[order] = 1 + np.cumsum(new)
    return out


def _parts(units: pa.Table) -> Iterator[pd.DataFrame]:
    """Nodes (kind 0) and the conversations that end at one (kind 1) of a shard's units."""
    column = lambda c: units.column(c).combine_chunks()
    block, k1, k2, conv = (column(c).to_numpy(zero_copy_only=False) for c in ("block", "k1", "k2", "conv_id"))
    ended = column("ended").to_numpy(zero_copy_only=False).astype(bool)
    offsets = column("p1").offsets.to_numpy()
    length = np.diff(offsets)
    there = np.arange(WIDTH) < length[:, None]

    def padded(values: np.ndarray) -> np.ndarray:
        out = np.zeros(there.shape, np.int64)
        out[there] = values
        return out

    p1, p2, chars = (column(c).flatten().to_numpy(zero_copy_only=False) for c in ("p1", "p2", "chars"))
    ids, p1, p2, chars = (padded(x) for x in (_dense(p1, p2), p1, p2, chars))
    key = _dense(block, k1, k2)
    order = np.lexsort((conv, *(ids[:, j] for j in reversed(range(WIDTH))), key))
    block, k1, k2, conv, ended, length, key = (x[order] for x in (block, k1, k2, conv, ended, length, key))
    ids, p1, p2, chars = (x[order] for x in (ids, p1, p2, chars))
    starts = np.ones((len(conv), WIDTH + 1), bool)
    starts[1:, 0] = key[1:] != key[:-1]
    starts[1:, 1:] = ids[1:] != ids[:-1]
    starts = np.logical_or.accumulate(starts, axis=1)
    f1 = np.bitwise_xor.accumulate(np.column_stack((k1, p1)), axis=1)
    f2 = np.bitwise_xor.accumulate(np.column_stack((k2, p2)), axis=1)
    for j in range(WIDTH + 1):
        rows = np.flatnonzero(length >= j)
        if not len(rows):
            return
        first = np.flatnonzero(starts[rows, j])
        at, n = rows[first], np.diff(np.append(first, len(rows)))
        smallest = np.minimum.reduceat(conv[rows], first)
        here = (block[at] == 0) if j == 0 else np.ones(len(at), bool)  # a unit's first node is the last of the one above
        if here.any():
            before = max(j - 1, 0)
            yield pd.DataFrame({"kind": 0, "depth": block[at] * WIDTH + j, "f1": f1[at, j], "f2": f2[at, j], "g1": f1[at, before], "g2": f2[at, before],
                                "conv_id": smallest, "n": n, "chars": chars[at, before] if j else 0, "ends": None})[here]
        of = np.cumsum(starts[rows, j]) - 1
        last = ended[rows] & (length[rows] == j)
        if last.any():
            rows, of = rows[last], of[last]
            cut = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
            at, names = rows[cut], conv[rows].astype(str)
            joined = [",".join(names[a:b]) for a, b in zip(cut, np.append(cut[1:], len(rows)))]
            yield pd.DataFrame({"kind": 1, "depth": block[at] * WIDTH + j, "f1": f1[at, j], "f2": f2[at, j], "g1": 0, "g2": 0,
                                "conv_id": conv[at], "n": np.diff(np.append(cut, len(rows))), "chars": 0, "ends": joined})


def _shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [b for b in batches if b.num_rows]
    if held:
        for part in _parts(pa.Table.from_batches(held)):
            yield pa.RecordBatch.from_pandas(part, schema=_PARTS, preserve_index=False)


def _units(turns: DataFrame, lengths: DataFrame, range_rows: int) -> tuple[DataFrame, DataFrame]:
    """The prefix up to each turn (conv_id, number, f1, f2), and the units."""
    hashed = turns.select("conv_id", "number", F.xxhash64("number", "id1").alias("p1"), F.xxhash64("number", "id2").alias("p2"), "chars", F.lit(False).alias("end"))
    zero = F.lit(0).cast("long")
    ends = lengths.select("conv_id", (F.col("length") + 1).alias("number"), zero.alias("p1"), zero.alias("p2"), zero.alias("chars"), F.lit(True).alias("end"))
    rows = staged(hashed.unionByName(ends), "trie-turns")
    paths = staged(running(rows, "conv_id", [F.col("number")], {"f1": ("p1", "xor"), "f2": ("p2", "xor")}, "trie-prefixes", range_rows), "trie-paths")
    real = F.filter("turns", lambda t: ~t["end"])
    first = F.col("turns")[0]
    units = paths.groupBy("conv_id", F.floor((F.col("number") - 1) / WIDTH).alias("block")).agg(
        F.array_sort(F.collect_list(F.struct("number", "p1", "p2", "chars", "end", "f1", "f2"))).alias("turns"))
    units = units.select(
        "conv_id", "block", first["f1"].bitwiseXOR(first["p1"]).alias("k1"), first["f2"].bitwiseXOR(first["p2"]).alias("k2"),
        F.exists("turns", lambda t: t["end"]).alias("ended"), *(real.getField(c).alias(c) for c in ("p1", "p2", "chars")))
    return paths.where("not end").select("conv_id", "number", "f1", "f2"), staged(units, "trie-units")


def _digests(ends: DataFrame) -> DataFrame:
    """depth, f1, f2, ends_sha256: of the conversations that end at a node. Each row holds the ids of a
    range, joined; nodes with several rows hash them one after the other."""
    whole = staged(ends.groupBy(*_NODE).agg(F.count(F.lit(1)).alias("rows"), F.min("ends").alias("ends")), "trie-ends")
    one = whole.where("rows = 1").select(*_NODE, F.sha2(F.col("ends").cast("binary"), 256).alias("ends_sha256"))
    many = ends.join(whole.where("rows > 1").select(*_NODE), _NODE, "left_semi").select(*_NODE, "conv_id", "ends")

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for batch in batches:
            done = []
            for *node, _, text in batch.itertuples(index=False):
                if node != key:
                    done += [(*key, state.hexdigest())] if key else []
                    key, state = node, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(text.encode())
            yield pd.DataFrame(done, columns=[*_NODE, "ends_sha256"])
        if key:
            yield pd.DataFrame([(*key, state.hexdigest())], columns=[*_NODE, "ends_sha256"])

    dealt = many.repartition(*_NODE).sortWithinPartitions(*_NODE, "conv_id")
    return one.unionByName(dealt.mapInPandas(hashed, "depth long, f1 long, f2 long, ends_sha256 string"))


# ------------------------------------------------------------------ the trie
def prefix_trie(turns: DataFrame, lengths: DataFrame, shard_units: int = SHARD_UNITS, range_rows: int = RANGE_ROWS) -> DataFrame:
    """A row for each node: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256.

    ``turns``: conv_id, number (1 to the length), id1, id2, chars; ``lengths``: conv_id, length of every
    conversation, also of those without turns."""
    paths, units = _units(turns, lengths, range_rows)
    order = [F.col(c) for c in ("block", "k1", "k2")] + [F.flatten(F.transform(F.arrays_zip("p1", "p2"), lambda t: F.array(t["p1"], t["p2"]))), F.col("conv_id")]
    sharded = units.repartitionByRange(ranges(units.count(), shard_units), *order)
    parts = staged(sharded.mapInArrow(_shard, from_arrow_schema(_PARTS)), "trie-parts")

    nodes = staged(parts.where("kind = 0").groupBy(*_NODE).agg(
        F.min("conv_id").alias("conv_id"), F.sum("n").alias("n"), F.max("chars").alias("chars"), F.max("g1").alias("g1"), F.max("g2").alias("g2")), "trie-nodes")
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("g1").alias("f1"), F.col("g2").alias("f2")).agg(F.count(F.lit(1)).alias("n_children"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("f1").alias("g1"), F.col("f2").alias("g2"), F.col("conv_id").alias("parent_conv_id"))
    none = F.lit(0).cast("long")
    nodes = staged(nodes.join(children, _NODE, "left").join(parents, ["depth", "g1", "g2"], "left").select(
        *_NODE, "conv_id", "parent_conv_id", "n", F.coalesce("n_children", none).alias("n_children"),
        F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long").alias("leaf"), ((F.col("n") - 1) * F.col("chars")).alias("saved")), "trie-linked")

    # What each conversation owns, and where it leaves the paths of the conversations above it.
    owned = staged(nodes.groupBy("conv_id").agg(F.min("depth").alias("top"), F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved")), "trie-owned")
    root = nodes.where("depth = 0").select("conv_id").first()  # one row at most
    above = paths.join(owned.select("conv_id", "top"), "conv_id").where("number < top").select("conv_id", F.col("number").alias("depth"), "f1", "f2")
    above = above.join(nodes.select(*_NODE, F.col("conv_id").alias("owner")), _NODE).select("conv_id", "owner", "depth")
    under = owned.where("top > 0").select("conv_id", F.lit(root and root[0]).cast("long").alias("owner"), none.alias("depth"))
    meets = above.unionByName(under).groupBy("conv_id", "owner").agg(F.max("depth").alias("depth"))
    extra = meets.join(owned.drop("top"), "conv_id").groupBy(F.col("owner").alias("conv_id"), "depth").agg(
        F.sum("leaf").alias("more_leaf"), F.sum("saved").alias("more_saved"))
    sums = nodes.join(extra, ["conv_id", "depth"], "left").withColumns({
        "leaf": F.col("leaf") + F.coalesce("more_leaf", none), "saved": F.col("saved") + F.coalesce("more_saved", none)})
    sums = staged(sums.drop("more_leaf", "more_saved"), "trie-sums")
    done = running(sums, "conv_id", [F.col("depth").desc()], {"n_leaves": ("leaf", "sum"), "saved_tokens": ("saved", "sum")}, "trie-subtrees", range_rows)
    return done.join(_digests(parts.where("kind = 1")), _NODE, "left").select(
        "conv_id", "depth", "parent_conv_id", F.col("n").alias("n_convs"), "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256"))
