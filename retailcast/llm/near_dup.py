"""Near-duplicate groups with SetSketch registers.

A document's set is its distinct shingles of ``words`` words. Its sketch keeps, for each of ``M``
hashes, the minimum as a register on an exponential scale: floor(1 - log_b(e)), truncated to 16 bits,
with e the least of as many exponential variables as the set has elements. Registers of a union are
the larger of the parts' registers; they are equal in two sets with a probability that grows with
their Jaccard similarity.

Bands of registers are hashed; sets that agree on a band meet in its bucket. The number of registers
to a band is the largest that misses a pair at the threshold with a probability under ``MISS``.
Pairs must pass a joint maximum-likelihood test of their registers and sizes (six standard
deviations), then are confirmed by the intersection of their full sets.

No bucket is expanded into all its pairs. First each bucket's members are compared with its pivot:
the smallest id, then the member with most links so far. Whoever is in one component needs no
further comparison. What is left, members of a bucket outside its largest component against all of
another component, is compared in cells of bounded size that return only one link to each component.
So each pair that meets in a bucket is either confirmed, refuted, or already connected.

Each distinct set is a node with a key of its own, whatever ids its rows have, or none; a component's
id is the smallest of all its rows. Defined results: null and wordless texts have no set, 0 shingles and
are their own component; each row gives a row; texts that share an id are compared and grouped like any
others, so two components can have one id (``component`` tells them apart); rows without id are labelled
by the ids that they reach, and of a component without ids the rows of the least text_hash are kept.
Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retailcast.llm.common import small_enough, staged, text_key, unstage
from retailcast.llm.words import give_back, kgram_hashes, normal, word_spans

M = 256
BASE = 1.01
RATE = 20.0
TOP = (1 << 16) - 1
MISS = 1e-8
SIGMAS = 6.0
CHUNK_WORDS = 1 << 16
#: Bytes up to which the rows that name the sets that met another are broadcast to fetch the texts, and
#: the ids of components to label their sets.
BROADCAST_BYTES = 32 << 20
#: Sets on either side of a cell of the last comparison.
SMALL_SIDE, LARGE_SIDE = 256, 1024

_SIGNS = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_FACTORS = np.random.default_rng(97).integers(0, 1 << 63, M, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def band_rows(threshold: float) -> int:
    """Registers to a band: as many as miss a pair at the threshold with a probability under MISS."""
    return max(r for r in range(1, M) if r == 1 or (1 - threshold ** r) ** (M // r) <= MISS)


def shingle_set(text: bytes | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles; the whole sequence, if it has fewer words."""
    joined = normal(text, _SIGNS)
    start, end = word_spans(joined)
    if not len(start):
        return np.zeros(0, np.uint64)
    k = min(words, len(start))
    return np.unique(np.concatenate([
        kgram_hashes(joined, start[c:c + CHUNK_WORDS + k - 1], end[c:c + CHUNK_WORDS + k - 1], k)
        for c in range(0, len(start) - k + 1, CHUNK_WORDS)]))


def sketch(shingles: np.ndarray) -> np.ndarray:
    """SetSketch registers of a set that isn't empty."""
    least = np.full(M, np.iinfo(np.uint64).max, np.uint64)
    for c in range(0, len(shingles), 1024):
        np.minimum(least, (shingles[c:c + 1024, None] * _FACTORS).min(axis=0), out=least)
    e = -np.log1p(-(least.astype(np.float64) + 1) / 2.0 ** 64 * (1 - 2.0 ** -53)) / RATE
    return np.clip(np.floor(1 - np.log(e) / math.log(BASE)), 0, TOP).astype("<u2")


def band_keys(registers: Column, rows: int) -> Column:
    """A hash of each band of registers."""
    size = 2 * rows
    return F.transform(F.sequence(F.lit(0), F.lit(M // rows - 1)),
                       lambda i: F.xxhash64(i, F.substring(registers, i * size + 1, F.lit(size))))


_GRID = np.linspace(0.0, 1.0, 201)


def may_reach(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, threshold: float) -> np.ndarray:
    """Whether the registers (rows of a and b) of sets of n_a and n_b elements allow a similarity at the
    threshold: its log likelihood is within SIGMAS standard deviations of the best."""
    more, less = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
    u, v = (n_a / (n_a + n_b))[:, None], (n_b / (n_a + n_b))[:, None]
    grid = np.minimum(_GRID[None, :], np.minimum(u / v, v / u))  # no more than the sizes allow

    def p(x: np.ndarray) -> np.ndarray:
        return np.clip(-np.log1p(-np.maximum(x, 0) * (BASE - 1) / BASE) / math.log(BASE), 1e-9, 1)

    def likelihood(j: np.ndarray) -> np.ndarray:
        up, down = p(u - v * j), p(v - u * j)
        return more * np.log(up) + less * np.log(down) + (M - more - less) * np.log(np.maximum(1 - up - down, 1e-9))
    all_j = likelihood(grid)
    best = all_j.max(1)
    above = np.where(grid >= threshold, all_j, -np.inf).max(1)
    above = np.maximum(above, likelihood(np.full_like(u, threshold))[:, 0])
    return (above >= best - SIGMAS ** 2 / 2) & (np.minimum(u / v, v / u)[:, 0] >= threshold - 1e-9)


_ROWS = "doc_id long, text_hash long, n_shingles long, digest string, registers binary"
_ROWS_ARROW = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.string()), ("registers", pa.binary())])


def _sketches(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, out = batch.column(1).cast(pa.binary()), []
            for text in texts:
                shingles = shingle_set(text.as_py(), words)
                if len(shingles):
                    out.append((len(shingles), hashlib.blake2b(shingles.tobytes(), digest_size=16).hexdigest(),
                                sketch(shingles).tobytes()))
                else:
                    out.append((0, None, None))
            if out:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(
                    pa.array(c, f.type) for c, f in zip(zip(*out), list(_ROWS_ARROW)[2:]))], schema=_ROWS_ARROW)
        give_back()
    return run


def _sets(words: int):
    schema = pa.schema([("id", pa.int64()), ("shingles", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in range(0, batch.num_rows, 256):
                texts = batch.column(1)[c:c + 256].cast(pa.binary())
                held = [shingle_set(t.as_py(), words).view(np.int64) for t in texts]
                yield pa.RecordBatch.from_arrays([batch.column(0)[c:c + 256], pa.array(held, pa.list_(pa.int64()))], schema=schema)
        give_back()
    return run


def _likely(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, M) for c in ("ra", "rb"))
                n_a, n_b = (batch.column(c).to_numpy() for c in ("na", "nb"))
                keep = np.concatenate([may_reach(a[i:i + 512], b[i:i + 512], n_a[i:i + 512], n_b[i:i + 512], threshold)
                                       for i in range(0, len(a), 512)])
                yield batch.select(["u", "v"]).filter(pa.array(keep))
    return run


def confirmed(pairs: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) of ``pairs`` whose full sets reach the threshold."""
    node = nodes.select("id", "n", "registers")
    both = (pairs.join(node.toDF("u", "na", "ra"), "u").join(node.toDF("v", "nb", "rb"), "v")
            .where((100 * F.col("na") >= percent * F.col("nb")) & (100 * F.col("nb") >= percent * F.col("na"))))
    likely = both.mapInArrow(_likely(percent / 100), "u long, v long")
    shared = F.size(F.array_intersect("a", "b"))
    return (likely.join(sets.toDF("u", "a"), "u").join(sets.toDF("v", "b"), "v")
            .select("u", "v", shared.alias("i"), (F.size("a") + F.size("b") - shared).alias("union"))
            .where(100 * F.col("i") >= percent * F.col("union")).select("u", "v"))


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every id in ``links`` (u, v): the smallest id that it reaches.

    Alternating stars: each node hands its larger neighbours to its smallest one, then its smaller
    neighbours; the links shrink to stars in few rounds, each written to the shared folder."""
    edges = staged(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    while True:
        mirrored = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = mirrored.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (mirrored.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")),
                                                                 F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
                 .select("e.*").where("u <> v").distinct())
        before_edges, edges = edges, staged(small, "edges")
        unstage(before_edges)
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum("v")).first()
        if state == before:
            break
        before = state
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def _cell(percent: int):
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(small: pa.Table, large: pa.Table) -> pa.Table:
        """One link from each small-side set to each other component of the large side, if there is any."""
        us, vs = [], []
        if small.num_rows and large.num_rows:
            registers = np.frombuffer(b"".join(large["registers"].to_pylist()), "<u2").reshape(-1, M)
            n, ids, comps = large["n"].to_numpy(), large["id"].to_numpy(), large["component"].to_numpy()
            sets = large["shingles"]
            small_sets = small["small_shingles"]
            columns = ["id", "component", "n", "registers"]
            for at, row in enumerate(small.select([f"small_{c}" for c in columns]).rename_columns(columns).to_pylist()):
                # sizes alone refute most sets, then registers
                open_ = (comps != row["component"]) & (100 * n >= percent * row["n"]) & (100 * row["n"] >= percent * n)
                if not open_.any():
                    continue
                theirs = registers[open_]
                mine = np.broadcast_to(np.frombuffer(row["registers"], "<u2"), theirs.shape)
                open_[open_] = may_reach(mine, theirs, np.full(len(theirs), row["n"]), n[open_], percent / 100)
                own, done = small_sets[at].values.to_numpy(), set()
                for i in np.flatnonzero(open_):
                    if comps[i] not in done:
                        shared = len(np.intersect1d(own, sets[int(i)].values.to_numpy(), assume_unique=True))
                        if 100 * shared >= percent * (row["n"] + n[i] - shared):
                            done.add(comps[i])
                            us.append(row["id"])
                            vs.append(int(ids[i]))
        return pa.table([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], schema=schema)
    return run


def _left_over(members: DataFrame, labels: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between members of a bucket that are still in different components."""
    rows = members.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = (rows.groupBy("band", "component").agg(F.count("*").alias("n")).groupBy("band")
             .agg(F.max(F.struct("n", F.col("component").alias("main")))["main"].alias("main"),
                  F.sum("n").alias("size"), F.max("n").alias("most"))
             .where((F.col("most") < F.col("size")) & (F.col("size") > 2)))
    rows = rows.join(mixed, "band").withColumn("small", F.col("component") != F.col("main"))
    parts = lambda n, side: F.greatest(F.lit(1), F.ceil(n / side)).cast("int")
    part = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), "id", "band"), n).cast("int")
    rows = rows.withColumns({"small_parts": parts(F.col("size") - F.col("most"), SMALL_SIDE), "large_parts": parts(F.col("size"), LARGE_SIDE)})
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    keys = ["band", "s", "l"]
    left = rows.where("small").select("band", part(1, F.col("small_parts")).alias("s"), every(F.col("large_parts")).alias("l"), "id", "component")
    right = rows.select("band", every(F.col("small_parts")).alias("s"), part(2, F.col("large_parts")).alias("l"), "id", "component")
    full = nodes.select("id", "n", "registers").join(sets, "id")
    left, right = left.join(full, "id"), right.join(full, "id")
    left = left.toDF(*[f"small_{c}" for c in left.columns])
    return (left.groupBy(*[f"small_{k}" for k in keys]).cogroup(right.groupBy(*keys))
            .applyInArrow(_cell(percent), "u long, v long"))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Per row of ``docs``: doc_id, text_hash, n_shingles, digest (of its set), component (key of its set's
    component, null without a set), component_id (smallest id in it), kept (it is that id)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       text_key(F.col("text")).alias("text_hash"))
    rows = staged(docs.mapInArrow(_sketches(words), _ROWS), "sketches")
    # Equal sets are one node, with a number that is fixed once written. One of its rows, with an id if any
    # has one, leads to its text.
    nodes = staged(rows.where("digest is not null").groupBy("digest")
                   .agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash",
                                       F.col("n_shingles").alias("n"), "registers")).alias("x"))
                   .select("digest", F.monotonically_increasing_id().alias("id"), "x.doc_id", "x.text_hash", "x.n", "x.registers"), "nodes")
    banded = nodes.select("id", F.explode(band_keys(F.col("registers"), band_rows(percent / 100))).alias("band"))
    # Near copies meet in many bands. Buckets with the same members, told by order-free sums over
    # the ids, are one; buckets of one are none.
    buckets = (banded.groupBy("band").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("id")).alias("x"),
                                          F.sum(F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(1 << 31))).alias("s"))
               .where("n > 1").groupBy("n", "x", "s").agg(F.min("band").alias("band")).select("band"))
    members = staged(banded.join(buckets, "band"), "buckets")

    met = nodes.join(members.select("id").distinct(), "id", "left_semi").select("id", F.col("doc_id").alias("key_id"), F.col("text_hash").alias("key_hash"))
    if small_enough(met, BROADCAST_BYTES, 24):
        met = F.broadcast(met)
    sets = staged(docs.join(met, F.col("doc_id").eqNullSafe(F.col("key_id")) & (F.col("text_hash") == F.col("key_hash")))
                  .select("id", "text").mapInArrow(_sets(words), "id long, shingles array<long>")
                  .groupBy("id").agg(F.max_by("shingles", F.size("shingles")).alias("shingles")), "sets")

    pivots = members.groupBy("band").agg(F.min("id").alias("v"))
    links, done = None, []
    for _ in range(2):
        pairs = members.join(pivots, "band").select(F.col("id").alias("u"), "v").where("u <> v")
        pairs = pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        if links is not None:
            pairs = pairs.join(tried, ["u", "v"], "left_anti")
        pairs = staged(pairs, "pairs")
        found = staged(confirmed(pairs, nodes, sets, percent), "links")
        done += [pairs, found]
        tried, links = pairs, found if links is None else links.unionByName(found)
        degree = links.select(F.explode(F.array("u", "v")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
        pivots = (members.join(degree, "id").groupBy("band")
                  .agg(F.max_by("id", F.struct("degree", -F.col("id"))).alias("v")))
    labels = components(links)
    more = staged(_left_over(members, labels, nodes, sets, percent), "links")
    first, done = labels, [*done, more]
    labels = staged(components(first.select(F.col("id").alias("u"), F.col("component").alias("v")).unionByName(more)), "labels")
    unstage(members, sets, first, *done)

    reached = (nodes.select("id", "doc_id", "text_hash").join(labels, "id").groupBy("component")
               .agg(F.min("doc_id").alias("least_id"), F.min("text_hash").alias("least_hash")))
    if small_enough(reached, BROADCAST_BYTES, 24):
        reached = F.broadcast(reached)
    named = (nodes.select("digest", "id", "doc_id", "text_hash").join(labels.join(reached, "component"), "id", "left")
             .select("digest", F.coalesce("component", "id").alias("component"),
                     F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("least_id")).alias("component_id"),
                     F.when(F.col("component").isNull(), F.col("text_hash")).otherwise(F.col("least_hash")).alias("least_hash")))
    own = F.col("doc_id").isNotNull() | F.col("digest").isNull() | (F.col("text_hash") == F.col("least_hash"))
    return (rows.select("doc_id", "text_hash", "n_shingles", "digest").join(named, "digest", "left")
            .withColumn("component_id", F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
            .select("doc_id", "text_hash", "n_shingles", "digest", "component", "component_id",
                    (F.col("doc_id").eqNullSafe(F.col("component_id")) & own).alias("kept")))
