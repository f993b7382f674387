"""Packing tokenized documents into sequences of a fixed capacity, by patterns of a few lengths.

Each document becomes its token ids and an end id. Documents longer than the capacity are cut into
pieces that fill a sequence, only the first piece may be shorter. Only the histogram of piece lengths
(at most one row for each length) goes to the driver. There, all patterns of two or three lengths that fill a
sequence exactly are enumerated, non-negative least squares (weighted by length, so that long pieces
are not left over) says how often each repeats, the counts are rounded, and the lengths that remain are packed best fit first, the longest first.
The resulting plan has rows (length, pieces from .. to, first sequence, offset); pieces of a length are
numbered over all tasks and look their sequence up in it. The work on the driver and the plan depend on
the capacity, not on the number of documents.

Defined results: null and empty texts are a document of the end id alone; ids may be null or repeated,
each row is a document; special strings inside a text are what the library makes of them by default;
texts of any length are taken whole; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from retailcast.llm.common import staged
from retailcast.llm.running import RANGE_ROWS, running

CAPACITY = 2048
#: Largest capacity whose patterns are enumerated (their number grows with its square).
LARGEST = 4096
END_ID = 0
#: Token bytes held before a batch of pieces is given out.
BATCH_BYTES = 4 << 20
#: The fit adds so many patterns a round at most, for so many rounds, with so many inner steps; this
#: share of a fitted count is kept, the rest is left to the best fit.
ADDED, ROUNDS, STEPS, KEPT = 128, 60, 60, 0.9

# Fixed value: the pre-tokenizer's pattern of the byte-level vocabulary.
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts with such runs go to the library that takes long pieces in n log n.
_LONG_RUN = regex.compile(r"\S{1000}|\s{1000}")


# ------------------------------------------------------------------ documents to pieces
class Encoder:
    """Ids of texts as the vocabulary file's own library gives them.

    A byte-level file whose merges come in the order of their ids is one of ranks as well, for which there
    is a faster library; it takes all texts but those with very long runs. Any other file goes without it."""

    def __init__(self, spec: bytes):
        from tokenizers import Tokenizer
        self.slow = Tokenizer.from_str(spec.decode())
        self.slow.no_truncation()
        self.slow.no_padding()
        self.fast = _ranked(json.loads(spec))

    def ids(self, text: str) -> np.ndarray:
        if self.fast is not None and not _LONG_RUN.search(text):
            return self.fast.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False)
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, "<u4")


def _ranked(spec: dict):
    """The vocabulary as ranks, None if its form isn't known to give the same ids."""
    import tiktoken

    before, model = spec.get("pre_tokenizer") or {}, spec["model"]
    plain = (before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
             and spec.get("normalizer") is None and model.get("type") == "BPE" and not model.get("ignore_merges")
             and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback")))
    special = {x["content"]: x["id"] for x in spec["added_tokens"]}
    if not plain or any(x.get(k) for x in spec["added_tokens"] for k in ("lstrip", "rstrip", "single_word", "normalized")):
        return None
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
    ranks = {bytes(byte[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
    made = [model["vocab"].get("".join(m.split(" ") if isinstance(m, str) else m), -1) for m in model["merges"]]
    if made != sorted(set(made)) or len(made) + 256 != len(ranks):
        return None
    return tiktoken.Encoding("ranks", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens=special)


_encoders: dict[int, Encoder] = {}


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID,
                 with_ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked, ids (little-endian unsigned 32-bit) of
    each piece. ``vocabulary``: the path of the vocabulary file on the driver; its contents are broadcast."""
    with open(vocabulary, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    out = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "")
    names = [c.split()[0] for c in out.split(", ")]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()][:len(names)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoders.get(hash(shared.value))
        if encoder is None:
            encoder = _encoders[hash(shared.value)] = Encoder(shared.value)
        end = np.array([end_id], "<u4")
        rows, size = [], 0
        give = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.concatenate((encoder.ids(text.as_py() or ""), end))
                first = (len(ids) - 1) % capacity + 1
                for piece, start in enumerate([0, *range(first, len(ids), capacity)]):
                    part = ids[start:first if piece == 0 else start + capacity].tobytes()
                    rows.append((doc_id, piece, start, len(part) // 4, zlib.crc32(part), part)[:len(names)])
                    size += len(part)
                if size >= BATCH_BYTES or len(rows) >= 10_000:
                    yield give()
                    rows, size = [], 0
        if rows:
            yield give()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, out)


# ------------------------------------------------------------------ the plan
def patterns(histogram: np.ndarray) -> np.ndarray:
    """All pairs and triples of the histogram's lengths whose sum is the capacity (its last index), in
    three columns; a pair's third is 0."""
    capacity = len(histogram) - 1
    short = np.arange(1, capacity // 2 + 1)
    pairs = np.stack([short, capacity - short, np.zeros_like(short)], 1)
    a, b = np.meshgrid(np.arange(1, capacity // 3 + 1), short, indexing="ij")
    c = capacity - a - b
    rising = (a <= b) & (b <= c)
    found = np.concatenate([pairs, np.stack([a[rising], b[rising], c[rising]], 1)])
    there = histogram > 0
    there[0] = True
    return found[there[found].all(1)]


def fit_repeats(found: np.ndarray, histogram: np.ndarray) -> np.ndarray:
    """How often each pattern repeats: non-negative x with the least sum of (length x pieces left over or
    lacking)². An active-set method: the patterns of the steepest descent that share no length enter
    together, the unrestricted fit of the active ones is found by conjugate gradients, and those that it
    makes negative leave on the way there."""
    n, x = len(histogram), np.zeros(len(found))
    weight = np.arange(n) / (n - 1)
    wanted = histogram * weight
    scale = np.sqrt(wanted @ wanted)
    if not len(found) or not scale:
        return x
    length = np.sqrt((weight[found] ** 2).sum(1))

    def used(which, repeats):
        return weight * sum(np.bincount(found[which, j], weights=repeats, minlength=n) for j in range(3))

    def slope(which, left):
        return (weight * left)[found[which]].sum(1)

    def unrestricted(which, start):
        y, left = start.copy(), wanted - used(which, start)
        g = slope(which, left)
        p, gg = g.copy(), g @ g
        least = 1e-10 * gg
        for _ in range(STEPS):
            if gg <= least or not gg:
                break
            q = used(which, p)
            step = gg / (q @ q)
            y, left = y + step * p, left - step * q
            g = slope(which, left)
            p, gg = g + (g @ g) / gg * p, g @ g
        return y

    active, y = np.zeros(0, np.int64), np.zeros(0)
    for _ in range(ROUNDS):
        descent = slope(slice(None), wanted - used(active, y)) / length
        descent[active] = 0
        taken, entering = np.zeros(n, bool), []
        for k in np.argsort(-descent, kind="stable")[:4 * ADDED]:
            own = found[k][found[k] > 0]
            if descent[k] <= 1e-5 * scale or len(entering) == ADDED:
                break
            if not taken[own].any():
                taken[own] = True
                entering.append(k)
        if not entering:
            break
        active, y = np.concatenate([active, entering]).astype(np.int64), np.concatenate([y, np.zeros(len(entering))])
        while len(active):
            z = unrestricted(active, y)
            low = z <= 0
            if not low.any():
                y = z
                break
            way = np.where(low, y / np.maximum(y - z, 1e-300), np.inf)  # share of the way until it is 0
            stay = way > way.min()
            y = (y + way.min() * (z - y))[stay]
            active = active[stay]
    x[active] = y
    return x


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, first, beyond, sequence, offset): the pieces of a length numbered from ``first`` to
    before ``beyond`` go one each to the sequences from ``sequence`` on, at ``offset``."""
    if not 0 < capacity <= LARGEST:
        raise ValueError(f"capacity must be 1 to {LARGEST}")
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] += n
    rows, given, sequences = [], np.zeros(capacity + 1, np.int64), 0

    def place(length: int, n: int, sequence: int, offset: int) -> None:
        rows.append((length, int(given[length]), int(given[length]) + n, sequence, offset))
        given[length] += n
        left[length] -= n

    if left[capacity]:  # whole sequences
        n = int(left[capacity])
        place(capacity, n, 0, 0)
        sequences = n
    found = patterns(left)
    repeats = fit_repeats(found, left.astype(float))
    for k in np.argsort(-repeats, kind="stable"):
        n = int(repeats[k] * KEPT + 0.5)
        if not n:
            break
        own = found[k][found[k] > 0]
        lengths, times = np.unique(own, return_counts=True)
        n = min(n, int((left[lengths] // times).min()))
        if n:
            offset = 0
            for length in own[::-1].tolist():
                place(length, n, sequences, offset)
                offset += length
            sequences += n
    # Best fit: groups of sequences that are filled alike, by the room that they have left.
    room: dict[int, list[tuple[int, int]]] = {}
    rooms: list[int] = []  # its keys, ascending

    def leave(free: int, first: int, n: int) -> None:
        if free not in room:
            insort(rooms, free)
        room.setdefault(free, []).append((first, n))

    for length in range(capacity - 1, 0, -1):
        while left[length]:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                new = -(-int(left[length]) // (capacity // length))
                leave(capacity, sequences, new)
                sequences += new
            free = rooms[at]
            first, n = room[free].pop()
            if not room[free]:
                del room[free], rooms[at]
            put = min(n, int(left[length]))
            if put < n:
                leave(free, first + put, n - put)
            place(length, put, first, capacity - free)
            if free > length:
                leave(free - length, first, put)
    return rows


# ------------------------------------------------------------------ pieces to sequences
def pack(pieces: DataFrame, capacity: int = CAPACITY, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``pieces`` (of ``token_pieces``) with sequence_id and offset."""
    # Equal keys are equal pieces but for copies of a row; the order among those is written with them.
    held = staged(pieces.withColumns({"_one": F.lit(1).cast("long"), "_tie": F.monotonically_increasing_id()}), "pieces")
    counts = {r["length"]: r["count"] for r in held.groupBy("length").count().collect()}  # one row for each length
    rows = np.array(sorted(plan(counts, capacity)), np.int64).reshape(-1, 5)
    numbered = running(held, "length", [F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("_tie")],
                       {"_number": ("_one", "sum")}, "numbered-pieces", range_rows)
    keys = rows[:, 0] << 48 | rows[:, 1]
    fields = numbered.drop("_one", "_tie", "_number").schema
    schema = StructType(fields.fields + [StructField("sequence_id", LongType()), StructField("offset", LongType())])

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = batch.column("_number").to_numpy() - 1
            at = np.searchsorted(keys, batch.column("length").to_numpy() << 48 | number, side="right") - 1
            added = [pa.array(rows[at, 3] + number - rows[at, 1]), pa.array(rows[at, 4])]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in fields.names), *added], names=schema.names)

    return numbered.mapInArrow(look_up, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, length, documents and ids (little-endian unsigned 32-bit) of each sequence, for packed
    pieces with ids. A sequence is bounded by the capacity."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "doc_id", "piece", "ids")))
    whole = packed.groupBy("sequence_id").agg(parts.alias("parts"))
    return whole.select("sequence_id", F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + p["length"]).alias("length"),
                        F.transform("parts", lambda p: F.struct(p["doc_id"].alias("doc_id"), p["piece"].alias("piece"), p["offset"].alias("offset"))).alias("documents"),
                        F.aggregate("parts", F.lit(b""), lambda x, p: F.concat(x, p["ids"])).alias("ids"))
