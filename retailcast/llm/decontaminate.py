"""Benchmark decontamination by winnowing.

A window is ``WINDOW`` consecutive words of a benchmark item, or a whole shorter item. For windows
of L words, k-grams of k = ceil(L / 2) words are hashed and the minimum (rightmost among equals) of
every L - k + 1 consecutive hashes is kept. Whatever a document and an item share over at least L
words then has a kept k-gram in common, as the choice looks only at those words. Documents' and
items' fingerprints are joined; each hit is extended to every L-word span around it, and the spans
are joined on their exact words.

Where the item fingerprints and windows are proven small, they are broadcast, and documents are
read once. Beyond that bound the same steps are shuffle joins.

Defined results: null or wordless texts have no words, no hit, no items; wordless items match
nothing; a null item_id marks words as hit but is not listed; rows that repeat an id and a text
give one row, an id with two texts a row for each. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retailcast.llm.common import small_enough, staged, text_key
from retailcast.llm.words import arrow_batches, kgram_hashes, normal, word_spans

WINDOW = 10
#: Bytes of item fingerprints, and of window texts, up to which they are broadcast.
BROADCAST_BYTES = 48 << 20
CHUNK_WORDS = 1 << 16

_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128
                    else 32 for b in range(256))

def winnow(h: np.ndarray, w: int) -> np.ndarray:
    """Positions of the minimum (rightmost among equals) of every w consecutive hashes."""
    m = len(h) - w + 1
    if m <= 0:
        return np.zeros(0, np.int64)
    least, at = h[:m].copy(), np.zeros(m, np.int64)
    for j in range(1, w):
        now = h[j:j + m]
        lower = now <= least
        least[lower] = now[lower]
        at[lower] = j
    at += np.arange(m)
    return at[np.concatenate(([True], at[1:] != at[:-1]))]


def fingerprints(words: bytes, start: np.ndarray, end: np.ndarray,
                 length: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, hashes) of the kept k-grams for windows of ``length`` words, chunk by chunk."""
    k = (length + 1) // 2
    for c in range(0, max(0, len(start) - length + 1), CHUNK_WORDS):
        s, e = start[c:c + CHUNK_WORDS + length - 1], end[c:c + CHUNK_WORDS + length - 1]
        h = kgram_hashes(words, s, e, k)
        at = winnow(h, length - k + 1)
        yield at + c, h[at]


def spans_around(hits: np.ndarray, n_words: int, length: int) -> np.ndarray:
    """Starts of all spans of ``length`` words that hold a k-gram starting at one of ``hits``."""
    back = length - (length + 1) // 2
    s = np.unique((hits[:, None] - np.arange(back + 1)[None, :]).ravel())
    return s[(s >= 0) & (s <= n_words - length)]


def _span_text(words: bytes, start: np.ndarray, end: np.ndarray, s: int, length: int) -> str:
    return words[start[s]:end[s + length - 1]].decode()


_CANDIDATE = "doc_id long, text_hash long, n_words long, start long, len int, span string"
_CANDIDATE_ARROW = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_words", pa.int64()),
                              ("start", pa.int64()), ("len", pa.int32()), ("span", pa.string())])


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[int | None, int, bytes | None, int]]:
    ids, hashes, texts = batch.column(0), batch.column(1), batch.column(2).cast(pa.binary())
    for i in range(batch.num_rows):
        yield ids[i].as_py(), hashes[i].as_py(), texts[i].as_py(), i


def _one_pass(shared, lengths: list[int]):
    """Per document a row with its word count, and one for each span around a fingerprint hit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value

        def rows():
            for batch in batches:
                for doc_id, text_hash, text, _ in _rows(batch):
                    words = normal(text, _WORD_BYTES)
                    start, end = word_spans(words)
                    n = len(start)
                    yield doc_id, text_hash, n, None, None, None
                    for length in lengths:
                        hits = [at[_among(h, known[length])] for at, h in fingerprints(words, start, end, length)]
                        hits = np.concatenate(hits) if hits else np.zeros(0, np.int64)
                        if len(hits):
                            for s in spans_around(hits, n, length).tolist():
                                yield doc_id, text_hash, n, s, length, _span_text(words, start, end, s, length)

        yield from arrow_batches(rows(), _CANDIDATE_ARROW)
    return run


def _among(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    at = np.searchsorted(known, h)
    at[at == len(known)] = 0
    return known[at] == h


_FP = "id long, text_hash long, n_words long, len int, at long, fp long"
_FP_ARROW = pa.schema([("id", pa.int64()), ("text_hash", pa.int64()), ("n_words", pa.int64()),
                       ("len", pa.int32()), ("at", pa.int64()), ("fp", pa.int64())])


def _all_fingerprints(lengths: list[int] | None):
    """Every kept k-gram; ``lengths`` None: items, by their own window length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for id_, text_hash, text, _ in _rows(batch):
                words = normal(text, _WORD_BYTES)
                start, end = word_spans(words)
                n = len(start)
                for length in [min(WINDOW, n)] * (n > 0) if lengths is None else lengths:
                    for at, h in fingerprints(words, start, end, length):
                        m = len(at)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([id_] * m, pa.int64()), pa.array([text_hash] * m, pa.int64()),
                             pa.array(np.full(m, n)), pa.array(np.full(m, length, np.int32)),
                             pa.array(at.astype(np.int64)), pa.array(h.view(np.int64))], schema=_FP_ARROW)
    return run


_WINDOW = "item_id long, len int, span string"
_WINDOW_ARROW = pa.schema([("item_id", pa.int64()), ("len", pa.int32()), ("span", pa.string())])


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for batch in batches:
            for item_id, _, text, _ in _rows(batch):
                words = normal(text, _WORD_BYTES)
                start, end = word_spans(words)
                length = min(WINDOW, len(start))
                for s in range(len(start) - length + 1 if length else 0):
                    yield item_id, length, _span_text(words, start, end, s, length)
    yield from arrow_batches(rows(), _WINDOW_ARROW)


def _extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans around given hits (column 3: array of (len, at)); a row without span for each document."""

    def rows():
        for batch in batches:
            found = batch.column(3)
            for doc_id, text_hash, text, i in _rows(batch):
                words = normal(text, _WORD_BYTES)
                start, end = word_spans(words)
                n = len(start)
                yield doc_id, text_hash, n, None, None, None
                by_length: dict[int, list[int]] = {}
                for hit in found[i].as_py() or ():
                    by_length.setdefault(hit["len"], []).append(hit["at"])
                for length, at in by_length.items():
                    for s in spans_around(np.array(at), n, length).tolist():
                        yield doc_id, text_hash, n, s, length, _span_text(words, start, end, s, length)
    yield from arrow_batches(rows(), _CANDIDATE_ARROW)


def _covered(spans: Column) -> Column:
    """Words under the union of the (start, len) spans."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to"))

    def step(acc, x):
        to = x["start"] + x["len"]
        return F.struct((acc["n"] + F.greatest(F.lit(0), to - F.greatest(acc["to"], x["start"]))).cast("long").alias("n"),
                        F.greatest(acc["to"], to).cast("long").alias("to"))
    return F.aggregate(F.array_sort(spans), zero, step, lambda acc: acc["n"])


def candidate_spans(docs: DataFrame, items: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Spans of ``docs`` (id, text_hash, text) around a fingerprint that an item also has."""
    marks = items.mapInArrow(_all_fingerprints(None), _FP).select("len", "fp").distinct()
    marks = staged(marks, "item-fingerprints")
    lengths = sorted(r[0] for r in marks.select("len").distinct().collect())  # 1 to WINDOW
    if small_enough(marks, max_bytes, 12):
        known: dict[int, np.ndarray] = {}
        held = marks.toPandas()
        for length in lengths:
            known[length] = np.sort(held.fp[held.len == length].to_numpy(np.int64).view(np.uint64))
        shared = docs.sparkSession.sparkContext.broadcast(known)
        return docs.mapInArrow(_one_pass(shared, lengths), _CANDIDATE)
    hits = (docs.mapInArrow(_all_fingerprints(lengths), _FP).join(marks, ["len", "fp"], "left_semi")
            .groupBy("id", "text_hash").agg(F.collect_set(F.struct("len", "at")).alias("hits")))
    d, h = docs.alias("d"), hits.alias("h")
    both = d.join(h, F.col("d.doc_id").eqNullSafe(F.col("h.id")) & (F.col("d.text_hash") == F.col("h.text_hash")), "left")
    return both.select("d.doc_id", "d.text_hash", "d.text", "h.hits").mapInArrow(_extend, _CANDIDATE)


def decontaminate(docs: DataFrame, items: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Per document: doc_id, text_hash, n_words, n_hit, spans (start, len, of matched windows),
    n_items, items_sha256, contaminated."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("text_hash"),
                       F.col("text").cast("string").alias("text"))
    items = items.select(F.col("item_id").cast("long").alias("item_id"), text_key(F.col("text")).alias("text_hash"),
                         F.col("text").cast("string").alias("text"))
    windows = staged(items.mapInArrow(_item_windows, _WINDOW).distinct(), "item-windows")
    # Windows that occur in the same items share a set, told by order-free sums over the item ids:
    # no list of items is gathered for a window.
    sets = windows.groupBy("len", "span").agg(F.concat_ws(
        "-", F.count("*"), F.bit_xor(F.xxhash64("item_id")),
        F.sum(F.pmod(F.xxhash64(F.lit(1), "item_id"), F.lit(1 << 31)))).alias("items_set"))
    sets = staged(sets, "window-sets")
    small = small_enough(sets, max_bytes, F.length("span") + 64)
    found = candidate_spans(docs, items, max_bytes).join(F.broadcast(sets) if small else sets, ["len", "span"], "left")
    span = F.when(F.col("items_set").isNotNull(), F.struct("start", "len"))
    per_doc = (found.groupBy("doc_id", "text_hash")
               .agg(F.max("n_words").alias("n_words"), F.collect_set(span).alias("spans"),
                    F.collect_set("items_set").alias("sets"))
               .withColumns({"n_hit": _covered(F.col("spans")),
                             "signature": F.when(F.size("sets") > 0, F.md5(F.array_join(F.array_sort("sets"), ",")))
                             .otherwise(F.concat(F.lit("none "), F.hex(F.xxhash64("doc_id", "text_hash"))))}))
    per_doc = staged(per_doc, "decontaminated")
    # Documents without hits have signatures of their own, so they don't meet in one task.
    # The list of items is made once for each distinct collection of sets, not for each document.
    member = (sets.groupBy("items_set").agg(F.min(F.struct("len", "span")).alias("w")).select("items_set", "w.*")
              .join(windows, ["len", "span"]).select("items_set", "item_id").where("item_id is not null"))
    digests = (per_doc.where(F.size("sets") > 0).select("signature", "sets").dropDuplicates(["signature"])
               .select("signature", F.explode("sets").alias("items_set")).join(member, "items_set")
               .groupBy("signature").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("ids"))
               .select("signature", F.size("ids").cast("long").alias("n_items"),
                       F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("items_sha256")))
    digests = staged(digests, "digests")
    if small_enough(digests, max_bytes, 256):
        digests = F.broadcast(digests)
    return per_doc.join(digests, "signature", "left").select(
        "doc_id", "text_hash", "n_words", "n_hit", "spans", F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))
