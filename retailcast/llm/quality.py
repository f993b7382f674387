"""Quality by perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model is of order ``ORDER`` over UTF-8 bytes (a text starts after ORDER - 1 pads), counted over
all trusted texts; each task sums its own n-grams before they are shuffled by n-gram. Lower orders use
continuation counts. Discounts for counts of 1, 2 and 3 or more come from the counts of counts.
Probabilities of all seen n-grams, and the weights that their contexts leave to the order below, are
made by joins of the count tables, sharded by n-gram.

A model that is proven small is broadcast and texts are scored where they are. Beyond that bound,
each document's distinct n-grams join the sharded tables. A document is kept if its perplexity per byte is at most
the ``QUANTILE`` of that of trusted documents in its language (of all, for a language without any) that the
model was not trained on (one in ``HELD_OUT``, by a hash of the id), or, if that is more, where it lies by
the mean and deviation of their logarithms.

Defined results: null and empty texts have no perplexity and are not kept; no trusted text at all:
no perplexity, and all texts that aren't empty are kept; a null language is a language; each row gives a row. Other
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retailcast.llm.common import small_enough, staged

ORDER = 5
SIGNS = 257
QUANTILE = 0.995
#: One in so many trusted ids gives thresholds instead of n-grams.
HELD_OUT = 5
#: Bytes of n-grams and contexts, at 16 each, and of ids of trusted documents up to which they are broadcast.
BROADCAST_BYTES = 64 << 20
_CHUNK = 1 << 20


def _symbols(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of the texts one after the other, each after its pads; where each text's first byte is."""
    pad = bytes(ORDER - 1)
    joined = np.frombuffer(pad.join([b"", *texts]), np.uint8).astype(np.int64) + 1
    sizes = np.array([len(t) + ORDER - 1 for t in texts])
    first = np.cumsum(sizes) - sizes + ORDER - 1
    for i in range(1, ORDER):
        joined[first - i] = 0
    return joined, first


def codes(symbols: np.ndarray) -> np.ndarray:
    """Code of the ORDER symbols that end at each position, from the (ORDER - 1)th on."""
    out = np.zeros(len(symbols) - ORDER + 1, np.int64)
    for i in range(ORDER):
        out = out * SIGNS + symbols[i:len(symbols) - ORDER + 1 + i]
    return out


def _chunks(texts: Iterator[bytes]) -> Iterator[tuple[int, bytes, bool]]:
    """(text number, piece with ORDER - 1 bytes of context, whether it begins the text)."""
    for i, text in enumerate(texts):
        for at in range(0, max(len(text), 1), _CHUNK):
            yield i, text[max(0, at - ORDER + 1):at + _CHUNK], at == 0


def piece_codes(text: bytes) -> Iterator[np.ndarray]:
    """Codes at all bytes of a text, piece by piece."""
    for _, piece, begins in _chunks(iter([text])):
        symbols = np.frombuffer(piece, np.uint8).astype(np.int64) + 1
        got = codes(np.concatenate((np.zeros(ORDER - 1, np.int64), symbols)) if begins else symbols)
        if len(got):
            yield got


_COUNTS = pa.schema([("code", pa.int64()), ("n", pa.int64())])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of n-grams, summed over as many texts as fit in memory."""
    held, size = [], 0
    known, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def merged():
        code, at = np.unique(np.concatenate([known, *held]), return_inverse=True)
        weights = np.concatenate([sums, np.ones(sum(map(len, held)), np.int64)])
        return code, np.bincount(at, weights, len(code)).astype(np.int64)

    for batch in batches:
        for text in batch.column(0).cast(pa.binary()):
            for got in piece_codes(text.as_py() or b""):
                held.append(got)
                size += len(got)
                if size > 4 * _CHUNK:
                    known, sums = merged()
                    held, size = [], 0
        if len(known) > 4 * _CHUNK:
            yield pa.RecordBatch.from_arrays([pa.array(known), pa.array(sums)], schema=_COUNTS)
            known, sums = known[:0], sums[:0]
    if held:
        known, sums = merged()
    if len(known):
        yield pa.RecordBatch.from_arrays([pa.array(known), pa.array(sums)], schema=_COUNTS)


def _discounts(counts: DataFrame) -> list[float]:
    """D1, D2 and D3+ of a count table, from its counts of counts."""
    n = {int(r[0]): r[1] for r in counts.where("n <= 4").groupBy("n").count().collect()}
    n1, n2, n3, n4 = (n.get(i, 0) for i in range(1, 5))
    if not (n1 and n2 and n3 and n4):
        return [0.5, 0.75, 0.9]  # too little text for estimates
    y = n1 / (n1 + 2 * n2)
    raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return [min(max(d, 0.05), i + 0.95) for i, d in enumerate(raw)]


def train(texts: DataFrame) -> dict[int, tuple[DataFrame, DataFrame]]:
    """For each order: (code, logp) of the seen n-grams and (context, logw) of what a context leaves to the order below."""
    counts = {ORDER: staged(texts.select("text").mapInArrow(_count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")), "counts")}
    for order in range(ORDER - 1, 0, -1):
        counts[order] = staged(counts[order + 1].groupBy((F.col("code") % SIGNS ** order).alias("code")).agg(F.count("*").alias("n")), "counts")
    model: dict[int, tuple[DataFrame, DataFrame]] = {}
    for order in range(1, ORDER + 1):
        d = _discounts(counts[order])
        off = F.get(F.array(*[F.lit(x) for x in d]), F.least(F.col("n"), F.lit(3)).cast("int") - 1)
        rows = counts[order].withColumn("context", F.expr(f"code div {SIGNS}")).withColumn("off", off)
        contexts = rows.groupBy("context").agg(F.sum("n").alias("total"), (F.sum("off") / F.sum("n")).alias("w"))
        rows = rows.join(contexts, "context")
        if order == 1:
            below = F.lit(1.0 / SIGNS)
        else:
            lower = model[order - 1][0].select(F.col("code").alias("suffix"), F.exp("logp").alias("below"))
            rows = rows.withColumn("suffix", F.col("code") % SIGNS ** (order - 1)).join(lower, "suffix")
            below = F.col("below")
        p = (F.col("n") - F.col("off")) / F.col("total") + F.col("w") * below
        model[order] = (staged(rows.select("code", F.log(p).alias("logp")), "ngrams"),
                        staged(contexts.select("context", F.log("w").alias("logw")), "contexts"))
    return model


class CodeTable:
    """Values by code: open addressing over arrays, looked up for many codes at once."""

    def __init__(self, code: np.ndarray, value: np.ndarray):
        self.bits = max(4, int(2 * len(code)).bit_length())
        self.code = np.full(1 << self.bits, -1, np.int64)
        self.value = np.zeros(1 << self.bits)
        slot, left = self._slot(code), np.arange(len(code))
        while len(left):
            free = self.code[slot[left]] < 0
            self.code[slot[left[free]]] = code[left[free]]  # of those that meet, one stays
            placed = self.code[slot[left]] == code[left]
            self.value[slot[left[placed]]] = value[left[placed]]
            left = left[~placed]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, code: np.ndarray) -> np.ndarray:
        return ((code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values, 0 where there is none; whether there is one)."""
        slot = self._slot(code)
        at = self.code[slot]
        found = at == code
        value = np.where(found, self.value[slot], 0.0)
        open_ = np.flatnonzero(~found & (at >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            at = self.code[slot[open_]]
            hit = at == code[open_]
            value[open_[hit]] = self.value[slot[open_[hit]]]
            found[open_[hit]] = True
            open_ = open_[~hit & (at >= 0)]
        return value, found


def log_probabilities(code: np.ndarray, tables: dict[int, tuple[CodeTable, CodeTable]]) -> np.ndarray:
    """Log probability of the last symbol of each n-gram, given the others."""
    out, left = np.zeros(len(code)), np.arange(len(code))
    for order in range(ORDER, 0, -1):
        ngrams, contexts = tables[order]
        tail = code[left] % SIGNS ** order
        value, found = ngrams.find(tail)
        out[left] += value
        missing = ~found
        left = left[missing]
        if not len(left):
            return out
        out[left] += contexts.find(tail[missing] // SIGNS)[0]
    out[left] -= math.log(SIGNS)
    return out


def _score(shared, kept: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = {n: (CodeTable(*a), CodeTable(*b)) for n, (a, b) in shared.value.items()}
        for batch in batches:
            texts = [t.as_py() or b"" for t in batch.column(batch.schema.get_field_index("text")).cast(pa.binary())]
            sums = [0.0] * len(texts)
            small: list[int] = []

            def flush():
                if small:
                    symbols, first = _symbols([texts[i] for i in small])
                    total = np.concatenate(([0.0], np.cumsum(log_probabilities(codes(symbols), tables))))
                    first = first - ORDER + 1  # codes begin ORDER - 1 symbols later
                    for i, f in zip(small, first):
                        sums[i] = float(total[f + len(texts[i])] - total[f])
                    small.clear()

            size = 0
            for i, text in enumerate(texts):
                if len(text) > _CHUNK:
                    sums[i] = float(sum(log_probabilities(c, tables).sum() for c in piece_codes(text)))
                elif text:
                    small.append(i)
                    size += len(text)
                    if size > _CHUNK:
                        flush()
                        size = 0
            flush()
            own = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*own, pa.array([len(t) for t in texts], pa.int64()), pa.array(sums)],
                                             names=[*kept, "n_bytes", "logp"])
    return run


_GRAMS = pa.schema([("r1", pa.int64()), ("r2", pa.int64()), ("code", pa.int64()), ("n", pa.int64())])


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r1, r2, text in zip(batch.column(0), batch.column(1), batch.column(2).cast(pa.binary())):
            for got in piece_codes(text.as_py() or b""):
                code, n = np.unique(got, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(code), r1.as_py())), pa.array(np.full(len(code), r2.as_py())), pa.array(code), pa.array(n.astype(np.int64))], schema=_GRAMS)


def _score_by_joins(texts: DataFrame, model: dict[int, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """(r1, r2, n_bytes, logp) of ``texts`` (r1, r2, text); rows of the same numbers are summed up."""
    grams = texts.mapInArrow(_grams, "r1 long, r2 long, code long, n long")
    seen = grams.select("code").distinct()
    value: Column = F.lit(-math.log(SIGNS))
    for order in range(1, ORDER + 1):
        ngrams, contexts = model[order]
        tail = F.col("code") % SIGNS ** order
        seen = (seen.withColumns({f"g{order}": tail, f"h{order}": F.floor(tail / SIGNS).cast("long")})
                .join(ngrams.toDF(f"g{order}", f"p{order}"), f"g{order}", "left").join(contexts.toDF(f"h{order}", f"w{order}"), f"h{order}", "left"))
        value = F.coalesce(F.col(f"p{order}"), F.coalesce(F.col(f"w{order}"), F.lit(0.0)) + value)
    seen = seen.select("code", value.alias("logp"))
    return grams.join(seen, "code").groupBy("r1", "r2").agg(F.sum("n").alias("n_bytes"), F.sum(F.col("n") * F.col("logp")).alias("logp"))


def score(rows: DataFrame, model: dict[int, tuple[DataFrame, DataFrame]], max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``rows`` with n_bytes and logp in place of text. A row's values depend on its text alone: they are
    found in one pass over the rows, or joined by two hashes of the text, never by numbers of rows."""
    kept = [c for c in rows.columns if c != "text"]
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "text")
    if sum(df.count() for pair in model.values() for df in pair) * 16 > max_bytes:
        keys = [F.xxhash64("text").alias("r1"), F.xxhash64(F.lit(1), F.col("text")).alias("r2")]
        found = _score_by_joins(rows.where("octet_length(text) > 0").select(*keys, "text"), model)
        found = found.select("r1", "r2", (F.col("logp") / F.col("n_bytes")).alias("each"))  # copies add up to the same
        size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
        return rows.select(*kept, size, *keys).join(found, ["r1", "r2"], "left").select(
            *kept, "n_bytes", (F.coalesce("each", F.lit(0.0)) * F.col("n_bytes")).alias("logp"))

    def held(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        got = df.toPandas()
        return got.iloc[:, 0].to_numpy(np.int64), got.iloc[:, 1].to_numpy(np.float64)
    shared = rows.sparkSession.sparkContext.broadcast({n: (held(a), held(b)) for n, (a, b) in model.items()})
    return rows.select(*kept, "text").mapInArrow(_score(shared, kept), f"{own}, n_bytes long, logp double")


def judge_quality(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, lang): doc_id, lang, n_bytes, trusted, perplexity, threshold,
    kept. ``labels`` (doc_id, quality): documents whose labels are all 1 are trusted."""
    good = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1").select("doc_id")
    good = staged(good, "trusted")
    if small_enough(good, max_bytes, 16):
        good = F.broadcast(good)
    docs = docs.select("doc_id", "lang", F.col("text").cast("string").alias("text"))
    learns = F.pmod(F.xxhash64("doc_id"), F.lit(HELD_OUT)) != 0
    model = train(docs.join(good.where(learns), "doc_id", "left_semi"))
    about = docs.join(good.withColumn("trusted", F.lit(True)), "doc_id", "left")
    about = about.select("doc_id", "lang", F.coalesce("trusted", F.lit(False)).alias("trusted"), "text")
    rows = score(about, model, max_bytes).select(
        "doc_id", "lang", "n_bytes", "trusted", F.when(F.col("n_bytes") > 0, F.exp(-F.col("logp") / F.col("n_bytes"))).alias("perplexity"))
    rows = staged(rows, "perplexity")
    # A model finds the texts that it learnt from too easy: thresholds come from trusted ones that it hasn't seen.
    trusted = rows.where(F.col("trusted") & F.col("perplexity").isNotNull() & ~learns)
    # Few held-out texts have no such quantile among them; a normal law of the logarithms tells where it lies.
    log, z = F.log("perplexity"), NormalDist().inv_cdf(quantile)
    cut = lambda: F.greatest(F.percentile_approx("perplexity", quantile, 10_000),
                             F.exp(F.avg(log) + z * F.coalesce(F.stddev(log), F.lit(0.0))))
    by_lang = trusted.groupBy("lang").agg(cut().alias("own")).withColumnRenamed("lang", "name")
    every = trusted.agg(cut()).first()[0]
    return (rows.join(by_lang, F.col("lang").eqNullSafe(F.col("name")), "left")
            .withColumn("threshold", F.coalesce("own", F.lit(every).cast("double")))
            .select("doc_id", "lang", "n_bytes", "trusted", "perplexity", "threshold",
                    ((F.col("n_bytes") > 0) & F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True))).alias("kept")))
