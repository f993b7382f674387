"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

Inputs are words: a learned vector of the word (of the sample's most widespread ones) plus those of
its hashed character n-grams. Two gated recurrent units read a window of ``WINDOW`` words forwards
and backwards; attention pools their states to one logit. A document's score is that of its highest
window, over all overlapping windows of the whole text, shifted so that 0.5 best splits the sample.
Only ASCII signs part words. A longer run than ``LONGEST`` bytes (scripts without spaces) is cut into
pieces of ``RUN`` signs that share ``RUN_OVERLAP``, so none of its n-grams is lost; each piece is a word.

The network learns from a bounded sample of labelled rows (``SAMPLE`` of either label at most, by a hash
of the id, texts of up to ``SAMPLE_BYTES``) outside the held-out fifth. Labels are of documents, so in
each round a toxic document teaches by its highest window, others by their highest and a random one.
Vectors start from the sample's log odds. Neither language, source nor id is an input of a score.

Defined results: null, empty and wordless texts score 0; a sample without both labels: all score 0; rows without
id are not held out; each row gives a row. Other columns are kept by ``with_scores``, but
for one named score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retailcast.llm.words import give_back, kgram_hashes, normal, word_spans

#: Bounds of the sample to learn from, for each label.
SAMPLE = 1_500
SAMPLE_BYTES = 20_000
FOLDS = 5
WINDOW, STRIDE = 48, 40
VOCABULARY, BUCKET_BITS = 4_096, 13
#: Bytes up to which a word stays whole; signs of the pieces of longer ones, and signs that two pieces share.
LONGEST, RUN, RUN_OVERLAP = 64, 6, 3
BUCKETS = 1 << BUCKET_BITS
WIDTH, HIDDEN, ATTENTION = 16, 8, 8
ROUNDS, STEPS, BATCH, RATE = 5, 160, 128, 0.01
CACHE_WORDS, VECTOR_WORDS, PIECE, PIECE_BYTES = 100_000, 1 << 12, STRIDE * 4_000, 1 << 18
#: Texts of a batch that are Python objects at once.
SLICE = 1_000
_SIGNS = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: str | None) -> bytes:
    """The lower-cased words, joined by one space; long runs as their pieces."""
    joined = normal((text or "").lower().encode("utf-8", "replace"), _SIGNS)
    if len(joined) > LONGEST and int(np.subtract(*word_spans(joined)[::-1]).max()) > LONGEST:
        return b" ".join(w if len(w) <= LONGEST else _cut(w) for w in joined.split())
    return joined


def _cut(run: bytes) -> bytes:
    """The overlapping pieces of a long run, joined by one space."""
    signs = run.decode("utf-8")
    return " ".join(signs[i:i + RUN] for i in range(0, max(len(signs) - RUN_OVERLAP, 1), RUN - RUN_OVERLAP)).encode("utf-8")


def ngram_ids(some: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts): the hashed character n-grams of 3 and 4 signs of each word, word ends marked."""
    signs = np.frombuffer((b"^" + b"$^".join(some) + b"$").decode("utf-8", "ignore").encode("utf-32-le"), "<u4").astype(np.uint64)
    ends = np.flatnonzero(signs == ord("$"))
    sizes = np.diff(ends, prepend=-1)
    left = np.repeat(ends + 1, sizes) - np.arange(len(signs))  # signs to the word's end
    out = np.full((len(signs), 2), -1, np.int64)
    for k, n in enumerate((3, 4)):
        h = np.zeros(max(len(signs) - n + 1, 0), np.uint64)
        for i in range(n):
            h = h * np.uint64(1_000_003) + signs[i:len(signs) - n + 1 + i]
        h = (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BUCKET_BITS)
        out[:len(h), k] = np.where(left[:len(h)] >= n, h.astype(np.int64), -1)
    flat = out.ravel()
    return flat[flat >= 0], np.maximum(sizes - 2, 0) + np.maximum(sizes - 3, 0)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _summed(index: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of ``rows`` by their ``index`` below n."""
    out = np.zeros((n, rows.shape[1]), rows.dtype)
    if len(index):
        order = np.argsort(index, kind="stable")
        index = index[order]
        starts = np.flatnonzero(np.concatenate(([True], index[1:] != index[:-1])))
        out[index[starts]] = np.add.reduceat(rows[order], starts, axis=0)
    return out


def gru(p: np.ndarray, u: np.ndarray, mask: np.ndarray, keep: bool = False):
    """States (T, 2, B, H) of two gated recurrent units, one for each direction. p (T, 2, B, 3H): inputs
    times weights, for update, reset and candidate; mask (T, 2, B, 1). keep: also what ``gru_back`` needs."""
    steps, _, n, h3 = p.shape
    size = h3 // 3
    h = np.zeros((2, n, size), p.dtype)
    out, kept = np.empty((steps, 2, n, size), p.dtype), []
    whole = mask.all()
    for t in range(steps):
        g = h @ u
        zr = _sigmoid(p[t, :, :, :2 * size] + g[:, :, :2 * size])
        z, r = zr[:, :, :size], zr[:, :, size:]
        c = np.tanh(p[t, :, :, 2 * size:] + r * g[:, :, 2 * size:])
        if keep:
            kept.append((h, z, r, c, g[:, :, 2 * size:]))
        new = c + z * (h - c)
        h = new if whole else np.where(mask[t], new, h)
        out[t] = h
    return (out, kept) if keep else out


def gru_back(dout: np.ndarray, kept: list, u: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of p and u for the gradient of the states."""
    steps, _, n, size = dout.shape
    dp, du, dh = np.zeros((steps, 2, n, 3 * size), dout.dtype), np.zeros_like(u), np.zeros((2, n, size), dout.dtype)
    back = u.transpose(0, 2, 1)
    for t in range(steps - 1, -1, -1):
        h, z, r, c, gc = kept[t]
        dh = dh + dout[t]
        d = dh * mask[t]
        dc = d * (1 - z) * (1 - c * c)
        dz = d * (h - c) * z * (1 - z)
        dr = dc * gc * r * (1 - r)
        dp[t] = np.concatenate((dz, dr, dc), 2)
        dg = np.concatenate((dz, dr, dc * r), 2)
        du += h.transpose(0, 2, 1) @ dg
        dh = dh * ~mask[t] + d * z + dg @ back
    return dp, du


class Network:
    """Weights, by name, and the words of the vocabulary."""

    def __init__(self, vocabulary: list[bytes], seed: int = 5):
        rng = np.random.default_rng(seed)
        f = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[-2]), shape).astype(np.float32)
        self.number = {w: i + 1 for i, w in enumerate(vocabulary)}
        self.w = {"word": 0.1 * rng.normal(0, 1, (len(vocabulary) + 1, WIDTH)).astype(np.float32),
                  "gram": 0.1 * rng.normal(0, 1, (BUCKETS, WIDTH)).astype(np.float32),
                  "in": f(2, WIDTH, 3 * HIDDEN), "b": np.zeros((2, 1, 3 * HIDDEN), np.float32), "u": f(2, HIDDEN, 3 * HIDDEN),
                  "wa": f(2 * HIDDEN, ATTENTION), "va": f(ATTENTION, 1)[:, 0], "out": f(2 * HIDDEN, 1)[:, 0], "bias": np.zeros(1, np.float32)}
        self.shift = 0.0

    def vectors(self, some: list[bytes]) -> np.ndarray:
        if len(some) > VECTOR_WORDS:
            return np.concatenate([self.vectors(some[i:i + VECTOR_WORDS]) for i in range(0, len(some), VECTOR_WORDS)])
        flat, counts = ngram_ids(some)
        sums = np.add.reduceat(self.w["gram"][flat], np.cumsum(counts) - counts, axis=0)
        own = np.fromiter((self.number.get(w, 0) for w in some), np.int64, len(some))
        return self.w["word"][own] + sums / np.sqrt(counts, dtype=np.float32)[:, None]

    def projected(self, vectors: np.ndarray) -> np.ndarray:
        """Inputs (2, n, 3H) of both units for n word vectors."""
        return vectors @ self.w["in"] + self.w["b"]

    def pooled(self, states: np.ndarray, mask: np.ndarray):
        """Attention over the states (T, B, 2H)."""
        a = np.tanh(states @ self.w["wa"])
        s = np.where(mask, a @ self.w["va"], np.float32(-1e9))
        e = np.exp(s - s.max(0)) * mask
        share = e / np.maximum(e.sum(0), np.float32(1e-9))
        return a, share, np.einsum("tb,tbh->bh", share, states)

    def logits(self, projected: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Of windows of word numbers (T, B), -1 where there is none."""
        mask = ids >= 0
        p = np.stack((projected[0][ids], projected[1][ids[::-1]]), 1)
        out = gru(p, self.w["u"], np.stack((mask, mask[::-1]), 1)[..., None])
        return self.pooled(np.concatenate((out[:, 0], out[::-1, 1]), 2), mask)[2] @ self.w["out"] + self.w["bias"][0]

    def learn(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients of the weighted log loss of windows of word vectors (T, B, WIDTH); and that of x."""
        w = self.w
        both = np.stack((x, x[::-1]), 1)
        masks = np.stack((mask, mask[::-1]), 1)[..., None]
        out, kept = gru(both @ w["in"] + w["b"], w["u"], masks, True)
        states = np.concatenate((out[:, 0], out[::-1, 1]), 2)
        a, share, c = self.pooled(states, mask)
        d = ((_sigmoid(c @ w["out"] + w["bias"][0]) - y) * weight / weight.sum()).astype(np.float32)
        g = {"out": c.T @ d, "bias": d.sum(keepdims=True)}
        dc = d[:, None] * w["out"]
        dshare = np.einsum("tbh,bh->tb", states, dc)
        ds = share * (dshare - (share * dshare).sum(0))
        da = ds[:, :, None] * w["va"] * (1 - a * a)
        flat = lambda v: v.reshape(-1, v.shape[-1])
        g["va"], g["wa"] = flat(a).T @ ds.ravel(), flat(states).T @ flat(da)
        dstates = share[:, :, None] * dc + da @ w["wa"].T
        dp, g["u"] = gru_back(np.stack((dstates[:, :, :HIDDEN], dstates[::-1, :, HIDDEN:]), 1), kept, w["u"], masks)
        g["in"] = np.stack([flat(both[:, k]).T @ flat(dp[:, k]) for k in (0, 1)])
        g["b"] = dp.sum((0, 2))[:, None]
        dx = dp @ w["in"].transpose(0, 2, 1)
        return g, dx[:, 0] + dx[::-1, 1]


def window_starts(n: int) -> list[int]:
    """Starts of the overlapping windows that cover n words."""
    return list(range(0, max(n - WINDOW, 0) + STRIDE, STRIDE)) if n > WINDOW else [0] * (n > 0)


def _windows(numbers: np.ndarray) -> np.ndarray:
    """Rows of WINDOW word numbers, filled up with -1."""
    starts = window_starts(len(numbers))
    padded = np.full((starts[-1] if starts else 0) + WINDOW, -1, np.int64)
    padded[:len(numbers)] = numbers
    return np.stack([padded[s:s + WINDOW] for s in starts]) if starts else np.zeros((0, WINDOW), np.int64)


def _window_logits(net: Network, projected: np.ndarray, rows: np.ndarray, size: int = 512) -> np.ndarray:
    out = [net.logits(projected, rows[i:i + size].T) for i in range(0, len(rows), size)]
    return np.concatenate(out) if out else np.zeros(0, np.float32)


def _numbered(texts: list[str]) -> tuple[list[np.ndarray], list[bytes]]:
    """The texts as numbers of words, and the words in order."""
    number: dict[bytes, int] = {}
    split = [np.fromiter((number.setdefault(w, len(number)) for w in words(t).split()), np.int64) for t in texts]
    in_order = sorted(number)
    rank = np.zeros(len(number), np.int64)
    rank[[number[w] for w in in_order]] = np.arange(len(number))
    return [rank[ws] for ws in split], in_order


def train(texts: list[str], toxic: list[int], seed: int = 5) -> Network | None:
    """The network for a sample of texts with labels 0 and 1; None if it lacks one of them, or any word."""
    y = np.array(toxic, np.float32)
    if not 0 < y.sum() < len(y):
        return None
    rng = np.random.default_rng(seed)
    split, all_words = _numbered(texts)
    if not all_words:
        return None
    spread = np.bincount(np.concatenate([np.unique(ws) for ws in split]), minlength=len(all_words))
    odds = np.bincount(np.concatenate([np.unique(ws) for ws, label in zip(split, y) if label]), minlength=len(all_words))
    top_words = np.argsort(-spread, kind="stable")[:VOCABULARY]
    net = Network([all_words[w] for w in top_words], seed)

    # In parts, as the n-grams of a whole vocabulary at once take many times their own memory.
    parts = [ngram_ids(all_words[i:i + VECTOR_WORDS]) for i in range(0, len(all_words), VECTOR_WORDS)]
    flat, counts = (np.concatenate(x) for x in zip(*parts))
    ends = np.cumsum(counts)
    grams = lambda w: flat[ends[w] - counts[w]:ends[w]]
    owner, scale = np.repeat(np.arange(len(counts)), counts), np.sqrt(counts, dtype=np.float32)
    word_row = np.array([net.number.get(w, 0) for w in all_words])
    del parts, all_words
    # Log odds by documents, smoothed, as the first guess of one dimension.
    prior = y.sum() / len(y)

    def log_odds(hit: np.ndarray, all_: np.ndarray) -> np.ndarray:
        return np.clip(np.log((hit + prior) / (all_ + 1) / prior) - np.log((all_ - hit + 1 - prior) / (all_ + 1) / (1 - prior)), -4, 4)
    net.w["word"][1:, 0] = log_odds(odds[top_words], spread[top_words]) / 2
    per_gram = np.zeros((2, BUCKETS))
    for ws, label in zip(split, y):
        seen = np.unique(np.concatenate([grams(w) for w in np.unique(ws)])) if len(ws) else np.zeros(0, np.int64)
        per_gram[:, seen] += [[float(label)], [1.0]]
    net.w["gram"][:, 0] = log_odds(per_gram[0], per_gram[1]) / 2

    used = [i for i, ws in enumerate(split) if len(ws)]
    n_rows = {i: len(window_starts(len(split[i]))) for i in used}
    rows, doc_of = np.concatenate([_windows(split[i]) for i in used]), np.repeat(used, list(n_rows.values()))
    first = dict(zip(used, np.cumsum([0, *n_rows.values()])))

    def vectors() -> np.ndarray:
        sums = np.zeros((len(counts), WIDTH), np.float32)
        for k in range(WIDTH):
            sums[:, k] = np.bincount(owner, net.w["gram"][flat, k], len(counts))
        return net.w["word"][word_row] + sums / scale[:, None]

    mean, square = {k: np.zeros_like(v) for k, v in net.w.items()}, {k: np.zeros_like(v) for k, v in net.w.items()}
    step = 0
    pos, neg = [i for i in used if y[i]], [i for i in used if not y[i]]
    first_guess = vectors()[:, 0]
    level = np.where(rows >= 0, first_guess[rows], -9).max(1)
    rounds = max(ROUNDS, -(-STEPS * BATCH // (len(pos) + 2 * len(neg))))
    for turn in range(rounds):
        if turn and turn % -(-rounds // 3) == 0:
            level = _window_logits(net, net.projected(vectors()), rows)
        top = {i: first[i] + int(np.argmax(level[first[i]:first[i] + n_rows[i]])) for i in used}
        picked = [(top[i], 1.0) for i in pos] + [(top[i], 0.0) for i in neg] + [(first[i] + int(rng.integers(n_rows[i])), 0.0) for i in neg]
        order = rng.permutation(len(picked))
        balance = len(neg) * 2 / max(len(pos), 1)
        for b in range(0, len(order), BATCH):
            some = [picked[j] for j in order[b:b + BATCH]]
            ids, labels = rows[[r for r, _ in some]].T, np.array([v for _, v in some], np.float32)
            mask = ids >= 0
            distinct, at = np.unique(ids, return_inverse=True)
            at = at.reshape(ids.shape)
            some_grams = [grams(w) for w in distinct if w >= 0]
            own = np.repeat(np.flatnonzero(distinct >= 0), [len(x) for x in some_grams])
            cat, root = np.concatenate(some_grams), np.where(distinct >= 0, scale[distinct], 1)[:, None]
            word_at = np.where(distinct >= 0, word_row[distinct], 0)
            mixed = net.w["word"][word_at] + _summed(own, net.w["gram"][cat], len(distinct)) / root
            g, dx = net.learn(mixed[at], mask, labels, np.where(labels > 0, np.float32(min(balance, 4)), np.float32(1)))
            dword = _summed(at[mask], dx[mask], len(distinct))
            g["word"], g["gram"] = _summed(word_at, dword, len(net.w["word"])), _summed(cat, (dword / root)[own], BUCKETS)
            step += 1
            for k, v in g.items():
                mean[k] = 0.9 * mean[k] + 0.1 * v
                square[k] = 0.99 * square[k] + 0.01 * v * v
                net.w[k] -= (RATE * (mean[k] / (1 - 0.9 ** step)) / (np.sqrt(square[k] / (1 - 0.99 ** step)) + 1e-8)).astype(np.float32)
    level = _window_logits(net, net.projected(vectors()), rows)
    best = np.full(len(y), -np.inf)
    np.maximum.at(best, doc_of, level)
    net.shift = _split(best[used], y[used])
    return net


def _split(logits: np.ndarray, y: np.ndarray) -> float:
    """Two thirds up the widest gap at which the fewest labels are wrong: clean texts are the many."""
    order = np.argsort(logits, kind="stable")
    s, lab = logits[order], y[order]
    wrong = np.concatenate(([0], np.cumsum(lab))) + np.concatenate((np.cumsum((1 - lab)[::-1])[::-1], [0]))
    best = np.flatnonzero(wrong == wrong.min())
    edge = np.concatenate(([s[0] - 1], s, [s[-1] + 1]))
    widths = edge[best + 1] - edge[best]
    at = best[int(np.argmax(widths))]
    return float(edge[at] + (edge[at + 1] - edge[at]) * 2 / 3)


class Scorer:
    """Scores texts; keeps the projected inputs of words that it has met, by their hash."""

    def __init__(self, net: Network | None):
        self.net, self.row, self.known = net, {}, np.zeros((2, 1024, 3 * HIDDEN), np.float32)

    def _numbers(self, joined: bytes) -> np.ndarray:
        """Rows of ``known`` for the words."""
        start, end = word_spans(joined)
        hashes, first, at = np.unique(kgram_hashes(joined, start, end, 1), return_index=True, return_inverse=True)
        hashes = hashes.tolist()
        rows = np.fromiter((self.row.get(h, -1) for h in hashes), np.int64, len(hashes))
        new = np.flatnonzero(rows < 0)
        if len(new):
            had, need = len(self.row), len(self.row) + len(new)
            if need > self.known.shape[1]:
                more = np.zeros((2, max(need - self.known.shape[1], self.known.shape[1]), 3 * HIDDEN), np.float32)
                self.known = np.concatenate((self.known, more), 1)
            self.known[:, had:need] = self.net.projected(self.net.vectors([joined[start[i]:end[i]] for i in first[new].tolist()]))
            rows[new] = np.arange(had, need)
            self.row.update((hashes[i], n) for i, n in zip(new.tolist(), range(had, need)))
        return rows[at]

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        out = np.full(len(texts), -np.inf)
        if self.net is None:
            return np.zeros(len(texts))
        held: list[tuple[int, bytes]] = []

        def flush():
            if not held:
                return
            sizes = [ws.count(b" ") + 1 for _, ws in held]
            rows = [_windows(x) for x in np.split(self._numbers(b" ".join(ws for _, ws in held)), np.cumsum(sizes)[:-1])]
            level = _window_logits(self.net, self.known, np.concatenate(rows))
            np.maximum.at(out, np.repeat([i for i, _ in held], [len(x) for x in rows]), level)
            held.clear()
            if len(self.row) > CACHE_WORDS:
                self.row = {}

        size = 0
        for i, text in enumerate(texts):
            ws = words(text)
            for piece in _pieces(ws) if ws else ():
                held.append((i, piece))
                size += len(piece)
                if size >= PIECE_BYTES:
                    flush()
                    size = 0
        flush()
        return np.where(np.isfinite(out), _sigmoid(out - self.net.shift), 0.0)


def _pieces(ws: bytes) -> Iterator[bytes]:
    """Very long texts in pieces that share a window's overlap."""
    if len(ws) < PIECE_BYTES:
        yield ws
        return
    start, end = word_spans(ws)
    for at in range(0, max(len(start) - (WINDOW - STRIDE), 1), PIECE):
        yield ws[start[at]:end[min(at + PIECE + WINDOW - STRIDE, len(end)) - 1]]


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Network | None:
    """The network, from a bounded sample of ``labels`` (doc_id, toxic) outside the held-out fold."""
    known = (labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
             .where(~held_out(F.col("doc_id"))).withColumn("h", F.xxhash64(F.lit(1), "doc_id")))
    picked = [r for value in (0, 1) for r in known.where(F.col("toxic") == value).orderBy("h", "doc_id").limit(sample).collect()]
    if not picked:
        return None
    ids = docs.sparkSession.createDataFrame([(r["doc_id"], r["toxic"]) for r in picked], "doc_id long, toxic int")
    rows = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.octet_length("text") <= SAMPLE_BYTES)
            .join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")).collect())
    rows.sort(key=lambda r: r["doc_id"])
    net = train([r["text"] for r in rows], [r["toxic"] for r in rows])
    give_back()
    return net


def with_scores(docs: DataFrame, net: Network | None) -> DataFrame:
    """``docs`` with a column score, for its column text."""
    shared = docs.sparkSession.sparkContext.broadcast(net)
    docs = docs.drop("score")
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())])
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)  # for one task: later jobs in this worker need its memory
        for batch in batches:
            texts = batch.column(at)
            scores = np.concatenate([scorer(texts[c:c + SLICE].to_pylist()) for c in range(0, len(texts), SLICE)]) if len(texts) else []
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, "score"])
        del scorer
        give_back()
    return docs.mapInArrow(run, schema)


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""
    scored = with_scores(docs.select("doc_id", F.col("text").cast("string").alias("text")), fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
