"""Exact token counts at every prefix of a text, for a byte-level BPE vocabulary.

Pieces of the pre-tokenizer's pattern are encoded apart. Within a piece a dynamic program over its
bytes finds, for each prefix, the one token that can end its encoding: the longest vocabulary entry
that may follow the last token of the shorter prefix (two tokens may stand side by side if encoding
their joined bytes gives just these two). count[i] = count[i - len(token)] + 1. Each distinct
piece is solved once for each Python worker and kept in a cache of bounded size; the new pieces of some
texts are solved in sorted order, so that a prefix that neighbours share is solved once.

Cutting a text may change its pieces near the cut. Where it does (within white space before a word, a
contraction, or a special token), the prefix is counted with the pieces it has itself. Counts are
stored as a binary column of differences, one signed byte (or four, if one doesn't do) for each code
point; ``tokens_in_prefix`` and ``longest_prefix`` answer from it without encoding again.

Defined results: null texts count as empty (0 tokens); ids may be null or repeated, each row gives
a row; texts of any length are counted whole. Other columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Distinct pieces, and pairs of tokens, kept by a worker; pieces longer than this are not kept.
CACHE_ENTRIES = 400_000
CACHED_CHARS = 64
#: Characters of the texts whose pieces are learnt together.
GROUP_CHARS = 4 << 20

# Fixed values of the vocabulary's pre-tokenizer: contractions, letters, digits, other signs, space.
_SPACE, _NO_SPACE = r"\p{White_Space}", r"\P{White_Space}"
_PIECES = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|{_SPACE}+(?!{_NO_SPACE})|{_SPACE}+")
# Each run is looked at once: from its first sign, and never given back.
_RUN_BEFORE_WORD = regex.compile(rf"(?<!{_SPACE}){_SPACE}{{2,}}+(?={_NO_SPACE})")
_TWO_SPACES = re.compile(r"\s\s")  # of every text with such a run, quickly
_LONG_CONTRACTIONS = ("'re", "'ve", "'ll")


def _byte_signs() -> dict[str, int]:
    """The printable stand-ins for bytes in the vocabulary file: printable Latin-1 signs stand for
    themselves, the other bytes for the signs from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class PrefixCounter:
    """Token counts of all prefixes of texts, for the contents of a byte-level BPE .json file."""

    def __init__(self, spec: bytes):
        spec = json.loads(spec)
        signs = _byte_signs()
        raw = lambda s: bytes(signs[c] for c in s)
        self.special = [x["content"] for x in spec["added_tokens"]]
        self._special = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) \
            if self.special else None
        self.vocab = {raw(s) for s in spec["model"]["vocab"] if s not in self.special}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.rank = {(raw(a), raw(b)): i for i, (a, b) in enumerate(pairs)}
        self._merges = len(pairs)
        self.parts = {a + b: (a, b) for a, b in reversed(self.rank)}  # of two ways, the one of lower rank
        self.made = {a + b: i for (a, b), i in reversed(self.rank.items())}
        # A token that plain merging of its own bytes does not give can end no encoding.
        self.tokens = [b"", *sorted(t for t in self.vocab if len(t) == 1 or t in self.parts)]
        self.number = {t: i for i, t in enumerate(self.tokens) if i}
        #: The longest token by its last three bytes; others have two at most.
        self._longest: dict[bytes, int] = {}
        for t in self.number:
            if len(t) > 2:
                self._longest[t[-3:]] = max(len(t), self._longest.get(t[-3:], 0))
        self._pairs: dict[int, bool] = {}
        self._pieces: dict[str, tuple[int, bytes | None, list[int]]] = {}
        self._older: dict[str, tuple[int, bytes | None, list[int]]] = {}

    def encode(self, data: bytes) -> list[bytes]:
        """Plain BPE: the pair of the lowest rank is merged, leftmost first, until none is left."""
        parts = [data[i:i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.rank.get((parts[i], parts[i + 1]), 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _may_follow(self, a: int, b: int) -> bool:
        """Whether token number b may come after token number a (0: the start)."""
        if len(self._pairs) >= CACHE_ENTRIES:
            self._pairs.clear()
        known = self._pairs[a << 32 | b] = self._stays_apart(self.tokens[a], self.tokens[b])
        return known

    def _stays_apart(self, a: bytes, b: bytes) -> bool:
        """Whether no merge joins the two tokens' bytes across their border. Their own merges are
        undone, the latest first; a pair that stood at the border before a merge of rank r would have
        been merged by a lower rank (or an equal one further left)."""
        if not a:
            return True
        before = self._merges + 1
        while True:
            if self.rank.get((a, b), before) < before:
                return False
            made_a, made_b = self.made.get(a, -1), self.made.get(b, -1)
            if made_a < 0 and made_b < 0:
                return True
            if made_a > made_b:
                before, a = made_a, self.parts[a][1]
            else:
                before, b = made_b + 1, self.parts[b][0]

    def byte_counts(self, data: bytes) -> list[int]:
        """count[i]: tokens of the first i bytes, as one piece."""
        count, last = [0], [0]
        self._go_on(data, count, last)
        return count

    def _go_on(self, data: bytes, count: list[int], last: list[int]) -> None:
        """Fill the counts and last tokens of the prefixes of ``data`` from the first one that is not there."""
        number, pairs, longest = self.number.get, self._pairs.get, self._longest.get
        for i in range(len(count), len(data) + 1):
            most = longest(data[i - 3:i], 2) if i > 3 else i
            for j in range(i - most if i > most else 0, i):
                token = number(data[j:i])
                if token:
                    ok = pairs(last[j] << 32 | token)
                    if ok or ok is None and self._may_follow(last[j], token):
                        count.append(count[j] + 1)
                        last.append(token)
                        break
            else:
                raise ValueError(f"no token of the vocabulary ends at byte {i} of {data[:40]!r}")

    def learn(self, pieces: set[str]) -> None:
        """Solve the pieces that aren't kept yet, in the order of their bytes: what a piece shares with the
        one before it is not solved again."""
        new = sorted((p.encode(), p) for p in pieces if len(p) <= CACHED_CHARS and p not in self._pieces and p not in self._older)
        before, count, last = b"", [0], [0]
        for data, piece in new:
            same, most = 0, min(len(before), len(data))
            while same < most and before[same] == data[same]:
                same += 1
            del count[same + 1:], last[same + 1:]
            self._go_on(data, count, last)
            self._keep(piece, self._solved(piece, data, count))
            before = data

    def _keep(self, piece: str, out: tuple[int, bytes | None, list[int]]) -> None:
        if len(self._pieces) >= CACHE_ENTRIES:  # pieces not met again go after a generation
            self._pieces, self._older = {}, self._pieces
        self._pieces[piece] = out

    def _solved(self, piece: str, data: bytes, at: list[int]) -> tuple[int, bytes | None, list[int]]:
        if len(data) != len(piece):  # counts at the ends of code points
            at = [at[i] for i in (0, *(i for i in range(1, len(data)) if data[i] & 0xC0 != 0x80), len(data))]
        if piece in _LONG_CONTRACTIONS:  # cut after its first letter, it is a sign and a word
            at = [*at[:2], self.count("'") + self.count(piece[1]), *at[3:]]
        steps = [b - a for a, b in zip(at, at[1:])]
        fits = min(steps) >= -128 and max(steps) <= 127
        return at[-1], bytes([s & 255 for s in steps]) if fits else None, () if fits else steps

    def _piece(self, piece: str) -> tuple[int, bytes | None, list[int]]:
        """Tokens of a piece, and the differences of the counts of its prefixes by code point."""
        known = self._pieces.get(piece)
        if known:
            return known
        known = self._older.get(piece)
        if known is None:
            data = piece.encode()
            known = self._solved(piece, data, self.byte_counts(data))
        if len(piece) <= CACHED_CHARS:
            self._keep(piece, known)
        return known

    def count(self, text: str) -> int:
        """Tokens of a text without special tokens."""
        return sum(self._piece(p)[0] for p in _PIECES.findall(text))

    def _plain(self, text: str, pieces: list[str] | None = None) -> tuple[int, np.ndarray]:
        known, piece = self._pieces, self._piece
        got = [known.get(p) or piece(p) for p in (_PIECES.findall(text) if pieces is None else pieces)]
        steps = [x[1] for x in got]
        if None in steps:
            steps = np.concatenate([np.frombuffer(x[1], np.int8) if x[1] is not None else np.array(x[2], np.int32) for x in got])
        else:
            steps = np.frombuffer(bytearray(b"".join(steps)), np.int8)
        for m in _RUN_BEFORE_WORD.finditer(text) if _TWO_SPACES.search(text) else ():
            # cut after the run, it is one piece; followed by a word, its last sign is no part of it
            step = self.count(m[0]) - self.count(m[0][:-1])
            if step != steps[m.end() - 1]:
                steps = steps.astype(np.int32)
                steps[m.end()] += steps[m.end() - 1] - step
                steps[m.end() - 1] = step
        return sum([x[0] for x in got]), steps

    def all_steps(self, texts: list[str]) -> Iterator[tuple[int, np.ndarray]]:
        """``steps`` of each text; the pieces that any of them brings are learnt together."""
        split = [None if self._special is not None and self._special.search(t) else _PIECES.findall(t) for t in texts]
        self.learn(set().union(*(s for s in split if s)))
        for text, pieces in zip(texts, split):
            yield self.steps(text) if pieces is None else self._plain(text, pieces)

    def steps(self, text: str) -> tuple[int, np.ndarray]:
        """(tokens, differences): the count of the first n code points is differences[:n].sum()."""
        if self._special is None or not self._special.search(text):
            return self._plain(text)
        total, out, at = 0, [], 0
        for m in [*self._special.finditer(text), None]:
            part = text[at:m.start()] if m else text[at:]
            n, steps = self._plain(part)
            out.append(steps.astype(np.int32))
            total += n
            if m:  # cut within the special token, it is plain text that joins the piece before it
                tail = (_PIECES.findall(part) or [""])[-1]
                before, counts = total - self.count(tail), [total]
                counts += [before + self.count(tail + m[0][:j]) for j in range(1, len(m[0]))] + [total + 1]
                out.append(np.diff(np.array(counts, np.int32)))
                total, at = total + 1, m.end()
        return total, np.concatenate(out)


def pack(steps: np.ndarray) -> bytes:
    if len(steps) and (steps.min() < -128 or steps.max() > 127):
        return b"\x04" + steps.astype("<i4").tobytes()
    return b"\x01" + steps.astype(np.int8).tobytes()


def unpack(data: bytes) -> np.ndarray:
    """Counts of all prefixes, from the empty one on."""
    steps = np.frombuffer(data, np.int8 if data[:1] == b"\x01" else "<i4", offset=1)
    return np.concatenate(([0], np.cumsum(steps, dtype=np.int64)))


_OUT = "doc_id long, n_bytes long, n_chars long, n_tokens long, prefix_counts binary"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_chars", pa.int64()),
                    ("n_tokens", pa.int64()), ("prefix_counts", pa.binary())])
_counters: dict[int, PrefixCounter] = {}


def prefix_token_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_bytes, n_chars, n_tokens and prefix_counts for each row. ``vocabulary`` is the path
    of a byte-level BPE .json file on the driver; its contents (some MB) are broadcast."""
    with open(vocabulary, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counters.get(hash(shared.value))
        if counter is None:
            counter = _counters[hash(shared.value)] = PrefixCounter(shared.value)
        for batch in batches:
            ids, texts, size = [], [], 0
            for k, (doc_id, text) in enumerate(zip(batch.column(0), batch.column(1)), 1):
                ids.append(doc_id.as_py())
                texts.append(text.as_py() or "")
                size += len(texts[-1])
                if size > GROUP_CHARS or k == batch.num_rows:
                    held = [(i, len(t.encode()), len(t), n, pack(steps)) for i, t, (n, steps) in zip(ids, texts, counter.all_steps(texts))]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), _ARROW)], schema=_ARROW)
                    ids, texts, size = [], [], 0

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _OUT)


def _answer(of: Callable[[np.ndarray, int], int]):
    def answers(counts: pd.Series, given: pd.Series) -> pd.Series:
        return pd.Series([of(unpack(c), int(n)) for c, n in zip(counts, given)], dtype="int64")
    return F.pandas_udf(answers, "long")


def tokens_in_prefix(counts: Column, n_chars: Column) -> Column:
    """Tokens of the text cut after ``n_chars`` code points (all, if it has fewer)."""
    return _answer(lambda c, n: int(c[min(max(n, 0), len(c) - 1)]))(counts, n_chars)


def longest_prefix(counts: Column, budget: Column) -> Column:
    """Code points of the longest prefix of at most ``budget`` tokens."""
    return _answer(lambda c, n: int(np.flatnonzero(c <= max(n, 0))[-1]))(counts, budget)
