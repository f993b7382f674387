"""Packing against the tokenizer library, plain sums and a plain packer."""
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from retailcast.llm import packing as pk
from retailcast.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, length string, sequence_id long, ids string, _tie string"


LIBRARY = Tokenizer.from_file(VOCABULARY)


def _library(text):
    return [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 0]


def _check(rows, texts, capacity):
    """Every token of every document is in one place; sequences are gapless. Returns their number."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert {d: len(t) for d, t in texts.items()} == {d: sum(r["piece"] == 0 for r in by_doc[d]) for d in by_doc}
    for doc_id, own in texts.items():
        wanted = []
        for text in own:
            ids = _library(text)
            first = (len(ids) - 1) % capacity + 1
            cuts = [0, *range(first, len(ids), capacity), len(ids)]
            wanted += [(k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
        assert sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in by_doc[doc_id]) == sorted(wanted)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    return len(by_sequence)


def test_query_packs_all_documents_nearly_full(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    rows = QUERIES["op11_pack"](spark, SF).collect()
    n = _check(rows, {d["doc_id"]: [d["text"]] for d in docs}, 2048)
    assert n <= 1.03 * -(-sum(r["length"] for r in rows) // 2048)


def test_odd_rows_and_clashing_columns(spark):
    texts = {1: [None], 2: [""], 3: ["a b"] * 40, None: ["x", "y <|endoftext|> z"], 5: ["  \n\n \t x   y\n "],
             6: ["\u0000\U0001f600 é 'ſ 'LL 're"], 7: [" " * 5000 + "q" * 5000], 8: ["word " * 3000], 9: ["<|endoftext|>"]}
    rows = [(d, t, "no", 7, "no", "no") for d, own in texts.items() for t in own]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    packed = pk.pack(pk.token_pieces(docs, VOCABULARY, 64), 64, range_rows=20)
    _check([r.asDict() for r in packed.drop("ids").collect()], texts, 64)
    whole = pk.sequences(packed).collect()
    assert sum(len(r["ids"]) // 4 for r in whole) == sum(len(_library(t)) for own in texts.values() for t in own)
    for r in whole:
        assert len(r["ids"]) == 4 * r["length"] and sum(d["offset"] == 0 for d in r["documents"]) == 1
    assert pk.pack(pk.token_pieces(docs.limit(0), VOCABULARY)).collect() == []


def test_reruns_agree_whatever_the_partitions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = [sorted(map(tuple, pk.pack(pk.token_pieces(docs.repartition(n), VOCABULARY, 256, with_ids=False), 256).collect())) for n in (1, 7)]
    assert got[0] == got[1]


def _lower_bound(counts, capacity):
    return -(-sum(k * n for k, n in counts.items()) // capacity)


@pytest.mark.parametrize("shape", ["even", "short", "one", "halves", "few"])
def test_plan_places_each_piece_once(shape):
    rng = np.random.default_rng(3)
    capacity = 512
    lengths = {"even": rng.integers(1, 513, 40_000), "short": 1 + rng.geometric(0.05, 40_000).clip(0, 500), "one": np.full(30_000, 200),
               "halves": rng.choice([255, 256, 257, 170, 171], 9_000), "few": rng.integers(1, 513, 20)}[shape]
    counts = {int(k): int(n) for k, n in zip(*np.unique(lengths, return_counts=True))}
    rows = pk.plan(counts, capacity)
    seen = {}
    filled = {}
    for length, first, beyond, sequence, offset in sorted(rows):
        assert seen.get(length, 0) == first < beyond
        seen[length] = beyond
        for s in range(sequence, sequence + beyond - first):
            filled.setdefault(s, []).append((offset, length))
    assert seen == counts
    for own in filled.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and sum(own[-1]) <= capacity
    assert sorted(filled) == list(range(len(filled)))
    bound = -(-30_000 // 2) if shape == "one" else _lower_bound(counts, capacity)
    assert len(filled) <= 1.01 * bound + 3


def test_fit_matches_a_plain_solver():
    """The least squares' conditions: no slope upwards at 0, none at all above 0."""
    rng = np.random.default_rng(5)
    histogram = np.concatenate([[0], rng.integers(0, 30, 48)]).astype(float)
    histogram[-1] = 0
    found = pk.patterns(histogram)
    assert all(sum(p) == 48 for p in found.tolist()) and len({tuple(p) for p in found.tolist()}) == len(found)
    x = pk.fit_repeats(found, histogram)
    weight = np.arange(49) / 48
    used = sum(np.bincount(found[:, j], weights=x, minlength=49) for j in range(3))
    used[0] = 0
    slope = (weight ** 2 * (histogram - used))[found]
    slope = np.where(found > 0, slope, 0).sum(1)
    assert (x >= 0).all() and abs(slope[x > 0]).max() < 1e-2 * histogram.max() and slope.max() < 1e-2 * histogram.max()
    assert pk.fit_repeats(found[:0], histogram).tolist() == []


def test_other_vocabularies_go_by_the_library():
    other = public_tokenizers.path("word_bpe_49k.json")
    encoder = pk.Encoder(open(other, "rb").read())
    assert encoder.fast is None
    text = "Some words, some <|endoftext|> more."
    assert encoder.ids(text).tolist() == Tokenizer.from_file(other).encode(text, add_special_tokens=False).ids
    assert pk.Encoder(open(VOCABULARY, "rb").read()).fast is not None
