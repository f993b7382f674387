import time

import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from retailcast.llm.token_counts import PrefixCounter, longest_prefix, pack, prefix_token_counts, tokens_in_prefix, unpack

PATH = P.path("byte_bpe_50k.json")
TOKENIZER = Tokenizer.from_file(PATH)
with open(PATH, "rb") as f:
    COUNTER = PrefixCounter(f.read())


def count(text):
    return len(TOKENIZER.encode(text, add_special_tokens=False).ids)


TEXTS = ["", "a", "Hello world, it's we're they've I'll o'clock 'r 'r're", "  two  spaces\n\n\nlines \t tab", "x\n\n y", "a   ", "   ", "\n \n b",
         "née naïve Straße 日本語 🎉🎉 é", "====================== ------- !!!!\n", "12345 3.14 1,000", "<|endoftext|>", "hi<|endoftext|>there",
         "a  <|endoftext|>  b!!<|endoftext|><|endoftext|>", "<|endof text", "'s't're 'llama'", "\x1c\x1d a b　c", "thisisaverylongwordwithoutspaces" * 3]


@pytest.mark.parametrize("text", TEXTS)
def test_every_prefix(text):
    n, steps = COUNTER.steps(text)
    assert unpack(pack(steps)).tolist() == [count(text[:i]) for i in range(len(text) + 1)]
    assert n == count(text)


def test_pieces_learnt_together_are_the_same():
    with open(PATH, "rb") as f:
        counter = PrefixCounter(f.read())
    texts = TEXTS + ["the then them theme themes", "née néen né", "x" * 200, "'re 'll"]
    for text, (n, steps) in zip(texts, counter.all_steps(texts)):
        assert n == count(text) and unpack(pack(steps)).tolist() == [count(text[:i]) for i in range(len(text) + 1)]
    assert list(counter.all_steps([])) == []


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab' \n\tstrelvé!1<|endoftxt>", max_size=40))
def test_every_prefix_of_random_texts(text):
    n, steps = COUNTER.steps(text)
    assert unpack(pack(steps)).tolist() == [count(text[:i]) for i in range(len(text) + 1)]


def test_column_answers_and_odd_rows(spark):
    texts = [(1, "one two three four"), (2, None), (3, ""), (None, "x"), (1, "one two three four"), (4, "long words " * 20_000)]
    df = spark.createDataFrame([(*t, 9) for t in texts], "doc_id long, text string, n_tokens int")
    got = prefix_token_counts(df, PATH)
    rows = sorted((r.doc_id or 0, r.n_bytes, r.n_tokens) for r in got.collect())
    assert rows == sorted((i or 0, len((t or "").encode()), count(t or "")) for i, t in texts)
    one = got.where("doc_id = 1").select(tokens_in_prefix(F.col("prefix_counts"), F.lit(9)).alias("a"), longest_prefix(F.col("prefix_counts"), F.lit(2)).alias("b")).first()
    assert one.a == count("one two t") and one.b == len("one two")
    assert prefix_token_counts(df.limit(0), PATH).count() == 0


@pytest.mark.parametrize("text", ["x" + " " * 200_000, " " * 60_000 + "x", ("word" + "  ") * 60_000, "a\n" * 200_000, "ab" * 100_000, "!" * 200_000])
def test_long_runs_take_linear_time(text):
    began = time.process_time()
    n, _ = COUNTER.steps(text)
    assert n == count(text) and time.process_time() - began < 60


def test_wide_differences():
    import numpy as np
    steps = np.array([1, 300, -299])
    assert unpack(pack(steps)).tolist() == [0, 1, 301, 2]
