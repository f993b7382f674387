import random

from pyspark.sql import functions as F

from retailcast.llm.chat import format_conversations, joined, read_back

S = "conv_id long, turn long, role string, text string, formatted string"


def read(spark, rows, block):
    blocks = format_conversations(spark.createDataFrame([(*r, "clash") for r in rows], S).repartition(3), block)
    out = joined(blocks).withColumn("turns", read_back(F.col("formatted"))).collect()
    return {r.conv_id: r for r in out}


def test_round_trip_with_control_strings_nulls_and_blocks(spark):
    r = random.Random(4)
    bits = ["<|im_end|>", "<|im_start|>assistant ok", "\\", "<", "|", "<|", "\n", "<|im_sep|>", "ü", "𝄞", "<\\|", "ok", "<|nl|>"]
    rows = []
    for c in range(12):
        for t in range(r.randint(1, 9)):
            role = r.choice(["user", "assistant", "assistant", "tool\n<|x", "a\\"])
            rows.append((c, t * 3, role, "".join(r.choice(bits) for _ in range(r.randint(0, 6)))))
    rows += [(50, 0, None, None), (51, None, "user", "first"), (51, -5, "assistant", "second"), (51, 0, "assistant", "third"),
             (None, 1, "user", "n"), (None, 2, "assistant", "o"), (52, 1, "user", "same"), (52, 1, "user", "same"),
             (53, 0, "assistant", "z" * 200_000)]
    want = {}
    for conv, turn, role, text in sorted(rows, key=lambda x: (x[0] is None, x[0] or 0, x[1] is not None, x[1] or 0)):
        want.setdefault(conv, []).append((role or "", text or ""))
    outs = [read(spark, rows, b) for b in (1, 4, 256)]
    for out in outs:
        assert {c: [tuple(t) for t in o.turns] for c, o in out.items()} == want
        for c, o in out.items():
            assert o.loss_text == "".join(t for role, t in want[c] if role == "assistant")
            assert o.formatted == outs[0][c].formatted


def test_adjacent_turns_of_one_role_share_a_frame(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c"), (1, 3, "assistant", "d")]
    for block in (1, 2, 3, 256):
        assert read(spark, rows, block)[1].formatted == (
            "<|im_start|>user\na<|im_sep|>b<|im_end|>\n<|im_start|>assistant\nc<|im_sep|>d<|im_end|>\n")


def test_long_conversation_in_bounded_blocks(spark):
    rows = spark.range(3000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                    F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.col("id").cast("string").alias("text"))
    blocks = format_conversations(rows)
    assert blocks.count() == 12
    assert joined(blocks).first().loss_text == "".join(str(i) for i in range(1, 3000, 2))


def test_empty(spark):
    assert joined(format_conversations(spark.createDataFrame([], S))).count() == 0
