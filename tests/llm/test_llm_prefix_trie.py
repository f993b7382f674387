"""The trie against plain dictionaries of prefixes."""
import hashlib
import zlib

from pyspark.sql import functions as F

from retailcast.llm import prefix_trie as pt
from retailcast.llm.queries import op12_prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth long, number long, n long, owner string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def _nodes(sequences):
    """Rows of the trie of {conv_id: turns}."""
    members = {}
    for conv, turns in sequences.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(conv)
    children, leaves, saved = {}, dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for node in members:
        if node:
            children[node[:-1]] = children.get(node[:-1], 0) + 1
    for node, convs in members.items():
        value = (len(convs) - 1) * len(node[-1][1]) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += node not in children
            saved[node[:d]] += value
    out = []
    for node, convs in members.items():
        ends = ",".join(str(c) for c in sorted(convs) if len(sequences[c]) == len(node))
        out.append((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), children.get(node, 0),
                    leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def _rebuilt(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    own = {c: [(t[2], t[4]) for t in sorted(turns)] for c, turns in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def _table(spark, rows):
    return spark.createDataFrame([(*r, 9, 9, 9, "x") for r in rows], SCHEMA)


def _query(spark, rows, folder):
    _table(spark, rows).repartition(3).write.parquet(f"{folder}/conversations.parquet")
    return sorted((tuple(r) for r in op12_prefix_trie(spark, str(folder)).select(*COLUMNS).collect()), key=str)


def test_odd_rows(spark, tmp_path):
    rows = [(0, k, "user" if k % 2 else "assistant", f"shared {k}") for k in range(4)]
    for c in [*range(1, 25), 99, 100, 205, 206, 207, -1, -101]:
        rows += [(c, k, None if c % 7 == 3 else "user", None if k == 1 else "hello " * (k % 3)) for k in range(c % 8)] or [(c, None, "user", "")]
    rows += [(None, 1, "user", "no id"), (7, None, "user", "null turn"), (7, 3, "user", "same turn"), (7, 3, "user", "same turn"), (7, 3, "a", "Z\U0001f600")]
    assert _query(spark, rows, tmp_path / "odd") == _nodes(_rebuilt(rows))


def test_no_rows(spark, tmp_path):
    assert _query(spark, [], tmp_path / "none") == []
    assert _query(spark, [(None, 1, "user", "x")], tmp_path / "null") == []


def _trie(spark, sequences, **sizes):
    rows = [(c, k, *turn) for c, turns in sequences.items() for k, turn in enumerate(turns)]
    lengths = spark.createDataFrame([(c, len(t)) for c, t in sequences.items()], "conv_id long, length long")
    turns = pt.numbered_turns(_table(spark, rows), range_rows=sizes.get("range_rows", 1 << 18))
    return sorted((tuple(r) for r in pt.prefix_trie(turns, lengths, **sizes).select(*COLUMNS).collect()), key=str)


def test_long_paths_many_copies_and_small_shards(spark):
    """Conversations of many units, one text that most say first, copies in every shard, a comb of
    conversations that each go on from another, and one without turns."""
    sequences = {c: [("user", "hi"), ("assistant", f"t{c % 5}")] for c in range(100, 260)}
    sequences |= {c: [("user", "hi"), ("assistant", "same")] for c in range(1000, 1180)}
    sequences |= {c: [("user", "hi")] + [("user", f"x{k}") for k in range(c)] for c in range(1, 50)}
    sequences |= {500: [("a", "long")] * 300, 501: [("a", "long")] * 290 + [("b", "other")] * 20, 502: [("a", "long")] * 16, 503: [], 499: [("a", "long")] * 32}
    assert _trie(spark, sequences, shard_units=23, range_rows=150) == _nodes(sequences)


def test_shards_and_partitions_do_not_matter(spark):
    sequences = {c: [("user", f"t{(c * k) % 3}") for k in range(c % 20)] for c in range(90)}
    assert _trie(spark, sequences) == _trie(spark, sequences, shard_units=7, range_rows=40) == _nodes(sequences)


def test_ends_are_hashed_over_several_rows(spark):
    rows = [(1, 2, 3, c, ",".join(map(str, range(c, c + 5)))) for c in range(0, 50, 5)] + [(1, 2, 4, 7, "7")]
    got = pt._digests(spark.createDataFrame(rows, "depth long, f1 long, f2 long, conv_id long, ends string").repartition(4)).collect()
    whole = hashlib.sha256(",".join(map(str, range(50))).encode()).hexdigest()
    assert sorted(map(tuple, got)) == [(1, 2, 3, whole), (1, 2, 4, hashlib.sha256(b"7").hexdigest())]
