"""The manifest and its proofs against a plain recursive tree."""
import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from retailcast.llm import merkle as mk
from retailcast.llm.queries import op13_merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, number long, digest string, given string, root string"


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(doc_id, source, lang, n_chars, text):
    return _h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def _up(nodes):
    return [_h(*nodes[k:k + 8]) for k in range(0, len(nodes), 8)]


def _path(nodes, i):
    path = []
    while len(nodes) > 1:
        start = i // 8 * 8
        path.append(("".join(nodes[start:i]), "".join(nodes[i + 1:start + 8])))
        nodes, i = _up(nodes), i // 8
    return path, nodes[0]


def _brute(rows):
    trees = {}
    for doc_id, text, lang, source, n_chars in rows:
        leaf = _leaf(doc_id, source, lang, n_chars, text)
        given = leaf
        if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0:
            lower = text and "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            given = _leaf(doc_id, source, lang, n_chars, lower)
        trees.setdefault(lang, []).append(((doc_id is not None, doc_id or 0, leaf), doc_id, leaf, given))
    order = sorted(trees, key=lambda k: (k is not None, (k or "").encode()))
    tops = []
    for lang in order:
        trees[lang].sort(key=lambda x: x[0])
        tops.append(_path([x[2] for x in trees[lang]], 0)[1])
    out = []
    for at, lang in enumerate(order):
        nodes = [x[2] for x in trees[lang]]
        above, root = _path(tops, at)
        for i, (_, doc_id, leaf, given) in enumerate(trees[lang]):
            path = _path(nodes, i)[0] + above
            folded = given
            for before, after in path:
                folded = _h(before, folded, after)
            out.append((doc_id, leaf, tops[at], root, _h(*(b + a for b, a in path)), folded, folded == root))
    return sorted(out, key=str)


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def _run(spark, rows, folder):
    spark.createDataFrame([(*r, "x", 1, "x", "x", "x") for r in rows], SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    return sorted((tuple(r) for r in op13_merkle(spark, str(folder)).select(*COLUMNS).collect()), key=str)


def test_odd_rows(spark, tmp_path):
    rows = [(1, "A Text", "en", "s", 6), (2, None, "en", None, None), (None, "No Id", "en", "s", 5), (3, "Ünï A", None, "s", 5),
            (4, "", "", "s", 0), (4, "", "", "s", 0), (4, "other", "", "s", 0), (7, "Alone", "de", "s", 5),
            (None, None, None, None, None), (-5, "B" * 300_000, "en", "s", 7)]
    rows += [(100 + i, f"Row {i}", "fr", "s", i) for i in range(66)]
    rows += [(200, "Same Row", "en", "s", 8)] * 20 + [(i, "X", f"l{i}", "s", 1) for i in range(300, 309)]
    assert _run(spark, rows, tmp_path / "a") == _brute(rows)


def test_one_row_and_none(spark, tmp_path):
    assert _run(spark, [(9, "T", "en", "s", 1)], tmp_path / "one") == _brute([(9, "T", "en", "s", 1)])
    assert _run(spark, [], tmp_path / "none") == []


def test_trees_over_several_builders(spark, tmp_path):
    rows = [(i * 7, f"Text {i}", "en" if i % 40 else "de", "s", i) for i in range(9_500)]
    assert _run(spark, rows, tmp_path / "many") == _brute(rows)


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65, 100, 513])
def test_places_are_those_of_a_postorder_walk(n):
    widths = [n]
    while widths[-1] > 1:
        widths.append(-(-widths[-1] // 8))
    walk = []

    def visit(level, index):
        if level:
            for child in range(index * 8, min(index * 8 + 8, widths[level - 1])):
                visit(level - 1, child)
        walk.append((level, index))

    visit(len(widths) - 1, 0)
    assert [int(mk.postorder(level, np.array([index]), n)[0]) for level, index in walk] == list(range(len(walk)))


def test_log_is_the_whole_tree_in_postorder(spark):
    rows = spark.range(600).select(F.lit("en").alias("g"), "id", F.sha2(F.col("id").cast("string").cast("binary"), 256).alias("digest"))
    made = mk.manifest(rows, "g", "id", range_rows=100)
    log = sorted(made.trees.log.select("position", "level", "number", "digest").collect())
    assert [r["position"] for r in log] == list(range(600 + 75 + 10 + 2 + 1))
    digests = {(r["level"], r["number"]): r["digest"] for r in log}
    nodes, level = [_h(str(i)) for i in range(600)], 0
    while True:
        assert nodes == [digests[level, i] for i in range(len(nodes))]
        if len(nodes) == 1:
            break
        nodes, level = _up(nodes), level + 1
    assert made.root == nodes[0]
