import random

import numpy as np
import pytest

from retailcast.llm import near_dup
from retailcast.llm.near_dup import M, band_rows, components, may_reach, near_duplicates, shingle_set, sketch

D = "doc_id long, text string, digest string, n int"


def shingles(text, k):
    w = (text or "").translate({i: i + 32 for i in range(65, 91)}).split(" ")
    w = [x for x in __import__("re").findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))]
    return {tuple(w[i:i + k]) for i in range(max(len(w) - k, 0) + 1)} if w else set()


def brute(docs, k, percent):
    sets = [(i, shingles(t, k)) for i, t in docs]
    root = {i: i for i, _ in sets if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    known = [(i, s) for i, s in sets if i is not None and s]
    for a, (i, s) in enumerate(known):
        for j, t in known[:a]:
            n = len(s & t)
            if 100 * n >= percent * (len(s) + len(t) - n):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return sorted((i, len(s), find(i), find(i) == i) for i, s in sets if i is not None)


def fixture(seed=8):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    docs, n = [], 0

    def add(words):
        nonlocal n
        n += 1
        docs.append((1000 - n if n % 2 else n + 2000, " ".join(words)))

    def edit(words, k):
        words = list(words)
        for i in r.sample(range(len(words)), k):
            words[i] = word()
        return words
    for size, copies, edits in ((60, 25, 1), (120, 40, 3), (90, 30, 5)):  # star groups; many links only through the middle one
        first = [word() for _ in range(size)]
        add(first)
        for _ in range(copies):
            add(edit(first, r.randint(1, edits)))
    chain = [word() for _ in range(80)]
    for _ in range(25):  # each a little further on
        add(chain)
        chain = edit(chain, 1)
    for _ in range(40):
        add([word() for _ in range(r.randint(0, 60))])
    same = [word() for _ in range(30)]
    for _ in range(60):
        add(same)
    passage = [word() for _ in range(40)]
    for _ in range(40):  # a shared passage alone is no link
        add(passage + [word() for _ in range(50)])
    docs += [(1, None), (2, ""), (3, " \n"), (4, "A B"), (5, "a b"), (6, "a"), (7, "long " + " ".join(map(str, range(70_000)))), (8, "LONG " + " ".join(map(str, range(70_000)))),
             (6, "a")]
    return docs


@pytest.mark.parametrize("k,percent", [(3, 85), (5, 80)])
def test_components_against_brute_force(spark, k, percent):
    docs = fixture()
    df = spark.createDataFrame([(*d, "clash", 1) for d in docs], D).repartition(4)
    got = near_duplicates(df, k, percent).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == brute(docs, k, percent)


def test_left_over_cells_find_what_the_pivots_miss(spark, monkeypatch):
    # without pivots' links all groups must come from the cells
    monkeypatch.setattr(near_dup, "confirmed", lambda pairs, *a: pairs.where("false"))
    docs = [d for d in fixture(9) if d[0] not in (7, 8)]
    got = near_duplicates(spark.createDataFrame([(*d, "", 1) for d in docs], D), 3, 85).collect()
    want = {i: c for i, _, c, _ in brute(docs, 3, 85)}
    size = {c: list(want.values()).count(c) for c in want.values()}
    # a bucket of two is settled by its pivot
    assert all(r.component_id == want[r.doc_id] for r in got if size[want[r.doc_id]] > 20)


def test_rows_without_id_repeated_ids_and_empty_table(spark):
    docs = [(None, "one two three four"), (None, "nobody else has this"), (9, "one two three four"), (9, "one two three four"), (4, "w x y z")]
    got = near_duplicates(spark.createDataFrame([(*d, "", 1) for d in docs], D), 3, 85).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in got) == [
        ("4", "4", True), ("9", "9", True), ("9", "9", True), ("None", "9", False), ("None", "None", True)]
    twice = [(1, "a b c d e f"), (1, "p q r s t"), (2, "p q r s t"), (3, "a b c d e f")]
    got = near_duplicates(spark.createDataFrame([(*d, "", 1) for d in twice], D), 3, 85).collect()
    assert {r.component_id for r in got} == {1}
    assert near_duplicates(spark.createDataFrame([], D), 3, 85).count() == 0


def test_texts_that_share_an_id_or_have_none_are_compared_by_their_sets(spark):
    text = lambda name, end="": " ".join(f"{name}{i}" for i in range(60)) + end
    docs = [(1, text("a")), (1, text("b", " more words here")), (2, text("a", " x")), (3, text("b", " more words there")),
            (None, text("a", " y")), (None, text("c")), (None, text("c", " z")), (None, text("d")), (5, text("e")), (1, text("f")), (4, text("f", " w"))]
    got = near_duplicates(spark.createDataFrame([(*d, "", 1) for d in docs], D).repartition(3), 3, 85).collect()
    of = {}
    for r in got:
        of.setdefault(r.component, []).append((r.doc_id, r.component_id, r.kept))
    key = lambda x: (x[0] is None, x[0] or 0, x[2])
    assert sorted(sorted(x, key=key) for x in of.values() if x[0][1] is not None) == [
        [(1, 1, True), (2, 1, False), (None, 1, False)], [(1, 1, True), (3, 1, False)], [(1, 1, True), (4, 1, False)], [(5, 5, True)]]
    assert sorted(sorted(x, key=key) for x in of.values() if x[0][1] is None) == [
        [(None, None, False), (None, None, True)], [(None, None, True)]]


def test_components_of_long_chains(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 90), (95, 100), (200, 200)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "u long, v long")).collect()))
    assert got == {**{i: 0 for i in range(61)}, 90: 90, 95: 90, 100: 90}


def test_sketches_merge_and_the_likelihood_test_keeps_true_pairs():
    r = np.random.default_rng(3)
    a, b = np.unique(r.integers(0, 1 << 63, 900, dtype=np.uint64)), np.unique(r.integers(0, 1 << 63, 700, dtype=np.uint64))
    assert (sketch(np.union1d(a, b)) == np.maximum(sketch(a), sketch(b))).all()
    kept = dropped = 0
    for _ in range(200):
        both, x, y = (r.integers(0, 1 << 63, n, dtype=np.uint64) for n in (850, 75, 75))
        s, t = np.concatenate((both, x)), np.concatenate((both, y))
        kept += may_reach(sketch(s)[None], sketch(t)[None], np.array([len(s)]), np.array([len(t)]), 0.85)[0]
        s, t = np.concatenate((both[:300], x)), np.concatenate((both[:300], y, r.integers(0, 1 << 63, 300, dtype=np.uint64)))
        dropped += not may_reach(sketch(s)[None], sketch(t)[None], np.array([len(s)]), np.array([len(t)]), 0.85)[0]
    assert kept == 200 and dropped == 200
    for t in (0.8, 0.85):
        assert (1 - t ** band_rows(t)) ** (M // band_rows(t)) <= 1e-8
    assert len(shingle_set(b"One two", 3)) == 1 and len(shingle_set(None, 3)) == 0
