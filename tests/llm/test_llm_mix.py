import random
import re
from collections import defaultdict

import pytest

from retailcast.llm.mix import mix, mirrored, mixed_stream, schedule, source_targets
from pyspark.sql import functions as F

D = "doc_id long, source string, text string, taken int, bucket int"


def targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight, out, left, open_ = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, {}, 1.5 * sum(sizes.values()), set(names)
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 2 * sizes[s]]
        if not over:
            return out | share
        for s in over:
            out[s] = 2 * sizes[s]
            left -= out[s]
            open_.discard(s)
    return out


def fixture(n=400):
    r = random.Random(6)
    docs = [(i, "hot" if i % 3 == 0 else r.choice(["b", "B", "é", "𝄞", "tiny", None]), " ".join("w" * r.randint(1, 3) for _ in range(r.randint(0, 300)))) for i in range(n)]
    docs += [(900, "empty", ""), (901, "empty", None), (902, "one", "\x0bword\x1c"), (None, "b", "x y z"), (5, docs[5][1], docs[5][2]), (903, "long", "word " * 30_000)]
    return docs


def test_targets_taken_and_bounds(spark):
    docs = fixture()
    got = mix(spark.createDataFrame([(*d, 1, 1) for d in docs], D).repartition(5)).collect()
    assert len(got) == len(docs)
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, taken = defaultdict(int), defaultdict(int)
    for _, s, t in docs:
        sizes[s] += count(t)
    want = targets(sizes)
    source = {i: s for i, s, _ in docs}
    for r in got:
        s = source[r.doc_id]
        taken[s] += r.taken
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s]) and 0 <= r.taken <= 2 * r.size
    assert sorted((str(r.doc_id), r.size) for r in got) == sorted((str(i), count(t)) for i, _, t in docs)
    assert all(want[s] - 1 < taken[s] <= want[s] + 1e-6 for s in sizes)


def test_reruns_agree_however_rows_are_dealt(spark):
    docs = spark.createDataFrame([(*d, 1, 1) for d in fixture(120)], D)
    a, b = (sorted((str(r.doc_id), r.taken, str(r.first_place)) for r in mix(docs.repartition(n)).collect()) for n in (1, 7))
    assert a == b
    assert all((place == "None") == (taken == 0) for _, taken, place in a)


def test_stream_follows_the_targets_and_sums_to_what_is_taken(spark):
    r = random.Random(3)
    docs = [(i, r.choice("aab"), " ".join("w" * r.randint(1, 3) for _ in range(r.randint(20, 200)))) for i in range(300)]
    df = spark.createDataFrame([(*d, 1, 1) for d in docs], D)
    pieces = sorted(mixed_stream(df).collect(), key=lambda p: (p.place, p.source))
    got = {r.doc_id: r for r in mix(df).collect()}
    sums, first, slots = defaultdict(int), {}, defaultdict(int)
    covered = defaultdict(lambda: defaultdict(int))
    for p in pieces:
        sums[p.doc_id] += p.length
        first.setdefault(p.doc_id, p.place)
        slots[p.place] += p.length
        for w in range(p.begin, p.begin + p.length):
            covered[p.doc_id][w] += 1
    assert {i: r.taken for i, r in got.items() if r.taken} == dict(sums)
    assert {i: r.first_place for i, r in got.items() if r.taken} == first
    assert all(0 <= w < got[i].size and n <= 2 for i, ws in covered.items() for w, n in ws.items())
    assert max(slots.values()) == 64 and sum(n < 64 for n in slots.values()) <= 2
    share = {s: t for s, t in {(d[1], got[d[0]].target) for d in docs}}
    total, seen, done = sum(share.values()), defaultdict(int), 0
    for p in pieces:
        seen[p.source] += p.length
        done += p.length
        if done > 2_000:
            assert all(abs(seen[s] - done * share[s] / total) < 12 * 64 for s in share)


def test_prefixes_of_the_schedule_follow_the_targets(spark):
    sized = spark.createDataFrame([("a", 50_000), ("b", 30_000), ("c", 20_000)], "source string, size long")
    goal = source_targets(sized)
    share = {r.source_no: r.target / 150_000 for r in goal.collect()}
    slots = sorted(schedule(goal).select("place", "source_no", "rank").collect())
    assert len({(s, r) for _, s, r in slots}) == len(slots)
    seen = defaultdict(int)
    for i, (_, s, rank) in enumerate(slots, 1):
        assert rank == seen[s]
        seen[s] += 1
        if i > 100:
            assert all(abs(seen[x] - i * share[x]) < 12 for x in share)


def test_points(spark):
    got = [r[0] for r in spark.range(8).select(mirrored(F.col("id"))).collect()]
    assert got == [0, .5, .25, .75, .125, .625, .375, .875]


def test_empty(spark):
    assert mix(spark.createDataFrame([], D)).count() == 0
    only = mix(spark.createDataFrame([(1, "a", "", 0, 0), (2, None, None, 0, 0)], D)).collect()
    assert [(r.size, r.target, r.taken) for r in only] == [(0, 0.0, 0)] * 2
