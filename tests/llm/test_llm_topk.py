import math
import random

import numpy as np
from pyspark.sql import functions as F

from retailcast.llm.topk import quantised, threshold_search, top_k

S = "vec_id long, embedding array<float>, score int"


def brute(rows, k, every):
    best = {}
    for i, v, _ in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            q = [math.floor(64 * float(np.float32(x))) for x in v]
            best[i] = min(best.get(i, q), q)
    out = []
    for a, p in best.items():
        if a % every == 0:
            found = sorted((-sum(x * y for x, y in zip(p, q)), b) for b, q in best.items() if b != a)[:k]
            out += [(a, n, b, -s) for n, (s, b) in enumerate(found, 1)]
    return sorted(out)


def fixture():
    r = random.Random(7)
    rows = [(i, [r.gauss(0, 0.15) for _ in range(12)], 0) for i in range(400)]
    rows += [(1000 + i, [0.5] * 12, 0) for i in range(150)]  # one vector many times: ties by id
    rows += [(2000, None, 0), (2001, [None] * 12, 0), (2002, [float("nan")] * 12, 0), (2003, [float("inf")] * 12, 0), (None, [1.0] * 12, 0),
             (2004, [], 0), (2005, [1.0, 2.0], 0), (2020, [0.0] * 12, 0), (1000, [0.5] * 12, 0), (1001, [0.1] * 12, 0)]
    return rows


def test_against_brute_force(spark):
    rows = fixture()
    vectors = quantised(spark.createDataFrame(rows, S).repartition(3))
    for block, group in ((10_000, 10_000), (37, 5)):
        got = top_k(vectors, F.col("vec_id") % 20 == 0, 20, block, group).collect()
        assert sorted(map(tuple, got)) == brute(rows, 20, 20)


def test_fewer_rows_than_k_and_none(spark):
    few = spark.createDataFrame([(0, [0.1], 0), (20, [0.2], 0), (3, [0.3], 0)], S)
    got = top_k(quantised(few), F.col("vec_id") % 20 == 0, 20).collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in got) == [(0, 1, 3), (0, 2, 20), (20, 1, 3), (20, 2, 0)]
    assert top_k(quantised(few.limit(0)), F.col("vec_id") % 20 == 0).count() == 0


def test_search_stops_early_and_stays_exact():
    class Counted(np.ndarray):
        read = 0

        def __getitem__(self, at):
            if isinstance(at, np.ndarray):
                Counted.read += len(at)
            return super().__getitem__(at)

    r = np.random.default_rng(1)
    rows = np.floor(1000 * r.pareto(1.0, (6000, 3))).astype(np.int64)
    lists = np.argsort(-rows, axis=0, kind="stable").T
    ids, query = np.arange(6000), np.array([3, 1, 0])
    got, scores = threshold_search(query, -1, rows.view(Counted), ids, lists, 5)
    order = np.lexsort((ids, -(rows @ query)))[:5]
    assert got.tolist() == order.tolist() and scores.tolist() == (rows @ query)[order].tolist()
    assert Counted.read < 2000
