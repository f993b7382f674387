import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from retailcast.llm.quality import ORDER, SIGNS, CodeTable, judge_quality, score, train

D, L = "doc_id long, text string, lang string, perplexity string", "doc_id long, quality int"


class Brute:
    """Interpolated modified Kneser-Ney by its definition."""

    def __init__(self, texts):
        self.c = {ORDER: Counter()}
        for t in texts:
            s = [0] * (ORDER - 1) + [b + 1 for b in t.encode()]
            self.c[ORDER].update(tuple(s[i:i + ORDER]) for i in range(len(s) - ORDER + 1))
        for n in range(ORDER - 1, 0, -1):
            self.c[n] = Counter(g[1:] for g in self.c[n + 1])
        self.d, self.by = {}, {}
        for n, c in self.c.items():
            m = Counter(c.values())
            if all(m[i] for i in (1, 2, 3, 4)):
                y = m[1] / (m[1] + 2 * m[2])
                raw = [1 - 2 * y * m[2] / m[1], 2 - 3 * y * m[3] / m[2], 3 - 4 * y * m[4] / m[3]]
                self.d[n] = [min(max(x, 0.05), i + 0.95) for i, x in enumerate(raw)]
            else:
                self.d[n] = [0.5, 0.75, 0.9]
            self.by[n] = defaultdict(list)
            for g, k in c.items():
                self.by[n][g[:-1]].append(k)

    def p(self, g):
        if not g:
            return 1 / SIGNS
        n, counts = len(g), self.by[len(g)].get(g[:-1])
        if not counts:
            return self.p(g[1:])
        d = self.d[n]
        own = self.c[n].get(g, 0)
        off = d[min(own, 3) - 1] if own else 0
        left = sum(d[min(k, 3) - 1] for k in counts) / sum(counts)
        return (own - off) / sum(counts) + left * self.p(g[1:])

    def logp(self, text):
        s = [0] * (ORDER - 1) + [b + 1 for b in text.encode()]
        return sum(math.log(self.p(tuple(s[i:i + ORDER]))) for i in range(len(s) - ORDER + 1))


def texts(n, seed=1):
    r = random.Random(seed)
    return [" ".join(r.choice(["the", "cat", "sat", "on", "mat", "é", "was", "that"]) for _ in range(r.randint(3, 30))) for _ in range(n)]


def test_perplexity_against_the_definition_by_both_ways(spark):
    known = texts(40)
    brute = Brute(known)
    model = train(spark.createDataFrame([(t,) for t in known + [None, ""]], "text string").repartition(3))
    asked = texts(10, 2) + ["zzz qqq", "THE CAT!!", "ü"]
    rows = spark.createDataFrame(list(enumerate(asked)) + [(99, None), (98, "")], "row long, text string")
    for limit in (1 << 24, 0):
        got = {r.row: r.logp for r in score(rows, model, limit).collect()}
        for i, t in enumerate(asked):
            assert got[i] == pytest.approx(brute.logp(t), rel=1e-4)


def test_thresholds_by_language_and_odd_rows(spark):
    good = texts(120)
    docs = [(i, t, "en") for i, t in enumerate(good)] + [(500, "XQ ZW!! KJ%% $$", "en"), (501, "XQ ZW!! KJ%% $$", "xx"), (502, good[0], None),
                                                        (503, None, "en"), (504, "", "en"), (None, good[1], "en"), (0, good[0], "en")]
    d = spark.createDataFrame([(*x, "clash") for x in docs], D)
    labels = spark.createDataFrame([(i, 1) for i in range(100)] + [(0, 1), (500, 0), (7, None), (None, 1), (101, 1), (101, 0)], L)
    got = judge_quality(d, labels).collect()
    assert len(got) == len(docs)
    kept = {(r.doc_id, r.lang): r.kept for r in got}
    assert not kept[500, "en"] and not kept[501, "xx"] and not kept[503, "en"] and not kept[504, "en"]
    assert kept[502, None] and sum(kept[i, "en"] for i in range(120)) >= 117
    assert not any(r.trusted for r in got if r.doc_id in (101, 500, None))
    assert all(r.kept == (r.n_bytes > 0) for r in judge_quality(d, labels.limit(0)).collect())
    assert judge_quality(d.limit(0), labels).count() == 0


def test_rows_keep_their_own_values_however_they_are_dealt(spark, tmp_path):
    """By both ways, with other splits in every job."""
    docs = [(i % 90, t, "en") for i, t in enumerate(texts(150, 5))] + [(None, None, "en"), (None, "the mat", "fr"), (3, "the mat", None)]
    spark.createDataFrame([(*x, "clash") for x in docs], D).repartition(12).write.parquet(str(tmp_path / "docs"))
    labels = spark.createDataFrame([(i, 1) for i in range(60)], L)
    values, old = [], spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for split, limit in (("1g", 1 << 24), ("3000", 1 << 24), ("1g", 0)):
            spark.conf.set("spark.sql.files.maxPartitionBytes", split)
            asked = judge_quality(spark.read.parquet(str(tmp_path / "docs")), labels, max_bytes=limit)
            spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
            values.append(sorted(((r.doc_id, r.lang, r.n_bytes, r.trusted, r.kept, round(r.perplexity or 0, 9)) for r in asked.collect()), key=str))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert values[0] == values[1] == values[2] and len(values[0]) == len(docs)
    scored = score(spark.createDataFrame([(1, "the cat"), (2, "the cat"), (3, "")], "row long, text string"), train(spark.createDataFrame([("the cat sat",)], "text string")), 0)
    assert {(r.row, r.n_bytes) for r in scored.collect()} == {(1, 7), (2, 7), (3, 0)}


def test_very_long_text(spark):
    long = " ".join(texts(1)) * 60_000
    got = judge_quality(spark.createDataFrame([(1, long, "en", ""), (2, long[:2000], "en", "")], D), spark.createDataFrame([(2, 1)], L)).collect()
    ppl = {r.doc_id: r.perplexity for r in got}
    assert len(long.encode()) > 1 << 20 and ppl[1] == pytest.approx(ppl[2], rel=0.05)


def test_code_table():
    r = np.random.default_rng(2)
    code = np.unique(r.integers(0, 1 << 40, 5000))
    t = CodeTable(code, np.arange(len(code), dtype=np.float32))
    value, found = t.find(np.concatenate((code, code + 1)))
    assert found[:len(code)].all() and (value[:len(code)] == np.arange(len(code))).all()
    assert (found[len(code):] == np.isin(code + 1, code)).all()
