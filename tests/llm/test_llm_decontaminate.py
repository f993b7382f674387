import hashlib
import random
import re

from retailcast.llm.decontaminate import WINDOW, decontaminate, winnow

D, I = "doc_id long, text string, n_words int, span string", "item_id long, text string"


def split(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = split(text)
        n = min(WINDOW, len(w))
        for s in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[s:s + n]), set()).add(item)
    out = set()
    for doc, text in docs:
        w, hit, found = split(text), set(), set()
        for n in {len(x) for x in windows}:
            for s in range(len(w) - n + 1):
                if tuple(w[s:s + n]) in windows:
                    hit.update(range(s, s + n))
                    found |= windows[tuple(w[s:s + n])]
        ids = sorted(str(i) for i in found if i is not None)
        out.add((doc, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return out


def fixture():
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdé7") for _ in range(r.randint(1, 3)))
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([0, 1, 4, 9, 10, 11, 30, 60])]
    items += [(20, items[6][1]), (21, items[6][1]), (22, None), (None, items[7][1]), (23, "Same head " + items[6][1])]
    docs = []
    for i in range(60):
        body = [word() for _ in range(r.randint(0, 80))]
        _, text = r.choice(items)
        w = (text or "").split()
        a = r.randint(0, len(w))
        body[len(body) // 2:len(body) // 2] = w[a:a + r.randint(5, 40)]
        docs.append((i, r.choice([" ", ", ", "\n"]).join(body).upper() if i % 3 else "; ".join(body)))
    long = " ".join(word() for _ in range(70_000)) + " " + items[7][1]
    docs += [(100, None), (101, ""), (102, "?!"), (103, long), (5, docs[5][1]), (None, items[6][1]), (104, "x " * 30)]
    return docs, items


def test_against_brute_force_broadcast_and_joined(spark):
    docs, items = fixture()
    d = spark.createDataFrame([(*x, 7, "clash") for x in docs], D).repartition(5)
    i = spark.createDataFrame(items, I)
    want = brute(docs, items)
    assert sum(x[5] for x in want) > 20
    for limit in (1 << 20, 0):
        got = decontaminate(d, i, limit).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()
        assert {tuple(x) for x in got} == want
        assert len(got) == len(want)


def test_empty_tables(spark):
    docs, items = fixture()
    none_d, none_i = spark.createDataFrame([], D), spark.createDataFrame([], I)
    assert decontaminate(none_d, spark.createDataFrame(items, I)).count() == 0
    got = decontaminate(spark.createDataFrame([(*docs[0], 1, "")], D), none_i).collect()
    assert [(x.doc_id, x.contaminated) for x in got] == [(0, False)]


def test_winnow_keeps_one_of_each_window():
    import numpy as np
    h = np.random.default_rng(1).integers(0, 5, 300).astype(np.uint64)
    kept = winnow(h, 6)
    assert all(((kept >= i) & (kept < i + 6)).any() for i in range(len(h) - 5))
    assert len(winnow(h[:3], 6)) == 0
