import random

import numpy as np

from retailcast.llm import toxicity as X

D, L = "doc_id long, text string, score string, lang string", "doc_id long, toxic int"


def corpus(n, seed=1):
    r = random.Random(seed)
    word = lambda: "".join(r.choice(["ta", "re", "lo", "mi", "su", "ke", "é"]) for _ in range(r.randint(1, 4)))
    out = []
    for i in range(n):
        ws = [word() for _ in range(r.randint(5, 200))]
        bad = i % 4 == 0
        if bad:
            for _ in range(3):
                ws.insert(r.randint(0, len(ws)), r.choice(["zorgh", "grukx", "zorghly"]))
        out.append((i, " ".join(ws), int(bad)))
    return out


def test_gradients_against_differences():
    r = np.random.default_rng(0)
    net = X.Network([b"a", b"b"], 1)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    x = r.normal(0, 1, (6, 3, X.WIDTH))
    mask = np.ones((6, 3), bool)
    mask[4:, 1] = False
    y, weight = np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 1.0])

    def loss():
        w = net.w
        both = np.stack((x, x[::-1]), 1)
        out = X.gru(both @ w["in"] + w["b"], w["u"], np.stack((mask, mask[::-1]), 1)[..., None])
        p = X._sigmoid(net.pooled(np.concatenate((out[:, 0], out[::-1, 1]), 2), mask)[2] @ w["out"] + w["bias"][0])
        return -(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / weight.sum()
    g, dx = net.learn(x, mask, y, weight)
    for name in ("in", "b", "u", "wa", "va", "out", "bias"):
        w = net.w[name]
        for at in [tuple(r.integers(0, s) for s in w.shape) for _ in range(4)]:
            w[at] += 1e-5
            up = loss()
            w[at] -= 2e-5
            down = loss()
            w[at] += 1e-5
            assert abs((up - down) / 2e-5 - g[name][at]) < 1e-4, name
    x[2, 1, 3] += 1e-5
    up = loss()
    x[2, 1, 3] -= 2e-5
    assert abs((up - loss()) / 2e-5 - dx[2, 1, 3]) < 1e-4


def test_windows_cover_all_words_and_overlap():
    for n in (0, 1, X.WINDOW, X.WINDOW + 1, 500, 1000):
        starts = X.window_starts(n)
        assert {i for s in starts for i in range(s, min(s + X.WINDOW, n))} == set(range(n))
        assert all(b - a == X.STRIDE < X.WINDOW for a, b in zip(starts, starts[1:]))


def test_ngrams_of_words():
    flat, counts = X.ngram_ids([b"ab", "é".encode(), b"word"])
    assert counts.tolist() == [2 + 1, 1, 4 + 3] and len(flat) == counts.sum()
    one, _ = X.ngram_ids([b"word"])
    assert sorted(one) == sorted(flat[-7:])


def test_long_runs_are_read_to_their_end():
    r = random.Random(4)
    for sign in ("abcdefghij", "中文字符測試語料庫長", "😀😁😂🤣😃"):
        for n in (64, 65, 67, 80, 81, 500):
            run = "".join(r.choice(sign) for _ in range(n))
            pieces = X.words("x " + run + " y").decode().split()[1:-1]
            assert all(len(p.encode()) <= X.LONGEST for p in pieces)
            if len(run.encode()) <= X.LONGEST:
                assert pieces == [run]
                continue
            again = pieces[0] + "".join(p[X.RUN_OVERLAP:] for p in pieces[1:])
            assert again == run
            whole = {run[i:i + k] for k in (3, 4) for i in range(n - k + 1)}
            assert whole == {p[i:i + k] for p in pieces for k in (3, 4) for i in range(len(p) - k + 1)}
    assert X.words("a" * 64 + "b-c").decode().split()[-1] == "c"


def test_abuse_deep_in_a_text_without_spaces_is_found():
    r = random.Random(6)
    signs = [chr(0x4E00 + i) for i in range(400)]

    def text(bad):
        run = [r.choice(signs) for _ in range(r.randint(80, 300))]
        if bad:
            for _ in range(3):
                run.insert(r.randint(30, len(run)), "惡罵辱詞")
        return "".join(run)
    rows = [(text(i % 4 == 0), int(i % 4 == 0)) for i in range(600)]
    net = X.train([t for t, _ in rows[:450]], [y for _, y in rows[:450]])
    got, y = X.Scorer(net)([t for t, _ in rows[450:]]), np.array([y for _, y in rows[450:]])
    assert (got[y == 1][:, None] > got[y == 0]).mean() >= 0.95


def test_held_out_accuracy_and_odd_rows(spark, monkeypatch):
    rows = corpus(500)
    docs = [(i, t) for i, t, _ in rows] + [(900, None), (901, ""), (902, "?!"), (None, "zorgh"), (3, rows[3][1]), (903, "ta re lo " * 60_000 + "grukx zorgh grukx")]
    d = spark.createDataFrame([(*x, "clash", "en") for x in docs], D).repartition(4)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(4, 1), (None, 1), (900, 0), (901, None)], L)
    got = X.score_toxicity(d, labels).collect()
    assert len(got) == len(docs)
    truth = {i: y for i, _, y in rows}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 60 and sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    score = {r.doc_id: r for r in got}
    assert all(score[i].score == 0 for i in (900, 901, 902)) and score[903].predicted == 1
    assert all(0 <= r.score <= 1 for r in got) and not score[None].held_out
    none = X.score_toxicity(d, labels.where("toxic = 0")).collect()
    assert all(r.score == 0 and r.predicted == 0 for r in none)
    assert X.score_toxicity(d.limit(0), labels).count() == 0


def test_pieces_of_long_texts_score_as_the_whole(monkeypatch):
    net = X.train([t for _, t, _ in corpus(120)], [y for _, _, y in corpus(120)])
    texts = [t for _, t, _ in corpus(30, 3)] + [" ".join(t for _, t, _ in corpus(60, 4))]
    whole = X.Scorer(net)(texts)
    monkeypatch.setattr(X, "PIECE", X.STRIDE * 3)
    monkeypatch.setattr(X, "PIECE_BYTES", 400)
    assert np.allclose(X.Scorer(net)(texts), whole, atol=1e-5)


def test_scores_keep_the_other_columns(spark):
    df = spark.createDataFrame([(1, "a", "x", "en")], D)
    out = X.with_scores(df, None)
    assert out.columns == ["doc_id", "text", "lang", "score"] and out.first().lang == "en"


def test_words_are_numbered_in_their_order_and_no_words_give_no_network():
    split, names = X._numbered(["b a b", "", "c a"])
    assert names == [b"a", b"b", b"c"] and [ws.tolist() for ws in split] == [[1, 0, 1], [], [2, 0]]
    assert X.train(["", "!"], [0, 1]) is None


def test_slices_of_a_batch_score_as_the_whole(spark, monkeypatch):
    texts = [f"word{i % 7} other{i % 11} bad{i % 3}" for i in range(60)]
    net = X.train(texts, [int(i % 3 == 0) for i in range(60)])
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None, ""])], "doc_id long, text string").coalesce(1)
    whole = X.Scorer(net)([*texts, None, ""])
    got = [r.score for r in X.with_scores(docs, net).orderBy("doc_id").collect()]
    assert np.allclose(got, whole, atol=1e-5)
    scorer = X.Scorer(net)
    assert np.allclose(np.concatenate([scorer(texts[c:c + 7]) for c in range(0, 60, 7)]), whole[:60], atol=1e-5)
