"""The toxicity network: gradients, windows, held-out accuracy, edge cases."""

import zlib

import numpy as np

from textloom.llm import gru, toxicity

SCHEMA = "doc_id long, text string, source string, held_out string, score string"


def test_gradients():
    rng = np.random.default_rng(0)
    words = ["idiot", "thing", "", "loweiä"]
    rows, mask = rng.integers(0, 4, (5, 6)), np.ones((5, 6), np.float32)
    mask[0, 4:] = 0
    label = np.array([0, 1, 1, 0, 1], np.float32)
    net = gru.Network({"idiot": 0, "thing": 1})
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    seen = {}
    net.adam = lambda grad, rate: seen.update(grad)
    net.adam_rows = lambda name, rows, g, rate: seen.setdefault(name, (rows, g))
    net.learn(words, rows, mask, label)

    def loss():
        prob = gru.sigmoid(net.logits(rows, mask, tuple(t.astype(np.float64) for t in net.project(net.inputs(words)))))
        return -np.mean(label * np.log(prob + 1e-7) + (1 - label) * np.log(1 - prob + 1e-7))

    for name, at in [("uf", (1, 2)), ("ub", (3, 20)), ("xf", (2, 5)), ("attend", (4, 1)), ("query", (2,)), ("out", (9,)), ("cb", (17,))]:
        old, eps = net.p[name][at], 1e-2
        net.p[name][at] = old + eps
        up = loss()
        net.p[name][at] = old - eps
        down = loss()
        net.p[name][at] = old
        assert abs((up - down) / (2 * eps) - seen[name][at]) < 2e-3, name


def test_windows_cover_everything():
    for n in (0, 1, 47, 48, 49, 100, 1000):
        s = toxicity.windows(n)
        assert s[0] == 0 and (n <= toxicity.WINDOW or s[-1] + toxicity.WINDOW >= n) and (np.diff(s) <= toxicity.STRIDE).all()


def test_pieces_leave_nothing_out():
    for n in (0, 1, 40, 41, 56, 57, 1000):
        run = "".join(chr(0x4E00 + i) for i in range(n))
        got = toxicity.steps("a " + run + " b")
        pieces = got[1:-1]
        assert got[0] == "a" and got[-1] == "b" and (n > 40 or pieces == [run] * (n > 0))
        assert all(any(run[i : i + 6] in p for p in pieces) for i in range(n - 5)) and len(pieces) >= min(n, 1) and all(len(p) <= 40 for p in pieces)


def test_toxic_after_a_long_prefix():
    rng = np.random.default_rng(5)
    phrases = {"": ["今天天气很好", "我们去公园散步", "老朋友来喝茶", "孩子在海边玩", "他读了一本书", "晚饭后听音乐"], "/": ["sea", "calm", "walk", "park", "friend", "day"]}

    def text(toxic, join):
        bits = list(rng.choice(phrases[join], 30))
        if toxic:
            bits[22] = "scoundrel" if join else "你这个恶棍滚开"
        return join.join(bits)

    for join in phrases:
        y = [i % 2 for i in range(200)]
        net = toxicity.train([text(k, join) for k in y], y)
        got = toxicity.Scorer(net).score([text(k, join) for k in y]) >= 0.5
        assert np.mean(got == np.array(y)) > 0.95, join


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.score(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and (r.score >= 0.5) == r.predicted and 0 <= r.score <= 1 for r in rows)
    toxic = [r.predicted for r in held if r.toxic == 1]
    clean = [r.predicted for r in held if r.toxic == 0]
    print(np.mean(toxic), np.mean(clean))
    assert np.mean(toxic) > 0.85 and np.mean(clean) < 0.02  # some labelled toxic hold no toxic word (noise in these tables)


def small(spark):
    good = ["the sea is calm and the day is long"] * 3 + ["a walk in the park with old friends"] * 3
    rows = [(i, good[i % 6] if i % 2 else good[i % 6] + " you rotten scoundrel go away", "s", "x", "y") for i in range(1, 80)]
    edge = [(100, None, None, None, None), (101, "", None, None, None), (102, "rotten scoundrel " * 20000, None, None, None), (None, "calm sea", None, None, None), (1, rows[0][1], "s", "", "")]
    labels = spark.createDataFrame([(i, int(i % 2 == 0), 9) for i in range(1, 80)] + [(None, 1, 9), (5, None, 9)], "doc_id long, toxic int, text int")
    return spark.createDataFrame(rows + edge, SCHEMA), labels, len(rows) + len(edge)


def test_edges(spark):
    docs, labels, n = small(spark)
    got = toxicity.score(docs, labels).collect()
    assert len(got) == n
    by = {r.doc_id: r for r in got}
    assert by[102].predicted == 1 and by[101].predicted == 0 and by[100].score == by[101].score
    kept = toxicity.clean(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if not r.predicted}


def test_no_labels_and_no_documents(spark):
    docs, labels, n = small(spark)
    assert {r.score for r in toxicity.score(docs, labels.limit(0)).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), labels).count() == 0


def plain_score(net, text):
    """The forward pass a word at a time, in double precision, from each word's own n-grams."""
    p = {k: v.astype(float) for k, v in net.p.items()}
    sig = lambda x: 1 / (1 + np.exp(-x))
    size, words, logits = gru.HIDDEN, [toxicity.normal(w) for w in toxicity.steps(text)], []
    for begin in range(0, max(1, len(words) - toxicity.WINDOW + toxicity.STRIDE), toxicity.STRIDE):
        inputs = []
        for w in words[begin : begin + toxicity.WINDOW]:
            inputs.append(p["word"][net.words.get(w, len(net.words))] + p["gram"][gru.grams([w])[0]].mean(0))
        states = {}
        for side in "fb":
            h, own = np.zeros(size), []
            for x in inputs if side == "f" else inputs[::-1]:
                a, b = x @ p[f"x{side}"] + p[f"c{side}"], h @ p[f"u{side}"]
                z, r = sig(a[:size] + b[:size]), sig(a[size : 2 * size] + b[size : 2 * size])
                h = z * h + (1 - z) * np.tanh(a[2 * size :] + r * b[2 * size :])
                own.append(h)
            states[side] = own if side == "f" else own[::-1]
        both = [np.concatenate(x) for x in zip(states["f"], states["b"], strict=True)]
        strength = [np.exp(np.tanh(h @ p["attend"]) @ p["query"]) for h in both]
        pooled = sum((s * h for s, h in zip(strength, both, strict=True)), np.zeros(2 * size)) / (sum(strength) or 1)
        logits.append(pooled @ p["out"] + p["bias"][0])
    return sig(max(logits))


def test_scores_by_brute_force():
    rng = np.random.default_rng(3)
    net = gru.Network({"idiot": 0, "thing": 1, "ein": 2})
    net.p["bias"][0] = -0.7
    vocabulary = ["Idiot!", "thing", "ein", "Loweiä", "x" * 90, "---", "a/b", "thing,thing"]
    texts = ["", None, " \n ", "thing"] + [" ".join(rng.choice(vocabulary, n)) for n in (2, 47, 48, 49, 83, 84, 85, 300)]
    scorer = toxicity.Scorer(net)
    want = [plain_score(net, t) for t in texts]
    assert np.allclose(scorer.score(texts), want, atol=1e-5) and np.allclose(scorer.score(texts[::-1]), want[::-1], atol=1e-5)
    assert len(set(np.round(want, 4))) > 6
