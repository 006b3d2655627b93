import math
import random

import numpy as np
from quire.llm import quality as Q

DOCS = "doc_id long, text string, kept string"


def corpus(n, seed):
    rng = random.Random(seed)
    plain = ["".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    rows = []
    for i in range(n):
        grade = rng.choice([0, 1, 2, 2])
        words = [rng.choice(plain) for _ in range(rng.randint(20, 120))]
        if grade == 0:
            for _ in range(len(words) // 15 + 1):
                words[rng.randrange(len(words))] = rng.choice(["zork", "zarkle", "zimbo"])
        if grade == 1:
            words = [w.upper() + "!!" for w in words]
        rows.append((i, " ".join(words), grade))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus(900, 1)
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows], DOCS)
    labels = spark.createDataFrame([(i, int(g == 2), int(g == 0)) for i, _, g in rows if i % 3], "doc_id long, quality int, toxic int")
    model = Q.train(docs, labels, sample=500)
    assert (np.diff(model.thresholds) >= 0).all()
    got = {r.doc_id: r for r in Q.rate(docs, model).collect()}
    held = [(i, g) for i, _, g in rows if i % 3 == 0]
    assert np.mean([got[i].kept == (g == 2) for i, g in held]) > 0.95
    mean = [np.mean([got[i].expected_grade for i, g in held if g == k]) for k in range(3)]
    assert mean == sorted(mean)
    kept = Q.select_good(docs, labels)
    assert kept.columns == docs.columns and {r.kept for r in kept.collect()} == {"x"}


def test_gradient_matches_differences():
    at, s, eps = np.array([-0.5, 0.8]), 0.3, 1e-6

    def log_p(y, score):
        below = np.concatenate([[0], Q._sigmoid(at - score), [1]])
        return np.log(below[y + 1] - below[y])

    for y in range(3):
        below = np.concatenate([[0], Q._sigmoid(at - s), [1]])
        assert abs((log_p(y, s + eps) - log_p(y, s - eps)) / (2 * eps) - (below[y + 1] + below[y] - 1)) < 1e-5


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (None, "word", "c"), (1, "w " * 20000, "d")], DOCS)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = Q.train(docs, none)
    assert [r.kept for r in Q.rate(docs, model).collect()] == [True] * 4
    labels = spark.createDataFrame([(1, None, None), (2, None, 1), (None, 1, 0), (1, 1, 0), (1, 0, None)], "doc_id long, quality int, toxic int")
    assert {r.doc_id: r.grade for r in Q.graded(labels).collect()} == {1: 1, 2: 0}
    assert Q.select_good(docs, labels).count() <= 4
    assert Q.rate(docs.limit(0), model).count() == 0


def test_fit_against_numerical_gradients():
    """The fit, step by step, with gradients taken as differences of the likelihood that its docstring names."""
    rng = np.random.default_rng(2)
    rows = [(np.sort(rng.choice(6, 3, replace=False)).astype(np.int32), rng.random(3).astype(np.float32)) for _ in range(12)]
    grades = np.array([0, 1, 2, 2, 1, 0, 2, 1, 0, 2, 2, 1])
    got = Q.fit(rows, grades, epochs=2, batch=4)
    share = np.bincount(grades, minlength=Q.GRADES)
    weight = (len(rows) / (Q.GRADES * share)) ** 0.5
    sigmoid = lambda x: 1 / (1 + math.exp(-x))

    def loss(w, at, pick):
        total = 0.0
        for i in pick:
            s = sum(w[k] * v for k, v in zip(*rows[i], strict=True))
            cut = [0.0, *[sigmoid(t - s) for t in at], 1.0]
            total -= weight[grades[i]] * math.log(cut[grades[i] + 1] - cut[grades[i]])
        used = sorted({int(k) for i in pick for k in rows[i][0]})
        return total / len(pick) + 1e-4 / 2 * sum(w[k] ** 2 for k in used), used

    w, squares = np.zeros(6), np.full(6, 1e-3)
    at, at_squares = np.linspace(-1, 1, Q.GRADES - 1), np.full(Q.GRADES - 1, 1e-2)
    order = np.random.default_rng(5)
    for _ in range(2):
        every = order.permutation(len(rows))
        for k in range(0, len(every), 4):
            pick = every[k : k + 4]
            step = lambda x, j: np.where(np.arange(len(x)) == j, 1e-5, 0)
            gw = [(loss(w + step(w, j), at, pick)[0] - loss(w - step(w, j), at, pick)[0]) / 2e-5 for j in range(6)]
            ga = np.array([(loss(w, at + step(at, j), pick)[0] - loss(w, at - step(at, j), pick)[0]) / 2e-5 for j in range(len(at))])
            for j in loss(w, at, pick)[1]:
                squares[j] += gw[j] ** 2
                w[j] -= 0.3 * gw[j] / squares[j] ** 0.5
            at_squares += ga**2
            at = np.sort(at - 0.3 * ga / at_squares**0.5)
    assert np.allclose(got.weights[:6], w, atol=1e-4) and np.allclose(got.thresholds, at, atol=1e-4)


def test_a_worker_holds_one_operators_cache():
    """Workers live on from packing to the classifier of the next run; the caches of both would lie in them together."""
    import gc
    import weakref

    from quire.llm import packing

    held = weakref.ref(packing.encoder(packing.default_tokenizer()))
    assert held() is packing.encoder(packing.default_tokenizer())
    Q.features("some words")
    gc.collect()
    assert held() is None


def test_features_of_the_fit_come_a_few_at_a_time(spark, monkeypatch):
    """The model is the same, however many rows' features are made together."""
    rows = corpus(60, 3)
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows], DOCS).repartition(2)
    labels = spark.createDataFrame([(i, int(g == 2), int(g == 0)) for i, _, g in rows], "doc_id long, quality int, toxic int")
    whole = Q.train(docs, labels)
    monkeypatch.setattr(Q, "ROWS", 7)
    parts = Q.train(docs, labels)
    assert np.array_equal(whole.weights, parts.weights) and np.array_equal(whole.thresholds, parts.thresholds)
