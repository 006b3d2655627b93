import math
import zlib
from collections import Counter

import numpy as np
from quire.llm import lm as L
from quire.llm import maxent as M

DOCS = "doc_id long, text string, score string"


def tokens(text):
    return (text or "").encode().lower().split() + ["end"]


def test_base_counts_and_gain(spark):
    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    docs = [(r.doc_id, r.text) for r in real] + [(10**6, None), (10**6 + 1, ""), (None, "The Of\tthe\x0b x"), (3, "a repeated id")]
    df = spark.createDataFrame([(i, t, "s") for i, t in docs], DOCS).repartition(4)
    got = {}
    for r in L.scored(df, block=100_000, bucket=10_000).collect():
        got.setdefault(r.doc_id, []).append(r)
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    count = Counter(t for i, x in docs if not held(i) for t in tokens(x))
    n, v = sum(count.values()), len(count)
    assert sum(map(len, got.values())) == len(docs)
    for i, x in docs:
        t = tokens(x)
        base = sum(math.log10((count[k] + 0.5) / (n + 0.5 * (v + 1))) for k in t)
        assert any(abs(r.base_score - base) < 1e-6 * len(t) and (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(i), len(t), sum(count[k] > 0 for k in t), n) for r in got[i])
    held_rows = [r for rs in got.values() for r in rs if r.held_out]
    assert sum(r.score for r in held_rows) > sum(r.base_score for r in held_rows)


def test_no_rows_or_no_training(spark):
    df = spark.createDataFrame([(i, "a b", None) for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 1], DOCS)
    rows = L.scored(df).collect()
    assert rows and all((r.train_tokens, r.n_known, r.base_score, r.score) == (0, 0, 0.0, 0.0) for r in rows)
    assert L.scored(df.limit(0)).count() == 0


def test_classes_of_many_words():
    words = [b"a", b"ab", b"cab", b"\n", b"\xff\xfe", bytes([7]), b"long word"]
    assert M.rare_classes(words).tolist() == [M.rare_class(w) for w in words]


def test_probabilities_sum_to_one():
    words = [b"w%d" % k for k in range(M.CLASSES * M.PER_CLASS - 1)] + [M.END]
    rng = np.random.default_rng(0)
    rare = [b"rare%d" % k for k in range(300)]
    count = Counter({w: int(n) for w, n in zip([*words, *rare], rng.integers(1, 50, len(words) + 300), strict=True)})
    n, t = np.zeros(M.RARE), np.zeros(M.RARE)
    for w in rare:
        n[M.rare_class(w) - M.CLASSES] += count[w]
        t[M.rare_class(w) - M.CLASSES] += 1
    v = M.Vocabulary(words, [count[w] for w in words], n, t, sum(count.values()), len(count))
    w = M.Weights(v)
    w.classes[:] += rng.normal(0, 1, w.classes.shape)
    w.words[:] += rng.normal(0, 1, w.words.shape)
    every = [*words, *rare]
    cls, place = v.slots(every)
    same = np.full(len(every), 99, np.uint64)
    p = 10 ** M.log_probability(w, v, cls, place, np.array([count[x] for x in every]), same, same)
    unknown = [10 ** M.log_probability(w, v, np.array([M.CLASSES + k]), np.array([-1]), np.array([0]), same[:1], same[:1])[0] for k in range(M.RARE)]
    assert abs(p.sum() + sum(unknown) - 1) < 1e-4


def plain_model(docs):
    """Training and scores in plain loops, one token at a time, from the definition alone."""
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    words = {i: t.encode().lower().split() + [M.END] for i, t in docs}
    count = Counter(w for i, ws in words.items() if not held(i) for w in ws)
    rank = sorted(count, key=lambda w: (-count[w], w))[: M.CLASSES * M.PER_CLASS]
    assert M.END in rank
    place = {w: k for k, w in enumerate(rank)}
    rare_n, rare_v = Counter(), Counter()
    for w in count.keys() - place.keys():
        rare_n[M.rare_class(w)] += count[w]
        rare_v[M.rare_class(w)] += 1
    cls_of = lambda w: place[w] % M.CLASSES if w in place else M.rare_class(w)
    prior = np.full(M.ALL, 0.5)
    within = np.full((M.CLASSES, M.PER_CLASS), -30.0)
    for w in rank:
        prior[cls_of(w)] += count[w]
        within[cls_of(w), place[w] // M.CLASSES] = math.log(count[w] + 0.5)
    for c, n in rare_n.items():
        prior[c] += n
    prior /= prior.sum()
    within -= np.log(np.exp(within).sum(axis=1, keepdims=True))
    share = np.exp(within).mean(axis=0)
    tables = [{"bias": np.log(prior)}, {("bias", c): within[c].copy() for c in range(M.CLASSES)}]
    spread, used = [prior * (1 - prior), share * (1 - share)], [Counter(), Counter()]

    def tokens(i):
        h = [np.uint64(zlib.crc32(w)) for w in words[i]]
        for k, w in enumerate(words[i]):
            b = np.array([h[k - 1] if k else 1], np.uint64)
            e = np.array([h[k - 2] if k > 1 else 1 if k else 2], np.uint64)
            c = cls_of(w)
            class_keys = [("f", int(f[0])) for f in M.class_features(b, e)] + ["bias"]
            word_keys = [("f", int(f[0])) for f in M.word_features(np.array([c]), b, e)] + [("bias", c)]
            yield w, c, [(0, class_keys, c)] + ([(1, word_keys, place[w] // M.CLASSES)] if w in place else [])

    def soft(t, keys):
        z = sum(tables[t].get(k, 0.0) for k in keys)
        p = np.exp(z - z.max())
        return p / p.sum()

    for r in range(len(M.ROUNDS)):
        g, n = [{}, {}], [Counter(), Counter()]
        for i in words:
            if not held(i) and M.round_of(zlib.crc32(str(i).encode())) == r:
                for _, _, parts in tokens(i):
                    for t, keys, outcome in parts:
                        d = -soft(t, keys)
                        d[outcome] += 1
                        for k in keys:
                            g[t][k] = g[t].get(k, 0) + d
                            n[t][k] += 1
        for t in (0, 1):
            for k, d in g[t].items():
                used[t][k] += n[t][k]
                tables[t][k] = tables[t].get(k, 0.0) + np.clip(M.RATE * d / (M.CALM + used[t][k] * spread[t]), -M.MOST, M.MOST)
    out = {}
    for i in words:
        out[i] = 0.0
        for w, c, parts in tokens(i):
            p = math.prod(soft(t, keys)[outcome] for t, keys, outcome in parts)
            if w not in place:
                p *= (count[w] + 0.5) / (rare_n[c] + 0.5 * (rare_v[c] + 1))
            out[i] += math.log10(p)
    return out


def test_scores_against_plain_loops(spark):
    rng = np.random.default_rng(8)
    vocabulary = ["".join(chr(97 + c) for c in rng.integers(0, 9, 4)) for _ in range(6000)]
    docs = [(i, " ".join(vocabulary[int(k)] for k in np.minimum(rng.zipf(1.3, 60), 6000) - 1)) for i in range(60)]
    df = spark.createDataFrame([(i, t, "s") for i, t in docs], DOCS).repartition(3)
    got = {r.doc_id: r.score for r in L.scored(df, block=2000, bucket=5000).collect()}
    want = plain_model(docs)
    # gradients travel in half precision
    assert all(abs(got[i] - want[i]) < 0.002 * abs(want[i]) for i in want)


def test_gain_does_not_depend_on_partitions(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    gains = []
    for n in (1, 8, 64):
        r = L.scored(df.repartition(n)).where("held_out").selectExpr("sum(score - base_score) / sum(n_tokens) AS g").first()
        gains.append(r.g)
    assert min(gains) > 0 and max(gains) - min(gains) < 0.05 * max(gains)


def test_query_over_a_long_text_and_repeats(spark, tmp_path):
    rows = [(1, "ab cd " * 400_000), (2, "ab cd"), (2, "ab cd"), (None, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = L.op4_lm_scoring(spark, str(tmp_path)).collect()
    assert sorted(r.n_tokens for r in got) == [1, 3, 3, 800_001]
