import random

from quire.llm import token_counts as T

DOCS = "doc_id long, text string, n_tokens string"


def brute(model, token):
    best = [(0.0, 0)]
    for end in range(1, len(token) + 1):
        alone = len(token[end - 1].encode())
        options = [(best[end - 1][0] + T.BYTE_COST * alone, best[end - 1][1] + alone)]
        options += [(best[a][0] + model.costs[token[a:end]], best[a][1] + 1) for a in range(max(0, end - model.longest), end) if token[a:end] in model.costs]
        low = min(c for c, _ in options)
        best.append((low, min(n for c, n in options if c <= low + 1e-9)))
    return best[-1][1]


def test_against_brute_force(spark):
    model = T.Unigram.load(T.default_vocabulary())
    rng = random.Random(5)
    texts = [None, "", " \n ", "The quick brown fox", "日本語 🎈🎈x é", "a" * 5000, "ß𝄞" * 40, *[" ".join("".join(rng.choice("abcdeorstinü") for _ in range(rng.randrange(1, 14))) for _ in range(60)) for _ in range(20)]]
    texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(20).collect()]
    df = spark.createDataFrame([(i, t, "q") for i, t in enumerate(texts)], DOCS).repartition(3)
    got = {r.doc_id: (r.n_pre_tokens, r.n_distinct, r.n_tokens) for r in T.token_counts(df).collect()}
    for i, t in enumerate(texts):
        words = T.pre_tokens(t)
        assert got[i] == (len(words), len(set(words)), sum(brute(model, w) for w in words))
    assert T.token_counts(df.limit(0)).count() == 0


def test_ties_and_own_costs():
    model = T.Unigram({"a": 1.0, "b": 1.0, "ab": 2.0, "c": 1.0, "abc": 3.0})
    assert model.count(["ab", "abc", "", "ba", "abab"]).tolist() == [1, 1, 0, 2, 2]
