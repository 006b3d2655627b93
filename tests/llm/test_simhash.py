import numpy as np
import xxhash
from quire.llm import simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def rows(*texts):
    return [(i, t, None, None, None) for i, t in enumerate(texts)]


def brute(docs, radius=4):
    def fp(text):
        w = (text or "").encode().lower().split()
        shingles = [w[i : i + 4] for i in range(len(w) - 3)] if len(w) >= 4 else ([w] if w else [])
        h = [xxhash.xxh64_intdigest(b" ".join(s), 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fps = [(i, fp(t)) for i, t in docs]
    comp = {i: i for i, _ in fps}
    changed = True
    while changed:
        changed = False
        for i, f in fps:
            for j, g in fps:
                if (f ^ g).bit_count() <= radius and comp[j] < comp[i]:
                    comp[i], changed = comp[j], True
    return {i: (f, comp[i]) for i, f in fps}


def test_against_brute_force(spark):
    base = "the quick brown fox jumps over the lazy dog and runs far away from here " * 3
    words = base.split()
    texts = [base, base.upper(), " ".join(words[:-1] + ["now"]), "", None, "one", "one  ONE\tx", "   ", *[f"t{i} u{i % 3} v w x y" for i in range(30)], base + " zz " * 2]
    made = rows(*texts)
    got = {r.doc_id: (np.int64(r.fp).astype(np.uint64).item(), r.component_id) for r in simhash.near_duplicates(spark.createDataFrame(made, DOCS), tile=4).collect()}
    assert got == brute([(i, t) for i, t, *_ in made])


def test_forest_links_like_all_pairs():
    rng = np.random.default_rng(0)
    seeds = rng.integers(0, 2**63, 5, dtype=np.uint64)
    a = np.unique(np.concatenate([s ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) for s in seeds]))
    for left, right in ((a, None), (a[:50], a[50:])):
        u, v = simhash._forest(left, right, 4)
        assert all((int(x) ^ int(y)).bit_count() <= 4 for x, y in zip(u, v, strict=True))
        assert len(u) < len(a)
    u, v = simhash._forest(a, None, 4)
    assert len(u) == len(a) - 5


def test_empty_extra_and_repeated(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    df = spark.createDataFrame([(1, "a b c d e", 9), (1, "a b c d e", 9), (None, "a b c d e", 9), (None, "q r s t u v", 9)], "doc_id long, text string, fp int")
    got = sorted((r.doc_id or -1, r.component_id) for r in simhash.near_duplicates(df).collect() if r.component_id is not None)
    assert got == [(-1, 1), (1, 1), (1, 1)]
    assert simhash.drop_near_duplicates(df).count() == 4
