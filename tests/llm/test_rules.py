import random
import re

import numpy as np
from quire.llm import rules as R
from quire.llm import suffixes as S

DOCS = "doc_id long, text string, n_words string"


def brute(text):
    t = text or ""
    w = re.findall(r"[^ \t-\r]+", t)
    n = len(w)

    def longest(p):
        return max((next((k for k in range(n - max(p, q) + 1) if max(p, q) + k >= n or w[p + k] != w[q + k]), 0) for q in range(n) if q != p), default=0)

    reach = [longest(p) for p in range(n)]

    def cover(least):
        return len({p + k for p in range(n) if reach[p] >= least for k in range(reach[p])})

    lines = t.split("\n")
    dup = sum(1 for k, x in enumerate(lines) if re.search(r"[^ \t-\r]", x) and x in lines[:k])
    windows = [tuple(w[i : i + 5]) for i in range(n - 4)]
    rep = len({i + k for i, x in enumerate(windows) if windows.count(x) > 1 for k in range(5)})
    assert rep == cover(5)
    failed = n < 10 or 100 * rep > 20 * n
    fine = cover(R.REPEAT) / max(n, 1) <= R.MOST_COVERED and max(reach, default=0) <= R.LONGEST
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, rep, failed, not failed and fine, max(reach, default=0)


def test_against_brute_force(spark):
    rng = random.Random(2)
    base = " ".join(rng.choice("abcdefghijklmnop") + str(rng.randrange(9)) for _ in range(70))
    texts = [None, "", "   ", "a", "a a a a a a a a a a a a", base, base + " x " + base[:60], base + "\n" + base, "é# ü$|\nline one\nline one\n \n \n\nline one <b>", "  x y \x1c z", *[" ".join(rng.choice("abc") for _ in range(rng.randrange(40))) for _ in range(25)]]
    df = spark.createDataFrame([(i if i else None, t, "z") for i, t in enumerate(texts)], DOCS).repartition(3)
    got = {r.doc_id or 0: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept, r.longest_repeat) for r in R.judged(df).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}
    assert R.judged(df.limit(0)).count() == 0


def test_suffix_order_and_prefixes():
    rng = np.random.default_rng(3)
    for size, sigma in ((1, 1), (2, 1), (60, 1), (300, 2), (300, 9)):
        s = rng.integers(1, sigma + 1, size)
        s[-1] = 0
        levels = []
        order = S.suffix_order(s, levels)
        want = sorted(range(size), key=lambda i: s[i:].tolist())
        assert order.tolist() == want
        shared = [0] + [next(k for k in range(size) if s[a + k] != s[b + k] or s[a + k] == 0) for a, b in zip(want, want[1:], strict=False)]
        assert S.common_prefixes(order, levels).tolist() == shared
