import hashlib
import random

import numpy as np
import pytest
from quire.llm import suffix_dedup as S

DOCS = "doc_id long, text string, raw int, block string"


def brute(docs, length=S.LENGTH):
    out = []
    data = [(i, (t or "").encode()) for i, t in docs]
    least = {}
    for i, b in data:
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            key = S.NO_ID if i is None else i
            least[w] = min(least.get(w, key), key)
    for i, b in data:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if least[b[p : p + length]] < (S.NO_ID if i is None else i):
                gone[p : p + length] = b"\1" * length
        runs = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(7)
    say = lambda n, letters="abcdefghij klm éü日": "".join(rng.choice(letters) for _ in range(n))
    passages = [say(n) for n in (49, 50, 51, 80, 200, 400)]
    docs = [(i, say(rng.randrange(200)) + rng.choice(passages) + say(rng.randrange(90)) + rng.choice(passages)) for i in range(40)]
    docs += [(i + 100, t) for i, t in docs[:6]] + [(i + 200, t[:60] + "x" + t[61:]) for i, t in docs[:6]]
    docs += [(300, None), (301, ""), (302, "a" * 300), (303, "a" * 49), (304, "b" + "a" * 120 + "b"), (None, passages[5]), (None, docs[3][1]), (7, docs[7][1]), (7, "y" + docs[9][1])]
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize(("block", "hot"), [(1 << 20, 4096), (900, 2)])
def test_against_brute_force(spark, block, hot, monkeypatch):
    docs = corpus()
    df = spark.createDataFrame([(i, t, 1, "b") for i, t in docs], DOCS).repartition(3)
    got = [(r.doc_id, r.n_bytes, r.n_bytes - len(r.kept), len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in S.remove_repeats(df, block=block, hot=hot).collect()]
    assert sorted(got, key=str) == brute(docs)


def test_empty(spark):
    assert S.remove_repeats(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("sigma", [1, 2, 6])
def test_collection_groups(sigma):
    rng = np.random.default_rng(sigma)
    lengths = rng.integers(4, 12, 60)
    rows = np.where(np.arange(12) < lengths[:, None], rng.integers(0, sigma, (60, 12)), 0).astype(np.uint8)
    rows[30:40], lengths[30:40] = rows[:10], lengths[:10]
    got = S.collection_groups(rows, lengths, 4)
    strings = [bytes(r[:n]) for r, n in zip(rows, lengths, strict=True)]
    windows = [s[p : p + 4] for s in strings for p in range(len(s) - 3)]
    names = {}
    assert len(windows) == len(got)
    assert all(names.setdefault(w, g) == g for w, g in zip(windows, got.tolist(), strict=True))
    assert len(set(names.values())) == len(names)
