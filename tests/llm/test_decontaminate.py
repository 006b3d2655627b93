import re

import numpy as np
import pytest
from quire.llm import decontaminate as D

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items, window=10):
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for item, t in items:
            i = words(t)
            n = min(window, len(i))
            for a in range(len(i) - n + 1) if i else ():
                for b in range(len(w) - n + 1):
                    if w[b : b + n] == i[a : a + n]:
                        hit.update(range(b, b + n))
                        found.add(item)
        out.append((doc_id, len(w), tuple(sorted(hit)), tuple(sorted(found))))
    return sorted(out, key=str)


ITEM = "One fish two fish red fish blue fish this one has a little star and Ünï çödé"
ITEMS = [(1, ITEM), (2, "short item, four words"), (3, None), (4, "!!!"), (None, "red"), (2, "short item four words"), (5, ITEM + " more")]
TEXTS = [
    None, "", "nothing here", "SHORT-item: four words; short item four words", "x short item four", ITEM, "lead in " + ITEM.upper().replace(" ", ", ") + " tail",
    "one fish two fish red fish blue fish this", "a b c " * 50 + ITEM + " " + ITEM + " fish" * 30, "one fish two fish red fish blue fish this one fish two fish red fish blue fish this one has",
]


@pytest.mark.parametrize(("shard", "block"), [(500_000, 1000), (7, 3)])
def test_against_brute_force(spark, shard, block):
    docs = [(i, t) for i, t in enumerate(TEXTS)] + [(None, ITEM), (5, ITEM)]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in docs], DOCS)
    items = spark.createDataFrame([(i, t, 7) for i, t in ITEMS], "item_id long, text string, n_words int")
    got = [(r.doc_id, r.n_words, tuple(k for s in r.spans for k in range(s.start, s.start + s.length)), tuple(sorted(r["items"]))) for r in D.find(df, items, shard=shard, block=block).collect()]
    assert sorted(got, key=str) == brute(docs, [x for x in ITEMS if x[0] is not None])
    clean = {(r.doc_id, r.text, r.n_chars) for r in D.decontaminate(df, items, shard=shard, block=block).collect()}
    assert {(2, "nothing here", None), (0, None, None), (6, "lead in , ÜNÏ, ÇÖDÉ tail", 24), (5, "", 0)} <= clean and len(clean) == len(docs) - 1


def test_empty_tables(spark):
    none, items = spark.createDataFrame([], DOCS), spark.createDataFrame([], "item_id long, text string")
    assert D.find(none, items).count() == 0
    assert [r.spans for r in D.find(spark.createDataFrame([(1, "a b", None, None, None)], DOCS), items).collect()] == [[]]


def test_index_finds_all_places():
    rng = np.random.default_rng(1)
    text = rng.integers(0, 4, 400)
    text[-1] = 0
    index = D.FMIndex(text, 3)
    phrases = np.array([[a, b, c] for a in (1, 2, 3) for b in (1, 2, 3) for c in (1, 2, 3)], np.int32)
    which, lo, hi = index.search(phrases, np.full(len(phrases), 3))
    for p, a, b in zip(which, lo, hi, strict=True):
        want = [i for i in range(398) if (text[i : i + 3] == phrases[p]).all()]
        assert sorted(index.locate(np.arange(a, b))) == want
    assert set(which) == {k for k, p in enumerate(phrases) if any((text[i : i + 3] == p).all() for i in range(398))}
