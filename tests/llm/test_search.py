"""Ranked search against brute force: ties, repeats, nulls, long texts, several blocks, clashing columns; recall is exact."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from quire.llm import queries, search

RNG = random.Random(11)
WORDS = ["".join(RNG.choice("abcdefghij") for _ in range(RNG.randint(1, 6))) for _ in range(400)]
SAY = lambda n: " ".join(RNG.choice(WORDS[: RNG.choice((20, 400))]) for _ in range(n))
COPY = SAY(25)
DOCS = [(k, SAY(RNG.randint(1, 60))) for k in range(300)] + [(1000 + k, COPY) for k in range(60)]
DOCS += [(5, "Again AGAIN again"), (5, "Again AGAIN again"), (None, COPY), (2**60 + 1, COPY + " rare"), (7000, None), (7001, ""), (7002, "?! -- \x00"), (7003, SAY(30_000)), (7004, "Ünï ünï ß 日本 K k"), (7005, "x" * 50_000)]
ITEMS = [(k, SAY(RNG.randint(1, 30))) for k in range(40)] + [(100, COPY), (100, COPY), (None, "again"), (101, None), (102, ""), (103, "nowhere-tobefound"), (104, "Ünï ÜNÏ 日本"), (105, "rare rare again"), (106, SAY(3000))]


def brute(docs, items, top=20):
    words = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").encode().lower())
    bags = [(d, Counter(words(t))) for d, t in docs]
    many, total = sum(bool(c) for _, c in bags), sum(sum(c.values()) for _, c in bags)
    df = Counter(t for _, c in bags for t in c)
    out = []
    for item, text in items:
        scored = []
        for doc, c in bags:
            m = 100 - 25 + 25 * sum(c.values()) * many // max(total, 1)
            s = sum(math.floor(1000 * math.log((2 * many + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in words(text) if c[t])
            if s > 0:
                scored.append((-s, doc is None, doc))
        out += [(str(item), rank + 1, d, -s) for rank, (s, _, d) in enumerate(sorted(scored)[:top])]
    return sorted(out, key=str)


def frames(spark, docs, items):
    return (
        spark.createDataFrame([(i, t, 1, b"", "w") for i, t in docs], "doc_id long, text string, row int, sketch binary, n string"),
        spark.createDataFrame([(i, t, 1, "x") for i, t in items], "item_id long, text string, item int, term string"),
    )


def told(df):
    return sorted(((str(r.item_id), r.rank, r.doc_id, r.score) for r in df.collect()), key=str)


@pytest.mark.parametrize("rows, bound, top", [(1024, 8 << 20, 20), (16, 40_000, 20), (7, 1, 3)])
def test_against_brute_force(spark, monkeypatch, rows, bound, top):
    monkeypatch.setattr(search, "ROWS", rows)
    monkeypatch.setattr(search, "BLOCK_BYTES", bound)
    items = ITEMS if bound > 1 else ITEMS[:6]
    assert told(search.search(*frames(spark, DOCS, items), top)) == brute(DOCS, items, top)


def test_bounds_are_never_below_scores(spark):
    docs, items = frames(spark, DOCS[:80], ITEMS[:12])
    size = search.statistics(docs)
    index = search.build_index(docs, size)
    asked = search._asked(items, index).collect()
    block = search.Block(asked, *size)
    for r in index.collect():
        bound = block.bounds([bytes(r["sketch"])])[0]
        impacts = block.impacts([bytes(t) for t in r["terms"]], np.array(r["counts"]), r["n"])
        scores = [block.score(k, impacts) for k in range(len(block.items))]
        assert all(b >= s for b, s in zip(bound, scores, strict=True)) and sum(scores) > 0


def test_query_and_empty_tables(spark, tmp_path):
    docs, items = frames(spark, DOCS, ITEMS)
    docs.write.parquet(f"{tmp_path}/documents.parquet"), items.write.parquet(f"{tmp_path}/benchmark.parquet")
    assert told(queries.queries()["op12_ranked_search"](spark, str(tmp_path))) == brute(DOCS, ITEMS)
    assert search.search(docs.limit(0), items).collect() == [] and search.search(docs, items.limit(0)).collect() == []
    assert search.search(docs.where("text is null or text = ''"), items).collect() == []
