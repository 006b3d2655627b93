"""The registered queries over one small set of tables: nulls, empty and very long texts, ties, repeated rows, clashing columns."""

import hashlib
import random
import re

import pytest
import xxhash
from quire.llm import queries
from test_suffix_dedup import brute

RNG = random.Random(17)
WORDS = ["".join(RNG.choice("abcdefgh") for _ in range(RNG.randint(2, 7))) for _ in range(900)]
SAY = lambda n: " ".join(RNG.choice(WORDS) for _ in range(n))
PASSAGE = SAY(40)
LONG = SAY(220_000)
DOCS = [(1, SAY(60)), (2, SAY(30) + " " + PASSAGE), (3, PASSAGE + "\n" + SAY(20)), (4, ""), (5, None), (6, LONG), (7, "Two words"), (7, "Two words"), (8, "x " * 40), (9, LONG[:5000] + " tail"), (None, PASSAGE), (11, "Ünï " + PASSAGE.upper())]
ITEMS = [(1, PASSAGE), (2, "two WORDS"), (3, None), (4, ""), (5, "never seen anywhere")]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(i, t, 1, "s", "k") for i, t in DOCS], "doc_id long, text string, id long, word string, kept string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, t, "x") for i, t in ITEMS], "item_id long, text string, words string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def run(spark, tables, name):
    return queries.queries()[name](spark, tables).collect()


def split(text, pattern=rb"[^\x20\x09-\x0D]+"):
    return re.findall(pattern, (text or "").encode().lower())


def test_rules(spark, tables):
    got = sorted((r.doc_id is None, r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in run(spark, tables, "op5_quality_rules"))
    want = []
    for i, t in DOCS:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        seen, hit = {}, set()
        for k in range(len(words) - 4):
            seen.setdefault(tuple(words[k : k + 5]), []).append(k)
        for places in seen.values():
            if len(places) > 1:
                hit.update(p + d for p in places for d in range(5))
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want.append((i is None, i, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(hit), len(words) < 10 or 100 * len(hit) > 20 * len(words)))
    assert got == sorted(want)


def test_simhash(spark, tables):
    def fingerprint(t):
        words = split(t)
        grams = [b" ".join(words[k : k + 4]) for k in range(len(words) - 3)] or ([b" ".join(words)] if words else [])
        h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    prints = [fingerprint(t) for _, t in DOCS]
    root = list(range(len(DOCS)))
    for a in range(len(DOCS)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 4 and root[a] != root[b]:
                root = [root[b] if r == root[a] else r for r in root]
    least = {r: min((DOCS[k][0] for k in range(len(DOCS)) if root[k] == r and DOCS[k][0] is not None), default=None) for r in root}
    want = sorted(((DOCS[k][0] or 0), f"{prints[k]:016x}", least[root[k]] or 0) for k in range(len(DOCS)))
    assert sorted((r.doc_id or 0, r.fingerprint, r.component_id or 0) for r in run(spark, tables, "op6_simhash_near_dedup")) == want


def test_suffix_dedup(spark, tables):
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in run(spark, tables, "op9_suffix_array_dedup")]
    assert sorted(got, key=str) == brute(DOCS)


def test_decontamination(spark, tables):
    words = lambda t: split(t, rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    asked = {}
    for item, t in ITEMS:
        w = words(t)
        for k in range(max(len(w) - 9, 1) if w else 0):
            asked.setdefault(tuple(w[k : k + 10]), set()).add(item)
    want = []
    for i, t in DOCS:
        w, hit, items = words(t), set(), set()
        for n in {len(x) for x in asked}:
            for k in range(len(w) - n + 1):
                if (found := asked.get(tuple(w[k : k + n]))) is not None:
                    hit.update(range(k, k + n))
                    items |= found
        want.append((i or 0, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest(), bool(hit)))
    got = [(r.doc_id or 0, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in run(spark, tables, "op10_benchmark_decontamination")]
    assert sorted(got) == sorted(want)


def test_every_row_is_rated_and_counted(spark, tables):
    assert len(run(spark, tables, "op3_quality_classifier")) == len(DOCS)
    assert len(run(spark, tables, "op7_token_counts")) == len(DOCS)
