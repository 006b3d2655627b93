import zlib
from collections import defaultdict

import numpy as np
from quire.llm import packing as P
from tokenizers import Tokenizer

DOCS = "doc_id long, text string, length long"
ODD = ["", "a", "don't stop  now\n\n\n  x\t y", " lead", "trail ", "\n", "  ", "x\x00 y\n z", "é à  b 　 c", "日本語テキスト " * 9, "a" * 3000, "12 345,6 <|endoftext|> z", "tab\there\r\nnext \r\n q", "x\x1c y\x1d\nz", "'s 't it's we'll\n's", "word$$$ word. word's. a1!! 1!! é, <x> don't... (a) " + "b" * 300 + ". " + "b" * 300 + " " + "b" * 300 + "$$"]


def test_ids_equal_the_tokenizer(spark):
    whole = Tokenizer.from_file(P.default_tokenizer())
    whole.encode_special_tokens = True
    texts = ODD + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    got = P.Encoder(P.default_tokenizer()).encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [whole.encode(t, add_special_tokens=False).ids for t in texts]
    long = " ".join(texts)
    encoder = P.Encoder(P.default_tokenizer())
    small = [np.frombuffer(y, "<u4") for part in P.slices(long, 1000) for y in encoder.encode([part])]
    assert np.concatenate(small).tolist() == whole.encode(long, add_special_tokens=False).ids


def test_sequences(spark):
    texts = [*ODD, None, *["w " * k for k in range(1, 4000, 97)], *["same text here"] * 300]
    df = spark.createDataFrame([(i if i % 7 else None, t, 1) for i, t in enumerate(texts)], DOCS).repartition(5)
    rows = P.pack(P.pieces(df)).collect()
    assert sum(r.length for r in rows if r.start == 0 or r.length) == sum(r.doc_tokens for r in rows if r.start == 0)
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
        assert len(r.ids) == 4 * r.length and r.start % P.SIZE == 0
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= P.SIZE
    assert len(by) < 1.25 * sum(r.length for r in rows) / P.SIZE + 2
    assert zlib.crc32(np.array([1], "<u4").tobytes()) in {zlib.crc32(bytes(r.ids)) for r in rows}
    assert P.pack(P.pieces(df.limit(0))).count() == 0


def test_histogram_packing():
    histogram = {5: 3, 3: 4, 2: 2, 1: 5}
    patterns = P.shortest_pack_first(histogram, 8)
    seen = defaultdict(int)
    for lengths, packs in patterns:
        assert sum(lengths) <= 8
        for x in lengths:
            seen[x] += packs
    assert dict(seen) == histogram
    assert sum(n for _, n in patterns) == 5


def test_patterns_against_one_by_one():
    """Placing piece by piece, longest first, into the pack with the most room leaves the same rooms, however ties fall."""
    rng = np.random.default_rng(3)
    for size, most in ((8, 20), (50, 9), (300, 40)):
        for _ in range(20):
            histogram = {int(x): int(rng.integers(1, most)) for x in rng.integers(1, size + 1, 12)}
            rooms = []
            for length in sorted((x for x, n in histogram.items() for _ in range(n)), reverse=True):
                best = max(range(len(rooms)), key=rooms.__getitem__, default=None)
                if best is None or rooms[best] < length:
                    rooms.append(size - length)
                else:
                    rooms[best] -= length
            assert sorted(rooms) == sorted(size - sum(p) for p, n in P.shortest_pack_first(histogram, size) for _ in range(n))


def test_query_over_repeats_ties_and_a_long_text(spark, tmp_path):
    texts = ["same text"] * 40 + [None, "", "x y " * 300_000]
    spark.createDataFrame([(k // 2, t, "extra") for k, t in enumerate(texts)], "doc_id long, text string, start string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = P.op8_packing(spark, str(tmp_path)).collect()
    assert sum(r.start == 0 for r in rows) == len(texts)
    assert sum(r.length for r in rows) == sum(r.doc_tokens for r in rows if r.start == 0)
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
