"""Chunked encoding against the tokenizer's own, over small chunks, hostile texts, nulls, repeats and clashing columns."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from quire.llm import bpe, queries

RNG = random.Random(5)
SAY = lambda n: " ".join("".join(RNG.choice("abcdefgéß") for _ in range(RNG.randint(1, 9))) for _ in range(n))
CHUNK, OVERLAP = 40, 9
TEXTS = [
    "", None, "Two words", "a" * 500, " " * 333, "\n \n" * 60 + "x", "'" * 120 + "s", "it's we'll they're I'd've '' 'll" * 20, "a" * 39 + "'re" + "b" * 39 + "'ll" + "c" * 200,
    "x" * 38 + "  " + "y" * 38 + "  \n " + "z" * 60, "1234567890" * 30, "!?'s!?" * 50, "".join(chr(RNG.randrange(1, 0x3000)) for _ in range(700)), "𝒳😀ा" * 90, " 　 \x85\x1c\x1f" * 40, "\U000107bb՘࢏" * 50,
    SAY(200), SAY(30), "a b " * 100 + "q" * 150 + " c" * 60, ("w" * 100 + " ") * 5, "tail" + " " * 90,
]


@pytest.fixture(scope="module")
def encoding():
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def want(encoding, rows):
    out = []
    for doc, text in rows:
        ids = encoding.encode_ordinary(text or "")
        out.append((doc is None, doc, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out)


def told(df):
    return sorted((r.doc_id is None, r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in df.collect())


ROWS = [(None if k == 3 else 2**60 + k // 2, t) for k, t in enumerate(TEXTS)]


@pytest.mark.parametrize("chunk, overlap", [(CHUNK, OVERLAP), (7, 3), (64, 40)])
def test_any_chunk_gives_the_ids_of_the_whole_text(spark, encoding, chunk, overlap):
    docs = spark.createDataFrame([(i, t, 1, "r", b"x") for i, t in ROWS], "doc_id long, text string, row int, piece string, ids binary")
    made = bpe.encode(docs, chunk=chunk, overlap=overlap)
    assert told(bpe.digests(made)) == want(encoding, ROWS)
    back = bpe.decode(made).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("piece", "data"))).alias("p")).collect()
    assert sorted(b"".join(bytes(p["data"]) for p in r["p"]) for r in back) == sorted((t or "").encode() for _, t in ROWS)


def test_texts_are_cut_and_stitched_in_several_places(spark):
    docs = spark.createDataFrame([(1, SAY(300)), (2, "a" * 900)], "doc_id long, text string")
    pieces = {r["doc_id"]: r["n"] for r in bpe.encode(docs, chunk=CHUNK, overlap=OVERLAP).groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert pieces[1] > 20 and pieces[2] == 1


def test_query_over_long_and_runaway_texts(spark, tmp_path, encoding):
    rows = [(1, SAY(40_000)), (1, SAY(40_000)), (2, "é" * 70_000 + " end"), (3, SAY(3)), (4, None), (None, "ab'll " * 9000)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert told(queries.queries()["op11_byte_level_bpe"](spark, str(tmp_path))) == want(encoding, rows)
    runaway = " " * 1_000_000 + "x"
    got = told(bpe.digests(bpe.encode(spark.createDataFrame([(9, runaway)], "doc_id long, text string"))))
    assert got[0][4] == hashlib.sha256(runaway.encode()).hexdigest()


def test_classes_are_those_of_the_encoder(encoding):
    own = bpe.codec(bpe.default_ranks())
    for code in [*range(0x2100), *range(0xA700, 0xA800), *range(0x10700, 0x10980), 0x3FC36]:
        text = "ab'" + chr(code) + "9 " + chr(code) + chr(code) + " '" + chr(code) + "s"
        ends = own.ends(text)
        ids = [t for a, b in zip([0, *ends], ends, strict=False) for t in encoding._core_bpe.encode_single_piece(text[a:b].encode())]
        assert ids == encoding.encode_ordinary(text), hex(code)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.digests(bpe.encode(docs)).collect() == []
    with pytest.raises(ValueError):
        bpe.encode(docs, chunk=4, overlap=4)
    assert np.uint32 == bpe.codec(bpe.default_ranks()).encode("x").dtype
