import duckdb
import pytest
from quire import queries
from quire.functions import filters
from quire.functions.filters import text_string
from quire.kernels import codecs
from quire.operators import objects, pages, signatures
from quire.sources.files import read_files, write_files
from quire.streaming.arrivals import count_objects, stream_files
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
QUICK = ["f5_ascii_hex", "f6_ascii85", "f3_flate", "f9_crypt", "f10_png_predictor", "f11_tiff_predictor", "f12_image_stop", "f4_lzw", "f7_run_length_chain", "f2_lenient_decode", "f8_fax", "t1_text_string", "t2_casts", "e6_permissions", "g2_byte_range", "g4_gap_binding", "g7_budget", "h5_span_lengths", "c4_inline_images", "s12_indirect_values", "s17_lost_catalogue", "s13_last_object"]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in "lineitem orders events documents embeddings".split():
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_its_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(str(tuple(r[c] for c in columns)) for r in df.collect())
    found = duck.sql(queries.SQL[name])
    assert got == sorted(str(tuple(r[found.columns.index(c)] for c in columns)) for r in found.fetchall())


#: Written by hand, not by our sink.
TYPED = b"""%PDF-1.4
1 0 obj <</Type/Catalog/Pages 2 0 R>> endobj
2 0 obj <</Type/Pages/Count 1/Kids[3 0 R 2 0 R]/MediaBox[0 0 9 9]>> endobj
3 0 obj <</Type/Page/Parent 2 0 R/Contents[4 0 R 5 0 R]>> endobj
4 0 obj <</Length 3>> stream
BT 
endstream endobj
5 0 obj <</Length 99>> stream
(x) Tj ET
endstream endobj
trailer <</Root 1 0 R/Size 6>>
"""


def test_file_without_a_table_is_repaired(spark):
    files = spark.createDataFrame([("a", bytearray(TYPED)), ("b", bytearray(b"no pdf")), ("c", None)], "file_id string, content binary")
    objs, documents = objects.opened(files)
    assert {(r.file_id, r.root, r.repaired) for r in documents.collect()} == {("a", 1, True), ("b", None, True), ("c", None, True)}
    found = pages.pages(objs, documents)
    assert [(r.file_id, r.page_no, r.num) for r in found.collect()] == [("a", 1, 3)]
    assert [r.value for r in pages.attributes(found, objs).collect()] == ["[0 0 9 9]"]
    content = pages.contents(found, objs)
    assert [bytes(r.content) for r in content.collect()] == [b"BT \n(x) Tj ET"]
    assert [r.operator for r in pages.operations(content.drop("recovered", "image")).orderBy("op_seq").collect()] == ["BT", "Tj", "ET"]


def test_text_strings(spark):
    rows = [(b"\xfe\xff\x00L\x00\xf8", "Lø"), (b"\xfe\xff\xd8=\xde\x00", "\U0001f600"), (b"\xfe\xff\x00a\x00", "a�"), (b"\xfe\xff", ""), (b"\xef\xbb\xbfa\xffb", "a�b"), (bytes(range(0x18, 0x20)), "˘ˇˆ˙˝˛˚˜"), (b"\xa0", "€"), (b"\x7f\x9f\xad", "���"), (b"plain", "plain"), (None, None)]
    df = spark.createDataFrame([(bytearray(b) if b is not None else None, t) for b, t in rows], "b binary, want string")
    assert [r.t for r in df.select(text_string(F.col("b")).alias("t"), "want").collect()] == [t for _, t in rows]


def test_byte_ranges(spark):
    big = 1 << 61
    rows = [([0, 7, 15, 5], 20, "ok"), ([0, 7, 9, 0], 9, "ok"), ([3, big, big, big], 40, "does not start at the start"), ([0, 0, 10, 5], 40, "first span empty or negative"), ([0, -2, 10, 5], 40, "first span empty or negative"), ([0, 7, 7, 5], 40, "second span before the end of the first"), ([0, 7, 8, 5], 40, "no gap"), ([0, 7, 9, -1], 40, "second span negative"), ([0, 7, 30, (1 << 63) - 9], 60, "past the end"), ([0, 7, 1 << 33, 1], 1 << 20, "past the end"), ([0, 7], 9, "not four numbers"), (None, 9, "not four numbers")]
    df = spark.createDataFrame(rows, "r array<long>, n long, want string")
    assert [r.v for r in df.select(signatures.range_verdict(F.col("r"), F.col("n")).alias("v")).collect()] == [w for *_, w in rows]


def decoded(spark, rows, name, parms="<<>>"):
    df = spark.createDataFrame([(k, bytearray(b)) for k, b in enumerate(rows)], "k int, b binary")
    return [(r.decoded.data and bytes(r.decoded.data), r.decoded.undecoded and bytes(r.decoded.undecoded), r.decoded.cause) for r in filters.decode_filter(df, F.col("b"), name, parms).orderBy("k").collect()]


def test_text_filters_at_their_edges(spark):
    assert decoded(spark, [b"6 1\n62>zz", b"7>", b">", b"61 6x", b"x"], "AHx") == [(b"ab", None, None), (b"p", None, None), (b"", None, None), (b"a", None, "hex: not a digit"), (None, b"x", "hex: not a digit")]
    assert decoded(spark, [b"zz~>", b"<~87cUR~>", b"87cURz!~>", b"uuuuv~>"], "A85") == [(bytes(8), None, None), (b"Hell", None, None), (b"Hell" + bytes(4), None, "ascii85: a lone last character"), (None, b"uuuuv~>", "ascii85: not a digit")]
    assert decoded(spark, [b"\x01\xfe\x0a\xff\xe9", b"\x80rest", b"\x03ab", b"\x00a\x90"], "RL") == [(b"\xfe\n\xe9\xe9", None, None), (b"", None, None), (b"ab", None, "run length: data ends early"), (b"a", None, "run length: data ends early")]
    assert decoded(spark, [b"616263>"], "AHx XYZ") == [(None, b"616263>", "unknown filter XYZ")]


def test_predictors_at_their_edges():
    assert codecs.predict(b"\x01\x02\x03", 15, columns=4) == (b"\x02\x05\x05\x05", None)
    assert codecs.predict(b"\x00\x07\x07\x09\x01\x01", 12, columns=2) == (b"", "predictor: no such row type")
    assert codecs.predict(b"\x00ab", 5, columns=2)[0] == b"" and codecs.predict(b"ab", 2, bits=4, columns=4)[0] == b""
    assert codecs.predict(b"ab", 15, columns=1 << 29)[0] == b""


def test_strict_decoding_refuses_what_was_recovered(spark):
    df = spark.createDataFrame([({"Filter": "[/AHx]"}, bytearray(b"6162>")), ({}, bytearray(b"raw"))], "entries map<string,string>, raw binary")
    assert [bytes(r.data) for r in filters.decode_strictly(df).collect()] == [b"ab", b"raw"]
    bad = spark.createDataFrame([({"Filter": "/AHx"}, bytearray(b"61!"))], "entries map<string,string>, raw binary")
    with pytest.raises(Exception, match="not a digit"):
        filters.decode_strictly(bad).collect()


#: Contents by way of a reference to a reference to an array, with a filter that is one too; kids and a wrong place in the table.
INDIRECT = b"""%PDF-1.3
1 0 obj <</Type/Catalog/Pages 2 0 R>> endobj
2 0 obj <</Type/Pages/Kids 7 0 R>> endobj
3 0 obj <</Type/Page/Contents 8 0 R>> endobj
4 0 obj <</Filter 10 0 R/Length 7>> stream
4254>
endstream endobj
7 0 obj [3 0 R] endobj
8 0 obj 9 0 R endobj
9 0 obj [4 0 R 11 0 R 99 0 R] endobj
10 0 obj /AHx endobj
11 0 obj <</Length 2>> stream
ET
endstream endobj
xref
1 1
0000000009 00000 n 
2 1
0000000003 00000 n 
trailer <</Root 1 0 R/Size 12>>
startxref
PLACE
%%EOF
"""


def test_indirect_values_and_a_misplaced_object(spark):
    data = INDIRECT.replace(b"PLACE", b"%d" % INDIRECT.index(b"xref"))
    objs, documents = objects.opened(spark.createDataFrame([("a", bytearray(data))], "file_id string, content binary"))
    assert [(r.root, r.repaired, r.version) for r in documents.collect()] == [(1, True, "1.3")]
    content = pages.contents(pages.pages(objs, documents), objs)
    assert [bytes(r.content) for r in content.collect()] == [b"BT\nET"]


def test_files_at_rest_and_arriving(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.pdf").write_bytes(TYPED)
    found = read_files(spark, str(tmp_path / "in"))
    assert objects.scan(found).count() == 15
    write_files(found, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    counts = count_objects(stream_files(spark, str(tmp_path / "in")))
    query = counts.writeStream.format("memory").queryName("arrived").outputMode("complete").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {(r.kind, r.objects) for r in spark.table("arrived").collect()} == {("dict", 9), ("stream", 6)}


def test_functions_in_sql(spark):
    filters.register(spark)
    assert spark.sql("SELECT pdf_text(x'FEFF00E9') AS t, pdf_inflate(x'789c4b0400006200 62').problem AS p".replace(" 62'", "62'")).first().t == "é"
