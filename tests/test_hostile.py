"""Values that would take a pattern, a plan or a walk too far, and values at any depth."""

import time
import zlib

import pytest
from pyspark.sql import functions as F
from quire.functions import filters
from quire.kernels import rows
from quire.kernels.syntax import leaves, parse
from quire.operators import leaves as deep
from quire.operators import linear, pages, signatures


@pytest.fixture
def quick():
    began = time.time()
    yield
    assert time.time() - began < 30


def decoded(spark, given):
    streams = spark.createDataFrame([(k, {n: v for n, v in (("Filter", f), ("DecodeParms", p)) if v is not None}, raw) for k, (f, p, raw) in enumerate(given)], "k int, entries map<string, string>, raw binary")
    return [r["decoded"] for r in filters.decode_streams(streams).orderBy("k").collect()]


def test_endless_filter_lists(spark, quick):
    hexed = b"plain"
    for _ in range(9):
        hexed = hexed.hex().encode()
    short = "[" + " ".join(["/AHx"] * 9) + "]"
    sixty = "[" + " ".join(["/Crypt"] * 63 + ["/AHx"]) + "]"
    got = decoded(spark, [("[" + "/A " * 20_000 + "]", None, b"x"), ("[" + "/Crypt " * 5_000 + "]", None, b"x"), (short, None, hexed), (sixty, None, b"41>"), ("/AHx", None, b"4142>"), ("/" + "F" * 200_000, None, b"x")])
    assert [g["cause"] for g in got[:2]] == ["filter: too many in a chain"] * 2 and bytes(got[0]["undecoded"]) == b"x"
    assert [bytes(g["data"]) for g in got[2:5]] == [b"plain", b"A", b"AB"] and not any(g["recovered"] for g in got[2:5])
    assert got[5]["recovered"]


def test_image_and_fault_behind_the_unrolled_filters(spark):
    got = decoded(spark, [("[/Crypt/Crypt/Crypt/Crypt/AHx/DCT]", None, b"4142>"), ("[/Crypt/Crypt/Crypt/Crypt/AHx]", None, b"41zz"), ("[/Crypt/Crypt/Crypt/Crypt/Nix]", None, b"41")])
    assert (got[0]["image"], bytes(got[0]["data"]), got[0]["recovered"]) == ("DCTDecode", b"AB", False)
    assert (bytes(got[1]["data"]), got[1]["recovered"], got[1]["filter"]) == (b"A", True, "ASCIIHexDecode")
    assert got[2]["recovered"] and bytes(got[2]["undecoded"]) == b"41"


def test_nested_and_quoted_parameters(spark):
    data = zlib.compress(b"\x02abcde\x02\x01\x01\x01\x01\x01")
    for parms in ("<</Predictor 12/X<</A 1/Columns 2>>/Columns 5>>", "<</Columns 5/Predictor 12/S(>> \\( /Columns 9)>>", "[<</Columns 5/Predictor 12/S(a\nb)/L[1 2]>>]", "<</Columns 5/Predictor 12>>", "[<</Columns 5/Predictor 12>>null]"):
        got = decoded(spark, [("/FlateDecode", parms, data)])[0]
        assert bytes(got["data"]) == b"abcdebcdef" and not got["recovered"], parms
    assert all(d["recovered"] for d in decoded(spark, [("/FlateDecode", "(x)", data), ("/FlateDecode", "[1]", data), ("[/Fl 3]", None, data)]))


def test_references_in_strings_are_none(spark):
    got = spark.createDataFrame([("[1 0 R(2 0 R \\) 3 0 R)4 0 R<35203020>]",)], "v string").select(pages.numbers(F.col("v")).alias("n")).first()
    assert got["n"] == [1, 4]


def test_long_byte_range(spark, quick):
    row = "[" + " ".join(["7"] * 5000) + "]"
    docs = spark.createDataFrame([("f", {}, 1)], "file_id string, trailer map<string,string>, root long")
    refs = "array<struct<key: string, ord: int, num: long, gen: long>>"
    objs = spark.createDataFrame([("f", 1, {"AcroForm": "2 0 R"}, []), ("f", 2, {}, [("Fields", 0, 3, 0), ("Fields", 1, 5, 0)]), ("f", 3, {"FT": "/Sig", "V": "4 0 R", "T": "(a)"}, []), ("f", 4, {"ByteRange": row}, []), ("f", 5, {"FT": "/Sig", "V": "6 0 R", "T": "(b)"}, []), ("f", 6, {"ByteRange": "[0 1 99999999999999999999 4]"}, [])], f"file_id string, num long, entries map<string,string>, refs {refs}")
    files = spark.createDataFrame([("f", b"x" * 100)], "file_id string, content binary")
    assert sorted((r["name"], r["verdict"]) for r in signatures.signatures(files, objs, docs).collect()) == [("a", "not four numbers"), ("b", "not four numbers")]


def test_line_feeds_before_the_first_object(spark, quick):
    body = b"1 0 obj\n<</Linearized 1/L %d>>\nendobj\n"
    cases = [b"\n" * 900, b"%PDF-1.7\r\n%\xe2\xe3\n", b"\r\n" * 300 + b"x\n", b"% 1 0 obj in words\n"]
    files = [head + body % (len(head) + len(body) - 2 + len(str(len(head) + len(body) + 1))) for head in cases]
    files = [f if b"/L %d>" % len(f) in f else head + body % len(f) for f, head in zip(files, cases, strict=True)]
    more = [b"\n" * 5000, b"1 0 obj\n<</A 1>>\nendobj\n" + files[0]]
    rows_ = linear.linearized(spark.createDataFrame(list(enumerate(files + more)), "file_id int, content binary")).orderBy("file_id").collect()
    assert [r["error"] for r in rows_] == [None] * 4 + ["not linearized"] * 2


def test_hybrid_sections():
    first = b"%PDF-1.5\n1 0 obj\n1\nendobj\n"
    at1 = len(first)
    table1 = b"xref\n1 1\n%010d 00000 n \n7 1\n%010d 00000 n \ntrailer\n<</Root 1 0 R>>\n" % (9, 9)
    start2 = at1 + len(table1)
    data = b"\x01\x00\x05\x00"
    stream = b"5 0 obj\n<</Type/XRef/W[1 2 1]/Size 9/Prev 3/Index[3 1]/Length 4>>\nstream\n" + data + b"\nendstream\nendobj\n"
    for place, found in ((start2, {1, 3, 4, 7}), (2, {1, 4, 7}), (10**9, {1, 4, 7})):
        table2 = b"xref\n4 1\n%010d 00000 n \ntrailer\n<</Root 1 0 R/XRefStm %d/Prev %d>>\n" % (9, place, at1)
        whole = first + table1 + stream + table2 + b"startxref\n%d\n%%%%EOF\n" % (start2 + len(stream))
        got = rows.section_rows(whole)
        assert {r["num"] for r in got if r["kind"] == "n"} == found and not [r for r in got if r["kind"] == "e"]
        assert [r["seq"] for r in got if r["num"] in (4, 3, 1)] == sorted(r["seq"] for r in got if r["num"] in (4, 3, 1))


def test_leaves_spell_their_value():
    for text in (b"<</A[1 2.5(x\\))<00ff>/N 3 0 R[]<<>>]/B null/C true>>", b"[]", b"7 0 R", b"(a)", b"<<>>", b"[" * 3000 + b"]" * 3000):
        value, _ = parse(text)
        found = leaves(value)
        assert parse("".join(x["before"] + x["text"] for x in found).encode("latin-1"))[0] == value
    found = leaves(parse(b"<</A[1 <</B(x)>>]>>")[0])
    assert [(x["path"], x["kind"], x["text"]) for x in found] == [(["A", "0"], "int", "1"), (["A", "1", "B"], "string", "(x)"), ([], "end", "")]


def test_references_at_any_depth(spark, quick):
    refs = "array<struct<key: string, ord: int, num: long, gen: long>>"
    made = []
    for num, text in [(1, "<</Filter[2 0 R/Fl]/DecodeParms[null 4 0 R]/Other 9 0 R>>"), (2, "3 0 R"), (3, "/AHx"), (4, "<</A[5 0 R 6 0 R]/Columns 5 0 R>>"), (5, "16"), (6, "[7 0 R 1 0 R 99 0 R 8 0 R]"), (7, "[6 0 R]"), (8, "<<>>"), (20, "<</Filter 21 0 R>>")]:
        value = parse(text.encode())[0]
        made.append(("f", num, "stream" if num in (1, 8) else "dict", rows.text_of(value).encode(), {k: rows.text_of(v) for k, v in value.items()} if isinstance(value, dict) else {}, []))
    # each of these names the next one twice: 2 ** 30 leaves, were they all followed
    made += [("f", 21 + k, "array", b"[%d 0 R %d 0 R]" % (22 + k, 22 + k), {}, []) for k in range(30)]
    objs = spark.createDataFrame(made, f"file_id string, num long, kind string, body binary, entries map<string,string>, refs {refs}")
    got = {r["num"]: r["entries"] for r in deep.inlined_deep(objs, "Filter", "DecodeParms").collect()}
    assert got[1] == {"Filter": "[/AHx /Fl]", "DecodeParms": "[null <</A [16 [[null] 1 0 R null 8 0 R]]/Columns 16>>]", "Other": "9 0 R"}
    assert " R" not in got[20]["Filter"] and got[20]["Filter"].startswith("[[[")
    assert got[4] == {"A": "[5 0 R 6 0 R]", "Columns": "5 0 R"}
