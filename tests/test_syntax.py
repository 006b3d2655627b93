import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from quire.kernels import codecs as C
from quire.kernels import content as K
from quire.kernels import rows as R
from quire.kernels import syntax as S
from quire.kernels.fax import fax

TOKENS = [(b"-17", -17), (b"+9", 9), (b"4.", 4.0), (b"-.002", -0.002), (b"--5", -5.0), (b"9" * 20, 1e20), (b"(a(b)\\)\\101\\\nz)", b"a(b))Az"), (b"<41 4>", b"A@"), (b"/A#20b", "A b"), (b"(\r\n)", b"\n")]


@pytest.mark.parametrize(("raw", "value"), TOKENS)
def test_tokens(raw, value):
    got = S.parse(raw)[0]
    assert got == value and type(got) in (type(value), S.Name)


def test_numbers_stop_at_the_first_bad_byte():
    assert S.token(b"12x", 0) == (12, 2)
    assert S.token(b"3.4-5", 0) == (3.4, 3) and S.token(b"3.4-5", 3) == (-5, 5)
    assert S.token(b"1.2.3", 3) == (0.3, 5)
    for bad in (b"-", b"+", b"."):
        with pytest.raises(S.PdfError):
            S.parse(bad)


values = st.recursive(st.none() | st.booleans() | st.integers(-(2**63), 2**63 - 1) | st.binary(max_size=30) | st.text(st.characters(max_codepoint=255), max_size=9).map(S.Name) | st.builds(S.Ref, st.integers(0, 10**9), st.integers(0, 65535)), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(st.characters(max_codepoint=255), max_size=5).map(S.Name), x, max_size=4), max_leaves=20)


@given(values)
@settings(max_examples=300, deadline=None)
def test_round_trip(value):
    assert S.parse(S.format_value(value))[0] == value


@given(st.floats(allow_nan=True, allow_infinity=True))
def test_reals(x):
    spelled = S.format_value(x)
    assert b"e" not in spelled
    if math.isfinite(x) and abs(x) < 1e15:
        assert float(S.parse(spelled)[0]) == pytest.approx(x, rel=1e-12, abs=1e-300)


@given(st.binary(max_size=300))
@settings(max_examples=200, deadline=2000)
def test_rubbish_never_raises(data):
    R.object_rows(data), R.section_rows(data), K.operations(data), fax(data, {"Columns": 20}), C.lzw(data)
    for name in C.SHORT.values():
        C.decode({"Filter": S.Name(name)}, data)


def test_deep_nesting_needs_no_stack():
    assert S.format_value(S.parse(b"[" * 50_000 + b"]" * 50_000)[0]) == b"[" * 50_000 + b"]" * 50_000


@pytest.mark.parametrize(("f", "raw", "data", "clean"), [(C.ascii_hex, b"41 42\n43>", b"ABC", True), (C.ascii_hex, b"4>", b"@", True), (C.ascii_hex, b">", b"", True), (C.ascii_hex, b"4G>", b"", False), (C.ascii85, b'87cURD]i,"Ebo80~>', b"Hello World!", True), (C.ascii85, b"z~>", bytes(4), True), (C.ascii85, b"87cU~>", b"Hel", True), (C.ascii85, b"8~>", b"", False), (C.ascii85, b"uuuuu~>", b"", False), (C.run_length, b"\x02abc\x80", b"abc", True), (C.run_length, b"\xfex\x80", b"xxx", True), (C.run_length, b"\x05a", b"a", False), (C.run_length, b"\xc8", b"", False)])
def test_filters(f, raw, data, clean):
    got, problem = f(raw)
    assert (got, problem is None) == (data, clean)


def test_bombs_are_bounded():
    import zlib

    assert len(C.flate(zlib.compress(bytes(10**6)), cap=1000)[0]) <= 1000
    assert C.predict(b"\x02ab", 12, 1, 8, 10**9) == (b"", "predictor: a row larger than its data")
    assert len(R.packed_rows(8, 9999999999999, b"1 0 2 3 [] 5")) <= 2


def test_inline_image_with_its_end_mark_inside():
    ops, problem = K.operations(b"q BI /W 4 /H 1 /BPC 8 /CS /G ID a EI\nEI Q")
    assert problem is None and [o["operator"] for o in ops] == ["q", "BI", "Q"]
    assert ops[1]["image"][1] == b"a EI" and K.expanded(ops[1]["image"][0])["ColorSpace"] == "DeviceGray"


@pytest.mark.parametrize("name", [b"/DCT", b"/DCTDecode"])
def test_inline_jpeg_with_an_end_in_its_data(name):
    jpeg = b"\xff\xd8\xff\xe0 ab EI cd \xff\xd9"
    found, problem = K.operations(b"q BI /W 2 /H 2 /CS /G /BPC 8 /F " + name + b" ID " + jpeg + b" EI Q")
    assert problem is None and [o["operator"] for o in found] == ["q", "BI", "Q"] and found[1]["image"][1] == jpeg
