"""From the bytes of one file, or of one object, to plain tuples. Run by Spark on Arrow batches of rows."""

from __future__ import annotations

import re
from collections.abc import Iterator

from .codecs import decode
from .syntax import Name, PdfError, Ref, Stream, format_value, headers, kind_of, parse, parse_indirect, references, respelled, skip

TAIL = 4096
_SUBSECTION = re.compile(rb"[\x00\t\n\x0c\r ]*(\d+)[\x00\t\n\x0c\r ]+(\d+)[\x00\t\n\x0c\r ]*")
_ENTRY = re.compile(rb"[\x00\t\n\x0c\r ]*(\d+)[\x00\t\n\x0c\r ]+(\d+)[\x00\t\n\x0c\r ]+([nf])")
MOST_SECTIONS = 1024


def text_of(value: object) -> str:
    """A value's spelling as text of the same bytes."""
    return format_value(value).decode("latin-1")


#: The columns of object_tuples, section_tuples and packed_tuples.
OBJECT = ("num", "gen", "offset", "end", "kind", "body", "entries", "refs", "raw", "error")
SECTION = ("seq", "kind", "num", "offset", "gen", "strm", "trailer", "error")
MEMBER = ("num", "index", "kind", "body", "entries", "refs", "raw")
_BEHIND = re.compile(rb"[\x00\t\n\x0c\r ]*(?:(endobj)|(stream)(?:\r\n|\n|\r)?)")
_CLOSED = re.compile(rb"[\x00\t\n\x0c\r ]*endstream[\x00\t\n\x0c\r ]*+(?:endobj)?+(?!%)")


def _plain_numbers(data: bytes, found: list[tuple]) -> dict[int, int]:
    """The objects that are a number and nothing else, which lengths may be references to."""
    numbers = {}
    for num, _, at in found:
        if plain := re.compile(rb"[^o]*obj[\x00\t\n\x0c\r ]+(\d+)[\x00\t\n\x0c\r ]+endobj").match(data, at):
            numbers[num] = int(plain[1])
    return numbers


def object_tuples(data: bytes) -> Iterator[tuple]:
    """Every object whose header can be found, as it stands at that place; what can't be parsed has an error."""
    found = headers(data)
    numbers: dict[int, int] | None = None

    def length_of(ref: Ref) -> int | None:
        nonlocal numbers
        numbers = _plain_numbers(data, found) if numbers is None else numbers
        return numbers.get(ref.num)

    for num, gen, at in found:
        told = respelled(data, data.index(b"obj", at) + 3)
        if told is not None and (m := _BEHIND.match(data, told[4])) is not None:
            if m[1]:
                yield num, gen, at, m.end(), *told[:4], None, None
                continue
            size = told[2].get("Length", "")
            if told[0] == "dict" and size.isdigit() and len(size) < 19 and (end := m.end() + int(size)) <= len(data) and (c := _CLOSED.match(data, end)) is not None:
                yield num, gen, at, c.end() if c[0].endswith(b"j") else end + c[0].index(b"m") + 1, "stream", *told[1:4], data[m.end() : end], None
                continue
        try:
            _, value, end = parse_indirect(data, at, length_of)
            row = value_tuple(value)
        except (PdfError, ValueError, IndexError) as e:
            yield num, gen, at, at, None, None, None, None, None, str(e)
        else:
            yield num, gen, at, end, *row, None


def object_rows(data: bytes) -> list[dict]:
    return [dict(zip(OBJECT, row, strict=True)) for row in object_tuples(data)]


def span_row(num: int, data: bytes, length: int | None) -> dict:
    """The object that has to stand at the start of data; length is what a reference in its /Length means, if that is known."""
    row = {"gen": None, "kind": None, "body": None, "entries": None, "refs": None, "raw": None, "length_at": None, "closed": False, "error": None}
    named = []

    def length_of(ref: Ref) -> int | None:
        named.append(ref.num)
        return length

    try:
        ref, value, end = parse_indirect(data, 0, length_of)
    except (PdfError, ValueError, IndexError) as e:
        return row | {"error": str(e), "length_at": named[0] if named else None}
    if ref.num != num:
        return row | {"error": f"object {ref.num} stands in the place of {num}"}
    return row | value_row(value) | {"gen": ref.gen, "length_at": named[0] if named else None, "closed": data[:end].endswith(b"endobj")}


def value_tuple(value: object) -> tuple:
    """kind, body, entries, refs, raw."""
    entries = value.entries if isinstance(value, Stream) else value
    told = {str(k): text_of(v) for k, v in entries.items()} if isinstance(entries, dict) else {}
    return kind_of(value), format_value(entries), told, references(value), value.raw if isinstance(value, Stream) else None


def value_row(value: object) -> dict:
    row = dict(zip(MEMBER[2:], value_tuple(value), strict=True))
    return row | {"refs": [{"key": k, "ord": o, "num": n, "gen": g} for k, o, n, g in row["refs"]]}


def _table(data: bytes, at: int) -> tuple[list[tuple], dict]:
    """(kind, num, offset, gen, strm) of each entry, and the trailer."""
    rows = []
    at += 4
    while m := _SUBSECTION.match(data, at):
        first, count = int(m[1]), int(m[2])
        at = m.end()
        for k in range(count):
            e = _ENTRY.match(data, at)
            if not e:
                raise PdfError("xref: bad entry")
            at = e.end()
            rows.append((e[3].decode(), first + k, int(e[1]), int(e[2]), None))
    at = skip(data, at)
    if not data.startswith(b"trailer", at):
        raise PdfError("xref: no trailer")
    trailer, _ = parse(data, at + 7)
    if not isinstance(trailer, dict):
        raise PdfError("xref: trailer is no dictionary")
    return rows, trailer


def _stream(data: bytes, at: int) -> tuple[list[tuple], dict]:
    _, value, _ = parse_indirect(data, at)
    if not isinstance(value, Stream) or value.entries.get("Type") != Name("XRef"):
        raise PdfError("xref: no cross-reference stream")
    made = decode(value.entries, value.raw)
    if made["data"] is None or made["recovered"]:
        raise PdfError("xref: its stream can't be decoded")
    body, widths = made["data"], value.entries.get("W")
    if not (isinstance(widths, list) and len(widths) >= 3 and all(isinstance(w, int) and 0 <= w <= 8 for w in widths)):
        raise PdfError("xref: bad widths")
    w1, w2, w3 = widths[:3]
    index = value.entries.get("Index") or [0, value.entries.get("Size", 0)]
    rows, step, at = [], sum(widths), 0
    for first, count in zip(index[::2], index[1::2], strict=False):
        for num in range(first, first + min(count, (len(body) - at) // max(step, 1))):
            a, b, c = body[at : at + w1], body[at + w1 : at + w1 + w2], body[at + w1 + w2 : at + w1 + w2 + w3]
            kind = int.from_bytes(a, "big") if w1 else 1
            second, third = int.from_bytes(b, "big"), int.from_bytes(c, "big")
            at += step
            rows.append(("n", num, second, third, None) if kind == 1 else ("o", num, third, 0, second) if kind == 2 else ("f", num, 0, 0, None))
    return rows, value.entries


def _beside(data: bytes, at: object, place: int) -> list[tuple]:
    """The entries of the stream that a table of a hybrid file names. Its own /Prev is not followed, as that of the table is;
    one that can't be read is as good as none."""
    try:
        if not isinstance(at, int) or not 0 <= at < len(data):
            return []
        rows, _ = _stream(data, skip(data, at))
    except (PdfError, ValueError, IndexError, TypeError):
        return []
    return [(2 * place + 1, *r, None, None) for r in rows]


def section_tuples(data: bytes) -> list[tuple]:
    """Entries and trailers of every section of the /Prev chain, newest first: seq tells the section.

    A row of kind 't' carries a trailer; one of kind 'e' says why the chain can't be read.
    """
    out: list[tuple] = []
    told = lambda kind, seq, trailer=None, error=None: (seq, kind, None, None, None, None, trailer, error)
    if head := re.search(rb"%PDF-(...)", data[:1024]):
        out.append(told("h", 0, {"Version": head[1].decode("latin-1")}))
    tail = data[-TAIL:]
    mark = tail.rfind(b"startxref")
    try:
        if mark < 0:
            raise PdfError("no startxref")
        start, _ = parse(tail, mark + 9)
        todo, seen = [start], set()
        while todo:
            at = todo.pop(0)
            if not isinstance(at, int) or not 0 <= at < len(data):
                raise PdfError("xref: offset outside of the file")
            if at in seen or len(seen) >= MOST_SECTIONS:
                raise PdfError("xref: sections in a circle")
            at = skip(data, at)
            seen.add(at)
            rows, trailer = (_table if data.startswith(b"xref", at) else _stream)(data, at)
            # a section's place in the chain, twice: entries of the stream beside a table come after the table's own
            seq = 2 * len(seen)
            out += [(seq, *r, None, None) for r in rows]
            out.append(told("t", seq, {str(k): text_of(v) for k, v in trailer.items()}))
            if "XRefStm" in trailer and data.startswith(b"xref", at):
                out += _beside(data, trailer["XRefStm"], len(seen))
            todo = [trailer["Prev"]] if "Prev" in trailer else []
    except (PdfError, ValueError, IndexError, TypeError) as e:
        out.append(told("e", 0, None, str(e)))
    return out


def section_rows(data: bytes) -> list[dict]:
    return [dict(zip(SECTION, row, strict=True)) for row in section_tuples(data)]


def trailer_tuples(data: bytes) -> Iterator[tuple]:
    """(seq, trailer): trailer dictionaries found by their keyword, the last in a file first."""
    seq = 0
    for m in reversed(list(re.finditer(rb"trailer", data))):
        try:
            value, _ = parse(data, m.end())
        except ValueError:
            continue
        if isinstance(value, dict):
            yield seq, {str(k): text_of(v) for k, v in value.items()}
            seq += 1


_HEAD = re.compile(rb"[\x00\t\n\x0c\r \d]*")


def _places(first: int, count: int, data: bytes) -> list[tuple]:
    """(number, place) of the members that the head of an object stream names."""
    most = min(count, -(-first // 4))
    if first <= len(data) and _HEAD.fullmatch(data, 0, first):
        said = re.findall(rb"\d+", data[:first])
        if len(said) >= 2 * most and max(map(len, said), default=0) < 19:
            return [(int(said[2 * k]), int(said[2 * k + 1])) for k in range(most)]
    at, places = 0, []
    for _ in range(most):
        try:
            num, at = parse(data, at)
            place, at = parse(data, at)
            places.append((num, place))
        except PdfError:
            break
    return places


def packed_tuples(first: int | None, count: int | None, data: bytes | None) -> Iterator[tuple]:
    """The members of an object stream from its decoded data; those that can't be parsed are left out."""
    if first is None or count is None or data is None:
        return
    for k, (num, place) in enumerate(_places(first, count, data)):
        if not isinstance(num, int):
            continue
        try:
            told = respelled(data, first + place) if place >= 0 else None
            if told is not None:
                yield num, k, *told[:4], None
                continue
            value, _ = parse(data, first + place)
            row = value_tuple(value)
        except (PdfError, TypeError, IndexError):
            continue
        yield num, k, *row


def packed_rows(first: int, count: int, data: bytes) -> list[dict]:
    return [dict(zip(MEMBER, row, strict=True)) for row in packed_tuples(first, count, data)]
