"""Reading and writing of PDF values: small helpers that run on one value or one object at a time.

Values are Python ones: None, bool, int, float, bytes (string), Name, list, dict (with str keys), Ref and Stream.
Nesting uses an explicit stack, so that hostile input can't exhaust Python's.
"""

from __future__ import annotations

import math
import re
from typing import NamedTuple


class Name(str):
    """A name without its slash; bytes above 127 are characters of the same number."""


class Ref(NamedTuple):
    num: int
    gen: int


class Stream(NamedTuple):
    entries: dict
    raw: bytes


class Keyword(bytes):
    pass


class PdfError(ValueError):
    pass


BLANK = b"\x00\t\n\x0c\r "
DELIMITERS = b"()<>[]{}/%"
_SKIP = re.compile(rb"(?:[\x00\t\n\x0c\r ]|%[^\r\n]*)*")
_REGULAR = re.compile(rb"[^\x00\t\n\x0c\r ()<>\[\]{}/%]*")
_NUMBER = re.compile(rb"([+-]*)(\d*)(\.?)(\d*)")
_REFERENCE = re.compile(rb"(\d+)[\x00\t\n\x0c\r ]+(\d+)[\x00\t\n\x0c\r ]+R(?![^\x00\t\n\x0c\r ()<>\[\]{}/%])")
_STRING = re.compile(rb"[()\\\r]")
_ESCAPES = {110: b"\n", 114: b"\r", 116: b"\t", 98: b"\b", 102: b"\f", 40: b"(", 41: b")", 92: b"\\"}
INT_MAX = 2**63 - 1


def skip(data: bytes, at: int) -> int:
    return _SKIP.match(data, at).end()


def _number(data: bytes, at: int) -> tuple[int | float, int]:
    """Stops at the first byte that can't go on; a second sign, a point, or too large an integer makes a real."""
    m = _NUMBER.match(data, at)
    signs, whole, point, part = m.groups()
    if not whole and not part:
        raise PdfError(f"no digits at {at}")
    sign = -1 if signs[:1] == b"-" else 1
    if not point and len(signs) < 2:
        value = sign * int(whole)
        if -INT_MAX - 1 <= value <= INT_MAX:
            return value, m.end()
    real = float(f"{whole.decode() or '0'}.{part.decode() or '0'}")
    if math.isinf(real):
        raise PdfError(f"number out of range at {at}")
    return sign * real, m.end()


def _literal(data: bytes, at: int) -> tuple[bytes, int]:
    out, depth = bytearray(), 1
    at += 1
    while True:
        m = _STRING.search(data, at)
        if not m:
            raise PdfError("string without end")
        out += data[at : m.start()]
        c, at = data[m.start()], m.end()
        if c == 40:
            depth += 1
            out.append(c)
        elif c == 41:
            depth -= 1
            if not depth:
                return bytes(out), at
            out.append(c)
        elif c == 13:
            out.append(10)
            at += data[at : at + 1] == b"\n"
        else:
            c = data[at] if at < len(data) else -1
            if 48 <= c <= 55:
                m = re.compile(rb"[0-7]{1,3}").match(data, at)
                out.append(int(m[0], 8) & 255)
                at = m.end()
            elif c in (10, 13):
                at += 2 if data[at : at + 2] == b"\r\n" else 1
            elif c >= 0:
                out += _ESCAPES.get(c, bytes([c]))
                at += 1


def _hex(data: bytes, at: int) -> tuple[bytes, int]:
    end = data.find(b">", at + 1)
    if end < 0:
        raise PdfError("hex string without end")
    digits = re.sub(rb"[^0-9A-Fa-f]", b"", data[at + 1 : end])
    return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()), end + 1


def _name(data: bytes, at: int) -> tuple[Name, int]:
    m = _REGULAR.match(data, at + 1)
    raw = m[0]
    if b"#" in raw:
        if re.search(rb"#(?![0-9A-Fa-f]{2})", raw):
            raise PdfError(f"bad escape in a name at {at}")
        raw = re.sub(rb"#(..)", lambda x: bytes([int(x[1], 16)]), raw)
    return Name(raw.decode("latin-1")), m.end()


def token(data: bytes, at: int) -> tuple[object, int]:
    """The next token from at: a value, or a Keyword (also for the brackets); Keyword(b"") at the end."""
    at = skip(data, at)
    if at >= len(data):
        return Keyword(b""), at
    c = data[at]
    if c in b"+-.0123456789":
        return _number(data, at)
    if c == 47:
        return _name(data, at)
    if c == 40:
        return _literal(data, at)
    if c == 60 and data[at + 1 : at + 2] != b"<":
        return _hex(data, at)
    if c in DELIMITERS:
        two = data[at : at + 2]
        if two in (b"<<", b">>"):
            return Keyword(two), at + 2
        return Keyword(data[at : at + 1]), at + 1
    m = _REGULAR.match(data, at)
    return Keyword(m[0]), m.end()


WORDS = {b"true": True, b"false": False, b"null": None}


_ENDS = rb"(?=[\x00\t\n\x0c\r ()<>\[\]{}/%]|\Z)"
#: What most values are made of, blanks before it: a name that is spelled as it is, a reference, a number, brackets, a string that is
#: spelled as it is, a word. Whatever doesn't match goes the long way.
_PIECE = re.compile(
    rb"[\x00\t\n\x0c\r ]*(?:/([!\"$&'*-.0-;=?-Z\\^-z|~]*)" + _ENDS + rb"|(\d{1,18})[\x00\t\n\x0c\r ]+(\d{1,18})[\x00\t\n\x0c\r ]+R" + _ENDS + rb"|(0|-?[1-9]\d{0,17})" + _ENDS
    + rb"|(<<|\[)|(>>|\])|\(([\x20-'*-\[\]-~\t\n]*)\)|(true|false|null)" + _ENDS + rb")"
)


def parse(data: bytes, at: int = 0) -> tuple[object, int]:
    """The direct object at `at`, and where it ends."""
    stack: list[list] = []
    while True:
        if (m := _PIECE.match(data, at)) is not None:
            which, at = m.lastindex, m.end()
            if which == 4:
                value = int(m[4])
            elif which == 1:
                value = Name(m[1].decode("latin-1"))
            elif which == 3:
                value = Ref(int(m[2]), int(m[3]))
            elif which == 7:
                value = m[7]
            elif which == 8:
                value = WORDS[m[8]]
            else:
                value = Keyword(m[which])
        else:
            at = skip(data, at)
            if (m := _REFERENCE.match(data, at)) is not None:
                value, at = Ref(int(m[1]), int(m[2])), m.end()
            else:
                value, at = token(data, at)
        if isinstance(value, Keyword):
            if value in (b"[", b"<<"):
                stack.append([bytes(value)])
                continue
            if stack and (value, stack[-1][0]) in ((b"]", b"["), (b">>", b"<<")):
                made = stack.pop()
                value = made[1:] if made[0] == b"[" else _dictionary(made[1:])
            elif value in WORDS:
                value = WORDS[value]
            else:
                raise PdfError(f"unexpected {bytes(value)!r} before {at}")
        if not stack:
            return value, at
        stack[-1].append(value)


#: Nesting up to which a value is spelled while it is read.
SHALLOW = 16
_KINDS = {1: "name", 3: "ref", 4: "int", 7: "string"}


def respelled(data: bytes, at: int) -> tuple[str, bytes, dict[str, str], list[tuple], int] | None:
    """What kind_of, format_value and references say of the value at `at`, its entries spelled, and where it ends, without making the
    value; None for one that needs the long way, a wrong one too."""
    texts: list[bytes] = []
    refs: list[list | None] = []
    stack: list[tuple] = []
    match = _PIECE.match
    while True:
        some = None
        if (m := match(data, at)) is None:
            if _REFERENCE.match(data, skip(data, at)) is not None:
                return None
            try:
                value, at = token(data, at)
            except PdfError:
                return None
            if isinstance(value, (Keyword, Name)):
                return None
            kind, text = kind_of(value), format_value(value)
        else:
            which, at = m.lastindex, m.end()
            if which == 1:
                text = b"/" + m[1]
            elif which == 4 or which == 8:
                text = m[which]
            elif which == 3:
                some = [(int(m[2]), int(m[3]))]
                text = b"%d %d R" % some[0]
            elif which == 7:
                text = b"(" + m[7] + b")"
            elif which == 5:
                if len(stack) == SHALLOW:
                    return None
                stack.append((m[5], texts, refs))
                texts, refs = [], []
                continue
            else:
                if not stack or (m[6], stack[-1][0]) not in ((b">>", b"<<"), (b"]", b"[")):
                    return None
                if m[6] == b"]":
                    text, some = b"[" + b" ".join(texts) + b"]", [r for x in refs if x for r in x] or None
                    if len(stack) == 1:
                        return "array", text, {}, [("", k, *r) for k, r in enumerate(some or ())], at
                else:
                    keys = texts[::2]
                    if len(texts) % 2 or not all(k[0] == 47 for k in keys):
                        return None
                    held, leads = dict(zip(keys, texts[1::2], strict=True)), dict(zip(keys, refs[1::2], strict=True))
                    text = b"<<" + b"".join([k + b" " + held[k] for k in sorted(held)]) + b">>"
                    if len(stack) == 1:
                        named = [(k[1:].decode("latin-1"), r) for k, x in leads.items() if x for r in x]
                        entries = {k[1:].decode("latin-1"): v.decode("latin-1") for k, v in held.items()}
                        return "dict", text, entries, [(key, k, *r) for k, (key, r) in enumerate(named)], at
                    some = [r for x in leads.values() if x for r in x] or None
                _, texts, refs = stack.pop()
            kind = None
        if not stack:
            kind = kind or (_KINDS.get(which) or ("null" if text == b"null" else "bool"))
            return kind, text, {}, [("", 0, *some[0])] if some else [], at
        texts.append(text)
        refs.append(some)


def _dictionary(flat: list) -> dict:
    """A repeated key's last value counts."""
    if len(flat) % 2 or not all(isinstance(k, Name) for k in flat[::2]):
        raise PdfError("a dictionary of other than names and values")
    return dict(zip(flat[::2], flat[1::2], strict=True))


_HEADER = re.compile(rb"(\d{1,10})[\x00\t\n\x0c\r ]+(\d{1,10})[\x00\t\n\x0c\r ]+obj")
_STREAM = re.compile(rb"stream(\r\n|\n|\r)?")
_END = re.compile(rb"[\x00\t\n\x0c\r ]*endstream")


def parse_indirect(data: bytes, at: int, length_of=None) -> tuple[Ref, object, int]:
    """The object whose header stands at `at`; length_of gives the number that a reference in /Length means."""
    m = _HEADER.match(data, skip(data, at))
    if not m:
        raise PdfError(f"no object header at {at}")
    ref, at = Ref(int(m[1]), int(m[2])), m.end()
    if data.startswith(b"endobj", skip(data, at)):
        return ref, None, skip(data, at) + 6
    value, at = parse(data, at)
    after = skip(data, at)
    if isinstance(value, dict) and (m := _STREAM.match(data, after)):
        start = m.end()
        length = value.get("Length")
        if isinstance(length, Ref) and length_of is not None:
            length = length_of(length)
        if isinstance(length, int) and 0 <= length <= len(data) - start and _END.match(data, start + length):
            end = start + length
            at = _END.match(data, end).end()
        else:
            found = data.find(b"endstream", start)
            if found < 0:
                raise PdfError("stream without end")
            end, at = found, found + 9
            if data[end - 2 : end] == b"\r\n" and end - 2 >= start:
                end -= 2
            elif end > start and data[end - 1] in b"\r\n":
                end -= 1
        value = Stream(value, data[start:end])
        after = skip(data, at)
    if data.startswith(b"endobj", after):
        at = after + 6
    return ref, value, at


def headers(data: bytes) -> list[tuple[int, int, int]]:
    """(number, generation, offset) of everything that looks like an object header, in order."""
    return [(int(m[1]), int(m[2]), m.start()) for m in _HEADER.finditer(data) if m.start() == 0 or data[m.start() - 1] not in b"0123456789"]


_PLAIN = re.compile(rb"[\x20-\x7e\t\n]*\Z")


def _real(x: float) -> bytes:
    if not math.isfinite(x) or x == 0:
        return b"0"
    if x == int(x) and abs(x) < 1e300:
        return str(int(x)).encode()
    s = repr(x)
    if "e" in s or "E" in s:
        s = f"{x:.340f}".rstrip("0")
    return s.encode()


def _quoted(s: bytes) -> bytes:
    literal = b"(" + re.sub(rb"[()\\\r]", lambda m: b"\\r" if m[0] == b"\r" else b"\\" + m[0], s) + b")"
    return literal if _PLAIN.match(s) and len(literal) <= 2 * len(s) + 2 else b"<" + s.hex().encode() + b">"


def _slashed(name: str) -> bytes:
    return b"/" + b"".join(bytes([c]) if 33 <= c <= 126 and c not in b"()<>[]{}/%#" else b"#%02X" % c for c in name.encode("latin-1"))


def format_value(value: object) -> bytes:
    """The one spelling of a value: sorted keys, the shorter form of strings, no exponents."""
    out: list[bytes] = []
    todo: list[object] = [value]
    while todo:
        v = todo.pop()
        if isinstance(v, Keyword):
            out.append(bytes(v))
        elif v is None:
            out.append(b"null")
        elif isinstance(v, bool):
            out.append(b"true" if v else b"false")
        elif isinstance(v, int):
            out.append(str(v).encode())
        elif isinstance(v, float):
            out.append(_real(v))
        elif isinstance(v, bytes):
            out.append(_quoted(v))
        elif isinstance(v, Name):
            out.append(_slashed(v))
        elif isinstance(v, Ref):
            out.append(b"%d %d R" % v)
        elif isinstance(v, Stream):
            entries = {**v.entries, Name("Length"): len(v.raw)}
            todo += [Keyword(b"\nendstream"), Keyword(v.raw), Keyword(b"\nstream\n"), entries]
        elif isinstance(v, list):
            todo.append(Keyword(b"]"))
            for k, x in enumerate(reversed(v)):
                todo += [x] + [Keyword(b" ")] * (k < len(v) - 1)
            out.append(b"[")
        elif isinstance(v, dict):
            todo.append(Keyword(b">>"))
            for k in sorted(v, reverse=True):
                todo += [v[k], Keyword(b" "), Name(k)]
            out.append(b"<<")
        else:
            raise TypeError(type(v))
    return b"".join(out)


def kind_of(value: object) -> str:
    for kind, name in ((bool, "bool"), (int, "int"), (float, "real"), (Name, "name"), (bytes, "string"), (Ref, "ref"), (list, "array"), (dict, "dict"), (Stream, "stream")):
        if isinstance(value, kind):
            return name
    return "null"


def references(value: object) -> list[tuple[str, int, int, int]]:
    """(top-level key, ordinal, number, generation) of every reference inside a value, in the order written."""
    out: list[tuple[str, int, int, int]] = []
    entries = value.entries if isinstance(value, Stream) else value
    tops = list(entries.items()) if isinstance(entries, dict) else [("", entries)]
    for key, top in tops:
        todo = [top]
        while todo:
            v = todo.pop()
            if isinstance(v, Ref):
                out.append((str(key), len(out), v.num, v.gen))
            elif isinstance(v, list):
                todo += reversed(v)
            elif isinstance(v, dict):
                todo += reversed(list(v.values()))
    return out


#: Steps of a path that are told; deeper leaves have the path of the node that many steps down.
DEEPEST = 64


def leaves(value: object) -> list[dict]:
    """What a value has that is neither array nor dictionary, in the order of its spelling: path (keys, and places in arrays), kind,
    before (what is spelled since the last one), text, and num of a reference. A last row of kind 'end' has what closes the value, so
    that all before and text in order are the value's spelling, also with other texts in place of some."""
    out: list[dict] = []
    pending: list[bytes] = []
    todo: list[tuple[object, list[str]]] = [(value.entries if isinstance(value, Stream) else value, [])]
    row = lambda path, kind, text, num: {"seq": len(out), "path": path, "kind": kind, "before": b"".join(pending).decode("latin-1"), "text": text, "num": num}
    while todo:
        v, path = todo.pop()
        deeper = len(path) < DEEPEST
        if isinstance(v, Keyword):
            pending.append(bytes(v))
        elif isinstance(v, list):
            todo.append((Keyword(b"]"), path))
            for k in reversed(range(len(v))):
                todo += [(v[k], [*path, str(k)] if deeper else path)] + [(Keyword(b" "), path)] * (k > 0)
            pending.append(b"[")
        elif isinstance(v, dict):
            todo.append((Keyword(b">>"), path))
            for k in sorted(v, reverse=True):
                todo += [(v[k], [*path, str(k)] if deeper else path), (Keyword(b" "), path), (Keyword(_slashed(k)), path)]
            pending.append(b"<<")
        else:
            out.append(row(path, kind_of(v), format_value(v).decode("latin-1"), v.num if isinstance(v, Ref) else None))
            pending.clear()
    out.append(row([], "end", "", None))
    return out
