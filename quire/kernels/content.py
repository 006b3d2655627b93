"""Content streams as operations."""

from __future__ import annotations

import re
from collections.abc import Iterator

from .codecs import decode
from .syntax import WORDS, Keyword, Name, PdfError, parse, skip, token

#: The short keys and colour spaces of inline images.
SHORT_KEYS = {"BPC": "BitsPerComponent", "CS": "ColorSpace", "D": "Decode", "DP": "DecodeParms", "F": "Filter", "H": "Height", "IM": "ImageMask", "I": "Interpolate", "W": "Width", "L": "Length"}
SHORT_SPACES = {"G": "DeviceGray", "RGB": "DeviceRGB", "CMYK": "DeviceCMYK", "I": "Indexed"}
COMPONENTS = {"DeviceGray": 1, "DeviceRGB": 3, "DeviceCMYK": 4, "Indexed": 1}
_END = re.compile(rb"(?<![^\x00\t\n\x0c\r ])EI(?![^\x00\t\n\x0c\r ])")
_TIGHT = re.compile(rb"EI(?![^\x00\t\n\x0c\r ])")


def expanded(entries: dict) -> dict:
    """Long keys and colour spaces; where both forms of a key stand, the short one counts."""
    out = {k: v for k, v in entries.items() if k not in SHORT_KEYS}
    out |= {Name(SHORT_KEYS[k]): v for k, v in entries.items() if k in SHORT_KEYS}
    space = out.get("ColorSpace")
    if isinstance(space, Name):
        out[Name("ColorSpace")] = Name(SHORT_SPACES.get(str(space), str(space)))
    return out


def _size(e: dict) -> int | None:
    """Bytes of an image's samples, if its dictionary tells."""
    width, height = e.get("Width"), e.get("Height")
    bits = 1 if e.get("ImageMask") is True else e.get("BitsPerComponent", 8)
    parts = 1 if e.get("ImageMask") is True else COMPONENTS.get(str(e.get("ColorSpace")))
    if not all(isinstance(x, int) and x >= 0 for x in (width, height, bits)) or parts is None:
        return None
    return (width * bits * parts + 7) // 8 * height


def _image(data: bytes, at: int) -> tuple[dict, bytes, int]:
    flat: list = []
    while True:
        at = skip(data, at)
        if data.startswith(b"ID", at) and (at + 2 == len(data) or data[at + 2] in b"\x00\t\n\x0c\r "):
            break
        value, at = parse(data, at)
        flat.append(value)
    if len(flat) % 2 or not all(isinstance(k, Name) for k in flat[::2]):
        raise PdfError("inline image: bad dictionary")
    entries = dict(zip(flat[::2], flat[1::2], strict=True))
    start, e = at + 3, expanded(entries)
    size = _size(e)
    known = [size] if "Filter" not in e else []
    known += [e["Length"]] if isinstance(e.get("Length"), int) else []
    for n in known:
        if n is not None and start + n <= len(data) and (m := re.compile(rb"[\x00\t\n\x0c\r ]*EI(?![^\x00\t\n\x0c\r ])").match(data, start + n)):
            return entries, data[start : start + n], m.end()
    for pattern in (_END, _TIGHT):
        for m in pattern.finditer(data, start):
            raw = data[start : m.start()]
            raw = raw[:-1] if raw and raw[-1] in b"\x00\t\n\x0c\r " else raw
            made = decode(e, raw)
            if made["image"] == "DCTDecode" and not (len(made["data"]) > 4 and made["data"].startswith(b"\xff\xd8") and made["data"].endswith(b"\xff\xd9")):
                continue
            if made["cause"] is None and (size is None or made["image"] or len(made["data"]) >= size):
                return entries, raw, m.end()
    raise PdfError("inline image: no end")


def operations(data: bytes) -> tuple[list[dict], str | None]:
    """Operators with their operands, in order, and the first thing that was wrong."""
    rows = list(each_operation(data))
    return [r for r in rows if r["operator"] is not None], rows[-1]["problem"] if rows and rows[-1]["operator"] is None else None


def each_operation(data: bytes) -> Iterator[dict]:
    """Operators with their operands, as they are found; if something was wrong, a last row without an operator tells the first such thing."""
    held, problem, at, start = [], None, 0, None
    while True:
        at = skip(data, at)
        if at >= len(data):
            break
        start = at if start is None else start
        try:
            if data[at] in b"[<" or data[at] in b"(/+-.0123456789":
                value, at = parse(data, at)
                held.append(value)
                continue
            word, at = token(data, at)
        except PdfError as e:
            problem = problem or str(e)
            at += 1
            continue
        if isinstance(word, Keyword) and word in WORDS:
            held.append(WORDS[word])
            continue
        row = {"operator": bytes(word).decode("latin-1"), "operands": held, "start": start, "end": at, "image": None, "problem": None}
        if word == b"BI":
            try:
                entries, raw, at = _image(data, at)
            except PdfError as e:
                problem = problem or str(e)
                break
            row |= {"end": at, "image": (entries, raw)}
        elif not isinstance(word, Keyword) or word in (b">>", b"]", b"}", b"{", b")", b">"):
            problem = problem or f"unexpected {word!r}"
            held, start = [], None
            continue
        yield row
        held, start = [], None
    if problem:
        yield {"operator": None, "operands": [], "start": at, "end": at, "image": None, "problem": problem}
