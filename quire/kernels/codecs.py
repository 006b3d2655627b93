"""Stream filters as functions of bytes.

Each decoder gives (data, problem): data is all that could be read, problem says what stopped it or is None.
"""

from __future__ import annotations

import re
import zlib

import numpy as np

from .syntax import Name, PdfError

FLATE_CAP = 1 << 30
ROW_CAP = 1 << 20
BLANK = b"\x00\t\n\x0c\r "

Decoded = tuple[bytes, str | None]


def _inflate(data: bytes, bits: int, cap: int) -> Decoded:
    d = zlib.decompressobj(bits)
    try:
        out = d.decompress(data, cap + 1)
    except zlib.error as e:
        out = _prefix(data, bits, cap)
        return out, f"flate: {e}"
    if len(out) > cap:
        return out[:cap], "flate: more than the cap"
    return out, None if d.eof else "flate: data ends early"


def _prefix(data: bytes, bits: int, cap: int) -> bytes:
    """What comes out before the place of damage, found by feeding ever smaller steps."""
    d, out, at = zlib.decompressobj(bits), bytearray(), 0
    step = 4096
    while at < len(data) and len(out) < cap:
        ahead = d.copy()
        try:
            out += ahead.decompress(data[at : at + step], cap - len(out))
        except zlib.error:
            if step == 1:
                break
            step = 64 if step == 4096 else 1
            continue
        d, at = ahead, at + step
    return bytes(out)


def flate(data: bytes, cap: int = FLATE_CAP) -> Decoded:
    """zlib after white-space, then raw deflate after each part of that white-space; the first clean, non-empty reading wins, else the longest."""
    lead = len(data) - len(data.lstrip(BLANK))
    best: Decoded = (b"", "flate: nothing to read")
    for bits, at in [(15, lead), *((-15, k) for k in range(lead + 1))]:
        out = _inflate(data[at:], bits, cap)
        if out[0] and out[1] is None:
            return out
        if len(out[0]) > len(best[0]) or (not out[0] and out[1] is None and not best[0]):
            best = out
    return best


def lzw(data: bytes, early: int = 1) -> Decoded:
    """Codes of 9 to 12 bits, high bits first; data that just ends is complete."""
    table: list[bytes] = []
    out: list[bytes] = []
    held = bits = 0
    width, last = 9, b""
    base = [bytes([k]) for k in range(256)] + [b"", b""]
    table = list(base)
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits
        held &= (1 << bits) - 1
        if code == 257:
            return b"".join(out), None
        if code == 256:
            table, width, last = list(base), 9, b""
            continue
        if not last:
            if code > 255:
                return b"".join(out), "lzw: a first code that is no byte"
            entry = table[code]
        else:
            if code < len(table):
                entry = table[code]
            elif code == len(table) and len(table) < 4096:
                entry = last + last[:1]
            else:
                return b"".join(out), "lzw: a code not yet defined"
            if len(table) < 4096:
                table.append(last + entry[:1])
        out.append(entry)
        last = entry
        width = min(12, max(9, (len(table) + early).bit_length()))
    return b"".join(out), None


def ascii_hex(data: bytes) -> Decoded:
    """Up to >; an odd last digit stands for its high half."""
    body = re.sub(rb"[\x00\t\n\x0c\r ]", b"", data.split(b">", 1)[0])
    good = re.match(rb"[0-9A-Fa-f]*", body)[0]
    out = bytes.fromhex((good + b"0" * (len(good) % 2)).decode()) if len(good) == len(body) else bytes.fromhex(good[: len(good) // 2 * 2].decode())
    return out, None if len(good) == len(body) else "hex: not a digit"


def ascii85(data: bytes) -> Decoded:
    body = re.sub(rb"[\x00\t\n\x0c\r ]", b"", data)
    body = body.removeprefix(b"<~").split(b"~", 1)[0]
    out, at = bytearray(), 0
    while at < len(body):
        if body[at] == 122:
            out += b"\0\0\0\0"
            at += 1
            continue
        group = body[at : at + 5]
        if not all(33 <= c <= 117 for c in group):
            return bytes(out), "ascii85: not a digit"
        if len(group) == 1:
            return bytes(out), "ascii85: a lone last character"
        value = 0
        for c in group.ljust(5, b"u"):
            value = value * 85 + c - 33
        if value >> 32:
            if len(group) == 5:
                return bytes(out), "ascii85: a group too large"
            value &= 0xFFFFFFFF
        out += value.to_bytes(4, "big")[: len(group) - 1]
        at += len(group)
    return bytes(out), None


def run_length(data: bytes) -> Decoded:
    out, at = [], 0
    while at < len(data):
        n = data[at]
        if n == 128:
            break
        part = data[at + 1 : at + 2 + n] if n < 128 else data[at + 1 : at + 2] * (257 - n)
        out.append(part)
        if len(part) < (n + 1 if n < 128 else 257 - n):
            return b"".join(out), "run length: data ends early"
        at += 2 + n if n < 128 else 2
    return b"".join(out), None


def predict(data: bytes, predictor: int, colors: int = 1, bits: int = 8, columns: int = 1) -> Decoded:
    """Undoes TIFF's predictor 2 or PNG's 10 and up; where that can't be done there is no data."""
    if predictor < 2:
        return data, None
    if not (0 < colors <= 1 << 16 and bits in (1, 2, 4, 8, 16) and 0 < columns):
        return b"", "predictor: impossible geometry"
    if 2 < predictor < 10:
        return b"", "predictor: not defined"
    row = (colors * bits * columns + 7) // 8
    if row > max(ROW_CAP, len(data)):
        return b"", "predictor: a row larger than its data"
    return _tiff(data, colors, bits, row) if predictor == 2 else _png(data, max(1, colors * bits // 8), row)


def _tiff(data: bytes, colors: int, bits: int, row: int) -> Decoded:
    if bits not in (8, 16):
        return b"", "predictor: TIFF of other than 8 or 16 bits"
    whole = len(data) // row * row
    values = np.frombuffer(data[:whole], ">u2" if bits == 16 else np.uint8).reshape(-1, row * 8 // bits // colors, colors) if whole else np.zeros((0, 1, 1), np.uint8)
    summed = np.cumsum(values, axis=1, dtype=np.uint16 if bits == 16 else np.uint8)
    return summed.astype(values.dtype).tobytes() + data[whole:], None


def _png(data: bytes, step: int, row: int) -> Decoded:
    """A last row that the data cuts short is filled with zeros before its filter is undone."""
    count = -(-len(data) // (row + 1))
    rows = np.frombuffer(data.ljust(count * (row + 1), b"\0"), np.uint8).reshape(count, row + 1)
    kinds = rows[:, 0]
    if (kinds > 4).any():
        return b"", "predictor: no such row type"
    out = np.zeros((count + 1, row + step), np.uint8)
    out[1:, step:] = rows[:, 1:]
    at = 1
    while at <= count:
        kind, last = kinds[at - 1], at
        # rows of one kind that is plain sums go together
        while kind in (1, 2) and last < count and kinds[last] == kind:
            last += 1
        now = out[at : last + 1, step:]
        if kind == 1:
            for k in range(step):
                now[:, k::step] = np.cumsum(now[:, k::step], axis=1, dtype=np.uint8)
        elif kind == 2:
            out[at : last + 1] = np.cumsum(out[at - 1 : last + 1], axis=0, dtype=np.uint8)[1:]
        elif kind:
            (_average if kind == 3 else _nearest)(out[at], out[at - 1], step)
        at = last + 1
    return out[1:, step:].tobytes(), None


def _average(now: np.ndarray, above: np.ndarray, step: int) -> None:
    a, b = now.tolist(), above.tolist()
    for k in range(step, len(a)):
        a[k] = (a[k] + (a[k - step] + b[k] >> 1)) & 255
    now[:] = a


def _nearest(now: np.ndarray, above: np.ndarray, step: int) -> None:
    """Adds whichever of left, up and corner is nearest to left + up - corner, in this order."""
    a, b = now.tolist(), above.tolist()
    for k in range(step, len(a)):
        left, up, corner = a[k - step], b[k], b[k - step]
        x, y = up - corner, left - corner
        z = abs(x + y)
        x, y = abs(x), abs(y)
        a[k] = (a[k] + (left if x <= y and x <= z else up if y <= z else corner)) & 255
    now[:] = a


#: The filters' names and their short forms, and those whose data stays an image.
SHORT = {"AHx": "ASCIIHexDecode", "A85": "ASCII85Decode", "LZW": "LZWDecode", "Fl": "FlateDecode", "RL": "RunLengthDecode", "CCF": "CCITTFaxDecode", "DCT": "DCTDecode"}
IMAGES = ("DCTDecode", "JPXDecode", "JBIG2Decode")


def _one(name: str, data: bytes, parms: dict, cap: int) -> Decoded:
    if name == "ASCIIHexDecode":
        return ascii_hex(data)
    if name == "ASCII85Decode":
        return ascii85(data)
    if name == "RunLengthDecode":
        return run_length(data)
    if name == "Crypt":
        return (data, None) if parms.get("Name", "Identity") == "Identity" else (b"", "crypt: a filter other than Identity")
    if name == "CCITTFaxDecode":
        from .fax import fax

        return fax(data, parms)
    if name in ("FlateDecode", "LZWDecode"):
        out, problem = flate(data, cap) if name == "FlateDecode" else lzw(data, int(parms.get("EarlyChange", 1) != 0))
        plain, second = predict(out, *(int(parms.get(k, d)) for k, d in (("Predictor", 1), ("Colors", 1), ("BitsPerComponent", 8), ("Columns", 1))))
        return plain, problem or second
    raise PdfError(f"unknown filter {name}")


def chain(entries: dict) -> list[tuple[str, dict]]:
    """Filters with their parameters; a lone dictionary goes with the first filter."""
    given = entries.get("Filter", entries.get("F"))
    parms = entries.get("DecodeParms", entries.get("DP"))
    names = [] if given is None else [given] if isinstance(given, Name) else given
    if not isinstance(names, list) or not all(isinstance(n, Name) for n in names):
        raise PdfError("filter: neither a name nor a list of names")
    rows = [parms] if isinstance(parms, dict) else parms if isinstance(parms, list) else [] if parms is None else None
    if rows is None or not all(p is None or isinstance(p, dict) for p in rows):
        raise PdfError("filter: parameters of the wrong kind")
    rows = [*rows, *[None] * len(names)]
    return [(SHORT.get(str(n), str(n)), p or {}) for n, p in zip(names, rows, strict=False)]


def decode(entries: dict, raw: bytes, cap: int = FLATE_CAP) -> dict:
    """data or undecoded, image, recovered, cause and the filter at which decoding stopped."""
    result = {"data": raw, "undecoded": None, "image": None, "recovered": False, "cause": None, "filter": None}
    try:
        filters = chain(entries)
    except PdfError as e:
        return result | {"data": None, "undecoded": raw, "recovered": True, "cause": str(e)}
    now = raw
    for name, parms in filters:
        if name in IMAGES:
            return result | {"data": now, "image": name}
        try:
            now, problem = _one(name, now, parms, cap)
        except (PdfError, ValueError, TypeError) as e:
            now, problem = b"", str(e)
        if problem:
            if now:
                return result | {"data": now, "recovered": True, "cause": problem, "filter": name}
            return result | {"data": None, "undecoded": raw, "recovered": True, "cause": problem, "filter": name}
    return result | {"data": now}
