"""CCITT fax decoding, groups 3 and 4."""

from __future__ import annotations

import numpy as np

#: Terminating and make-up codes of T.4, by run length.
WHITE_ENDS = "00110101 000111 0111 1000 1011 1100 1110 1111 10011 10100 00111 01000 001000 000011 110100 110101 101010 101011 0100111 0001100 0001000 0010111 0000011 0000100 0101000 0101011 0010011 0100100 0011000 00000010 00000011 00011010 00011011 00010010 00010011 00010100 00010101 00010110 00010111 00101000 00101001 00101010 00101011 00101100 00101101 00000100 00000101 00001010 00001011 01010010 01010011 01010100 01010101 00100100 00100101 01011000 01011001 01011010 01011011 01001010 01001011 00110010 00110011 00110100".split()
WHITE_MORE = "11011 10010 010111 0110111 00110110 00110111 01100100 01100101 01101000 01100111 011001100 011001101 011010010 011010011 011010100 011010101 011010110 011010111 011011000 011011001 011011010 011011011 010011000 010011001 010011010 011000 010011011".split()
BLACK_ENDS = "0000110111 010 11 10 011 0011 0010 00011 000101 000100 0000100 0000101 0000111 00000100 00000111 000011000 0000010111 0000011000 0000001000 00001100111 00001101000 00001101100 00000110111 00000101000 00000010111 00000011000 000011001010 000011001011 000011001100 000011001101 000001101000 000001101001 000001101010 000001101011 000011010010 000011010011 000011010100 000011010101 000011010110 000011010111 000001101100 000001101101 000011011010 000011011011 000001010100 000001010101 000001010110 000001010111 000001100100 000001100101 000001010010 000001010011 000000100100 000000110111 000000111000 000000100111 000000101000 000001011000 000001011001 000000101011 000000101100 000001011010 000001100110 000001100111".split()
BLACK_MORE = "0000001111 000011001000 000011001001 000001011011 000000110011 000000110100 000000110101 0000001101100 0000001101101 0000001001010 0000001001011 0000001001100 0000001001101 0000001110010 0000001110011 0000001110100 0000001110101 0000001110110 0000001110111 0000001010010 0000001010011 0000001010100 0000001010101 0000001011010 0000001011011 0000001100100 0000001100101".split()
BOTH_MORE = "00000001000 00000001100 00000001101 000000010010 000000010011 000000010100 000000010101 000000010110 000000010111 000000011100 000000011101 000000011110 000000011111".split()
MODES = {"1": 0, "011": 1, "010": -1, "000011": 2, "000010": -2, "0000011": 3, "0000010": -3, "0001": "pass", "001": "horizontal"}
MOST_COLUMNS, MOST_PIXELS = 1 << 16, 1 << 28
EOL = "000000000001"


def _table(ends: list[str], more: list[str]) -> dict[str, int]:
    return {c: n for n, c in enumerate(ends)} | {c: 64 * (n + 1) for n, c in enumerate(more)} | {c: 1792 + 64 * n for n, c in enumerate(BOTH_MORE)}


RUNS = (_table(WHITE_ENDS, WHITE_MORE), _table(BLACK_ENDS, BLACK_MORE))


class _Ended(Exception):
    pass


class _Bits:
    def __init__(self, data: bytes):
        self.bits = "".join(f"{b:08b}" for b in data)
        self.at = 0

    def code(self, table: dict) -> object:
        for n in range(1, 14):
            found = table.get(self.bits[self.at : self.at + n])
            if found is not None:
                self.at += n
                return found
        raise _Ended

    def run(self, black: int) -> int:
        total = 0
        while True:
            n = self.code(RUNS[black])
            total += n
            if n < 64:
                return total

    def end_of_line(self) -> bool:
        """Skips fill and an end-of-line code, if one comes next."""
        one = self.bits.find("1", self.at)
        if one - self.at >= 11:
            self.at = one + 1
            return True
        if one < 0 and len(self.bits) - self.at >= 11:
            raise _Ended
        return False


def _one_dimensional(r: _Bits, columns: int) -> list[int]:
    edges, at, black = [], 0, 0
    while at < columns:
        at += r.run(black)
        if at > columns:
            raise _Ended
        edges.append(at)
        black ^= 1
    return edges


def _two_dimensional(r: _Bits, above: list[int], columns: int) -> list[int]:
    edges, at, black = [], -1, 0
    while at < columns:
        start = max(at, 0)
        # b1: the first change above, right of `at`, to the colour opposite to the present one
        k = next((i for i, x in enumerate(above) if x > at and i % 2 == black), len(above))
        b1 = above[k] if k < len(above) else columns
        b2 = above[k + 1] if k + 1 < len(above) else columns
        mode = r.code(MODES)
        if mode == "pass":
            at = b2
        elif mode == "horizontal":
            for colour in (black, black ^ 1):
                start += r.run(colour)
                edges.append(min(start, columns))
            at = start
        else:
            at = b1 + mode
            if at < start or at > columns:
                raise _Ended
            edges.append(at)
            black ^= 1
    return edges


def fax(data: bytes, parms: dict) -> tuple[bytes, str | None]:
    """Rows of packed bits, 1 for white unless BlackIs1; short data is padded with white to Rows."""
    k, columns, rows = int(parms.get("K", 0)), int(parms.get("Columns", 1728)), int(parms.get("Rows", 0))
    if not 0 < columns <= MOST_COLUMNS or rows < 0 or columns * max(rows, 1) > MOST_PIXELS:
        return b"", "fax: impossible geometry"
    r, lines, problem = _Bits(data), [], None
    above: list[int] = []
    try:
        while (not rows or len(lines) < rows) and r.at < len(r.bits) and (len(lines) + 1) * columns <= MOST_PIXELS:
            if parms.get("EncodedByteAlign"):
                r.at = -(-r.at // 8) * 8
            ends = 0
            two = k < 0
            while r.end_of_line():
                ends += 1
                if k > 0:
                    two = r.bits[r.at : r.at + 1] == "0"
                    r.at += 1
            if ends > 1 and parms.get("EndOfBlock", True):
                break
            if r.at >= len(r.bits):
                break
            above = _two_dimensional(r, above, columns) if two else _one_dimensional(r, columns)
            lines.append(above)
    except _Ended:
        if "1" in r.bits[r.at :]:
            problem = "fax: no such code"
    marks = np.zeros((max(rows, len(lines)), columns + 1), np.int64)
    for y, edges in enumerate(lines):
        np.add.at(marks[y], np.minimum(edges, columns), 1)
    black = np.cumsum(marks[:, :-1], axis=1) % 2 == 1
    packed = np.packbits(black if parms.get("BlackIs1") else ~black, axis=1)
    return packed.tobytes(), problem if rows == 0 or len(lines) < rows else None
