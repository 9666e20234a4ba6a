"""CCITT fax coding: modified Huffman rows, Group 3 in one and two dimensions, Group 4."""

from __future__ import annotations

import numpy as np

from pixelloom.sources.codecs import need

# Code words, fixed values: runs of 0 to 63, then of 64, 128 and so on to 1728; then runs of
# both colours from 1792 to 2560.
WHITE = """
00110101 000111 0111 1000 1011 1100 1110 1111 10011 10100 00111 01000 001000 000011 110100 110101 101010 101011 0100111 0001100
0001000 0010111 0000011 0000100 0101000 0101011 0010011 0100100 0011000 00000010 00000011 00011010 00011011 00010010 00010011
00010100 00010101 00010110 00010111 00101000 00101001 00101010 00101011 00101100 00101101 00000100 00000101 00001010 00001011
01010010 01010011 01010100 01010101 00100100 00100101 01011000 01011001 01011010 01011011 01001010 01001011 00110010 00110011
00110100
11011 10010 010111 0110111 00110110 00110111 01100100 01100101 01101000 01100111 011001100 011001101 011010010 011010011 011010100
011010101 011010110 011010111 011011000 011011001 011011010 011011011 010011000 010011001 010011010 011000 010011011
"""
BLACK = """
0000110111 010 11 10 011 0011 0010 00011 000101 000100 0000100 0000101 0000111 00000100 00000111 000011000 0000010111 0000011000
0000001000 00001100111 00001101000 00001101100 00000110111 00000101000 00000010111 00000011000 000011001010 000011001011
000011001100 000011001101 000001101000 000001101001 000001101010 000001101011 000011010010 000011010011 000011010100 000011010101
000011010110 000011010111 000001101100 000001101101 000011011010 000011011011 000001010100 000001010101 000001010110 000001010111
000001100100 000001100101 000001010010 000001010011 000000100100 000000110111 000000111000 000000100111 000000101000 000001011000
000001011001 000000101011 000000101100 000001011010 000001100110 000001100111
0000001111 000011001000 000011001001 000001011011 000000110011 000000110100 000000110101 0000001101100 0000001101101 0000001001010
0000001001011 0000001001100 0000001001101 0000001110010 0000001110011 0000001110100 0000001110101 0000001110110 0000001110111
0000001010010 0000001010011 0000001010100 0000001010101 0000001011010 0000001011011 0000001100100 0000001100101
"""
LONG = """
00000001000 00000001100 00000001101 000000010010 000000010011 000000010100 000000010101 000000010110 000000010111 000000011100
000000011101 000000011110 000000011111
"""
#: Two-dimensional modes, fixed values: a shift from b1, or pass and horizontal.
MODES = {"1": 0, "011": 1, "000011": 2, "0000011": 3, "010": -1, "000010": -2, "0000010": -3, "0001": "pass", "001": "horizontal"}
ROWS, GROUP3, GROUP4 = 2, 3, 4


def runs_of(words: str) -> dict[str, int]:
    lengths = [*range(64), *range(64, 1729, 64)]
    return dict(zip(words.split(), lengths)) | dict(zip(LONG.split(), range(1792, 2561, 64)))


RUNS = (runs_of(WHITE), runs_of(BLACK))


class Bits:
    def __init__(self, data: bytes, fill_order: int):
        bits = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little" if fill_order == 2 else "big")
        self.text, self.at = (bits + 48).tobytes().decode(), 0

    def word(self, table: dict, most: int):
        """The entry of the code word that comes next."""
        for n in range(1, most + 1):
            found = table.get(self.text[self.at : self.at + n])
            if found is not None:
                self.at += n
                return found
        need(False, "invalid CCITT data")

    def run(self, color: int) -> int:
        total = 0
        while True:
            n = self.word(RUNS[color], 13)
            total += n
            if n < 64:
                return total

    def end_of_line(self) -> bool:
        """Skip fill and the end-of-line word, if that is what comes."""
        one = self.text.find("1", self.at)
        if one < 0 or one - self.at < 11:
            return False
        self.at = one + 1
        return True


def flat_row(bits: Bits, width: int) -> list[int]:
    """Places where the colour changes, from white, of a row of runs."""
    changes, x, color = [], 0, 0
    while x < width:
        x += bits.run(color)
        need(x <= width, "invalid CCITT data")
        changes.append(x)
        color ^= 1
    return changes


def relative_row(bits: Bits, width: int, above: list[int]) -> list[int]:
    """A row coded by the changes of the row above."""
    changes, a0, color = [], -1, 0
    while a0 < width:
        # b1: the next change above to the other colour; b2: the one after it.
        k = next((j for j in range(color, len(above), 2) if above[j] > a0), len(above))
        b1 = above[k] if k < len(above) else width
        mode = bits.word(MODES, 7)
        if mode == "pass":
            a0 = above[k + 1] if k + 1 < len(above) else width
        elif mode == "horizontal":
            a1 = max(a0, 0) + bits.run(color)
            a0 = a1 + bits.run(color ^ 1)
            need(a0 <= width, "invalid CCITT 2D data")
            changes += [a1, a0]
        else:
            a0 = b1 + mode
            need(0 <= a0 <= width and a0 >= (changes[-1] if changes else 0), "invalid CCITT 2D data")
            changes.append(a0)
            color ^= 1
    return changes


def decode(data: bytes, width: int, height: int, compression: int, options: int = 0, fill_order: int = 1) -> bytes:
    """Packed rows of a strip, black as 1."""
    bits, above = Bits(data, fill_order), []
    out = np.zeros((height, width), np.uint8)
    for y in range(height):
        two = compression == GROUP4
        if compression == ROWS:
            bits.at = -(-bits.at // 8) * 8
        elif compression == GROUP3 and bits.end_of_line() and options & 1:
            two = bits.text[bits.at : bits.at + 1] == "0"
            bits.at += 1
        above = relative_row(bits, width, above) if two else flat_row(bits, width)
        for a, b in zip(above[::2], [*above[1::2], width]):
            out[y, a:b] = 1
    return np.packbits(out, axis=1).tobytes()
