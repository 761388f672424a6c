"""MD5 of many short texts at once, in numpy: the first 32 bits of the digest, as uniform() takes them."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa

_K = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_TURN = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
_WORD = [(1, 0), (5, 1), (3, 5), (7, 0)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_ALL = 0xFFFFFFFF


def _step(kind: int, turn: int, a: int, b: int, c: int, d: int, added: int) -> int:
    """The word that a step of the digest puts in place of a; sums are taken modulo 2^32."""
    f = (d ^ (b & (c ^ d)), c ^ (d & (b ^ c)), b ^ c ^ d, c ^ (b | (d ^ _ALL)))[kind]
    x = (f + a + added) & _ALL
    return (((x << turn) | (x >> (32 - turn))) + b) & _ALL


def _steps(kind: int, turn: int, a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray, word: int | np.ndarray, k: int, x: np.ndarray) -> np.ndarray:
    """_step() of arrays: in place of a, with x for what is between."""
    if kind == 0:
        np.bitwise_xor(c, d, out=x)
        x &= b
        x ^= d
    elif kind == 1:
        np.bitwise_xor(b, c, out=x)
        x &= d
        x ^= c
    elif kind == 2:
        np.bitwise_xor(b, c, out=x)
        x ^= d
    else:
        np.invert(d, out=x)
        x |= b
        x ^= c
    x += a
    if isinstance(word, int):
        x += np.uint32((word + k) & _ALL)
    else:
        x += word
        x += np.uint32(k)
    np.right_shift(x, np.uint32(32 - turn), out=a)
    x <<= np.uint32(turn)
    x |= a
    return np.add(x, b, out=a)


class Tails:
    """The ends of texts whose beginnings, of `before` bytes each, are told later and shared by all of them."""

    def __init__(self, tails: pa.Array, before: int):
        tails = tails.cast(pa.large_binary())
        ends = np.frombuffer(tails.buffers()[1], np.int64)[tails.offset : tails.offset + len(tails) + 1]
        data = np.frombuffer(tails.buffers()[2] or b"", np.uint8)
        sizes, self.before, self.n, self.groups = np.diff(ends), before, len(tails), []
        blocks = (before + sizes + 9 + 63) // 64
        for b in np.unique(blocks):
            own = np.flatnonzero(blocks == b)
            text, lengths = np.zeros((len(own), 64 * int(b)), np.uint8), sizes[own]
            row = np.repeat(np.arange(len(own)), lengths)
            at = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            text[row, before + at] = data[np.repeat(ends[own], lengths) + at]
            text[np.arange(len(own)), before + lengths] = 0x80
            words = text.view("<u4")
            words[:, -2] = 8 * (before + lengths)
            # A word that all texts share is one number.
            self.groups.append((own, [int(w[0]) if (w == w[0]).all() else np.ascontiguousarray(w) for w in words.T]))

    def draws(self, beginning: bytes) -> np.ndarray:
        """The first 32 bits of the digest of beginning + tail, for each tail."""
        if len(beginning) != self.before:
            raise ValueError(f"{len(beginning)} bytes for {self.before}")
        head = np.frombuffer(beginning + bytes(-self.before % 4), "<u4").tolist()
        out, space = np.empty(self.n, np.uint32), np.empty(self.n, np.uint32)
        for own, words in self.groups:
            words = [*((w | h if isinstance(w, int) else w | np.uint32(h)) for w, h in zip(words, head)), *words[len(head) :]]
            state: list = list(_START)
            for at in range(0, len(words), 16):
                now, last = [v if isinstance(v, int) else v.copy() for v in state], at + 16 == len(words)
                # The last block's steps after the last one that changes the first word are not needed.
                for i in range(61 if last else 64):
                    kind = i // 16
                    word, turn = words[at + (_WORD[kind][0] * i + _WORD[kind][1]) % 16], _TURN[kind][i % 4]
                    a, b, c, d = now
                    if isinstance(word, int) and isinstance(a, int):
                        now = [d, _step(kind, turn, a, b, c, d, word + _K[i]), b, c]
                    else:
                        if isinstance(a, int):
                            a, b, c, d = (np.full(len(own), v, np.uint32) for v in now)
                        now = [d, _steps(kind, turn, a, b, c, d, word, _K[i], space[: len(own)]), b, c]
                # After 61 steps the first word stands where the second does after 64.
                now = [now[1], 0, 0, 0] if last else now
                state = [(v + n) & _ALL if isinstance(n, int) and isinstance(v, int) else np.add(np.uint32(v) if isinstance(v, int) else v, np.uint32(n) if isinstance(n, int) else n) for v, n in zip(state, now, strict=True)]
            out[own] = np.uint32(state[0]) if isinstance(state[0], int) else state[0]
        return out.byteswap()
