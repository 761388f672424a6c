"""Adaptive context-mixing range coder for token ids, many lanes at a time.

A block is a run of ids coded on its own: its model starts empty, and its checksum covers its ids.
The ids are cut into lanes of equal length. At each step all lanes code one id with the one model of
the block, and the model then learns from all of them, so encoder and decoder see the same past.

For each id the model mixes three distributions over all ids: adaptive counts (order 0), the id that
last followed the id before it (order 1) and the id that last followed the two ids before it (order 2).
The mixing weights are adaptive counts of how often each was right, by the confidence of both guesses,
in MIX parts. The id is coded by its interval in the mixture: at each place the parts of order 0 below
it, and the guesses below it with their whole weight.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"SVRC2\0"
#: Model settings that the file format fixes.
HASH_BITS, LEVELS, REFRESH, GAIN, LIMIT, MIX = 18, 8, 8, 24, 1 << 21, 512
#: Places of the order-0 counts that the decoder looks up together (a power of two; the format does not depend on it).
BUCKET = 32
_U = np.uint64
_W16, _TOP, _BOT, _LOW = _U(16), _U(1 << 48), _U(1 << 32), _U((1 << 32) - 1)


#: What is added to id * LEVELS + confidence of a guess that was wrong (first LEVELS entries) or right.
_MOVE = np.array([(c >> 1) - c for c in range(LEVELS)] + [int(c < LEVELS - 1) for c in range(LEVELS)], np.int32)


class _Model:
    def __init__(self, lanes: int, vocab: int):
        self.vocab = vocab
        # A guess and its confidence are one number, id * LEVELS + confidence.
        self.guess1, self.guess2 = np.zeros(vocab, np.int32), np.zeros(1 << HASH_BITS, np.int32)
        self.seen = np.ones((LEVELS * LEVELS * 2, 3), np.int64)
        self.seen[:, 0] = 4
        self.count = np.ones(vocab, np.int64)
        self.total = vocab
        # Beyond the sums stand values above all, for find().
        self.padded = np.full(vocab + 1 + BUCKET, 1 << 62, np.int64)
        self.cum = self.padded[: vocab + 1]
        self.cum[:] = np.arange(vocab + 1)
        self.buckets: np.ndarray | None = None
        self.before = np.zeros(lanes, np.int64)
        self.last = np.zeros(lanes, np.int64)
        self.step = 0

    def predict(self) -> tuple:
        if self.step % REFRESH == 0 and self.step:
            if self.total > LIMIT:
                self.count = (self.count + 1) >> 1
                self.total = int(self.count.sum())
            np.cumsum(self.count, out=self.cum[1:])
            self.buckets = None
        self.slot = (self.before * 40503 + self.last * 2654435761 >> 7) & ((1 << HASH_BITS) - 1)
        self.p2, self.p1 = self.guess2.take(self.slot), self.guess1.take(self.last)
        self.c2, self.c1 = self.p2 % LEVELS, self.p1 % LEVELS
        g2, g1 = (self.p2 // LEVELS).astype(np.int64), (self.p1 // LEVELS).astype(np.int64)
        self.ctx = (self.c2 * LEVELS + self.c1) * 2 + (g1 == g2)
        # The weights of the few contexts, and then those of the lanes.
        share = (self.seen[:, 1:] * (MIX - 3)) // self.seen.sum(axis=1)[:, None] + 1
        q1, q2 = share[:, 0].take(self.ctx), share[:, 1].take(self.ctx)
        return g2, g1, q2, q1, MIX - q1 - q2

    def find(self, at: np.ndarray) -> np.ndarray:
        """The ids whose order-0 intervals hold these places."""
        if self.buckets is None:
            self.buckets = np.cumsum(np.bincount((self.cum + (BUCKET - 1)) // BUCKET)) - 1
        bucket = at // BUCKET
        x = self.buckets.take(bucket)
        # An interval is one place wide at least, so that a bucket meets at most BUCKET of them.
        several = np.flatnonzero(x < self.buckets.take(bucket + 1))
        y, at = x.take(several), at.take(several)
        k = BUCKET // 2
        while k:
            y += k * (self.padded.take(y + k) <= at)
            k //= 2
        x[several] = y
        return x

    def learn(self, ids: np.ndarray, right2: np.ndarray, right1: np.ndarray) -> None:
        kind = np.maximum(2 * right2.view(np.int8), right1.view(np.int8))
        self.seen += 2 * np.bincount(self.ctx * 3 + kind, minlength=self.seen.size).reshape(self.seen.shape)
        if self.step % REFRESH == 0:
            big = self.seen.sum(axis=1) > 1 << 14
            self.seen[big] = (self.seen[big] + 1) >> 1
        fresh_guess = (ids * LEVELS).astype(np.int32)
        for guess, at, p, c, right in ((self.guess2, self.slot, self.p2, self.c2, right2), (self.guess1, self.last, self.p1, self.c1, right1)):
            case = c + LEVELS * right.view(np.int8)
            p = p + _MOVE.take(case)
            # The guess stays if it was right or is sure; of lanes at one place the last counts.
            np.copyto(p, fresh_guess, where=case < 2)
            guess[at] = p
        fresh = ids.take(np.flatnonzero(kind == 0))
        np.add.at(self.count, fresh, GAIN)
        self.total += GAIN * len(fresh)
        self.before, self.last = self.last, ids
        self.step += 1


def _settle(low: np.ndarray, rng: np.ndarray, moved) -> None:
    """Shift out the words that are settled, lane by lane; moved(lanes, their lows) takes or gives one for each."""
    m, lo, r = None, low, rng
    while True:
        settled = (lo ^ (lo + r)) < _TOP
        go = np.flatnonzero(settled | (r < _BOT))
        if not len(go):
            return
        m = go if m is None else m.take(go)
        lo, r, settled = lo.take(go), r.take(go), settled.take(go)
        if not settled.all():
            r = np.where(settled, r, (~lo + _U(1)) & _LOW)
        moved(m, lo)
        lo, r = lo << _W16, r << _W16
        low[m], rng[m] = lo, r


def encode(ids: np.ndarray, lanes: int, vocab: int) -> bytes:
    """The coded block of ids (each from 0 to vocab - 1)."""
    n = len(ids)
    lanes = max(1, min(lanes, n))
    steps = -(-n // lanes) if n else 0
    grid = np.zeros(lanes * steps, np.int32)
    grid[:n] = ids
    grid = np.ascontiguousarray(grid.reshape(lanes, steps).T)
    model = _Model(lanes, vocab)
    low, rng = np.zeros(lanes, _U), np.full(lanes, (1 << 64) - 1, _U)
    owners: list[np.ndarray] = []
    words: list[np.ndarray] = []

    def put(m: np.ndarray, lo: np.ndarray) -> None:
        owners.append(m.astype(np.uint16 if lanes <= 1 << 16 else np.int64))
        words.append((lo >> _U(48)).astype("<u2"))

    for t in range(steps):
        x = grid[t].astype(np.int64)
        g2, g1, q2, q1, q0 = model.predict()
        right2, right1 = g2 == x, g1 == x
        all_, base = int(model.cum[-1]), model.cum.take(x)
        start = q0 * base + all_ * (q1 * (g1 < x) + q2 * (g2 < x))
        width = q0 * (model.cum.take(x + 1) - base) + all_ * (q1 * right1 + q2 * right2)
        r = rng // _U(all_ * MIX)
        low, rng = low + r * start.view(_U), r * width.view(_U)
        _settle(low, rng, put)
        model.learn(x, right2, right1)
    for _ in range(4 if n else 0):
        put(np.arange(lanes), low)
        low = low << _W16
    ids32 = np.asarray(ids).astype("<u4")
    head = MAGIC + struct.pack("<QIIII", n, lanes, vocab, zlib.crc32(ids32.tobytes()), 0)
    if not n:
        return head
    owner = np.concatenate(owners)
    body = np.concatenate(words)[np.argsort(owner, kind="stable")]
    return head + np.bincount(owner, minlength=lanes).astype("<u4").tobytes() + body.tobytes()


def decode(block: bytes) -> np.ndarray:
    """The ids of a coded block; ValueError if it is not whole."""
    if block[: len(MAGIC)] != MAGIC:
        raise ValueError("not a coded block")
    n, lanes, vocab, crc, _ = struct.unpack_from("<QIIII", block, len(MAGIC))
    at = len(MAGIC) + 24
    if not n:
        return np.zeros(0, np.uint32)
    steps = -(-n // lanes)
    used = np.frombuffer(block, "<u4", lanes, at).astype(np.int64)
    at += 4 * lanes
    if len(block) != at + 2 * int(used.sum()):
        raise ValueError("the block is cut off")
    data = np.concatenate([np.frombuffer(block, "<u2", -1, at), np.zeros(4, "<u2")])
    pos = np.cumsum(used) - used
    code = np.zeros(lanes, _U)
    for _ in range(4):
        code = (code << _W16) | data[pos]
        pos += 1
    model = _Model(lanes, vocab)
    low, rng = np.zeros(lanes, _U), np.full(lanes, (1 << 64) - 1, _U)
    grid = np.zeros((steps, lanes), np.uint32)
    end = len(data) - 1

    def get(m: np.ndarray, lo: np.ndarray) -> None:
        p = pos.take(m)
        code[m] = (code.take(m) << _W16) | data.take(np.minimum(p, end))
        pos[m] = p + 1

    for t in range(steps):
        g2, g1, q2, q1, q0 = model.predict()
        all_ = int(model.cum[-1])
        r = rng // _U(all_ * MIX)
        v = np.minimum((code - low) // r, _U(all_ * MIX - 1)).view(np.int64)
        # Within the interval of a guess, or else beyond some guesses, whose weight is then taken off.
        w2, w1, same = all_ * q2, all_ * q1, g1 == g2
        base2, base1 = model.cum.take(g2), model.cum.take(g1)
        start2, start1 = q0 * base2 + w1 * (g1 < g2), q0 * base1 + w2 * (g2 < g1)
        width2 = q0 * (model.cum.take(g2 + 1) - base2) + w2 + w1 * same
        width1 = q0 * (model.cum.take(g1 + 1) - base1) + w1 + w2 * same
        past1, past2 = v >= start1 + width1, v >= start2 + width2
        right2, right1 = (v >= start2) & ~past2, (v >= start1) & ~past1
        x, start, width = np.where(right2, g2, g1), np.where(right2, start2, start1), np.where(right2, width2, width1)
        free = np.flatnonzero(~(right1 | right2))
        q0 = q0.take(free)
        over = (w1 * past1 + w2 * past2).take(free)
        x[free] = found = model.find((v.take(free) - over) // q0)
        base = model.cum.take(found)
        start[free], width[free] = q0 * base + over, q0 * (model.cum.take(found + 1) - base)
        low, rng = low + r * start.view(_U), r * width.view(_U)
        _settle(low, rng, get)
        grid[t] = x
        model.learn(x, right2, right1)
    ids = np.ascontiguousarray(grid.T).reshape(-1)[:n]
    if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
        raise ValueError("the block's checksum is wrong")
    return ids
