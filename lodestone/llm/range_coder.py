"""Adaptive context-mixing range coder for arrays of ids.

A block is cut into lanes, runs of neighbouring ids that are coded in step by one shared model, each with a range
coder of its own, so that numpy handles a step of all lanes at once. For each id the contexts of order 2 and order 1 name
a candidate; whether it is right is coded with a probability that mixes, in the logistic domain with learned weights, what
order 2, order 1 and order 0 say of it. Otherwise the id itself is coded by adaptive order-0 frequencies. Contexts learn
at every step, the mix every PACE steps, and order 0 at steps that grow by half.

A lane's range is kept above 2**32: when it falls below, 32 settled bits leave, and where they are not settled the range is
first cut to the part in which they are. So an id moves a lane by one word at most.

All arithmetic is in integers, so that files decode on any machine. Each block starts from a fresh model and carries a
CRC-32 of its ids and one of its bytes. An alphabet has 2**(ORDER0 - 1) ids at most.
"""
from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"LDC3"
#: Bits of order-0 frequencies, of candidate probabilities and of order 2's slots; lanes at most, steps at least.
ORDER0, FLAG, SLOT_BITS, LANES, STEPS, PACE = 20, 12, 18, 4096, 64, 16
_U = np.uint64
_WORD, _LOW, _MASK, _FLAG, _ORDER0 = _U(32), _U(1 << 32), _U((1 << 32) - 1), _U(FLAG), _U(ORDER0)
_p = np.arange(1, 1 << FLAG) / (1 << FLAG)
_STRETCH = np.concatenate([[-2047], np.clip(np.rint(np.log(_p / (1 - _p)) * 256), -2047, 2047)]).astype(np.int64)
_SQUASH = np.clip(np.rint((1 << FLAG) / (1 + np.exp(-np.arange(-2048, 2048) / 256))), 1, (1 << FLAG) - 1).astype(np.int64)

#: How much surer an entry is after another id (first 16, by how sure it was; under 2 it is replaced) or its own id (the others).
_MOVES = np.array([-((k + 1) >> 1) for k in range(16)] + [int(k < 15) for k in range(16)], np.int32)


class _Model:
    """What coder and decoder know alike. A context's entry is its id and, in 4 bits, how sure it is."""

    def __init__(self, ids: int, lanes: int):
        self.n = ids
        self.prev, self.hash = np.zeros(lanes, np.int64), np.zeros(lanes, np.uint32)
        self.one, self.two = np.zeros(ids, np.int32), np.zeros(1 << SLOT_BITS, np.int32)
        self.entry = np.zeros((2, lanes), np.int32)
        # hits and trials by how sure order 2 is, how sure order 1 is and whether it agrees, how common the candidate is
        self.hits, self.tried = [np.ones(k, np.int64) for k in (16, 32, 16)], [np.full(k, 4, np.int64) for k in (16, 32, 16)]
        self.weights = np.full((16, 3), 22000, np.int64)
        self.count, self.seen, self.flags, self.step, self.next = np.zeros(ids, np.int64), [], [], 0, 1
        self._mix()
        self._rebuild()

    def _mix(self) -> None:
        """The probability for each combination of the three keys."""
        if self.flags:
            got = np.bincount(np.concatenate(self.flags), minlength=2 << 13).reshape(16, 32, 16, 2)
            self.flags = []
            tried = got.sum(3)
            err = (got[..., 1] << FLAG) - self.p.reshape(16, 32, 16) * tried
            rows = np.maximum(1, tried.sum((1, 2)))
            for j, axes in enumerate(((1, 2), (0, 2), (0, 1))):
                shape = [1, 1, 1]
                shape[j] = -1
                self.weights[:, j] += (err * self.inputs[j].reshape(shape)).sum((1, 2)) // (rows * 128)
                self.hits[j] += got[..., 1].sum(axes)
                self.tried[j] += tried.sum(axes)
                if self.tried[j].max() > 1 << 20:
                    self.hits[j], self.tried[j] = (self.hits[j] + 1) >> 1, (self.tried[j] >> 1) + 2
        self.inputs = [_STRETCH[(h << FLAG) // t] for h, t in zip(self.hits, self.tried, strict=True)]
        w, (a, b, c) = self.weights, self.inputs
        dot = (w[:, 0] * a)[:, None, None] + (w[:, 1, None] * b)[:, :, None] + (w[:, 2, None] * c)[:, None, :]
        self.p = _SQUASH[np.clip(dot >> 16, -2047, 2047) + 2048].reshape(-1)
        self.range = self.p.astype(_U)

    def _rebuild(self) -> None:
        if self.seen:
            self.count += np.bincount(np.concatenate(self.seen), minlength=self.n)
            self.seen = []
        freq = 1 + self.count * ((1 << ORDER0) - self.n) // max(1, int(self.count.sum()))
        freq[0] += (1 << ORDER0) - int(freq.sum())
        self.sizes, self.cum, self.freq = freq, (np.cumsum(freq) - freq).astype(_U), freq.astype(_U)
        self.common = np.minimum(15, np.frexp(freq.astype(np.float64))[1] >> 1).astype(np.int32)
        self.inverse = None

    def guess(self) -> tuple[np.ndarray, np.ndarray]:
        """The candidate of each lane, and its probability in FLAG bits."""
        self.slot = ((self.hash + self.prev.astype(np.uint32)) * np.uint32(2654435761) >> np.uint32(32 - SLOT_BITS)).astype(np.int64)
        e = self.entry
        self.two.take(self.slot, out=e[0], mode="clip")
        self.one.take(self.prev, out=e[1], mode="clip")
        self.sure = e & 15
        self.cand = np.where(self.sure[0] > 0, e[0], e[1]) >> 4
        agree = ((e[1] >> 4) == self.cand).view(np.int8)
        self.key = (self.sure[0] << 9) + (agree.astype(np.int32) << 8) + (self.sure[1] << 4) + self.common.take(self.cand, mode="clip")
        return self.cand, self.range.take(self.key, mode="clip")

    def learn(self, ids: np.ndarray, hit: np.ndarray) -> None:
        """ids: int32."""
        self.flags.append((self.key << 1) + hit)
        e, sure = self.entry, self.sure
        same = (e >> 4) == ids
        new = e + _MOVES.take((same.view(np.int8) << 4) + sure, mode="clip")
        np.copyto(new, (ids << 4) + 1, where=~same & (sure < 2))
        self.two[self.slot], self.one[self.prev] = new[0], new[1]
        self.hash = (self.prev.astype(np.uint32) + np.uint32(1)) * np.uint32(40503)
        self.prev = ids.astype(np.int64)
        self.seen.append(self.prev)
        self.step += 1
        if self.step % PACE == 0 or self.step < 8:
            self._mix()
        if self.step == self.next:
            self._rebuild()
            self.next = self.step + max(1, self.step // 2)


def _settle(low: np.ndarray, rng: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lanes that emit a word now, and the words; low and rng are moved on."""
    at = np.flatnonzero(rng < _LOW)
    a, r = low[at], rng[at]
    whole = (a ^ (a + r - _U(1))) < _LOW
    rng[at] = np.where(whole, r, (~a + _U(1)) & _MASK) << _WORD
    low[at] = a << _WORD
    return at, a >> _WORD


def encode_block(ids: np.ndarray, alphabet: int) -> bytes:
    if alphabet > 1 << (ORDER0 - 1):
        raise ValueError(f"an alphabet of {alphabet} ids is too large for this format")
    n = len(ids)
    lanes = max(1, min(LANES, 1 << max(0, (n // STEPS).bit_length() - 1)))
    steps = -(-n // lanes)
    grid = np.zeros(lanes * steps, np.int32)
    grid[:n] = ids
    grid = np.ascontiguousarray(grid.reshape(lanes, steps).T)
    model = _Model(alphabet, lanes)
    low, rng, pos = np.zeros(lanes, _U), np.full(lanes, 2**64 - 1, _U), np.zeros(lanes, np.int64)
    wide = steps + 4
    out, base, full = np.zeros(lanes * wide, np.uint32), np.arange(lanes) * wide, _U(1 << FLAG)
    for step in grid:
        cand, p = model.guess()
        hit = cand == step
        r = rng >> _FLAG
        rng = r * p
        # a miss goes on within its part of the range
        miss = np.flatnonzero(~hit)
        part, s = (r[miss] * (full - p[miss])) >> _ORDER0, step[miss]
        low[miss] += rng[miss] + part * model.cum[s]
        rng[miss] = part * model.freq[s]
        at, word = _settle(low, rng)
        out[base[at] + pos[at]] = word
        pos[at] += 1
        model.learn(step, hit)
    for _ in range(2):
        out[base + pos] = low >> _WORD
        pos += 1
        low = low << _WORD
    words = out.reshape(lanes, wide)[np.arange(wide)[None, :] < pos[:, None]]
    crc = zlib.crc32(ids.astype("<u4").tobytes())
    body = pos.astype("<u4").tobytes() + words.astype("<u4").tobytes()
    return struct.pack("<4sIIIIII", MAGIC, alphabet, n, lanes, steps, crc, zlib.crc32(body)) + body


def decode_block(raw: bytes) -> np.ndarray:
    magic, alphabet, n, lanes, steps, crc, body = struct.unpack_from("<4sIIIIII", raw)
    if magic != MAGIC:
        raise ValueError("not a block of this format")
    if zlib.crc32(raw[28:]) != body:
        raise ValueError("block is damaged")
    sizes = np.frombuffer(raw, "<u4", lanes, 28).astype(np.int64)
    words = np.concatenate([np.frombuffer(raw, "<u4", -1, 28 + 4 * lanes), np.zeros(4, "<u4")]).astype(_U)
    at = np.cumsum(sizes) - sizes
    code = words[at] << _WORD | words[at + 1]
    at += 2
    model, full = _Model(alphabet, lanes), _U(1 << FLAG)
    low, rng = np.zeros(lanes, _U), np.full(lanes, 2**64 - 1, _U)
    grid = np.zeros((steps, lanes), np.int32)
    for t in range(steps):
        cand, p = model.guess()
        if model.inverse is None:
            model.inverse = np.repeat(np.arange(alphabet, dtype=np.uint16 if alphabet <= 1 << 16 else np.int32), model.sizes)
        r = rng >> _FLAG
        rng = r * p
        off = code - low
        hit = off < rng
        miss = np.flatnonzero(~hit)
        part, over = (r[miss] * (full - p[miss])) >> _ORDER0, rng[miss]
        v = np.minimum((off[miss] - over) // part, _U((1 << ORDER0) - 1)).astype(np.int64)
        s = model.inverse[v]
        step = grid[t]
        step[:] = cand
        step[miss] = s
        low[miss] += over + part * model.cum[s]
        rng[miss] = part * model.freq[s]
        moved, _ = _settle(low, rng)
        code[moved] = code[moved] << _WORD | words[at[moved]]
        at[moved] += 1
        model.learn(step, hit)
    ids = np.ascontiguousarray(grid.T).reshape(-1)[:n].astype(np.int64)
    if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
        raise ValueError("block fails its checksum")
    return ids
