"""Adaptive context-mixing range coder for blocks of token ids.

A block is cut into lanes that are coded side by side with array operations;
all lanes share one model, which learns after every step from the ids of all
lanes. Each id is coded in up to three steps:

1. Which prediction holds: the id last seen after the same two ids (order 2),
   the one after the same id (order 1), or neither. Its probabilities mix, on
   the scale of a sigmoid, how often predictions of this confidence held so far in
   either order; the weights are learned on the way.
2. If neither: the id by its frequency in the block (order 0).
3. If new to the block: the plain 16 bits.

Encoder and decoder run the same model, so nothing but the code is stored.
"""

from __future__ import annotations

import numpy as np

MAX_LANES, LANE_STEPS = 8192, 128
IDS = 1 << 16
NONE = IDS - 1
_TABLE2 = 1 << 18
_CONFIDENT = 8
_FLAG_BITS, _ID_BITS = 12, 16
_U32, _U16 = np.uint64(32), np.uint64(16)
_FULL, _LOW = np.uint64(1 << 48), np.uint64((1 << 48) - 1)
_LEAST = np.uint64(1 << 32)
# Confidence after a miss, and after a hit.
_NEXT = np.array([c >> 1 for c in range(_CONFIDENT)] + [min(c + 1, _CONFIDENT - 1) for c in range(_CONFIDENT)], np.uint8)


# A sigmoid and its inverse of quotients and roots alone: unlike exp and log
# they give the same bits on every machine, as decoding elsewhere needs.
def _stretch(p: np.ndarray) -> np.ndarray:
    return (p - 0.5) / (p * (1 - p))


def _squash(y: np.ndarray) -> np.ndarray:
    return 0.5 + y / (2 * (1 + np.sqrt(1 + y * y)))


def _sum(x: np.ndarray) -> float:
    """Sum in fixed point, the same in any order."""
    return float(np.rint(x * 65536).astype(np.int64).sum()) / 65536


class Model:
    """What the next id of each lane may be, from the ids before."""

    def __init__(self):
        self.id2 = np.full(_TABLE2, NONE, np.uint16)
        self.id1 = np.full(IDS, NONE, np.uint16)
        self.sure2 = np.zeros(_TABLE2, np.uint8)
        self.sure1 = np.zeros(IDS, np.uint8)
        # Hits and tries by confidence of the order, and by both.
        self.tried2, self.held2 = np.full(_CONFIDENT, 2.0), np.full(_CONFIDENT, 1.0)
        self.tried1, self.held1 = np.full(_CONFIDENT, 2.0), np.full(_CONFIDENT, 1.0)
        self.weight = np.array([0.6, 0.6])
        self.flags = np.zeros((2 * _CONFIDENT * _CONFIDENT, 3))
        self.count = np.zeros(IDS, np.int64)
        self.fresh, self.step = [], 0
        c = np.arange(len(self.flags))
        self.c2, self.c1 = (c >> 3) & 7, c & 7
        self.agree = c >= 64
        self._flag_table()
        self._id_table()

    def look(self, before2: np.ndarray, before1: np.ndarray):
        slot = ((before2.astype(np.uint32) * np.uint32(0x9E3B) + before1) * np.uint32(0x85EBCA6B)) >> np.uint32(14)
        a, b = self.id2[slot], self.id1[before1]
        sure2, sure1 = self.sure2[slot], self.sure1[before1]
        context = (sure2 << np.uint8(3)) | sure1 | ((a == b).view(np.uint8) << np.uint8(6))
        self.last = slot, before1, sure2, sure1
        return a, b, context.astype(np.intp)

    def learn(self, a, b, x, cell):
        """Take in the ids of a step; ``cell`` is 3 * context + flag."""
        slot, before1, sure2, sure1 = self.last
        self._tables(self.id2, self.sure2, slot, sure2, a, x)
        self._tables(self.id1, self.sure1, before1, sure1, b, x)
        seen = np.bincount(cell, minlength=self.flags.size).reshape(-1, 3)
        # Weights follow the error of the mixed forecast, context by context.
        n, held = seen.sum(1), seen[:, 0]
        error = held - n * self.first
        total = max(1, n.sum())
        self.weight += 0.02 * np.array([_sum(error * self.in2), _sum(error * self.in1)]) / total
        self.flags += seen
        held1 = np.where(self.agree, seen[:, 0], seen[:, 1])
        self.tried2 += np.bincount(self.c2, n, _CONFIDENT)
        self.held2 += np.bincount(self.c2, seen[:, 0], _CONFIDENT)
        self.tried1 += np.bincount(self.c1, n, _CONFIDENT)
        self.held1 += np.bincount(self.c1, held1, _CONFIDENT)
        self._flag_table()

    def learn_ids(self, fresh):
        """Ids that neither order foresaw. Shares are made anew after the first
        steps and then after every fourth."""
        self.fresh.append(fresh)
        self.step += 1
        if self.step <= 8 or self.step % 4 == 0:
            fresh = np.concatenate(self.fresh)
            self.fresh = []
            if len(fresh):
                self.count += np.bincount(fresh, minlength=IDS)
                self._id_table()

    @staticmethod
    def _tables(ids, sure, slot, old, foreseen, x):
        hit = foreseen == x
        ids[slot] = np.where(old > 1, foreseen, x)
        sure[slot] = _NEXT[old + (hit.view(np.uint8) << np.uint8(3))]

    def _flag_table(self):
        p2, p1 = self.held2 / (self.tried2 + 1), self.held1 / (self.tried1 + 1)
        p2, p1 = np.clip(p2, 1e-3, 0.999), np.clip(p1, 1e-3, 0.999)
        self.in2, self.in1 = _stretch(p2)[self.c2], np.where(self.agree, _stretch(p1)[self.c1], 0.0)
        mixed = _squash(self.weight[0] * self.in2 + self.weight[1] * self.in1)
        n = self.flags.sum(1)
        # The context's own record counts more and more.
        self.first = np.clip((self.flags[:, 0] + 8 * mixed) / (n + 8), 2e-3, 0.99)
        rest = n - self.flags[:, 0]
        second = np.clip((self.flags[:, 1] + 8 * p1[self.c1]) / (rest + 8), 2e-3, 0.99)
        second = np.where(self.agree, 1e-3, second)
        whole = 1 << _FLAG_BITS
        f0 = np.maximum(1, (self.first * whole).astype(np.int64))
        f1 = np.maximum(1, ((1 - self.first) * second * whole).astype(np.int64))
        f1 = np.minimum(f1, whole - 1 - f0)
        edge = np.stack([np.zeros_like(f0), f0, f0 + f1, np.full_like(f0, whole)], 1)
        self.flag_edge = edge.astype(np.uint64)
        self.flag_start = self.flag_edge[:, :3].ravel()
        self.flag_size = np.diff(self.flag_edge, axis=1).ravel()

    def _id_table(self):
        """Shares of the ids seen, at least 1 each; NONE stands for a new id."""
        seen = np.flatnonzero(self.count)
        n = self.count[seen]
        whole = 1 << _ID_BITS
        # Ids new to the block have been as frequent as ids seen once.
        new = max(1, int((n == 1).sum()) if len(n) else 1)
        total = int(n.sum()) + new
        room = whole - len(seen) - 1
        share = 1 + (n * room) // total
        self.id_of = np.append(seen, NONE).astype(np.uint16)
        size = np.append(share, whole - int(share.sum()))
        self.id_edge = np.concatenate([[0], np.cumsum(size)]).astype(np.uint64)
        self.id_size = size.astype(np.uint64)
        self.rank = np.full(IDS, len(seen), np.int32)
        self.rank[seen] = np.arange(len(seen), dtype=np.int32)
        self.rank_of = None

    def ranks(self, v: np.ndarray) -> np.ndarray:
        """The ids (by rank) whose shares hold the values."""
        if self.rank_of is None:
            self.rank_of = np.repeat(np.arange(len(self.id_of), dtype=np.int32), self.id_size.astype(np.int64))
        return self.rank_of[v]


def _lanes(n: int) -> tuple[int, int]:
    """Lanes of a block and steps of all but the last lane."""
    if not n:
        return 0, 0
    steps = -(-n // max(1, min(MAX_LANES, n // LANE_STEPS)))
    return -(-n // steps), steps


class _Writer:
    def __init__(self, lanes: int, steps: int):
        self.room = 3 * steps + 4
        self.out = np.zeros(lanes * self.room, np.uint16)
        self.base = np.arange(lanes, dtype=np.int64) * self.room
        self.at = self.base.copy()
        self.low = np.zeros(lanes, np.uint64)
        self.range = np.full(lanes, _LOW)

    def put(self, lane, start: np.ndarray, size: np.ndarray, bits: int) -> None:
        """Code an interval in some lanes (a slice from 0 or their numbers)."""
        r = self.range[lane] >> np.uint64(bits)
        low = r * start
        low += self.low[lane]
        r *= size
        all_lanes = isinstance(lane, slice)
        over = np.flatnonzero(low >= _FULL)
        if len(over):
            low[over] &= _LOW
            at = self.at[over if all_lanes else lane[over]] - 1
            while len(at):
                self.out[at] += np.uint16(1)
                at = at[self.out[at] == 0] - 1
        small = np.flatnonzero(r < _LEAST)
        if len(small):
            where = small if all_lanes else lane[small]
            at, rest = self.at[where], low[small]
            self.out[at] = rest >> _U32
            self.at[where] = at + 1
            low[small] = (rest << _U16) & _LOW
            r[small] <<= _U16
        self.low[lane], self.range[lane] = low, r

    def finish(self) -> tuple[np.ndarray, np.ndarray]:
        """Words of all lanes one after the other, and how many each has. The
        reader takes missing words as zero."""
        low = self.low + (_LEAST - np.uint64(1))
        over = np.flatnonzero(low >= _FULL)
        at = self.at[over] - 1
        while len(at):
            self.out[at] += np.uint16(1)
            at = at[self.out[at] == 0] - 1
        self.out[self.at] = (low & _LOW) >> _U32
        n = self.at + 1 - self.base
        inside = np.arange(self.room)[None, :] < n[:, None]
        return self.out.reshape(len(n), self.room)[inside], n


class _Reader:
    def __init__(self, words: np.ndarray, n: np.ndarray):
        # Each lane's words, with room for the zeros that were not written.
        spaced = np.zeros(int(n.sum()) + 4 * len(n), np.uint16)
        self.at = np.cumsum(n + 4) - (n + 4)
        spaced[np.arange(len(words)) + np.repeat(4 * np.arange(len(n)), n)] = words
        self.words = spaced
        self.range = np.full(len(n), _LOW)
        self.value = np.zeros(len(n), np.uint64)
        for _ in range(3):
            self.value = (self.value << _U16) | self._next(slice(None))

    def _next(self, lane) -> np.ndarray:
        at = self.at[lane]
        word = self.words[at]
        self.at[lane] = at + 1
        return word.astype(np.uint64)

    def peek(self, lane, bits: int) -> np.ndarray:
        self.part = self.range[lane] >> np.uint64(bits)
        return np.minimum(self.value[lane] // self.part, np.uint64((1 << bits) - 1))

    def take(self, lane, start: np.ndarray, size: np.ndarray) -> None:
        value, rng = self.value[lane] - self.part * start, self.part * size
        small = np.flatnonzero(rng < _LEAST)
        if len(small):
            value[small] = (value[small] << _U16) | self._next(small if isinstance(lane, slice) else lane[small])
            rng[small] <<= _U16
        self.value[lane], self.range[lane] = value, rng


def _grid(n: int):
    lanes, steps = _lanes(n)
    # Lanes still active at a step: all but the last one have every step.
    full = n - (lanes - 1) * steps
    return lanes, steps, lambda t: lanes if t < full else lanes - 1


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code of ids below 65535: 16-bit words and their number per lane."""
    if len(ids) and int(ids.max()) >= NONE:
        raise ValueError("ids of 65535 and more have no code")
    lanes, steps, active = _grid(len(ids))
    grid = np.zeros(lanes * steps, np.uint16)
    grid[: len(ids)] = ids
    grid = np.ascontiguousarray(grid.reshape(lanes, steps).T) if lanes else grid.reshape(0, 0)
    model, out = Model(), _Writer(lanes, steps)
    two = one = np.zeros(lanes, np.uint16)
    for t in range(steps):
        k = active(t)
        two, one, x = two[:k], one[:k], grid[t, :k]
        a, b, context = model.look(two, one)
        missed2 = a != x
        flag = missed2.view(np.uint8) + (missed2 & (b != x)).view(np.uint8)
        f = context * 3 + flag
        out.put(slice(0, k), model.flag_start[f], model.flag_size[f], _FLAG_BITS)
        neither = np.flatnonzero(flag == 2)
        own = x[neither]
        if len(neither):
            r = model.rank[own]
            out.put(neither, model.id_edge[r], model.id_size[r], _ID_BITS)
            new = np.flatnonzero(r == len(model.id_of) - 1)
            if len(new):
                out.put(neither[new], own[new].astype(np.uint64), np.uint64(1), _ID_BITS)
        model.learn(a, b, x, f)
        model.learn_ids(own)
        two, one = one, x
    return out.finish() if lanes else (np.zeros(0, np.uint16), np.zeros(0, np.int64))


def decode(words: np.ndarray, per_lane: np.ndarray, n: int) -> np.ndarray:
    lanes, steps, active = _grid(n)
    grid = np.zeros((steps, lanes), np.uint16)
    model, code = Model(), _Reader(words, per_lane)
    two = one = np.zeros(lanes, np.uint16)
    for t in range(steps):
        k = active(t)
        two, one = two[:k], one[:k]
        a, b, context = model.look(two, one)
        v = code.peek(slice(0, k), _FLAG_BITS)
        edge = model.flag_edge[context]
        flag = (v >= edge[:, 1]).view(np.uint8) + (v >= edge[:, 2]).view(np.uint8)
        f = context * 3 + flag
        code.take(slice(0, k), model.flag_start[f], model.flag_size[f])
        x = np.where(flag == 0, a, b)
        neither = np.flatnonzero(flag == 2)
        own = x[neither]
        if len(neither):
            r = model.ranks(code.peek(neither, _ID_BITS))
            code.take(neither, model.id_edge[r], model.id_size[r])
            own = model.id_of[r]
            new = np.flatnonzero(r == len(model.id_of) - 1)
            if len(new):
                value = code.peek(neither[new], _ID_BITS)
                code.take(neither[new], value, np.uint64(1))
                own[new] = value
            x[neither] = own
        grid[t, :k] = x
        model.learn(a, b, x, f)
        model.learn_ids(own)
        two, one = one, x
    return grid.T.reshape(-1)[:n].astype(np.uint32)
