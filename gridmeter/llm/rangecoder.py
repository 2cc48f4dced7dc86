"""Adaptive context-mixing range coder for token ids below 65,536.

An id is coded in one step from a mixture of three distributions: of all ids so far (order 0), of ids after the id before
(order 1), and of ids after the two before (order 2). A context of orders 1 and 2 holds two ids with small counts; what such
counts are worth is learned from the outcomes, and what they leave open falls to order 0. The weights of the three orders
follow how well each did, apart for every pair of counts. The mixture drives a 64-bit range coder that emits 16-bit words.

Many blocks are coded at once, one to a lane of numpy arrays, and share one model, which so stays in a processor's cache and
learns from all of them; blocks coded together are decoded together. Lanes that meet in a context are taken in their order.
All arithmetic is on integers, so any machine decodes what another encoded.
"""

from __future__ import annotations

import numpy as np

LANES = 4096
IDS = 1 << 16
#: Shares of order 0 are out of 2^20, weights out of 2^12; what is coded is out of 2^32.
SHARE, WEIGHT = 20, 12
CONTEXTS = 1 << 17
TOP = 7
#: Weights are renewed after every step of the first, then after one of so many; shares of order 0 after steps 1, 2, 4 and so on, and every fourth time.
COUNTED, EVERY = 32, 8
_LEAST = np.uint64(1 << 48)
_WORD, _HEAD, _TOTAL = np.uint64(16), np.uint64(48), np.uint64(32)


def _transitions() -> np.ndarray:
    """Counts of a context's two ids after (counts before, outcome), and in bit 6 whether the coded id becomes the first."""
    out = np.zeros((TOP + 1, TOP + 1, 3), dtype=np.int64)
    for a in range(TOP + 1):
        for b in range(TOP + 1):
            more = min(b + 1, TOP)
            out[a, b, 0] = min(a + 1, TOP) << 3 | b
            out[a, b, 1] = 64 | more << 3 | a if more > a else a << 3 | more
            out[a, b, 2] = (a - 1) << 3 | 1 if a else 64 | 1 << 3
    return out.ravel()


#: What becomes of both contexts of an id, by their counts and which of the four candidates it was (the first of order 1 in the
#: highest of four bits): new counts, and what is done to the two ids of each context.
_KEEP, _TAIL, _HEAD_OF = 0, 1, 2


def _steps() -> np.ndarray:
    after = _transitions().reshape(64, 3)
    outcome = np.array([2, 1, 0, 0])
    done = np.where(after >= 64, _HEAD_OF, np.where(np.arange(3) == 0, _KEEP, _TAIL))
    both, code = np.arange(4096)[:, None], np.arange(16)[None, :]
    one, two = (both & 63, outcome[code >> 2]), (both >> 6, outcome[code & 3])
    counts = after[two] % 64 << 6 | after[one] % 64
    return (counts << 4 | done[two] << 2 | done[one]).astype(np.int32).ravel()


_AFTER, _OUTCOME = _steps(), np.array([2, 1, 0, 0])
#: Bits that stay, and bits that the coded id gives, by what is done to both contexts; the first id gives the others.
_STAY = np.array([[0xFFFFFFFF, 0xFFFF, 0, 0][i & 3] | [0xFFFFFFFF, 0xFFFF, 0, 0][i >> 2] << 32 for i in range(16)], dtype=np.uint64).view(np.int64)
_GIVE = np.array([[0, 0xFFFF0000, 0xFFFF, 0][i & 3] | [0, 0xFFFF0000, 0xFFFF, 0][i >> 2] << 32 for i in range(16)], dtype=np.uint64).view(np.int64)
_FIRST = ~(_STAY | _GIVE)
_IDS = np.arange(IDS).astype(np.uint16)
#: Four times the same 16 bits; times this, the highest 16 bits are the sum of all four.
_FOUR = 0x0001000100010001
_PAIRS = 0xFFFFFFFF


class Model:
    """What the ids so far tell of the next one, for all lanes.

    The candidates of a lane are four: the first and second id of order 1, then of order 2. Their ids lie in one number of
    four times 16 bits, as do their weights."""

    def __init__(self, lanes: int, find: bool = False):
        self.before = np.zeros((2, lanes), dtype=np.int64)
        # A context: first id, second id, from bit 32 on counts of both (order 2: from bit 38 on).
        self.contexts = (np.zeros(IDS, dtype=np.int64), np.zeros(CONTEXTS, dtype=np.int64))
        self.outcomes = np.tile(np.array([1, 1, 2], dtype=np.int64), (2, 64, 1))
        self.credit, self.trials = np.full((2, 64), 4 << WEIGHT, dtype=np.int64), np.full(64, 12 << WEIGHT, dtype=np.int64)
        self.seen, self.unseen = np.zeros(IDS, dtype=np.int64), []
        self.step, self.finds = 0, find
        self._share()
        self._weigh()

    def _share(self) -> None:
        """Shares of order 0; every id has one."""
        if self.unseen:
            self.seen += np.bincount(np.concatenate(self.unseen), minlength=IDS)
        self.unseen = []
        n = int(self.seen.sum())
        if n:
            held = np.flatnonzero(self.seen)
            share = np.ones(IDS, dtype=np.int64)
            share[held] += self.seen[held] * ((1 << SHARE) - IDS) // n
            share[self.seen.argmax()] += (1 << SHARE) - int(share.sum())
        else:
            share = np.full(IDS, (1 << SHARE) // IDS)
        # Begin from bit 32 on, size below.
        self.share = np.cumsum(share) - share << 32 | share
        if self.finds:
            self.id_at = np.repeat(_IDS, share)

    def _weigh(self) -> None:
        """Weights of the candidates by the counts of both contexts; the counts of their first ids select those of the orders."""
        odds = (self.outcomes[:, :, :2] << WEIGHT) // self.outcomes.sum(axis=2, keepdims=True)
        weights = np.maximum((self.credit << WEIGHT) // self.trials * 4064 >> WEIGHT, 8).reshape(2, 8, 8)
        odds = odds[:, :, 0] | odds[:, :, 1] << 32
        # By the first and second count of order 2, then of order 1.
        one = odds[0].reshape(1, 1, 8, 8) * weights[0][:, None, :, None] >> WEIGHT & 0x1FFF00001FFF
        two = odds[1].reshape(8, 8, 1, 1) * weights[1][:, None, :, None] >> WEIGHT & 0x1FFF00001FFF
        one, two = one | one >> 16, two | two >> 16
        self.masses = ((one & _PAIRS) + (two << 32)).ravel()
        self.rests = (1 << WEIGHT) - (self.masses * _FOUR >> 48)

    def predict(self, n: int) -> None:
        """Candidates of the next id in the first n lanes, with their weights; the rest is order 0's."""
        one, two = self.before[0, :n], self.before[1, :n]
        self.n, self.at = n, (one, (one * 0x2545F491 + two * 0x3C6EF372) >> 9 & CONTEXTS - 1)
        held = [t.take(a, mode="clip") for t, a in zip(self.contexts, self.at, strict=True)]
        self.both = (held[0] | held[1]) >> 32
        self.ids = held[0] & _PAIRS | held[1] << 32
        self.mass = self.masses.take(self.both, mode="clip")
        self.rest = self.rests.take(self.both, mode="clip")

    def interval(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and size of the ids' shares of the mixture, out of 2^32."""
        self.four = ids * _FOUR
        held, wanted, mass = self.ids.view(np.uint16), self.four.view(np.uint16), self.mass.view(np.uint16)
        self.same = held == wanted
        self.hit = mass * self.same
        hit = self.hit.view(np.uint64) * np.uint64(_FOUR) >> _HEAD
        below = (mass * (held < wanted)).view(np.uint64) * np.uint64(_FOUR) >> _HEAD
        both = (self.rest * self.share.take(ids, mode="clip")).view(np.uint64)
        both += (below << _TOTAL | hit) << np.uint64(SHARE)
        self.size = both & np.uint64(_PAIRS)
        return both >> _TOTAL, self.size

    def find(self, value: np.ndarray) -> np.ndarray:
        """The ids whose shares hold the values."""
        value, rest = value.astype(np.uint32), self.rest.astype(np.uint32)
        keys = np.empty((4, self.n), dtype=np.uint32)
        for i, key in enumerate(keys):
            np.left_shift(self.ids.view(np.uint16)[i::4], np.uint32(16), out=key)
            key |= self.mass.view(np.uint16)[i::4]
        # The candidates in order.
        for i, j in ((0, 1), (2, 3), (0, 2), (1, 3), (1, 2)):
            low = np.minimum(keys[i], keys[j])
            np.maximum(keys[i], keys[j], out=keys[j])
            keys[i] = low
        below, passed, out, inside = np.zeros_like(value), np.zeros_like(value), np.zeros_like(value), np.zeros(self.n, dtype=bool)
        for key in keys:
            ids, mass = key >> np.uint32(16), key << np.uint32(SHARE)
            share = self.share.take(ids, mode="clip").view(np.uint32)
            begin = rest * share[1::2]
            begin += below
            size = rest * share[::2]
            size += mass
            # Below the begin, the difference wraps around, and is beyond any size from there.
            here = value - begin < size
            after = value >= begin
            after &= ~here
            passed += mass * after
            out = np.maximum(out, ids * here)
            inside |= here
            below += mass
        free = np.minimum((value - passed) // rest, np.uint32((1 << SHARE) - 1))
        return np.where(inside, out, self.id_at.take(free, mode="clip")).astype(np.int64)

    def update(self, ids: np.ndarray) -> None:
        """Learn the ids, after `interval` of them."""
        code = self.same.view(np.uint32) * np.uint32(0x08040201) >> np.uint32(24)
        if self.step < COUNTED or self.step % EVERY == EVERY - 1:
            self._count(code)
        after = _AFTER.take(self.both << 4 | code, mode="clip")
        done = after & 15
        stay, give, first = (table.take(done, mode="clip") for table in (_STAY, _GIVE, _FIRST))
        held = self.ids & stay | self.four & give | self.ids << 16 & first
        counts = after.astype(np.int64) << 28
        self.contexts[0][self.at[0]] = held & _PAIRS | counts & 0x3F << 32
        self.contexts[1][self.at[1]] = held >> 32 & _PAIRS | counts & 0xFC0 << 32
        self.unseen.append(ids)
        self.before[1, : self.n], self.before[0, : self.n] = self.before[0, : self.n], ids
        self.step += 1
        if self.step & self.step - 1 == 0 or self.step % (4 * EVERY) == 0:
            self._share()

    def _count(self, code: np.ndarray) -> None:
        pair = self.both >> 6 & 56 | self.both >> 3 & 7
        mass = self.hit.view(np.uint32)
        for o, (counts, found) in enumerate(((self.both & 63, code >> 2), (self.both >> 6, code & 3))):
            self.outcomes[o] += np.bincount(counts * 3 + _OUTCOME[found], minlength=192).reshape(64, 3)
            mine = (mass[o::2] & 0xFFFF) + (mass[o::2] >> 16)
            # Sums of whole doubles are exact below 2^53.
            worth = (mine.astype(np.uint64) << np.uint64(SHARE + WEIGHT)) // self.size
            self.credit[o] += np.bincount(pair, weights=worth, minlength=64).astype(np.int64)
        self.trials += np.bincount(pair, minlength=64) << WEIGHT
        self._weigh()


def _ordered(sizes: np.ndarray) -> np.ndarray:
    return np.argsort(-sizes, kind="stable")


def encode(blocks: list[np.ndarray]) -> list[bytes]:
    """Coded bytes of every block of ids."""
    out: list[bytes] = [b""] * len(blocks)
    for lo in range(0, len(blocks), LANES):
        part = blocks[lo : lo + LANES]
        order = _ordered(np.array([len(b) for b in part]))
        for i, coded in zip(order.tolist(), _encode([part[i] for i in order]), strict=True):
            out[lo + i] = coded
    return out


def _encode(blocks: list[np.ndarray]) -> list[bytes]:
    sizes = np.array([len(b) for b in blocks])
    lanes, longest = len(blocks), int(sizes[0]) if len(blocks) else 0
    rows = np.zeros((lanes, longest), dtype=np.int64)
    for row, block in zip(rows, blocks, strict=True):
        row[: len(block)] = block
    if rows.size and rows.max() >= IDS:
        raise ValueError("ids of 65,536 and more have no code")
    ids = np.ascontiguousarray(rows.T)
    model = Model(lanes)
    low, width = np.zeros(lanes, dtype=np.uint64), np.full(lanes, 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
    # An id has a share of 8 / 2^32 at least: two words. A word is held back until the next one, since it may get a carry; one
    # that overflows then is settled at the end. The first word of a lane is before its bits.
    width_of = longest * 2 + 3
    out, held = np.zeros(lanes * width_of, dtype=np.uint32), np.zeros(lanes, dtype=np.uint32)
    begins = np.arange(lanes) * width_of
    at, past = begins.copy(), np.searchsorted(-sizes, -np.arange(longest), side="left").tolist()
    for t, n in enumerate(past):
        model.predict(n)
        begin, size = model.interval(ids[t, :n])
        low_n, width_n, held_n, at_n = low[:n], width[:n], held[:n], at[:n]
        unit = width_n >> _TOTAL
        begin *= unit
        low_n += begin
        held_n += low_n < begin
        np.multiply(unit, size, out=width_n)
        small = width_n < _LEAST
        while small.any():
            out[at_n] = held_n
            at_n += small
            np.copyto(held_n, low_n >> _HEAD, where=small, casting="unsafe")
            shift = small * np.uint64(16)
            low_n <<= shift
            width_n <<= shift
            small = width_n < _LEAST
        model.update(ids[t, :n])
    # The first word that, followed by zeros, lies in the interval.
    step = _LEAST - np.uint64(1)
    low += step
    held += low < step
    out[at] = held
    out[at + 1] = low >> _HEAD
    at -= begins
    out = out.reshape(lanes, width_of)[:, : int(at.max(initial=0)) + 2]
    while (full := out >> 16).any():
        out &= 0xFFFF
        out[:, :-1] += full[:, 1:]
    words = out.astype("<u2")
    return [words[i, 1 : n + 2].tobytes() if sizes[i] else b"" for i, n in enumerate(at.tolist())]


def decode(coded: list[bytes], sizes: list[int]) -> list[np.ndarray]:
    """Ids of every block, given all blocks that were encoded together, in order, and how many ids each has."""
    out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(coded)
    for lo in range(0, len(coded), LANES):
        size = np.array(sizes[lo : lo + LANES])
        order = _ordered(size)
        for i, ids in zip(order.tolist(), _decode([coded[lo + i] for i in order], size[order]), strict=True):
            out[lo + i] = ids
    return out


def _decode(coded: list[bytes], sizes: np.ndarray) -> list[np.ndarray]:
    lanes, longest = len(coded), int(sizes[0]) if len(sizes) else 0
    words = np.zeros((lanes, max((len(c) // 2 for c in coded), default=0) + 4), dtype=np.uint64)
    for i, c in enumerate(coded):
        words[i, : len(c) // 2] = np.frombuffer(c, dtype="<u2")
    code = words[:, 0] << _HEAD | words[:, 1] << _TOTAL | words[:, 2] << _WORD | words[:, 3]
    width = np.full(lanes, 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
    # The zeros behind a lane's words are as many as are read past them.
    each, words = words.shape[1], words.ravel()
    at = np.arange(lanes) * each + 4
    ids = np.zeros((longest, lanes), dtype=np.uint32)
    model = Model(lanes, find=True)
    past = np.searchsorted(-sizes, -np.arange(longest), side="left").tolist()
    for t, n in enumerate(past):
        code_n, width_n, at_n = code[:n], width[:n], at[:n]
        model.predict(n)
        unit = width_n >> _TOTAL
        found = model.find(np.minimum(code_n // unit, np.uint64(0xFFFFFFFF)))
        begin, size = model.interval(found)
        begin *= unit
        code_n -= begin
        np.multiply(unit, size, out=width_n)
        small = width_n < _LEAST
        while small.any():
            shift = small * np.uint64(16)
            code_n <<= shift
            code_n |= words.take(at_n, mode="clip") * small
            at_n += small
            width_n <<= shift
            small = width_n < _LEAST
        model.update(found)
        ids[t, :n] = found
    return [ids[: sizes[i], i].copy() for i in range(lanes)]
