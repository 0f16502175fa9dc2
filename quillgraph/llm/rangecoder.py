"""Adaptive context-mixing range coder for token ids, in numpy.

Ids below 65,536 are coded in blocks of ``BLOCK``, each reset to nothing learned and with its own
checksum, so that any block can be read alone. Within a block an id's interval is a mixture of three
predictions, whose weights depend on the kind of context and are counted as the block goes on: the id that last
followed the two ids before gets the weight of order 2, the one that last followed the id before that of order 1
(if it is another), and all ids share that of order 0 by their frequencies so far, with an escape to plain 16
bits for ids not seen. Predictions and weights are renewed at the positions ``RENEW``, from all ids of the
block before them.

Many blocks are coded in step, one lane each: every numpy operation handles one id of each block.

A block: ``<4sIIII`` magic, ids, coded length, words, crc32 of the three numbers and the payload; then its
32-bit words, little-endian.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BLOCK = 8192
RENEW = (256, 1024, 3072)
LANES = 2048
#: Lanes whose intervals are made at a time: their table of known ids stays in the processor's cache.
STEP_LANES = 16
MAGIC = b"QRC2"
HEAD = struct.Struct("<4sIIII")

NONE = 0xFFFF  # no prediction; also the one id that is never predicted
MIX_BITS, FREQ_BITS = 12, 14
MIX, FREQ = 1 << MIX_BITS, 1 << FREQ_BITS
SIZE_1, SIZE_2 = 1 << 11, 1 << 13
#: Starting counts of (order-2 hit, order-1 hit, neither) by kind of context.
PRIOR = np.array([[0, 0, 8], [1, 1, 6], [4, 1, 4], [2, 1, 5]], np.int64)
U16, U32, ONE = np.uint64(16), np.uint64(32), np.uint64(1)
#: Bits of a plain id's interval, and of a mixed prediction's.
RAW, MIXED = np.uint64(16), np.uint64(MIX_BITS + FREQ_BITS)
LOW16, LOW32 = np.uint64(0xFFFF), np.uint64(0xFFFFFFFF)


class Model:
    """What L lanes have learned from the first t ids of their blocks."""

    def __init__(self, lanes: int):
        self.lanes = np.arange(lanes)
        self.counts = np.zeros((lanes, 4, 3), np.int64)
        self.one, self.two = np.empty(lanes * SIZE_1, np.uint16), np.empty(lanes * SIZE_2, np.uint16)

    def learn(self, seen: np.ndarray) -> None:
        """seen: (t, L) ids, in order of time."""
        t, lanes = seen.shape
        key = np.sort((seen.astype(np.uint32) | (self.lanes.astype(np.uint32) << np.uint32(16))).ravel())
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        times = np.diff(np.append(first, len(key)))
        keys = key[first]
        lane = (keys >> np.uint32(16)).astype(np.int64)
        kinds = np.bincount(lane, minlength=lanes)
        escape = np.maximum(1, FREQ * kinds // (2 * t + kinds))
        room = FREQ - escape - kinds
        freq = 1 + times * room[lane] // t
        begin = np.cumsum(kinds) - kinds
        total = np.cumsum(freq)
        used = np.add.reduceat(freq, begin)
        #: entries by lane: the escape first, then the ids with their frequencies
        self.begin = begin + self.lanes
        own = np.arange(len(keys)) + lane + 1
        self.ids, self.freq = (np.zeros(len(keys) + lanes, np.uint16) for _ in range(2))
        self.ids[own] = keys & np.uint32(0xFFFF)
        self.freq[own], self.freq[self.begin] = freq, FREQ - used
        #: cum, freq and id of an entry in one number, so that one look-up finds the three
        cum = np.empty(len(self.ids), np.uint64)
        cum[own], cum[self.begin] = total - freq - (total - freq)[begin][lane], used
        self.packed = (cum << U32) | (self.freq.astype(np.uint64) << U16) | self.ids
        self.one.fill(NONE)
        self.two.fill(NONE)
        # of equal places the last one stays: assignment goes in order of time
        wide = seen.astype(np.uint32)
        self.one[self.lanes * SIZE_1 + hash_1(wide[:-1])] = seen[1:]
        self.two[self.lanes * SIZE_2 + hash_2(wide[:-2], wide[1:-1])] = seen[2:]
        self._weigh()

    def sizes(self) -> tuple[np.ndarray, np.ndarray]:
        """Entries of each lane, and each entry's place in its lane."""
        size = np.append(self.begin[1:], len(self.ids)) - self.begin
        return size, np.arange(len(self.ids)) - np.repeat(self.begin, size)

    def slots(self) -> np.ndarray:
        """(L * FREQ) entry within its lane, 0 for the escape, of each frequency slot."""
        size, place = self.sizes()
        # slots go by cum: ids first, the escape last
        order = np.arange(len(place)) + 1
        last = self.begin + size - 1
        order[last] = self.begin
        return np.repeat(place[order].astype(np.uint16), self.freq[order])

    def _weigh(self) -> None:
        """By (lane, kind of context, event): where its interval of 2 ** MIXED starts, and its width (of the third event: the factor of a frequency)."""
        n = self.counts * 2 + PRIOR
        f = 1 + n * (MIX - 3) // n.sum(axis=2, keepdims=True)
        f[:, 0, :2] = 0
        f[:, :, 2] = MIX - f[:, :, 0] - f[:, :, 1]
        start = np.zeros_like(f)
        start[:, :, 1], start[:, :, 2] = f[:, :, 0] * FREQ, (f[:, :, 0] + f[:, :, 1]) * FREQ
        f[:, :, :2] *= FREQ
        self.start, self.width = start.astype(np.uint32).ravel(), f.astype(np.uint32).ravel()

    def predict(self, base_2, base_1, before, last) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Predictions of order 2 and 1, and the kind of context: 0 none, 1 order 1 only, 2 both and equal, 3 both.

        base_2 and base_1: where the lanes' tables begin; before and last: ids as uint32.
        """
        two, one = self.two.take(base_2 + hash_2(before, last)), self.one.take(base_1 + hash_1(last))
        return two, one, np.where(two != NONE, np.int64(2) + (two != one), one != NONE)

    def note(self, at: np.ndarray, lanes: np.ndarray) -> None:
        """Counts events: at is (lane * 4 + kind) * 3 + event, where 0 and 1 are hits of order 2 and 1, 2 is neither."""
        self.counts[lanes] += np.bincount((at - 12 * lanes[0]).ravel(), minlength=12 * len(lanes)).reshape(-1, 4, 3)


def hash_1(last: np.ndarray) -> np.ndarray:
    return (last * np.uint32(2654435761)) >> np.uint32(21)


def hash_2(before: np.ndarray, last: np.ndarray) -> np.ndarray:
    return (before * np.uint32(2246822519) + last * np.uint32(3266489917)) >> np.uint32(19)


def segments(n: int) -> list[tuple[int, int]]:
    cuts = [0, *[r for r in RENEW if r < n], n]
    return list(zip(cuts[:-1], cuts[1:]))


def narrowed(low: np.ndarray, wide: np.ndarray) -> np.ndarray:
    """Widths of intervals of 32 bits or less, cut where one goes across a border of 32-bit words."""
    cross = ((low & LOW32) + wide > LOW32 + ONE).nonzero()[0]
    if len(cross):
        wide[cross] = (~low[cross] + ONE) & LOW32
    return wide


class Writer:
    """Range coders in step. The interval is [low, low + range) of 64 bits; whole 32-bit words leave it."""

    def __init__(self, lanes: int, n: int):
        self.low = np.zeros(lanes, np.uint64)
        self.range = np.full(lanes, 0xFFFFFFFFFFFFFFFF, np.uint64)
        self.room = n // 2 + 4  # words a lane, 16 bits an id at first; see reserve
        self.out = np.zeros(lanes * self.room, np.uint32)
        self.begin = np.arange(lanes) * self.room
        self.at = self.begin.copy()

    def put(self, cum, freq, bits: np.uint64, lanes=None) -> None:
        low, wide = (self.low, self.range) if lanes is None else (self.low[lanes], self.range[lanes])
        part = wide >> bits
        low = low + part * cum
        wide = part * freq
        small = (wide <= LOW32).nonzero()[0]
        if len(small):
            l, w = low[small], wide[small]
            w = narrowed(l, w)
            who = small if lanes is None else lanes[small]
            at = self.at[who]
            self.out[at] = l >> U32
            self.at[who] = at + 1
            low[small], wide[small] = l << U32, w << U32
        if lanes is None:
            self.low, self.range = low, wide
        else:
            self.low[lanes], self.range[lanes] = low, wide

    def reserve(self, words: int) -> None:
        used = self.at - self.begin
        if int(used.max(initial=0)) + words > self.room:
            lanes, room = len(used), self.room
            self.room += max(words, room // 2)
            out = np.zeros((lanes, self.room), np.uint32)
            out[:, :room] = self.out.reshape(lanes, room)
            self.out, self.begin = out.ravel(), np.arange(lanes) * self.room
            self.at = self.begin + used

    def finish(self) -> list[np.ndarray]:
        self.reserve(2)
        for shift in (U32, np.uint64(0)):
            self.out[self.at] = (self.low >> shift) & LOW32
            self.at += 1
        return [self.out[a:b] for a, b in zip(self.begin, self.at)]


class Reader:
    def __init__(self, words: list[np.ndarray]):
        lanes = len(words)
        self.begin = np.cumsum([0] + [len(w) for w in words])[:-1]
        self.words = np.concatenate([*words, np.zeros(2, np.uint32)])
        self.low = np.zeros(lanes, np.uint64)
        self.range = np.full(lanes, 0xFFFFFFFFFFFFFFFF, np.uint64)
        self.code = self.words[self.begin].astype(np.uint64) << U32 | self.words[self.begin + 1]
        self.at = self.begin + 2

    def value(self, bits: np.uint64, lanes=None) -> np.ndarray:
        """Where in 2 ** bits the code stands; ``take`` then removes the interval that it stands in."""
        code, low, wide = (self.code, self.low, self.range) if lanes is None else (self.code[lanes], self.low[lanes], self.range[lanes])
        self.part = wide >> bits
        return np.minimum((code - low) // self.part, (ONE << bits) - ONE)

    def take(self, cum, freq, lanes=None) -> None:
        low, part = self.low if lanes is None else self.low[lanes], self.part
        low = low + part * cum
        wide = part * freq
        small = (wide <= LOW32).nonzero()[0]
        if len(small):
            l, w = low[small], wide[small]
            w = narrowed(l, w)
            who = small if lanes is None else lanes[small]
            at = self.at[who]
            self.code[who] = self.code[who] << U32 | self.words.take(at, mode="clip")
            self.at[who] = at + 1
            low[small], wide[small] = l << U32, w << U32
        if lanes is None:
            self.low, self.range = low, wide
        else:
            self.low[lanes], self.range[lanes] = low, wide


def _intervals(model: Model, lanes: np.ndarray, local: np.ndarray, own: np.ndarray, last: np.ndarray, before: np.ndarray):
    """Of (s, l) ids after two others: start and width of their interval, whether the plain id follows, and (lane, kind, event)."""
    two, one, kind = model.predict(lanes * SIZE_2, lanes * SIZE_1, before, last)
    other = ((own != two) | (two == NONE)) & ((own != one) | (one == NONE))
    at = (lanes * 4 + kind) * 3 + np.where(other, np.int64(2), (own != two) | (two == NONE))
    place = local.take(own + ((lanes - lanes[0]) << 16))
    entry = model.packed.take(model.begin[lanes] + place)
    width = model.width.take(at)
    start = model.start.take(at)
    start += width * np.where(other, (entry >> U32).astype(np.uint32), np.uint32(0))
    width *= np.where(other, (entry >> U16).astype(np.uint16), np.uint16(1))
    return start, width, other & (place == 0), at


def _encode(ids: np.ndarray) -> list[np.ndarray]:
    """ids: (n, L). Words of each lane."""
    n, lanes = ids.shape
    out, model = Writer(lanes, n), Model(lanes)
    local = np.zeros(STEP_LANES << 16, np.uint16)
    for a, b in segments(n):
        if a == 0:
            out.reserve(2 * b + 2)
            for t in range(b):
                out.put(ids[t].astype(np.uint64), ONE, RAW)
            continue
        model.learn(ids[:a])
        size, place = model.sizes()
        lane_of = np.repeat(model.lanes, size)
        cum, width, raw = np.empty((b - a, lanes), np.uint32), np.empty((b - a, lanes), np.uint32), np.empty((b - a, lanes), bool)
        for g in range(0, lanes, STEP_LANES):
            own = model.lanes[g : g + STEP_LANES]
            at = np.arange(model.begin[g], model.begin[own[-1]] + size[own[-1]])
            at = at[place[at] > 0]  # the escape has no id
            known = ((lane_of[at] - g) << 16) + model.ids[at]
            local[known] = place[at]
            s = slice(g, g + len(own))
            near = ids[a - 2 : b, s].astype(np.uint32)
            cum[:, s], width[:, s], raw[:, s], events = _intervals(model, own, local, near[2:], near[1:-1], near[:-2])
            if b < n:  # nothing is weighed after the last segment
                model.note(events, own)
            local[known] = 0
        for t in range(b - a):
            if t % 64 == 0:
                out.reserve(64 * 2 + 2)  # an id gives two words at most
            out.put(cum[t], width[t], MIXED)
            who = raw[t].nonzero()[0]
            if len(who):
                out.put(ids[a + t, who].astype(np.uint64), ONE, RAW, who)
    return out.finish()


def _decode(words: list[np.ndarray], n: int) -> np.ndarray:
    """(n, L) ids."""
    lanes = len(words)
    code, model = Reader(words), Model(lanes)
    ids = np.zeros((n, lanes), np.uint16)
    slot_base, lane_4, base_2, base_1 = (model.lanes * k for k in (FREQ, 4, SIZE_2, SIZE_1))
    for a, b in segments(n):
        if a == 0:
            for t in range(b):
                v = code.value(RAW)
                code.take(v, ONE)
                ids[t] = v
            continue
        model.learn(ids[:a])
        slots, start_2, start_3, factor = model.slots(), model.start[1::3].copy(), model.start[2::3].copy(), model.width[2::3].copy()
        events = np.zeros((b - a if b < n else 0, lanes), np.int32)
        before, last = ids[a - 2].astype(np.uint32), ids[a - 1].astype(np.uint32)
        for t in range(a, b):
            two, one, kind = model.predict(base_2, base_1, before, last)
            context = lane_4 + kind
            v = code.value(MIXED).astype(np.uint32)
            from_2, from_3, width = start_2.take(context), start_3.take(context), factor.take(context)
            other, second = v >= from_3, v >= from_2
            # lanes whose event is a hit look up some entry too, and leave it
            place = slots.take(slot_base + np.minimum((v - from_3) // width, np.uint32(FREQ - 1)))
            entry = model.packed.take(model.begin + place)
            start = np.where(other, from_3 + width * (entry >> U32).astype(np.uint32), from_2 * second)
            width *= ((entry >> U16) & LOW16).astype(np.uint32)
            code.take(start, np.where(other, width, np.where(second, from_3 - from_2, from_2)))
            now = np.where(other, entry.astype(np.uint16), np.where(second, one, two)).astype(np.uint32)
            who = (other & (place == 0)).nonzero()[0]
            if len(who):
                v = code.value(RAW, who)
                code.take(v, ONE, who)
                now[who] = v
            ids[t] = now
            if b < n:  # nothing is weighed after the last segment
                events[t - a] = context * 3 + second + other
            before, last = last, now
        if b < n:
            model.note(events, model.lanes)
    return ids


def turned(table: np.ndarray) -> np.ndarray:
    """A transposed copy, in strips: column by column, each number would take a cache line of its own."""
    out = np.empty(table.shape[::-1], table.dtype)
    for k in range(0, len(table), 32):
        out[:, k : k + 32] = table[k : k + 32].T
    return out


def checksum(size: int, length: int, payload: bytes) -> int:
    return zlib.crc32(payload, zlib.crc32(struct.pack("<III", size, length, len(payload) // 4)))


def encode_blocks(ids: np.ndarray, block: int = BLOCK) -> list[bytes]:
    """Blocks of the ids, in order; the last may be shorter, and is padded while it is coded."""
    ids = np.asarray(ids)
    if len(ids) and int(ids.max()) >= 1 << 16:
        raise ValueError("ids must be below 65,536")
    out: list[bytes] = []
    length = min(block, len(ids))
    for at in range(0, len(ids), block * LANES):
        part = ids[at : at + block * LANES].astype(np.uint16)
        lanes = -(-len(part) // length)
        laid = np.zeros(lanes * length, np.uint16)
        laid[: len(part)] = part
        sizes = np.diff(np.append(np.arange(0, len(part), length), len(part)))
        for size, words in zip(sizes, _encode(turned(laid.reshape(lanes, length)))):
            payload = words.astype("<u4").tobytes()
            out.append(HEAD.pack(MAGIC, int(size), length, len(words), checksum(int(size), length, payload)) + payload)
    return out


def decode_blocks(blocks: list[bytes]) -> np.ndarray:
    """Ids of the blocks, in order. Raises ValueError where a block isn't whole."""
    heads = []
    for b in blocks:
        magic, size, length, words, crc = HEAD.unpack_from(b)
        if magic != MAGIC or len(b) != HEAD.size + 4 * words or checksum(size, length, b[HEAD.size :]) != crc:
            raise ValueError("a block is damaged")
        heads.append((size, length))
    out: list[np.ndarray] = [np.zeros(0, np.uint16)] * len(blocks)
    for length in sorted({h[1] for h in heads}):
        own = [i for i, h in enumerate(heads) if h[1] == length]
        for k in range(0, len(own), LANES):
            part = own[k : k + LANES]
            ids = turned(_decode([np.frombuffer(blocks[i], "<u4", offset=HEAD.size) for i in part], length))
            for lane, i in enumerate(part):
                out[i] = ids[lane, : heads[i][0]]
    return np.concatenate(out) if out else np.zeros(0, np.uint16)
