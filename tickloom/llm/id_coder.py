"""Blocks of token ids, packed by an adaptive context-mixing range coder.

Three predictors look at an id: order 2 and order 1 each remember the id that
last followed their context, with a confidence; order 0 counts ids. The two
confidences select a gate, whose counts of who was right give the mixed
probability of "order 2's id", "order 1's id" and "any id, by its count". One
interval per id goes to a carry-less range coder with 64-bit state.

A block is cut into lanes of consecutive ids that are coded in lock step: step t
codes the t-th id of every lane with numpy, then all predictors learn from the
whole step. The decoder repeats the same steps. Nothing is shared between
blocks; each starts from the same state and carries a checksum of its ids.
"""

import struct
import zlib

import numpy as np

LANES, STEPS = 8192, 256
BLOCK_IDS = LANES * STEPS
TOTAL_BITS, COUNT_BITS, TABLE_BITS = 28, 20, 18
TOTAL, COUNTS = 1 << TOTAL_BITS, 1 << COUNT_BITS
MOST_IDS = COUNTS >> 1
REFRESH = 16
LEVELS = 16
MAGIC = b"TLB1"
HEAD = "<4sIIIII"  # magic, ids, steps, vocabulary, bytes, checksum of the ids
U64 = np.uint64
LOW32 = U64(0xFFFFFFFF)


class Model:
    """The predictors' state within a block. An entry of orders 1 and 2 is an id above four bits of confidence."""

    def __init__(self, vocabulary: int):
        self.order2 = np.zeros(1 << TABLE_BITS, np.int32)
        self.order1 = np.zeros(vocabulary, np.int32)
        self.right = np.ones(LEVELS * LEVELS * 3, np.int64)  # per gate: order 0, 1, 2
        self.right[0::3] = 4
        self.seen = np.zeros(vocabulary, np.int64)
        # the new confidence less the old one, for misses and for hits
        miss = (np.arange(LEVELS) >> 1) - np.arange(LEVELS)
        hit = np.minimum(np.arange(LEVELS) + 1, LEVELS - 1) - np.arange(LEVELS)
        self.change = np.concatenate([miss, hit]).astype(np.int32)
        self.learn_counts()
        self.learn_gates()

    def learn_counts(self):
        """Order 0's cumulative counts, scaled to a fixed total with at least 1 for every id."""
        running = np.zeros(len(self.seen) + 1, np.int64)
        np.cumsum(self.seen, out=running[1:])
        if not running[-1]:
            running = np.arange(len(running))
        room = (COUNTS - len(self.seen)) / float(running[-1])
        self.running = (running * room).astype(np.uint64) + np.arange(len(running), dtype=np.uint64)
        self.running[-1] = COUNTS

    def id_table(self) -> np.ndarray:
        """The id of each place below ``COUNTS``, for decoding."""
        return np.repeat(np.arange(len(self.seen), dtype=np.int32), np.diff(self.running.astype(np.int64)))

    def learn_gates(self):
        n0, n1, n2 = self.right[0::3], self.right[1::3], self.right[2::3]
        share = (TOTAL - (1 << (TOTAL_BITS - 5))) // (n0 + n1 + n2)
        self.weight2, self.base = (n2 * share).astype(np.uint64), ((n2 + n1) * share).astype(np.uint64)

    def contexts(self, last, before):
        """(place in order 2, its entry, order 1's entry, gate, weight of order 2, of both)."""
        at2 = ((last * 0x9E3779B1 + before * 0x85EBCA77) & 0xFFFFFFFF) >> (32 - TABLE_BITS)
        two, one = self.order2.take(at2), self.order1.take(last)
        gate = ((two & 15) << 4) | (one & 15)
        return at2, two, one, gate, self.weight2.take(gate), self.base.take(gate)

    def learn(self, last, ids, at2, two, one, gate, hit2, hit1):
        self.right += np.bincount(gate * 3 + np.where(hit2, 2, hit1), minlength=len(self.right))
        self.learn_gates()
        fresh = ((ids << 4) | 1).astype(np.int32)
        for table, at, entry, hit in ((self.order2, at2, two, hit2), (self.order1, last, one, hit1)):
            conf = entry & 15
            kept = entry + self.change.take(conf + (hit << 4))
            table[at] = np.where(hit | (conf > 1), kept, fresh)


def lanes_of(count: int) -> tuple[int, int]:
    """(steps, lanes) for a block: short blocks use fewer lanes."""
    steps = min(max(64, -(-count // LANES)), count)
    return steps, -(-count // steps)


def encode(ids: np.ndarray) -> bytes:
    """A block of at least one id below ``MOST_IDS``, at most ``BLOCK_IDS`` of them."""
    ids = np.ascontiguousarray(ids, np.int64)
    count, vocabulary = len(ids), int(ids.max()) + 1
    if vocabulary > MOST_IDS:
        raise ValueError(f"id {vocabulary - 1} is not below {MOST_IDS}")
    steps, lanes = lanes_of(count)
    grid = np.zeros(steps * lanes, np.int64)
    grid[:count] = ids
    grid = np.ascontiguousarray(grid.reshape(lanes, steps).T)
    full = count - (lanes - 1) * steps  # ids of the last lane
    model = Model(vocabulary)
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, 0xFFFFFFFFFFFFFFFF, np.uint64)
    last = before = np.zeros(lanes, np.int64)
    out, lengths = np.zeros((lanes, steps + 2), np.uint32), np.zeros(lanes, np.int64)
    for t in range(steps):
        active = lanes if t < full else lanes - 1
        now, last, before, lo, sp = grid[t, :active], last[:active], before[:active], low[:active], span[:active]
        at2, two, one, gate, w2, base = model.contexts(last, before)
        hit2, hit1 = now == two >> 4, now == one >> 4
        start, stop = np.where(hit2, U64(0), w2), np.where(hit2, w2, base)
        other = np.flatnonzero(~(hit2 | hit1))
        if len(other):
            base_, ids_ = base[other], now[other]
            rest = U64(TOTAL) - base_
            start[other] = base_ + ((rest * model.running.take(ids_)) >> U64(COUNT_BITS))
            stop[other] = base_ + ((rest * model.running.take(ids_ + 1)) >> U64(COUNT_BITS))
        width = stop - start
        unit = sp >> U64(TOTAL_BITS)
        lo += unit * start
        np.multiply(unit, width, out=sp)
        short = np.flatnonzero(sp <= LOW32)
        if len(short):
            lo_, sp_ = lo[short], sp[short]
            sp_ = np.where((lo_ ^ (lo_ + sp_)) >> U64(32) != 0, (~lo_ + U64(1)) & LOW32, sp_)
            out[short, lengths[short]] = (lo_ >> U64(32)).astype(np.uint32)
            lengths[short] += 1
            lo[short], sp[short] = lo_ << U64(32), sp_ << U64(32)
        model.learn(last, now, at2, two, one, gate, hit2, hit1)
        if (t + 1) % REFRESH == 0:
            model.seen += np.bincount(grid[t + 1 - REFRESH:t + 1, :active].ravel(), minlength=vocabulary)
            model.learn_counts()
        last, before = now, last
    rows = np.arange(lanes)
    out[rows, lengths] = ((low + LOW32) >> U64(32)).astype(np.uint32)
    lengths += 1
    used = np.arange(steps + 2) < lengths[:, None]
    body = lengths.astype("<u2").tobytes() + out[used].astype("<u4").tobytes()
    return struct.pack(HEAD, MAGIC, count, steps, vocabulary, len(body), zlib.crc32(ids.astype("<u4").tobytes())) + body


def decode(block) -> np.ndarray:
    """The ids of a block; raises ValueError where it is damaged."""
    if len(block) < struct.calcsize(HEAD):
        raise ValueError("a block is cut off")
    magic, count, steps, vocabulary, size, checksum = struct.unpack_from(HEAD, block)
    body = block[struct.calcsize(HEAD):struct.calcsize(HEAD) + size]
    if magic != MAGIC or len(body) != size or not 0 < steps <= count <= BLOCK_IDS:
        raise ValueError("not a block of ids")
    lanes = -(-count // steps)
    lengths = np.frombuffer(body, "<u2", lanes).astype(np.int64)
    stream = np.frombuffer(body, "<u4", offset=2 * lanes).astype(np.uint64)
    if lengths.sum() != len(stream):
        raise ValueError("a block's lanes do not add up")
    words = np.zeros((lanes, int(lengths.max()) + 2), np.uint64)
    words[np.arange(words.shape[1]) < lengths[:, None]] = stream
    full = count - (lanes - 1) * steps
    model = Model(vocabulary)
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, 0xFFFFFFFFFFFFFFFF, np.uint64)
    code, read = (words[:, 0] << U64(32)) | words[:, 1], np.full(lanes, 2, np.int64)
    last = before = np.zeros(lanes, np.int64)
    grid = np.zeros((steps, lanes), np.int64)
    end, owner = words.shape[1] - 1, model.id_table()
    for t in range(steps):
        active = lanes if t < full else lanes - 1
        last, before, lo, sp, co = last[:active], before[:active], low[:active], span[:active], code[:active]
        at2, two, one, gate, w2, base = model.contexts(last, before)
        unit = sp >> U64(TOTAL_BITS)
        slot = np.minimum((co - lo) // unit, U64(TOTAL - 1))
        is2 = slot < w2
        now = (np.where(is2, two, one) >> 4).astype(np.int64)
        start, stop = np.where(is2, U64(0), w2), np.where(is2, w2, base)
        other = np.flatnonzero(slot >= base)
        if len(other):
            base_ = base[other]
            rest = U64(TOTAL) - base_
            most = (((slot[other] - base_ + U64(1)) << U64(COUNT_BITS)) - U64(1)) // rest
            ids = owner.take(most.astype(np.int64))
            now[other] = ids
            start[other] = base_ + ((rest * model.running.take(ids)) >> U64(COUNT_BITS))
            stop[other] = base_ + ((rest * model.running.take(ids + 1)) >> U64(COUNT_BITS))
        width = stop - start
        lo += unit * start
        np.multiply(unit, width, out=sp)
        short = np.flatnonzero(sp <= LOW32)
        if len(short):
            lo_, sp_ = lo[short], sp[short]
            sp_ = np.where((lo_ ^ (lo_ + sp_)) >> U64(32) != 0, (~lo_ + U64(1)) & LOW32, sp_)
            lo[short], sp[short] = lo_ << U64(32), sp_ << U64(32)
            code[short] = (co[short] << U64(32)) | words[short, np.minimum(read[short], end)]
            read[short] += 1
        grid[t, :active] = now
        model.learn(last, now, at2, two, one, gate, now == two >> 4, now == one >> 4)
        if (t + 1) % REFRESH == 0:
            model.seen += np.bincount(grid[t + 1 - REFRESH:t + 1, :active].ravel(), minlength=vocabulary)
            model.learn_counts()
            owner = model.id_table()
        last, before = now, last
    ids = grid.T.ravel()[:count]
    if zlib.crc32(ids.astype("<u4").tobytes()) != checksum:
        raise ValueError("a block's checksum does not hold")
    return ids
