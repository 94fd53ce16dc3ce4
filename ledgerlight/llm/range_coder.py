"""Adaptive context-mixing coder for blocks of token ids.

Each block starts from an empty model, so blocks are read in any order, alone, and after another one was damaged. The
model learns from the ids coded so far. For the next id

* order 2 predicts the id that followed the last two ids, order 1 the one that followed the last id; each slot has a
  confidence, and how often a prediction of that confidence was right so far is its share of the probability;
* order 0 has the rest: ids in proportion to their counts, which fade, and a share for ids without a count, which follows
  how often they came up and stands before the id as it is.

A block is cut into up to ``STREAMS`` runs of equal length, which share its model and advance together, one id of each at
every step; the model learns from all of them after every ``LEARN`` steps, and more often in the beginning. The shares
are laid side by side on a scale of 2^28, and each run has a 64-bit state that takes them in and hands out 32 bits at a
time (rANS): the coder takes the steps in reverse order, once the model has gone through them, the decoder in order.

Runs of many blocks advance together, so numpy works on arrays as wide as there are runs. A coded block holds for each run
the number of its words, then the number of its plain ids; then the words of all runs, the last state first; then the
plain ids, 16 bits each; then a CRC-32 of the ids, which the decoder checks.
"""

from __future__ import annotations

import zlib

import numpy as np

SCALE_BITS = 28
U, V = np.uint32, np.uint64
SCALE = U(1 << SCALE_BITS)
SLOT_BITS, ID_BITS = 14, 16
TOP = 7
PROBABLE = 58_000  # of 65,536: the most that a prediction or the plain ids may claim
#: Most runs of a block, ids in a run while there are fewer, steps between two lessons.
STREAMS, RUN, LEARN = 128, 2048, 32
#: What an id adds to its count, and the sum of counts at which they are halved; its table is made anew less often.
WEIGHT, FULL = 4, 1 << 15
#: Most blocks, and runs of them, that advance together.
BLOCKS, LANES = 64, 4096


def lessons(n: int) -> dict[int, bool]:
    """Steps at which the model learns, and whether order 0 makes its table anew there."""
    at = {2: True, 4: False, 8: True, 16: False} | {t: t in (32, 128) or t % 512 == 0 for t in range(LEARN, n, LEARN)}
    return {t: table for t, table in at.items() if t < n}


#: Confidence after a miss (first row) and a hit, by the confidence before.
AFTER = np.array([[max(c >> 1, 1) for c in range(TOP + 1)], [min(c + 1, TOP) for c in range(TOP + 1)]], U).ravel() << U(16)
START = np.linspace(0, 40_000, TOP + 1).astype(np.int64)


def _runs(n: int) -> int:
    return max(1, min(STREAMS, -(-n // RUN)))


class Runs:
    """How blocks of these sizes are cut: for each run its block, where it begins there and its length, longest first."""

    def __init__(self, sizes: list[int]):
        cut = [_runs(n) for n in sizes]
        length = [-(-n // c) for n, c in zip(sizes, cut, strict=True)]
        found = [(i, j * m, max(0, min(m, sizes[i] - j * m))) for i, (c, m) in enumerate(zip(cut, length, strict=True)) for j in range(c)]
        found = sorted(found, key=lambda r: -r[2])
        self.block, self.begin, self.n = (np.array(x, np.int64) for x in zip(*found, strict=True))
        self.count = len(found)
        self.steps = int(self.n[0])
        self.active = np.searchsorted(-self.n, -np.arange(self.steps), side="left").tolist()
        self.by_block: list[list[int]] = [[] for _ in sizes]
        for r, i in enumerate(self.block.tolist()):
            self.by_block[i].append(r)


class Model:
    """State of all blocks. A slot holds a predicted id and, above its 16 bits, the confidence; 0 is an empty slot."""

    def __init__(self, runs: Runs, sizes: list[int]):
        self.runs, self.of, blocks = runs, runs.block, len(sizes)
        slots = np.array([1 << min(SLOT_BITS, max(4, n.bit_length())) for n in sizes], np.int64)
        ends = np.cumsum(slots)
        self.slots = [np.zeros(int(ends[-1]), U) for _ in range(2)]
        self.base, self.mask = (ends - slots)[self.of], (slots - 1)[self.of].astype(U)
        self.tries = [np.zeros((blocks, 2, TOP + 1), np.int64) for _ in range(2)]  # wrong and right, by confidence
        self.right = [np.tile(START, blocks).astype(U) for _ in range(2)]
        self.sure_base = self.of * (TOP + 1)
        self.others = np.zeros((blocks, 2), np.int64)  # ids that weren't predicted, plain ones
        self.other = np.full(len(self.of), 40_000, U)
        self.tally = np.zeros((blocks, 1 << ID_BITS), U)

    def slot(self, k: int, last: np.ndarray, before: np.ndarray) -> np.ndarray:
        a = last.shape[-1]
        key = last * U(0x9E3779B1)
        if not k:
            key = (key ^ before) * U(0x85EBCA6B)
        return ((key >> U(15)) & self.mask[:a]) + self.base[:a]

    def predict(self, last: np.ndarray, before: np.ndarray, total: np.ndarray | None):
        """Predictions, where the shares of order 2, order 1 and plain ids end, and what each of ``total`` counts is worth."""
        a = last.shape[-1]
        held2, held1 = (self.slots[k].take(self.slot(k, last, before)) for k in (0, 1))
        end2, odds = (self.right[k].take(self.sure_base[:a] + (held >> U(16))) for k, held in ((0, held2), (1, held1)))
        held2, held1 = held2 & U(0xFFFF), held1 & U(0xFFFF)
        end2 = end2 << U(SCALE_BITS - 16)
        rest = SCALE - end2
        one = ((rest >> U(SCALE_BITS - 16)) * odds >> U(32 - SCALE_BITS)) * (held2 != held1)
        end1 = end2 + one
        rest -= one
        if total is None:
            return held2, held1, end2, end1, end1 + rest, None
        plain = np.maximum((rest >> U(SCALE_BITS - 16)) * self.other[:a] >> U(32 - SCALE_BITS), U(1))
        return held2, held1, end2, end1, end1 + plain, (rest - plain) // total[:a]

    def learn(self, x: np.ndarray, last: np.ndarray, before: np.ndarray, plain: np.ndarray) -> None:
        """From steps of the first runs; ``plain``: the id was coded as it is."""
        a, blocks = x.shape[-1], len(self.tries[0])
        missed = None
        for k in (0, 1):
            at = self.slot(k, last, before)
            held = self.slots[k].take(at)
            sure, guess = held >> U(16), held & U(0xFFFF)
            same = (guess == x) & (sure > 0)
            step = sure + same * U(TOP + 1)
            self.slots[k][at] = np.where(step > 1, guess, x) | AFTER.take(step)
            cell = self.of[:a] * (2 * TOP + 2) + step
            self.tries[k] += np.bincount(cell.ravel() if k == 0 else cell[missed], minlength=blocks * (2 * TOP + 2)).reshape(blocks, 2, TOP + 1)
            wrong, right = self.tries[k][:, 0], self.tries[k][:, 1]
            odds = np.minimum(((right << 16) + START * 4) // (wrong + right + 4), PROBABLE)
            odds[:, 0] = 0
            self.right[k] = odds.ravel().astype(U)
            missed = ~same if k == 0 else missed & ~same
        of = self.of[:a]
        seen = [np.bincount(of, f.sum(0), minlength=blocks).astype(np.int64) for f in (missed, plain)]
        self.others = (self.others >> 1) + np.stack(seen, 1)
        share = np.clip((self.others[:, 1] << 16) // np.maximum(self.others[:, 0], 1), 64, PROBABLE)
        self.other = share[self.of].astype(U)

    def count(self, ids: np.ndarray) -> np.ndarray:
        """Adds to the counts the ids of the first runs; the sums of the counts, one of each block."""
        for i, own in enumerate(self.runs.by_block):
            own = [r for r in own if r < ids.shape[-1]]
            if own:
                side_by_side = own[-1] - own[0] == len(own) - 1
                some = ids[:, own[0] : own[-1] + 1] if side_by_side else ids[:, own]
                self.tally[i] += np.bincount(some.ravel(), minlength=1 << ID_BITS).astype(U) * U(WEIGHT)
        while len(full := np.flatnonzero((sums := self.tally.sum(1)) > FULL)):
            self.tally[full] >>= U(1)
        return np.maximum(sums, 1).astype(U)


def _groups(sizes: list[int]):
    """Blocks that advance together, in order."""
    i = 0
    while i < len(sizes):
        j, lanes = i, 0
        while j < len(sizes) and j - i < BLOCKS and (j == i or lanes < LANES):
            lanes += _runs(sizes[j])
            j += 1
        yield i, j
        i = j


def encode(blocks: list[np.ndarray]) -> list[bytes]:
    out: list[bytes] = []
    for i, j in _groups([len(b) for b in blocks]):
        out += _encode(blocks[i:j])
    return out


def _encode(blocks: list[np.ndarray]) -> list[bytes]:
    sizes = [len(b) for b in blocks]
    runs = Runs(sizes)
    n, lanes = runs.steps, runs.count
    rows = np.zeros((lanes, n), np.uint16)
    for r, (i, begin, m) in enumerate(zip(runs.block.tolist(), runs.begin.tolist(), runs.n.tolist(), strict=True)):
        rows[r, :m] = blocks[i][begin : begin + m]
    ids = np.zeros((n + 2, lanes), U)  # two steps before the first
    ids[2:] = rows.T
    model, due = Model(runs, sizes), lessons(n)
    begins, widths, plains = np.empty((n, lanes), U), np.empty((n, lanes), U), np.zeros((n, lanes), bool)
    total, table, counted, cuts = None, None, 0, [0, *due, n]
    for t, end_t in zip(cuts, cuts[1:], strict=False):
        if due.get(t):
            sums = model.count(_known(ids, counted, t, runs))
            total, counted = sums[runs.block], t
            table = ((np.cumsum(model.tally, 1, dtype=U) - model.tally << U(16)) + model.tally).ravel()
        for u, end_u, a in _pieces(t, end_t, runs.active):
            x, last, before = ids[u + 2 : end_u + 2, :a], ids[u + 1 : end_u + 1, :a], ids[u:end_u, :a]
            held2, held1, end2, end1, end, width = model.predict(last, before, total)
            hit2 = (x == held2) & (end2 > 0)
            hit1 = (x == held1) & (end1 > end2) & ~hit2
            if total is None:
                plain, begin, size = ~(hit2 | hit1), end1.copy(), end - end1
            else:
                cell = table.take((runs.block[:a] << ID_BITS) + x)
                count = cell & U(0xFFFF)
                plain = count == 0
                begin = np.where(plain, end1, end + (cell >> U(16)) * width)
                size = np.where(plain, end - end1, count * width)
                plain &= ~(hit2 | hit1)
            h = np.nonzero(hit1)
            begin[h], size[h] = end2[h], end1[h] - end2[h]
            h = np.nonzero(hit2)
            begin[h], size[h] = 0, end2[h]
            begins[u:end_u, :a], widths[u:end_u, :a], plains[u:end_u, :a] = begin, size, plain
        if end_t < n:
            a = runs.active[end_t - 1]
            model.learn(*(f[:, :a] for f in (ids[t + 2 : end_t + 2], ids[t + 1 : end_t + 1], ids[t:end_t], plains[t:end_t])))
    state, words = np.full(lanes, 1 << 32, V), np.zeros(lanes * (n + 1), U)
    first = np.arange(lanes, dtype=np.int64) * (n + 1)
    at = first.copy()
    for t in range(n - 1, -1, -1):
        a = runs.active[t]
        now, size = state[:a], widths[t, :a].astype(V)
        out = now >> V(64 - SCALE_BITS) >= size
        words[at[:a]] = now.astype(U)
        at[:a] += out
        now = np.where(out, now >> V(32), now)
        whole = now // size
        state[:a] = (whole << V(SCALE_BITS)) + (now - whole * size) + begins[t, :a]
    plains = np.ascontiguousarray(plains.T)
    coded = []
    for i, own in enumerate(runs.by_block):
        bodies = [np.concatenate([np.array([state[r] >> V(32), state[r] & V(0xFFFFFFFF)], U), words[first[r] : at[r]][::-1]]) for r in own]
        plain = [rows[r][plains[r]] for r in own]
        head = np.array([len(b) for b in bodies] + [len(p) for p in plain], "<u4")
        check = zlib.crc32(np.asarray(blocks[i]).astype("<u4").tobytes()).to_bytes(4, "little")
        coded.append(head.tobytes() + np.concatenate(bodies).astype("<u4").tobytes() + np.concatenate(plain).astype("<u2").tobytes() + check)
    return coded


def _known(ids: np.ndarray, begin: int, end: int, runs: Runs) -> np.ndarray:
    return ids[begin + 2 : end + 2, : runs.active[end - 1]]


def _pieces(begin: int, end: int, active: list[int]):
    """Steps with the same runs."""
    while begin < end:
        stop = begin + 1
        while stop < end and active[stop] == active[begin]:
            stop += 1
        yield begin, stop, active[begin]
        begin = stop


def decode(coded: list[bytes], sizes: list[int]) -> list[np.ndarray]:
    """The ids of each block; ``ValueError`` if a checksum is wrong."""
    out: list[np.ndarray] = []
    for i, j in _groups(sizes):
        out += _decode(coded[i:j], sizes[i:j])
    return out


def _decode(coded: list[bytes], sizes: list[int]) -> list[np.ndarray]:
    runs = Runs(sizes)
    n, lanes = runs.steps, runs.count
    # Damaged blocks may read beyond their end, by no more than a word and a plain id a step.
    words, plain_ids = [np.zeros(0, U)], [np.zeros(0, np.uint16)]
    at, plain_at = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
    word, place = 0, 0
    for body, own in zip(coded, runs.by_block, strict=True):
        k = len(own)
        head = np.frombuffer(body[: 8 * k], "<u4").astype(np.int64)
        n_words, n_plain = head[:k], head[k:]
        at[own] = word + np.cumsum(n_words) - n_words
        plain_at[own] = place + np.cumsum(n_plain) - n_plain
        middle = 8 * k + 4 * int(n_words.sum())
        if middle + 2 * int(n_plain.sum()) + 4 != len(body):
            raise ValueError("a block has not the length that it says")
        words.append(np.frombuffer(body[8 * k : middle], "<u4"))
        plain_ids.append(np.frombuffer(body[middle:-4], "<u2"))
        word, place = word + len(words[-1]), place + len(plain_ids[-1])
    words = np.concatenate([*words, np.zeros(n + 2, U)])
    plain_ids = np.concatenate([*plain_ids, np.zeros(n + 2, np.uint16)])
    model, due = Model(runs, sizes), lessons(n)
    ids, plains = np.zeros((n + 2, lanes), U), np.zeros((n, lanes), bool)
    state = (words[at].astype(V) << V(32)) | words[at + 1]
    at += 2
    total, counted, cuts = None, 0, [0, *due, n]
    for t, end_t in zip(cuts, cuts[1:], strict=False):
        if due.get(t):
            sums = model.count(_known(ids, counted, t, runs))
            total, counted = sums[runs.block], t
            below = (np.cumsum(model.tally, 1, dtype=U) - model.tally << U(16)) + model.tally
            found = np.flatnonzero(below & U(0xFFFF))
            below = below.ravel()[found]
            held = model.tally.sum(1, dtype=np.int64)
            table = np.append(np.repeat((found & 0xFFFF) << 32 | below, below & U(0xFFFF)), 0)
            row = (np.cumsum(held) - held)[runs.block]
        for u in range(t, end_t):
            a = runs.active[u]
            held2, held1, end2, end1, end, width = model.predict(ids[u + 1, :a], ids[u, :a], total)
            now = state[:a]
            value = (now & V(SCALE - 1)).astype(U)
            hit2, hit, plain = value < end2, value < end1, value < end
            plain &= ~hit
            if total is None:
                x, begin, size = plain_ids.take(plain_at[:a]).astype(U), end1.copy(), end - end1
            else:
                cell = table.take(row[:a] + np.minimum((value - end) // width, total[:a] - U(1)))
                x, span = (cell >> 32).astype(U), cell.astype(U)
                begin, size = end + (span >> U(16)) * width, (span & U(0xFFFF)) * width
                h = np.flatnonzero(plain)
                x[h], begin[h], size[h] = plain_ids[plain_at[h]], end1[h], end[h] - end1[h]
            plain_at[:a] += plain
            h = np.flatnonzero(hit & ~hit2)
            x[h], begin[h], size[h] = held1[h], end2[h], end1[h] - end2[h]
            h = np.flatnonzero(hit2)
            x[h], begin[h], size[h] = held2[h], 0, end2[h]
            ids[u + 2, :a], plains[u, :a] = x, plain
            now = size * (now >> V(SCALE_BITS)) + (value - begin)
            short = now < V(1 << 32)
            state[:a] = np.where(short, (now << V(32)) | words.take(at[:a]), now)
            at[:a] += short
        if end_t < n:
            a = runs.active[end_t - 1]
            model.learn(*(f[:, :a] for f in (ids[t + 2 : end_t + 2], ids[t + 1 : end_t + 1], ids[t:end_t], plains[t:end_t])))
    rows = np.ascontiguousarray(ids[2:].T.astype(np.uint16))
    out = []
    for own, body in zip(runs.by_block, coded, strict=True):
        got = np.concatenate([rows[r, : runs.n[r]] for r in own])
        if zlib.crc32(got.astype("<u4").tobytes()) != int.from_bytes(body[-4:], "little"):
            raise ValueError("a block's checksum is wrong")
        out.append(got)
    return out
