"""Adaptive context-mixing range coder for token ids.

Ids are cut into blocks that are coded independently: every model starts anew in each block, and each
block carries the crc32 of its ids. All blocks of a call are coded side by side, one token of each at
a time, so every step is a few array operations over the blocks.

Per token, the order-2 context (the two ids before) and the order-1 context (the id before) each
predict one id, with a confidence; the prediction of the surer one is taken, order 2 if both are alike.
"Is it the prediction?" is coded with a probability mixed from two adaptive estimates (by both
confidences and the agreement of the predictions; by recent hits) whose weight follows the better one;
otherwise the id's high and low byte are coded with adaptive order-0 frequencies. All arithmetic is on
integers, so a block decodes alike on every machine. Ids are below 2**16.

The range is at least 2**48 before a token and is filled up once after it: a token's symbols take at most
42 bits of it. A carry is added to the words already written.

Block layout: b"QTB2", little-endian uint32 number of ids, uint32 crc32 of the ids as little-endian
uint32, then the code as little-endian 16-bit words, after which a reader takes zeros.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

from quire.llm.shipping import ship

MAGIC = b"QTB2"
BLOCK_IDS = 2048
U = np.uint64
LEAST, TOP, WORD, SCALE = U(1 << 48), U(48), U(16), U(16)
SLOTS = 2048
ONE = 1 << 16
LOW_P, HIGH_P = 64, ONE - 64  # bounds of the chance of a hit
RATE = 5
GAIN = 12
REFRESH = 96  # tokens between two looks at the frequencies
MOST = 60_000  # sum of a block's frequencies, halved beyond it
BY_CONF, BY_HITS = 128, 32  # contexts a block of the two estimates
#: frequencies of the high and the low byte at first: frequent words have the lowest ids
FIRST_HIGH, FIRST_LOW = np.maximum(1, 200 // np.arange(1, 257)), np.ones(256)
BYTE_ENDS = np.arange(1, 257, dtype=np.uint32)[:, None]
FOUR = U(0x0001000100010001)


class Encoder:
    """The registers of all blocks and the words written."""

    def __init__(self, n: int, cap: int):
        self.reg, self.rng, self.cap = np.zeros(n, U), np.full(n, ~U(0)), cap
        self.words = np.zeros(n * cap, np.uint32)
        self.next = np.arange(n) * cap  # where the next word goes

    def carry(self, before: np.ndarray):
        """Add the carries of a token to the last words: a token adds less than its range, so there is one a block at most."""
        over = self.reg[:len(before)] < before
        if over.any():
            self.words[self.next[:len(before)][over] - 1] += np.uint32(1)

    def fill(self, k: int):
        reg, rng, at = self.reg[:k], self.rng[:k], self.next[:k]
        short = rng < LEAST
        self.words[at] = reg >> TOP  # overwritten later where it is not due yet
        at += short
        short = short * WORD
        reg <<= short
        rng <<= short
        i = np.flatnonzero(rng < LEAST)
        while len(i):
            low, r = reg[i], rng[i] << WORD
            self.words[at[i]] = low >> TOP
            at[i] += 1
            reg[i], rng[i] = low << WORD, r
            i = i[r < LEAST]

    def finish(self) -> list[bytes]:
        """The words of every block: one more that settles the code, and carries passed on."""
        before = self.reg.copy()
        self.reg += LEAST - U(1)
        self.carry(before)
        self.words[self.next] = self.reg >> TOP
        over = np.flatnonzero(self.words >> np.uint32(16))
        while len(over):
            self.words[over] &= np.uint32(ONE - 1)
            self.words[over - 1] += np.uint32(1)
            over = over[self.words[over - 1] >> np.uint32(16) > 0] - 1
        return [self.words[j * self.cap:a + 1].astype("<u2").tobytes() for j, a in enumerate(self.next.tolist())]


class Decoder:
    """The registers of all blocks: what is read of the code, less the low end of the range."""

    def __init__(self, words: np.ndarray):
        n, cap = words.shape
        self.words, self.next = words.ravel(), np.arange(n) * cap + 4
        self.last = self.next + cap - 9  # where sound code ends at most; a damaged one reads zeros from there on
        w = words[:, :4].astype(U)
        self.reg = (w[:, 0] << U(48)) | (w[:, 1] << U(32)) | (w[:, 2] << U(16)) | w[:, 3]
        self.rng = np.full(n, ~U(0))

    def fill(self, k: int):
        reg, rng, at = self.reg[:k], self.rng[:k], self.next[:k]
        short = rng < LEAST
        word = self.words[at] * short
        at += short
        short = short * WORD
        reg <<= short
        reg |= word
        rng <<= short
        i = np.flatnonzero(rng < LEAST)
        while len(i):
            r = rng[i] << WORD
            reg[i] = (reg[i] << WORD) | self.words[at[i]]
            at[i] += 1
            rng[i] = r
            i = i[r < LEAST]
        np.minimum(at, self.last[:k], out=at)


class Bytes:
    """Adaptive frequencies of one byte of the ids, 256 a block: ``start`` holds where each byte's share of
    65536 begins (16 bits: the end of the last one wraps to 0), ``coarse`` every sixteenth."""

    def __init__(self, n: int, first: np.ndarray):
        self.n, self.freq = n, np.repeat(first.astype(np.uint32)[:, None], n, axis=1)
        self.ends = np.zeros((256, n), np.uint32)
        self.start = np.zeros(n * 256 + 1, np.uint16)
        self.rows, self.fine = self.start[:-1].reshape(-1, 256), self.start[:-1].reshape(-1, 16)
        self.coarse = np.zeros((n, 16), np.uint16)
        self.seen: list[np.ndarray] = []

    def refresh(self, k: int):
        freq, ends = self.freq[:, :k], self.ends[:, :k]
        if self.seen:
            counts = np.bincount(np.concatenate(self.seen), minlength=256 * self.n).reshape(256, self.n)[:, :k]
            np.multiply(counts, GAIN, out=ends, casting="unsafe")
            freq += ends
            self.seen = []
            full = np.flatnonzero(freq.sum(axis=0, dtype=np.uint32) > MOST)
            while len(full):
                freq[:, full] -= freq[:, full] >> np.uint32(1)
                full = full[freq[:, full].sum(axis=0) > MOST]
        ends[0] = freq[0]
        for b in range(1, 256):  # numpy's cumsum is many times slower along this axis
            np.add(ends[b - 1], freq[b], out=ends[b])
        ends *= np.uint32((ONE - 256) << 15) // ends[255]
        ends >>= np.uint32(15)
        ends += BYTE_ENDS
        self.rows[:k, 1:] = ends[:255].astype(np.uint16).T
        self.coarse[:k] = self.rows[:k, ::16]

    def share(self, at):
        a = self.start[at]
        return a.astype(U), (self.start[at + 1] - a).astype(U)

    def find(self, lane, v):
        """lane * 256 + the byte whose share holds ``v``: by sixteens, then one by one."""
        wide = np.empty((len(v), 4), U)
        wide.T[:] = v.astype(np.uint16) * FOUR
        v = wide.view(np.uint16)
        at = lane * 16 + count(self.coarse.take(lane, axis=0) <= v)
        return at * 16 + count(self.fine.take(at, axis=0) <= v)


def count(yes: np.ndarray) -> np.ndarray:
    """How many of each row of sixteen are true, less one."""
    n = np.bitwise_count(yes.view(U))
    return np.add(n[:, 0], n[:, 1], dtype=np.int64) - 1


def _run(lengths: np.ndarray, coder, ids: np.ndarray) -> None:
    """Code all blocks (sorted by length, longest first): ``ids`` (tokens, blocks) is read or filled."""
    decoding = isinstance(coder, Decoder)
    n = len(lengths)
    tables = [np.zeros(n * SLOTS, np.int32) for _ in (1, 2)]  # prediction * 8 + confidence
    by_conf = np.full(n * BY_CONF, ONE // 2, np.int32)
    by_hits = np.full(n * BY_HITS, ONE // 2, np.int32)
    by_conf[::BY_CONF] = by_conf[1::BY_CONF] = LOW_P  # no prediction
    by_hits.reshape(n, BY_HITS)[:, :8] = LOW_P
    weights, pasts = np.full(n, 128, np.int32), np.zeros(n, np.int32)
    high, low = Bytes(n, FIRST_HIGH), Bytes(n, FIRST_LOW)
    prev1, prev2 = np.zeros(n, np.int64), np.zeros(n, np.int64)
    k = -1
    still = np.searchsorted(-lengths, -np.arange(int(lengths[0]) if n else 0), "left").tolist()  # blocks longer than t
    for t, now in enumerate(still):
        if now != k:
            k = now
            lanes = np.arange(k)
            slot0, conf0, hits0 = lanes * SLOTS, lanes * BY_CONF, lanes * BY_HITS
            weight, past, prev1, prev2 = weights[:k], pasts[:k], prev1[:k], prev2[:k]
            reg, rng = coder.reg[:k], coder.rng[:k]
        if t % REFRESH == 0 or t & (t - 1) == 0:
            high.refresh(k)
            low.refresh(k)
        s1 = slot0 + ((prev1 * 40503 >> 4) & (SLOTS - 1))
        s2 = slot0 + ((prev2 * 30011 + prev1 * 48271 >> 3) & (SLOTS - 1))
        e1, e2 = tables[0][s1], tables[1][s2]
        c1, c2, p1, p2 = e1 & 7, e2 & 7, e1 >> 3, e2 >> 3
        two = (c2 >= c1) & (c2 > 0)
        guess = np.where(two, p2, p1)
        ia = conf0 + (c2 * 16 + c1 * 2 + (p1 == p2))
        ib = hits0 + (((c1 > 0) + two * np.int32(2)) * 8 + past)
        pa, pb = by_conf[ia], by_hits[ib]
        p = pb + ((pa - pb) * weight >> 8)
        bound = (rng >> SCALE) * p.astype(U)
        if decoding:
            hit = reg < bound
            miss = ~hit
            reg -= bound * miss
        else:
            x = ids[t, :k].astype(np.int32)
            before = reg.copy()
            hit = x == guess
            miss = ~hit
            reg += bound * miss
        rng[:] = np.where(hit, bound, rng - bound)
        goal = np.where(hit, HIGH_P, LOW_P).astype(np.int32)
        by_conf[ia] = pa + (goal - pa >> RATE)
        by_hits[ib] = pb + (goal - pb >> RATE)
        weight += (((pa > pb) == hit) * np.int32(256) - weight) >> 5
        past[:] = (past * 2 + hit) & 7
        i = np.flatnonzero(miss)
        if len(i):
            part, r, row = reg[i], rng[i], i * 256
            if not decoding:
                y = x[i]
            for model, shift in ((high, 8), (low, 0)):
                r >>= SCALE
                if decoding:
                    at = model.find(i, part // r)
                    value = at - row
                else:
                    value = (y >> shift) & 255
                    at = row + value
                a, f = model.share(at)
                a *= r
                part = part - a if decoding else part + a
                r *= f
                model.seen.append(value * n + i)
                if decoding:
                    guess[i] = value if shift else guess[i] * 256 + value
            reg[i], rng[i] = part, r
        if decoding:
            x = guess
            ids[t, :k] = x
        else:
            coder.carry(before)
        coder.fill(k)
        new = (x << 3) + np.int32(1)
        for table, s, e, c, q in ((tables[0], s1, e1, c1, p1), (tables[1], s2, e2, c2, p2)):
            table[s] = new + np.minimum(c * (q == x), 6)
        prev2 = prev1
        prev1 = x.astype(np.int64)


def encode(blocks: list[np.ndarray]) -> list[bytes]:
    """Each block of ids as bytes."""
    if not blocks:
        return []
    order = sorted(range(len(blocks)), key=lambda i: -len(blocks[i]))
    lengths = np.array([len(blocks[i]) for i in order])
    ids = np.zeros((len(blocks), max(1, int(lengths[0]))), np.uint16)
    for row, i in enumerate(order):
        ids[row, :lengths[row]] = blocks[i]
    coder = Encoder(len(blocks), cap=3 * int(lengths[0]) + 2)  # less than three words an id, and the last one
    ids = np.ascontiguousarray(ids.T)
    _run(lengths, coder, ids)
    coded = coder.finish()
    out: list[bytes] = [b""] * len(blocks)
    for row, i in enumerate(order):
        raw = np.asarray(blocks[i]).astype("<u4").tobytes()
        out[i] = MAGIC + struct.pack("<II", len(blocks[i]), zlib.crc32(raw)) + coded[row]
    return out


def decode(blocks: list[bytes]) -> list[np.ndarray]:
    """The ids of each block (uint16). A damaged block raises."""
    if not blocks:
        return []
    heads = []
    for b in blocks:
        if b[:4] != MAGIC:
            raise ValueError("not a token block")
        heads.append(struct.unpack("<II", b[4:12]))
    order = sorted(range(len(blocks)), key=lambda i: -heads[i][0])
    lengths = np.array([heads[i][0] for i in order])
    size = max((len(b) - 12) // 2 for b in blocks)
    words = np.zeros((len(blocks), size + 8), np.uint16)
    for row, i in enumerate(order):
        w = np.frombuffer(blocks[i], "<u2", offset=12)
        words[row, :len(w)] = w
    ids = np.zeros((max(1, int(lengths[0])), len(blocks)), np.uint16)
    _run(lengths, Decoder(words), ids)
    ids = np.ascontiguousarray(ids.T)
    out: list[np.ndarray] = [np.zeros(0, np.uint16)] * len(blocks)
    for row, i in enumerate(order):
        out[i] = ids[row, :lengths[row]]
        if zlib.crc32(out[i].astype("<u4").tobytes()) != heads[i][1]:
            raise ValueError("damaged token block")
    return out


ship(__name__)
