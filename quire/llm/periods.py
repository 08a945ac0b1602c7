"""Periodic runs of words by internal pattern matching.

A run is a stretch of consecutive words with smallest period ``q`` (words ``q`` apart are identical) that
is at least ``max(min_length, 2 * q)`` long and that no neighbouring word extends keeping the period.

Every document is searched whole, on its own. Its suffixes are sorted by prefix doubling, so at level ``k`` the
suffixes that begin with the same ``2**k`` words are one interval of the suffix array, and equal ranks of a
level mean equal factors. Then, level by level, the document is cut into dyadic blocks of ``2**k`` words. A
run of period ``q`` holds a whole block of level ``k(q)`` among its first words, and the block occurs again
``q`` words later. So each block that occurs twice at all asks for its occurrences in the neighbouring
windows, of at most ``2**k`` starts each: a wavelet tree over the suffix array's interval gives the first, the
second and the last of them (range successor) and their number. Occurrences in such a window form one
arithmetic progression, whose members are the candidate periods. A candidate is extended to both sides
by the ranks of all levels and kept where it is long enough; of equal stretches the smallest period stays.

Scale: no shuffle; a document is read by one task and needs about 4 bytes a word and level. Texts are taken in
pieces of ``PIECE_BYTES``, a longer document alone. Work is n log n of a document's words whatever it repeats.

Words are compared by 64-bit hashes; every run that is found is compared again by its bytes, and a document
with two different words of one hash is done again by exact word numbers.

Defined results: words are runs of anything but ASCII white space, unchanged; null and empty texts have no words
and no run; rows equal in doc_id and text are one document with one result row each; a null doc_id is an id like
any other; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quire.llm import textops as T
from quire.llm.frames import pick
from quire.llm.shipping import ship

MIN_LENGTH = 12
PIECE_BYTES = 2 << 20


def levels_of(min_length: int, longest: int) -> list[list[tuple[int, int]]]:
    """Per level the windows (smallest, largest distance) that its blocks ask. Distance q belongs to the highest
    level whose blocks fit, one of them wholly, into the words of a shortest run of period q before its last q."""
    out: list[list[tuple[int, int]]] = []
    q = 1
    while 2 * q <= longest:
        spare = max(min_length, 2 * q) - q
        k = (spare + 1).bit_length() - 2
        # distances up to `last` have the same level: spare falls to q at q = min_length / 2, then grows
        if 2 * q >= min_length:
            last = min((1 << (k + 2)) - 2, longest // 2)
        else:
            last = min(min_length - (1 << (k + 1)) + 1, (min_length - 1) // 2, longest // 2)
        while len(out) <= k:
            out.append([])
        while q <= last:
            end = min(q + (1 << k) - 1, last)
            out[k].append((q, end))
            q = end + 1
    return out


class Suffixes:
    """Suffix array by prefix doubling over the words of many documents, each with an alphabet of its own.

    Position ``first[d] + d + i`` is word ``i`` of document ``d``; one more position ends each document.
    ``ranks[k]`` names the factors of ``2**k`` words, by the interval's start; ``groups[k]`` are the intervals
    with more than one suffix: (positions, interval starts, interval ends).
    """

    def __init__(self, words: np.ndarray, first: np.ndarray):
        n, docs = len(words), len(first) - 1
        doc = np.repeat(np.arange(docs), np.diff(first))
        own = T.mix(words ^ T.mix(doc.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)))
        order = np.argsort(own, kind="stable")
        at = np.arange(n) + doc
        self.begin = first[:-1] + np.arange(docs)
        self.end = first[1:] + np.arange(docs)  # the closing position
        key = own[order]
        pos = at[order]
        slot = np.arange(n)
        rank = np.zeros(n + docs, np.int32)
        rank[self.end] = n + np.arange(docs)
        sa = np.empty(n + docs, np.int32)
        sa[n:] = self.end
        self.ranks: list[np.ndarray] = []
        self.groups: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        k = 0
        while True:
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            heads = np.flatnonzero(new)
            size = np.diff(np.append(heads, len(key)))
            rank = rank.copy()
            rank[pos] = np.repeat(slot[heads], size) if len(heads) else 0
            sa[slot] = pos
            self.ranks.append(rank)
            again = np.repeat(size, size) > 1
            pos, slot = pos[again], slot[again]
            heads, size = heads[size > 1], size[size > 1]
            start = rank[pos]
            self.groups.append((pos, start, start + np.repeat(size, size).astype(np.int32)))
            if not len(pos):
                break
            key = start.astype(np.int64) * (n + docs) + rank[pos + (1 << k)]
            order = np.argsort(key, kind="stable")
            key, pos = key[order], pos[order]
            k += 1
        self.sa = sa

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the suffixes at ``a`` and ``b``, different positions of one document."""
        off = np.zeros(len(a), np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            off += (self.ranks[k][a + off] == self.ranks[k][b + off]).astype(np.int64) << k
        return off

    def common_before(self, a: np.ndarray, b: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Length of the longest common end of what lies before ``a`` and before ``b`` > a, from ``begin`` on."""
        off = np.zeros(len(a), np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            i = a - off - (1 << k)
            inside = i >= begin
            i = np.where(inside, i, begin)
            off += (inside & (self.ranks[k][i] == self.ranks[k][i + (b - a)])).astype(np.int64) << k
        return off


class WaveletTree:
    """Wavelet tree over a sequence of non-negative numbers, its levels stored one after another with zeros in
    front. ``less`` and ``pick`` take arrays of queries; together they are the range successor."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(values.max()).bit_length()) if len(values) else 1
        self.zeros, self.n_zero = [], []
        v = values.astype(np.int32)
        for bit in range(self.bits - 1, -1, -1):
            one = (v >> bit) & 1 == 1
            z = np.zeros(len(v) + 1, np.int32)
            np.cumsum(~one, out=z[1:])
            self.zeros.append(z)
            self.n_zero.append(int(z[-1]))
            v = np.concatenate([v[~one], v[one]])

    def less(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How many of the numbers at lo..hi-1 are smaller than x."""
        count = np.zeros(len(lo), np.int64)
        over = x >= 1 << self.bits
        total = hi - lo
        for z, nz, bit in zip(self.zeros, self.n_zero, range(self.bits - 1, -1, -1)):
            one = (x >> bit) & 1 == 1
            l0, h0 = z[lo], z[hi]
            count += np.where(one, h0 - l0, 0)
            lo, hi = np.where(one, nz + lo - l0, l0), np.where(one, nz + hi - h0, h0)
        return np.where(over, total, count)

    def pick(self, lo: np.ndarray, hi: np.ndarray, c: np.ndarray) -> np.ndarray:
        """The number of rank c (from 0) among those at lo..hi-1."""
        value = np.zeros(len(lo), np.int64)
        for z, nz, bit in zip(self.zeros, self.n_zero, range(self.bits - 1, -1, -1)):
            l0, h0 = z[lo], z[hi]
            one = c >= h0 - l0
            value |= one.astype(np.int64) << bit
            c = np.where(one, c - (h0 - l0), c)
            lo, hi = np.where(one, nz + lo - l0, l0), np.where(one, nz + hi - h0, h0)
        return value


def candidates(s: Suffixes, min_length: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, distance) of every block that occurs again at a distance its level asks for."""
    longest = int((s.end - s.begin).max(initial=0))
    plan = levels_of(min_length, longest)
    used = [k for k in range(min(len(plan), len(s.groups))) if plan[k] and len(s.groups[k][0])]
    none = np.zeros(0, np.int64)
    if not used:
        return none, none
    # the tree holds the suffixes that are not alone at the lowest level asked; higher levels lie inside
    in_tree = np.zeros(len(s.sa) + 1, np.int64)
    pos, start, end = s.groups[used[0]]
    step = np.zeros(len(s.sa) + 1, np.int64)
    heads = np.unique(start)
    step[heads] += 1
    np.subtract.at(step, np.unique(end), 1)
    held = np.cumsum(step[:-1]) > 0
    np.cumsum(held, out=in_tree[1:])
    doc_of = np.searchsorted(s.begin, s.sa[held], "right") - 1
    tree = WaveletTree(s.sa[held] - s.begin[doc_of])
    ps, qs = [], []
    for k in used:
        pos, start, end = s.groups[k]
        doc = np.searchsorted(s.begin, pos, "right") - 1
        local = pos - s.begin[doc]
        block = np.flatnonzero(local & ((1 << k) - 1) == 0)
        if not len(block):
            continue
        doc, local = doc[block], local[block].astype(np.int64)
        lo, hi = in_tree[start[block]], in_tree[end[block]]
        for a, b in plan[k]:
            before = tree.less(lo, hi, local + a)
            n = tree.less(lo, hi, local + b + 1) - before
            hit = np.flatnonzero(n > 0)
            if not len(hit):
                continue
            l, h, c, m = lo[hit], hi[hit], before[hit], n[hit]
            one = tree.pick(l, h, c)
            more = np.flatnonzero(m > 1)
            gap = np.zeros(len(hit), np.int64)
            gap[more] = tree.pick(l[more], h[more], c[more] + 1) - one[more]
            j = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
            at = np.repeat(local[hit], m)
            ps.append(at + np.repeat(s.begin[doc[hit]], m))
            qs.append(np.repeat(one, m) + j * np.repeat(gap, m) - at)
    if not ps:
        return none, none
    p, q = np.concatenate(ps), np.concatenate(qs)
    # blocks side by side at one distance lie in one run: the first is enough
    order = np.lexsort((p, q))
    p, q = p[order], q[order]
    first = np.ones(len(p), bool)
    width = np.zeros(int(q.max()) + 1, np.int64)
    for k in used:
        for a, b in plan[k]:
            width[a:b + 1] = 1 << k
    first[1:] = (q[1:] != q[:-1]) | (p[1:] - p[:-1] != width[q[1:]])
    return p[first], q[first]


def find(words: np.ndarray, first: np.ndarray, min_length: int = MIN_LENGTH) -> np.ndarray:
    """Runs (document, start, length, period), ordered so, of documents that own words first[d]:first[d+1]."""
    if len(words) == 0:
        return np.zeros((0, 4), np.int64)
    s = Suffixes(words, first)
    p, q = candidates(s, min_length)
    doc = np.searchsorted(s.begin, p, "right") - 1
    inside = p + q < s.end[doc]  # always, but for two documents' words of one hash
    p, q, doc = p[inside], q[inside], doc[inside]
    begin = s.begin[doc]
    back = s.common_before(p, p + q, begin)
    length = back + s.common(p, p + q) + q
    start = p - back - begin
    ok = length >= np.maximum(min_length, 2 * q)
    rows = np.stack([doc, start, length, q], 1)[ok].astype(np.int64)
    rows = rows[np.lexsort(rows.T[::-1])]
    keep = np.ones(len(rows), bool)
    keep[1:] = (rows[1:, :3] != rows[:-1, :3]).any(1)  # of one stretch's periods the smallest
    rows = rows[keep]
    return rows[np.lexsort((rows[:, 2], rows[:, 3], rows[:, 1], rows[:, 0]))]  # by document, start, period


def _exact(buf, s, e, h, first, runs, min_length):
    """The runs, with documents whose word hashes collide done again by word numbers."""
    wrong = set()
    for d, start, length, q in runs.tolist():
        a = int(first[d]) + start
        w = [buf[x:y].tobytes() for x, y in zip(s[a:a + length].tolist(), e[a:a + length].tolist())]
        if w[q:] != w[:-q]:
            wrong.add(d)
    for d in sorted(wrong):
        a, b = int(first[d]), int(first[d + 1])
        names: dict[bytes, int] = {}
        ids = np.array([names.setdefault(buf[x:y].tobytes(), len(names)) for x, y in zip(s[a:b].tolist(), e[a:b].tolist())], np.uint64)
        again = find(ids, np.array([0, b - a]), min_length)
        again[:, 0] = d
        runs = np.concatenate([runs[runs[:, 0] < d], again, runs[runs[:, 0] > d]])
    return runs


def _collapsed(buf, s, e, first, runs):
    """(bytes, offsets): every document's words outside runs' repeated parts, joined by one space."""
    n = len(s)
    step = np.zeros(n + 1, np.int64)
    if len(runs):
        np.add.at(step, first[runs[:, 0]] + runs[:, 1] + runs[:, 3], 1)
        np.add.at(step, first[runs[:, 0]] + runs[:, 1] + runs[:, 2], -1)
    kept = np.flatnonzero(np.cumsum(step[:n]) == 0)
    per_doc = np.searchsorted(kept, first)
    end = e[kept].copy()
    last = per_doc[1:][np.diff(per_doc) > 0] - 1
    inner = np.ones(len(kept), bool)
    inner[last] = False
    buf = np.append(buf, np.uint8(0))
    buf[end[inner]] = 0x20  # the blank after a word that another one follows
    end[inner] += 1
    edge = np.zeros(len(buf) + 1, np.int8)
    edge[s[kept]] += 1
    edge[end] -= 1
    sizes = np.zeros(len(kept) + 1, np.int64)
    np.cumsum(end - s[kept], out=sizes[1:])
    return buf[np.cumsum(edge[:-1], dtype=np.int8) > 0], sizes[per_doc]


def _worker(min_length, want_runs, want_text):
    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            buf, off = T.flat(texts)
            for a, b in T.chunks(off, PIECE_BYTES):
                part, at = buf[off[a]:off[b]], off[a:b + 1] - off[a]
                s, e, h, first = T.words(part, at, T.NOT_SPACE)
                runs = _exact(part, s, e, h, first, find(h, first, min_length), min_length)
                text, ends = _collapsed(part, s, e, first, runs)
                cut = np.searchsorted(runs[:, 0], np.arange(b - a + 1))
                out = []
                for d in range(b - a):
                    own = runs[cut[d]:cut[d + 1], 1:]
                    best = [None] * 4
                    if len(own):
                        start, length, q = own[np.lexsort((own[:, 2], own[:, 0], -own[:, 1]))[0]].tolist()
                        best = [start, length, q, 1000 * length // q]
                    listed = own.tolist()
                    kept = text[ends[d]:ends[d + 1]].tobytes()
                    row = [len(own), *best, hashlib.sha256("".join(f"{x},{y},{z}\n" for x, y, z in listed).encode()).hexdigest(),
                           hashlib.sha256(kept).hexdigest(), int(first[d + 1] - first[d])]
                    if want_runs:
                        row.append([{"start": x, "length": y, "period": z} for x, y, z in listed])
                    if want_text:
                        row.append(kept.decode("utf-8", "replace"))
                    out.append(row)
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a)] + [pa.array(c, t) for c, t in zip(cols, _types(want_runs, want_text))],
                    names=_names(want_runs, want_text))
    return run


def _types(want_runs, want_text):
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    return [pa.int64()] * 5 + [pa.string()] * 2 + [pa.int64()] + [pa.list_(run)] * want_runs + [pa.string()] * want_text


def _names(want_runs, want_text):
    return (["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "n_words"]
            + ["runs"] * want_runs + ["collapsed"] * want_text)


def detect(docs: DataFrame, min_length: int = MIN_LENGTH, want_runs: bool = True, want_text: bool = True) -> DataFrame:
    """Per document: its number of runs, the longest one (ties: smallest start, then period), digests of the run
    list and of the collapsed text, ``runs`` (start, length, period) and ``collapsed``, the text without the
    words that repeat a run's first period."""
    d = pick(docs, "doc_id", "text")
    id_type = d.schema["doc_id"].dataType.simpleString()
    schema = (f"doc_id {id_type}, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, "
              "runs_sha256 string, collapsed_sha256 string, n_words bigint")
    schema += ", runs array<struct<start:bigint,length:bigint,period:bigint>>" * want_runs + ", collapsed string" * want_text
    return d.mapInArrow(_worker(min_length, want_runs, want_text), schema)


def digest(docs: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """The digest columns of :func:`detect`."""
    return detect(docs, min_length, want_runs=False, want_text=False)


ship(__name__)
