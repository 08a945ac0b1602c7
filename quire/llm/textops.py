"""Vectorised word splitting and hashing over the UTF-8 buffers of Arrow string columns.

All functions work on one flat byte buffer that holds many texts, so the cost per word is a
few array operations rather than Python calls. Hashes are polynomial hashes modulo 2**64,
finished with a bit mixer; equal byte strings always hash alike.
"""

from __future__ import annotations

import sys
import types

import numpy as np
import pyarrow as pa
from pyspark import TaskContext

from quire.llm.shipping import ship

#: odd multipliers of the byte and the word polynomial, and their inverses modulo 2**64
P_BYTE, P_WORD = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_POW: dict[int, np.ndarray] = {}

#: bytes that belong to a word once A-Z are lower-cased: 0-9, a-z and every non-ASCII byte
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
#: bytes other than ASCII white space
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64 (grown on demand, kept per process)."""
    have = _POW.get(base)
    if have is None or len(have) < n:
        size = -(-n // (1 << 18)) * (1 << 18)
        out = np.full(size, base, np.uint64)
        out[0] = 1
        _POW[base] = have = np.multiply.accumulate(out)
    return have[:n]


def worker_store() -> types.ModuleType:
    """State that outlives a task in a reused Python worker."""
    return sys.modules.setdefault("_quire_llm_worker", types.ModuleType("_quire_llm_worker"))


def release(keep: str = "") -> None:
    """Give back what earlier stages left in this worker process: power tables, the worker's store but for ``keep``, Arrow's
    pool, freed heap pages. Workers are reused, and the stages' working sets would add up."""
    import ctypes
    import gc

    _POW.clear()
    store = worker_store().__dict__
    for name in [x for x in store if not x.startswith("_") and x not in (keep, "task")]:
        del store[name]
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def lean(run, keep: str = ""):
    """The mapInArrow function ``run``, whose worker gives memory back before it and, its own arrays too, after it: an idle
    worker holds little."""
    def task(batches):
        release(keep)
        yield from run(batches)
        release(keep)
    return task


def release_once() -> None:
    """:func:`release` on the first call of a task, for functions that are called once a group."""
    task = TaskContext.get()
    store = worker_store().__dict__
    if task is not None and store.get("task") != task.taskAttemptId():
        release()
        store["task"] = task.taskAttemptId()


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column; null reads as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    off = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset:column.offset + n + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[off[0]:off[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, off - off[0]


def chunks(offsets: np.ndarray, limit: int):
    """Row ranges [a, b) whose texts hold at most ``limit`` bytes together (one row at least)."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def words(buf: np.ndarray, offsets: np.ndarray, table: np.ndarray, fold: bool = False, piece: int = 1 << 20,
          heads: tuple[int, ...] = ()):
    """Words of every text of the buffer: (start, end, hash, first) arrays, where texts ``i`` own
    the words first[i]:first[i+1]. ``table`` marks the bytes of words; ``fold`` lower-cases A-Z first.
    With ``heads``, hash has a column more for each length: the hash of the word's first bytes.
    The buffer is taken piece by piece, cut between words, so temporaries stay small."""
    n = len(buf)
    ss, es, hs = [], [], []
    inv_int = inverse(P_BYTE)
    a = 0
    while a < n:
        b = min(n, a + piece)
        while b < n:  # end the piece where no word runs on
            cut = np.flatnonzero(~table[LOWER[buf[a:b]] if fold else buf[a:b]])
            bound = offsets[np.searchsorted(offsets, b, "right") - 1]
            last = max(a + int(cut[-1]) + 1 if len(cut) else a, int(bound))
            if last > a:
                b = last
                break
            b = min(n, b + piece)
        part = buf[a:b]
        if fold:
            part = LOWER[part]
        is_word = table[part]
        edge = np.zeros(b - a + 1, bool)
        edge[0] = True
        inner = offsets[np.searchsorted(offsets, a):np.searchsorted(offsets, b)] - a
        edge[inner] = True
        before = np.empty(b - a + 1, bool)
        before[0], before[1:] = False, is_word
        after = np.empty(b - a + 1, bool)
        after[:-1], after[-1] = is_word, False
        start = np.flatnonzero(after & (~before | edge))
        end = np.flatnonzero(before & (~after | edge))
        sums = np.zeros(b - a + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * powers(P_BYTE, b - a), out=sums[1:])
        back = powers(inv_int, b - a + 1)[start]
        h = mix((sums[end] - sums[start]) * back)
        hs.append(np.stack([h] + [mix((sums[np.minimum(end, start + k)] - sums[start]) * back) for k in heads], 1) if heads else h)
        ss.append(start + a)
        es.append(end + a)
        a = b
    s = np.concatenate(ss) if ss else np.zeros(0, np.int64)
    e = np.concatenate(es) if es else np.zeros(0, np.int64)
    h = np.concatenate(hs) if hs else np.zeros((0, 1 + len(heads)) if heads else 0, np.uint64)
    return s, e, h, np.searchsorted(s, offsets)


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` consecutive entries of ``h`` (runs over text borders included:
    the caller drops them)."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * powers(P_WORD, len(h)), out=sums[1:])
    m = len(h) - n + 1
    return mix((sums[n:] - sums[:m]) * powers(inverse(P_WORD), m))


def inside(first: np.ndarray, n: int) -> np.ndarray:
    """For every word position: does a run of ``n`` words that starts here stay in its text?"""
    total = int(first[-1])
    ok = np.zeros(max(0, total - n + 1), bool)
    left = np.repeat(first[1:], np.diff(first)) - np.arange(total)
    ok[:] = left[:len(ok)] >= n
    return ok


def spread(starts: np.ndarray, n: int, total: int) -> np.ndarray:
    """Mask of the positions covered by runs of ``n`` that begin at ``starts``."""
    step = np.zeros(total + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + n, -1)
    return np.cumsum(step[:total]) > 0


ship(__name__)
