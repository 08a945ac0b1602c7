"""Packed shuffles: many small records of one task travel as one compressed row per target.

A task gathers a unit of texts (a bounded number of bytes) and emits, for each target group, one binary
row that holds numpy arrays. The shuffle then moves a few thousand rows instead of one per record, and
the arrays arrive ready for vectorised work.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard

from quire.llm import textops as T
from quire.llm.shipping import ship

UNIT_BYTES = 16 << 20
RAW, PACKED, DELTA = 0, 1, 2


def dump(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes: each raw, or zstd-compressed when that is shorter; ascending integers as deltas."""
    out = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        body, how = a.tobytes(), RAW  # short ones stay as they are
        if a.dtype.kind in "iu" and 8 >= a.dtype.itemsize > 1 and a.nbytes > 64 and (a[1:] >= a[:-1]).all():
            step = np.diff(a, prepend=a[:1] * 0).astype(a.dtype)
            # bytes of one significance together: they compress far better
            body, how = step.view(np.uint8).reshape(-1, a.dtype.itemsize).T.tobytes(), DELTA
        small = zstandard.ZstdCompressor(level=3).compress(body) if len(body) > 64 else body
        if len(small) < len(body):
            body, how = small, how | PACKED
        head = f"{a.dtype.str},{len(a)},{how},{len(body)};".encode()
        out += [head, body]
    return b"".join(out)


def load(blob: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(blob):
        end = blob.index(b";", at)
        kind, n, how, size = blob[at:end].decode().split(",")
        body, n, how = blob[end + 1:end + 1 + int(size)], int(n), int(how)
        at = end + 1 + int(size)
        if how & PACKED:
            body = zstandard.ZstdDecompressor().decompress(body)
        if how & DELTA:
            width = np.dtype(kind).itemsize
            step = np.frombuffer(body, np.uint8).reshape(width, -1).T.copy().view(kind).ravel()
            out.append(np.cumsum(step, dtype=kind))
        else:
            out.append(np.frombuffer(body, kind))
        assert len(out[-1]) == n
    return out


def units(batches, at: int, limit: int = UNIT_BYTES):
    """Batches merged or cut to units of at most ``limit`` text bytes (one row at least): lists of columns."""
    held, size = [], 0
    for batch in batches:
        _, off = T.flat(batch.column(at))
        for a, b in T.chunks(off, limit):
            part = batch.slice(a, b - a)
            n = int(off[b] - off[a])
            if held and size + n > limit:
                yield _joined(held)
                held, size = [], 0
            held.append(part)
            size += n
    if held:
        yield _joined(held)


def _joined(parts):
    t = pa.Table.from_batches(parts)
    return [t.column(i).combine_chunks() if t.num_rows else t.column(i) for i in range(t.num_columns)]


def by_group(group: np.ndarray, n_groups: int):
    """(group, indices in their order) for every group that occurs."""
    order = np.argsort(group, kind="stable")
    edges = np.searchsorted(group[order], np.arange(n_groups + 1)) if n_groups < 4 * len(group) else None
    if edges is not None:
        for g in np.flatnonzero(np.diff(edges)):
            yield int(g), order[edges[g]:edges[g + 1]]
        return
    cut = np.flatnonzero(np.diff(group[order])) + 1
    for part in np.split(order, cut):
        if len(part):
            yield int(group[part[0]]), part


def doc_keys(ids: pa.Array, rows: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id or 0, 1 where the id is null, 32-bit row hash) as arrays."""
    null = np.asarray(ids.is_null()).astype(np.uint8)
    return ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), null, rows.to_numpy(zero_copy_only=False).astype(np.uint32)


def bucket_of(ids: np.ndarray, null: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """The bucket a document's text and spans meet in."""
    x = T.mix(ids.astype(np.uint64) * np.uint64(3) + null + (rows.astype(np.uint64) << np.uint64(32)))
    return (x % np.uint64(n)).astype(np.int64)


def pack_texts(n_buckets: int):
    """mapInArrow function: (doc_id, row32, text) to (bucket, kind 0, blob) of whole texts."""
    def run(batches):
        for ids, rows, texts in units(batches, 2):
            key, null, row = doc_keys(ids, rows)
            buf, off = T.flat(texts)
            g_out, blobs = [], []
            for g, part in by_group(bucket_of(key, null, row, n_buckets), n_buckets):
                sizes = (off[part + 1] - off[part]).astype(np.int64)
                body = np.concatenate([buf[off[i]:off[i + 1]] for i in part])
                g_out.append(g)
                blobs.append(dump(key[part], null[part], row[part], sizes, body))
            yield pa.RecordBatch.from_arrays([pa.array(g_out, pa.int64()), pa.array([0] * len(g_out), pa.int32()), pa.array(blobs, pa.binary())],
                                             names=["bucket", "kind", "blob"])
    return T.lean(run)


ship(__name__)
