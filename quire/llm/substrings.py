"""Substring dedup with prefix-partitioned suffix trees.

Every word position starts a suffix. Suffixes are divided by variable-length word prefixes: a first
pass counts prefixes (one word, two words, ... up to a depth that fits the input); a prefix that few
suffixes share closes early and neighbouring short ones are packed together, a frequent one is made
longer, and one that stays too frequent at the last depth is divided by its whole window. The groups
this gives fit in memory whatever the word statistics are.

Each group holds one subtree of the suffix tree, cut at ``depth`` words: its suffixes are sorted by
path, and suffixes with an equal path of ``depth`` words hang below one deep internal node. Such a node
is a repeat; windows that follow each other in a text join to maximal repeats. Below a node every
document but the smallest loses its words.

Scale: suffixes travel packed (about nine bytes each: the path key and a position delta), texts travel
compressed, once. Within one task repeats are resolved before the shuffle, so the node of a passage
that a third of all documents share receives one document per task unit, not all of them. Windows lost
that way need no group's suffixes; a unit's are dealt over all groups by its task and number. The width
of path keys grows with the number of suffixes so that two different paths share one with
a probability below 2**-12 over the whole input.

Defined results: null or empty text has no words; documents with a null doc_id neither lose words nor
make others lose any; rows equal in doc_id and text are one document with one result row each; a text
shorter than a window loses nothing; words are runs of anything but ASCII white space, unchanged.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import packing as K
from quire.llm import textops as T
from quire.llm.frames import pick
from quire.llm.shipping import ship

DEPTH = 13
GROUP_SUFFIXES = 2_000_000
UNIT_BYTES = 8 << 20
BUCKET_BYTES = 8 << 20
WORD_BITS, MAX_WORDS = 6, 3
DEEP_KEYS_FROM = 1 << 36  # suffixes from which path keys have 16 bytes


def prefix_codes(h: np.ndarray, words: int, n: int) -> np.ndarray:
    """Code of the first ``words`` words of each of the first ``n`` suffixes, WORD_BITS bits a word."""
    bits = (h >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    code = np.zeros(n, np.int64)
    for k in range(words):
        code = (code << WORD_BITS) | bits[k:k + n]
    return code


def plan_groups(counts: np.ndarray, words: int, limit: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(first group, number of groups) of every prefix code, and the number of groups in all."""
    fan = 1 << WORD_BITS
    first, parts = np.zeros(len(counts), np.int64), np.ones(len(counts), np.int64)
    state = {"next": 0, "room": 0}

    def close(a, b, size):  # codes a..b are one prefix (or a packed run of small ones)
        if size > limit:  # the longest prefix is still too frequent: divide by whole windows
            n = -(-int(size) // limit)
            first[a:b], parts[a:b] = state["next"], n
            state.update(next=state["next"] + n, room=0)
        else:
            if size > state["room"]:
                state.update(next=state["next"] + 1, room=limit)
            first[a:b] = state["next"] - 1
            state["room"] -= int(size)

    def walk(a, width):
        size = counts[a:a + width].sum()
        if size <= limit or width == 1:
            close(a, a + width, size)
            return
        for k in range(fan):
            walk(a + k * (width // fan), width // fan)

    for k in range(fan):
        walk(k * fan ** (words - 1), fan ** (words - 1))
    return first, parts, max(1, state["next"])


def _windows(buf, off, depth, wide):
    """Words per text, suffix path keys (one or two lanes), word hashes, and which suffixes are whole."""
    _, _, h, first = T.words(buf, off, T.NOT_SPACE)
    keys = [T.windows(h, depth)]
    if wide:
        keys.append(T.windows(T.mix(h + np.uint64(0x5851F42D4C957F2D)), depth))
    return first, keys, h, T.inside(first, depth)


def _count(depth, words):
    def run(batches):
        total = np.zeros(1 << (WORD_BITS * words), np.int64)
        for (texts,) in K.units(batches, 0, 4 << 20):
            buf, off = T.flat(texts)
            _, _, h, ok = _windows(buf, off, depth, False)
            if len(ok):
                total += np.bincount(prefix_codes(h, words, len(ok))[ok], minlength=len(total))
        code = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(code, pa.int64()), pa.array(total[code], pa.int64())], names=["code", "n"])
    return run




def _suffixes(depth, words, wide, plan_of):
    """Packed rows (group, kind, blob): kind 1 suffixes, kind 2 windows already known to be repeats."""
    def run(batches):
        first_group, parts, n_groups = plan_of()
        task = TaskContext.get().partitionId() << 32
        for u, (ids, rows, texts) in enumerate(K.units(batches, 2, UNIT_BYTES)):
            key, null, row = K.doc_keys(ids, rows)
            buf, off = T.flat(texts)
            first, lanes, h, ok = _windows(buf, off, depth, wide)
            at = np.flatnonzero(ok)
            doc = np.searchsorted(first, at, "right") - 1
            fine = null[doc] == 0
            at, doc = at[fine], doc[fine]
            paths = [x[at] for x in lanes]
            code = prefix_codes(h, words, len(ok))[at]
            order = np.lexsort(paths[::-1]) if wide else np.argsort(paths[0], kind="stable")
            same = np.ones(max(0, len(order) - 1), bool)
            for x in paths:
                s = x[order]
                same &= s[1:] == s[:-1]
            run_at = np.flatnonzero(np.concatenate([[True], ~same])) if len(order) else np.zeros(0, np.int64)
            lost = np.zeros(len(at), bool)
            if len(order):
                low = np.minimum.reduceat(key[doc[order]], run_at)
                lost[order] = key[doc[order]] > np.repeat(low, np.diff(np.append(run_at, len(order))))
            out_g, out_k, out_b = [], [], []
            keep = np.flatnonzero(~lost)
            g = first_group[code[keep]]
            many = parts[code[keep]]
            g = g + (paths[0][keep] % many.astype(np.uint64)).astype(np.int64)
            for group, part in K.by_group(g, n_groups):
                i = keep[part]  # ascending positions
                d, inv = np.unique(doc[i], return_inverse=True)
                out_g.append(group)
                out_k.append(1)
                out_b.append(K.dump(key[d], row[d], first[d].astype(np.uint32), np.bincount(inv).astype(np.uint32),
                                    at[i].astype(np.uint32), *[x[i] for x in paths]))
            i = np.flatnonzero(lost)
            if len(i):
                d, inv = np.unique(doc[i], return_inverse=True)
                out_g.append(int(T.mix(np.array([task + u], np.uint64))[0] % np.uint64(n_groups)))
                out_k.append(2)
                out_b.append(K.dump(key[d], row[d], first[d].astype(np.uint32), np.bincount(inv).astype(np.uint32), at[i].astype(np.uint32)))
            yield pa.RecordBatch.from_arrays([pa.array(out_g, pa.int64()), pa.array(out_k, pa.int32()), pa.array(out_b, pa.binary())],
                                             names=["group", "kind", "blob"])
    return run


def deep_nodes(paths: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The subtree of a group cut at its deep internal nodes: (order of the suffixes, start of each
    node's run of leaves in that order). A run of one leaf is no internal node."""
    order = np.lexsort(paths[::-1]) if len(paths) > 1 else np.argsort(paths[0], kind="stable")
    fresh = np.zeros(len(order), bool)
    fresh[:1] = True
    for x in paths:
        s = x[order]
        fresh[1:] |= s[1:] != s[:-1]
    return order, np.flatnonzero(fresh)


def _resolve(n_buckets):
    """A group's blobs to packed removed windows per bucket: (bucket, kind 1, blob)."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        known = [K.load(b) for b in pdf.loc[pdf["kind"] == 2, "blob"]]
        leaves = [K.load(b) for b in pdf.loc[pdf["kind"] == 1, "blob"]]
        lost = []
        if leaves:
            order, node = deep_nodes([np.concatenate(x) for x in zip(*(b[5:] for b in leaves))])
            ids = np.concatenate([np.repeat(b[0], b[3]) for b in leaves])[order]
            gone = np.empty(len(order), bool)
            gone[order] = ids > np.repeat(np.minimum.reduceat(ids, node), np.diff(np.append(node, len(order))))
            lost = np.split(gone, np.cumsum([len(b[4]) for b in leaves])[:-1])
        fields = []
        for (d, r, first, n, at, *_), gone in zip(known + leaves, [slice(None)] * len(known) + list(lost)):
            fields.append((np.repeat(d, n)[gone], np.repeat(r, n)[gone], (at - np.repeat(first, n))[gone]))
        ids, rows, starts = (np.concatenate(x) for x in zip(*fields))
        out = []
        for b, part in K.by_group(K.bucket_of(ids, np.zeros(len(ids), np.uint8), rows, n_buckets), n_buckets):
            part = part[np.lexsort((starts[part], rows[part], ids[part]))]
            edge = np.flatnonzero(np.concatenate([[True], (np.diff(ids[part]) != 0) | (np.diff(rows[part].astype(np.int64)) != 0)]))
            n = np.diff(np.append(edge, len(part))).astype(np.uint32)
            step = np.diff(starts[part].astype(np.int64), prepend=0)
            step[edge] = starts[part][edge]
            out.append((b, 1, K.dump(ids[part][edge], rows[part][edge], n, step.astype(np.uint32))))
        return pd.DataFrame(out, columns=["bucket", "kind", "blob"])
    return run


def _finish(depth, want_text):
    """A bucket's texts and removed windows to result rows."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        lost: dict[tuple[int, int], list[np.ndarray]] = {}
        for blob in pdf.loc[pdf["kind"] == 1, "blob"]:
            ids, rows, n, step = K.load(blob)
            for d, r, s in zip(ids.tolist(), rows.tolist(), np.split(step, np.cumsum(n)[:-1])):
                lost.setdefault((d, r), []).append(np.cumsum(s.astype(np.int64)))
        out = []
        for blob in pdf.loc[pdf["kind"] == 0, "blob"]:
            ids, null, rows, sizes, body = K.load(blob)
            raw, at = body.tobytes(), 0
            for d, z, r, size in zip(ids.tolist(), null.tolist(), rows.tolist(), sizes.tolist()):
                words = raw[at:at + size].split()  # ASCII white space: space and 0x09 to 0x0D
                at += size
                n, starts = len(words), None if z else lost.get((d, r))
                if starts is not None:
                    gone = T.spread(np.unique(np.concatenate(starts)), depth, n)
                    words = list(compress(words, (~gone).tolist()))
                kept = b" ".join(words)
                out.append((None if z else d, n, n - len(words), hashlib.sha256(kept).hexdigest(),
                            kept.decode() if want_text else None))
        res = pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])
        return res.astype({"doc_id": "Int64"})
    return run


def dedup(docs: DataFrame, depth: int = DEPTH, group_suffixes: int = GROUP_SUFFIXES, bucket_bytes: int = BUCKET_BYTES,
          want_text: bool = True) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256, kept (the text left, or null
    unless ``want_text``)."""
    d = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    d = d.select("doc_id", F.xxhash64("text").bitwiseAND(F.lit(0xFFFFFFFF)).alias("row32"), "text")
    size = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    need = max(1, size // 6 // group_suffixes).bit_length() + 4
    words = min(MAX_WORDS, max(2, -(-need // WORD_BITS)))
    rows = (d.select("text").mapInArrow(_count(depth, words), "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n")).collect())
    counts = np.zeros(1 << (WORD_BITS * words), np.int64)  # at most 2**18 prefixes
    for code, n in rows:
        counts[code] = n
    plan = plan_groups(counts, words, group_suffixes)
    held = docs.sparkSession.sparkContext.broadcast(plan)
    n_buckets = max(1, -(-size // bucket_bytes))
    s = d.mapInArrow(_suffixes(depth, words, counts.sum() >= DEEP_KEYS_FROM, lambda: held.value), "group bigint, kind int, blob binary")
    spans = s.groupBy("group").applyInPandas(_resolve(n_buckets), "bucket bigint, kind int, blob binary")
    texts = d.mapInArrow(K.pack_texts(n_buckets), "bucket bigint, kind int, blob binary")
    return texts.unionByName(spans).groupBy("bucket").applyInPandas(
        _finish(depth, want_text), "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept string")


def digest(docs: DataFrame, **kw) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256."""
    return dedup(docs, want_text=False, **kw).drop("kept")


ship(__name__)
