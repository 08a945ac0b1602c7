"""Suffix-array dedup on bytes: remove every byte inside a ``length``-byte string that occurs elsewhere.

1. Every window of ``length`` bytes has an anchor: the leftmost smallest k-gram hash inside it. Equal
   windows have equal anchors at the same place, and windows next to each other mostly share one. Anchor
   hashes (about one in 170 bytes) are shuffled and counted; a window whose anchor occurs once is unique.
2. For repeated anchors the stretch of text that holds all windows of the anchor (under 2 * ``length``
   bytes) travels to the anchor's group; equal stretches of a task travel once.
3. A group, of bounded size, cuts its distinct stretches into phrases at places that the next 8 bytes
   alone decide, and builds the suffix array of the phrase sequence by linear grouping
   (:mod:`quire.llm.suffixarray`). Two windows are equal when their phrases are equal (the same suffix
   array interval at that depth) and the bytes before the first and after the last phrase are.
4. Windows found twice go back to their documents as byte spans.

An anchor with more than ``hot`` records, such as a passage in a third of all documents, is not gathered
in one group: its windows are keyed by their whole content and spread over all groups.

Scale: texts travel compressed and once (both uses share an exchange); everything else is a few percent
of them. Groups and buckets grow in number, not in size. Hashes are compared together with a second,
independent hash, so a false match needs a 128-bit collision.

Defined results: null text is the empty text; a text shorter than ``length`` loses nothing; repeated
rows are occurrences of their own (so both lose every string of ``length`` bytes); rows with a null
doc_id take part; overlapping occurrences count.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import packing as K
from quire.llm import suffixarray as S
from quire.llm import textops as T
from quire.llm.frames import pick
from quire.llm.shipping import ship

LENGTH = 400
GRAM = 64
PHRASE_BITS = 5
LOOK = 8
HOT = 4096
BUCKET_BYTES = 8 << 20
GROUP_BYTES = 2 << 20
PIECE = 1 << 20
P_ONE, P_TWO = T.P_BYTE, 0xC2B2AE3D27D4EB4F
BLOB = "kind int, blob binary"


class Hasher:
    """Hashes of byte ranges of one buffer."""

    def __init__(self, buf: np.ndarray, base: int):
        self.sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * T.powers(base, len(buf)), out=self.sums[1:])
        self.back = T.powers(T.inverse(base), len(buf) + 1)

    def runs(self, n: int) -> np.ndarray:
        """Of every range of n bytes."""
        m = len(self.sums) - n
        return T.mix((self.sums[n:] - self.sums[:m]) * self.back[:m]) if m > 0 else np.zeros(0, np.uint64)

    def ranges(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return T.mix((self.sums[b] - self.sums[a]) * self.back[a])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive entries (block-wise running minima from both sides)."""
    n = len(x)
    pad = np.full(-n % w, np.iinfo(x.dtype).max, x.dtype)
    blocks = np.concatenate([x, pad]).reshape(-1, w)
    right = np.minimum.accumulate(blocks, axis=1).ravel()
    left = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(left[:n - w + 1], right[w - 1:n])


def anchor_runs(buf: np.ndarray, off: np.ndarray, length: int, gram: int, known: np.ndarray | None = None):
    """Runs of windows with one anchor, over a buffer of texts: arrays (doc, first window, last window,
    anchor hash, two hashes of the stretch of bytes that holds the run), windows by their start in the
    buffer. With ``known`` (sorted hashes) only the runs of these anchors. The buffer is taken in
    pieces, so temporaries stay small."""
    out = []
    for a, b in _pieces(off, length):  # bytes a..b: whole texts, or a part of one long text
        one = Hasher(buf[a:b], P_ONE)
        h = one.runs(gram)
        w = length - gram + 1
        if len(h) < w:
            continue
        key = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
        anchor = (sliding_min(key, w) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        start = np.arange(len(anchor)) + a
        doc = np.searchsorted(off, start, "right") - 1
        ok = start + length <= off[doc + 1]
        anchor, start, doc = anchor[ok], start[ok], doc[ok]
        if not len(start):
            continue
        new = np.flatnonzero(np.concatenate([[True], (np.diff(anchor) != 0) | (np.diff(doc) != 0)]))
        last = np.append(new[1:], len(start)) - 1
        name = h[anchor[new]]
        if known is not None:
            i = np.searchsorted(known, name)
            i[i == len(known)] = 0
            ok = known[i] == name
            new, last, name = new[ok], last[ok], name[ok]
        lo, hi = start[new], start[last]
        two = Hasher(buf[a:b], P_TWO).ranges(lo - a, hi - a + length) if known is not None else np.zeros(len(new), np.uint64)
        out.append((doc[new], lo, hi, name, one.ranges(lo - a, hi - a + length), two))
    if not out:
        z, u = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        return z, z, z, u, u, u
    return tuple(np.concatenate(x) for x in zip(*out))


def _pieces(off: np.ndarray, length: int):
    for a, b in T.chunks(off, PIECE):
        lo, hi = int(off[a]), int(off[b])
        while hi - lo > 2 * PIECE:  # one long text: parts that share length - 1 bytes
            yield lo, lo + PIECE + length - 1
            lo += PIECE
        yield lo, hi


def _unpack(blobs):
    """The texts of a bucket as one buffer: (ids, null, rows, buf, off)."""
    parts = [K.load(b) for b in blobs]
    if not parts:
        return None
    ids, null, rows, sizes, body = (np.concatenate(x) for x in zip(*parts))
    return ids, null, rows, body, np.concatenate([[0], np.cumsum(sizes)])


def _anchors(length, gram, n_groups, n_buckets):
    """(doc_id, row32, text) to (target group, blob of anchor hashes with their bucket and whether the
    unit holds more than one)."""
    def run(batches):
        for ids, rows, texts in K.units(batches, 2, BUCKET_BYTES):
            key, null, row = K.doc_keys(ids, rows)
            bucket = K.bucket_of(key, null, row, n_buckets)
            buf, off = T.flat(texts)
            doc, _, _, h, _, _ = anchor_runs(buf, off, length, gram)
            pair = np.rec.fromarrays([h, bucket[doc]], names="h,b")
            one, n = np.unique(pair, return_counts=True)
            g_out, blobs = [], []
            for g, part in K.by_group((one.h % np.uint64(n_groups)).astype(np.int64), n_groups):
                g_out.append(g)
                blobs.append(K.dump(np.ascontiguousarray(one.h[part]), np.ascontiguousarray(one.b[part]), np.minimum(n[part], 2).astype(np.uint8)))
            yield pa.RecordBatch.from_arrays([pa.array(g_out, pa.int64()), pa.array([0] * len(g_out), pa.int32()), pa.array(blobs, pa.binary())],
                                             names=["target", "kind", "blob"])
    return T.lean(run)


def _repeated(n_buckets, hot):
    """A group's anchors to the repeated ones per bucket, with whether they are hot."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        T.release_once()
        h, b, n = (np.concatenate(x) for x in zip(*(K.load(x) for x in pdf["blob"])))
        order = np.argsort(h, kind="stable")
        h, b, n = h[order], b[order], n[order]
        at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        records = np.diff(np.append(at, len(h)))
        often = np.add.reduceat(n.astype(np.int64), at) > 1
        keep = np.repeat(often, records)
        is_hot = np.repeat(records > hot, records)[keep]
        h, b = h[keep], b[keep]
        out = [(g, 1, K.dump(h[part], is_hot[part])) for g, part in K.by_group(b, n_buckets)]
        return pd.DataFrame(out, columns=["target", "kind", "blob"])
    return run


def _stretches(length, gram, n_groups):
    """A bucket's texts and repeated anchors to stretches (kind 2) and hot windows (kind 3) per group."""
    def run(texts: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
        T.release_once()
        out = []
        known = [K.load(b) for b in anchors["blob"]]
        got = _unpack(texts["blob"])
        if known and got:
            ids, null, rows, buf, off = got
            keys, at = np.unique(np.concatenate([k[0] for k in known]), return_index=True)
            hot = np.concatenate([k[1] for k in known])[at]
            doc, first, last, h, one, two = anchor_runs(buf, off, length, gram, keys)
            is_hot = hot[np.searchsorted(keys, h)] if len(h) else np.zeros(0, bool)
            own = lambda k: (ids[doc[k]], null[doc[k]], rows[doc[k]], (first[k] - off[doc[k]]).astype(np.int64))
            k = np.flatnonzero(~is_hot)
            if len(k):
                size = (last - first + length).astype(np.int64)
                mark = np.rec.fromarrays([one[k], two[k], size[k]], names="x,y,n")
                _, rep, same = np.unique(mark, return_index=True, return_inverse=True)
                target = (h[k] % np.uint64(n_groups)).astype(np.int64)
                by_stretch = np.argsort(same, kind="stable")
                many = np.bincount(same, minlength=len(rep))
                ends = np.cumsum(many)
                for g, part in K.by_group(target[rep], n_groups):  # part: distinct stretches, ascending
                    n = many[part]
                    who = k[np.concatenate([by_stretch[ends[p] - c:ends[p]] for p, c in zip(part, n)])]
                    src = k[rep[part]]
                    body = np.concatenate([buf[first[s]:first[s] + size[s]] for s in src])
                    out.append((g, 2, K.dump(size[src], n, *own(who), body)))
            every = np.flatnonzero(is_hot)
            for at in range(0, len(every), 1024):  # under a megabyte of stretches at a time
                k = every[at:at + 1024]
                count = last[k] - first[k] + 1
                who = np.repeat(k, count)
                body = np.concatenate([buf[a:b + length] for a, b in zip(first[k], last[k])])
                base = np.cumsum(count + length - 1) - (count + length - 1)
                rel = np.arange(len(who)) - np.repeat(np.cumsum(count) - count, count)
                start = np.repeat(base, count) + rel
                x, y = (Hasher(body, p).ranges(start, start + length) for p in (P_ONE, P_TWO))
                place = first[who] + rel - off[doc[who]]
                for g, part in K.by_group((x % np.uint64(n_groups)).astype(np.int64), n_groups):
                    d = doc[who[part]]
                    out.append((g, 3, K.dump(x[part], y[part], ids[d], null[d], rows[d], place[part].astype(np.int64))))
        return pd.DataFrame(out, columns=["target", "kind", "blob"])
    return run


def repeated_windows(buf: np.ndarray, off: np.ndarray, length: int) -> np.ndarray:
    """Starts of the windows (inside texts) that occur at another place of the buffer too, by the suffix
    array of the texts' phrases."""
    one, two = Hasher(buf, P_ONE), Hasher(buf, P_TWO)
    n_text = len(off) - 1
    count = np.maximum(np.diff(off) - length + 1, 0)
    start = np.arange(int(count.sum())) + np.repeat(off[:-1] - (np.cumsum(count) - count), count)
    text = np.repeat(np.arange(n_text), count)
    if not len(start):
        return start
    # phrase borders: decided by the LOOK bytes from there on, within the text
    look = one.runs(LOOK)
    border = np.flatnonzero((look >> np.uint64(64 - PHRASE_BITS)) == 0)
    owner = np.searchsorted(off, border, "right") - 1
    inside = border + LOOK <= off[owner + 1]
    border, owner = border[inside], owner[inside]
    # one symbol a border: the phrase up to the next border of the text, or 1 after the last
    follows = np.append(owner[1:] == owner[:-1], False) if len(border) else np.zeros(0, bool)
    symbols = np.ones(len(border) + 1, np.int64)
    symbols[-1] = 0
    i = np.flatnonzero(follows)
    if len(i):
        _, name = np.unique(np.rec.fromarrays([one.ranges(border[i], border[i + 1]), two.ranges(border[i], border[i + 1]),
                                               border[i + 1] - border[i]], names="x,y,n"), return_inverse=True)
        symbols[i] = name + 2
    order = S.suffix_array(symbols)
    # first and last border that the window decides
    low = np.searchsorted(border, start)
    high = np.searchsorted(border, start + (length - LOOK), "right") - 1
    has = high >= low
    depth = np.where(has, high - low, 0)
    most = int(depth.max())
    lcp = S.common_prefixes(symbols, order, most)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    interval = np.zeros(len(start), np.int64)
    by_depth = np.argsort(depth, kind="stable")
    cuts = np.searchsorted(depth[by_depth], np.arange(1, most + 2))
    for d in range(1, most + 1):  # the suffix array interval of the window's phrases
        w = by_depth[cuts[d - 1]:cuts[d]]
        if len(w):
            interval[w] = np.cumsum(lcp < d)[rank[low[w]]]
    safe = np.append(border, 0)
    head = np.where(has, safe[np.minimum(low, len(border))], start + length)
    tail = np.where(has, safe[np.where(has, high, 0)], start + length)
    key = T.mix(one.ranges(start, head) * np.uint64(3) + (head - start).astype(np.uint64))
    key = T.mix(key + interval.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + depth.astype(np.uint64))
    key = T.mix(key ^ one.ranges(tail, start + length))
    check = two.ranges(start, start + length)
    by_key = np.lexsort((check, key))
    same = (key[by_key][1:] == key[by_key][:-1]) & (check[by_key][1:] == check[by_key][:-1])
    twice = np.zeros(len(start), bool)
    twice[by_key[1:][same]] = True
    twice[by_key[:-1][same]] = True
    return start[twice]


def _match(length, n_buckets):
    """A group's stretches and hot windows to byte spans per bucket."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        T.release_once()
        found = []  # (ids, null, rows, start, end)
        parts = [K.load(b) for b in pdf.loc[pdf["kind"] == 2, "blob"]]
        if parts:
            size, n, ids, null, rows, place, body = (np.concatenate(x) for x in zip(*parts))
            off = np.concatenate([[0], np.cumsum(size)])
            sums = [Hasher(body, p).ranges(off[:-1], off[1:]) for p in (P_ONE, P_TWO)]
            _, rep, same = np.unique(np.rec.fromarrays([*sums, size], names="x,y,n"), return_index=True, return_inverse=True)
            total = np.bincount(same, weights=n)
            # distinct stretches only: one that occurs more than once is a repeat as a whole
            keep = np.concatenate([body[off[r]:off[r + 1]] for r in rep])
            d_off = np.concatenate([[0], np.cumsum(size[rep])])
            hit = np.zeros(len(keep) + 1, bool)
            hit[repeated_windows(keep, d_off, length)] = True
            spans = []
            for s in range(len(rep)):
                a, b = d_off[s], d_off[s + 1] - length + 1
                if total[s] > 1:
                    spans.append((np.array([0]), np.array([b - a - 1])))
                else:
                    w = np.flatnonzero(hit[a:b])
                    cut = np.flatnonzero(np.diff(w) > 1)
                    spans.append((w[np.concatenate([[0], cut + 1])], w[np.append(cut, len(w) - 1)]) if len(w) else (w, w))
            per = np.array([len(x[0]) for x in spans])
            lo, hi = (np.concatenate([x[j] for x in spans]) for j in (0, 1))
            s_at = np.cumsum(per) - per
            of = np.repeat(same, n)  # stretch of every occurrence
            k = np.repeat(np.arange(len(of)), per[of])
            j = np.repeat(s_at[of], per[of]) + np.arange(len(k)) - np.repeat(np.cumsum(per[of]) - per[of], per[of])
            found.append((ids[k], null[k], rows[k], place[k] + lo[j], place[k] + hi[j] + length))
        parts = [K.load(b) for b in pdf.loc[pdf["kind"] == 3, "blob"]]
        if parts:
            x, y, ids, null, rows, place = (np.concatenate(v) for v in zip(*parts))
            order = np.lexsort((y, x))
            same = (x[order][1:] == x[order][:-1]) & (y[order][1:] == y[order][:-1])
            twice = np.zeros(len(x), bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            found.append((ids[twice], null[twice], rows[twice], place[twice], place[twice] + length))
        ids, null, rows, lo, hi = (np.concatenate(x) for x in zip(*found))
        out = []
        for b, part in K.by_group(K.bucket_of(ids, null, rows, n_buckets), n_buckets):
            part = part[np.lexsort((lo[part], rows[part], null[part], ids[part]))]
            out.append((b, 4, K.dump(ids[part], null[part], rows[part], lo[part], hi[part])))
        return pd.DataFrame(out, columns=["target", "kind", "blob"])
    return run


def _finish(want_text):
    """A bucket's texts and spans to result rows."""
    def run(texts: pd.DataFrame, spans: pd.DataFrame) -> pd.DataFrame:
        T.release_once()
        gone: dict[tuple[int, int, int], list] = {}
        for blob in spans["blob"]:
            for d, z, r, a, b in zip(*(x.tolist() for x in K.load(blob))):
                gone.setdefault((d, z, r), []).append((a, b))
        out = []
        for blob in texts["blob"]:
            ids, null, rows, sizes, body = K.load(blob)
            raw, at = body.tobytes(), 0
            for d, z, r, size in zip(ids.tolist(), null.tolist(), rows.tolist(), sizes.tolist()):
                text = raw[at:at + size]
                at += size
                merged: list[list[int]] = []
                for a, b in sorted(gone.get((d, z, r), ())):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], b)
                    else:
                        merged.append([a, b])
                kept, end = [], 0
                for a, b in merged:
                    kept.append(text[end:a])
                    end = b
                kept = b"".join(kept + [text[end:]])
                out.append((None if z else d, size, size - len(kept), len(merged), hashlib.sha256(kept).hexdigest(), kept if want_text else None))
        res = pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
        return res.astype({"doc_id": "Int64"})
    return run


def dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, bucket_bytes: int = BUCKET_BYTES,
          group_bytes: int = GROUP_BYTES, want_text: bool = True) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes left, or
    null unless ``want_text``)."""
    d = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    d = d.select("doc_id", F.xxhash64("text").bitwiseAND(F.lit(0xFFFFFFFF)).alias("row32"), "text")
    size = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_buckets = max(1, -(-size // bucket_bytes))
    n_groups = max(1, -(-4 * size // group_bytes))  # a group's stretches, were all windows repeated
    target = f"target bigint, {BLOB}"
    texts = d.mapInArrow(K.pack_texts(n_buckets), f"bucket bigint, {BLOB}").groupBy("bucket")
    anchors = d.mapInArrow(_anchors(length, gram, n_buckets, n_buckets), target).groupBy("target").applyInPandas(_repeated(n_buckets, hot), target)
    stretches = texts.cogroup(anchors.groupBy("target")).applyInPandas(_stretches(length, gram, n_groups), target)
    spans = stretches.groupBy("target").applyInPandas(_match(length, n_buckets), target)
    return texts.cogroup(spans.groupBy("target")).applyInPandas(
        _finish(want_text), "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")


def digest(docs: DataFrame, **kw) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return dedup(docs, want_text=False, **kw).drop("kept")


ship(__name__)
