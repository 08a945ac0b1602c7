"""Near-duplicate documents by Order MinHash and banded alignment.

A text's three-word shingles are labelled with their occurrence number. For each of ``SKETCHES`` random
orders the two smallest labelled shingles are taken and kept in text order; texts that agree on such an
ordered pair are candidates (agreement falls with the edit distance, not only with the shared
shingles). Texts of at most ``SHORT`` words also meet by what is left of them when up to as many words as
they may differ in are left out: that finds every pair of them. Candidates are verified by a banded,
bit-parallel alignment of their words: similarity = 1 - edit distance / longer length, and pairs of 0.8
or more are links. Classes are the connected components of the links.

A pair with shingle Jaccard J agrees on one sketch with a probability near J squared; scattered word edits
of similarity s leave about J = s^3 / (2 - s^3). README has the recall measured against brute force.

Scale: equal texts are merged first, so copies are one candidate whatever their number. Within a
sketch's group up to ``ALL_PAIRS`` texts are compared pairwise. In a larger group every text is first
compared with the group's smallest text, which is the same one in most groups of near copies. The texts of groups
these links leave apart are then compared with each other by an exact filter: a text's words are put in order from the
rarest, and similar texts share a word among the first of each, as many as they may differ in and one more. Pairs that
share one and pass by length and a bag of ``BAG`` counts are aligned. The passage
that brought a group together is none of its texts' rarest words, so it brings no pairs.

A group of up to ``GROUP_ROWS`` texts and ``GROUP_WORDS`` words meets whole in one task: a row is a text's place in it
with hashes of the text's words, so rows grow with the places. Hashes are aligned there, in one of the groups that a pair
has in common, and texts travel only for pairs that do align: the rest cost time, but no rows. The
texts of larger groups meet by a row for each of their rarest words, whatever the group. A word that is
rarest for more than ``WORD_ROWS`` texts is spread over cells: its rows grow with the square of its texts over
``WORD_ROWS``, which is left of the square; no pair is left out at any size.
Every text is first aligned with its smallest candidate; the second round takes only pairs that those
links have not already joined.

Defined results: words are lower-cased (A-Z) runs of letters and digits; a null text is the empty text;
texts without words are duplicates only of equal texts; a text of fewer than three words is one shingle;
rows equal in text are always in one class; rows with a null doc_id take part, and are kept last.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quire.llm import textops as T
from quire.llm.frames import components, pick, shuffle_partitions, written
from quire.llm.shipping import ship

SHINGLE = 3
SIMILARITY = 0.8
SKETCHES = 40
TAKEN = 2
SHORT = 14
ALL_PAIRS = 16
WORD_BITS = 20  # hash buckets of word counts: 4 MB of 32-bit counts, whatever the input
BAG = 256
WORD_ROWS = 4096  # rows of one word in a cell
GROUP_ROWS = 4096  # texts and words of a group that meets whole in one task
GROUP_WORDS = 1 << 20
MEETINGS = 1 << 17
CHUNK_BYTES = 4 << 20


def occurrence_numbers(g: np.ndarray) -> np.ndarray:
    """How often each value occurred before, in order."""
    order = np.argsort(g, kind="stable")
    s = g[order]
    fresh = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    out = np.empty(len(g), np.int64)
    out[order] = np.arange(len(g)) - np.repeat(fresh, np.diff(np.append(fresh, len(g))))
    return out


def sketch(h: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """The ordered tuples of a text with word hashes ``h``: one key a seed."""
    g = T.windows(h, min(SHINGLE, len(h)))
    x = T.mix(g + occurrence_numbers(g).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    n = len(x)
    out = np.empty(len(seeds), np.uint64)
    step = max(1, (1 << 21) // n)
    for a in range(0, len(seeds), step):
        v = T.mix(x[None, :] ^ seeds[a:a + step, None])
        at = np.argpartition(v, TAKEN - 1, axis=1)[:, :TAKEN] if n > TAKEN else np.broadcast_to(np.arange(n), v.shape)
        took = g[np.sort(at, axis=1)]  # in text order
        key = seeds[a:a + step] + np.uint64(TAKEN)
        for c in range(took.shape[1]):
            key = T.mix(key * np.uint64(0xD6E8FEB86659FD93) + took[:, c])
        out[a:a + step] = key
    return out


_LEFT_OUT: dict[tuple[int, int], np.ndarray] = {}  # a plain table: it travels with the functions that use it


def _left_out(n: int, k: int) -> np.ndarray:
    """Every way to keep ``n`` - ``k`` of ``n`` positions, one row each."""
    if (n, k) not in _LEFT_OUT:
        _LEFT_OUT[n, k] = np.array(list(combinations(range(n), n - k)), np.int64).reshape(-1, n - k)
    return _LEFT_OUT[n, k]


def shortened(h: np.ndarray, similarity: float) -> np.ndarray:
    """Keys of a short text without up to as many of its words as it may differ in: two short texts that
    are similar have one in common."""
    n, out = len(h), []
    for k in range(min(n - 1, int(n * (1 - similarity) + 1e-9)) + 1):
        took = h[_left_out(n, k)]
        key = np.full(len(took), n - k, np.uint64)
        for c in range(n - k):
            key = T.mix(key * np.uint64(0xD6E8FEB86659FD93) + took[:, c])
        out.append(key)
    return np.unique(np.concatenate(out))


def seeds(n: int) -> np.ndarray:
    return T.mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))


def _lists(parts: list) -> pa.Array:
    flat = np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64)
    offs = np.concatenate([[0], np.cumsum([len(k) for k in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offs), pa.array(flat))


def _sketches(n_sketches, similarity):
    """(tid, text) to (tid, n, keys, short): the keys of all sketches, and those of a short text's shortenings."""
    def run(batches):
        s, none = seeds(n_sketches), np.zeros(0, np.uint64)
        for batch in batches:
            buf, off = T.flat(batch.column(1))
            n_out, keys, short = [], [], []
            for a, b in T.chunks(off, CHUNK_BYTES):
                _, _, h, first = T.words(buf[off[a]:off[b]], off[a:b + 1] - off[a], T.ALNUM, fold=True)
                for d in range(b - a):
                    w = h[first[d]:first[d + 1]]
                    n_out.append(len(w))
                    keys.append(sketch(w, s) if len(w) else none)
                    short.append(shortened(w, similarity) if 0 < len(w) <= SHORT else none)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_out, pa.int64()), _lists(keys), _lists(short)],
                                             names=["tid", "n", "keys", "short"])
        T.release()
    return run


def memberships(sketched: DataFrame) -> DataFrame:
    """(band, key, tid, n) of texts(tid, n, keys, short): band -1 holds the shortenings."""
    long = sketched.select("tid", "n", F.posexplode("keys").alias("band", "key")).select("band", "key", "tid", "n")
    return long.union(sketched.select("tid", "n", F.explode("short").alias("key")).select(F.lit(-1).alias("band"), "key", "tid", "n"))


def candidates(sketched: DataFrame) -> DataFrame:
    """Distinct candidate pairs (a < b) of texts(tid, n, keys, short): all pairs of groups up to ALL_PAIRS, each
    text with the smallest in larger ones (``star``). A row (a, null, band, key, n) is text a's place in a larger group,
    for :func:`apart`; these three are null in pairs."""
    w = W.partitionBy("band", "key")
    rows = memberships(sketched).withColumn("_group", F.count("*").over(w)).where("_group > 1")
    o = w.orderBy("n", "tid")
    near = [F.lag("tid", d).over(o) for d in range(1, ALL_PAIRS)]
    wide = F.array(F.min("tid").over(w))
    rows = rows.withColumn("mates", F.when(F.col("_group") <= ALL_PAIRS, F.array(*near)).otherwise(wide))
    own = F.when(F.col("_group") > ALL_PAIRS, F.col("tid"))  # stands for the text's place
    rows = rows.select("band", "key", "tid", "n", (F.col("_group") > ALL_PAIRS).alias("star"), F.explode(F.concat(
        F.filter(F.array_distinct("mates"), lambda m: m.isNotNull() & (m != F.col("tid"))), F.filter(F.array(own), lambda m: m.isNotNull()))).alias("mate"))
    place = F.col("mate") == F.col("tid")
    return rows.select(F.least("tid", "mate").alias("a"), F.when(~place, F.greatest("tid", "mate")).alias("b"),
                       *[F.when(place, F.col(c)).alias(c) for c in ("band", "key", "n")], "star").distinct()


def _labelled(h: np.ndarray) -> np.ndarray:
    """A text's words, repeats told apart by their number: what two texts share of these is what they have in common."""
    return T.mix(h + occurrence_numbers(h).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _texts_words(column):
    """The labelled words of each text of a column."""
    buf, off = T.flat(column)
    for a, b in T.chunks(off, CHUNK_BYTES):
        _, _, h, first = T.words(buf[off[a]:off[b]], off[a:b + 1] - off[a], T.ALNUM, fold=True)
        for d in range(b - a):
            yield _labelled(h[first[d]:first[d + 1]])


def _rarest(w: np.ndarray, similarity: float, held: np.ndarray) -> np.ndarray:
    """The places of a text's rarest words: as many as it may differ in and one more."""
    return np.lexsort((w, held[w >> np.uint64(64 - WORD_BITS)]))[:int(len(w) * (1 - similarity) + 1e-9) + 1]


def _count_words(similarity, counts):
    """(text) to (bucket, n): how many texts hold words of each of the ``1 << WORD_BITS`` hash buckets; with ``counts``,
    hold them among their rarest."""
    def run(batches):
        total = np.zeros(1 << WORD_BITS, np.uint32)
        held = counts() if counts else None
        for batch in batches:
            for x in _texts_words(batch.column(0)):
                x = x if held is None else x[_rarest(x, similarity, held)]
                np.add.at(total, x >> np.uint64(64 - WORD_BITS), 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at].astype(np.int64))], names=["bucket", "n"])
        T.release()
    return run


def _rare_words(similarity, counts, met):
    """(tid, text, component) to (word, x, y, side, n, at, tid, bag, component): a text's rarest words that may be (``met``)
    among the rarest of another text; ``at`` is the word's place among the text's words from the rarest. Words of more
    than ``WORD_ROWS`` texts have cells (x, y) of two sides each; ``bag`` counts the text's words by ``BAG`` hash
    classes."""
    def run(batches):
        held, others = counts(), met()
        for batch in batches:
            out = [[] for _ in range(9)]
            ids, comp = _fixed(batch.column(0)), _fixed(batch.column(2))
            for i, w in enumerate(_texts_words(batch.column(1))):
                n = len(w)
                rarest = w[_rarest(w, similarity, held)]
                of = others[rarest >> np.uint64(64 - WORD_BITS)].astype(np.int64)
                at = np.flatnonzero(of > 1)
                word, cells = rarest[at], -(-of[at] // WORD_ROWS)
                bag = np.minimum(np.bincount((w & np.uint64(BAG - 1)).astype(np.int64), minlength=BAG), 255).astype(np.uint8)
                if bag.max(initial=0) == 255:  # no longer a count: let all pairs pass
                    bag[:] = 255
                side = (word ^ ids[i].view(">u8")[0].astype(np.uint64)) % cells.astype(np.uint64)
                r = np.repeat(np.arange(len(at)), cells)
                other = np.arange(len(r)) - np.repeat(np.cumsum(cells) - cells, cells)
                side = side.astype(np.int64)[r]
                for c, v in zip(out, (word[r].view(np.int64), np.minimum(side, other), np.maximum(side, other), side, np.full(len(r), n), at[r],
                                      *[np.broadcast_to(b, (len(r), len(b))) for b in (ids[i], bag, comp[i])])):
                    c.append(v)
                if i + 1 == len(ids) or sum(map(len, out[0])) > 1 << 14:  # rows are wide
                    whole = [np.concatenate(c) for c in out]
                    out = [[] for _ in range(9)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) if c.ndim == 1 else _binary(c) for c in whole],
                                                     names=["word", "x", "y", "side", "n", "at", "tid", "bag", "component"])
        T.release()
    return run


def _fixed(column) -> np.ndarray:
    """The bytes of a binary column whose values are equally long, one row each."""
    buf, off = T.flat(column)
    return buf[off[0]:off[-1]].reshape(len(column), -1) if len(column) else np.zeros((0, 16), np.uint8)


def _binary(rows: np.ndarray) -> pa.Array:
    rows = np.ascontiguousarray(rows)
    off = (np.arange(len(rows) + 1) * rows.shape[1]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(off), pa.py_buffer(rows)])


def _meet(similarity, whole):
    """Rows (word, x, y, side, n, at, tid, bag, component), cell by cell and by length, to pairs (a, b, t, c) of different
    components that can reach the similarity by length, words and bag: text ``t`` and component ``c`` name the pair. All
    of them, or (not ``whole``) one of each text and component in a batch."""
    def pairs(t):
        word, x, y, side, n, at = (t.column(c).to_numpy() for c in range(6))
        tid, bag, comp = (_fixed(t.column(c).combine_chunks()) for c in (6, 7, 8))
        ids, comps = (np.ascontiguousarray(v).view(">u8").astype(np.uint64) for v in (tid, comp))
        fresh = np.concatenate([[True], (word[1:] != word[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
        cell = np.cumsum(fresh) - 1
        need = n - (n * (1 - similarity) + 1e-9).astype(np.int64)  # words in common with a text no longer than this
        r = np.arange(len(n))
        low = np.searchsorted((cell << 32) | n, (cell << 32) | need)
        of, full = r - low, bag.min(axis=1) == 255
        ends = np.cumsum(of)
        start = 0
        while start < len(n):
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + MEETINGS, side="right")))
            q = np.repeat(r[start:stop], of[start:stop])
            p = np.arange(len(q)) - np.repeat(np.cumsum(of[start:stop]) - of[start:stop], of[start:stop]) + low[q]
            ok = (comps[q] != comps[p]).any(axis=1) & (np.minimum(n[p] - at[p], n[q] - at[q]) >= need[q])
            ok &= (x[q] == y[q]) | (side[q] != side[p])
            q, p = q[ok], p[ok]
            common = np.concatenate([np.minimum(bag[q[a:a + 8192]], bag[p[a:a + 8192]]).sum(axis=1, dtype=np.int64)
                                     for a in range(0, len(q), 8192)] or [np.zeros(0, np.int64)])
            ok = full[q] | full[p] | (common >= need[q])
            q, p = q[ok], p[ok]
            second = comps[p] if not whole else ids[p]
            order = np.lexsort((second[:, 1], second[:, 0], ids[q, 1], ids[q, 0]))
            key = np.concatenate([ids[q], second], axis=1)[order]
            one = order[np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1)])] if len(q) else order
            q, p = q[one], p[one]
            less = (ids[q, 0] < ids[p, 0]) | ((ids[q, 0] == ids[p, 0]) & (ids[q, 1] < ids[p, 1]))
            a, b = np.where(less, q, p), np.where(less, p, q)
            yield pa.RecordBatch.from_arrays([_binary(tid[a]), _binary(tid[b]), _binary(tid[q]), _binary(comp[p])], names=["a", "b", "t", "c"])
            start = stop

    def run(batches):
        held = None
        for batch in batches:
            held = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch])
            if held.num_rows < 1 << 15:
                continue
            held = held.combine_chunks()
            last = [held.column(c).to_numpy() for c in range(3)]
            cut = np.flatnonzero(np.any([v != v[-1] for v in last], axis=0))
            if len(cut):  # the last cell may go on
                yield from pairs(held.slice(0, int(cut[-1]) + 1).combine_chunks())
                held = held.slice(int(cut[-1]) + 1)
        if held is not None and held.num_rows:
            yield from pairs(held.combine_chunks())
        held = None
        T.release()
    return run


def _counts(sent):
    return lambda: np.frombuffer(sent.value, np.uint32)


def _text_words(batches):
    """(tid, keys, text) to (tid, keys, words): the hashes of a text's words in order."""
    for batch in batches:
        words = []
        buf, off = T.flat(batch.column(2))
        for a, b in T.chunks(off, CHUNK_BYTES):
            _, _, h, first = T.words(buf[off[a]:off[b]], off[a:b + 1] - off[a], T.ALNUM, fold=True)
            words += [h[first[d]:first[d + 1]].tobytes() for d in range(b - a)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(words, pa.binary())], names=["tid", "keys", "words"])
    T.release()


def _groups(batches):
    """The rows of sorted batches as a table for each value of their first two columns."""
    held = None
    for batch in batches:
        held = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch])
        band, key = held.column(0).to_numpy(), held.column(1).to_numpy()
        cuts = np.flatnonzero((band[1:] != band[:-1]) | (key[1:] != key[:-1])) + 1
        for a, b in zip(np.concatenate([[0], cuts[:-1]]), cuts):
            yield held.slice(int(a), int(b - a)).combine_chunks()
        held = held.slice(int(cuts[-1]) if len(cuts) else 0)  # the last group may go on
    if held is not None and held.num_rows:
        yield held.combine_chunks()


def _within(similarity, whole):
    """Rows (band, key, n, tid, component, keys, words), group by group, to links (a, b, ca, cb) of different components
    ca < cb: pairs whose words align, one of two components in a group. All pairs that can by length, words and bag are
    looked at, or (not ``whole``) each text's most promising one; each in one of the groups it has in common, by its ids."""
    def pairs(t):
        n, m = t.column(2).to_numpy(), t.num_rows
        tid, comp = (_fixed(t.column(c).combine_chunks()) for c in (3, 4))
        part = np.unique(np.ascontiguousarray(comp).view("V16").ravel(), return_inverse=True)[1]  # in their order
        joined = set()
        band, keys = t.column(0)[0].as_py(), t.column(5).combine_chunks().flatten().to_numpy().reshape(m, -1)
        lot = np.ascontiguousarray(tid).view(">u8")[:, 0].astype(np.uint64)
        buf, off = T.flat(t.column(6))
        plain, first = np.frombuffer(buf.tobytes(), np.uint64), off // 8
        w = np.concatenate([_labelled(plain[a:b]) for a, b in zip(first[:-1], first[1:])])
        text = np.repeat(np.arange(m), np.diff(first))
        bag = text * BAG + (w & np.uint64(BAG - 1)).astype(np.int64)
        bag = np.minimum(np.bincount(bag, minlength=m * BAG).reshape(m, BAG), 255).astype(np.uint8)
        full = bag.max(axis=1) == 255  # no longer a count

        def aligned(x, y):
            found = []
            for i, j in zip(x.tolist(), y.tolist()):
                i, j = (i, j) if part[i] < part[j] else (j, i)
                if (part[i], part[j]) not in joined and similar(plain[first[i]:first[i + 1]], plain[first[j]:first[j + 1]], similarity):
                    joined.add((part[i], part[j]))
                    found.append((i, j))
            if found:
                i, j = np.array(found).T
                yield pa.RecordBatch.from_arrays([_binary(v) for v in (tid[i], tid[j], comp[i], comp[j])], names=["a", "b", "ca", "cb"])

        # the words of every text from the rarest of the group, as many as it may differ in and one more
        uniq, inv, count = np.unique(w, return_inverse=True, return_counts=True)
        rarest = np.argsort(count, kind="stable")
        rank = np.empty(len(uniq), np.int64)
        rank[rarest] = np.arange(len(uniq))
        word = np.sort(text * len(uniq) + rank[inv]) - text * len(uniq)
        at = np.arange(len(w)) - first[text]
        keep = np.flatnonzero((at <= (n * (1 - similarity) + 1e-9).astype(np.int64)[text]) & (count[rarest[word]] > 1))
        keep = keep[np.lexsort((part[text[keep]], word[keep]))]
        word, at, text = word[keep], at[keep], text[keep]
        # a row meets the rows of its word whose components come before its own
        low = np.searchsorted(word, word)
        mine = word * m + part[text]
        of = np.searchsorted(mine, mine) - low
        ends = np.cumsum(of)
        best, mate = np.full(m, -1.0), np.zeros(m, np.int64)
        start = 0
        while start < len(of):
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + MEETINGS, side="right")))
            q = np.repeat(np.arange(start, stop), of[start:stop])
            p = np.arange(len(q)) - np.repeat(np.cumsum(of[start:stop]) - of[start:stop], of[start:stop]) + low[q]
            start = stop
            x, y = text[q], text[p]
            longer = np.maximum(n[x], n[y])
            ok = np.minimum(n[x] - at[q], n[y] - at[p]) >= longer - (longer * (1 - similarity) + 1e-9).astype(np.int64)
            one = np.unique(np.minimum(x, y)[ok] * m + np.maximum(x, y)[ok])
            for a in range(0, len(one), 8192):
                x, y = one[a:a + 8192] // m, one[a:a + 8192] % m
                if band >= 0:  # short texts meet by all they have in common
                    shared = keys[x] == keys[y]
                    turn = T.mix(lot[x] ^ lot[y]) % shared.sum(axis=1).astype(np.uint64)
                    here = shared[:, band] & (shared[:, :band].sum(axis=1) == turn)
                    x, y = x[here], y[here]
                longer = np.maximum(n[x], n[y])
                common = np.minimum(bag[x], bag[y]).sum(axis=1, dtype=np.int64)
                ok = full[x] | full[y] | (common >= longer - (longer * (1 - similarity) + 1e-9).astype(np.int64))
                x, y, share = x[ok], y[ok], common[ok] / longer[ok]
                if whole:
                    yield from aligned(x, y)
                for i, j in ((x, y), (y, x)):
                    top = np.lexsort((-share, i))
                    top = top[np.concatenate([[True], i[top][1:] != i[top][:-1]])] if len(top) else top
                    top = top[share[top] > best[i[top]]]
                    best[i[top]], mate[i[top]] = share[top], j[top]
        x = np.flatnonzero(best >= 0)
        if not whole:
            one = np.unique(np.minimum(x, mate[x]) * m + np.maximum(x, mate[x]))
            yield from aligned(one // m, one % m)

    def run(batches):
        for t in _groups(batches):
            yield from pairs(t)
        T.release()
    return run


def _joined(part: DataFrame, pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """components(node, component) joined by the pairs whose texts align."""
    found = links(pairs, texts, similarity, "links")
    if found.isEmpty():
        return part
    return written(components(part.select(F.col("node").alias("a"), F.col("component").alias("b")).union(found)), "parts")


def apart(places: DataFrame, sketched: DataFrame, part: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """components(node, component) joined by the links between the texts of groups of more than ALL_PAIRS texts,
    places(tid, band, key, n), that lie in more than one component: texts with a sketch in common that are similar. Two
    similar texts share one of the rarest words of each, of which as many are taken as they may differ in and one
    more. First each text's most promising pairs are compared, then every pair these links leave apart."""
    key = ["band", "key"]
    rows = places.join(part, places["tid"] == part["node"], "left").withColumn("component", F.coalesce("component", "tid")).drop("node")
    size = rows.groupBy(*key).agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("size"), F.sum("n").alias("words"))
    fits = (F.col("size") <= GROUP_ROWS) & (F.col("words") <= GROUP_WORDS)
    divided = written(size.where("lo <> hi").select(*key, fits.alias("fits")), "divided")
    open_rows = written(places.join(divided, key), "places")
    spark = places.sparkSession
    mine = open_rows.where("fits").select("tid").distinct()
    words = sketched.select("tid", "keys").join(mine, "tid").join(texts.select("tid", "text"), "tid")
    words = written(words.mapInArrow(_text_words, "tid binary, keys array<bigint>, words binary"), "words")
    for whole in (False, True):
        now = words.join(part, words["tid"] == part["node"], "left").select("tid", "keys", "words", F.coalesce("component", "tid").alias("component"))
        met = open_rows.where("fits").select(*key, "n", "tid").join(now, "tid").select(*key, "n", "tid", "component", "keys", "words")
        met = met.repartition(shuffle_partitions(spark), *key).sortWithinPartitions(*key)
        met = met.mapInArrow(_within(similarity, whole), "a binary, b binary, ca binary, cb binary")
        part = _joined(part, met.groupBy("ca", "cb").agg(F.min(F.struct("a", "b")).alias("p")).select("p.a", "p.b"), texts, similarity)
    large = open_rows.where("not fits").select("tid").distinct()
    return part if large.isEmpty() else _by_words(large, sketched, part, texts, similarity)


def _by_words(ids: DataFrame, sketched: DataFrame, part: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """components(node, component) joined by the links between texts ``ids`` that have a sketch in common. First one pair
    of a text and a component is compared, then every pair these links leave apart."""
    mine = sketched.select("tid", F.concat("keys", "short").alias("keys")).join(ids, "tid", "left_semi")
    open_texts = written(texts.select("tid", "text").join(mine, "tid"), "open")
    spark = ids.sparkSession
    sent: list = []
    for _ in range(2):  # texts that hold a word; texts that hold it among their rarest
        counted = open_texts.select("text").mapInArrow(_count_words(similarity, _counts(sent[0]) if sent else None), "bucket bigint, n bigint")
        table = counted.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # at most 1 << WORD_BITS rows
        held = np.zeros(1 << WORD_BITS, np.uint32)
        held[table.column("bucket").to_numpy()] = np.minimum(table.column("n").to_numpy(), 0xFFFFFFFF)
        sent.append(spark.sparkContext.broadcast(held.tobytes()))
    rare = _rare_words(similarity, *map(_counts, sent))
    for whole in (False, True):
        now = open_texts.join(part, open_texts["tid"] == part["node"], "left").select("tid", "text", F.coalesce("component", "tid").alias("component"))
        met = now.mapInArrow(rare, "word bigint, x bigint, y bigint, side bigint, n bigint, at bigint, tid binary, bag binary, component binary")
        met = met.repartition(shuffle_partitions(spark), "word", "x", "y").sortWithinPartitions("word", "x", "y", "n")
        met = met.mapInArrow(_meet(similarity, whole), "a binary, b binary, t binary, c binary")
        pairs = met.select("a", "b").distinct() if whole else met.groupBy("t", "c").agg(F.min(F.struct("a", "b")).alias("p")).select("p.a", "p.b").distinct()
        part = _joined(part, pairs, open_texts, similarity)
    return part


def banded_distance(a: list, b: list, limit: int) -> int:
    """Edit distance of two sequences, or ``limit`` + 1 when it is larger: the cells within ``limit``
    of the diagonal, one bit each, column by column in whole-integer operations."""
    if len(a) < len(b):
        a, b = b, a
    m, n = len(a), len(b)
    if m - n > limit:
        return limit + 1
    if n == 0:
        return m
    limit = min(limit, m)
    width = 2 * limit + 2
    full = (1 << width) - 1
    where: dict = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | (1 << i)
    up, down = full ^ ((1 << (width - limit - 1)) - 1), 0  # vertical steps +1 and -1 of the band
    dist, diagonal, bottom = limit, 1 << (width - 1), 1 << (width - 2)
    stop = limit + n - (m - limit)
    shift = limit + 1 - width
    for j, c in enumerate(b):
        bits = where.get(c, 0)
        bits = (bits << -shift if shift < 0 else bits >> shift) & full
        shift += 1
        zero = ((((bits & up) + up) ^ up) | bits | down) & full  # diagonal steps of 0
        right = (down | ~(zero | up)) & full
        left = zero & up
        if j < m - limit:
            dist += not zero & diagonal
        else:
            dist += bool(right & bottom) - bool(left & bottom)
            bottom >>= 1
        if dist > stop:
            return limit + 1
        half = zero >> 1
        up = (left | ~(half | right)) & full
        down = half & right
    return dist if dist <= limit else limit + 1


def similar(x: np.ndarray, y: np.ndarray, similarity: float = SIMILARITY) -> bool:
    """Is 1 - edit distance / longer length at least ``similarity``? ``x`` and ``y``: word hashes."""
    longer = max(len(x), len(y))
    limit = int(longer * (1 - similarity) + 1e-9)
    if abs(len(x) - len(y)) > limit:
        return False
    n = min(len(x), len(y))
    same = np.flatnonzero(x[:n] != y[:n])
    k = int(same[0]) if len(same) else n
    x, y = x[k:], y[k:]
    n = min(len(x), len(y))
    same = np.flatnonzero(x[::-1][:n] != y[::-1][:n])
    k = int(same[0]) if len(same) else n
    x, y = x[:len(x) - k], y[:len(y) - k]
    if not len(x) or not len(y):
        return max(len(x), len(y)) <= limit
    both, inv = np.unique(np.concatenate([x, y]), return_inverse=True)
    diff = np.bincount(inv[:len(x)], minlength=len(both)) - np.bincount(inv[len(x):], minlength=len(both))
    if max(diff[diff > 0].sum(), -diff[diff < 0].sum()) > limit:  # words of one without a match in the other
        return False
    a, b = inv[:len(x)].tolist(), inv[len(x):].tolist()
    band = min(limit, 32)
    while True:  # a narrow band first
        if banded_distance(a, b, band) <= band:
            return True
        if band == limit:
            return False
        band = min(limit, band * 4)


def _verify(similarity):
    def run(batches):
        for batch in batches:
            keep = []
            sides = []
            for c in (2, 3):
                buf, off = T.flat(batch.column(c))
                _, _, h, first = T.words(buf, off, T.ALNUM, fold=True)
                sides.append((h, first))
            (h, f), (g, e) = sides
            for i in range(batch.num_rows):
                keep.append(similar(h[f[i]:f[i + 1]], g[e[i]:e[i + 1]], similarity))
            part = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["a", "b"])
        T.release()
    return run


def links(pairs: DataFrame, texts: DataFrame, similarity: float, name: str) -> DataFrame:
    """The pairs whose texts align; if the texts have ``keys``, those with a key in common."""
    sides = [texts.select(F.col("tid").alias(c), *[F.col(v).alias(v[0] + c) for v in texts.columns if v != "tid"]) for c in "ab"]
    both = pairs.join(sides[0], "a").join(sides[1], "b")
    if "keys" in texts.columns:
        both = both.where(F.arrays_overlap("ka", "kb"))
    return written(both.select("a", "b", "ta", "tb").mapInArrow(_verify(similarity), "a binary, b binary"), name)


def text_id(text) -> F.Column:
    return F.unhex(F.md5(text.cast("binary")))


def classes(docs: DataFrame, similarity: float = SIMILARITY, n_sketches: int = SKETCHES) -> DataFrame:
    """(tid, class_tid, class_id, class_docs, class_texts) of every distinct text: the class's
    representative text and document (smallest doc_id), and its documents and distinct texts."""
    d = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    d = d.select("doc_id", text_id(F.col("text")).alias("tid"), "text")
    copies = d.groupBy("tid").agg(F.min("doc_id").alias("doc"), F.count("*").alias("docs"))
    sketched = d.select("tid", "text").mapInArrow(
        _sketches(n_sketches, similarity), "tid binary, n bigint, keys array<bigint>, short array<bigint>").dropDuplicates(["tid"])
    sketched = written(sketched, "sketches")
    met = written(candidates(sketched), "pairs")
    pairs = met.where("b is not null")
    places = met.where("b is null").select(F.col("a").alias("tid"), "band", "key", "n")
    ends = pairs.select(F.col("a").alias("tid")).union(pairs.select("b")).distinct()
    texts = written(d.select("tid", "text").join(ends, "tid", "left_semi").dropDuplicates(["tid"]), "texts")
    # first every text against its smallest candidate; then the pairs of small groups that this has not joined already
    small, pairs = pairs.where("not star").select("a", "b"), pairs.select("a", "b")
    both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    first = both.groupBy("a").agg(F.min("b").alias("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    found = links(first, texts, similarity, "links")
    root = (found.union(found.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy("a").agg(F.min("b").alias("r"))
                 .select("a", F.least("a", "r").alias("r")))
    left = (small.join(root.select("a", F.col("r").alias("ra")), "a", "left").join(root.select(F.col("a").alias("b"), F.col("r").alias("rb")), "b", "left")
                 .where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).join(first, ["a", "b"], "left_anti").select("a", "b"))
    part = written(components(found.union(links(left, texts, similarity, "links"))), "parts")
    part = apart(places, sketched, part, texts, similarity)
    t = copies.join(part, copies["tid"] == part["node"], "left").select(
        "tid", "doc", "docs", F.coalesce("component", "tid").alias("class_tid"))
    t = written(t, "texts")
    best = F.min(F.struct(F.col("doc").isNull().alias("no_id"), "doc", "tid"))
    info = t.groupBy("class_tid").agg(best.alias("m"), F.sum("docs").alias("class_docs"), F.count("*").alias("class_texts"))
    info = info.select(F.col("class_tid").alias("_class"), F.col("m.doc").alias("class_id"), F.col("m.tid").alias("rep_tid"), "class_docs", "class_texts")
    return written(t.join(info, t["class_tid"] == info["_class"]).select("tid", "rep_tid", "class_id", "class_docs", "class_texts"), "classes")


def digest(docs: DataFrame, **kw) -> DataFrame:
    """One row per document: doc_id, class_id (the smallest doc_id of its class), class_docs, class_texts."""
    d = pick(docs, "doc_id", "text").select("doc_id", text_id(F.coalesce("text", F.lit(""))).alias("tid"))
    return d.join(classes(docs, **kw), "tid").select("doc_id", "class_id", "class_docs", "class_texts")


def keep_one(docs: DataFrame, **kw) -> DataFrame:
    """The columns of ``docs``, one row of each class: that of the smallest doc_id."""
    names = docs.columns
    kept = classes(docs, **kw).where("tid = rep_tid").select("tid", "class_id")
    flat = docs.toDF(*[f"_c{i}" for i in range(len(names))])
    doc_id, text = F.col(f"_c{names.index('doc_id')}"), F.col(f"_c{names.index('text')}")
    flat = flat.withColumns({"tid": text_id(F.coalesce(text, F.lit(""))), "_doc": doc_id.cast("bigint")})
    rows = flat.join(kept, (flat["tid"] == kept["tid"]) & flat["_doc"].eqNullSafe(kept["class_id"]), "left_semi")
    # rows equal in doc_id and text: one of them
    order = [F.hash(*[F.col(f"_c{i}").cast("string") for i in range(len(names))])]
    rows = rows.withColumn("_n", F.row_number().over(W.partitionBy("tid", "_doc").orderBy(*order))).where("_n = 1")
    return rows.select(*[f"_c{i}" for i in range(len(names))]).toDF(*names)


ship(__name__)
