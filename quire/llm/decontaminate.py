"""Benchmark decontamination: which training documents hold word windows of benchmark items.

Method: the benchmark's normalised n-grams form a hash set that is broadcast to every task;
each task slides over the words of its documents, looks every window up, verifies each hit
word by word, and marks the words inside. Documents never move: no shuffle.

The hash set is broadcast only after its size was measured (``max_broadcast_bytes`` of item
text). A larger benchmark is cut into slices by item hash, each within the bound; the documents
are scanned once per slice, and the marks of earlier slices are carried along in a table.

Defined results: a null or empty text has no words and is clean; a null item text has no windows;
an item row with a null item_id is ignored; repeated document rows are judged one by one; repeated
item rows count once; an empty benchmark leaves every document clean.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import textops as T
from quire.llm.frames import pick, written
from quire.llm.shipping import ship

NGRAM = 13
#: a document is contaminated when RATIO * hit words >= words
RATIO = 20
MAX_BROADCAST_BYTES = 16 << 20
BATCH_BYTES = 2 << 20


def build_index(rows: list[tuple[object, str]], ngram: int) -> dict:
    """n-gram index of item texts: per window length a sorted hash array with, for each entry,
    the distinct windows (their exact words) and the items that hold each."""
    by_len: dict[int, dict[int, dict[bytes, set]]] = {}
    texts = [(i, t) for i, t in rows if i is not None and t]
    buf, off = T.flat(pa.array([t for _, t in texts], pa.string()))
    s, e, h, first = T.words(buf, off, T.ALNUM, fold=True)
    low = T.LOWER[buf].tobytes()
    for k, (item, _) in enumerate(texts):
        a, b = int(first[k]), int(first[k + 1])
        n = min(ngram, b - a)
        if not n:
            continue
        hashes = T.windows(h[a:b], n)
        for j, x in enumerate(hashes.tolist()):
            window = b" ".join(low[s[w]:e[w]] for w in range(a + j, a + j + n))
            by_len.setdefault(n, {}).setdefault(x, {}).setdefault(window, set()).add(str(item))
    return {n: (np.array(sorted(d), np.uint64), d) for n, d in by_len.items()}


def scan(buf: np.ndarray, off: np.ndarray, index: dict) -> tuple[np.ndarray, list[set], np.ndarray, np.ndarray, np.ndarray]:
    """(first, items per text, mask of hit words, word starts, word ends) of the texts of a buffer."""
    s, e, h, first = T.words(buf, off, T.ALNUM, fold=True)
    total = len(h)
    hit = np.zeros(total, bool)
    items: list[set] = [set() for _ in range(len(off) - 1)]
    for n, (keys, windows) in index.items():
        if total < n:
            continue
        hashes = T.windows(h, n)
        at = np.searchsorted(keys, hashes)
        at[at == len(keys)] = 0
        found = np.flatnonzero((keys[at] == hashes) & T.inside(first, n))
        good = []
        docs = np.searchsorted(first, found, "right") - 1
        for w, d, x in zip(found.tolist(), docs.tolist(), hashes[found].tolist()):
            exact = b" ".join(T.LOWER[buf[s[i]:e[i]]].tobytes() for i in range(w, w + n))
            held = windows[x].get(exact)
            if held:
                good.append(w)
                items[d] |= held
        if good:
            hit |= T.spread(np.array(good), n, total)
    return first, items, hit, s, e


def _marks(index_of, n_in: int):
    """Rows in: key columns, text, carried spans and items; rows out: the same with this slice's added."""
    def run(batches):
        index = index_of()
        for batch in batches:
            _, off = T.flat(batch.column(n_in - 3))
            for a, b in T.chunks(off, BATCH_BYTES):  # each part leaves before the next is read
                yield marked(batch.slice(a, b - a), index)

    def marked(part, index):
        buf, off = T.flat(part.column(n_in - 3))
        old_spans, old_items = part.column(n_in - 2).to_pylist(), part.column(n_in - 1).to_pylist()
        spans_out, items_out = [], []
        first, items, hit, s, e = scan(buf, off, index)
        for d in range(part.num_rows):
            got = hit[int(first[d]):int(first[d + 1])]
            if got.any():
                step = np.diff(np.concatenate([[0], got.view(np.int8), [0]]))
                spans = np.stack([np.flatnonzero(step == 1), np.flatnonzero(step == -1)], 1).ravel().tolist()
            else:
                spans = []
            spans_out.append(merged((old_spans[d] or []), spans))
            items_out.append(sorted(set(old_items[d] or []) | items[d]))
        cols = [part.column(i) for i in range(n_in - 2)]
        return pa.RecordBatch.from_arrays(
            cols + [pa.array(spans_out, pa.list_(pa.int64())), pa.array(items_out, pa.list_(pa.string())),
                    pa.array(np.diff(first), pa.int64())],
            names=[f"c{i}" for i in range(n_in + 1)])
    return T.lean(run)


def merged(old: list[int], new: list[int]) -> list[int]:
    """Union of two flat [start, end, start, end, ...] span lists."""
    if not old or not new:
        return list(new or old)
    out: list[int] = []
    for s, e in sorted(list(zip(old[::2], old[1::2])) + list(zip(new[::2], new[1::2]))):
        if out and s <= out[-1]:
            out[-1] = max(out[-1], e)
        else:
            out += [s, e]
    return out


def benchmark_slices(benchmark: DataFrame, max_bytes: int) -> list[DataFrame]:
    """The distinct items, cut so that the text of each slice stays within ``max_bytes``."""
    items = pick(benchmark, "item_id", "text").where("item_id is not null and text is not null").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    k = 1
    while k < total:  # a power of two of slices, each measured before it is collected
        cut = items.withColumn("slice", F.pmod(F.xxhash64("item_id", "text"), F.lit(k)))
        most = cut.groupBy("slice").agg(F.sum(F.octet_length("text")).alias("b")).agg(F.max("b")).first()[0]
        if most <= max_bytes or k >= 1 << 20:
            return [cut.where(F.col("slice") == i).select("item_id", "text") for i in range(k)]
        k *= 2
    return [items]


def mark(docs: DataFrame, benchmark: DataFrame, ngram: int = NGRAM,
         max_broadcast_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """``docs`` with three columns appended by position: spans (flat [start, end) word ranges inside
    benchmark windows), items (item ids as sorted strings) and the number of words. Column names are
    ``c0, c1, ...`` for the document columns (clashing names do no harm), then spans, items, n_words;
    the text is moved to the last document place."""
    spark = docs.sparkSession
    names = docs.columns
    at = names.index("text")
    order = [i for i in range(len(names)) if i != at] + [at]
    base = docs.toDF(*[f"c{i}" for i in range(len(names))]).select(*[f"c{i}" for i in order])
    keys = [base.schema[f"c{i}"] for i in order]
    slices = benchmark_slices(benchmark, max_broadcast_bytes)
    out = base.withColumns({"spans": F.array().cast("array<bigint>"), "items": F.array().cast("array<string>")})
    for k, part in enumerate(slices):
        rows = [(r[0], r[1]) for r in part.collect()]  # within max_broadcast_bytes, measured above
        held = spark.sparkContext.broadcast(build_index(rows, ngram))
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keys)
        schema += ", spans array<bigint>, items array<string>, n_words bigint"
        out = (out.drop("n_words") if k else out).mapInArrow(_marks(lambda held=held: held.value, len(names) + 2), schema)
        if k + 1 < len(slices):
            out = written(out, "marks")
    return out


def is_contaminated(spans: F.Column, n_words: F.Column, ratio: int = RATIO) -> F.Column:
    n_hit = hit_words(spans)
    return (n_hit > 0) & (ratio * n_hit >= n_words)


def hit_words(spans: F.Column) -> F.Column:
    """Words inside flat [start, end) spans: ends minus starts."""
    return F.aggregate(F.transform(spans, lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)),
                       F.lit(0).cast("bigint"), lambda a, x: a + x)


def remove_spans(text: str, spans: list[int]) -> str:
    """``text`` without the marked words (the separators stay)."""
    if not spans or not text:
        return text
    raw = text.encode()
    buf, off = T.flat(pa.array([text]))
    s, e, _, _ = T.words(buf, off, T.ALNUM, fold=True)
    out, at = [], 0
    for a, b in zip(spans[::2], spans[1::2]):
        out.append(raw[at:s[a]])
        at = int(e[b - 1])
    return b"".join(out + [raw[at:]]).decode()


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "documents", ngram: int = NGRAM,
                  ratio: int = RATIO, **kw) -> DataFrame:
    """The columns of ``docs`` without benchmark text. mode "documents": contaminated documents go;
    mode "spans": every document stays, without the words inside benchmark windows."""
    names = docs.columns
    at = names.index("text")
    marked = mark(docs, benchmark, ngram, **kw)
    back = [f"c{i}" for i in range(len(names))]
    if mode == "documents":
        out = marked.where(~is_contaminated(F.col("spans"), F.col("n_words"), ratio))
    else:
        cut = F.pandas_udf(lambda t, s: t.combine(s, lambda x, y: remove_spans(x, [] if y is None else list(y))), "string")
        out = marked.withColumn(f"c{at}", F.when(F.size("spans") > 0, cut(F.col(f"c{at}"), F.col("spans"))).otherwise(F.col(f"c{at}")))
    return out.select(*back).toDF(*names)


def digest(docs: DataFrame, benchmark: DataFrame, **kw) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    marked = mark(pick(docs, "doc_id", "text"), benchmark, **kw)
    return marked.select(
        F.col("c0").alias("doc_id"), "n_words", hit_words(F.col("spans")).alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        is_contaminated(F.col("spans"), F.col("n_words")).alias("contaminated"))


ship(__name__)
