"""Token-ID output: tokenised documents in a compressed binary format, and its reader.

Documents are range-partitioned by doc_id and sorted, so the files hold all ids in ascending order of
documents. Each task tokenises its texts, appends the end id to every document, cuts the id stream
into blocks of ``BLOCK_IDS`` and codes them (see :mod:`quire.llm.rangecoder`). A file row holds one block
and the table of the document parts in it; rows are written by Spark, so a lost task's file is never
seen half written and any store that Spark reaches will do.

Reading decodes blocks independently (a document may span several), checks every block's checksum, and
joins the parts of a document: counts add up, and crc32s combine by their lengths.

Words are tokenised once per worker: pre-tokenisation never joins text across ASCII white space, so a
text's ids are the ids of its white-space separated words. Known words are kept in sorted hash arrays
of bounded size.

Defined results: null or empty text is the end id alone; rows with a null doc_id come first; repeated
rows are written once each, in the order of their text hash; an empty table writes no blocks.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quire.llm import packing as K
from quire.llm import rangecoder as R
from quire.llm import textops as T
from quire.llm.frames import pick, scratch_path, shuffle_partitions
from quire.llm.shipping import ship

END = 2
VOCABULARY = "word_bpe_49k.json"
UNIT_BYTES = 10 << 20  # text that is coded together
KNOWN_WORDS = 1_500_000
CALL_WORDS = 4096  # words of one call of the tokenizer, whose results are large objects
SCHEMA = "part bigint, seq bigint, first_id bigint, n_ids bigint, docs binary, block binary"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


class WordIds:
    """ids of words by their hash: a sorted table that grows up to KNOWN_WORDS words."""

    def __init__(self, path: str):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.keys = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.n = np.zeros(0, np.int32)
        self.pool = np.zeros(0, np.int32)

    def ids(self, words: list[str]) -> list[list[int]]:
        return [e.ids for a in range(0, len(words), CALL_WORDS)
                for e in self.tokenizer.encode_batch_fast(words[a:a + CALL_WORDS], add_special_tokens=False)]

    def encode(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts with their end ids, first id per text) of a buffer of texts."""
        s, e, h, first = T.words(buf, off, T.NOT_SPACE)
        uniq, pick_one, inv = np.unique(h, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, uniq)
        at[at == len(self.keys)] = 0
        new = np.flatnonzero(self.keys[at] != uniq) if len(self.keys) else np.arange(len(uniq))
        raw = buf.tobytes()
        new_ids = self.ids([raw[s[k]:e[k]].decode() for k in pick_one[new]]) if len(new) else []
        # table of this unit: known words, then new ones
        n = np.zeros(len(uniq), np.int64)
        where = np.zeros(len(uniq), np.int64)
        if len(self.keys):
            n[:], where[:] = self.n[at], self.at[at]
        fresh_n = np.array([len(x) for x in new_ids], np.int64)
        fresh_at = len(self.pool) + np.cumsum(fresh_n) - fresh_n
        n[new], where[new] = fresh_n, fresh_at
        pool = np.concatenate([self.pool, np.array([i for x in new_ids for i in x], np.int32)])
        if len(self.keys) + len(new) <= KNOWN_WORDS:
            keys = np.concatenate([self.keys, uniq[new]])
            order = np.argsort(keys, kind="stable")
            self.keys = keys[order]
            self.at = np.concatenate([self.at, fresh_at])[order]
            self.n = np.concatenate([self.n, fresh_n.astype(np.int32)])[order]
            self.pool = pool
        # words of all texts, with an end word after each text
        lengths = np.insert(n[inv], first[1:], 1)
        source = np.insert(where[inv], first[1:], len(pool))
        total = np.cumsum(lengths)
        out = np.append(pool, END)[np.repeat(source - (total - lengths), lengths) + np.arange(total[-1] if len(total) else 0)]
        ends = total[first[1:] + np.arange(len(first) - 1)] if len(first) > 1 else np.zeros(0, np.int64)
        return out, np.concatenate([[0], ends]).astype(np.int64)


def _write(path, block_ids):
    def run(batches):
        known = T.worker_store().__dict__.setdefault("words", {})
        if path not in known:
            known[path] = WordIds(path)
        words = known[path]
        part, seq, done, doc_no = TaskContext.get().partitionId(), 0, 0, 0
        for ids, texts in K.units(batches, 1, UNIT_BYTES):
            key = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            null = np.asarray(ids.is_null()).astype(np.uint8)
            buf, off = T.flat(texts)
            parts = [words.encode(buf[off[a]:off[b]], off[a:b + 1] - off[a]) for a, b in T.chunks(off, 4 << 20)]
            stream = np.concatenate([x for x, _ in parts])
            starts = np.concatenate([f[:-1] + d for (_, f), d in zip(parts, np.cumsum([0] + [len(x) for x, _ in parts]))])
            if stream.max() >> 16:
                raise ValueError("the block format holds ids below 65536")
            size = np.diff(np.append(starts, len(stream)))
            cuts = np.arange(0, len(stream), block_ids)
            coded = R.encode([stream[c:c + block_ids] for c in cuts])
            rows = []
            for c, block in zip(cuts.tolist(), coded):
                end = min(c + block_ids, len(stream))
                a = int(np.searchsorted(starts, c, "right")) - 1
                b = int(np.searchsorted(starts, end, "left"))
                d = np.arange(a, b)
                inside = np.maximum(c - starts[d], 0)  # ids of the document in earlier blocks
                here = np.minimum(starts[d] + size[d], end) - np.maximum(starts[d], c)
                rows.append((part, seq, done + c, end - c, K.dump(d + doc_no, key[d], null[d], size[d], inside, here), block))
                seq += 1
            done += len(stream)
            doc_no += len(key)
            for a in range(0, len(rows), 2000):
                cols = list(zip(*rows[a:a + 2000]))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 4 + [pa.binary()] * 2)],
                                                 names=["part", "seq", "first_id", "n_ids", "docs", "block"])
    return T.lean(run, "words")


def write_tokens(docs: DataFrame, path: str, vocabulary: str | None = None, block_ids: int = R.BLOCK_IDS) -> None:
    """Write the token files of ``docs`` to ``path``."""
    d = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = shuffle_partitions(docs.sparkSession)
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    d = d.repartitionByRange(n, *order).sortWithinPartitions(*order)
    d.mapInArrow(_write(vocabulary or vocabulary_path(), block_ids), SCHEMA).write.option("compression", "none").parquet(path)


def _times(a: int, b):
    """Products modulo the crc polynomial, of one factor and an array of others (lowest powers first, as in a crc)."""
    out = np.zeros_like(b)
    for bit in range(31, -1, -1):
        if a >> bit & 1:
            out ^= b
        b = (b >> 1) ^ (b & 1) * 0xEDB88320
    return out


def crc_shift(crc, n):
    """What crc32s of messages contribute once ``n`` bytes follow each: with it,
    crc32(a + b) = crc_shift(crc32(a), len(b)) ^ crc32(b). They are multiplied by x**(8 n) modulo the crc
    polynomial, all together, a power of two of bytes at a time."""
    shape = np.shape(crc)
    out, n = np.array(crc, np.int64, ndmin=1), np.array(n, np.int64, ndmin=1)
    power = 1 << 23  # x**8
    for bit in range(int(n.max(initial=0)).bit_length()):
        i = np.flatnonzero(n >> bit & 1)
        if len(i):
            out[i] = _times(power, out[i])
        power = int(_times(power, np.array([power], np.int64))[0])
    return out.reshape(shape)


def _read(with_ids):
    def run(batches):
        for batch in batches:
            blocks = R.decode(batch.column(3).to_pylist())
            part, first = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out, crcs, after = [], [], []
            for i, (ids, table) in enumerate(zip(blocks, batch.column(2).to_pylist())):
                at = 0
                raw = ids.astype("<u4").tobytes()
                for no, d, z, size, inside, here in zip(*(x.tolist() for x in K.load(table))):
                    crcs.append(zlib.crc32(raw[4 * at:4 * (at + here)]))
                    after.append(4 * (size - inside - here))
                    out.append((part[i], no, None if z else d, first[i] + at, here, ids[at:at + here].tolist() if with_ids else None))
                    at += here
            cols = list(zip(*out)) if out else [[]] * 6
            cols.insert(5, crc_shift(crcs, after))
            kinds = [pa.int64()] * 6 + [pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)],
                                             names=["part", "doc_no", "doc_id", "at", "n", "crc", "ids"])
    return T.lean(run)


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """One row per document of the files: doc_id, start (ids of all documents before it), n_tokens,
    ids_crc32, and with ``with_ids`` the ids."""
    files = spark.read.schema(SCHEMA).parquet(path)
    totals = files.groupBy("part").agg(F.sum("n_ids").alias("n"))  # one row a file
    before = totals.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)),
                                              F.lit(0)).alias("before"))
    parts = files.select("part", "first_id", "docs", "block").mapInArrow(
        _read(with_ids), "part bigint, doc_no bigint, doc_id bigint, at bigint, n bigint, crc bigint, ids array<int>")
    ids = [F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("at", "ids"))), lambda x: x["ids"])).alias("ids")] if with_ids else []
    docs = parts.groupBy("part", "doc_no").agg(F.max("doc_id").alias("doc_id"), F.min("at").alias("at"), F.sum("n").alias("n_tokens"),
                                               F.bit_xor("crc").alias("ids_crc32"), *ids)
    out = docs.join(F.broadcast(before), "part")  # at most one row a shuffle partition
    return out.select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def digest(docs: DataFrame, path: str | None = None, **kw) -> DataFrame:
    """Write the files and read them back: one row per document."""
    spark = docs.sparkSession
    path = path or scratch_path(spark, "tokens")
    write_tokens(docs, path, **kw)
    return read_tokens(spark, path)


ship(__name__)
