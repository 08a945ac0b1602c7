"""Document fingerprints (SimHash) and search within a Hamming radius.

Terms are pairs of neighbouring words (a text of one word: that word), weighted by how often they
occur. Every term hash votes on each of 64 signed bits; a bit of the fingerprint is set when the votes
for it are in the majority. Votes are counted in packed counters, within the row: eight longs hold eight
8-bit counters each, over runs of at most 127 terms, and the runs' counters add up.

Search: fingerprints at a Hamming distance of at most ``radius`` agree on all but ``radius`` of the
``blocks`` blocks; a table is kept for every choice of ``blocks - radius`` blocks (the permuted block
tables), rows join on the chosen blocks, and each candidate's distance is verified. Equal fingerprints
are merged first, so copies are one row.

Native DataFrame operations only. Defined results: a null or empty text (or one of white space only)
has no terms and the fingerprint 0; repeated rows get one row each; rows with a null doc_id come first
in the order of ids; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.frames import ordered, pick, written

WORD_GAP = r"[\x20\x09-\x0D]+"
LANES = 8
#: a packed counter holds 7 bits (the sign of a long stays clear): terms are summed in runs of this many
RUN = 127
MASK = 0x0101010101010101
RADIUS, BLOCKS = 3, 6
QUERY_EVERY = 100


def let(x, fn) -> F.Column:
    """``fn`` of ``x`` with ``x`` evaluated once a row (a plain column could be inlined many times)."""
    return F.transform(F.array(x), fn)[0]


def term_hashes(text) -> F.Column:
    """64-bit hashes of the pairs of neighbouring words, in text order."""
    def pairs(h):
        n = F.size(h)
        return F.when(n < 2, h).otherwise(F.zip_with(
            F.slice(h, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(h, F.lit(2), F.greatest(n - 1, F.lit(0))),
            lambda a, b: F.xxhash64(a, b)))
    return let(F.transform(F.filter(F.split(text, WORD_GAP), lambda w: w != ""), lambda w: F.xxhash64(w)), pairs)


def fingerprint(text) -> F.Column:
    """The 64-bit SimHash of a text."""
    def packed(h):  # per run of terms: eight longs of eight counters
        runs = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(h) / RUN) - 1, F.lit(0)).cast("int"))
        lanes = F.sequence(F.lit(0), F.lit(LANES - 1))
        return F.transform(runs, lambda r: let(F.slice(h, r * RUN + 1, F.lit(RUN)), lambda part: F.transform(
            lanes, lambda j: F.aggregate(part, F.lit(0).cast("bigint"), lambda acc, x: acc + F.call_function(
                "shiftrightunsigned", x, j).bitwiseAND(F.lit(MASK))))))

    def bits(h):
        def majority(lanes):
            def vote(i):  # bit i sits in long i % 8, counter i div 8
                n = F.aggregate(lanes, F.lit(0).cast("bigint"), lambda acc, run: acc + F.call_function(
                    "shiftrightunsigned", F.element_at(run, i % LANES + 1), F.lit(8) * F.floor(i / LANES).cast("int")).bitwiseAND(F.lit(0xFF)))
                return F.when(2 * n > F.size(h), F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint"))
            return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("bigint"), lambda acc, i: acc.bitwiseOR(vote(i)))
        return let(packed(h), majority)
    return let(term_hashes(text), bits)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def likeness(a, b) -> F.Column:
    """Share of equal bits."""
    return 1.0 - F.bit_count(a.bitwiseXOR(b)) / 64.0


def block_tables(prints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """Rows of all permuted block tables: (table, block_key, then the columns of ``prints``)."""
    width = -(-64 // blocks)
    keys = []
    for t, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        mask = 0
        for b in chosen:
            mask |= ((1 << width) - 1) << (b * width)
        mask &= (1 << 64) - 1
        keys.append(F.struct(F.lit(t).alias("table"), F.col("fingerprint").bitwiseAND(F.lit(_signed(mask))).alias("block_key")))
    return prints.select(F.explode(F.array(*keys)).alias("k"), *prints.columns).select("k.table", "k.block_key", *prints.columns)


def within(queries: DataFrame, prints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(query, fingerprint, distance): all fingerprints of ``prints`` within ``radius`` bits of each
    distinct fingerprint of ``queries``, exactly."""
    q = block_tables(queries.select("fingerprint").distinct(), radius, blocks).withColumnRenamed("fingerprint", "query")
    p = block_tables(prints.select("fingerprint").distinct(), radius, blocks)
    d = F.bit_count(F.col("query").bitwiseXOR(F.col("fingerprint")))
    return (q.join(p, ["table", "block_key"]).select("query", "fingerprint", d.alias("distance"))
             .where(F.col("distance") <= radius).distinct())


def edited_texts(docs: DataFrame) -> DataFrame:
    """(_index, _next, doc_id, n, text, edited): the last half of every text replaced by the start of
    the next document's text (ascending doc_id, then text hash; after the last the first). Rows equal
    in doc_id and text are one document and get the same values."""
    d = pick(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    known = F.col("doc_id").isNotNull()
    d = d.select(known.alias("_known"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63))).alias("_id"),
                 F.xxhash64("text", ~known).alias("_row"), "text")
    ids = d.select("_known", "_id", F.xxhash64("text").alias("_text"), "_row", F.length("text").cast("bigint").alias("n")).distinct()
    ids = ordered(ids, ["_known", "_id", "_text"], "order").select("_known", "_id", "_row", "n", "_index")
    ids = written(ids, "ids")
    total = max(ids.count(), 1)
    # for every document: how much of its text the document before it needs, and which that is
    before = ids.select(((F.col("_index") + 1) % total).alias("_index"), F.floor(F.col("n") / 2).alias("_need"),
                        F.col("_id").alias("_before_id"), F.col("_row").alias("_before_row"))
    ids = written(ids.join(before, "_index"), "needs")
    # texts are shuffled once, by their key (both readers below take the same three columns, so they share
    # the exchange); the heads then travel to the same partitions
    d = d.select("_id", "_row", "text").join(ids, ["_id", "_row"]).select(
        "_id", "_row", "_index", F.when(F.col("_known"), F.col("_id")).alias("doc_id"), "text", "n", "_before_id", "_before_row",
        F.expr("substr(text, 1, cast(_need as int))").alias("_head"))
    heads = d.groupBy(F.col("_before_id").alias("_id"), F.col("_before_row").alias("_row")).agg(F.max("_head").alias("_head"))  # repeated rows: one
    d = d.select("_id", "_row", "_index", "doc_id", "text", "n").join(heads, ["_id", "_row"])
    return d.select("_index", ((F.col("_index") + 1) % total).alias("_next"), "doc_id", "n", "text",
                    F.expr("concat(substr(text, 1, cast(n - floor(n / 2) as int)), _head)").alias("edited"))


def digest(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next; and for the query documents (id divisible by 100) n_within, the number of documents
    within the Hamming radius (itself included), else null."""
    e = edited_texts(docs)
    t = written(e.select("_index", "_next", "doc_id", F.col("n").alias("n_chars"),
                         F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
                         fingerprint(F.col("text")).alias("fp"), fingerprint(F.col("edited")).alias("efp")), "prints")
    nxt = t.select(F.col("_index").alias("_next"), F.col("fp").alias("next_fp")).distinct()
    copies = t.groupBy(F.col("fp").alias("fingerprint")).agg(F.count("*").alias("docs"))
    found = within(t.where(F.col("doc_id") % QUERY_EVERY == 0).select(F.col("fp").alias("fingerprint")), copies)
    near = (found.join(copies, "fingerprint").groupBy(F.col("query").alias("fp")).agg(F.sum("docs").alias("n_near")))
    hexed = lambda c: F.lower(F.lpad(F.hex(c), 16, "0"))
    out = t.join(nxt, "_next").join(near, "fp", "left")
    return out.select("doc_id", "n_chars", "edited_sha256", hexed("fp").alias("fingerprint"), hexed("efp").alias("edited_fingerprint"),
                      likeness(F.col("fp"), F.col("efp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
                      F.when(F.col("doc_id") % QUERY_EVERY == 0, F.col("n_near")).alias("n_within"))
