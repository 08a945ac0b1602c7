"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target number of words. The whole part of target / source size is allotted as certain
copies of each document. For the words left, every document has an inclusion probability of its own: it is in
proportion to the binary length of its size (longer texts are likelier), at most 1, and such that the
expected words are the words left. Documents are ranked by the odds of a random number divided by the odds of their
inclusion probability; the lowest ranked, whose words fill the rest of the target, are taken once more: a
fixed-size sample (counted in words) with unequal probabilities.

Scale: only (source, size class) and (source, rank bucket) sums are gathered; the cut inside the one bucket that
straddles a target is found on that bucket's rows, equal ones combined. Documents are compared with their source's
cut, so texts are never shuffled. Native DataFrame operations only.

Defined results: a null text has size 0 and is never copied by sampling (certain copies apply but
hold no words); null sources form one source, last in order; random numbers come from the id, size
and a seed, so reruns agree. Rows equal in id, size and source have one rank; where they lie at the cut, as many of them
are taken as the target asks for (:func:`mix`: in the order of a hash of the whole row). An empty table
gives an empty result; a source without words has target 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quire.llm.frames import ordered, pick, written

WORD = r"[^\x20\x09-\x0D]+"
CAP = 3
CYCLE = 3
SEED = "mix-1"
BUCKETS = 1 << 16
U_BITS = 60


def n_words(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def random_bits(doc_id, size, seed: str = SEED) -> F.Column:
    """60 random bits from the md5 of seed, id and size."""
    key = F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), size.cast("string"))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("bigint")


def pareto_rank(u, p) -> F.Column:
    """Odds of the random number over odds of the inclusion probability (null when nothing is to be
    drawn, 0 when everything is)."""
    x = (F.shiftright(u, U_BITS - 52).cast("double") + 0.5) / float(1 << 52)  # strictly between 0 and 1
    return F.when(p >= 1, F.lit(0.0)).when(p > 0, (x / (1 - x)) / (p / (1 - p)))


def source_targets(sized: DataFrame, cap: int = CAP, cycle: int = CYCLE) -> DataFrame:
    """(source, source_size, target): sources in code point order, null last, weigh 1, 2, .., cycle,
    repeating; targets share all words by weight, stop at ``cap`` times the source, and the excess is
    shared again by weight until no target is above. Only two sums come to the driver per round."""
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    t = ordered(sums, [F.col("source").asc_nulls_last()], "sources").withColumn("weight", F.col("_index") % cycle + 1)
    total, weight = t.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    level, capped = (total / weight if weight else 0.0), None
    while True:
        over = F.lit(level) * F.col("weight") > cap * F.col("source_size")
        n, fixed, free = t.agg(F.count_if(over), F.coalesce(F.sum(F.when(over, cap * F.col("source_size"))), F.lit(0)),
                               F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0))).first()
        if n == capped or not free:
            break
        capped, level = n, (total - fixed) / free
    target = F.when(F.lit(level) * F.col("weight") > cap * F.col("source_size"), (cap * F.col("source_size")).cast("double"))
    return t.select("source", "source_size", target.otherwise(F.lit(level) * F.col("weight")).alias("target"))


def size_class(size) -> F.Column:
    """Binary length of a size: the weight of its documents' inclusion probabilities."""
    return F.length(F.bin(size))


def inclusion(sized: DataFrame, t: DataFrame) -> DataFrame:
    """``t`` (one row a source, with ``rest``) and ``c``: a document of size class w has p = least(1, c * w). Classes whose p
    would be above 1 are filled first, from the largest; at most 63 classes a source."""
    sums = sized.where("size > 0").groupBy("source", size_class("size").alias("w")).agg(F.sum("size").alias("words"))
    s = sums.join(t.select(F.col("source").alias("_src"), "rest"), sums["source"].eqNullSafe(F.col("_src"))).drop("_src")
    w = W.partitionBy("source").orderBy(F.desc("w"))
    full = F.coalesce(F.sum("words").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    open_ = F.sum(F.col("w") * F.col("words")).over(w.rowsBetween(0, W.unboundedFollowing))
    c = s.select("source", "w", (F.greatest(F.col("rest") - full, F.lit(0.0)) / open_).alias("c"))
    c = c.where(F.col("c") * F.col("w") <= 1).groupBy("source").agg(F.max_by("c", "w").alias("c"))
    return t.join(c, t["source"].eqNullSafe(c["source"]), "left").select(t["*"], F.coalesce("c", F.lit(0.0)).alias("c"))


def cuts(sized: DataFrame, cap: int = CAP) -> DataFrame:
    """Per source: source_size, target, whole copies, c (see :func:`inclusion`), and the cut: the last (rank, u, doc_id, size)
    that gets one more copy, in ``cut_bucket``, and how many of the rows equal to it do (``some`` of ``equal``)."""
    t = source_targets(sized, cap)
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(cap))).otherwise(F.lit(0))
    t = t.withColumn("whole", whole.cast("bigint"))
    t = t.withColumn("rest", F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0)))
    t = written(inclusion(sized, t), "targets")
    s = ranked(sized.where("size > 0"), t)
    sums = s.groupBy("source", "bucket").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    w = W.partitionBy("source").orderBy("bucket")  # at most BUCKETS rows a source
    upto = sums.withColumn("upto", F.sum("words").over(w.rowsBetween(W.unboundedPreceding, 0)))
    edge = (upto.where("upto > rest").groupBy("source")
                .agg(F.min(F.struct("bucket", F.col("upto").alias("upto"), F.col("words").alias("words"))).alias("e"))
                .select("source", F.col("e.bucket").alias("cut_bucket"), (F.col("e.upto") - F.col("e.words")).alias("before")))
    edge = written(edge, "edges")
    at = s.join(edge, s["source"].eqNullSafe(edge["source"]) & (s["bucket"] == edge["cut_bucket"])).select(
        s["source"], "rank", "u", s["doc_id"], "size", "rest", "before")
    at = at.groupBy("source", "rank", "u", "doc_id", "size").agg(  # equal rows are one
        F.count("*").alias("equal"), F.first("rest").alias("rest"), F.first("before").alias("before"))
    w = W.partitionBy("source").orderBy("rank", "u", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    cum = F.col("before") + F.coalesce(F.sum(F.col("size") * F.col("equal")).over(w), F.lit(0))
    # the i-th of them is taken while 2 * (cum + (i - 1) * size) + size <= 2 * rest
    room = F.floor(2 * F.col("rest")) - 2 * cum - F.col("size")
    at = at.withColumn("some", F.when(room >= 0, F.least("equal", F.floor(room / (2 * F.col("size"))) + 1)).otherwise(F.lit(0)).cast("bigint"))
    last = (at.where("some > 0").groupBy("source")
              .agg(F.max(F.struct("rank", "u", "doc_id", "size", "some", "equal")).alias("cut")))
    out = t.join(edge, t["source"].eqNullSafe(edge["source"]), "left").select(t["*"], "cut_bucket")
    out = out.join(last, out["source"].eqNullSafe(last["source"]), "left").select(
        out["*"], F.when(F.col("cut").isNotNull(), F.struct(*[F.col(f"cut.{c}").alias(c) for c in KEY])).alias("cut"),
        F.col("cut.some").alias("some"), F.col("cut.equal").alias("equal"))
    return written(out, "cuts")


KEY = ["rank", "u", "doc_id", "size"]


def ranked(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """``sized`` with its source's figures, inclusion probability, rank and rank bucket. The targets are a small written
    table (one row a source); the planner broadcasts it only below its size threshold."""
    names = [c for c in targets.columns if c != "source"]
    s = sized.join(targets, sized["source"].eqNullSafe(targets["source"]), "left").select(sized["*"], *[targets[c] for c in names])
    s = s.withColumn("p", F.when(F.col("size") > 0, F.least(F.lit(1.0), F.col("c") * size_class("size"))).otherwise(F.lit(0.0)))
    s = s.withColumn("rank", pareto_rank(F.col("u"), F.col("p")))
    share = F.col("rank") / (1 + F.col("rank"))
    return s.withColumn("bucket", F.when(F.col("p") > 0, F.floor(share * BUCKETS)).otherwise(F.lit(BUCKETS)).cast("bigint"))


def divided() -> F.Column:
    """Is this row one of several equal ones of which the cut takes some and leaves some?"""
    return F.coalesce((F.col("some") < F.col("equal")) & (F.col("bucket") == F.col("cut_bucket")) & (F.col("size") > 0)
                      & F.struct(*KEY).eqNullSafe(F.col("cut")), F.lit(False))


def copies() -> F.Column:
    """Copies of a ranked row that is not :func:`divided`: the certain ones, and one more up to the cut."""
    more = (F.col("size") > 0) & (F.col("p") > 0) & (
        F.col("cut_bucket").isNull() | (F.col("bucket") < F.col("cut_bucket"))
        | ((F.col("bucket") == F.col("cut_bucket")) & F.coalesce(F.struct(*KEY) <= F.col("cut"), F.lit(False))))
    return F.col("whole") + more.cast("bigint")


def sizes(docs: DataFrame) -> DataFrame:
    d = pick(docs, "doc_id", "source", "text").select("doc_id", "source", n_words(F.col("text")).alias("size"))
    return d.withColumn("u", random_bits(F.col("doc_id"), F.col("size")))


def digest(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken."""
    sized = written(sizes(docs), "sizes")
    r = ranked(sized, cuts(sized))
    out = r.where(~divided()).select("doc_id", "size", "source_size", "target", (copies() * F.col("size")).alias("taken"))
    equal = r.where(divided()).groupBy("source", "doc_id", "size", "source_size", "target", "whole", "some").agg(F.count("*").alias("n"))
    equal = equal.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n"))))
    return out.unionByName(equal.select("doc_id", "size", "source_size", "target", (
        (F.col("whole") + (F.col("i") <= F.col("some")).cast("bigint")) * F.col("size")).alias("taken")))


def mix(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, each as many times as the mix takes it (documents without words: their
    certain copies)."""
    names = docs.columns
    own = [f"_c{i}" for i in range(len(names))]
    at = {n: names.index(n) for n in ("doc_id", "source", "text")}
    cut = cuts(written(sizes(docs), "sizes"))
    flat = docs.toDF(*own)
    flat = flat.withColumns({"doc_id": F.col(f"_c{at['doc_id']}"), "source": F.col(f"_c{at['source']}"),
                             "size": n_words(F.col(f"_c{at['text']}"))})
    flat = ranked(flat.withColumn("u", random_bits(F.col("doc_id"), F.col("size"))), cut)
    rows = flat.where(~divided()).select(*own, copies().alias("_n"))
    # equal rows at a cut: variants (rows equal in all columns) in the order of their hash, each as often as it is there
    hashed = [F.to_json(F.struct(c)) if "map<" in t else F.col(c) for c, t in flat.select(*own).dtypes]
    tied = flat.where(divided()).groupBy("source", F.xxhash64(*hashed).alias("v")).agg(
        F.count("*").alias("n"), F.first(F.struct(*own)).alias("row"), F.first("whole").alias("whole"), F.first("some").alias("some"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("source").orderBy("v").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    tied = tied.withColumn("more", F.greatest(F.lit(0), F.least(F.col("n"), F.col("some") - before)))
    tied = tied.select("row.*", (F.col("whole") * F.col("n") + F.col("more")).alias("_n"))
    rows = rows.unionByName(tied)
    rows = rows.where("_n > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_n"))))
    return rows.select(*own).toDF(*names)
