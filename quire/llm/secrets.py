"""Secret scans over an incremental blob ledger.

Every version of a text is addressed by its content (sha-256). The ledger holds one row for each
(blob, rule version) pair that was scanned, with its findings; a run scans only pairs the ledger has
not seen and joins the findings back to every path that holds the blob.

Spans are found with native functions: ``split`` yields the pieces between the matches and
``regexp_extract_all`` the matches, so running sums of their lengths are the positions. The sums run
over rows, not in arrays, so a text with very many matches costs no more than its matches.

Scale: equal texts are merged before the scan (map-side first); only (blob, path) keys and findings
are joined back. Native DataFrame operations only.

Defined results: a null text is the empty blob; repeated rows are paths of one blob; positions are
code points, end exclusive; a document without matches has counts 0 and empty span lists.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quire.llm.frames import pick, scratch_path, written

#: rule versions: kind -> (order, pattern, group whose length is tested, least length)
RULES = {
    "base-1": {
        "assign": (0, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
        "access": (1, r"AKIA[A-Z0-9]{16,}", 0, 20),  # with its whole run of 20 and more
        "hex": (2, r"[0-9a-f]{24,}", 0, 24),
    },
    "method-1": {
        "pem": (3, r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 1),
        "forge": (4, r"\b(?:gh[pousr]_[A-Za-z0-9]{30,}|xox[abprs]-[A-Za-z0-9-]{10,})", 0, 1),
    },
}
BASE = "base-1"


def versions(docs: DataFrame) -> DataFrame:
    """(path, blob, text): every version under its content address."""
    d = pick(docs, "doc_id", "text").select(F.col("doc_id").alias("path"), F.coalesce("text", F.lit("")).alias("text"))
    return d.select("path", F.sha2(F.col("text").cast("binary"), 256).alias("blob"), "text")


def ledger_schema() -> str:
    return "blob string, rule_version string, spans array<struct<start: bigint, kind_order: int, kind: string, end: bigint>>"


def empty_ledger(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], ledger_schema())


def findings(blobs: DataFrame, rule_version: str) -> DataFrame:
    """(blob, spans) of distinct blobs(blob, text) that hold a match of the rule version."""
    rules = RULES[rule_version]
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(o).alias("kind_order"), F.lit(n).alias("least"),
                               F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias("hits"),
                               (F.regexp_extract_all("text", F.lit(p), F.lit(g)) if g else F.array().cast("array<string>")).alias("groups"),
                               F.lit(p).alias("pattern"))
                      for k, (o, p, g, n) in rules.items()])
    found = blobs.select("blob", "text", F.explode(F.filter(kinds, lambda x: F.size(x["hits"]) > 0)).alias("k"))
    pieces = F.array(*[F.when(F.col("k.kind") == k, F.split("text", p, -1)) for k, (_, p, _, _) in rules.items()])
    found = found.select("blob", "k.kind", "k.kind_order", "k.least", "k.hits", "k.groups",
                         F.filter(pieces, lambda x: x.isNotNull())[0].alias("pieces"))
    rows = found.select("blob", "kind", "kind_order", "least", F.posexplode(F.arrays_zip("hits", "pieces", "groups")).alias("at", "m"))
    rows = rows.where("m.hits is not null").select(
        "blob", "kind", "kind_order", "least", "at", F.length("m.pieces").cast("bigint").alias("gap"),
        F.length("m.hits").cast("bigint").alias("n"), F.length(F.coalesce("m.groups", "m.hits")).alias("tested"))
    w = W.partitionBy("blob", "kind").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.col("n")).over(w)).where("tested >= least")
    span = F.struct((F.col("end") - F.col("n")).alias("start"), "kind_order", "kind", "end")
    return rows.groupBy("blob").agg(F.sort_array(F.collect_list(span)).alias("spans"))  # the spans of one text


def scan(vers: DataFrame, ledger: DataFrame, rule_versions: list[str]) -> DataFrame:
    """New ledger rows: the (blob, rule version) pairs of ``vers`` that ``ledger`` has not seen."""
    blobs = vers.groupBy("blob").agg(F.first("text").alias("text"))  # equal texts: any of them
    out = []
    for v in rule_versions:
        seen = ledger.where(F.col("rule_version") == v).select("blob")
        todo = blobs.join(seen, "blob", "left_anti")
        hits = findings(todo, v)
        out.append(hits.select("blob", F.lit(v).alias("rule_version"), "spans"))
    rows = out[0]
    for x in out[1:]:
        rows = rows.unionByName(x)
    return rows


def update(docs: DataFrame, ledger_path: str, rule_versions: list[str] | None = None) -> DataFrame:
    """Scan what the ledger at ``ledger_path`` has not seen, append it there, and return the ledger.
    Pairs without findings are recorded too, with no spans."""
    spark = docs.sparkSession
    rule_versions = rule_versions or list(RULES)
    vers = versions(docs)
    try:
        ledger = spark.read.schema(ledger_schema()).parquet(ledger_path)
        ledger.head(1)
    except Exception as e:  # only a ledger that does not exist yet counts as empty
        if "PATH_NOT_FOUND" not in str(e):
            raise
        ledger = empty_ledger(spark)
    new = written(scan(vers, ledger, rule_versions), "findings")
    pairs = vers.select("blob").distinct().select("blob", F.explode(F.array(*map(F.lit, rule_versions))).alias("rule_version"))
    pairs = pairs.join(ledger.select("blob", "rule_version"), ["blob", "rule_version"], "left_anti")
    rows = pairs.join(new, ["blob", "rule_version"], "left").select("blob", "rule_version", "spans")
    written_rows = written(rows, "ledger_rows")  # read the old ledger fully before it is appended to
    written_rows.write.mode("append").parquet(ledger_path)
    return spark.read.schema(ledger_schema()).parquet(ledger_path)


def _joined(spans) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(docs: DataFrame, ledger_path: str | None = None) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    spark = docs.sparkSession
    path = ledger_path or scratch_path(spark, "ledger")
    ledger = update(docs, path).where("size(spans) > 0")
    none = F.array().cast("array<struct<start: bigint, kind_order: int, kind: string, end: bigint>>")
    found = ledger.groupBy("blob").agg(
        F.sort_array(F.flatten(F.collect_list("spans"))).alias("spans"),  # one list per rule version
        F.first(F.when(F.col("rule_version") == BASE, F.col("spans")), ignorenulls=True).alias("base"))
    paths = versions(docs).select("path", "blob")
    out = paths.join(found, "blob", "left")
    base, spans = F.coalesce("base", none), F.coalesce("spans", none)
    count = lambda k: F.size(F.filter(base, lambda s: s["kind"] == k)).cast("bigint")
    return out.select(F.col("path").alias("doc_id"), count("assign").alias("n_assign"), count("access").alias("n_access"),
                      count("hex").alias("n_hex"), F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"),
                      _joined(spans).alias("spans"))
