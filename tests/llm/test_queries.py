"""Every query against its SQL or a brute-force version, on the smallest test tables and on edge rows."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quire.llm import bytespans, fingerprints, neardup, queries, substrings, tokens, toxicity
from quire.llm import textops as T
from tools.oracle_check import compare, duck

SF = "/root/testdata/sf0.001"


def docs_of(spark, d):
    return [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]


def order(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("where", ["sf", "edge", "empty"])
@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_sql(spark, edge_dir, empty_dir, name, where):
    d = {"sf": SF, "edge": edge_dir, "empty": empty_dir}[where]
    _, status, *_ = compare(spark, duck(d), name, queries.QUERIES[name], queries.ORACLE[name], d)
    assert status == "ok"


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_clashing_columns(spark, edge_dir, name):
    """Extra columns that repeat a name or differ only in case change nothing."""
    docs = spark.read.parquet(f"{edge_dir}/documents.parquet")
    clash = docs.toDF("doc_id", "text", "lang", "source", "TEXT", "Doc_Id", "score", "text")
    bench, labels, pages = (spark.read.parquet(f"{edge_dir}/{t}.parquet") for t in ("benchmark", "labels", "pages"))
    run = {
        "op1_decontaminate": lambda d: queries.decontaminate.digest(d, bench), "op2_substring_dedup": substrings.digest,
        "op3_suffix_array_dedup": bytespans.digest, "op4_order_minhash": neardup.digest, "op5_token_files": tokens.digest,
        "op7_secret_scan": queries.secrets.digest, "op8_mix_sources": queries.mixing.digest, "op9_fingerprints": fingerprints.digest,
        "op10_toxicity": lambda d: toxicity.digest(d, labels)}
    run |= {"op11_exact_dedup": queries.digestindex.digest, "op12_periodic_runs": lambda d: queries.periods.digest(queries.with_tails(d))}
    if name == "op13_vector_codes":
        vec = spark.read.parquet(f"{edge_dir}/embeddings.parquet")
        a, b = queries.lloyd.digest(vec.toDF("vec_id", "embedding", "label", "VEC_ID", "label")), queries.lloyd.digest(vec)
    elif name == "op6_url_filter":
        a, b = queries.urlfilter.digest(pages.toDF("page_id", "url", "html", "URL")), queries.urlfilter.digest(pages)
    else:
        a, b = run[name](clash), run[name](docs)
    assert order(map(tuple, a.collect())) == order(map(tuple, b.collect()))


def brute_bytes(rows, length=400):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(b[i:i + length] for b in texts for i in range(len(b) - length + 1))
    out = []
    for (d, _), b in zip(rows, texts):
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return order(out)


@pytest.mark.parametrize("kw", [{}, {"hot": 1}, {"group_bytes": 20_000, "bucket_bytes": 50_000, "hot": 3}])
@pytest.mark.parametrize("where", ["sf", "edge"])
def test_bytes(spark, edge_dir, where, kw):
    d = SF if where == "sf" else edge_dir
    got = bytespans.digest(spark.read.parquet(f"{d}/documents.parquet"), **kw).collect()
    assert order(map(tuple, got)) == brute_bytes(docs_of(spark, d))


def test_bytes_short_alphabet(spark):
    """Runs, periods and windows at text ends; strings that overlap themselves."""
    rng = np.random.default_rng(5)
    rows = [(i, "".join(rng.choice(list("ab"), rng.integers(0, 60)))) for i in range(60)] + [(100, "a" * 70), (101, "ab" * 30)]
    got = bytespans.dedup(spark.createDataFrame(rows, "doc_id long, text string"), length=12, gram=4, want_text=True)
    assert order((r[0], r[1], r[2], r[3], r[4]) for r in got.collect()) == brute_bytes(rows, 12)


@pytest.mark.parametrize("limit", [500, 100_000])
def test_words_any_grouping(spark, edge_dir, limit):
    """The result does not depend on how suffixes are grouped; kept text matches its digest."""
    got = substrings.dedup(spark.read.parquet(f"{edge_dir}/documents.parquet"), group_suffixes=limit, bucket_bytes=50_000).collect()
    want = queries.QUERIES["op2_substring_dedup"](spark, edge_dir).collect()
    assert order((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == order(map(tuple, want))
    assert all(hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256 for r in got)


def test_prefix_groups():
    counts = np.zeros(1 << 12, np.int64)
    counts[:64] = 10
    counts[100] = 1000
    counts[200:300] = 1
    first, parts, n = substrings.plan_groups(counts, 2, 100)
    load = Counter()
    for c in np.flatnonzero(counts):
        for k in range(parts[c]):
            load[first[c] + k] += counts[c] / parts[c]
    assert max(load.values()) <= 100 and max(load) < n and parts[100] == 10


def classes(rows):
    """Brute force: all pairs aligned in full, components."""
    buf, off = T.flat(pa.array([t or "" for _, t in rows]))
    _, _, h, first = T.words(buf, off, T.ALNUM, fold=True)
    words = [h[first[i]:first[i + 1]].tolist() for i in range(len(rows))]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def distance(a, b):
        p = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            c = [i]
            for j, y in enumerate(b, 1):
                c.append(min(p[j] + 1, c[-1] + 1, p[j - 1] + (x != y)))
            p = c
        return p[-1]

    for i in range(len(rows)):
        for j in range(i):
            a, b = words[i], words[j]
            longer = max(len(a), len(b))
            if (rows[i][1] or "") == (rows[j][1] or "") or (a and b and min(len(a), len(b)) >= 0.8 * longer
                    and len((Counter(a) & Counter(b))) >= 0.3 * len(set(a)) and 1 - distance(a, b) / longer >= 0.8 - 1e-12):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(root(i), []).append(i)
    out = []
    for g in groups.values():
        ids = [rows[i][0] for i in g]
        out += [(d, min((x for x in ids if x is not None), default=None), len(g), len({rows[i][1] or "" for i in g})) for d in ids]
    return order(out)


@pytest.mark.parametrize("where", ["sf", "edge"])
def test_near_duplicates(spark, edge_dir, where):
    d = SF if where == "sf" else edge_dir
    got = queries.QUERIES["op4_order_minhash"](spark, d).collect()
    rows = docs_of(spark, d)
    rows = [(i, t) for i, t in rows]
    assert order(map(tuple, got)) == classes(rows)


def test_near_duplicates_large_group(spark):
    """More near copies than are compared pairwise, next to texts that only share a passage."""
    rng = np.random.default_rng(2)
    base, passage = [f"w{i}" for i in range(120)], " ".join(f"p{i}" for i in range(30))
    rows = [(i, " ".join("zz%d" % i if j == k else w for j, w in enumerate(base))) for i, k in enumerate(rng.integers(0, 120, 60))]
    rows += [(100 + i, passage + " " + " ".join(f"u{i}_{j}" for j in range(60))) for i in range(60)]
    got = neardup.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in got} == {d: 0 if d < 100 else d for d, _ in rows}


def test_unit_repeats_spread_over_groups(spark):
    """Windows repeated inside a unit go to all groups, though every task's first unit has number 0."""
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(i, i, f"{passage} a{i} {passage}") for i in range(128)]
    rows += [(1000 + i, i, f"{passage} b{i}") for i in range(128)]
    plan = np.zeros(1 << 12, np.int64), np.ones(1 << 12, np.int64), 64
    d = spark.createDataFrame(spark.sparkContext.parallelize(sorted(rows, key=lambda r: r[0] % 1000), 64), "doc_id long, row32 long, text string")
    out = d.mapInArrow(substrings._suffixes(13, 2, False, lambda: plan), "group bigint, kind int, blob binary").where("kind = 2")
    held = Counter(r.group for r in out.select("group").collect())
    assert sum(held.values()) == 64 and len(held) > 24 and max(held.values()) <= 8


def test_near_duplicates_short(spark):
    """Short texts a middle word apart (similarity 0.8 or 0.9) meet, though they share hardly a shingle."""
    rows = []
    for n, k in ((5, 2), (9, 4), (10, 5), (14, 7)):
        for i in range(12):
            w = [f"q{n}x{i}y{j}" for j in range(n)]
            rows += [(len(rows), " ".join(w)), (len(rows) + 1, " ".join(w[:k] + ["other"] + w[k + 1:]))]
    got = {r.doc_id: r.class_id for r in neardup.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: d - d % 2 for d, _ in rows}


def test_near_duplicates_star(spark):
    """A large group that holds together through one text: copies of a base that are mostly no links of each other."""
    rng = np.random.default_rng(5)
    base, rows = [f"w{i}" for i in range(100)], []
    for i in range(800):
        w = list(base)
        for j in rng.choice(100, 17, replace=False):
            w[j] = f"x{i}y{j}"
        rows.append((i + 1, " ".join(w)))
    rows.append((0, " ".join(base)))
    got = {r.doc_id: r.class_id for r in neardup.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    # links of the candidates, by brute force
    key = {}
    for d, t in rows:
        _, _, h, _ = T.words(*T.flat(pa.array([t])), T.ALNUM, fold=True)
        key[d] = (h, neardup.sketch(h, neardup.seeds(neardup.SKETCHES)))
    sketches = np.stack([key[d][1] for d, _ in rows])
    up = {d: d for d in key}

    def root(d):
        while up[d] != d:
            d = up[d]
        return d

    for i, (d, _) in enumerate(rows):
        for j in np.flatnonzero((sketches[:i] == sketches[i]).any(1)):
            a, b = root(d), root(rows[j][0])
            if a != b and neardup.similar(key[d][0], key[rows[j][0]][0]):
                up[max(a, b)] = min(a, b)
    assert got == {d: root(d) for d in key}
    assert sum(c == 0 for c in got.values()) > 760


def test_keep_one(spark, edge_dir):
    docs = spark.read.parquet(f"{edge_dir}/documents.parquet")
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns
    want = {(r.class_id) for r in neardup.digest(docs).collect()}
    assert sorted(map(repr, (r.doc_id for r in kept.collect()))) == sorted(map(repr, want))


@pytest.mark.parametrize("where", ["sf", "edge"])
def test_tokens(spark, edge_dir, tmp_path, where):
    from tokenizers import Tokenizer
    d = SF if where == "sf" else edge_dir
    docs = spark.read.parquet(f"{d}/documents.parquet")
    path = str(tmp_path / "t")
    tokens.write_tokens(docs, path, block_ids=256)
    got = tokens.read_tokens(spark, path, with_ids=True).collect()
    full = Tokenizer.from_file(tokens.vocabulary_path())
    rows = docs_of(spark, d)
    texts = {}
    for i, t in rows:
        texts.setdefault(i, []).append(full.encode(t or "", add_special_tokens=False).ids + [tokens.END])
    assert len(got) == len(rows)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at and r.ids in texts[r.doc_id]
        assert r.n_tokens == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += r.n_tokens
    ids = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0))


def test_tokens_empty(spark, empty_dir):
    assert queries.QUERIES["op5_token_files"](spark, empty_dir).count() == 0


def fingerprint(text):
    import xxhash
    h = [xxhash.xxh64_intdigest(w.encode(), seed=42) for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    if len(h) > 1:
        h = [xxhash.xxh64_intdigest(b.to_bytes(8, "little"), seed=xxhash.xxh64_intdigest(a.to_bytes(8, "little"), seed=42)) for a, b in zip(h, h[1:])]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


@pytest.mark.parametrize("where", ["sf", "edge"])
def test_fingerprints(spark, edge_dir, where):
    d = SF if where == "sf" else edge_dir
    got = queries.QUERIES["op9_fingerprints"](spark, d).collect()
    rows = docs_of(spark, d)
    assert len(got) == len(rows)
    import xxhash
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    seq = sorted({(i, t or "") for i, t in rows}, key=lambda r: (r[0] is not None, r[0] or 0, signed(xxhash.xxh64_intdigest(r[1].encode(), seed=42))))
    nxt = {r: seq[(k + 1) % len(seq)][1] for k, r in enumerate(seq)}
    prints = {t: fingerprint(t) for _, t in seq}
    alike = lambda a, b: 1 - bin(a ^ b).count("1") / 64
    all_prints = [prints[t or ""] for _, t in rows]
    want = []
    for i, t in rows:
        t = t or ""
        half, other = len(t) // 2, nxt[(i, t)]
        new = t[:len(t) - half] + other[:half]
        f = prints[t]
        n = sum(bin(f ^ x).count("1") <= 3 for x in all_prints) if i is not None and i % 100 == 0 else None
        want.append((i, len(t), hashlib.sha256(new.encode()).hexdigest(), f"{f:016x}", f"{fingerprint(new):016x}",
                     alike(f, fingerprint(new)), alike(f, prints[other]), n))
    assert order(map(tuple, got)) == order(want)


def test_fingerprint_many_terms(spark):
    """More terms than one packed counter holds."""
    text = " ".join(f"t{i}" for i in range(70_000))
    got = spark.createDataFrame([(text,)], "text string").select(fingerprints.fingerprint("text")).first()[0]
    assert got & ((1 << 64) - 1) == fingerprint(text)


def test_hamming_search(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(-2**63, 2**63 - 1, 40)
    near = [int(b) ^ sum(1 << int(k) for k in rng.choice(63, n, replace=False)) for b in base for n in range(6)]
    df = spark.createDataFrame([(int(x),) for x in near], "fingerprint long")
    got = {(r[0], r[1]) for r in fingerprints.within(df, df).collect()}
    want = {(a, b) for a in near for b in near if bin((a ^ b) & ((1 << 64) - 1)).count("1") <= 3}
    assert got == want


def test_toxicity(spark, edge_dir, empty_dir):
    sf = "/root/testdata/sf0.01"
    got = queries.QUERIES["op10_toxicity"](spark, sf).collect()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    test = [(r.score, labels[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in labels]
    pos, neg = [s for s, y, _ in test if y == 1], [s for s, y, _ in test if y == 0]
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert len(got) == 1000 and auc > 0.85 and sum(p == y for _, y, p in test) / len(test) > 0.85
    edge = queries.QUERIES["op10_toxicity"](spark, edge_dir).collect()
    assert len(edge) == len(docs_of(spark, edge_dir)) and all(0 <= r.score <= 1 for r in edge)
    assert queries.QUERIES["op10_toxicity"](spark, empty_dir).count() == 0


def test_toxicity_ignores_other_columns(spark):
    """Scores depend on texts alone, and held-out labels are never read."""
    from pyspark.sql import functions as F
    sf = SF
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    a = {r.doc_id: r.score for r in toxicity.digest(docs, labels).collect()}
    other = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    b = {r.doc_id: r.score for r in toxicity.digest(docs.withColumns({"lang": F.lit("xx"), "source": F.lit(None)}), other).collect()}
    assert a == b


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty(spark, empty_dir, name):
    assert queries.QUERIES[name](spark, empty_dir).count() == 0


def test_pipeline(spark):
    """The pipeline's rows against a brute-force run of its stages."""
    import corpus_pipeline
    from quire.llm import decontaminate, mixing
    from quire.llm.frames import load
    got = corpus_pipeline.run(spark, SF).collect()
    docs = load(spark, SF, "documents")
    model = toxicity.fit(docs, load(spark, SF, "labels"))
    rows = [tuple(r) for r in docs.select("doc_id", "text", "source").collect()]
    ids, first, lang = toxicity.features(pa.array([t or "" for _, t, _ in rows]))
    score = toxicity.scores(model, toxicity.logits(model, toxicity.pooled(model, ids, first)), lang)
    rows = [r for r, s in zip(rows, score) if s < toxicity.THRESHOLD]
    low = {d: c for d, c, *_ in classes([r[:2] for r in rows])}
    rows = [r for r in rows if low[r[0]] == r[0]]
    index = decontaminate.build_index([tuple(r) for r in load(spark, SF, "benchmark").select("item_id", "text").collect()], 13)
    kept = []
    for r in rows:
        buf, off = T.flat(pa.array([r[1] or ""]))
        f, _, hit, _, _ = decontaminate.scan(buf, off, index)
        if not (hit.sum() and 20 * hit.sum() >= f[-1]):
            kept.append(r)
    taken = {r.doc_id: r.taken // r.size if r.size else 0 for r in
             mixing.digest(spark.createDataFrame(kept, "doc_id long, text string, source string")).collect()}
    from tokenizers import Tokenizer
    full, at, want = Tokenizer.from_file(tokens.vocabulary_path()), 0, []
    for d, t, _ in sorted(kept):
        x = full.encode(t, add_special_tokens=False).ids + [2]
        for _ in range(taken[d]):
            want.append((d, at, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
            at += len(x)
    assert order(map(tuple, got)) == order(want)


def test_very_long_texts(spark, edge_dir):
    """Texts far beyond a piece, a unit and a block pass through every operator whole."""
    words = [f"w{i % 50_021}x{i}" for i in range(250_000)]
    text = " ".join(words)
    docs = spark.createDataFrame([(1, text, "a"), (2, text + " end", "a"), (3, "short one", "b")], "doc_id long, text string, source string")
    bench, labels = (spark.read.parquet(f"{edge_dir}/{t}.parquet") for t in ("benchmark", "labels"))
    by_id = lambda df: {r.doc_id: r for r in df.collect()}
    one = by_id(queries.decontaminate.digest(docs, bench))
    assert one[1].n_words == 250_000 and one[2].n_words == 250_001
    two = by_id(substrings.digest(docs))
    assert (two[1].n_removed, two[2].n_removed) == (0, 250_000)
    three = by_id(bytespans.digest(docs))
    assert (three[1].n_removed, three[2].n_removed, three[2].n_bytes) == (len(text), len(text), len(text) + 4)
    assert {d: r.class_id for d, r in by_id(neardup.digest(docs)).items()} == {1: 1, 2: 1, 3: 3}
    five = by_id(tokens.digest(docs))
    assert five[2].start == five[1].n_tokens and five[2].n_tokens == five[1].n_tokens + 1
    assert by_id(queries.secrets.digest(docs))[1].n_assign == 0
    assert by_id(queries.mixing.digest(docs))[2].size == 250_001
    nine = by_id(fingerprints.digest(docs))
    assert int(nine[1].fingerprint, 16) == fingerprint(text)
    assert len(by_id(toxicity.digest(docs, labels))) == 3
