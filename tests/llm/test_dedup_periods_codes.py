"""Digest index, periodic runs and vector codes against brute force, over several runs and at their edges."""

import hashlib
import re
import zlib

import numpy as np
import pytest

from quire.llm import digestindex, lloyd, periods, queries

SF = "/root/testdata/sf0.001"


def brute_runs(w, least=12):
    """(start, length, period) of all runs, by start, then period: every period is tried at every place."""
    out = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, 2 * q):
                out.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2], r[1]))


def words_of(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def digest_row(doc_id, w, least=12):
    runs = brute_runs(w, least)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    return (doc_id, len(runs), *(best + (1000 * best[1] // best[2],) if best else (None,) * 4),
            hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(),
            hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest())


@pytest.mark.parametrize("where", ["sf", "edge"])
def test_runs(spark, edge_dir, where):
    d = SF if where == "sf" else edge_dir
    got = queries.QUERIES["op12_periodic_runs"](spark, d).collect()
    want = []
    for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect():
        w = words_of(r.text)
        if len(w) > 1500:  # brute force takes the square: the long ones are tested below
            continue
        h = zlib.crc32(str(r.doc_id).encode()) if r.doc_id is not None else 1
        if h % 10 == 0 and w:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
        want.append(digest_row(r.doc_id, w))
    assert set(want) <= set(map(tuple, got)) and len(got) == spark.read.parquet(f"{d}/documents.parquet").count()
    if where == "sf":
        assert sum(r[1] > 0 for r in want) > 5


@pytest.mark.parametrize("least", [2, 7, 12, 30])
def test_runs_small_alphabets(least):
    """Nested, overlapping and touching runs, over one to four words."""
    rng = np.random.default_rng(least)
    for _ in range(400):
        docs = []
        for _ in range(rng.integers(1, 4)):
            w = rng.integers(0, rng.integers(1, 5), rng.integers(0, 100))
            if len(w) and rng.random() < 0.6:
                a, p = int(rng.integers(0, len(w))), int(rng.integers(1, 20))
                w = np.array([w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))])
            docs.append(w.astype(np.uint64))
        first = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
        got = periods.find(np.concatenate(docs), first, least)
        assert list(map(tuple, got.tolist())) == [(i, *r) for i, d in enumerate(docs) for r in brute_runs(d.tolist(), least)]


def test_runs_of_fibonacci_and_long_words(spark):
    """The word with the most runs, one word repeated, a long tail, a text of one very long word."""
    a, b = "x", "x y"
    while len(b.split()) < 900:
        a, b = b, b + " " + a
    tail = " ".join(f"u{i}" for i in range(700))
    rows = [(1, b), (2, "\t".join(["same"] * 1200)), (3, f"{tail} {tail} {tail} u0"), (4, "z" * 200_000), (5, f"  lead {tail}\n"), (6, None), (6, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = periods.detect(docs).collect()
    for r in got:
        w = words_of(dict(rows)[r.doc_id])
        want = digest_row(r.doc_id, w)
        assert tuple(r)[:8] == want
        assert [tuple(x) for x in r.runs] == brute_runs(w) and hashlib.sha256(r.collapsed.encode()).hexdigest() == want[7]
    assert {r.doc_id: r.period for r in got}[3] == 700


def test_runs_survive_hash_collisions(monkeypatch):
    """Different words of one hash: the document is done again by its bytes."""
    text = " ".join(["a b c d"] * 4 + ["a b X d"] * 4 + [f"w{i}" for i in range(30)]).encode()
    real = periods.T.words

    def colliding(buf, off, table, **kw):
        s, e, h, first = real(buf, off, table, **kw)
        h = h.copy()
        for i, (x, y) in enumerate(zip(s, e)):
            if buf[x:y].tobytes() == b"X":
                h[i] = h[2]
        return s, e, h, first
    buf = np.frombuffer(text, np.uint8)
    s, e, h, first = colliding(buf, np.array([0, len(buf)]), periods.T.NOT_SPACE)
    merged = periods.find(h, first)
    exact = periods._exact(buf, s, e, h, first, merged, 12)
    assert merged.tolist() == [[0, 0, 32, 4]]
    assert [tuple(r[1:]) for r in exact.tolist()] == brute_runs(text.decode().split())


def test_wavelet_tree():
    rng = np.random.default_rng(1)
    v = rng.integers(0, 700, 500)
    t = periods.WaveletTree(v)
    lo = rng.integers(0, 500, 300)
    hi = lo + rng.integers(0, 500 - lo + 1)
    x = rng.integers(0, 1500, 300)
    assert t.less(lo, hi, x).tolist() == [int((v[a:b] < c).sum()) for a, b, c in zip(lo, hi, x)]
    some = hi > lo
    c = rng.integers(0, np.maximum(hi - lo, 1))
    assert t.pick(lo, hi, c)[some].tolist() == [int(np.sort(v[a:b])[k]) for a, b, k in zip(lo, hi, c) if b > a]


def test_index_over_runs(spark, tmp_path):
    """Three batches, a batch again, another session's view of the index, and a compacted index."""
    def batch(rows):
        return digestindex.digests(spark.createDataFrame(rows, "doc_id long, text string"))
    path = str(tmp_path / "index")
    index = digestindex.DigestIndex(spark, path, buckets=4)
    one = batch([(1, "Alpha"), (2, "alpha"), (3, "beta"), (3, "beta"), (None, None), (4, "")])
    assert index.ingest(one, "one") == 3
    rows = sorted(map(tuple, index.verdicts(one, ["one"]).select("doc_id", "keep_id", "group_size", "kept").collect()), key=repr)
    assert rows == sorted([(1, 2, 2, False), (2, 2, 2, True), (3, 3, 2, True), (3, 3, 2, False), (None, 4, 2, False), (4, 4, 2, True)], key=repr)
    two = batch([(9, "ALPHA"), (10, "gamma"), (11, "Gamma"), (12, "É"), (13, "é")])
    assert index.ingest(two, "two") == 3  # gamma, and two texts that differ in a letter beyond A-Z
    want = {(9, 2, 1, False), (10, 11, 2, False), (11, 11, 2, True), (12, 12, 1, True), (13, 13, 1, True)}
    see = lambda ix, b, names: {tuple(r)[:4] for r in ix.verdicts(b, names).collect()}
    assert see(index, two, ["two"]) == want
    assert index.ingest(two, "two") == 0 and see(index, two, ["two"]) == want
    spark.sql(f"DROP TABLE {index.table}")  # another session does not know the table, only the folder
    again = digestindex.DigestIndex(spark, path)
    assert again.buckets == 4 and again.entries().count() == 6 and see(again, two, ["two"]) == want
    small = again.compact(str(tmp_path / "compacted"))
    assert {tuple(r) for r in small.entries().collect()} == {tuple(r) for r in again.entries().collect()}
    assert small.ingest(batch([(20, "BETA"), (21, "delta")]), "three") == 1


def test_index_is_not_shuffled(spark, tmp_path):
    """The anti-join is a sort-merge join that deals only the batch; the index's buckets are read in place."""
    index = digestindex.DigestIndex(spark, str(tmp_path / "index"), buckets=4)
    rows = digestindex.digests(spark.createDataFrame([(i, f"t{i % 7}") for i in range(50)], "doc_id long, text string"))
    index.ingest(rows, "one")
    plan = (rows.select("digest").join(index.entries().select("digest").hint("merge"), "digest", "left_anti")
            ._jdf.queryExecution().executedPlan().toString())
    assert "SortMergeJoin" in plan and plan.count("Exchange") <= 2 and "Bucketed: true" in plan


def test_hot_text(spark, monkeypatch):
    """A third of all rows hold one text; hot and other texts get the same verdicts whatever counts as hot."""
    rows = [(i, "copy" if i % 3 == 0 else f"text {i % 40}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    seen = []
    for n in (1, 8, 4096):
        monkeypatch.setattr("quire.llm.frames.HOT_KEYS", n)
        seen.append(sorted(map(tuple, digestindex.digest(docs).collect())))
    assert seen[0] == seen[1] == seen[2]
    top = {t: max(i for i, x in rows if x == t) for _, t in rows}
    assert all((d, k) == (d, top[dict(rows)[d]]) and s == sum(t == dict(rows)[d] for _, t in rows) for d, k, s, *_ in seen[0])


def brute_codes(vectors, parts, entries, rounds):
    """Codes and codebooks in plain integers."""
    x = [[int(np.floor(256 * np.float64(np.float32(c)))) for c in v] for _, v in vectors]
    w = len(x[0]) // parts
    part = lambda v, p: v[p * w:(p + 1) * w]
    order = sorted(range(len(x)), key=lambda i: (vectors[i][0], x[i]))[:entries]
    books = [[part(x[i], p) for i in order] for p in range(parts)]
    dist = lambda a, b: sum((s - t) ** 2 for s, t in zip(a, b))
    def assign():
        return [[min(range(len(books[p])), key=lambda k: (dist(part(v, p), books[p][k]), k)) for p in range(parts)] for v in x]
    for _ in range(rounds):
        code = assign()
        for p in range(parts):
            for k in range(len(books[p])):
                own = [part(v, p) for v, c in zip(x, code) if c[p] == k]
                if own:
                    books[p][k] = [sum(c) // len(own) for c in zip(*own)]
    code = assign()
    return books, [("".join(f"{k:02x}" for k in c), sum(dist(part(v, p), books[p][k]) for p, k in enumerate(c))) for v, c in zip(x, code)]


@pytest.mark.parametrize("parts,entries,rounds", [(4, 8, 1), (4, 8, 5), (12, 3, 3), (2, 200, 2)])
def test_codes_any_rounds(spark, parts, entries, rounds):
    """More rounds than the query's, so members migrate several times and are resident in several tables."""
    rng = np.random.default_rng(parts)
    vectors = [(int(i), [float(np.float32(c)) for c in rng.normal(0, 1, 24)]) for i in rng.permutation(150)]
    vectors += [(1000 + i, vectors[0][1]) for i in range(80)]  # a third of all rows hold one vector
    df = spark.createDataFrame([(i, v, None) for i, v in vectors], "vec_id long, embedding array<float>, label int")
    book, coded = lloyd.compress(df, parts, entries, rounds)
    want_book, want = brute_codes(vectors, parts, entries, rounds)
    assert book.tolist() == want_book
    assert {r.vec_id: (r.code, r.error) for r in coded.collect()} == {i: c for (i, _), c in zip(vectors, want)}


def test_hot_entries_are_dealt_to_many_owners(spark):
    """An entry with most members is salted; an owner holds no more than its share."""
    df = spark.createDataFrame([(i, [0.0] * 16 if i else [9.0] * 16, 1) for i in range(4000)], "vec_id long, embedding array<double>, label int")
    first = np.zeros((16, 2, 1), np.int64)
    first[:, 1] = 5000
    members = df.selectExpr("vec_id AS row", "embedding").select("row").crossJoin(
        spark.createDataFrame([(lloyd.packed(np.zeros((1, 16)))[0].as_py(),)], "x binary"))
    dealt = members.mapInArrow(lloyd._deal(16, first), lloyd.PART)
    count = np.zeros((16, 2), np.int64)
    count[:, 0] = 4000
    owners = lloyd._owned(dealt, count, 4, "test").groupBy("position", "entry", "salt").count().collect()
    assert sum(r["count"] for r in owners) == 64_000 and max(r["count"] for r in owners) < 4000
