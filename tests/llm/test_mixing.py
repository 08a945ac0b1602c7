"""Mixing with repeated rows at the cut, and inclusion probabilities that differ within a source."""

from collections import Counter

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from quire.llm import mixing, queries
from tools.oracle_check import compare, duck


def tied_dir(d, n_tied, ids):
    """Three sources; in the first, ``n_tied`` rows repeat (id 7 or no id), of ten words each."""
    rows = [(i, " ".join(f"w{j}" for j in range(1 + i % 23)), "a") for i in range(60)]
    rows += [(ids, " ".join(["same"] * 10), "a")] * n_tied
    rows += [(1000 + i, " ".join(["b"] * (5 + i % 400)), "b") for i in range(50)] + [(5000 + i, "c " * (i % 9), None) for i in range(300)]
    c = list(zip(*rows))
    pq.write_table(pa.table({"doc_id": pa.array(c[0], pa.int64()), "text": c[1], "source": pa.array(c[2], pa.string()),
                             "lang": ["x" if i % 2 else "y" for i in range(len(rows))]}), d / "documents.parquet")
    return rows


@pytest.mark.parametrize("n_tied,ids", [(100, 7), (100, None), (400, 7), (1, 7)])
def test_ties_at_the_cut(spark, tmp_path, n_tied, ids):
    rows = tied_dir(tmp_path, n_tied, ids)
    d = str(tmp_path)
    assert compare(spark, duck(d), "op8_mix_sources", queries.QUERIES["op8_mix_sources"], queries.ORACLE["op8_mix_sources"], d)[1] == "ok"
    got = queries.QUERIES["op8_mix_sources"](spark, d).collect()
    source = {i: s for i, _, s in rows}
    taken, target, longest = Counter(), {}, Counter()
    for r in got:
        s = source[r.doc_id]
        taken[s] += r.taken
        target[s] = r.target
        longest[s] = max(longest[s], r.size)
        assert r.taken <= 3 * r.size
    for s in target:  # within half a document of the target
        assert abs(taken[s] - target[s]) <= longest[s] / 2 + 1e-6
    # the mixed rows are the digest's, each of the variants no more often than its rows ask for
    mixed = Counter(r.doc_id for r in mixing.mix(spark.read.parquet(f"{d}/documents.parquet")).collect() if r.text.strip())
    assert mixed == Counter({i: n for i, n in ((i, sum(r.taken // r.size for r in got if r.doc_id == i and r.size)) for i in set(source)) if n})


def test_probabilities_differ_and_add_up(spark, tmp_path):
    tied_dir(tmp_path, 30, 7)
    sized = mixing.sizes(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    r = mixing.ranked(sized, mixing.cuts(sized)).collect()
    for s in ("a", "b", None):
        own = [x for x in r if x.source == s and x["size"] > 0]
        if own[0].rest > 0:
            assert abs(sum(x.p * x["size"] for x in own) - own[0].rest) < 1e-6 * own[0].source_size
            assert len({x.p for x in own}) > 1 and all(0 < x.p <= 1 for x in own)
            by_rank = [x.doc_id for x in sorted(own, key=lambda x: (x["rank"], x.u))]
            assert by_rank != [x.doc_id for x in sorted(own, key=lambda x: x.u)]
