"""Algorithms against plain versions."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import decontaminate, neardup, packing, rangecoder, suffixarray, tokens
from quire.llm import textops as T
from quire.llm.neardup import banded_distance


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=60), st.integers(1, 4))
def test_suffix_array(x, repeat):
    x = x * repeat + [0]
    assert suffixarray.suffix_array(np.array(x)).tolist() == sorted(range(len(x)), key=lambda i: x[i:])


def test_common_prefixes():
    x = np.array([2, 3, 2, 3, 2, 4, 0])
    order = suffixarray.suffix_array(x)
    got = suffixarray.common_prefixes(x, order, 10)
    for k in range(1, len(x)):
        a, b = x[order[k]:].tolist(), x[order[k - 1]:].tolist()
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        assert got[k] == n


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=18), st.lists(st.integers(0, 3), max_size=18), st.integers(0, 14))
def test_banded_distance(a, b, limit):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        c = [i]
        for j, y in enumerate(b, 1):
            c.append(min(p[j] + 1, c[-1] + 1, p[j - 1] + (x != y)))
        p = c
    assert banded_distance(a, b, limit) == min(p[-1], limit + 1)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, 65535), max_size=80), max_size=6), st.integers(1, 65536))
def test_range_coder(blocks, top):
    blocks = [np.array([x % top for x in b], np.int64) for b in blocks]
    back = rangecoder.decode(rangecoder.encode(blocks))
    assert [b.tolist() for b in back] == [b.tolist() for b in blocks]


def test_range_coder_long_and_damaged():
    rng = np.random.default_rng(1)
    blocks = [rng.integers(0, 65536, 5000), np.zeros(4096, int), rng.zipf(1.4, 3000) % 49408]
    coded = rangecoder.encode(blocks)
    assert all((a == b).all() for a, b in zip(blocks, rangecoder.decode(coded)))
    assert len(coded[1]) < 200  # a constant block costs next to nothing
    assert rangecoder.encode([blocks[2]]) == [coded[2]]  # blocks do not depend on each other
    bad = bytearray(coded[2])
    bad[40] ^= 1
    with pytest.raises(ValueError):
        rangecoder.decode([bytes(bad)])


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=50), st.binary(max_size=50))
def test_crc_shift(a, b):
    assert zlib.crc32(a + b) == tokens.crc_shift(zlib.crc32(a), len(b)) ^ zlib.crc32(b)


def test_crc_shift_of_many():
    """The crcs of all parts are shifted together; one by one they cost more than a block's decoding."""
    parts = [bytes([i]) * (i * 37) for i in range(40)]
    tails = [b"x" * (i * 811 % 9000) for i in range(40)]
    got = tokens.crc_shift([zlib.crc32(a) for a in parts], [len(b) for b in tails])
    assert [int(g) ^ zlib.crc32(b) for g, b in zip(got, tails)] == [zlib.crc32(a + b) for a, b in zip(parts, tails)]
    assert len(tokens.crc_shift([], [])) == 0


def test_range_coder_fills_once_a_token(monkeypatch):
    """The registers are filled once a token, whatever was coded; carries reach the words before."""
    calls = []
    for kind in (rangecoder.Encoder, rangecoder.Decoder):
        monkeypatch.setattr(kind, "fill", lambda self, k, f=kind.fill: (calls.append(k), f(self, k)))
    rng = np.random.default_rng(5)
    blocks = [np.where(rng.random(700) < 0.5, 65535, rng.integers(0, 65536, 700)) for _ in range(300)]
    coded = rangecoder.encode(blocks)
    assert calls == [300] * 700
    assert all((a == b).all() for a, b in zip(blocks, rangecoder.decode(coded))) and len(calls) == 1400
    e = rangecoder.Encoder(1, 5)
    e.words[:3], e.next[0], e.reg[0] = [7, 65535, 65535], 3, ~rangecoder.U(0)
    assert np.frombuffer(e.finish()[0], "<u2").tolist() == [8, 0, 0, 0]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="aB9 é\t.\n漢", max_size=30), max_size=6), st.integers(3, 40))
def test_words(texts, piece):
    buf, off = T.flat(pa.array(texts, pa.string()))
    s, e, h, first = T.words(buf, off, T.NOT_SPACE, piece=piece)
    raw, seen = buf.tobytes(), {}
    assert [[raw[s[i]:e[i]] for i in range(first[k], first[k + 1])] for k in range(len(texts))] == [t.encode().split() for t in texts]
    for i in range(len(s)):
        assert seen.setdefault(raw[s[i]:e[i]], h[i]) == h[i]
    assert len(set(seen.values())) == len(seen)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**40), max_size=50))
def test_packing(x):
    a, b = np.array(x, np.int64), np.sort(np.array(x, np.int64))
    c, d = packing.load(packing.dump(a, b))
    assert (a == c).all() and (b == d).all()


def test_remove_spans():
    assert decontaminate.remove_spans("Keep THIS out, please; and é go", [1, 3, 5, 6]) == "Keep , please; and  go"
    assert decontaminate.merged([0, 3, 8, 9], [2, 5, 9, 12]) == [0, 5, 8, 12]


def test_sliced_benchmark(spark, edge_dir):
    """A benchmark beyond the broadcast bound is scanned in slices, with the same result."""
    docs, bench = (spark.read.parquet(f"{edge_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    a = decontaminate.digest(docs, bench).collect()
    b = decontaminate.digest(docs, bench, max_broadcast_bytes=20).collect()
    assert sorted(map(repr, a)) == sorted(map(repr, b)) and any(r.contaminated for r in a)
    spans = decontaminate.decontaminate(docs, bench, mode="spans")
    assert spans.columns == docs.columns and spans.count() == docs.count()


def test_rare_words_meet_all_similar(monkeypatch):
    """Every pair of different components that is similar passes the rare-word filter, also when words have several
    cells and bags are full; a passage that all texts share brings no pairs."""
    monkeypatch.setattr(neardup, "WORD_ROWS", 7)
    monkeypatch.setattr(neardup, "MEETINGS", 50)
    rng = np.random.default_rng(11)
    texts = []
    for _ in range(6):
        base = [f"w{k}" for k in rng.integers(0, 40, int(rng.integers(20, 90)))]
        for _ in range(20):
            w = list(base)
            for j in rng.integers(0, len(w), int(rng.integers(0, len(w) // 5 + 2))):
                w[j] = f"w{rng.integers(0, 40)}"
            texts.append(" ".join(w))
    long = ["again"] * 400 + [f"v{i}" for i in range(80)]
    texts += [" ".join(long), " ".join(long[:-20])]
    passage = " ".join(f"p{i}" for i in range(40))
    texts += [passage + " " + " ".join(f"u{i}_{j}" for j in range(30)) for i in range(20)]
    texts = sorted(set(texts))
    words = [T.words(*T.flat(pa.array([t])), T.ALNUM, fold=True)[2] for t in texts]
    want = {(i, j) for j in range(len(texts)) for i in range(j) if neardup.similar(words[i], words[j])}
    tid = [i.to_bytes(16, "big") for i in range(len(texts))]
    held = []
    for _ in range(2):
        counts = np.zeros(1 << neardup.WORD_BITS, np.int64)
        for b in neardup._count_words(0.8, (lambda: held[0]) if held else None)([pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])]):
            counts[b.column(0).to_numpy()] = b.column(1).to_numpy()
        held.append(counts)
    rows = pa.Table.from_batches(list(neardup._rare_words(0.8, lambda: held[0], lambda: held[1])(
        [pa.RecordBatch.from_arrays([pa.array(tid, pa.binary()), pa.array(texts), pa.array(tid, pa.binary())], names=["tid", "text", "component"])])))
    rows = rows.sort_by([(c, "ascending") for c in ("word", "x", "y", "n")])
    got = {(int.from_bytes(r["a"], "big"), int.from_bytes(r["b"], "big"))
           for b in neardup._meet(0.8, True)(rows.combine_chunks().to_batches()) for r in b.to_pylist()}
    assert len(want) > 300 and want <= got
    shared = {i for i, t in enumerate(texts) if t.startswith(passage)}
    assert not any(i in shared and j in shared for i, j in got)


def test_groups_meet_all_similar(monkeypatch):
    """All components with a similar pair that shares a group are linked, by similar pairs alone and once a group; a row a
    text at most comes of a first look."""
    rng = np.random.default_rng(12)
    texts = []
    for _ in range(4):
        base = [f"w{k}" for k in rng.integers(0, 40, int(rng.integers(20, 90)))]
        for _ in range(25):
            w = list(base)
            for j in rng.integers(0, len(w), int(rng.integers(0, len(w) // 5 + 2))):
                w[j] = f"w{rng.integers(0, 40)}"
            texts.append(" ".join(w))
    long = ["again"] * 400 + [f"v{i}" for i in range(80)]
    texts += [" ".join(long), " ".join(long[:-20])]
    passage = " ".join(f"p{i}" for i in range(40))
    texts += [passage + " " + " ".join(f"u{i}_{j}" for j in range(30)) for i in range(20)]
    texts = sorted(set(texts))
    words = [T.words(*T.flat(pa.array([t])), T.ALNUM, fold=True)[2] for t in texts]
    tid = [i.to_bytes(16, "big") for i in range(len(texts))]
    part = [max(0, i - i % 3).to_bytes(16, "big") for i in range(len(texts))]  # three texts a component
    keys = [[i % 2, 7, 7] for i in range(len(texts))]  # a band of two groups, and two bands of one
    sent = pa.Table.from_batches(list(neardup._text_words([pa.RecordBatch.from_arrays(
        [pa.array(tid, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(texts)], names=["tid", "keys", "text"])])))
    sent = sent.column("words").to_pylist()
    places = sorted((band, keys[i][band], len(words[i]), i) for i in range(len(texts)) for band in range(3))
    of = [i for *_, i in places]
    cols = [pa.array([r[c] for r in places], pa.int64()) for c in range(3)]
    cols += [pa.array([v[i] for i in of], t) for v, t in ((tid, pa.binary()), (part, pa.binary()), (keys, pa.list_(pa.int64())), (sent, pa.binary()))]
    rows = pa.table(cols, names=["band", "key", "n", "tid", "component", "keys", "words"]).to_batches(max_chunksize=50)

    def met(whole):
        return [tuple(sorted((int.from_bytes(r["a"], "big"), int.from_bytes(r["b"], "big"))))
                for b in neardup._within(0.8, whole)(rows) for r in b.to_pylist()]

    got = met(True)
    want = {(i, j) for j in range(len(texts)) for i in range(j) if part[i] != part[j] and neardup.similar(words[i], words[j])}
    linked = {(part[i], part[j]) for i, j in want}
    assert len(linked) > 100 and set(got) <= want and {(part[i], part[j]) for i, j in got} == linked
    assert len(got) <= 4 * len(linked)  # four groups
    first = met(False)
    assert 40 < len(first) <= len(places) and set(first) <= want
    monkeypatch.setattr(neardup, "MEETINGS", 50)  # pieces of a group
    assert {(part[i], part[j]) for i, j in met(True)} == linked and len(met(False)) <= len(places)


@pytest.mark.parametrize("group_rows", [0, 30, 4096])
def test_large_groups_by_either_way(spark, monkeypatch, group_rows):
    """A group that meets whole and one that is too large for it have the same classes."""
    monkeypatch.setattr(neardup, "GROUP_ROWS", group_rows)
    rng = np.random.default_rng(6)
    rows = []
    for c in range(3):
        head = " ".join(f"h{c % 2}x{i}" for i in range(40))  # the first and the third kind share a passage
        for i in range(40):
            tail = [f"t{c}x{j}" for j in range(60)]
            for j in rng.choice(60, 11 + i % 5, replace=False):
                tail[j] = f"y{c}x{i}x{j}"
            rows.append((len(rows), head + " " + " ".join(tail)))
    got = {r.doc_id: r.class_id for r in neardup.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    words = [T.words(*T.flat(pa.array([t])), T.ALNUM, fold=True)[2] for _, t in rows]
    sketches = np.stack([neardup.sketch(w, neardup.seeds(neardup.SKETCHES)) for w in words])
    want = list(range(len(rows)))
    for j in range(len(rows)):
        for i in range(j):
            if want[i] != want[j] and (sketches[i] == sketches[j]).any() and neardup.similar(words[i], words[j]):
                want = [min(want[i], want[j]) if v in (want[i], want[j]) else v for v in want]
    assert got == dict(enumerate(want)) and 3 < len(set(want)) < 100


def test_worker_gives_memory_back_before_and_after_its_task():
    store = T.worker_store().__dict__
    store.update(words={"a": 1}, other=[1])
    seen = []

    def run(batches):
        T.powers(T.P_BYTE, 10)
        seen.append(set(store) & {"words", "other"})
        yield from batches

    assert list(T.lean(run, "words")([1, 2])) == [1, 2]
    assert seen == [{"words"}] and not T._POW and "words" in store
    assert list(T.lean(run)([3])) == [3]
    assert seen[1] == set() and not T._POW and "words" not in store


def test_tokens_worker_keeps_its_words_and_the_next_stage_drops_them():
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["one two", "two three"])], names=["doc_id", "text"])
    index = decontaminate.build_index([("i", "two three")], 13)
    words = T.worker_store().__dict__
    words["words"] = {"x": 1}
    part = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([[], []], pa.list_(pa.int64())),
                                       pa.array([[], []], pa.list_(pa.string()))], names=["c0", "c1", "spans", "items"])
    out = list(decontaminate._marks(lambda: index, 4)([part]))
    assert [r.as_py() for b in out for r in b.column(2)] == [[], [0, 2]]
    assert [r.as_py() for b in out for r in b.column(3)] == [[], ["i"]]
    assert "words" not in words


def test_tokenizer_gets_bounded_calls():
    class Counts:
        def __init__(self):
            self.calls = []

        def encode_batch_fast(self, words, add_special_tokens):
            self.calls.append(len(words))
            return [type("E", (), {"ids": [len(w)]}) for w in words]

    w = tokens.WordIds(tokens.vocabulary_path())
    w.tokenizer = Counts()
    texts = [" ".join("x" * (1 + i % 7) + str(i) for i in range(9000)), "", "x0 x0 xx1"]
    buf, off = T.flat(pa.array(texts))
    ids, first = w.encode(buf, off)
    assert max(w.tokenizer.calls) <= tokens.CALL_WORDS and sum(w.tokenizer.calls) == 9000
    assert ids.tolist() == [len(x) for x in texts[0].split()] + [2, 2] + [2, 2, 3, 2]
    assert first.tolist() == [0, 9001, 9002, 9006]


def test_marked_parts_are_bounded():
    n = 40
    text = "some words of a long text " * 5000  # 130 kB
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array([text] * n), pa.array([[]] * n, pa.list_(pa.int64())),
                                        pa.array([[]] * n, pa.list_(pa.string()))], names=["c0", "c1", "spans", "items"])
    index = decontaminate.build_index([("i", "of a long text")], 13)
    out = list(decontaminate._marks(lambda: index, 4)([batch]))
    assert [x for b in out for x in b.column(0).to_pylist()] == list(range(n))
    assert len(out) > 1 and max(len(b.column(1)[0].as_py()) * b.num_rows for b in out) <= decontaminate.BATCH_BYTES
