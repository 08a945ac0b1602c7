"""Multi-line records by byte ranges: against Python's csv reader, whatever the split size."""

import csv
import io
import os
import random

import pytest

from quire.sources import files as fs
from quire.sources import records as rec

CELLS = ["a", "b#c", 'say "hi"', "two\nlines", "x\n\n\ny", "é" * 30, 'q"\n"', "long " * 80, "", "cr\rin cell", "#"]


@pytest.fixture
def split(spark):
    """Set the split size of file scans; the old one comes back."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = [spark.conf.get(n) for n in names]

    def to(n):
        spark.conf.set(names[0], str(n))
        spark.conf.set(names[1], "1")
    yield to
    for n, v in zip(names, old):
        spark.conf.set(n, v)


def write_files(d, seed):
    r, want = random.Random(seed), {}
    for f in range(5):
        table = [[r.choice(CELLS) for _ in range(3)] for _ in range(r.choice([1, 4, 30, 90]))]
        table = [row if any(row) else ["x"] + row[1:] for row in table]
        b = io.StringIO()
        csv.writer(b, delimiter="#", lineterminator="\r\n" if f % 2 else "\n", quoting=csv.QUOTE_MINIMAL if f % 3 else csv.QUOTE_ALL).writerows(table)
        text = b.getvalue()
        text = ("\n" + text if f == 1 else text).removesuffix("\r\n" if f % 2 else "\n") if f < 3 else text + "\n\n"
        (d / f"f{f}.csv").write_bytes(text.encode())
        want[f"f{f}.csv"] = table
    (d / "empty.csv").write_bytes(b"")
    return want


@pytest.mark.parametrize("size,seed", [(40, 1), (150, 2), (1000, 3), (1 << 27, 4)])
def test_records_match_csv_reader(spark, tmp_path, split, size, seed):
    want = write_files(tmp_path, seed)
    split(size)
    got = {}
    for r in rec.read_records(spark, str(tmp_path), "*.csv").collect():
        assert r.closed and (r.first is None or r.first == got.setdefault(os.path.basename(r.source_file), {}).get(0, r.first))
        got.setdefault(os.path.basename(r.source_file), {})[r.record_no] = r.text
    assert set(got) == set(want)
    for f, table in want.items():
        assert sorted(got[f]) == list(range(len(table)))
        assert [next(csv.reader(io.StringIO(got[f][i], newline=""), delimiter="#")) for i in range(len(table))] == table


def test_many_tasks_read_one_file(spark, tmp_path, split):
    """A file of many splits, most of whose borders lie inside quotes, is read by many tasks; no task has it all."""
    (tmp_path / "big.csv").write_text("id#text\n" + "".join(f'{i}#"line one {i}\nline two, ""quoted""\n\nend"\n' for i in range(4000)))
    split(4096)
    lines = rec.physical_lines(spark, str(tmp_path))
    per_split = [r["count"] for r in lines.groupBy("block").count().collect()]
    known = rec.splits(lines).collect()
    assert len(per_split) > 20 and max(per_split) < sum(per_split) / 10
    assert sum(r.inside for r in known) > 5
    t = fs.read_seed_tables(spark, str(tmp_path))
    got = {r.row_idx: tuple(r.cells) for r in t.collect()}
    assert got == {i + 1: (str(i), f'line one {i}\nline two, "quoted"\n\nend') for i in range(4000)}
    assert {tuple(r.header) for r in t.select("header").distinct().collect()} == {("id", "text")}


def test_record_over_many_splits(spark, tmp_path, split):
    """One record longer than several splits, as the first and as the last of its file."""
    long = "\n".join(f"row {i}" for i in range(300))
    (tmp_path / "a.csv").write_text(f'"h\n{long}"#b\n1#"{long}"\n2#x')
    split(200)
    got = {r.row_idx: (r.header, r.cells) for r in fs.read_seed_tables(spark, str(tmp_path)).collect()}
    assert {k: v[0] for k, v in got.items()} == {1: [f"h\n{long}", "b"], 2: [f"h\n{long}", "b"]}
    assert {k: v[1] for k, v in got.items()} == {1: ["1", long], 2: ["2", "x"]}


@pytest.mark.parametrize("size", [30, 1 << 20])
def test_bad_tables_are_left_out(spark, tmp_path, split, size):
    (tmp_path / "long.csv").write_text("a#b\n1#2\n1#2#3\n4\n")
    (tmp_path / "open.csv").write_text('a#b\n1#2\n3#"never closed\n4#5\n6#7\n')
    (tmp_path / "good.csv").write_text('a#b\n\n1#NA\n"x\ny"#"NA "\n5\n')
    split(size)
    t = fs.read_seed_tables(spark, str(tmp_path))
    name = lambda r: os.path.basename(r.table_id)
    errors = {(name(r), r.row_idx, r.error) for r in t.collect() if r.error}
    assert errors == {("long.csv", 2, "row longer than header"), ("open.csv", 2, "open quote")}
    ok = sorted((name(r), r.row_idx, tuple(r.cells)) for r in fs.accepted_tables(t).collect())
    assert ok == [("good.csv", 1, ("1", None)), ("good.csv", 2, ("x\ny", "NA ")), ("good.csv", 3, ("5", None))]
