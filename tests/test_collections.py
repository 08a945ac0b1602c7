"""Ordered collections: order, positions, replacement, and parts that no manifest names."""

from quire.sources import collections as co

SCHEMA = "id int, v string"


def test_order_and_replacement(spark, tmp_path):
    path = str(tmp_path / "c")
    rows = [(i * 7 % 101, f'text "{i}"\nnext\x01 é' if i % 3 else None) for i in range(101)] + [(50, "tie b"), (50, "tie a"), (None, "none")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(9)
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.coalescePartitions.enabled")
    old = [spark.conf.get(n) for n in names]
    spark.conf.set(names[0], "200")  # parts of several splits
    spark.conf.set(names[1], "false")
    try:
        m = co.write_collection(df, path, ["id"]).collect()
        assert len(m) > 1 and sum(r.n for r in m) == 104 and sorted(r.first for r in m)[0] == 0
        got = sorted(map(tuple, co.read_collection(spark, path, SCHEMA).collect()))
        assert [p for p, *_ in got] == list(range(104)) and got[0][1:] == (None, "none")
        assert [i for _, i, _ in got[1:]] == sorted(i for i, _ in rows if i is not None)
        assert {x[1:] for x in got} == set(rows)
        # parts laid end to end in the manifest's order are the collection
        lines = "".join(open(tmp_path / "c" / r.folder / r.part).read() for r in sorted(m, key=lambda r: r.first)).splitlines()
        assert len(lines) == 104
        # a writer that died leaves parts without a manifest: they are not read
        (tmp_path / "c" / "parts-dead").mkdir()
        (tmp_path / "c" / "parts-dead" / "part-00000.txt").write_text('{"id": 999, "v": "x"}\n')
        assert co.read_collection(spark, path, SCHEMA).where("id = 999").count() == 0
        co.write_collection(df.where("id < 3"), path, ["id"])
        assert sorted(r.id for r in co.read_collection(spark, path, SCHEMA).collect()) == [0, 1, 2]
    finally:
        for n, v in zip(names, old):
            spark.conf.set(n, v)


def test_empty(spark, tmp_path):
    co.write_collection(spark.createDataFrame([], SCHEMA), str(tmp_path / "e"), ["id"])
    assert co.read_collection(spark, str(tmp_path / "e"), SCHEMA).count() == 0
