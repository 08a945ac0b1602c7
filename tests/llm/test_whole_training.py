"""The classifier learns from every labelled row, with whole texts."""

import pytest
from pyspark.sql import functions as F

from quire.llm import toxicity


def _tables(spark, long_words: int):
    """Even ids are toxic: their mark stands at the end of a text of ``long_words`` words."""
    rows = [(i, " ".join(f"w{(i * 7 + k) % 50}" for k in range(long_words if i % 2 == 0 else 40)) + (" vilemark" if i % 2 == 0 else " plain"))
            for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    return docs, docs.select("doc_id", (F.col("doc_id") % 2 == 0).cast("int").alias("toxic"))


def test_texts_of_any_length_are_learned_from(spark):
    docs, labels = _tables(spark, 12_000)  # over 32,000 characters each
    got = toxicity.digest(docs, labels).collect()
    assert len(got) == 240
    wrong = [r.doc_id for r in got if r.predicted != (r.doc_id + 1) % 2]
    assert len(wrong) <= 6


@pytest.mark.parametrize("unit_rows", [2500, 40])
def test_every_row_is_counted_once(spark, monkeypatch, unit_rows):
    monkeypatch.setattr(toxicity, "UNIT_ROWS", unit_rows)
    docs, labels = _tables(spark, 50)
    rows, units = toxicity.training_rows(docs, labels)
    usable = labels.where(~toxicity.held_out(F.col("doc_id")))
    assert rows.count() == usable.count() and units == -(-usable.count() // unit_rows)
    seen = rows.select("text", "toxic").mapInArrow(toxicity._counts, "id int, pos bigint, neg bigint").groupBy("id").agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    want = usable.groupBy().agg(F.sum("toxic")).first()[0]
    assert want in [r.pos for r in seen.where("neg = 0").collect()]
    first, second = (sorted(toxicity.digest(docs, labels).collect()) for _ in range(2))
    assert first == second  # whatever the order units come in
    assert sum(r.predicted == (r.doc_id + 1) % 2 for r in first) >= 234
