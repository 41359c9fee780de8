from __future__ import annotations

import corpus_pipeline
from siltstone.llm import near_dedup, quality

SCHEMA = "doc_id long, text string"


def test_near_copy_leaves_other_texts_of_its_id(spark):
    rows = [(1, "a b c d e f"), (2, "A b c d e f"), (2, "a clean text of its own"), (3, None), (2, None)]
    out = near_dedup.deduplicated(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, out), key=str) == sorted([rows[0], *rows[2:]], key=str)


def test_quality_rejects_rows_by_id_and_text(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(quality, "learnt", lambda docs, labels: None)
    monkeypatch.setattr(quality, "score", lambda docs, model, id_col: docs.select(F.col(id_col).alias("id"), F.when(F.col("text") == "bad", 0.0).otherwise(1.0).alias("score")))
    rows = [(1, "bad"), (1, "good"), (None, "bad"), (None, "good"), (2, None)]
    out = dict(corpus_pipeline.STAGES)["quality"](spark, spark.createDataFrame(rows, SCHEMA), "/root/testdata/sf0.001").collect()
    assert sorted(map(tuple, out), key=str) == sorted([(1, "good"), (None, "good"), (2, None)], key=str)
