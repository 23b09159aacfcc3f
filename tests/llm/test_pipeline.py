"""The pipeline, stage by stage, against brute force over its own input."""

import collections

import pytest
from pyspark.sql import functions as F
from test_operators import ROWS, SCHEMA, brute_components, brute_contamination, words

from datastrata.llm.common import written

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, tmp_path):
    from test_operators import BENCH

    spark.createDataFrame(ROWS, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(BENCH, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, str(tmp_path)), name)
        seen.append(docs)
    for d in seen[1:-1]:
        assert d.columns == seen[0].columns
    rows = [[(r.doc_id, r.text) for r in d.collect()] for d in seen[:-1]]
    assert all(len(words(t)) >= 20 for _, t in rows[1])
    found = brute_components(rows[1])
    # Texts of one doc_id that are not alike both stay.
    assert sorted(map(repr, [d for d, _ in rows[2]])) == sorted(repr(d) for d, _ in {r for r, (d, _, c) in zip(rows[1], found) if d == c})
    assert collections.Counter(rows[3]) == collections.Counter(r for r in rows[2] if not brute_contamination(r[1])[-1])
    assert abs(sum(len(words(t)) for _, t in rows[4]) - sum(len(words(t)) for _, t in rows[3])) <= 3
    assert seen[-1].count() == len(rows[4])


def test_run(spark, tmp_path):
    spark.createDataFrame(ROWS, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_run_of_nothing(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "a question")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_stages_keep_clashing_columns(spark, tmp_path):
    names = ["q_text", "b_lines", "rest", "sid", "source_size", "taken", "_n", "_i", "key", "doc", "extra"]
    rows = spark.createDataFrame(ROWS, SCHEMA)
    for c in names:
        rows = rows.withColumn(c, F.concat(F.lit("x"), F.col("doc_id").cast("string")))
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "a question of thirteen words " * 3)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == rows.columns
        assert all(r[c] == (None if r.doc_id is None else f"x{r.doc_id}") for r in docs.collect() for c in names)
