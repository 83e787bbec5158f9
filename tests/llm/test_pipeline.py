from __future__ import annotations

import glob
import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_lines_chat import brute_lines
from tests.llm.test_simhash import _least_of_groups
from weft.llm import decontam, pieces, quality

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    assert len(corpus_pipeline.STAGES) == 5
    before = {r["doc_id"]: r for r in docs.collect()}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        rows = {r["doc_id"]: r for r in docs.collect()}
        assert 0 < len(rows) <= len(before) and set(rows) <= set(before)
        if k < 4:
            assert docs.columns == columns
        if k == 0:
            labels = spark.read.parquet(f"{SF}/labels.parquet")
            network = quality.fit(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"), labels)
            assert set(rows) == {i for i, r in before.items() if network.score(r["text"]) >= 0.3}
        if k == 1:
            assert len(rows) == len(before)
            assert sorted((i, r["text"]) for i, r in rows.items()) == sorted(brute_lines(list(before.values()), 8, True))
            assert all(r["n_chars"] == len(r["text"]) for r in rows.values())
        if k == 2:
            assert set(rows) == _least_of_groups([(i, r["text"]) for i, r in before.items()])
        if k == 3:
            items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            index = decontam.SeedIndex(items)
            assert set(rows) == {i for i, r in before.items() if not index.match(r["text"])}
        if k == 4:
            m = pieces.model(pieces.MODEL)
            assert set(rows) == set(before) and all(m.decode(r["ids"]) == before[i]["text"] for i, r in rows.items())
        before = rows


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_run_is_the_stages_one_after_the_other(spark):
    out = corpus_pipeline.run(spark, SF)
    assert 0 < out.count() < spark.read.parquet(f"{SF}/documents.parquet").count()
    assert glob.glob(f"{SF}/*.parquet")


@pytest.mark.parametrize("rows", [[], [(None, None), (1, None), (1, ""), (2, "a b"), (2, "a b"), (None, "a b")]])
def test_stages_of_odd_tables(spark, rows):
    """Nulls in any column, repeated rows, an empty table, and columns of clashing names."""
    d = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    d = d.withColumns({"n_lines": F.lit(1), "key": F.lit("x"), "node": F.lit(None).cast("string")})
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, d, SF)
        assert out.count() <= len(rows)
        if k in (2, 3, 4):
            assert k == 4 or out.columns == d.columns
        if k == 2:
            assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str) == ([(1, ""), (2, "a b")] if rows else []) or sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str) == [(1, None), (2, "a b")]
