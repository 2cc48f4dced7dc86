"""The pipeline's stages on a small table, what each promises; and the SQL counterparts."""

from __future__ import annotations

import math
from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from gridmeter.llm import mixing
from gridmeter.llm.queries import ORACLE, QUERIES

FOLDER = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    before, columns = docs, docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, FOLDER).cache()
        assert after.columns == columns, name
        had, has = ([r.doc_id for r in x.select("doc_id").collect()] for x in (before, after))
        assert has and set(has) <= set(had), name
        if name != "mixture":
            assert len(has) == len(set(has)), name
        else:  # a document is there as often as its weight, rounded down or up
            drawn = mixing.sample(before, mixing.document_dims(), mixing.document_tokens()).select("row.doc_id", "tokens", "weight", "copies").collect()
            assert Counter(has) == Counter({r.doc_id: r.copies for r in drawn if r.copies})
            assert all(r.copies in (math.floor(r.weight), math.ceil(r.weight)) for r in drawn if r.tokens)
            assert sum(r.tokens * r.weight for r in drawn) == pytest.approx(sum(r.tokens for r in drawn), rel=0.03)
        before = after
    pieces = corpus_pipeline.STAGES[-1][1](spark, before, FOLDER).collect()
    assert Counter(r.doc_id for r in pieces if r.start == 0) == Counter(has)
    assert len({(r.doc_id, r.copy, r.start) for r in pieces}) == len(pieces)
    again = corpus_pipeline.run(spark, FOLDER)
    assert again.count() == len(pieces)


def test_stages_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
        assert docs.count() == 0


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_queries_equal_their_sql(spark, name):
    db = duckdb.connect()
    for table in ("documents", "pages", "embeddings", "benchmark"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    want = db.execute(ORACLE[name])
    columns = [c[0] for c in want.description]
    got = QUERIES[name](spark, FOLDER).select(*columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.fetchall()))
