"""Rows that repeat a document, and rows without id, through the stages that drop near duplicates and lines."""

from collections import Counter

from cases import SCHEMA, odd_texts, rows_of

import corpus_pipeline
from llm.line_dedup import dedup_lines

SF = "/root/testdata/sf0.001"


def test_rows_of_one_document_stay_or_go_together(spark):
    text, other = odd_texts()[30][1], odd_texts()[35][1]
    docs = spark.createDataFrame(rows_of([(1, text)] * 3 + [(2, text)] * 2 + [(None, other)] * 2 + [(3, None)] * 2 + [(4, " ")]), SCHEMA)
    near = Counter(r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, docs, SF).collect())
    assert near == {1: 3, None: 2, 3: 2, 4: 1}
    lines = Counter(r.doc_id for r in corpus_pipeline.line_stage(spark, docs, SF).collect())
    assert lines == {1: 3, None: 2, 3: 2, 4: 1}


def test_columns_with_the_names_of_results_are_replaced(spark):
    docs = spark.createDataFrame([(1, "a b c\na b c", "x", 7)], "doc_id long, text string, n_removed string, n_lines long")
    out = dedup_lines(docs)
    assert out.columns == ["doc_id", "text", "n_lines", "n_removed"]
    assert tuple(out.first()) == (1, "a b c", 2, 1)
